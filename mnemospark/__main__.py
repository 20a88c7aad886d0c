"""Command line: evaluates a model on a tree of review logs and writes its records."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import MODELS, PARTITIONS, Settings
from .plans.evaluation import run, skipped

FLAGS = (
    "secs", "short", "two_buttons", "default", "recency", "train_equals_test", "equalize_test_with_non_secs", "no_test_same_day", "no_train_same_day",
    "sched_penalties", "duration", "dev",
)
#: Options of other drivers of these models that a command line may hold.
NO_EFFECT = {"--processes": 8, "--batch_size": 512, "--torch_num_threads": 1, "--gpus": None, "--raw": False, "--file": False, "--plot": False, "--weights": False}


def settings(argv: list[str] | None = None) -> tuple[argparse.Namespace, Settings]:
    parser = argparse.ArgumentParser(prog="mnemospark", description=__doc__)
    parser.add_argument("--algo", default="FSRSv3", choices=MODELS)
    parser.add_argument("--data", required=True, help="folder with revlogs, and cards and decks for --partitions")
    parser.add_argument("--out", default="result")
    parser.add_argument("--max-user-id", type=int)
    parser.add_argument("--partitions", default="none", choices=PARTITIONS)
    parser.add_argument("--max_seq_len", type=int, default=64)
    parser.add_argument("--n_splits", type=int, default=5)
    parser.add_argument("--S0", dest="only_s0", action="store_true")
    for flag in FLAGS:
        parser.add_argument(f"--{flag}", action="store_true")
    for flag, default in NO_EFFECT.items():
        parser.add_argument(flag, **({"action": "store_true"} if default is False else {"type": type(default or ""), "default": default}), help="accepted, without effect here")
    args = parser.parse_args(argv)
    for flag, default in NO_EFFECT.items():
        if getattr(args, flag.strip("-")) != default:
            print(f"{flag} has no effect here", file=sys.stderr)
    names = Settings.__dataclass_fields__
    return args, Settings(**{k: v for k, v in vars(args).items() if k in names})


def main(argv: list[str] | None = None) -> None:
    args, s = settings(argv)
    spark = SparkSession.builder.appName("mnemospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = run(spark, args.data, args.out, s)
    for r in skipped(spark, args.data, found, s).orderBy("user_id").toLocalIterator():  # one partition at a time
        print(f"learner {r['user_id']} {r['reason']}", file=sys.stderr)
    print(f"{found.count()} records in {args.out}/{s.result_name}.jsonl")


if __name__ == "__main__":
    main()
