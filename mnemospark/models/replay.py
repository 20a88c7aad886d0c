"""Recurrent models as plans: training in groups of (learner, fold, partition), told by joins.

Training is the only Python: folds and partitions of a learner are trainings of their own, which a
task runs side by side, and each gives one row of a table of parameters. A tested card joins
the row of its learner, fold and partition, or takes the default weights, and replays its history
natively: one array a card and fold, one expression for the model's step.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.folds import states
from . import ebisu, evaluate, lockstep, onestep, recurrent
from .learner import NEEDED, Learner, folds

PARAMETERS = "user_id long, fold long, partition long, w array<double>, text string, ms double"
ASKED = ("fold", "pos", "review_th", "y", "delta_t", "i", "rmse_bins_lapse")
ONE_STEP = "FSRS-6-one-step"
#: Reviews of learners that are trained online in lock-step; reviews of trainings; cards that are updated in lock-step.
BLOCK, TRAINED, CARDS = 1 << 17, 1 << 16, 2048


def stabilities(m: recurrent.Recurrence, history: Column, w: list[Column], s_min: float) -> Column:
    """array<double>: the stability after each review of history (pos, rating, delta_t)."""
    fields = [f"x{k}" for k in range(len(m.begin(F.lit(1.0), w, s_min)))]

    def struct(state: tuple[Column, ...]) -> Column:
        held = (F.least(F.greatest(state[0], F.lit(s_min)), F.lit(recurrent.S_MAX)), *state[1:])
        return F.struct(*[x.alias(n) for x, n in zip(held, fields, strict=True)])

    def step(state: Column, review: Column) -> Column:
        r = review["rating"].cast("double")
        # A stability is 0 before the first review only.
        again = m.step(tuple(state[n] for n in fields), review["delta_t"], r, w, s_min)
        return F.when(state["x0"] > 0, struct(again)).otherwise(struct(m.begin(r, w, s_min)))

    return states(history, F.struct(*[F.lit(0.0).alias(n) for n in fields]), "double", step, lambda state: state["x0"])


def placed(rows: DataFrame, s: Settings) -> DataFrame:
    """Adds before (evaluated reviews of the learner before this one), size and first (of the folds), and
    fold, which tests the review, null where none does. Learners with too few reviews are left out."""
    user, counted = Window.partitionBy("user_id"), F.col("evaluable").cast("long")
    before = F.coalesce(F.sum(counted).over(user.orderBy("review_th").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumns({"before": before, "n": F.sum(counted).over(user)}).filter(F.col("n") >= evaluate.LEAST)
    found = found.withColumn("size", F.expr(f"nullif(n div {s.n_splits + 1}, 0)")).withColumn("first", F.col("n") - s.n_splits * F.col("size"))
    fold = F.lit(0).cast("long") if whole(s) else F.expr("(before - first) div size")
    return found.withColumn("fold", F.when(F.col("evaluable") & (F.col("before") >= F.col("first")), fold))


def tasks_of(rows: DataFrame) -> int:
    """Few bytes, much work: a fixed number of partitions, which adaptive execution does not merge."""
    spark = rows.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole(s: Settings) -> bool:
    """Whether one training on the whole log tests all of its folds."""
    return s.algo == "FSRS-6" and s.train_equals_test and s.partitions == "none"


def training(found: DataFrame, s: Settings) -> DataFrame:
    """The reviews before each fold's first one, as often as folds train on them.

    The fold f begins at the evaluated review numbered first + f * size; others go with those
    that they stand before.
    """
    if whole(s):
        return found.select(*NEEDED, F.lit(0).cast("long").alias("fold"))
    past = F.col("before") - F.col("first") + F.when(F.col("evaluable"), F.col("size")).otherwise(F.col("size") - 1)
    earliest = F.greatest(F.floor(past / F.col("size")), F.lit(0))
    used = found.withColumn("earliest", earliest).filter(F.col("earliest") < s.n_splits)
    return used.select(*NEEDED, F.explode(F.sequence("earliest", F.lit(s.n_splits - 1).cast("long"))).alias("fold"))


def parameters(found: DataFrame, s: Settings, most: int = TRAINED) -> DataFrame:
    """PARAMETERS trained on each fold's earlier reviews; partitions without evaluated ones have none.

    A task reads its trainings in order and runs them in lock-step, in blocks of about most
    reviews. The time is a training's share of its block's.
    """
    keys = ("user_id", "fold", "partition")
    names = [c.split()[0] for c in PARAMETERS.split(", ")]
    columns = ("review_th", "rating", "delta_t", "pos", "i", "evaluable")

    def block(ids: list[np.ndarray], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        began, parts = time.perf_counter(), [np.concatenate(x) for x in parts]
        heads = np.flatnonzero(np.append(True, (np.stack(ids)[:, 1:] != np.stack(ids)[:, :-1]).any(0)))
        sizes = np.diff(np.append(heads, len(ids[0])))
        with np.errstate(all="ignore"):
            w = lockstep.recurrent_weights(recurrent.MODELS[s.algo], np.repeat(np.arange(len(heads)), sizes), *parts, len(heads), s)
        some = np.add.reduceat(parts[-1].astype(np.int64), heads) > 0
        told, ms = w[some].tolist(), (time.perf_counter() - began) * 1000 / len(heads)
        texts = [json.dumps(evaluate.rounded(x)) for x in told]
        return pa.RecordBatch.from_arrays([*(pa.array(x[heads][some]) for x in ids), pa.array(told, pa.list_(pa.float64())), pa.array(texts, pa.string()), pa.array([ms] * len(told), pa.float64())], names)

    def fit(batches):
        for held in lockstep.blocks(batches, len(keys), most):
            yield block([np.concatenate(x) for x in held[:3]], held[3:])

    log = training(found, s).select(*keys, "review_th", F.col("rating").cast("byte"), "delta_t", F.col("pos").cast("short"), F.col("i").cast("short"), "evaluable", "card_id")
    dealt = log.repartition(tasks_of(found), *keys).sortWithinPartitions(*keys, "card_id", "pos")
    return dealt.drop("card_id").mapInArrow(fit, PARAMETERS)


def one_step(rows: DataFrame, s: Settings) -> DataFrame:
    """PARAMETERS of the model that is trained online, for all folds of a block of learners at once.

    A task reads its learners in order and trains them in blocks of about BLOCK reviews. The
    time is a training's share of its block's.
    """
    names, m = [c.split()[0] for c in PARAMETERS.split(", ")], recurrent.MODELS["FSRS-6"]

    def block(logs: list[pd.DataFrame]) -> pd.DataFrame:
        began, start, keys, tasks = time.perf_counter(), m.weights(s.secs), [], []
        for log in logs:
            x = Learner.of(log)
            for f, (end, _) in enumerate(folds(len(x), s.n_splits) if len(x) >= evaluate.LEAST else []):
                with np.errstate(all="ignore"):
                    first = evaluate.with_s0(recurrent.MODELS["FSRS-6"], x, np.arange(end), s, start, local=True)
                keys.append((int(log["user_id"].iloc[0]), f, 0))
                tasks.append((x, end, first))
        found = onestep.train(tasks).tolist()
        ms = (time.perf_counter() - began) * 1000 / max(len(tasks), 1)
        return pd.DataFrame([(*key, w, json.dumps(evaluate.rounded(w)), ms) for key, w in zip(keys, found, strict=True)], columns=names)

    def run(batches):
        logs, held, size = [], None, 0
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            each = [g for _, g in held.groupby("user_id", sort=True)]
            *done, held = each or [held]  # the last learner may go on
            logs, size = [*logs, *done], size + sum(map(len, done))
            if size >= BLOCK:
                yield block(logs)
                logs, size = [], 0
        if held is not None and len(held):
            logs.append(held)
        if logs:
            yield block(logs)

    return rows.select(*NEEDED).repartition(tasks_of(rows), "user_id").sortWithinPartitions("user_id").mapInPandas(run, PARAMETERS)


def as_text(weights: list[float]) -> str:
    return json.dumps(evaluate.rounded({"0": weights}))


def tests_of(found: DataFrame, by_fold: bool = False) -> DataFrame:
    """A row for each tested card (and fold): the card's history, and what is asked of it."""
    asked = F.col("fold").isNotNull()
    tests = found.groupBy("user_id", "card_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "rating", "delta_t"))).alias("history"), F.max("partition").alias("partition"),
        F.collect_list(F.when(asked, F.struct(*ASKED))).alias("asked"), F.max(F.when(asked, F.col("pos"))).cast("int").alias("longest"),
    ).filter("longest IS NOT NULL")
    if not by_fold:
        return tests
    tests = tests.withColumn("fold", F.explode(F.array_distinct(F.transform("asked", lambda x: x["fold"]))))
    return tests.withColumn("asked", F.filter("asked", lambda x: x["fold"] == F.col("fold"))).withColumn("longest", F.array_max(F.transform("asked", lambda x: x["pos"])).cast("int"))


def bayesian(rows: DataFrame, s: Settings) -> DataFrame:
    """Probabilities of the tested reviews under the half-life model, cards in lock-step.

    A batch of cards, whosever they are, takes its k-th review together.
    """

    def recalls(batches):
        for b in batches:
            out, longest = [None] * len(b), b["longest"].to_numpy()
            order = np.argsort(longest, kind="stable")
            for i in range(0, len(order), CARDS):  # cards of like length, so that few wait for a long one
                some = order[i : i + CARDS]
                n = int(longest[some].max())
                intervals, ratings = np.zeros((len(some), n)), np.zeros((len(some), n), int)
                for row, k in enumerate(some):
                    for j, review in enumerate(b["history"].iat[k][: longest[k]]):
                        intervals[row, j], ratings[row, j] = review["delta_t"], review["rating"]
                models = ebisu.after(intervals, ratings, longest[some])
                for row, k in enumerate(some):
                    asked = b["asked"].iat[k]
                    at, t = np.array([x["pos"] for x in asked]), np.array([x["delta_t"] for x in asked])
                    out[k] = ebisu.recall(models[row, at], np.maximum(t, 0.001))
            yield b[["user_id", "card_id", "asked"]].assign(told=out)

    tests = tests_of(placed(rows, s)).select("user_id", "card_id", "history", "asked", "longest")
    spread = tests.repartition(tasks_of(rows), "user_id", "card_id")
    schema = tests.select("user_id", "card_id", "asked").schema.add("told", T.ArrayType(T.DoubleType()))
    told = spread.mapInPandas(recalls, schema).select("user_id", "card_id", F.explode(F.arrays_zip("asked", "told")).alias("x"))
    return told.select("user_id", "card_id", "x.asked.*", F.col("x.told").alias("p")).select("user_id", "card_id", "review_th", "y", "delta_t", "i", "rmse_bins_lapse", "fold", "p")


def predictions(rows: DataFrame, s: Settings) -> DataFrame:
    """Probabilities of the tested reviews and the fold's parameters as JSON text.

    With training also time_ms, what a learner's folds up to the row's took. A review without a
    history has probability 0.
    """
    m = recurrent.MODELS["FSRS-6" if s.algo == ONE_STEP else s.algo]
    found, start = placed(rows, s), m.weights(s.secs).tolist()
    extra, plain = ["parameters"], s.default and (s.partitions == "none" or s.algo == ONE_STEP)
    tests = tests_of(found, by_fold=not plain)  # weights differ by fold
    if plain:
        w = [F.lit(float(x)) for x in start]
        tests = tests.withColumn("parameters", F.lit(as_text(start)))
    else:
        fold = Window.partitionBy("user_id", "fold")
        so_far = Window.partitionBy("user_id").orderBy("fold").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        part = F.concat(F.lit('"'), F.col("partition").cast("string"), F.lit('": '), F.col("text"))
        every = F.transform(F.array_sort(F.collect_list(F.struct("partition", part.alias("text"))).over(fold)), lambda x: x["text"])
        trained = (one_step(rows, s) if s.algo == ONE_STEP else parameters(found, s)).withColumns({"parameters": F.concat(F.lit("{"), F.array_join(every, ", "), F.lit("}")), "time_ms": F.sum("ms").over(so_far)})
        trained = trained.drop("partition") if s.algo == ONE_STEP else trained  # one training a fold, whatever the partitions
        keys = ["user_id", "fold"] if s.algo == ONE_STEP else ["user_id", "fold", "partition"]
        tests = tests.join(trained.drop("text", "ms"), keys, "left")
        tests = tests.withColumn("w", F.coalesce("w", F.array(*[F.lit(float(x)) for x in start])))
        w, extra = [F.col("w")[k] for k in range(len(start))], [*extra, "time_ms", "w"]
    after = stabilities(m, F.slice("history", F.lit(1), F.col("longest")), w, s.s_min)
    told = tests.withColumn("after", after).select("user_id", "card_id", "after", *extra, F.explode("asked").alias("a"))
    told = told.select("user_id", "card_id", *extra, "a.*", F.get("after", F.col("a.pos").cast("int") - 1).alias("stability"))
    p = F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(m.curve(F.col("delta_t"), F.col("stability"), w))
    return told.withColumn("p", p).select("user_id", "card_id", "review_th", "y", "delta_t", "i", "rmse_bins_lapse", "fold", "p", *[c for c in extra if c != "w"])
