"""From reviews to results: features, folds, a model, metrics, one record for each learner."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODELS, Settings
from ..functions.metrics import NAMES, metrics
from ..models import closed, evaluate, recurrent, replay
from ..operators.features import evaluable, features, with_partitions
from ..operators.splits import equalised
from ..sources import results, revlog, tree

NATIVE = ("AVG", "MOVING-AVG", "RMSE-BINS-EXPLOIT", "SM2")
#: Trees that a learner must be in, by the kind of partitions.
TREES = {"none": (), "deck": ("cards",), "preset": ("cards", "decks")}
FEW = "does not have enough data"
#: Fields of a record's metrics, from the columns of functions.metrics.
FIELDS = dict(zip(("RMSE", "LogLoss", "RMSE(bins)", "AUC", "precision@90", "recall@90", "MBE"), NAMES, strict=True))


def with_equal_folds(rows: DataFrame, reviews: DataFrame, s: Settings) -> DataFrame:
    """Adds equal_fold and equal_end out of the days' folds; learners without such folds go."""
    days = Settings(**{**s.__dict__, "secs": False})
    tests = equalised(evaluable(rows), evaluable(features(reviews, days)), s.n_splits)
    tests = tests.select("user_id", "review_th", F.col("fold").cast("long").alias("equal_fold"), F.col("train_end").cast("long").alias("equal_end"))
    kept = rows.join(tests.select("user_id").distinct(), "user_id", "left_semi").join(tests, ["user_id", "review_th"], "left")
    return kept.withColumn("equal_fold", F.coalesce("equal_fold", F.lit(-1))).withColumn("equal_end", F.coalesce("equal_end", F.lit(0)))


def prepared(reviews: DataFrame, s: Settings, partition_map: DataFrame | None = None) -> DataFrame:
    rows = with_partitions(features(reviews, s), partition_map if s.partitions != "none" else None)
    return with_equal_folds(rows, reviews, s) if s.equalize_test_with_non_secs and s.secs else rows


def predictions(reviews: DataFrame, s: Settings, partition_map: DataFrame | None = None) -> DataFrame:
    """Probabilities of the tested reviews: user_id, card_id, review_th, y, delta_t, i, rmse_bins_lapse, fold, p."""
    if s.algo not in MODELS:
        raise ValueError(f"unknown model {s.algo}")
    rows = prepared(reviews, s, partition_map)
    if s.algo == "AVG":
        return closed.average(evaluable(rows), s.n_splits)
    if s.algo == "MOVING-AVG":
        return closed.moving_average(evaluable(rows), s.n_splits)
    if s.algo == "RMSE-BINS-EXPLOIT":
        return closed.bins_exploit(evaluable(rows), s.n_splits)
    if s.algo == "SM2":
        return closed.sm2(rows, s.n_splits)
    if s.algo == "Ebisu-v2":
        return replay.bayesian(rows, s)
    if s.algo in recurrent.MODELS or s.algo == replay.ONE_STEP:
        return replay.predictions(rows, s)
    if s.default and s.algo in closed.WEIGHTED and not s.equalize_test_with_non_secs:
        return closed.weighted(rows, s.algo, s.short, s.n_splits)
    return evaluate.predictions(rows, s)


def records(reviews: DataFrame, s: Settings, partition_map: DataFrame | None = None) -> DataFrame:
    """One record for each learner: metrics, user, size, parameters (JSON text), time_ms.

    Parameters are those of the last fold. time_ms is a learner's own time where a model is
    trained or told in its group; models that are plans have learners side by side, so theirs is
    the time since this call by the clock of the plan's start. Predictions are made once.
    """
    began = time.time()
    told = predictions(reviews, s, partition_map)
    took = F.greatest((F.unix_millis(F.current_timestamp()) - F.lit(int(began * 1000))).cast("double"), F.lit(0.0))
    most = {"time_ms": F.col("time_ms")} if "time_ms" in told.columns else {}
    if "parameters" in told.columns:
        most["last"] = F.struct(F.when(F.col("parameters").isNotNull(), F.col("fold")).alias("fold"), "parameters")
    each = metrics(told, **most)
    each = each.withColumn("parameters", F.col("last.parameters") if "last" in most else F.lit(None).cast("string"))
    each = each if "time_ms" in most else each.withColumn("time_ms", took)
    fields = F.struct(*[F.col(c).alias(n) for n, c in FIELDS.items()])
    return each.select(fields.alias("metrics"), F.col("user_id").alias("user"), "size", "parameters", F.round("time_ms", 3).alias("time_ms"))


def run(spark: SparkSession, data: str, out: str, s: Settings) -> DataFrame:
    """Evaluates the learners of a tree that out/<name>.jsonl has no record of; writes all records there.

    A learner that can't be evaluated gets no record and stops no other one: see skipped.
    """
    reviews = revlog.read_revlogs(spark, data, s.max_user_id, strict=False)
    for kind in TREES[s.partitions]:
        reviews = reviews.join(revlog.learners_with(spark, data, kind), "user_id", "left_semi")
    path = f"{out}/{s.result_name}.jsonl"
    partition_map = revlog.read_partition_map(spark, data, s.partitions) if s.partitions != "none" else None
    old = results.read(spark, path) if tree.exists(path) else None
    new = records(results.not_done(reviews, old) if old is not None else reviews, s, partition_map)
    results.write(results.merged(old, new) if old is not None else new, path)
    return results.read(spark, path)


def without_record(users: DataFrame, done: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(user_id, reason) of users (user_id) that done (user_id) has not; reasons (user_id, reason)
    are those known, too few reviews is the one that is left."""
    left = users.join(done, "user_id", "left_anti")
    if reasons is None:
        return left.select("user_id", F.lit(FEW).alias("reason"))
    return left.join(reasons.groupBy("user_id").agg(F.min("reason").alias("known")), "user_id", "left").select("user_id", F.coalesce("known", F.lit(FEW)).alias("reason"))


def skipped(spark: SparkSession, data: str, found: DataFrame, s: Settings) -> DataFrame:
    """(user_id, reason) of the learners of a tree that have no record in found: a directory without
    files, a null in a column, no cards or decks where partitions need them, or too few reviews."""
    users = revlog.users(spark, data, s.max_user_id)
    reasons = revlog.nulls(spark, data, s.max_user_id).select("user_id", F.concat(F.lit("has a null in "), F.col("column")).alias("reason"))
    reasons = reasons.unionByName(revlog.without_files(spark, data).select("user_id", F.lit("has no revlogs").alias("reason")))
    for kind in TREES[s.partitions]:
        reasons = reasons.unionByName(users.join(revlog.learners_with(spark, data, kind), "user_id", "left_anti").select("user_id", F.lit(f"has no {kind}").alias("reason")))
    return without_record(users, found.filter("user IS NOT NULL").select(F.col("user").alias("user_id")), reasons)
