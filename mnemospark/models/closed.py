"""Models without training, or at their default weights, as native Spark plans without Python."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import outputs
from ..functions.scalar import exploit_bins, half_even, sigmoid
from ..operators import history
from ..operators.splits import folds
from . import counts, regression

KEPT = ("user_id", "card_id", "review_th", "y", "delta_t", "i", "rmse_bins_lapse", "fold", "p")


def average(rows: DataFrame, n_splits: int = 5) -> DataFrame:
    """The mean label of everything before the fold."""
    user = Window.partitionBy("user_id")
    before = F.sum("y").over(user.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))
    placed = folds(rows, n_splits).withColumn("before", before)
    fold = Window.partitionBy("user_id", "fold")
    tested = placed.filter("fold IS NOT NULL").withColumn("start", F.min("rn").over(fold)).withColumn("hits", F.min_by("before", "rn").over(fold))
    return tested.withColumn("p", F.when(F.col("start") > 0, F.col("hits") / F.nullif(F.col("start").cast("double"), F.lit(0.0))).otherwise(F.lit(0.5))).select(*KEPT)


def _log(rows: DataFrame, *columns: str) -> DataFrame:
    """One sorted array of a learner's reviews: its size is the learner's log."""
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", *columns))).alias("log"))


def moving_average(rows: DataFrame, n_splits: int = 5, start: float = 1.2, rate: float = 0.3) -> DataFrame:
    """sigma(x) before each review; x moves by rate times the error. Runs from the first review on."""
    placed = folds(rows, n_splits)

    def step(x: Column, r: Column) -> tuple[Column, Column]:
        return x + rate * (r["y"].cast("double") - sigmoid(x)), sigmoid(x)

    told = outputs(F.col("log"), F.lit(start), "double", step)
    each = _log(placed, "y").select("user_id", F.posexplode(told).alias("rn", "p"))
    return placed.filter("fold IS NOT NULL").join(each, ["user_id", "rn"]).select(*KEPT)


def bins_exploit(rows: DataFrame, n_splits: int = 5) -> DataFrame:
    """Predicts what brings its bin's sum of predictions to its sum of labels plus the mean label.

    The mean is that of earlier tested reviews; the first review gets 0.5, which is not counted
    in its bin's predictions. Bins of a learner are independent, so each is one short fold.
    """
    tested = folds(rows, n_splits).filter("fold IS NOT NULL")
    before = Window.partitionBy("user_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    low, dt, i = exploit_bins(F.col("rmse_bins_lapse"), F.col("delta_t"), F.col("i"))
    tested = tested.withColumn("mean", F.avg("y").over(before)).withColumn("b1", low).withColumn("b2", dt).withColumn("b3", i)
    bins = ("user_id", "b1", "b2", "b3")
    logs = tested.groupBy(*bins).agg(F.array_sort(F.collect_list(F.struct("rn", "y", "mean"))).alias("log"))

    def step(state: Column, r: Column) -> tuple[Column, Column]:
        held = F.greatest(F.least(state["truth"] + r["mean"] - state["told"], F.lit(1.0)), F.lit(0.0))
        p = F.when(r["mean"].isNull(), F.lit(0.5)).otherwise(held)
        told = state["told"] + F.when(r["mean"].isNull(), F.lit(0.0)).otherwise(held)
        return F.struct((state["truth"] + r["y"]).alias("truth"), told.alias("told")), F.struct(r["rn"].alias("rn"), p.alias("p"))

    start = F.struct(F.lit(0.0).alias("truth"), F.lit(0.0).alias("told"))
    told = outputs(F.col("log"), start, "struct<rn:bigint,p:double>", step)
    each = logs.select("user_id", F.explode(told).alias("x")).select("user_id", F.col("x.rn").alias("rn"), F.col("x.p").alias("p"))
    return tested.join(each, ["user_id", "rn"]).select(*KEPT)


def sm2_intervals(features: DataFrame) -> DataFrame:
    """(user_id, card_id, pos, interval): the interval that SM-2 sets before each review."""
    cards = features.groupBy("user_id", "card_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rating"))).alias("history"))

    def step(acc: Column, r: Column) -> Column:
        grade = r["rating"] + 1
        good = grade > 2
        reps = F.when(good, acc["reps"] + 1).otherwise(F.lit(0))
        raw = F.when(~good | (reps == 1), F.lit(1.0)).when(reps == 2, F.lit(6.0)).otherwise(acc["interval"] * acc["ease"])
        interval = F.greatest(F.least(half_even(raw + 0.01), F.lit(36500.0)), F.lit(1.0))
        gap = (5 - grade).cast("double")
        ease = F.greatest(acc["ease"] + (0.1 - gap * (0.08 + gap * 0.02)), F.lit(1.3))
        return F.struct(interval.alias("interval"), reps.alias("reps"), ease.alias("ease"), F.concat(acc["all"], F.array(interval)).alias("all"))

    start = F.struct(F.lit(0.0).alias("interval"), F.lit(0).alias("reps"), F.lit(2.5).alias("ease"), F.array(F.lit(0.0)).alias("all"))
    each = F.aggregate("history", start, step, lambda acc: acc["all"])
    return cards.select("user_id", "card_id", F.posexplode(each).alias("pos", "interval"))


def sm2(features: DataFrame, n_splits: int = 5) -> DataFrame:
    """0.9 to the interval over SM-2's; a review without a history gets 0."""
    tested = folds(features.filter("evaluable"), n_splits).filter("fold IS NOT NULL")
    joined = tested.join(sm2_intervals(features), ["user_id", "card_id", "pos"])
    decay = F.exp(F.ln(F.lit(0.9)) * F.col("delta_t") / F.nullif(F.col("interval"), F.lit(0.0)))
    return joined.withColumn("p", F.when(F.col("interval") == 0, F.lit(0.0)).otherwise(decay)).select(*KEPT)


#: Models on features of a history, which their default weights turn into a probability.
WEIGHTED = ("HLR", "DASH", "DASH[MCM]", "LogisticRegression")


def weighted(rows: DataFrame, algo: str, short: bool, n_splits: int = 5) -> DataFrame:
    """A weighted model at its default weights, which go along as JSON text."""
    if algo == "LogisticRegression":
        w = [float(x) for x in regression.MEAN]
        text, z = w, sum((F.col(n) * v for n, v in zip(history.LOGREG, w, strict=True)), F.lit(0.0))
        found, p = history.logreg_features(rows), sigmoid(z)
    else:
        w = [float(x) for x in counts.MODELS[algo].weights(short)]
        text = {"0": w}
        if algo == "HLR":
            half = F.pow(F.lit(2.0), F.col("passed") * w[0] + F.col("failed") * w[1] + w[2])
            found, p = history.hlr_features(rows), F.exp(F.ln(F.lit(0.5)) * F.col("delta_t") / half)
        else:
            z = sum((F.log1p(n) * v for n, v in zip(history.DASH, w, strict=False)), F.lit(w[8]))
            found, p = history.dash_features(rows, algo == "DASH[MCM]"), sigmoid(z)
    placed = folds(found, n_splits).filter("fold IS NOT NULL").withColumn("p", p)
    return placed.select(*KEPT, F.lit(json.dumps(text)).alias("parameters"))
