"""Calibration and ranking metrics of predictions (user_id, y, p, delta_t, i, rmse_bins_lapse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import bin_delta_t, bin_i, bin_lapse, round6

#: Probabilities are kept this far from 0 and 1 in the log loss.
EPSILON = 2.220446049250313e-16
NAMES = ("rmse", "logloss", "rmse_bins", "auc", "precision_90", "recall_90", "mbe")


def precision_recall(y: Column, p: Column, n: Column | None = None) -> tuple[Column, Column]:
    """At p >= 0.9; 0 where there is nothing to divide by. y counts the passed of n predictions, or of one."""
    n = F.lit(1.0) if n is None else n
    called = (p >= 0.9).cast("double")
    hit, told, there = F.sum(called * y), F.sum(called * n), F.sum(y.cast("double"))
    return F.when(told > 0, hit / F.nullif(told, F.lit(0.0))).otherwise(F.lit(0.0)), F.when(there > 0, hit / F.nullif(there, F.lit(0.0))).otherwise(F.lit(0.0))


def bins(predictions: DataFrame) -> DataFrame:
    """(user_id, three bins, n, mean y, mean p)."""
    keyed = predictions.select("user_id", "y", "p", bin_delta_t(F.col("delta_t")).alias("bin_delta_t"), bin_i(F.col("i")).alias("bin_i"), bin_lapse(F.col("rmse_bins_lapse")).alias("bin_lapse"))
    return keyed.groupBy("user_id", "bin_delta_t", "bin_i", "bin_lapse").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))


def counted(predictions: DataFrame, *keys: str, **most: Column) -> DataFrame:
    """Predictions of one value (and of equal keys) as a row: n of them, passed of which passed."""
    return predictions.groupBy("user_id", *keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("passed"), *[F.max(c).alias(k) for k, c in most.items()])


def beaten() -> Column:
    """Failed reviews below the row's value, those of the same value by half."""
    failed = F.col("n") - F.col("passed")
    up_to = F.sum(failed).over(Window.partitionBy("user_id").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return up_to - F.sum(failed).over(Window.partitionBy("user_id", "p")) / F.lit(2.0)


def area(beaten: Column) -> Column:
    """Mann-Whitney from counts; null for a single class."""
    passed, failed = F.sum("passed").cast("double"), F.sum(F.col("n") - F.col("passed")).cast("double")
    return F.when(passed * failed > 0, F.sum(F.col("passed") * beaten) / F.nullif(passed * failed, F.lit(0.0)))


def auc(predictions: DataFrame) -> DataFrame:
    """The area under the curve of each learner, from its distinct predictions with their counts."""
    return counted(predictions).withColumn("beaten", beaten()).groupBy("user_id").agg(area(F.col("beaten")).alias("auc"))


def metrics(predictions: DataFrame, **most: Column) -> DataFrame:
    """(user_id, size, NAMES) rounded to 6 digits, and the largest of each further column.

    Predictions, which may be dear, are made once. Equal ones of a bin are counted before they
    are shuffled; windows run over these counts, not over reviews. A bin's squared gap counts
    once for each of its reviews.
    """
    p, n, passed = F.col("p"), F.col("n"), F.col("passed")
    placed = predictions.withColumns({"b1": bin_delta_t(F.col("delta_t")), "b2": bin_i(F.col("i")), "b3": bin_lapse(F.col("rmse_bins_lapse"))})
    same_bin = Window.partitionBy("user_id", "b1", "b2", "b3")
    gap = (F.sum(passed).over(same_bin) - F.sum(p * n).over(same_bin)) / F.sum(n).over(same_bin)
    cells = counted(placed, "b1", "b2", "b3", **most).withColumns({"beaten": beaten(), "gap": gap})
    q, failed, size = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON)), n - passed, F.sum(n)
    precision, recall = precision_recall(passed, p, n)
    found = cells.groupBy("user_id").agg(
        size.alias("size"), F.sqrt(F.sum(passed * (p - 1) * (p - 1) + failed * p * p) / size).alias("rmse"),
        (F.sum(-passed * F.ln(q) - failed * F.ln(1 - q)) / size).alias("logloss"), F.sqrt(F.sum(n * F.col("gap") * F.col("gap")) / size).alias("rmse_bins"),
        area(F.col("beaten")).alias("auc"), precision.alias("precision_90"), recall.alias("recall_90"), (F.sum(p * n - passed) / size).alias("mbe"),
        *[F.max(k).alias(k) for k in most],
    )
    return found.select("user_id", "size", *[round6(F.col(n)).alias(n) for n in NAMES], *most)
