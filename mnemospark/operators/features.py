"""Features of reviews as window columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Settings

#: First-interval cells below this many reviews are outliers, whatever comes before.
LEAST_CELL = 6
#: The share and the number of a learner's first intervals that may go as outliers.
OUTLIER_SHARE, OUTLIER_COUNT = 0.05, 20


def card() -> WindowSpec:
    """A card's reviews in order."""
    return Window.partitionBy("user_id", "card_id").orderBy("review_th")


def before() -> WindowSpec:
    return card().rowsBetween(Window.unboundedPreceding, -1)


def up_to() -> WindowSpec:
    return card().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def valid_reviews(reviews: DataFrame, two_buttons: bool = False) -> DataFrame:
    """Reviews rated 1 to 4; with two buttons, hard and easy count as good."""
    rows = reviews.filter(F.col("rating").between(1, 4))
    return rows.withColumn("rating", F.when(F.col("rating").isin(2, 4), F.lit(3).cast("long")).otherwise(F.col("rating"))) if two_buttons else rows


def capped(reviews: DataFrame, cap: int) -> DataFrame:
    """The first cap valid reviews of each card."""
    return reviews.withColumn("nth", F.row_number().over(card())).filter(F.col("nth") <= cap).drop("nth")


def interval(secs: bool) -> Column:
    """Days since the last review, never negative."""
    days = F.col("elapsed_seconds").cast("double") / F.lit(86400.0) if secs else F.col("elapsed_days").cast("double")
    return F.greatest(days, F.lit(0.0))


def histories(reviews: DataFrame, s: Settings) -> DataFrame:
    """All retained reviews with their features; those with delta_t > 0 can be evaluated.

    pos, i, lapses and ratings are counted over the retained reviews, including those that are
    not evaluated.
    """
    rows = capped(valid_reviews(reviews, s.two_buttons), s.history_cap)
    if not s.short:
        rows = rows.filter("elapsed_days <> 0")
    rows = rows.withColumn("delta_t", interval(s.secs)).withColumn("y", F.when(F.col("rating") == 1, F.lit(0)).otherwise(F.lit(1)).cast("long"))
    lapse = (F.col("rating") == 1) if s.secs else (F.col("rating") == 1) & (F.col("delta_t") != 0)
    return rows.select(
        "*",
        (F.row_number().over(card()) - 1).cast("long").alias("pos"),
        F.first("rating").over(up_to()).alias("first_rating"),
        F.coalesce(F.last(F.when(F.col("elapsed_days") > 0, F.col("rating")), ignorenulls=True).over(before()), F.first("rating").over(up_to())).alias("last_rating"),
        F.coalesce(F.sum(lapse.cast("long")).over(before()), F.lit(0)).cast("long").alias("rmse_bins_lapse"),
        (F.sum((F.col("elapsed_days") > 0).cast("long")).over(up_to()) + 1).cast("long").alias("i"),
        (F.first("elapsed_days").over(up_to()) <= 0).alias("card_has_i1"),
    )


def outlier_cells(rows: DataFrame) -> DataFrame:
    """(user_id, first_rating, elapsed_days, n, removed) of the second reviews' intervals.

    Cells go by count, then by longer interval, while the removed reviews stay below a share;
    as counts ascend, that is one running sum. Rare and over-long intervals go as well.
    """
    cells = rows.filter((F.col("i") == 2) & (F.col("delta_t") > 0)).groupBy("user_id", "first_rating", "elapsed_days").agg(F.count("*").alias("n"))
    group = Window.partitionBy("user_id", "first_rating")
    so_far = F.sum("n").over(group.orderBy("n", F.desc("elapsed_days")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bound = F.greatest(F.sum("n").over(group) * F.lit(OUTLIER_SHARE), F.lit(float(OUTLIER_COUNT)))
    longest = F.when(F.col("first_rating") == 4, F.lit(365)).otherwise(F.lit(100))
    removed = (F.col("so_far") < F.col("bound")) | (F.col("n") < LEAST_CELL) | (F.col("elapsed_days") > longest)
    return cells.select("*", so_far.alias("so_far"), bound.alias("bound")).select("user_id", "first_rating", "elapsed_days", "n", removed.alias("removed"))


def without_outliers(rows: DataFrame) -> DataFrame:
    """rows with evaluable false for outliers.

    A card whose second review is an outlier goes as a whole if it began as a new card, else
    only that review.
    """
    gone = outlier_cells(rows).filter("removed").select("user_id", "first_rating", "elapsed_days", F.lit(True).alias("outlier"))
    marked = rows.join(gone, ["user_id", "first_rating", "elapsed_days"], "left")
    own = F.coalesce(F.col("outlier"), F.lit(False)) & (F.col("i") == 2) & (F.col("delta_t") > 0)
    marked = marked.withColumn("own", own).withColumn("any", F.max("own").over(Window.partitionBy("user_id", "card_id")))
    drop = F.when(F.col("card_has_i1"), F.col("any")).otherwise(F.col("own"))
    return marked.withColumn("evaluable", F.col("evaluable") & ~drop).drop("outlier", "own", "any")


def features(reviews: DataFrame, s: Settings) -> DataFrame:
    """Histories with a flag evaluable: a positive interval and, in days, no outlier."""
    rows = histories(reviews, s).withColumn("evaluable", F.col("delta_t") > 0)
    return rows if s.secs else without_outliers(rows)


def evaluable(rows: DataFrame) -> DataFrame:
    return rows.filter("evaluable").drop("evaluable")


def with_partitions(rows: DataFrame, partition_map: DataFrame | None) -> DataFrame:
    """Adds partition: a card's deck or preset, 0 where the map has none."""
    if partition_map is None:
        return rows.withColumn("partition", F.lit(0).cast("long"))
    return rows.join(partition_map, ["user_id", "card_id"], "left").withColumn("partition", F.coalesce("partition", F.lit(0)).cast("long"))
