"""Time-ordered folds, equalised folds and recency weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def user() -> WindowSpec:
    return Window.partitionBy("user_id")


def log() -> WindowSpec:
    return user().orderBy("review_th")


def placed(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Adds rn (place of a review in its learner's log, from 0) and n (reviews of the learner).

    A learner's log is one task's, unless a block is given: then stretches of so many review
    numbers are numbered side by side, from offsets that the stretches' counts add up to, so that
    the log of one learner, however long, is spread over tasks.
    """
    if block is None:
        return rows.withColumn("rn", (F.row_number().over(log()) - 1).cast("long")).withColumn("n", F.count("*").over(user()))
    stretch = F.floor(F.col("review_th") / block)
    counts = rows.groupBy("user_id", stretch.alias("stretch")).agg(F.count("*").alias("inside"))
    before = F.coalesce(F.sum("inside").over(user().orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("user_id", "stretch", before.alias("before"), F.sum("inside").over(user()).alias("n"))
    within = F.row_number().over(Window.partitionBy("user_id", "stretch").orderBy("review_th"))
    numbered = rows.withColumn("stretch", stretch).withColumn("within", within).join(offsets, ["user_id", "stretch"])
    return numbered.withColumn("rn", (F.col("before") + F.col("within") - 1).cast("long")).select(*rows.columns, "rn", "n")


def folds(rows: DataFrame, n_splits: int = 5, block: int | None = None) -> DataFrame:
    """Adds rn (place of a review, from 0), n, test_size and fold.

    Fold f tests the f-th of n_splits stretches of n div (n_splits + 1) reviews that end the
    log; a fold trains on everything before it. Reviews before the first stretch have no fold.
    Learners with fewer than six reviews are left out. block is that of placed.
    """
    rows = placed(rows, block).filter("n >= 6")
    rows = rows.withColumn("test_size", F.expr(f"n div {n_splits + 1}"))
    first = F.col("n") - n_splits * F.col("test_size")
    place = F.expr(f"(rn - (n - {n_splits} * test_size)) div nullif(test_size, 0)")
    return rows.withColumn("fold", F.when((F.col("rn") >= first) & (F.col("test_size") > 0), place))


def equalised(secs_rows: DataFrame, day_rows: DataFrame, n_splits: int = 5) -> DataFrame:
    """(user_id, fold, review_th, train_end): tests of the days' folds found among the rows in seconds.

    train_end counts the learner's rows in seconds before the fold's first review: that review
    is merged into the log as a mark, and a running count gives every mark its place.
    """
    days = folds(day_rows, n_splits).filter("fold IS NOT NULL").select("user_id", "review_th", "fold")
    marks = days.groupBy("user_id", "fold").agg(F.min("review_th").alias("review_th")).withColumn("counts", F.lit(0).cast("long"))
    each = secs_rows.select("user_id", "review_th")
    merged = each.withColumns({"fold": F.lit(None).cast("long"), "counts": F.lit(1).cast("long")}).unionByName(marks)
    # A mark comes before the review that it marks.
    so_far = F.sum("counts").over(user().orderBy("review_th", "counts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = merged.withColumn("train_end", so_far).filter("counts = 0").select("user_id", "fold", "train_end")
    return each.join(days, ["user_id", "review_th"]).join(ends, ["user_id", "fold"])


def recency_weights(rows: DataFrame) -> DataFrame:
    """Adds the weights of a whole log as training rows: cubic, and the regression's quartic."""
    x = F.when(F.col("n") > 1, F.col("rn").cast("double") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rn", (F.row_number().over(log()) - 1).cast("long")).withColumn("n", F.count("*").over(user())).withColumn("x", x)
    return rows.withColumn("cubic", 0.25 + 0.75 * F.col("x") * F.col("x") * F.col("x")).withColumn("quartic", 0.1 + 0.9 * F.pow("x", F.lit(4.0)))
