"""Review logs: partitioned Parquet trees, and an adapter for the events table.

A review log has user_id, card_id, review_th, rating, elapsed_days, elapsed_seconds; review_th
is the order of a learner's reviews. Columns that no model reads are not selected, so the scan
prunes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tree

COLUMNS = ("user_id", "card_id", "review_th", "rating", "elapsed_days", "elapsed_seconds")
_READ = ("card_id", "rating", "elapsed_days", "elapsed_seconds")
REVLOG = T.StructType([T.StructField(c, T.LongType()) for c in (*_READ, "user_id")])
CARDS = T.StructType([T.StructField(c, T.LongType()) for c in ("card_id", "deck_id", "user_id")])
DECKS = T.StructType([T.StructField(c, T.LongType()) for c in ("deck_id", "preset_id", "user_id")])


def _tree(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    found = spark.read.parquet(f"{root}/{kind}")
    for f in schema.fields:
        if f.name not in found.columns:
            raise ValueError(f"{kind} has no column {f.name}")
        if f.name != "user_id" and found.schema[f.name].dataType != T.LongType():
            raise TypeError(f"{kind}.{f.name} is {found.schema[f.name].dataType.simpleString()}, not bigint")
    return found.withColumn("user_id", F.col("user_id").cast("long"))


def _not_null(c: str) -> F.Column:
    return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}")).cast("long")).alias(c)


def read_revlogs(spark: SparkSession, root: str, max_user_id: int | None = None, strict: bool = True) -> DataFrame:
    """The tree root/revlogs/user_id=*/: reviews numbered by file path and place in the file.

    A bound on user_id prunes directories. A missing column or another type than bigint is an
    error, and so is a null; not strict, a learner with a null is left out instead.
    """
    rows = _tree(spark, root, "revlogs", REVLOG)
    if max_user_id is not None:
        rows = rows.filter(F.col("user_id") <= max_user_id)
    if not strict:
        rows = rows.withColumn("nulls", F.max(_null_in(*_READ)).over(Window.partitionBy("user_id"))).filter("nulls IS NULL")
    rows = rows.select("user_id", *map(_not_null, _READ), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    order = Window.partitionBy("user_id").orderBy("path", "place")
    return rows.withColumn("review_th", F.row_number().over(order).cast("long")).select(*COLUMNS)


def _null_in(*columns: str) -> F.Column:
    """The first of the columns that is null in a row, null if none is."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def nulls(spark: SparkSession, root: str, max_user_id: int | None = None) -> DataFrame:
    """(user_id, column): learners whose reviews hold a null, with a column that does."""
    rows = _tree(spark, root, "revlogs", REVLOG)
    rows = rows.filter(F.col("user_id") <= max_user_id) if max_user_id is not None else rows
    return rows.groupBy("user_id").agg(F.max(_null_in(*_READ)).alias("column")).filter("column IS NOT NULL")


def learners_with(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(user_id) of the learners that have a directory in the tree root/kind, with files or without."""
    return tree.learners(spark, root, kind).select("user_id").distinct()


def without_files(spark: SparkSession, root: str, kind: str = "revlogs") -> DataFrame:
    """(user_id) of the learners whose directory in the tree holds no Parquet file."""
    return tree.learners(spark, root, kind).groupBy("user_id").agg(F.sum("files").alias("files")).filter("files = 0").select("user_id")


def users(spark: SparkSession, root: str, max_user_id: int | None = None) -> DataFrame:
    """Learners of the tree, ascending, by their directories."""
    found = learners_with(spark, root, "revlogs")
    return (found.filter(F.col("user_id") <= max_user_id) if max_user_id is not None else found).orderBy("user_id")


def _last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the last row of each (user_id, key) in file order."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return rows.select("user_id", key, value, at.alias("at")).groupBy("user_id", key).agg(F.max_by(value, "at").alias(value))


def read_partition_map(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(user_id, card_id, partition) by deck or preset; of repeated keys the last row counts."""
    cards = _last(_tree(spark, root, "cards", CARDS), "card_id", "deck_id")
    decks = _last(_tree(spark, root, "decks", DECKS), "deck_id", "preset_id") if kind == "preset" else None
    return partition_map(cards, decks)


def partition_map(cards: DataFrame, decks: DataFrame | None) -> DataFrame:
    """A card's partition is its deck or, given decks, the deck's preset; a deck without one stands for itself."""
    if decks is None:
        return cards.select("user_id", "card_id", F.col("deck_id").alias("partition"))
    joined = cards.join(decks, ["user_id", "deck_id"], "left")
    return joined.select("user_id", "card_id", F.coalesce("preset_id", "deck_id").alias("partition"))


#: The rating that an event type stands for; others are invalid.
EVENT_RATING = {"error": 1, "view": 2, "click": 3, "purchase": 4}


def from_events(events: DataFrame, days_view: bool = False) -> DataFrame:
    """A review log out of events (event_id, ts, user_id, event_type, props).

    A card is props.k modulo 5. In the days view learners are merged modulo 3 and their cards
    kept apart, so that first intervals are frequent enough for outlier removal.
    """
    k = F.get_json_object("props", "$.k").cast("long") % 5
    learner = F.col("user_id") % 3 if days_view else F.col("user_id")
    card = F.col("user_id") * 5 + k if days_view else k
    rating = F.lit(0).cast("long")
    for kind, r in EVENT_RATING.items():
        rating = F.when(F.col("event_type") == kind, F.lit(r).cast("long")).otherwise(rating)
    rows = events.select(learner.alias("user_id"), card.alias("card_id"), F.col("event_id").alias("review_th"), "ts", rating.alias("rating"))
    before = F.lag("ts").over(Window.partitionBy("user_id", "card_id").orderBy("review_th"))
    days = F.datediff(F.col("ts").cast("date"), F.col("before").cast("date"))
    seconds = F.timestamp_diff("SECOND", F.col("before"), F.col("ts"))
    return rows.withColumn("before", before).select(
        "user_id", "card_id", "review_th", "rating",
        F.coalesce(days, F.lit(-1)).cast("long").alias("elapsed_days"), F.coalesce(seconds, F.lit(-1)).cast("long").alias("elapsed_seconds"),
    )


def event_decks(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and decks to go with from_events: deck 2 has no preset."""
    cards = reviews.select("user_id", "card_id").distinct().withColumn("deck_id", F.col("card_id") % 3)
    decks = cards.select("user_id", "deck_id").distinct().filter("deck_id <> 2").withColumn("preset_id", F.col("deck_id") % 2)
    return cards, decks
