"""Results as JSON lines: formatting, sorted writing, reading back, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tree

METRICS = ("RMSE", "LogLoss", "RMSE(bins)", "AUC", "precision@90", "recall@90", "MBE")
SCHEMA = T.StructType([
    T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])),
    T.StructField("user", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("time_ms", T.DoubleType()),
])


def lines(results: DataFrame) -> DataFrame:
    """(user, value): one JSON text for each result, with ', ' and ': ' between its parts.

    Parameters come as JSON text (a list, or a map of lists) and are left out where null;
    a metric that is no finite number is null.
    """

    def number(c: F.Column) -> F.Column:
        """Plain decimals, of which six are kept, without zeros at the end but the first."""
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        plain = F.regexp_replace(F.when(finite, c).cast("decimal(28,6)").cast("string"), "0+$", "")
        return F.coalesce(F.regexp_replace(plain, r"\.$", ".0"), F.lit("null"))

    shown = F.concat_ws(", ", *[F.concat(F.lit(f'"{m}": '), number(F.col(f"metrics.`{m}`"))) for m in METRICS])
    spread = F.regexp_replace(F.regexp_replace("parameters", r",\s*", ", "), r'":\s*', '": ')
    parts = [F.concat(F.lit('{"metrics": {'), shown, F.lit("}")), F.concat(F.lit('"user": '), F.col("user").cast("string")), F.concat(F.lit('"size": '), F.col("size").cast("string"))]
    parts += [F.concat(F.lit('"parameters": '), spread), F.concat(F.lit('"time_ms": '), number(F.col("time_ms")))]
    return results.select("user", F.concat(F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def write(results: DataFrame, path: str) -> None:
    """One file of lines ordered by user, those without one last; an old file is replaced when all is written.

    Only the finished lines, one a learner, go to the task that writes the file.
    """
    tree.write_lines(lines(results).repartition(1).sortWithinPartitions(F.col("user").asc_nulls_last()).select("value"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Results read back; blank and unparsable lines are dropped, lines without a user stay."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    kind = T.StructType([*SCHEMA.fields, T.StructField("_bad", T.StringType())])
    parsed = text.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r._bad IS NULL").select("r.*").drop("_bad")


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new results together."""
    return existing.unionByName(new)


def not_done(reviews: DataFrame, existing: DataFrame) -> DataFrame:
    """Reviews of learners without a result."""
    done = existing.filter("user IS NOT NULL").select(F.col("user").alias("user_id")).distinct()
    return reviews.join(done, "user_id", "left_anti")
