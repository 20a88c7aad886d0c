"""Shared helpers: shared-folder tables, row numbers, null handling, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text separators of the contracts: space and \x09-\x0D.
ASCII_SPACE = r"\x20\x09-\x0D"

#: Bytes of an Arrow batch sent to Python: bounds what a worker holds at once. Spark's own bound, in place where the user has set none.
ARROW_BYTES, ARROW_UNSET = "4m", "67108864b"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes an execution's shuffle files as it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and master is this machine (as in tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "mnemospark-shared")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Bound this session's Arrow batches where the user has not; called by operators that use Python.

    Batches are made when a returned DataFrame runs, so the setting has to stay.
    """
    if spark.conf.get(_ARROW) == ARROW_UNSET:
        spark.conf.set(_ARROW, ARROW_BYTES)


def release() -> None:
    """Give a worker's freed memory back to the system: workers are used again by other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function after whose last batch freed memory is given back."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only its own running tasks. Schema is passed on,
    so that an empty table reads back too. The shuffle files behind df go as soon as it is
    written. Tables lie in the shared folder until its owner clears it, as a returned
    DataFrame may read them at any time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text column, null counted as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str | None:
    """The mounted path of a file: URI, None for a store that only Spark reads."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, row, text): row holds all columns but text, rid numbers rows in the order of doc_id.

    Null ids come last, rows of one doc_id in no fixed order. Where doc_id is unique, it is rid.
    Otherwise rows are dealt into ranges of (doc_id, hash of the text, place in the input), so
    that neither null ids nor copies meet in one task, and numbered by range and place: 2 ** 31
    ranges of 2 ** 33 rows, whatever the ids are.
    """
    doc_id = docs["doc_id"].cast("long")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    same = docs.groupBy(doc_id.alias("doc_id")).agg(F.count("*").alias("n"))
    most, nulls = same.agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if (most or 1) == 1 and not nulls:
        return docs.select(doc_id.alias("rid"), row, text_of(docs).alias("text"))
    rows = docs.select(doc_id.alias("id"), row, text_of(docs).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = (F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("place"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.select(F.monotonically_increasing_id().alias("rid"), "row", "text"), "numbered")


def in_order(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of a row and its text as they were before numbered."""
    return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def packed(rows: DataFrame) -> DataFrame:
    """(rid, row, packed) of numbered rows: texts compressed before they are shuffled."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary())], ["rid", "row", "packed"])

    schema = rows.drop("text").schema.add("packed", "binary")
    return rows.select("rid", "row", "text").mapInArrow(frugal(run), schema)
