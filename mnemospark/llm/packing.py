"""Best-fit packing planned on the histogram of lengths.

The plan looks only at how many pieces there are of each length (at most ``capacity`` numbers),
never at pieces: best fit places a whole count at once, and a plan row says that the pieces of
a length with ranks [first, last) go to consecutive sequences. Pieces find their row by their
rank within their length; ranks come from per-bucket counts, so that no length, however common,
meets in one task.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import local_encoder

CAPACITY = 2048


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row; ids end with 0."""

    def run(batches):
        encode = local_encoder(path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return rows.mapInArrow(common.frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces a sequence, offset), best fit decreasing.

    Open sequences are kept as groups of equal free space. A count goes to the group with the
    least space that fits; each of its sequences takes as many pieces as fit, as best fit would
    do one by one. The rest of a group stays open. The rows number a few times the lengths.
    """
    out, spaces, groups, made = [], [], {}, 0

    def open_up(space: int, sequence: int, n: int) -> None:
        if space and n:
            if space not in groups:
                bisect.insort(spaces, space)
            groups.setdefault(space, []).append((sequence, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                sequence, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[k]
            else:
                space, n = capacity, -(-left // (capacity // length))
                sequence, made = made, made + n
            each = space // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            out.append((length, rank, rank + placed, sequence, each, capacity - space))
            rank, left = rank + placed, left - placed
            full = placed // each
            open_up(space - each * length, sequence, full)
            if placed % each:
                open_up(space - placed % each * length, sequence + full, 1)
            open_up(space, sequence + used, n - used)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Ties (equal lengths) are ordered by a hash bucket, then doc_id, piece, start; repeated rows
    take a place each. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    buckets = max(64, 4 * common.partitions(spark))
    table = common.stored(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int")), "pieces")
    counts = common.stored(table.groupBy("length", "bucket").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows, "length long, first long, last long, sequence long, each long, space long")
    slots = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "sequence", "each", "space"))).alias("slots"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = table.withColumn("nth", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
    # At most `capacity` rows of slots: the bound of the broadcast is the sequence length.
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth")).join(F.broadcast(slots), "length")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"]))[0]
    ranked = ranked.withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.first"))
    return ranked.select(
        *pieces.columns,
        (F.col("slot.sequence") + F.floor(F.col("k") / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.space") + F.col("k") % F.col("slot.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every row of docs: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null text counts as empty (its one id is the 0 at its end), a null doc_id stays null,
    repeated rows are packed each, very long texts are cut into pieces, other columns are
    ignored. Pieces of equal length are in the order of a hash. An empty table gives an empty
    table.
    """
    common.prepare(docs.sparkSession)
    return place(tokenized(docs, path, capacity), capacity)
