"""Document fingerprints by Order MinHash; DataFrame functions only.

The k-mers of a text's words are numbered by occurrence, so repeats count, and each
(k-mer, occurrence) has a hash on a circle. Entry j of the sketch takes the ``PICKS`` pairs that
come first from the j-th point of the circle on, puts them back into text order, and hashes the
tuple: it agrees between two texts if the same k-mers were picked in the same order, so it
falls with edit distance, not only with the overlap of sets. One hash of a pair serves all
entries, and an entry whose arc is empty goes on round the circle, so short texts have full
sketches too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words in a k-mer, entries of a sketch, pairs picked for an entry, hex digits shown of an entry.
WIDTH, ENTRIES, PICKS, DIGITS = 2, 64, 2, 8
#: Bits of a sort key that hold a k-mer's position: all that an array's places need; the others hold its hash.
POSITION = 32
SEPARATOR, SPACES = f"[{common.ASCII_SPACE}]+", " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, width: int = WIDTH, entries: int = ENTRIES, picks: int = PICKS) -> Column:
    """array<long> of entries hashes. Texts without words have entries of 0; texts with fewer
    words than a k-mer have their whole sequence as the only one. Keys are alike for texts of any
    length; two k-mers of one text that share 32 bits of their hashes count as one."""
    bare = F.btrim(text, F.lit(SPACES))

    def of(words: Column) -> Column:
        return let(F.sort_array(keyed(words, width, POSITION)), lambda s: let(pairs(s, POSITION), lambda p: picked(p, entries, picks, POSITION)))

    return F.when(F.length(bare) == 0, zeros(entries)).otherwise(let(F.split(bare, SEPARATOR), of))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def keyed(words: Column, width: int, bits: int) -> Column:
    """Hash and position of each k-mer in one long: after sorting, equal k-mers are neighbours in
    text order. A k-mer that starts before the last one's start is whole; those after it are
    left out, unless there is no whole one."""
    hashed = F.transform(words, lambda w, i: F.shiftleft(F.xxhash64(w, *[F.get(words, i + j) for j in range(1, width)]), bits).bitwiseOR(i.cast("long")))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))


def pairs(s: Column, bits: int) -> Column:
    """Sorted longs: the circle hash of each (k-mer, occurrence) above its position."""
    n = F.size(s)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), bits) != 0))
    # Numbers within each run of equal k-mers: 0, 1, 2, ... up to the next run's start.
    number = let(first, lambda f: F.flatten(F.transform(f, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(f, j + 1), n) - a - 1))))
    place = F.lit((1 << bits) - 1).cast("long")
    return F.sort_array(F.zip_with(s, number, lambda x, c: F.shiftleft(F.xxhash64(F.shiftright(x, bits), c), bits).bitwiseOR(x.bitwiseAND(place))))


def picked(p: Column, entries: int, picks: int, position: int) -> Column:
    """The entries: arcs by the top of the circle hash, the first pairs from an arc's start on."""
    bits = entries.bit_length() - 1
    n, place = F.size(p), F.lit((1 << position) - 1).cast("long")
    arcs = F.transform(p, lambda x: (F.shiftright(x, 64 - bits) + entries // 2).cast("int"))

    def starts(a: Column) -> Column:
        # An empty arc starts where the next one does; past the last, at the circle's first pair.
        found = F.transform(F.sequence(F.lit(entries - 1), F.lit(0), F.lit(-1)), lambda j: F.array_position(a, j).cast("int") - 1)
        return F.aggregate(found, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(x >= 0, x).otherwise(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))

    def entry(at: Column) -> Column:
        chosen = F.transform(F.array(*[F.get(p, (at + i) % n) for i in range(picks)]), lambda x: F.shiftleft(x.bitwiseAND(place), 64 - position).bitwiseOR(F.shiftrightunsigned(x, position)))
        # Position first, so that sorting restores the text order; only the hashes are kept then.
        return F.xxhash64(F.transform(F.sort_array(F.array_distinct(chosen)), lambda x: F.shiftleft(x, position)))

    return let(let(arcs, starts), lambda s: F.transform(s, entry))


def likeness(a: Column, b: Column) -> Column:
    """Share of the entries that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.size(a)


def shown(entries: Column, digits: int = DIGITS) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.substring(F.lower(F.lpad(F.hex(x), 16, "0")), 1, digits)), "")


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many cuts are below value; looked up in blocks of the root of their number."""
    size = max(1, math.isqrt(len(cuts)))
    listed = lambda x: F.array(*[F.lit(int(c)).cast("long") for c in x]).cast("array<bigint>")
    block = F.size(F.filter(listed(cuts[size - 1 :: size]), lambda c: c < value))
    return block * size + F.size(F.filter(F.slice(listed(cuts), block * size + 1, size), lambda c: c < value))


def with_next(rows: DataFrame, ranges: int, **derived: Column) -> DataFrame:
    """rows (rid, ..., text) with columns derived from them, and next_<column> of the text and
    those: of the row that follows by rid; the first follows the last.

    rid is unique. It is cut into ranges of about equal rows; each range is ordered by itself
    and holds a copy of the first row of the range after it, so nothing is ordered in one task.
    Derived columns are made once a row.
    """
    cuts = rows.agg(F.percentile_approx("rid", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    dealt = rows.withColumn("part", range_of(F.col("rid"), sorted(set(cuts or []))))
    firsts = dealt.groupBy("part").agg(F.min("rid").alias("rid"))
    every = Window.orderBy("part")  # one row a range: this window sees as many rows as there are ranges
    before = F.coalesce(F.lag("part").over(every), F.max("part").over(Window.partitionBy()))
    firsts = firsts.select(before.alias("before"), F.col("rid").alias("first"))
    copies = rows.join(F.broadcast(firsts), F.col("rid") == F.col("first")).select(*rows.columns, F.col("before").alias("part"), F.lit(1).alias("copy"))
    both = dealt.withColumn("copy", F.lit(0)).unionByName(copies).withColumns(derived)
    w = Window.partitionBy("part").orderBy("copy", "rid")
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", *derived)]).filter("copy = 0").drop("part", "copy")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, entries, edited_entries, near_edited, near_next) of every row.

    A null text counts as empty. A single row is its own next one. Null ids come after all
    others, rows of one doc_id in no fixed order; very long texts are taken whole; other columns
    are ignored. Of k-mers that tie on the circle the earlier one is picked. An empty table gives
    an empty table.
    """
    rows = common.numbered(docs).select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    found = with_next(rows, 4 * common.partitions(docs.sparkSession), entries=sketch(F.col("text")))
    found = found.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "entries", "next_entries")
    found = found.withColumn("edited_entries", sketch(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", "edited", "entries", "edited_entries",
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


def query(found: DataFrame) -> DataFrame:
    """The digests of the query."""
    return found.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("entries")).alias("fingerprint"), shown(F.col("edited_entries")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
