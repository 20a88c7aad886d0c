"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at ``radius`` or fewer differing bits have a common variant within half of it
of either. Every distinct fingerprint therefore emits all its variants within the half radius,
the variants are shuffled, and fingerprints that meet are linked. Those that share a variant
lie in one ball round it, so a group never exceeds the ball's size (65 at radius 2), however
many documents there are; copies were merged before. Links are verified by their bit count.
"""

from __future__ import annotations

import functools
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64
#: Keys with over this share of the rows are looked up by broadcast: at most its inverse many.
HOT_SHARE = 1000
#: Near copies: bits that may differ, those of the second fingerprint, blocks of the fingerprint, sets of blocks shuffled at once.
REACH, REACH_2, BLOCKS, AT_ONCE = 12, 16, 6, 5
#: Strangers that a bucket of variants may hold in the mean; fingerprints in a bucket of which only the leaders are kept between batches.
STRANGERS, LONG_RUN = 8, 1 << 16
#: Blocks that make a bucket's key.
TOGETHER = 3
#: Seed of the second fingerprint; pairs of one text that are compared in one task.
SECOND, MEMBERS = 43, 256


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text's word shingles, repeats counted."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :], strict=False)]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # bounds the unpacked bits of very long texts
        bits = np.unpackbits(np.array(hashes[at : at + 65536], ">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long; a null text counts as empty: 0."""

    def run(batches):
        for b in batches:
            found = [signed(fingerprint(t.encode(), width)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return rows.mapInArrow(common.frugal(run), "doc_id long, fp long")


def masks(half: int) -> list[int]:
    """The bit patterns of at most half set bits."""
    return [signed(sum(1 << b for b in c)) for k in range(half + 1) for c in itertools.combinations(range(BITS), k)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): for each shared variant, its fingerprints linked to the smallest of them.

    fps has distinct fp. Fingerprints of one ball of half the radius differ pairwise by the
    radius at most, so the star holds the same components as all pairs; each link is verified.
    """
    flips = F.array(*[F.lit(m).cast("long") for m in masks(radius // 2)])
    dealt = fps.repartition(common.partitions(fps.sparkSession), "fp")  # a row becomes as many as a ball holds
    emitted = dealt.select("fp", F.explode(flips).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = emitted.groupBy("variant").agg(F.collect_list("fp").alias("ball")).filter(F.size("ball") > 1)
    star = met.select(F.array_min("ball").alias("a"), F.explode("ball").alias("b")).filter("a <> b").distinct()
    return star.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable.

    A null text counts as empty (fingerprint 0, linked like any other). A row with a null doc_id
    keeps it; it links like others, but is never the smallest unless all are null. Repeated rows
    give repeated rows; very long texts are hashed whole; other columns are ignored. Bits set in
    just half of the hashes are 0. An empty table gives an empty table. radius is even, as half
    of it is emitted.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    common.prepare(docs.sparkSession)
    rows = common.stored(fingerprints(docs, width), "fingerprints")
    least = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-classes")
    found = components(links(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = least.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = common.stored(rooted.join(roots, "root").select("fp", "n", "component_id"), "fingerprint-ids")
    return lookup(rows, ids, "fp").select("doc_id", "fp", "component_id")


def block_masks(together: int = 3) -> list[int]:
    """The bits of every choice of so many of the BLOCKS blocks."""
    cuts = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, together)]


def strangers(texts: int, together: int) -> float:
    """Unrelated fingerprints in a bucket of variants, in the mean over the choices of blocks."""
    bits = [m.bit_count() for m in block_masks(together)]
    return sum(texts * (b + 1) / 2.0**b for b in bits) / len(bits)


def blocks_for(texts: int) -> int:
    """How many blocks a caller may choose for so many texts: three, or four where three would fill buckets
    with strangers. Nothing here chooses by the size of an input, as four find fewer pairs."""
    return next((k for k in (3, 4) if strangers(texts, k) <= STRANGERS), 4)


def leaders(group, fp, led):
    """(a, b, led) of fingerprints sorted by group: each with every leader of its group within REACH.

    The first fingerprint that no leader reaches leads in its turn, so a group of near copies has
    few leaders and links grow with the rows, while a stranger hides nobody: it leads itself only.
    led marks the leaders.
    """
    import numpy as np

    n = len(group)
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, n))
    shared = np.repeat(size > 1, size)
    of = np.repeat(np.arange(len(start)), size)
    done, led, pairs = ~shared, led.copy(), []
    waiting = np.flatnonzero(led & shared)  # leaders of earlier batches lead again
    while True:
        if len(waiting):
            first = waiting[np.append(True, of[waiting[1:]] != of[waiting[:-1]])]
        else:
            open_ = np.flatnonzero(~done)
            if not len(open_):
                break
            first = open_[np.append(True, of[open_[1:]] != of[open_[:-1]])]
        done[first], led[first] = True, True
        lead = np.full(len(start), -1)
        lead[of[first]] = first
        rows = np.flatnonzero(shared & (lead[of] >= 0))
        a, b = fp[lead[of[rows]]], fp[rows]
        near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= REACH)
        done[rows[near]] = True
        pairs.append(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])]))
        waiting = waiting[~np.isin(waiting, first)] if len(waiting) else waiting
    return np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.empty((2, 0), np.int64), led


def parities(hashes) -> tuple[int, ...]:
    """(n, s0, s1) of a set of hashes: its size, and whether each of 128 parts of it is odd."""
    import numpy as np

    odd = np.bincount((hashes % np.uint64(2 * BITS)).astype(np.int64), minlength=2 * BITS) & 1
    return len(hashes), *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_be_alike(x, y, least: float):
    """Of parities as arrays (3, pairs): where the sets can have a Jaccard similarity of least.

    Two parts of unlike parity differ in an element, so this many elements are in one set only, at
    least; a similarity of least leaves (1 - least) / (1 + least) of the sizes' sum. Exact: no pair that
    reaches least is ruled out.
    """
    import numpy as np

    apart = np.bitwise_count((x[1:] ^ y[1:]).view(np.uint64)).sum(0, dtype=np.int64)
    return np.maximum(apart, np.abs(x[0] - y[0])) <= (x[0] + y[0]) * ((1 - least) / (1 + least)) + 1e-6


def buckets(batches, least: float | None = None):
    """Of (variant, fp) sorted so: (a, b) of leaders and what they reach; a bucket may go on over batches.

    With least, rows have parities too and links like, whether the sets may be so similar; of those that
    can't be only the one with the smallest a for each b is told.
    """
    import numpy as np

    held = None
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(new[0]):
            continue
        new.append(np.zeros(len(new[0]), bool))
        v, fp, *sets, led = (np.concatenate(x) for x in zip(held, new, strict=True)) if held else new
        pairs, led = leaders(v, fp, led)
        if least is None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])
        else:
            known, at = np.unique(fp, return_index=True)
            a, b = (np.stack(sets)[:, at[np.searchsorted(known, x)]] for x in pairs)
            like = may_be_alike(a, b, least)
            told = like.copy()
            told[np.unique(pairs[1], return_index=True)[1]] = True  # pairs are sorted by a
            yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (*pairs, like)], ["a", "b", "like"])
        last = v == v[-1]
        if last.sum() > LONG_RUN:
            last &= led
        held = [v[last], fp[last], *[x[last] for x in sets], led[last] if last.sum() > 1 else np.zeros(last.sum(), bool)]


def far_links(fps: DataFrame, together: int = TOGETHER, least: float | None = None) -> DataFrame:
    """(a, b): fingerprints of at most REACH differing bits that share a bucket, by leaders of the buckets.

    Every choice of so many blocks emits its variants of one flipped bit, so fingerprints with at
    most two differing bits in it meet: with three blocks all with up to five, most with up to eight.
    Longer keys have fewer strangers in a bucket and find fewer pairs, so the input's size doesn't
    choose them; strangers hide no pair. Sorted variants are read as a stream; a group of near copies has few leaders, so links grow
    with the rows. fps has distinct fp. With least, fps has parities (n, s0, s1) of its texts' sets too,
    and links have like: false if the sets can't be so similar, which for each b is told of its smallest a
    in a batch only.
    """
    sets, schema = ([], "a long, b long") if least is None else (["n", "s0", "s1"], "a long, b long, like boolean")
    run = functools.partial(buckets, least=least)
    spark, n = fps.sparkSession, common.partitions(fps.sparkSession)
    out, halves = [], block_masks(together)
    for k in range(0, len(halves), AT_ONCE):  # the files of one shuffle go before the next
        flips = [(signed(h), signed(1 << b if b < BITS else 0)) for h in halves[k : k + AT_ONCE] for b in (*(b for b in range(BITS) if h >> b & 1), BITS)]
        each = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("half"), F.lit(m).cast("long").alias("flip")) for h, m in flips])).alias("x")
        emitted = fps.repartition(n, "fp").select("fp", *sets, each).select(F.col("fp").bitwiseAND(F.col("x.half")).bitwiseXOR(F.col("x.flip")).alias("variant"), "fp", *sets)
        met = emitted.repartition(n, "variant").sortWithinPartitions("variant", "fp").mapInArrow(common.frugal(run), schema)
        out.append(common.stored(once(met), "far-links"))
    return once(functools.reduce(DataFrame.unionByName, out)) if out else spark.createDataFrame([], schema)


def once(met: DataFrame) -> DataFrame:
    """Links without repeats; of those that are not like the smallest a of each b."""
    if "like" not in met.columns:
        return met.distinct()
    return met.groupBy(F.when(F.col("like"), F.col("a")).alias("of"), "b", "like").agg(F.min("a").alias("a")).select("a", "b", "like")


def shingles(text: str, words: int):
    """Sorted distinct hashes of a text's word shingles; a shorter text has one, of all its words."""
    import numpy as np
    import xxhash

    w = text.encode().lower().split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))), np.uint64))


def similarity(x, y) -> float:
    """Jaccard similarity of two results of shingles."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def near_copies(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(rid) of numbered rows: the smallest of each group of texts linked by a Jaccard similarity of least.

    Candidates are texts whose fingerprints far_links finds and whose second fingerprints differ
    by REACH_2 bits at most, which strangers of the first hardly ever do, and whose sets of word
    shingles can be so similar by their parities; they are verified on these sets, of which only
    hashes travel. A text of many pairs is sent to
    one task for every MEMBERS of them. Repeated rows and equal texts are one group, as are all
    texts without words; an empty table gives an empty table.
    """
    common.prepare(rows.sparkSession)
    rows = rows.select("rid", "text").withColumn("key", F.xxhash64("text"))

    def prints(batches):
        for b in batches:
            found = [[signed(fingerprint(t.encode(), seed=seed)) for t in b.column(2).to_pylist()] for seed in (42, SECOND)]
            found += zip(*(parities(shingles(t, words)) for t in b.column(2).to_pylist()), strict=True) if len(b) else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in found]], ["key", "rid", "fp", "fp2", "n", "s0", "s1"])

    def hashed(batches):
        for b in batches:
            found = [shingles(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["key", "hashes"])

    def alike(batches):
        import numpy as np

        for b in batches:
            pairs = zip(*(b.column(k) for k in (2, 3)), strict=True)
            keep = pa.array([similarity(*(np.frombuffer(v.as_buffer(), np.uint64) for v in p)) >= least for p in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)

    found = rows.select("key", "rid", "text").mapInArrow(common.frugal(prints), "key long, rid long, fp long, fp2 long, n long, s0 long, s1 long")
    texts = common.stored(found.groupBy("key", "fp", "fp2", "n", "s0", "s1").agg(F.min("rid").alias("least")), "texts")
    # The first texts of linked fingerprints meet; so does every text with its fingerprint's first
    # one and with that of the smallest fingerprint linked to its own: pairs grow with the texts.
    first = common.stored(texts.groupBy("fp").agg(F.min(F.struct("key", "fp2", "n", "s0", "s1")).alias("x")).select("fp", "x.*"), "fingerprint-texts")
    met = common.stored(far_links(first.select("fp", "n", "s0", "s1"), least=least), "fingerprint-links")
    ka, kb = (first.select(F.col("fp").alias(x), F.col("key").alias(f"k{x}"), F.col("fp2").alias(f"f{x}")) for x in "ab")
    own = texts.select(F.col("fp").alias("b"), F.col("key").alias("kb"), F.col("fp2").alias("fb"))
    nearest = met.groupBy("b").agg(F.min("a").alias("a"))
    pairs = met.filter("like").join(ka, "a").join(kb, "b").select("ka", "fa", "kb", "fb")
    pairs = pairs.unionByName(own.withColumnRenamed("b", "a").join(ka, "a").select("ka", "fa", "kb", "fb")).unionByName(own.join(nearest.join(ka, "a").select("b", "ka", "fa"), "b").select("ka", "fa", "kb", "fb"))
    near = (F.col("ka") != F.col("kb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= REACH_2)
    pairs = common.stored(pairs.filter(near).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct(), "candidates")
    sides = pairs.select(F.col("ka").alias("key"), "kb").union(pairs.select(F.col("kb").alias("key"), F.lit(None).cast("long")))
    wanted = sides.groupBy("key").agg(F.count("kb").alias("n"))  # n: pairs of which it is the first
    sets = common.stored(rows.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")).mapInArrow(common.frugal(hashed), "key long, hashes binary"), "candidate-sets")
    parts = wanted.filter("n > 0").select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts.withColumnRenamed("key", "ka"), "ka").withColumn("part", F.pmod(F.xxhash64("kb"), F.col("parts")).cast("int")).drop("parts")
    spread = sets.join(parts, "key").select(F.col("key").alias("ka"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias("ha"))
    joined = dealt.join(sets.select(F.col("key").alias("kb"), F.col("hashes").alias("hb")), "kb").join(spread, ["ka", "part"])
    linked = joined.select("ka", "kb", "ha", "hb").mapInArrow(common.frugal(alike), "a long, b long")
    rooted = texts.join(components(linked).withColumnRenamed("node", "key"), "key", "left")
    return rooted.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("rid")).select("rid")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined to table (key, n, ...), n the rows of the key, with no task for a hot key.

    Keys with more than a ``HOT_SHARE``-th of the rows are at most ``HOT_SHARE`` many, which is
    the bound of what is broadcast; the others are joined by shuffle. Both are read again from
    stored tables.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(table.filter(F.col("n") * HOT_SHARE > total).drop("n"))
    cold = table.filter(F.col("n") * HOT_SHARE <= total).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def query(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
