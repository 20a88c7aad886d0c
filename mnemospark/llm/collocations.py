"""Phrase collocations from generalised suffix automata of word sequences.

Each task builds, for a bounded number of words at a time, the generalised suffix automaton of
their pieces down to a bounded depth: its states (classes of phrases with the same end
positions), their longest phrases, suffix links and numbers of end positions. A state stands for
its phrases longer than its link's, which are enumerated with their counts and summed over all
shards. Phrases are then cut, scored and held against those one word longer, of which they are
the suffix link or the prefix.

The states are built by sorting every position by its words read backwards (the suffix links of
an automaton are the tree of the reversed phrases), which numpy does without a Python step a
word; they are the states of the usual online construction, cut at the depth.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of an automaton: bounds a worker's memory. A longer text makes one of its own.
SHARD = 1 << 20
#: Rows of an Arrow batch that leaves Python; rows of packed phrases in one; an odd number that mixes hashes.
BATCH, BLOBS, MIX = 1 << 16, 64, np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose phrases make a bucket; buckets that one shuffle deals to.
BUCKET, FAN = 2 << 20, 1024
#: Parts of a language that are ranked before its first phrases are.
PARTS = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z and makes every separator a full stop, which no word holds.
TABLE = bytes(46 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Automaton(NamedTuple):
    """States of a generalised suffix automaton down to a depth; link -1 is the root."""

    end: np.ndarray  #: a position where the state's phrases end
    length: np.ndarray  #: words of its longest phrase
    link: np.ndarray  #: the state of its longest phrase with other end positions
    count: np.ndarray  #: number of its end positions


def words_of(text: str) -> list[bytes]:
    """A text's words with full stops between its pieces and at its end."""
    return (text.encode().translate(TABLE) + b".").replace(b".", b" . ").split()


def automaton(words: np.ndarray, depth: int) -> Automaton:
    """The automaton of the pieces of words: numbers from 0, -1 where a piece ends."""
    at = np.flatnonzero(words >= 0)
    columns = [words[at]]
    for d in range(1, depth):  # words read backwards; nothing before a piece's first
        before = np.where(at >= d, words[at - d], -1)
        columns.append(np.where(columns[-1] >= 0, before, -1))
    order = np.lexsort(columns[::-1])
    columns, at = [c[order] for c in columns], at[order]
    n = len(at)
    changed, firsts, counts, above = np.zeros(n, bool), [], [], []
    changed[:1] = True
    group = None
    for c in columns:  # the phrases of each length: runs of equal columns
        changed[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(changed)
        size = np.diff(np.append(start, n))
        there = c[start] >= 0
        firsts.append(start[there])
        counts.append(size[there])
        above.append(None if group is None else group[start[there]])
        number = np.cumsum(there) - 1
        group = np.repeat(np.where(there, number, -1), size)
    # A phrase is a state of its own unless one longer phrase ends wherever it ends.
    own = []
    for d in range(depth):
        most = np.zeros(len(firsts[d]), np.int64)
        if d + 1 < depth:
            np.maximum.at(most, above[d + 1], counts[d + 1])
        own.append(most < counts[d])
    base = np.cumsum([0, *(int(x.sum()) for x in own)])
    # The state that a phrase belongs to where it is one, else the one of the longer phrase.
    numbers, ends, lengths, links, sizes = [], [], [], [], []
    for d in range(depth):
        numbers.append(np.where(own[d], base[d] + np.cumsum(own[d]) - 1, -1))
        link = np.full(len(firsts[d]), -1)
        if d:  # up the tree to the first phrase that has more end positions
            parent, pending = above[d], np.ones(len(link), bool)
            for up in range(d - 1, -1, -1):
                found = pending & (counts[up][parent] > counts[d])
                link[found] = numbers[up][parent[found]]
                pending &= ~found
                if up:
                    parent = above[up][parent]
        ends.append(at[firsts[d][own[d]]])
        lengths.append(np.full(int(own[d].sum()), d + 1))
        links.append(link[own[d]])
        sizes.append(counts[d][own[d]])
    return Automaton(*(np.concatenate(x) for x in (ends, lengths, links, sizes)))


def enumerated(a: Automaton):
    """(words, positions where phrases end, counts) of the phrases of each length."""
    shortest = np.where(a.link >= 0, a.length[a.link], 0)
    for k in range(1, int(a.length.max(initial=0)) + 1):
        held = (shortest < k) & (k <= a.length)
        yield k, a.end[held], a.count[held]


def hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def packed(keys: pa.Array, f: pa.Array) -> bytes:
    """Phrases with their counts as compressed bytes: what is shuffled."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    batch = pa.RecordBatch.from_arrays([keys, f], ["key", "f"])
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def summed(parts: list[bytes]) -> pa.Table:
    """(key, f_sum) of all packed phrases."""
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in parts).group_by("key").aggregate([("f", "sum")]).select(["key", "f_sum"])


def dealt(keys: pa.Array, f: np.ndarray, bucket: np.ndarray, below: int = 0):
    """Batches of (bucket, phrases): one row for each bucket that has some, numbered from below."""
    order = np.argsort(bucket, kind="stable")
    keys, f, bucket = keys.take(pa.array(order)), pa.array(f[order], pa.int64()), bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
    size = np.diff(np.append(start, len(bucket)))
    for i in range(0, len(start), BLOBS):
        parts = [packed(keys.slice(a, n), f.slice(a, n)) for a, n in zip(start[i : i + BLOBS].tolist(), size[i : i + BLOBS].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(below + bucket[start[i : i + BLOBS]].astype(np.int64)), pa.array(parts, pa.binary())], ["bucket", "phrases"])


def by_bucket(batches):
    """(bucket, its rows' phrases) of sorted rows."""
    now, held = None, []
    for b in batches:
        for bucket, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(part)
    if held:
        yield now, held


def counted(docs: DataFrame, most: int, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of up to most words that occur least times; the empty phrase counts words.

    A shard's phrases go to buckets by hash, a compressed row each, and a bucket is summed at
    once: buckets grow in number with the text, so each stays at about BUCKET bytes of it. A
    phrase comes once from a shard, however frequent. More than FAN buckets take a second deal.
    """

    def shard(found: list[np.ndarray], langs: dict[str, int], numbers: dict[str, defaultdict]):
        words = np.concatenate(found)
        total = sum(map(len, numbers.values()))
        texts, of, hashed = np.empty(total, object), np.empty(total, object), np.empty(total, np.uint64)
        for lang, known in numbers.items():
            ids = np.fromiter(known.values(), np.int64, len(known))
            texts[ids], of[ids], hashed[ids] = [w.decode() for w in known], lang, hashes(list(known), lang)
        texts, of = pa.array(texts, pa.string()), pa.array(of, pa.string())

        def bucket(h: np.ndarray) -> np.ndarray:
            return ((h >> np.uint64(32)) % np.uint64(fan)).astype(np.int16)

        yield from dealt(pa.array([f".{x}" for x in langs], pa.string()), np.array(list(langs.values())), bucket(hashes([x.encode() for x in langs], "")))
        for k, end, count in enumerated(automaton(words, most)):
            mixed = np.zeros(len(end), np.uint64)
            for d in range(k - 1, -1, -1):
                mixed = (mixed ^ hashed[words[end - d]]) * MIX
            # No word holds a full stop: it ends the phrase, and the language follows.
            phrase = pc.binary_join_element_wise(*[texts.take(pa.array(words[end - d])) for d in range(k - 1, -1, -1)], " ") if k > 1 else texts.take(pa.array(words[end]))
            yield from dealt(pc.binary_join_element_wise(phrase, of.take(pa.array(words[end])), "."), count, bucket(mixed))

    def run(batches):
        found, langs, numbers, total, fresh = [], defaultdict(int), {}, 0, itertools.count()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in numbers:  # words of each language have numbers of their own
                    numbers[lang] = defaultdict(functools.partial(next, fresh))
                known, split = numbers[lang], words_of(text)
                known[b"."] = -1
                w = np.fromiter(map(known.__getitem__, split), np.int32, len(split))
                del known[b"."]
                langs[lang] += int((w >= 0).sum())
                found.append(w)
                total += len(w)
                if total >= SHARD:
                    yield from shard(found, langs, numbers)
                    found, langs, numbers, total, fresh = [], defaultdict(int), {}, 0, itertools.count()
                    common.release()
        if found:
            yield from shard(found, langs, numbers)

    def deal_again(batches):
        import xxhash

        for bucket, parts in by_bucket(batches):
            for i in range(0, len(parts), BLOBS):  # parts of a shard's size at most
                table = summed(parts[i : i + BLOBS]).combine_chunks()
                keys = table["key"].combine_chunks()
                digit = np.fromiter((xxhash.xxh64_intdigest(k) % second for k in keys.to_pylist()), np.int64, len(keys))
                yield from dealt(keys, table["f_sum"].to_numpy(), digit, bucket * second)

    def reduce(batches):
        for _, parts in by_bucket(batches):
            table = summed(parts)
            table = table.filter(pc.or_(pc.greater_equal(table["f_sum"], least), pc.starts_with(table["key"], ".")))
            yield from table.rename_columns(["key", "f"]).to_batches(max_chunksize=BATCH)
            del table
            common.release()

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), common.text_of(docs).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, schema = max(1, -(-size // BUCKET)), "bucket long, phrases binary"
    fan, second = min(buckets, FAN), -(-buckets // FAN)
    shards = rows.mapInArrow(common.frugal(run), schema)
    for step in (deal_again, reduce) if second > 1 else (reduce,):
        n = min(max(common.partitions(spark), buckets // 8), buckets)
        shards = shards.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(common.frugal(step), "key string, f long" if step is reduce else schema)
    return shards.select(F.expr("substring(key, instr(key, '.') + 1)").alias("lang"), F.expr("substring(key, 1, instr(key, '.') - 1)").alias("phrase"), "f")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to most words.

    A phrase that occurs a >= least times is cut where its score, floor(10 ** 6 * a * a / (l * r)),
    is lowest (the earliest of equal cuts); l and r are what the parts count, n all words of the
    language. Phrases that lie within a longer one with at least half their count are left out;
    those one word longer decide, as a still longer one counts no more than they. Ranks go by
    score, count and phrase. A null lang counts as und, a null text as empty; rows without words
    and other columns (also any called phrase or f) count for nothing; repeated rows count
    repeatedly; an empty table gives an empty table. Texts are taken whole, whatever their length.
    """
    common.prepare(docs.sparkSession)
    # A part counts at least as much as its phrase, so no count under least is needed.
    counts = common.stored(counted(docs, most, least), "phrases")
    words = F.split("phrase", " ")
    found = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).filter((F.col("phrase") != "") & (F.size("words") >= 2))

    def joined(a, n):
        return F.array_join(F.slice("words", a, n), " ")

    size = F.size("words")
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = found.select("*", k).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, size - F.col("k")).alias("right"))
    # Hot parts (a frequent word begins many phrases) are split by adaptive skew joins: a part has one count.
    left, right = (counts.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    exact = [F.col(c).cast("decimal(19,0)") for c in "alr"]  # products pass 64 bits
    score = F.expr("(1000000BD * x * x) div (y * z)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *[e.alias(x) for e, x in zip(exact, "xyz", strict=True)]).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.filter(size > 2).select("lang", "a", F.explode(F.array(joined(F.lit(2), size - 1), joined(F.lit(1), size - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * 50))
    rows = kept.select("lang", "phrase", "a", "cut.*")
    # The first of each part hold the first of all: no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    n = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """DuckDB SQL for collocations with its default parameters."""
    return r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 4) AS r(k)
), f AS (
  SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words >= 2 AND f >= 10
), halves AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:words], ' ') AS rp
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
), cuts AS (
  SELECT h.lang, h.phrase, h.a, h.k, lf.f AS l, rf.f AS r, (1000000::HUGEINT * h.a * h.a) // (lf.f::HUGEINT * rf.f) AS score
  FROM halves h JOIN f lf ON lf.lang = h.lang AND lf.phrase = h.lp JOIN f rf ON rf.lang = h.lang AND rf.phrase = h.rp
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE x.most IS NULL OR 100 * x.most < 50 * b.a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""
