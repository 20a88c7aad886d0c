"""Language-model scoring with an Elias-Fano n-gram trie.

Levels of the trie lie as files in the shared folder and are memory-mapped by the workers.
Level 1 holds the words (by 64-bit hash, in order; the index is the word's id) with their
counts. Level k holds, for every node of level k - 1 that goes on, its next words: a node's key
is its parent's place in the shard times the vocabulary plus the word, one monotone sequence
for a shard, so children are found by a successor search relative to their parent. Each node
has its smoothed log-probability in 16 bits, each parent its back-off weight.

Shards are ranges of parents, as many as the training tokens ask for, so neither a file nor
the task that builds it grows with the corpus. N-grams are counted in the tasks that read the
texts before they are shuffled, so a hot context arrives as distinct n-grams only.

Smoothing: p_1(w) = (c + 1) / (N + V + 1); above, absolute discounting that interpolates with
the next lower order. N-grams below a level's least count are left to the back-off weight, so
that every context's probabilities add up to one.
"""

from __future__ import annotations

import functools
import io
import itertools
import os
import tempfile
import urllib.parse
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .eliasfano import EliasFano

ORDER = 3
#: Least count of the n-grams that a level keeps, by order.
LEAST = {1: 1, 2: 1, 3: 2}
HELD_OUT, FOLDS = 2, 7
#: Stands for the end of a text; words hold no space.
END = b" "
#: Training tokens for a shard, tokens scored at once, n-grams counted before they are sent.
SHARD_TOKENS, BATCH_TOKENS, COUNT_NGRAMS = 4_000_000, 500_000, 2_000_000
#: Steps of a quantised log10: 1 / 4096, down to -16.
STEP = 4096.0
_CACHE_WORDS = 300_000


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


# --- files -----------------------------------------------------------------------------------


def write_file(uri: str, arrays: tuple[np.ndarray, ...]) -> None:
    """Arrays one after the other, each aligned; whole or not at all, so a task can run again."""
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a))
        out.write(b"\0" * (-out.tell() % 64))
    path = common.local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
            f.write(out.getbuffer())
        os.replace(f.name, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(at) as f:
        f.write(out.getvalue())


def read_file(uri: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; from a store without mounts it is fetched first."""
    path = common.local_path(uri)
    if not path:
        from pyarrow import fs

        path = os.path.join(tempfile.gettempdir(), urllib.parse.quote(uri, safe=""))
        if not os.path.exists(path):
            store, at = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(at) as f, tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as g:
                g.write(f.read())
            os.replace(g.name, path)
    raw, out, at = np.memmap(path, np.uint8, "r"), [], 0
    while at < len(raw):
        head = io.BytesIO(raw[at : at + 256].tobytes())
        np.lib.format.read_magic(head)
        shape, _, kind = np.lib.format.read_array_header_1_0(head)
        at += head.tell()
        size = shape[0] * kind.itemsize
        out.append(np.asarray(raw[at : at + size].view(kind)))
        at += size
        at += -at % 64
    return out


# --- the trie --------------------------------------------------------------------------------


#: Files that a worker's task has open; closed at its end, as a worker keeps broadcast tries for later tasks.
_open: dict[str, tuple[EliasFano, list[np.ndarray]]] = {}


def closing(run):
    """A batch function that leaves no file open and gives freed memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _open.clear()
            common.release()

    return wrapped


@dataclass
class Level:
    """One level's shards: bases[s] is the first node's number of shard s, step the parents in one."""

    step: int
    bases: list[int]
    size: int


@dataclass
class Trie:
    folder: str
    bits: int  # of a hash that name the shard of a word
    n: int  # training tokens
    v: int  # distinct words
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        """Bytes of a stored word id."""
        return 4 if self.v < 1 << 31 else 8

    def shard(self, level: int, s: int) -> tuple[EliasFano, list[np.ndarray]]:
        path = f"{self.folder}/{level}-{s}.ef"
        if path not in _open:
            meta, low, high, zeros, *rest = read_file(path)
            _open[path] = EliasFano(int(meta[0]), int(meta[1]), low, high, zeros), rest
        return _open[path]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of words by hash; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        keep = np.uint64(64 - self.bits)
        shard = (hashes >> keep).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        rest = hashes & np.uint64((1 << (64 - self.bits)) - 1)
        for s, at in grouped(shard):
            if self.levels[0].bases[s + 1] > self.levels[0].bases[s]:
                ef, (count,) = self.shard(1, s)
                i = ef.find(rest[at])
                hit = i >= 0
                ids[at[hit]] = i[hit] + self.levels[0].bases[s]
                counts[at[hit]] = count[i[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The counts of words by id, 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        bases = np.array(self.levels[0].bases)
        for s, at in grouped(np.searchsorted(bases, ids[known], "right") - 1):
            _, (count,) = self.shard(1, s)
            out[known[at]] = count[ids[known[at]] - bases[s]]
        return out

    def step(self, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, its log10 or nan, the parent's back-off log10) of the words after parent nodes."""
        meta = self.levels[level - 1]
        node, prob, back = np.full(len(parents), -1, np.int64), np.full(len(parents), np.nan), np.zeros(len(parents))
        for s, at in grouped(parents // meta.step):
            if meta.bases[s + 1] > meta.bases[s]:
                ef, (probs, backs) = self.shard(level, s)
                place = parents[at] - s * meta.step
                back[at] = backs[place] / -STEP
                known = np.flatnonzero(words[at] >= 0)
                # Each distinct n-gram is looked up once, in order: neighbours lie close together.
                keys, again = np.unique(place[known].astype(np.uint64) * np.uint64(self.v) + words[at[known]].astype(np.uint64), return_inverse=True)
                i = ef.find(keys)
                hit = i >= 0
                node[at[known]] = np.where(hit, i + meta.bases[s], -1)[again]
                prob[at[known]] = np.where(hit, probs[np.maximum(i, 0)] / -STEP, np.nan)[again]
        return node, prob, back

    def walk(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(node of the full order or -1, log10) of every token; first marks the first of each text."""
        log = np.log10((counts + 1) / (self.n + self.v + 1))
        node = ids
        for k in range(2, order + 1):
            parent = np.append(-1, node[:-1])
            parent[first] = -1
            at = np.flatnonzero(parent >= 0)
            found, prob, back = self.step(k, parent[at], ids[at])
            node = np.full(len(ids), -1, np.int64)
            node[at] = found
            log[at] = np.where(np.isnan(prob), log[at] + back, prob)
        return node, log


def grouped(keys: np.ndarray):
    """(key, indices) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys.astype(np.int16) if keys.max() < 1 << 15 else keys, kind="stable")  # short keys sort by digits
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        yield int(keys[part[0]]), part


class Places(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Turns texts into word ids, looking each remembered word up once."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.table = np.zeros(0, np.int64)

    def ids(self, texts: list[list[bytes]]) -> np.ndarray:
        import xxhash

        if len(self.place) > _CACHE_WORDS:
            self.forget()
        get = self.place.__getitem__
        at = np.fromiter(itertools.chain.from_iterable(map(get, words) for words in texts), np.int64, sum(map(len, texts)))
        new = itertools.islice(self.place, len(self.table), None)  # a dict keeps the order of its keys
        found, _ = self.trie.words(np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64))
        self.table = np.concatenate([self.table, found])
        return self.table[at]


def in_batches(batches, column: int):
    """(arrow columns sliced, token lists) of at most about BATCH_TOKENS tokens."""
    for b in batches:
        start, held, size = 0, [], 0
        for i, text in enumerate(b.column(column).to_pylist()):
            held.append(tokens(text))
            size += len(held[-1])
            if size >= BATCH_TOKENS:
                yield b.slice(start, i + 1 - start), held
                start, held, size = i + 1, [], 0
        if held:
            yield b.slice(start), held


def starts(texts: list[list[bytes]]) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.cumsum(sizes) - sizes


def id_batches(batches, column: int, width: int):
    """(arrow rows, their word ids, the first of each row) of at most about BATCH_TOKENS tokens."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        start, held, size = 0, [], 0
        for i, raw in enumerate(b.column(column).to_pylist(), 1):
            planes = np.frombuffer(z.decompress(raw), np.uint8).reshape(width, -1)
            held.append(np.ascontiguousarray(planes.T).view(f"<i{width}").ravel())
            size += len(held[-1])
            if size >= BATCH_TOKENS or i == b.num_rows:
                sizes = np.array([len(x) for x in held])
                yield b.slice(start, i - start), np.concatenate(held).astype(np.int64), np.cumsum(sizes) - sizes
                start, held, size = i, [], 0


# --- training --------------------------------------------------------------------------------


def count_words(rows: DataFrame) -> DataFrame:
    """(hash, n) of the words of training rows; hash is a signed long."""

    def send(seen: Counter) -> pa.RecordBatch:
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(w) for w in seen], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(seen.values()), pa.int64())], ["hash", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
            if len(seen) > COUNT_NGRAMS // 4:
                yield send(seen)
                seen = Counter()
        yield send(seen)

    return rows.select("text").mapInArrow(common.frugal(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_words(counts: DataFrame, folder: str) -> Trie:
    v, n = counts.agg(F.count("*"), F.sum("n")).first()
    bits = max(0, (max(v, 1) // 500_000).bit_length())
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)

    def build(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys = table.column("hash").to_numpy().view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
        order = np.argsort(keys)
        ef = EliasFano.build(keys[order])
        write_file(f"{folder}/1-{s}.ef", (np.array([ef.n, ef.bits]), *ef.arrays(), table.column("n").to_numpy()[order]))
        return pa.table({"shard": pa.array([s], pa.int32()), "size": pa.array([ef.n], pa.int64())})

    sizes = {r["shard"]: r["size"] for r in counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, size long").collect()}
    bases = np.cumsum([0, *(sizes.get(s, 0) for s in range(1 << bits))]).tolist()
    return Trie(folder, bits, int(n or 0), int(v), [Level(1, bases, bases[-1])])


def send_ngrams(rows: DataFrame, trie: Trie, k: int, step: int) -> DataFrame:
    """(shard, blob) of rows (ids): the distinct k-grams of a task with counts and lower log-probability."""
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def send(keys: list, lower: list):
        import zstandard

        parent, word, low = (np.concatenate(x) for x in (*zip(*keys, strict=True), lower))
        ids, blobs = [], []
        for s, at in grouped(parent // step):
            key = (parent[at] - s * step).astype(np.uint64) * np.uint64(shared.value.v) + word[at].astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(new, len(key)))
            delta = np.diff(key[new], prepend=np.uint64(0))
            raw = b"".join(a.tobytes() for a in (delta.view(np.uint8).reshape(-1, 8).T, np.minimum(count, 0xFFFFFFFF).astype(np.uint32), low[at[order[new]]]))
            ids.append(s)
            blobs.append(zstandard.ZstdCompressor(level=1).compress(raw))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches):
        keys, lower, size = [], [], 0
        for _, ids, first in id_batches(batches, 0, shared.value.width):
            node, log = shared.value.walk(ids, shared.value.counts(ids), first, k - 1)
            parent = np.append(-1, node[:-1])
            parent[first] = -1
            at = np.flatnonzero(parent >= 0)
            keys.append((parent[at], ids[at]))
            lower.append(quantised(log[at]))
            size += len(at)
            if size > COUNT_NGRAMS:
                yield send(keys, lower)
                keys, lower, size = [], [], 0
        if size:
            yield send(keys, lower)

    return rows.select("ids").mapInArrow(closing(run), "shard long, blob binary")


def word_ids(rows: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, held_out, ids) of rows (doc_id, text, held_out): texts are split and looked up once.

    ids are those of the tokens, -1 for unknown ones, as integers of the trie's width, byte by
    byte of all tokens and compressed.
    """
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        import zstandard

        reader, width, z = Reader(shared.value), shared.value.width, zstandard.ZstdCompressor(level=1)
        for b, texts in in_batches(batches, 1):
            ids = reader.ids(texts)
            parts = np.split(ids.astype(f"<i{width}"), starts(texts)[1:])
            packed = [z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()) for x in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["doc_id", "held_out", "ids"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(closing(run), "doc_id long, held_out boolean, ids binary")


def build_level(rows: DataFrame, trie: Trie, k: int, least: int) -> Level:
    """Builds level k from training rows; shards hold about SHARD_TOKENS n-grams at most."""
    parents = trie.levels[-1].size
    shards = max(1, -(-trie.n // SHARD_TOKENS))
    step = max(1, -(-parents // shards))
    while step * trie.v >= 1 << 62:
        step //= 2
    folder, v = trie.folder, trie.v

    def build(table: pa.Table) -> pa.Table:
        import zstandard

        s = table.column("shard")[0].as_py()
        parts: list[tuple] = []
        for blob in table.column("blob"):
            raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n = len(raw) // 14
            delta = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
            parts.append((np.cumsum(delta), np.frombuffer(raw, np.uint32, n, 8 * n), np.frombuffer(raw, np.uint16, n, 12 * n)))
        key, count, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, count, low = key[order], count[order].astype(np.int64), low[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.add.reduceat(count, new)
        key, low = key[new], low[new]
        one, two = int((count == 1).sum()), int((count == 2).sum())
        discount = min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5
        place = (key // np.uint64(v)).astype(np.int64)
        total = np.bincount(place, count, step)
        kept = count >= least
        share = np.bincount(place[kept], count[kept] - discount, step)
        back = np.where(total > 0, 1 - share / np.maximum(total, 1), 1.0)
        key, place, count, low = key[kept], place[kept], count[kept], low[kept]
        prob = (count - discount) / total[place] + back[place] * 10 ** (low / -STEP)
        ef = EliasFano.build(key)
        write_file(f"{folder}/{k}-{s}.ef", (np.array([ef.n, ef.bits]), *ef.arrays(), quantised(np.log10(prob)), quantised(np.log10(back))))
        return pa.table({"shard": pa.array([s], pa.int64()), "size": pa.array([ef.n], pa.int64())})

    found = send_ngrams(rows, trie, k, step).groupBy("shard").applyInArrow(build, "shard long, size long").collect()
    sizes = {r["shard"]: r["size"] for r in found}
    bases = np.cumsum([0, *(sizes.get(s, 0) for s in range(-(-max(parents, 1) // step)))]).tolist()
    return Level(step, bases, bases[-1])


def with_fold(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return rows.withColumn("held_out", common.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)


def words(rows: DataFrame) -> Trie:
    """The first level, of training rows (text)."""
    return build_words(common.stored(count_words(rows), "word-counts"), common.new_path(rows.sparkSession, "trie"))


def add_levels(ids: DataFrame, trie: Trie, order: int) -> Trie:
    """Adds the levels up to order to trie, from training rows (ids)."""
    for k in range(2, order + 1):
        trie.levels.append(build_level(ids, trie, k, LEAST.get(k, 2)))
    return trie


def train(docs: DataFrame, order: int = ORDER) -> Trie:
    """Learns from the rows that are not held out; without any, every word is unknown."""
    common.prepare(docs.sparkSession)
    rows = with_fold(docs).filter(~F.col("held_out"))
    trie = words(rows)
    return add_levels(common.stored(word_ids(rows, trie), "word-ids"), trie, order)


def score_ids(ids: DataFrame, trie: Trie) -> DataFrame:
    """The scores of rows (doc_id, held_out, ids)."""
    shared = ids.sparkSession.sparkContext.broadcast(trie)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        t = shared.value
        for b, ids, first in id_batches(batches, 2, t.width):
            counts = t.counts(ids)
            base = np.log10((counts + 1) / (t.n + t.v + 1))
            _, log = t.walk(ids, counts, first, len(t.levels))
            sizes = np.diff(np.append(first, len(ids)))
            sums = [np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64), base, log)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (sizes, sums[0], np.full(len(sizes), t.n), sums[1], sums[2]))], names)

    return ids.select("doc_id", "held_out", "ids").mapInArrow(closing(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text counts as empty (its one token is the end); a null doc_id stays null and counts
    as the empty text for its fold; repeated rows give repeated rows; very long texts are scored
    whole, a batch of tokens at a time; other columns are ignored. An empty table gives an empty
    table.
    """
    common.prepare(docs.sparkSession)
    return score_ids(word_ids(with_fold(docs), trie), trie)


def query(docs: DataFrame) -> DataFrame:
    """Trains on docs and scores them, with one look-up of their words for both."""
    common.prepare(docs.sparkSession)
    rows = with_fold(docs)
    trie = words(rows.filter(~F.col("held_out")))
    ids = common.stored(word_ids(rows, trie), "word-ids")
    return score_ids(ids, add_levels(ids.filter(~F.col("held_out")), trie, ORDER))
