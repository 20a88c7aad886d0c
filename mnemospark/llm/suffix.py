"""Suffix-array deduplication by distributed prefix doubling.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier. Suffixes
are compared on prefixes that grow by doubling; the rank of 2n bytes is the rank pair of two
n-byte prefixes. Spark sorts (rank, position) pairs at each of ``SEEDS`` bytes and at the
threshold, each time only of what is still open:

* at a seed length, of the suffixes that start in a window (``length`` bytes) only the one of
  least rank is sorted, with the run of windows that it stands for. Equal windows choose equal
  seeds, so a seed that is unique makes all its windows unique: they are done. If all runs of
  a seed are equal, all but the first are repeats: done as well. All but the first of equal
  runs are repeats; the first ones stay open.
* at the threshold the windows that are still open are sorted one by one; all but the first of
  equal rank are repeats.

Ranks are 64-bit names, so that a text's own prefixes double without a shuffle. Seeds of equal
name only cost work. What is removed is equal in two independent names of 64 bits each, the
rank and a polynomial over the bytes, besides its seed's: two different strings of n have both
in common with a probability of about n ** 2 / 2 ** 129, that is 1e-11 for 1e14 windows.

Sorted partitions are read as a stream with one open run, so a rank that a third of all texts
share needs no memory; repeats inside a batch are resolved before the shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, SEEDS = 100, (32, 64)
#: Bytes that are ranked at once; longer texts go in overlapping stretches.
STRETCH = 1 << 20
#: Bytes, runs or windows gathered before they are sent; bytes of texts returned at once.
GATHER, WINDOWS, RETURNED = 1 << 22, 400_000, 1 << 22
#: What becomes of a run: it repeats an earlier one, or its windows are compared further.
AGAIN, OPEN = 1, 2
#: Different runs of a seed in a batch that make it hot.
HOT_RUNS = 32

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S2)
    x *= _A
    x ^= x >> _S1
    x *= _B
    x ^= x >> _S2
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _B + b)


def ranks(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length (8 or more): the rank of that many bytes from every position where they fit.

    Doubles from 8 bytes; a length between two powers is the pair of two overlapping prefixes.
    """
    n = len(data)
    out: dict[int, np.ndarray] = {}
    span = 8
    now = mix(np.ndarray((max(0, n - 7),), "<u8", data, 0, (1,)).astype(np.uint64)) if n >= 8 else np.zeros(0, np.uint64)
    for want in sorted(set(lengths)):
        while span * 2 <= want:
            now = pair(now[: max(0, n - 2 * span + 1)], now[span:]) if n >= 2 * span else np.zeros(0, np.uint64)
            span *= 2
        fit = max(0, n - want + 1)
        out[want] = now[:fit] if want == span else pair(now[:fit], now[want - span : want - span + fit])
    return [out[x] for x in lengths]


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte; the powers of the polynomial's base and their inverses modulo 2 ** 64."""
    value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(STRETCH + 1, x, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return value, *out


def checks(data: bytes, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A second name of each data[first : first + size], independent of its rank."""
    value, up, down = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:])
    return (total[first + size] - total[first]) * down[first]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(rank of the seed, rank of the run, its second name, first window, windows) of one stretch's runs."""
    whole, part = ranks(data, (length, seed))
    if not len(whole):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    low = np.uint64(24)
    keyed = ((part >> low) << low) | np.arange(len(part), dtype=np.uint64)  # ties: the leftmost
    at = sliding_least(keyed, length - seed + 1) & np.uint64((1 << 24) - 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    count = last - first + 1
    run = pair(pair(whole[first], whole[last]), count.astype(np.uint64))
    return part[at[first].astype(np.int64)], run, checks(data, first, count + length - 1), first, count


def stretches(n: int, length: int):
    """(start, end) so that every window lies in just one stretch."""
    step = STRETCH - length + 1
    for s in range(0, max(1, n - length + 1), step):
        yield s, min(n, s + STRETCH)


def regions(at: list[int] | None, n: int, length: int):
    """(start, end) of the bytes of each stretch of open windows; without open runs, of the whole text."""
    if at is None:
        yield from stretches(n, length)
        return
    runs_at = np.sort(np.array(at, np.int64))
    first, after = runs_at >> 8, (runs_at >> 8) + (runs_at & 255)
    cut = np.flatnonzero(first[1:] != after[:-1]) + 1  # runs of one text don't overlap
    for start, end in zip(first[np.append(0, cut)].tolist(), after[np.append(cut - 1, len(first) - 1)].tolist(), strict=True):
        for s, e in stretches(end + length - 1 - start, length):
            yield start + s, start + e


def texts_of(batches):
    """(rid, bytes, open runs or None) of batches of (rid, packed, open)."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        for rid, text, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            yield rid, z.decompress(text), at


def seed_rows(texts: DataFrame, length: int, seed: int, bits: int) -> DataFrame:
    """(seed, run, check, rid, at) of (rid, packed, open): a row for each run; at holds first
    window, windows, and what a batch knows: AGAIN if the run repeats an earlier one of the
    batch, OPEN if its seed has HOT_RUNS different runs there. Such a seed has several runs, so
    its rows needn't meet to find that out; two of them stay unmarked to tell the seed's rows
    from other batches.
    """
    names = ["seed", "run", "check", "rid", "at"]
    mask, seed_mask = np.uint64((1 << bits) - 1), np.uint64((1 << min(bits, 48)) - 1)

    def emit(parts: list, ids: list[int], starts: list[int]) -> pa.RecordBatch:
        seeds, whole, check, first, count = (np.concatenate([p[k] for p in parts]) for k in range(5))
        seeds, whole = seeds & seed_mask, whole & mask
        sizes = [len(p[0]) for p in parts]
        rid, start = np.repeat(np.array(ids, np.int64), sizes), np.repeat(np.array(starts, np.int64), sizes) + first
        order = np.lexsort((start, rid, check, whole))
        known = np.zeros(len(order), np.int64)
        known[order[1:]] = np.where((whole[order[1:]] == whole[order[:-1]]) & (check[order[1:]] == check[order[:-1]]), AGAIN, 0)
        once = np.flatnonzero(known == 0)
        once = once[np.argsort(seeds[once], kind="stable")]
        heads = np.flatnonzero(np.append(True, seeds[once[1:]] != seeds[once[:-1]]))
        size = np.diff(np.append(heads, len(once)))
        nth = np.arange(len(once)) - np.repeat(heads, size)
        known[once[(np.repeat(size, size) >= HOT_RUNS) & (nth >= 2)]] = OPEN
        at = (start << 10) | (count << 2) | known
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (seeds.view(np.int64), whole.view(np.int64), check.view(np.int64), rid, at)], names)

    def run(batches):
        parts, ids, starts, size = [], [], [], 0
        for rid, data, at in texts_of(batches):
            for s, e in regions(at, len(data), length):
                parts.append(runs(data[s:e], length, seed))
                ids.append(rid)
                starts.append(s)
                size += e - s
                if size > GATHER:
                    yield emit(parts, ids, starts)
                    parts, ids, starts, size = [], [], [], 0
        if parts:
            yield emit(parts, ids, starts)

    return texts.mapInArrow(common.frugal(run), "seed long, run long, check long, rid long, at long")


def told_runs(rid: np.ndarray, at: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at >> 2), pa.array(kind.astype(np.int32))], ["rid", "at", "kind"])


def resolve(batches):
    """Of rows sorted by (seed, run, check, rid, at): repeats, and the runs that are still open.

    A seed with one run only: all but its first pair repeat. With several: all but the first of
    each run repeat, and those first ones go on. One row is held while its seed may continue.
    Rows that a batch knew about are passed on as they are: their kind is what it knew.
    """
    held = None  # (seed, run, check, rid, at, whether it waits to be told, whether its seed has several runs)
    for b in batches:
        seed, run, check, rid, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        known = at & 3
        if known.any():
            yield told_runs(rid[known > 0], at[known > 0], known[known > 0])
            seed, run, check, rid, at = (x[known == 0] for x in (seed, run, check, rid, at))
        if not len(seed):
            continue
        several, waits = False, False
        if held:
            seed, run, check, rid, at = (np.append(h, x) for h, x in zip(held[:5], (seed, run, check, rid, at), strict=True))
            waits, several = held[5:]
        new_seed = np.append(True, seed[1:] != seed[:-1])
        new_run = new_seed | np.append(True, (run[1:] != run[:-1]) | (check[1:] != check[:-1]))
        group = np.cumsum(new_seed) - 1
        kinds = np.bincount(group, new_run) > 1
        kinds[0] |= several
        lead = new_run.copy()
        if held and not waits:
            lead[0] = False
        out = np.where(lead, np.where(kinds[group], OPEN, 0), AGAIN)
        if held and not waits:
            out[0] = 0
        last = len(seed) - 1
        first_of_last = int(np.flatnonzero(new_seed)[-1])
        if not kinds[-1] and lead[first_of_last]:
            # The last seed's only run so far: its first row waits.
            keep, wait = first_of_last, True
        else:
            keep, wait = last, False
        held = (seed[keep], run[last], check[last], rid[keep], at[keep], wait, bool(kinds[-1]))
        if wait:
            out[keep] = 0
        told = np.flatnonzero(out)
        yield told_runs(rid[told], at[told], out[told])


def window_rows(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """(rank, check, rid, at) of the open windows of (rid, packed, open); at is start << 1, plus 1
    for a window that repeats an earlier one of the batch: it is known.
    """
    mask = np.uint64((1 << bits) - 1)

    def emit(rank, check, rid, start):
        rank, check, rid, start = (np.concatenate(x) for x in (rank, check, rid, start))
        rank &= mask
        order = np.lexsort((start, rid, check, rank))
        again = np.zeros(len(order), np.int64)
        again[order[1:]] = (rank[order[1:]] == rank[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank.view(np.int64), check.view(np.int64), rid, (start << 1) | again)], ["rank", "check", "rid", "at"])

    def run(batches):
        out: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for rid, data, at in texts_of(batches):
            for s, e in regions(at, len(data), length):
                n = max(0, e - s - length + 1)
                part = data[s:e]
                for column, value in zip(out, (ranks(part, (length,))[0], checks(part, np.arange(n), length), np.full(n, rid, np.int64), np.arange(s, s + n)), strict=True):
                    column.append(value)
                size += n
                if size > WINDOWS:
                    yield emit(*out)
                    out, size = ([], [], [], []), 0
        if size:
            yield emit(*out)

    return texts.mapInArrow(common.frugal(run), "rank long, check long, rid long, at long")


def repeats(batches):
    """Of (rank, check, rid, at) sorted so: all but the first of each rank and check."""
    last = None
    for b in batches:
        rank, check, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        if not len(rank):
            continue
        # Known ones repeat a window that comes before them here or lies in another partition.
        again = np.append((rank[0], check[0]) == last, (rank[1:] == rank[:-1]) & (check[1:] == check[:-1])) | (at & 1 == 1)
        last = (rank[-1], check[-1])
        keep = pa.array(again)
        yield pa.RecordBatch.from_arrays([b.column(2).filter(keep), pa.array(((at >> 1) << 8) | 1).filter(keep)], ["rid", "at"])


def repeated_windows(texts: DataFrame, length: int, seeds: tuple[int, ...], bits: int) -> list[DataFrame]:
    """Tables (rid, at) of runs of windows that also start earlier; at is first window << 8 | windows."""
    n = common.partitions(texts.sparkSession)
    known = F.col("at").bitwiseAND(F.lit(3)) != 0
    deal_seed = F.when(known, F.xxhash64("rid", "at")).otherwise(F.col("seed"))
    found, now = [], texts.select("rid", "packed", F.lit(None).cast("array<bigint>").alias("open"))
    for seed in seeds:
        sampled = seed_rows(now, length, seed, bits).repartition(n, deal_seed).sortWithinPartitions("seed", "run", "check", "rid", "at")
        told = common.stored(sampled.mapInArrow(common.frugal(resolve), "rid long, at long, kind int"), f"suffix-runs-{seed}")
        found.append(told.filter(F.col("kind") == AGAIN).select("rid", "at"))
        still = told.filter(F.col("kind") == OPEN).groupBy("rid").agg(F.collect_list("at").alias("open"))
        now = texts.select("rid", "packed").join(still, "rid").select("rid", "packed", "open")
    repeated = F.col("at").bitwiseAND(F.lit(1)) != 0
    deal = F.when(repeated, F.xxhash64("rid", "at")).otherwise(F.col("rank"))
    windows = window_rows(now, length, bits).repartition(n, deal).sortWithinPartitions("rank", "check", "rid", "at")
    return [*found, common.stored(windows.mapInArrow(common.frugal(repeats), "rid long, at long"), "suffix-windows")]


def removed(data: bytes, runs_at: list[int], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the bytes that stay)."""
    if not runs_at:
        return 0, 0, data
    at = np.array(runs_at, np.int64)
    first, count = at >> 8, at & 255
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + length - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


def deduplicate(docs: DataFrame, length: int = LENGTH, seeds: tuple[int, ...] = SEEDS, as_text: bool = False, bits: int = 64) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) of every row of docs.

    row is a struct of all columns but text, so no name clashes. kept are the bytes that stay;
    as_text, they are a text without the parts of characters that a cut left behind. bits are
    those of a rank (fewer for tests).

    Texts are ordered by doc_id, a null doc_id after all others; rows of one doc_id in no fixed
    order, and of repeated rows one keeps its text. A null text counts as empty. Texts shorter
    than length stay whole unless empty; very long ones are ranked in overlapping stretches and
    lose nothing. Of equal strings the earliest stays, so ties are none. An empty table gives an
    empty table.
    """
    if not all(8 <= seed < length <= seed + 254 for seed in seeds):
        raise ValueError("8 <= seed < length <= seed + 254")
    common.prepare(docs.sparkSession)
    texts = common.stored(common.packed(common.numbered(docs)), "suffix-texts")
    found = functools.reduce(DataFrame.unionByName, repeated_windows(texts, length, seeds, bits))
    by_text = found.groupBy("rid").agg(F.collect_list("at").alias("runs"))
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())

    def cut(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            start, out, size = 0, ([], [], [], []), 0
            for i, (text, at) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), 1):
                data = z.decompress(text)
                n, spans, kept = removed(data, at or [], length)
                for column, value in zip(out, (len(data), n, spans, kept.decode("utf-8", "ignore") if as_text else kept), strict=True):
                    column.append(value)
                size += len(kept)
                if size > RETURNED or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i - start), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)
                    start, out, size = i, ([], [], [], []), 0

    joined = texts.join(by_text, "rid", "left").select("row", "packed", "runs")
    schema = T.StructType([texts.schema["row"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return joined.mapInArrow(common.frugal(cut), schema)


def query(found: DataFrame) -> DataFrame:
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
