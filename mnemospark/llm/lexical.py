"""Ranked search over treaps: every term's postings in the order of documents, heaped by impact.

Documents are cut into words once; those that the queries ask for are stored by document. A task
reads its documents in segments of bounded size, builds for each term of a segment the treap of
its postings (a search tree by document, a heap by impact), and answers all queries by walking
the treaps of a query's terms together. A walk holds ranges of documents with the root of each
term within them; the sum of the roots' impacts bounds every score in the range, so a range that
can't enter the first k goes unseen. Otherwise the document of the heaviest root is scored and
splits the range. Ranges with the highest bounds go first, in blocks, as arrays.

Segments cut the postings of frequent terms, so no task holds a term's whole list, and postings
aren't shuffled: only the first k of each task and query are.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Postings of a segment; query bytes of one pass over the documents; ranges walked at once.
SEGMENT, QUERY_BYTES, RANGES = 1 << 21, 4 << 20, 4096
#: Lower-cases A-Z, and makes what can't be in a term a space.
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other code points from U+0080."""
    return text.encode().translate(TABLE).split()


def tree(impact: np.ndarray) -> tuple[int, list[int], list[int]]:
    """(root, left, right) of the treap of postings in the order of documents; -1 is no child."""
    left, right, stack = [-1] * len(impact), [-1] * len(impact), []
    values = impact.tolist()
    for i, x in enumerate(values):
        last = -1
        while stack and values[stack[-1]] < x:
            last = stack.pop()
        left[i] = last
        if stack:
            right[stack[-1]] = i
        stack.append(i)
    return (stack[0] if stack else -1), left, right


class Segment:
    """The treaps of one segment's terms: nodes of all terms in one set of arrays."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, impact: np.ndarray, terms: int):
        """Postings sorted by term and document."""
        self.docs, self.impact = docs, impact
        self.start = np.searchsorted(ids, np.arange(terms + 1))
        self.root = np.full(terms, -1)
        self.left, self.right = np.full(len(ids), -1, np.int32), np.full(len(ids), -1, np.int32)
        for t in np.flatnonzero(np.diff(self.start)):
            a, b = self.start[t : t + 2]
            root, left, right = tree(impact[a:b])
            for mine, found in ((self.left, left), (self.right, right)):
                x = np.array(found, np.int64)
                mine[a:b] = np.where(x >= 0, x + a, -1)
            self.root[t] = a + root

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The highest nodes at or below node whose documents are in [lo, hi); -1 where there is none."""
        shape, node = node.shape, node.ravel().copy()
        lo, hi = (np.broadcast_to(x, shape).ravel() for x in (lo, hi))
        live = np.flatnonzero(node >= 0)
        while len(live):
            x = node[live]
            doc = self.docs[x]
            low, high = doc < lo[live], doc >= hi[live]
            moved = low | high
            live, x, low = live[moved], x[moved], low[moved]
            x = np.where(low, self.right[x], self.left[x])
            node[live] = x
            live = live[x >= 0]
        return node.reshape(shape)

    def impacts(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of doc for the terms whose nodes these are, looked for below them."""
        found = self.within(node, doc, doc + 1)
        return np.where(found >= 0, self.impact[found], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, n: int, k: int, least: int):
        """(scores, documents): all of the first k by score that reach least, and maybe more."""
        roots = self.root[terms]
        there = roots >= 0
        roots, weights = roots[there], weights[there][:, None]
        scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(roots):
            return scores, docs

        def bounds(nodes):
            return (np.where(nodes >= 0, self.impact[nodes], 0) * weights).sum(0)

        first = roots[:, None]
        heap, made = [(-int(bounds(first)[0]), 0, np.zeros(1, np.int64), np.full(1, n), first, bounds(first))], 1
        while heap:
            best, _, lo, hi, nodes, bound = heapq.heappop(heap)
            if -best < least:
                break
            keep = bound >= least
            lo, hi, nodes = lo[keep], hi[keep], nodes[:, keep]
            share = np.where(nodes >= 0, self.impact[nodes], 0) * weights
            lead = share.argmax(0)
            pivot = self.docs[nodes[lead, np.arange(len(lead))]].astype(np.int64)
            found = (self.impacts(nodes, pivot) * weights).sum(0)
            good = found >= least
            scores, docs = np.append(scores, found[good]), np.append(docs, pivot[good])
            if len(scores) >= k:
                order = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[order], docs[order]
                least = max(least, int(scores[-1]))
            los, his = np.concatenate([lo, pivot + 1]), np.concatenate([pivot, hi])
            nodes = self.within(np.concatenate([nodes, nodes], 1), los, his)
            bound = bounds(nodes)
            keep = np.flatnonzero(bound >= least)
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            for i in range(0, len(keep), RANGES):
                x = keep[i : i + RANGES]
                heapq.heappush(heap, (-int(bound[x[0]]), made, los[x], his[x], nodes[:, x], bound[x]))
                made += 1
        return scores, docs


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(rid, doc_id, n, ids, tfs) of numbered rows: all terms' number, those in vocabulary with their frequencies."""

    def run(batches):
        for b in batches:
            n, ids, tfs = [], [], []
            for text in b.column(2).to_pylist():
                terms = terms_of(text)
                found = {vocabulary[t]: c for t, c in Counter(terms).items() if t in vocabulary}
                n.append(len(terms))
                ids.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["rid", "doc_id", "n", "ids", "tfs"])

    rows = docs.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(common.frugal(run), "rid long, doc_id long, n long, ids array<int>, tfs array<long>")


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * n * documents) div total, without an overflow."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // total
    return np.array([75 + 25 * x * documents // total for x in n.tolist()], np.int64)


def answered(found: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], terms: int, documents: int, total: int, k: int) -> DataFrame:
    """(qid, rid, doc_id, score): the first k documents of each task for queries (qid, terms, weights)."""

    def segments(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(3).flatten())
            if size >= SEGMENT:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        tops = {}
        for table in segments(batches):
            table = table.take(np.argsort(table["rid"].to_numpy(), kind="stable"))
            rids, n = table["rid"].to_numpy(), table["n"].to_numpy()
            doc_ids = table["doc_id"].combine_chunks()
            ids, tfs = (table[c].combine_chunks() for c in ("ids", "tfs"))
            doc = np.repeat(np.arange(len(rids), dtype=np.int32), np.diff(ids.offsets.to_numpy()))
            ids, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, tfs))
            impact = 1000000000 * tfs // (1000 * tfs + 12 * lengths(n, documents, total)[doc])
            order = np.argsort(ids, kind="stable")
            segment = Segment(ids[order], doc[order], impact[order], terms)
            for q, (_, asked, weights) in enumerate(queries):
                scores, ranked, given = tops.get(q, (np.empty(0, np.int64), np.empty(0, np.int64), []))
                least = max(1, int(scores[-1])) if len(scores) >= k else 1
                more, at = segment.search(asked, weights, len(rids), k, least)
                if len(more):
                    scores, ranked = np.append(scores, more), np.append(ranked, rids[at])
                    given = [*given, *doc_ids.take(pa.array(at)).to_pylist()]
                    best = np.lexsort((ranked, -scores))[:k]
                    tops[q] = scores[best], ranked[best], [given[i] for i in best]
        for q, (scores, ranked, given) in tops.items():
            yield pa.RecordBatch.from_arrays([pa.array([queries[q][0]] * len(scores), pa.int64()), pa.array(ranked), pa.array(given, pa.int64()), pa.array(scores)], ["qid", "rid", "doc_id", "score"])

    return found.mapInArrow(common.frugal(run), "qid long, rid long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores for each row of items.

    items has item_id and text. A score above 0 is needed; equal scores go by ascending doc_id,
    documents without one last, those of one doc_id in no fixed order but each with its rank.
    Null texts have no terms; items without terms, or whose terms no document holds, get no row.
    Repeated items are answered each, repeated documents rank each. Texts are taken whole; other
    columns are ignored; an empty table on either side gives an empty table. Queries go in blocks
    of about QUERY_BYTES, each one pass over the documents; blocks are what the driver holds.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def split(batches):
        for b in batches:
            found = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["qid", "terms", "tfs"])

    asked = common.stored(items.select(F.monotonically_increasing_id().alias("qid"), F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    parsed = common.stored(asked.select("qid", "text").mapInArrow(common.frugal(split), "qid long, terms array<binary>, tfs array<long>"), "queries")
    size = parsed.agg(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + 40 + length(t))"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    rows = common.numbered(docs.select("doc_id", "text"))
    parts = []
    for block in range(blocks):
        mine = parsed.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).filter(F.size("terms") > 0).collect()
        names = sorted({bytes(t) for r in mine for t in r.terms})
        numbers = {t: i for i, t in enumerate(names)}
        found = common.stored(postings(rows, numbers), "postings")
        documents, total = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        weights = np.zeros(len(names), np.int64)
        for t, df in found.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
            weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        queries = []
        for r in mine:
            ids = np.array([numbers[bytes(t)] for t in r.terms])
            queries.append((r.qid, ids, weights[ids] * np.array(r.tfs)))
        parts.append(answered(found, queries, len(names), documents, total or 1, k))
    found = functools.reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    """DuckDB SQL for ranked with its default parameters."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lower}, '{term}') AS ts FROM documents
), s AS (
  SELECT count(*) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM d WHERE len(ts) > 0
), p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL
), v AS (
  SELECT t, CAST(floor(1000 * ln((2 * (SELECT N FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t
), i AS (
  SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS t FROM benchmark) GROUP BY ALL
), x AS (
  SELECT i.item_id, p.doc_id, CAST(sum(i.c * v.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.N) // s.L)))) AS BIGINT) AS score
  FROM i JOIN p ON p.t = i.t JOIN v ON v.t = i.t CROSS JOIN s GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20
"""
