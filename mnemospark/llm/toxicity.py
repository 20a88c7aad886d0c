"""Toxicity: texts are restored through the noisy channel, then scored by a trained classifier.

The character model counts all texts. The classifier is a logistic regression on the presence
of word beginnings and whole words among the plain and restored words; it is fitted on at most
``SAMPLE`` labelled rows (a documented bound, taken by a hash of doc_id), never on held-out ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, noisy

#: Most labelled rows that the classifier is fitted on, most features it has.
SAMPLE, FEATURES = 20_000, 2_000
#: Lengths of word beginnings that are features; 0 is the whole word.
STEMS = (4, 5, 6, 0)
FOLDS = 5


@dataclass
class Model:
    cost: np.ndarray
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, features(words) & self.weights.keys()))
        return float(1 / (1 + np.exp(-z)))


def features(words: set[str]) -> set[str]:
    out = {w + "$" for w in words}
    for n in STEMS:
        if n:
            out.update(w[:n] for w in words if len(w) >= n)
    return out


def character_costs(docs: DataFrame) -> np.ndarray:
    """The character model of all texts; each task sends one table of fixed size."""

    def run(batches):
        total = np.zeros(noisy.SIZE**3, np.int64)
        for b in batches:
            total += noisy.trigram_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = docs.select(common.text_of(docs).alias("text")).mapInArrow(common.frugal(run), "code long, n long")
    counts = np.zeros(noisy.SIZE**3, np.int64)
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # SIZE ** 3 rows at most
        counts[r["code"]] = r["n"]
    return noisy.costs(counts)


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, y) of at most size labelled rows out of the training folds.

    The ids are at most size many, so they are broadcast; only texts with such an id are shuffled.
    Of repeated rows of an id one counts, so an id with many rows doesn't fill the driver.
    """
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.fold_of(F.col("doc_id"), FOLDS) != 0))
    chosen = chosen.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("labelled"), "labelled").limit(size)
    rows = docs.select("doc_id", common.text_of(docs).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))


def fit_weights(rows: list[tuple[list[int], int]], n: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse presence features, by full-batch Adam."""
    at = np.array([i for i, (x, _) in enumerate(rows) for _ in x], np.int64)
    col = np.array([c for x, _ in rows for c in x], np.int64)
    y = np.array([v for _, v in rows], float)
    w, b = np.zeros(n), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, steps + 1):
        z = b + np.bincount(at, w[col], len(y))
        e = (1 / (1 + np.exp(-z)) - y) / max(len(y), 1)
        g = np.append(np.bincount(col, e[at], n) + 1e-5 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Fits the channel's character model on all texts and the classifier on the sample.

    Without labelled rows, or with one class only, every score is the share of that class.
    """
    common.prepare(docs.sparkSession)
    cost = character_costs(docs)
    rows = common.stored(sample(docs, labels, size), "toxicity-sample").repartition(common.partitions(docs.sparkSession))

    def count(batches):
        restorer, seen = noisy.Restorer(cost), {}
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for f in features(restorer.words(text.lower())):
                    c = seen.setdefault(f, [0, 0])
                    c[y] += 1
            if len(seen) > 500_000:
                yield counted(seen)
                seen = {}
        yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    counts = rows.mapInArrow(common.frugal(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Features of toxic texts by the surplus of their share over that among clean ones.
    surplus = F.col("toxic") / F.lit(float(toxic or 1)) - 3 * F.col("clean") / F.lit(float(clean or 1))
    chosen = [r["feature"] for r in counts.filter("toxic >= 3").withColumn("surplus", surplus).filter("surplus > 0").orderBy(F.desc("surplus"), "feature").limit(FEATURES).collect()]
    place = {f: i for i, f in enumerate(chosen)}

    def vectors(batches):
        restorer = noisy.Restorer(cost)
        for b in batches:
            found = [sorted(place[f] for f in features(restorer.words(t.lower())) & place.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(2).cast(pa.int32())], ["x", "y"])

    data = [(r["x"], r["y"]) for r in rows.mapInArrow(common.frugal(vectors), "x array<int>, y int").collect()]
    if not clean or not toxic:
        return Model(cost, {}, float(np.log((toxic + 0.5) / (clean + 0.5))) if data else -1.0)
    w, b = fit_weights(data, len(chosen))
    return Model(cost, {f: float(x) for f, x in zip(chosen, w, strict=True)}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, text, score) of every row of docs: row is a struct of all columns but text, so no
    name clashes; the score is from 0 to 1.

    A null text counts as empty and stays null; empty texts get the score of a text without any
    feature. Texts of any length are scored whole. Repeated rows are scored each, an empty table
    gives an empty table.
    """
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        restorer = noisy.Restorer(m.cost)
        for b in batches:
            found = [m.score(restorer.words((t or "").lower())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], ["row", "text", "score"])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), "text")
    return rows.mapInArrow(common.frugal(run), T.StructType(list(rows.schema)).add("score", "double"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(rows, train(docs, labels)).select("row.doc_id", "score")
    return found.select("doc_id", (common.fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
