"""A model's predictions on the test folds of each learner, trained fold by fold.

Learners are read in blocks, whose trainings take each step together; a log that is longer than
a block is one of its own, never more.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import history
from . import counts, lockstep, recurrent, regression, training
from . import numeric as nm
from .learner import NEEDED as NEEDED
from .learner import Learner, folds

PREDICTIONS = "user_id long, card_id long, review_th long, y long, delta_t double, i long, rmse_bins_lapse long, fold int, p double, parameters string, time_ms double"
#: What of a review is told again.
ASKED = ("user_id", "card_id", "review_th", "y", "delta_t", "i", "rmse_bins_lapse")
#: Least reviews of a learner.
LEAST = 6
#: Reviews of learners that are trained in lock-step; the same for models whose work is pairs of reviews; rows of a batch of predictions.
BLOCK, PAIRS, TOLD = 1 << 15, 1 << 14, 1 << 16


def recency(n: int, on: bool) -> np.ndarray:
    x = np.arange(n) / (n - 1.0) if n > 1 else np.zeros(n)
    return 0.25 + 0.75 * x**3 if on else np.ones(n)


@dataclass
class Recurrent:
    """Training rows of a recurrent model."""

    m: recurrent.Recurrence
    x: Learner
    at: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    s_min: float

    def __post_init__(self) -> None:
        self.n, self.y = len(self.at), self.x.column("y")[self.at].astype(float)
        self.lengths, self.t = self.x.column("pos")[self.at], self.x.column("delta_t")[self.at]
        self.frozen = np.arange(len(self.start)) < (4 if self.m.frozen_s0 else 0)
        self.l2 = 1 / np.square(self.m.l2) if self.m.l2 else np.zeros(len(self.start))

    def predict(self, w, rows):
        return recurrent.predict(self.m, *self.x.history(self.at[rows]), self.t[rows], w, self.s_min)

    def clipped(self, w):
        return self.m.clipped(w, self.s_min)

    def penalty(self, w):
        return float((np.square(w - self.start) * self.l2).sum())

    def penalty_gradient(self, w):
        return 2 * (w - self.start) * self.l2


@dataclass
class Counting:
    """Training rows of a model on counts."""

    m: counts.Counted
    x: Learner
    at: np.ndarray
    weight: np.ndarray
    start: np.ndarray

    def __post_init__(self) -> None:
        self.n, self.y = len(self.at), self.x.column("y")[self.at].astype(float)
        self.lengths = self.x.column("pos")[self.at]
        self.frozen = np.zeros(len(self.start), bool)
        self.features = self.m.prepare(self.x, self.at)

    def predict(self, w, rows):
        return self.m.probability(tuple(f[rows] for f in self.features), w)

    def clipped(self, w):
        return np.clip(w, self.m.low, self.m.high)

    def penalty(self, w):
        return 0.0

    def penalty_gradient(self, w):
        return np.zeros(len(self.start))


def with_s0(m: recurrent.Recurrence, x: Learner, at: np.ndarray, s: Settings, start: np.ndarray, local: bool = False) -> np.ndarray:
    """start with its first four weights fitted on rows at."""
    out = start.copy()
    out[:4] = training.initial_stabilities(
        *(x.column(c)[at] for c in ("first_rating", "delta_t", "i", "y")), start[:4], lambda t, stab: nm.value(m.curve(t, stab, start)), s.secs, s.s_min, recurrent.S0_MAX, local
    )
    return out


def recurrent_weights(m: recurrent.Recurrence, x: Learner, at: np.ndarray, s: Settings) -> np.ndarray:
    start = m.weights(s.secs)
    if s.default:
        return start
    if m.fits_s0:
        start = with_s0(m, x, at, s, start)
        if s.only_s0 and m.l2:
            return start
    keep = x.column("pos")[at] <= s.max_seq_len
    if m.later_rows_only:
        keep &= x.column("i")[at] > 2
    return training.train(Recurrent(m, x, at[keep], recency(len(at), s.recency)[keep], start, s.s_min))


def counted_weights(m: counts.Counted, x: Learner, at: np.ndarray, s: Settings) -> np.ndarray:
    start = m.weights(s.short)
    if s.default:
        return start
    keep = np.ones(len(at), bool) if m.long_rows else x.column("pos")[at] <= s.max_seq_len + m.slack
    return training.train(Counting(m, x, at[keep], recency(len(at), s.recency)[keep], start))


def rounded(parameters: dict | list) -> dict | list:
    if isinstance(parameters, dict):
        return {k: rounded(w) for k, w in parameters.items()}
    return [round(float(x), 6) for x in parameters]


@dataclass
class Trainings:
    """Trainings of a block of learners: each one's learner, fold, rows to train on and tested ones, as ranges."""

    learner: np.ndarray
    fold: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    test: np.ndarray
    tests: np.ndarray

    @staticmethod
    def of(user: np.ndarray, k: int) -> Trainings:
        """k folds of each run of equal learners; those with fewer than LEAST rows have none."""
        first = np.flatnonzero(np.append(True, user[1:] != user[:-1])) if len(user) else np.zeros(0, np.int64)
        rows = np.diff(np.append(first, len(user)))
        some = rows >= LEAST
        ends = np.array([folds(int(n), k) for n in rows[some]], np.int64).reshape(-1, k, 2)
        learner, fold = (x.ravel() for x in np.indices(ends.shape[:2]))
        start, end = ends.reshape(-1, 2).T
        begin = first[some][learner]
        kept = end > start
        return Trainings(*(x[kept] for x in (learner, fold, begin, start, begin + start, end - start)))


def told(rows: dict, at: np.ndarray, of: np.ndarray, p: np.ndarray, fold: np.ndarray, texts: list[str], ms: np.ndarray):
    """PREDICTIONS of the rows at, which belong to the trainings of, in batches of TOLD rows."""
    names, texts = [c.split()[0] for c in PREDICTIONS.split(", ")], pa.array(texts, pa.string())
    for k in range(0, len(at), TOLD):
        mine, t = at[k : k + TOLD], of[k : k + TOLD]
        columns = [rows[c][mine].astype(float if c == "delta_t" else np.int64) for c in names[:7]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(fold[t].astype(np.int32)), pa.array(p[k : k + TOLD]), texts.take(pa.array(t)), pa.array(ms[t])], names)


def so_far(x: Trainings, began: float) -> np.ndarray:
    """What a learner's folds up to each one took: shares of the block's time since began."""
    return (time.perf_counter() - began) * 1000 / len(x.fold) * (lockstep.places(x.learner) + 1.0)


def of_block(rows: dict, s: Settings):
    """PREDICTIONS under a model on counts of a block of learners, whose reviews are sorted by learner, card and pos."""
    began, m = time.perf_counter(), counts.MODELS[s.algo]
    user, card_id = rows["user_id"], rows["card_id"]
    card = np.cumsum(np.append(True, (user[1:] != user[:-1]) | (card_id[1:] != card_id[:-1]))) - 1
    pos = rows["pos"].astype(np.int64)
    shape = (int(card[-1]) + 1, int(pos.max()) + 1)
    ratings, delta = np.zeros(shape, np.int8), np.zeros(shape)
    ratings[card, pos], delta[card, pos] = rows["rating"], rows["delta_t"]
    at = np.flatnonzero(rows["evaluable"])
    at = at[np.lexsort((rows["review_th"][at], user[at]))]
    log = {c: v[at] for c, v in rows.items()} | {"pos": pos[at]}
    x = Trainings.of(log["user_id"], s.n_splits)
    if not len(x.fold):
        return
    f = m.prepare(Learner(pd.DataFrame(log), card[at], ratings, delta), np.arange(len(at)))
    y, tested, of = log["y"].astype(float), lockstep.ranges(x.test, x.tests), np.repeat(np.arange(len(x.fold)), x.tests)
    start = m.weights(s.short)
    if s.default:
        w, p = np.tile(start, (len(x.fold), 1)), m.probability(counts.some(f, tested), start)
    else:
        used, mine = lockstep.ranges(x.begin, x.n), np.repeat(np.arange(len(x.fold)), x.n)
        weight = lockstep.recency(lockstep.places(mine), x.n[mine], s.recency)
        w = lockstep.counted_weights(m, f, used, mine, log["pos"][used], y[used], weight, len(x.fold), s)
        p = m.probability(counts.apart(counts.some(f, tested), of), w[of].T)
    texts = [json.dumps(rounded({"0": v})) for v in w.tolist()]
    yield from told(log, tested, of, p, x.fold, texts, so_far(x, began))


def of_regression(rows: dict, s: Settings):
    """PREDICTIONS under the regression of a block of learners, whose evaluated reviews are sorted by learner and time."""
    began, x = time.perf_counter(), Trainings.of(rows["user_id"], s.n_splits)
    if not len(x.fold):
        return
    terms, y, at = regression.Terms([rows[c] for c in history.COUNTERS]), rows["y"], None
    if "equal_fold" in rows:
        # The tests are those of the days' folds, the rows to train on what comes before the first of them.
        last = np.searchsorted(rows["user_id"], rows["user_id"][x.begin], "right")
        at = [b + np.flatnonzero(rows["equal_fold"][b:e] == f) for b, e, f in zip(x.begin, last, x.fold, strict=True)]
        x.n = np.array([int(rows["equal_end"][a[0]]) if len(a) else 0 for a in at])
        x.tests, at = np.array([len(a) for a in at]), np.concatenate(at)
    else:
        at = lockstep.ranges(x.test, x.tests)
    w = np.tile(regression.MEAN, (len(x.fold), 1)) if s.default else lockstep.regression_weights(terms, x.begin, x.n, y)
    of, p = np.repeat(np.arange(len(x.fold)), x.tests), np.empty(len(at))
    for k in range(0, len(at), TOLD):
        p[k : k + TOLD] = 1 / (1 + np.exp(-np.einsum("ij,ij->i", terms[at[k : k + TOLD]], w[of[k : k + TOLD]])))
    texts = [json.dumps(rounded(v)) for v in w.tolist()]
    yield from told(rows, at, of, p, x.fold, texts, so_far(x, began))


def predictions(features: DataFrame, s: Settings) -> DataFrame:
    """PREDICTIONS of all learners from features with partition (and equal folds, if asked for).

    A task reads its learners in order and trains blocks of them in lock-step. parameters are JSON
    text with 6 decimals; time_ms is a training's share of its block's time, summed up to the fold.
    """
    if s.algo == "FSRS-rs":
        raise ValueError("FSRS-rs trains in an outside library that is not here; its item lists are in models.items")
    if s.algo != "LogisticRegression" and s.algo not in counts.MODELS:
        raise ValueError(f"unknown model {s.algo}")
    narrow = {"rating": "byte", "y": "byte", "pos": "short", "r": "byte", "opening": "byte", "fr": "boolean", "ls": "boolean", "equal_fold": "byte"}
    narrow |= {c: "short" for c in ("sf", "nf", "sp", "np", "pn", "sn", "nn")}
    if s.algo == "LogisticRegression":
        source, run, order, most = history.logreg_counters(features), of_regression, ["review_th"], BLOCK
        columns = [*ASKED, *(c for c in history.COUNTERS if c not in ASKED), *(c for c in ("equal_fold", "equal_end") if c in features.columns)]
    else:
        source, run, order, most = features, of_block, ["card_id", "pos"], PAIRS if s.algo in ("ACT-R", "DASH[ACT-R]") else BLOCK
        columns = [*ASKED, "rating", "pos", "evaluable"]

    def fit(batches):
        with np.errstate(all="ignore"):
            for held in lockstep.blocks(batches, 1, most):
                rows = {}
                for c in columns:
                    rows[c] = np.concatenate(held.pop(0))
                yield from run(rows, s)

    # Few bytes, much work: a fixed number of partitions, which adaptive execution does not merge.
    spark = features.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log = source.select(*[F.col(c).cast(narrow[c]) if c in narrow else F.col(c) for c in columns])
    return log.repartition(n, "user_id").sortWithinPartitions("user_id", *order).mapInArrow(fit, PREDICTIONS)


def items(features: DataFrame) -> DataFrame:
    """(user_id, review_th, ratings, intervals): each evaluated review after its card's history.

    Intervals are whole days, cut off; reviews without a history are left out.
    """
    whole = F.array_sort(F.collect_list(F.struct("pos", "rating", F.floor("delta_t").alias("days"))))
    cards = features.groupBy("user_id", "card_id").agg(whole.alias("history"))
    rows = features.filter("evaluable AND pos > 0").select("user_id", "card_id", "review_th", "pos").join(cards, ["user_id", "card_id"])
    upto = F.slice("history", F.lit(1), (F.col("pos") + 1).cast("int"))
    return rows.select("user_id", "review_th", F.transform(upto, lambda h: h["rating"]).alias("ratings"), F.transform(upto, lambda h: h["days"]).alias("intervals"))
