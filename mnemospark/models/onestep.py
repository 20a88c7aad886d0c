"""FSRS-6 by one pass of online gradient steps that look back one review only.

Weights move with every review, so a card's history is replayed for each of them. Trainings (a
learner's folds, and many learners) don't depend on one another and go in lock-step: the k-th
review of all of them is one set of vectors, its slopes one matrix.
"""

from __future__ import annotations

import numpy as np

from . import numeric as nm
from .learner import Learner
from .recurrent import MODELS

RATE, FLOOR = 1e-4, 0.001
#: Weights of the same-day branch move freely.
UNBOUND = (17, 18, 19)
_BOUNDS = np.array([(FLOOR, 100.0)] * 4 + [(-np.inf, np.inf) if k in UNBOUND else b for k, b in enumerate(MODELS["FSRS-6"].bounds[4:], 4)])


def curve(t, s, w):
    """Recall at t; like the functions below, of vectors or of Duals, each row with its own weights w[k]."""
    return nm.power((nm.power(0.9, -1.0 / w[20]) - 1.0) * (t / s) + 1.0, -w[20])


def difficulty(d, r, w):
    """The difficulty after a review, not yet held between 1 and 10."""
    aim = w[4] - nm.exp(w[5] * 3.0) + 1.0
    return w[7] * aim + (1.0 - w[7]) * (d - w[6] * ((r - 3) * (10 - d) / 9))


def lapse(s, d, forgot, w):
    return w[11] * nm.power(d, -w[12]) * (nm.power(s + 1.0, w[13]) - 1.0) * nm.exp(w[14] * forgot)


def growth(s, d, forgot, r, w):
    factor = nm.where(r == 2, w[15], nm.where(r == 4, w[16], np.ones(len(r))))
    return s * (nm.exp(w[8]) * (11.0 - d) * nm.power(s, -w[9]) * (nm.exp(w[10] * forgot) - 1.0) * factor + 1.0)


def begin(r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after first reviews; w has a column for each row."""
    first = w[np.maximum(r, 1) - 1, np.arange(len(r))]
    return np.maximum(FLOOR, first), np.clip(w[4] - np.exp(w[5] * (r - 1)) + 1, 1.0, 10.0)


def advance(s: np.ndarray, d: np.ndarray, dt: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after reviews; unlike the predicting model, stability sees the new difficulty,
    a lapse is not held below the old stability, and there is no upper bound."""
    new_d = np.clip(difficulty(d, r, w), 1.0, 10.0)
    q = np.exp(w[17] * (r - 3 + w[18])) * s ** -w[19]
    same_day = np.where(s <= 0, FLOOR, s * np.where(r >= 3, np.maximum(q, 1.0), q))
    forgot = 1 - curve(dt, s, w)
    later = np.where(r == 1, lapse(s, new_d, forgot, w), growth(s, new_d, forgot, r, w))
    return np.maximum(FLOOR, np.where(dt < 1, same_day, later)), new_d


def slopes(t, y, s, d, s0, d0, dt, r, first, w: np.ndarray) -> np.ndarray:
    """(rows, weights): derivatives of reviews' cross-entropy, back through the last step only.

    (s, d) is the state, (s0, d0) the one before its last step of interval dt and rating r; first
    marks states after a first review. Where that differs from a plain gradient: a first
    stability moves 100 times faster; the recall at the last step is a constant, and bounds have
    no slope of zero; a last step on the same day is taken as one between days, where a lapse's
    slopes, but for the one by weight 13, are in proportion to the stability that it really left.
    """
    n, unit = len(w), np.eye(len(w))
    v = [nm.Dual(w[k], unit[k]) for k in range(n)]
    forgot = 1 - curve(dt, s0, w)
    new_d = nm.Dual(d, difficulty(d0, r, v).g)
    failed, grown = lapse(s0, new_d, forgot, v), growth(s0, new_d, forgot, r, v)
    share = np.where(np.arange(n) == 13, 1.0, (s / failed.v)[:, None])
    g = np.where((r == 1)[:, None], failed.g * share, grown.g)
    g = np.where(first[:, None], 100.0 * unit[np.maximum(r, 1) - 1], g)
    told = curve(t, nm.Dual(s, g), v)
    p = np.clip(told.v, 1e-9, 1 - 1e-9)
    return ((p - y) / (p * (1 - p)))[:, None] * told.g


def train(tasks: list[tuple[Learner, int, np.ndarray]]) -> np.ndarray:
    """(tasks, weights): one pass over the first n rows of each (learner, n, start), all together.

    Same-day rows and rows without history are passed by, as are those of the least stability.
    """
    if not tasks:
        return np.empty((0, len(_BOUNDS)))
    # Cards of all learners in one matrix, rows of a task as places in it.
    learners = list({id(x): x for x, _, _ in tasks}.values())
    widest = max(x.ratings.shape[1] for x in learners)
    first_card = dict(zip(map(id, learners), np.cumsum([0, *(len(x.ratings) for x in learners[:-1])]), strict=True))
    ratings, delta = (np.concatenate([np.pad(m, ((0, 0), (0, widest - m.shape[1]))) for m in ms]) for ms in ([x.ratings for x in learners], [x.delta for x in learners]))
    rows = [np.flatnonzero((x.column("delta_t")[:n] >= 1) & (x.column("pos")[:n] > 0)) for x, n, _ in tasks]
    order = np.argsort([-len(r) for r in rows], kind="stable")
    count = np.array([len(rows[k]) for k in order])
    card, pos, t, y = (np.zeros((len(tasks), int(count.max(initial=0))), kind) for kind in (int, int, float, float))
    for place, k in enumerate(order):
        x, r = tasks[k][0], rows[k]
        card[place, : len(r)] = x.card[r] + first_card[id(x)]
        for m, name in ((pos, "pos"), (t, "delta_t"), (y, "y")):
            m[place, : len(r)] = x.column(name)[r]
    w = np.array([tasks[k][2] for k in order], float).T
    with np.errstate(all="ignore"):
        for j in range(card.shape[1]):
            n = int((count > j).sum())  # those that still have rows come first
            now, at, length = w[:, :n], card[:n, j], pos[:n, j]
            r, dt = ratings[at], delta[at]
            s, d = begin(r[:, 0], now)
            s0, d0 = np.ones(n), np.full(n, 5.0)
            for k in range(1, int(length.max())):
                more = length > k
                after = advance(s, d, dt[:, k], r[:, k], now)
                s0, d0 = np.where(more, s, s0), np.where(more, d, d0)
                s, d = np.where(more, after[0], s), np.where(more, after[1], d)
            last = np.arange(n), length - 1
            g = slopes(t[:n, j], y[:n, j], s, d, s0, d0, dt[last], r[last], length == 1, now)
            moved = np.clip(now - RATE * g.T, _BOUNDS[:, :1], _BOUNDS[:, 1:])
            w[:, :n] = np.where(s > FLOOR, moved, now)
    out = np.empty((len(tasks), len(w)))
    out[order] = w.T
    return out
