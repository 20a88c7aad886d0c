"""Models on counts and times of a card's history: half-life regression, DASH, ACT-R.

Each has prepare(learner, rows) -> features, and probability(features, w), on arrays or Duals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import numeric as nm
from .learner import Learner

#: Look-back windows in days, decay times of the smooth counts.
WINDOWS = (1.0, 7.0, 30.0, np.inf)
DECAYS = (0.2434, 1.9739, 16.009, 129.8426)


def sigmoid(z):
    return 1.0 / (nm.exp(-z) + 1.0)


def hlr_features(x: Learner, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(root of passed reviews, root of failed ones, interval)."""
    ratings, _, lengths = x.history(at)
    there = np.arange(ratings.shape[1]) < lengths[:, None]
    return np.sqrt((there & (ratings > 1)).sum(1)), np.sqrt((there & (ratings == 1)).sum(1)), x.column("delta_t")[at]


def hlr(f, w):
    passed, failed, t = f
    half = nm.exp((w[0] * passed + w[1] * failed + w[2]) * np.log(2.0))
    return nm.exp(np.log(0.5) * (t / half))


def since(later: np.ndarray) -> np.ndarray:
    """Time from each review to now: sums of the intervals after it."""
    return np.cumsum(later[:, ::-1], 1)[:, ::-1]


def dash_features(x: Learner, at: np.ndarray, decay: bool = False) -> tuple[np.ndarray, ...]:
    """Reviews and passed reviews for each window; with decay, weighted by their age."""
    ratings, _, lengths = x.history(at)
    there = np.arange(ratings.shape[1]) < lengths[:, None]
    age, passed = since(x.later_delta(at)), ratings > 1
    out = []
    for k in range(4):
        weight = (there & (age <= WINDOWS[k])) * (np.exp(-age / DECAYS[k]) if decay else 1.0)
        out += [weight.sum(1), (weight * passed).sum(1)]
    return tuple(out)


def dash(f, w):
    z = w[8] + np.zeros(len(f[0]))
    for k, x in enumerate(f):
        z = z + w[k] * np.log1p(x)
    return sigmoid(z)


@dataclass(frozen=True)
class Ages:
    """Reviews that n rows look back on: the row of each, ascending, its age, whether it was passed."""

    n: int
    row: np.ndarray
    age: np.ndarray
    passed: np.ndarray

    def __getitem__(self, rows) -> Ages:
        count = np.bincount(self.row, minlength=self.n)
        begin, size = (np.cumsum(count) - count)[rows], count[rows]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Ages(len(size), np.repeat(np.arange(len(size)), size), self.age[at], self.passed[at])


def dash_actr_features(x: Learner, at: np.ndarray) -> tuple[Ages]:
    """Reviews more than a tenth of a day old. An age is a difference of times on the
    card, as in the query's SQL: a sum of intervals can lie on the other side of the tenth."""
    ratings, _, lengths = x.history(at)
    time = np.cumsum(x.delta, 1)[x.card[at]]
    age = time[np.arange(len(at)), lengths][:, None] - time[:, : ratings.shape[1]]
    row, k = np.nonzero((np.arange(ratings.shape[1]) < lengths[:, None]) & (age > 0.1))
    return (Ages(len(at), row, age[row, k], ratings[row, k] > 1),)


def dash_actr(f, w):
    (a,) = f
    strength = nm.where(a.passed, nm.spread(w[3], a.row), nm.spread(w[2], a.row))
    total = nm.summed(nm.power(a.age, nm.spread(-w[1], a.row)) * strength, a.row, a.n)
    return sigmoid(w[0] * nm.log(nm.clip(total, 0.0) + 1.0) + w[4])


@dataclass(frozen=True)
class Activations:
    """Rows of cards: time (cards, reviews) of each card's reviews; by row its card in time, its length
    and the number of its card, which is another one for each training.

    All rows of a card share one triangle of activations, whatever their number.
    """

    time: np.ndarray
    card: np.ndarray
    length: np.ndarray
    own: np.ndarray

    def __getitem__(self, rows) -> Activations:
        return Activations(self.time, self.card[rows], self.length[rows], self.own[rows])

    def apart(self, of: np.ndarray) -> Activations:
        """The rows with cards of their own for each training of."""
        return Activations(self.time, self.card, self.length, of * len(self.time) + self.card)


def actr_features(x: Learner, at: np.ndarray) -> tuple[Activations]:
    """The times of the cards' reviews up to and with the rows' own."""
    return (Activations(np.cumsum(x.delta, 1), x.card[at], x.column("pos")[at], x.card[at]),)


def actr(f, w):
    """Activation after each review sums what is left of the earlier ones, whose decay grows
    with their own activation. One pass a card, longest cards first: review i adds one row of its triangle."""
    (a,) = f
    _, head, card = np.unique(a.own, return_index=True, return_inverse=True)
    longest = np.zeros(len(head), np.int64)
    np.maximum.at(longest, card, a.length)
    order = np.argsort(-longest, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    head, card, longest = head[order], place[card], longest[order]
    by = np.argsort(a.length, kind="stable")
    most = int(longest[0]) if len(longest) else 0
    ends = np.searchsorted(a.length[by], np.arange(most + 2))
    w = [nm.take(x, head) for x in w]
    exponents, told = [nm.full(-w[0], head)], [np.zeros(ends[1])]
    for i in range(1, most + 1):
        alive = int(np.searchsorted(-longest, -i, "right"))
        rows, mine = np.repeat(np.arange(alive), i), slice(0, alive)
        time = a.time[a.card[head[:alive]], : i + 1]
        held = nm.clip(nm.spread(w[4], rows) * ((time[:, i:] - time[:, :i]) * 86400.0).ravel(), 1.0)
        total = nm.summed(nm.power(held, nm.beside(exponents, alive)), rows, alive)
        exponents.append(-(nm.take(w[1], mine) * total + nm.take(w[0], mine)))
        told.append(nm.take(nm.log(total), card[by[ends[i] : ends[i + 1]]]))
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    last = nm.take(nm.joined(told), back)
    w = [nm.spread(x, card) for x in w]
    return 1.0 / (nm.exp((w[3] - last) / w[2]) + 1.0)


def some(f: tuple, rows: np.ndarray) -> tuple:
    """The features of the rows given."""
    return tuple(x[rows] for x in f)


def apart(f: tuple, of: np.ndarray) -> tuple:
    """Features of rows that belong to the trainings of."""
    return tuple(x.apart(of) if isinstance(x, Activations) else x for x in f)


@dataclass(frozen=True)
class Counted:
    name: str
    start: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    prepare: Callable
    probability: Callable
    long_rows: bool = True
    not_short: tuple[float, ...] = ()
    #: How much longer than max_seq_len a training row's history may be, if it is bounded.
    slack: int = 0

    def weights(self, short: bool) -> np.ndarray:
        return np.array(self.not_short if self.not_short and not short else self.start)


_NONE = -np.inf
_ANY = np.inf


def _open(n: int) -> dict:
    return {"low": (_NONE,) * n, "high": (_ANY,) * n}


# Default weights and bounds.
DASH_SHORT = (-0.1766, 0.4483, -0.3618, 0.5953, -0.5104, 0.8609, -0.3643, 0.6447, 1.2815)
MODELS = {
    m.name: m
    for m in (
        Counted("HLR", (2.5819, -0.8674, 2.7245), **_open(3), prepare=hlr_features, probability=hlr),
        Counted("DASH", DASH_SHORT, **_open(9), prepare=dash_features, probability=dash, not_short=(0.2024, 0.5967, 0.1255, 0.6039, -0.1485, 0.572, 0.0933, 0.4801, 0.787)),
        Counted(
            "DASH[MCM]", DASH_SHORT, **_open(9), prepare=lambda x, at: dash_features(x, at, True), probability=dash,
            not_short=(0.2783, 0.8131, 0.4252, 1.0056, -0.1527, 0.6455, 0.1409, 0.669, 0.843),
        ),
        Counted(
            "DASH[ACT-R]", (1.4164, 0.516, -0.0564, 1.9223, 1.0549), low=(0.001, 0.001, _NONE, _NONE, _NONE), high=(_ANY,) * 5, prepare=dash_actr_features,
            probability=dash_actr,
        ),
        Counted(
            "ACT-R", (0.176786766570677, 0.216967308403809, 0.254893976981164, -0.704205679427144, 0.025), low=(0.001, 0.001, 0.001, _NONE, 0.001),
            high=(1.0, 1.0, 1.0, -0.001, 1.0), prepare=actr_features, probability=actr, long_rows=False, slack=-1,
        ),
    )
}
