"""Models that replay a card's history: a state, a step for a review, a forgetting curve.

States start at position 0; after every step stability is held in [s_min, 36500] and, unless a
model says otherwise, difficulty in [1, 10]. A row without history keeps stability 0, so its
probability is 0 and its gradient undefined, as division by zero has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import numeric as nm

S_MAX, S0_MAX = 36500.0, 100.0
LN_09 = float(np.log(0.9))


def exponential(t, s, w):
    return nm.exp(LN_09 * (t / s))


def hyperbolic(t, s, w):
    return 1.0 / (t / (s * 9.0) + 1.0)


def power_half(t, s, w):
    return nm.power((0.9**-2 - 1) * (t / s) + 1.0, -0.5)


def power_trained(t, s, w):
    d = -w[20]
    return nm.power((nm.exp(LN_09 / d) - 1.0) * (t / s) + 1.0, d)


@dataclass(frozen=True)
class Recurrence:
    """start: default weights; bounds: by weight (low, high); begin(r, w) and step(state, dt, r, w)
    give states, stability first; curve(t, s, w); l2: spreads of a pull towards the start."""

    name: str
    start: tuple[float, ...]
    bounds: tuple[tuple[float, float] | None, ...]
    begin: Callable
    step: Callable
    curve: Callable
    l2: tuple[float, ...] = ()
    fits_s0: bool = False
    frozen_s0: bool = False
    later_rows_only: bool = False
    secs_start: tuple[float, ...] = field(default=())

    def weights(self, secs: bool) -> np.ndarray:
        return np.array(self.secs_start if secs and self.secs_start else self.start)

    def clipped(self, w: np.ndarray, s_min: float) -> np.ndarray:
        low = np.array([-np.inf if b is None else s_min if b[0] is S_FLOOR else b[0] for b in self.bounds], float)
        high = np.array([np.inf if b is None else b[1] for b in self.bounds], float)
        return np.clip(w, low, high)


#: Stands for the least stability in a bound.
S_FLOOR = object()
FREE = None


def states(m: Recurrence, ratings: np.ndarray, delta: np.ndarray, lengths: np.ndarray, w, s_min: float):
    """The stability after each row's history (0 without one)."""
    n = len(lengths)
    state = None
    for k in range(ratings.shape[1]):
        r, dt = ratings[:, k], delta[:, k]
        after = m.begin(r, w, s_min) if state is None else m.step(state, dt, r, w, s_min)
        after = (nm.clip(after[0], s_min, S_MAX), *after[1:])
        if state is None:
            state = tuple(nm.where(lengths > 0, x, np.zeros(n)) for x in after)
        else:
            state = tuple(nm.where(lengths > k, a, b) for a, b in zip(after, state, strict=True))
    return np.zeros(n) if state is None else state[0]


def predict(m: Recurrence, ratings, delta, lengths, t: np.ndarray, w, s_min: float):
    """Probabilities at interval t after the histories."""
    with np.errstate(all="ignore"):
        s = states(m, ratings, delta, lengths, w, s_min)
        p = m.curve(t, s, w)
    if isinstance(w[0], nm.Dual) and not isinstance(p, nm.Dual):
        p = nm.Dual(p, np.zeros((len(t), len(w))))
    return p


def _by_rating(r: np.ndarray, w, first: int = 0):
    """w[first + r - 1]."""
    out = nm.full(w[first], r)
    for k in (2, 3, 4):
        out = nm.where(r == k, nm.full(w[first + k - 1], r), out)
    return out


def _growth(r, w, hard: int, easy: int):
    """The factors for hard and easy reviews."""
    return nm.where(r == 2, nm.full(w[hard], r), nm.full(1.0, r)) * nm.where(r == 4, nm.full(w[easy], r), nm.full(1.0, r))


# --- the FSRS family -----------------------------------------------------------------------------


def _v1_begin(r, w, s_min):
    return w[0] * 2.0 ** (r - 1.0) / 4.0, w[1] + (3.0 - r), nm.maximum(2.0 - r, 0.0)


def _v1_step(state, dt, r, w, s_min):
    s, d, lapses = state
    p = exponential(dt, s, w)
    d = nm.clip(d + p + (0.1 - 2.0 ** (r - 1.0) / 4.0), 0.0)
    good = s * (nm.exp(w[2]) * nm.power(d + 0.1, w[3]) * nm.power(s, w[4]) * (nm.exp((1.0 - p) * w[5]) - 1.0) + 1.0)
    bad = w[0] * nm.exp(w[6] * lapses)
    return nm.where(r > 1, good, bad), d, lapses + nm.maximum(2.0 - r, 0.0)


def _v2_begin(r, w, s_min):
    return w[0] * (w[1] * (r - 1.0) + 1.0), nm.clip(w[2] * (w[3] * (r - 4.0) + 1.0), 1.0, 10.0)


def _v2_step(state, dt, r, w, s_min):
    s, d = state
    p = exponential(dt, s, w)
    d = nm.clip(w[5] * (w[2] * (1.0 - w[3])) + (1.0 - w[5]) * (d + w[4] * (r - 3.0)), 1.0, 10.0)
    good = s * (nm.exp(w[6]) * nm.power(d, w[7]) * nm.power(s, w[8]) * (nm.exp((1.0 - p) * w[9]) - 1.0) + 1.0)
    bad = w[10] * nm.power(d, w[11]) * nm.power(s, w[12]) * (nm.exp((1.0 - p) * w[13]) - 1.0)
    return nm.where(r > 1, good, bad), d


def _v3_begin(r, w, s_min):
    return w[0] + w[1] * (r - 1.0), nm.clip(w[2] + w[3] * (r - 3.0), 1.0, 10.0)


def _v3_step(state, dt, r, w, s_min):
    s, d = state
    p = exponential(dt, s, w)
    d = nm.clip(w[5] * w[2] + (1.0 - w[5]) * (d + w[4] * (r - 3.0)), 1.0, 10.0)
    good = s * (nm.exp(w[6]) * (11.0 - d) * nm.power(s, w[7]) * (nm.exp((1.0 - p) * w[8]) - 1.0) + 1.0)
    bad = w[9] * nm.power(d, w[10]) * nm.power(s, w[11]) * nm.exp((1.0 - p) * w[12])
    return nm.where(r > 1, good, bad), d


def _v4_begin(r, w, s_min):
    return _by_rating(r, w), nm.clip(w[4] - w[5] * (r - 3.0), 1.0, 10.0)


def _recalled(s, d, p, r, w):
    return s * (nm.exp(w[8]) * (11.0 - d) * nm.power(s, -w[9]) * (nm.exp((1.0 - p) * w[10]) - 1.0) * _growth(r, w, 15, 16) + 1.0)


def _forgotten(s, d, p, w):
    return w[11] * nm.power(d, -w[12]) * (nm.power(s + 1.0, w[13]) - 1.0) * nm.exp((1.0 - p) * w[14])


def _v4_step(state, dt, r, w, s_min, curve=hyperbolic, held: bool = False):
    s, d = state
    p = curve(dt, s, w)
    bad = _forgotten(s, d, p, w)
    after = nm.where(r > 1, _recalled(s, d, p, r, w), nm.minimum(bad, s) if held else bad)
    return after, nm.clip(w[7] * w[4] + (1.0 - w[7]) * (d - w[6] * (r - 3.0)), 1.0, 10.0)


def _v45_step(state, dt, r, w, s_min):
    return _v4_step(state, dt, r, w, s_min, power_half, True)


def _v5_begin(r, w, s_min):
    return _by_rating(r, w), nm.clip(w[4] - nm.exp(w[5] * (r - 1.0)) + 1.0, 1.0, 10.0)


def _v5_difficulty(d, r, w):
    aim = w[4] - nm.exp(w[5] * 3.0) + 1.0
    return nm.clip(w[7] * aim + (1.0 - w[7]) * (d - w[6] * (r - 3.0) * (10.0 - d) / 9.0), 1.0, 10.0)


def _v5_long(s, d, dt, r, w, curve):
    p = curve(dt, s, w)
    bad = nm.minimum(_forgotten(s, d, p, w), s / nm.exp(w[17] * w[18]))
    return nm.where(r > 1, _recalled(s, d, p, r, w), bad)


def _v5_step(state, dt, r, w, s_min):
    s, d = state
    same_day = s * nm.exp(w[17] * (w[18] + (r - 3.0)))
    return nm.where(dt < 1, same_day, _v5_long(s, d, dt, r, w, power_half)), _v5_difficulty(d, r, w)


def _v6_step(state, dt, r, w, s_min):
    s, d = state
    q = nm.exp(w[17] * (w[18] + (r - 3.0))) * nm.power(s, -w[19])
    same_day = s * nm.where(r >= 2, nm.maximum(q, nm.full(1.0, r)), q)
    return nm.where(dt < 1, same_day, _v5_long(s, d, dt, r, w, power_trained)), _v5_difficulty(d, r, w)


# --- SM-2 with trained weights, and Anki's scheduler ---------------------------------------------


def _sm2_begin(r, w, s_min):
    return _sm2_step((nm.full(0.0, r), nm.full(w[2], r), nm.full(0.0, r)), None, r, w, s_min)


def _sm2_step(state, dt, r, w, s_min):
    interval, ease, reps = state
    reps = nm.where(r > 1, reps + 1.0, nm.full(1.0, r))
    after = nm.where(reps == 1, nm.full(w[0], r), nm.where(reps == 2, nm.full(w[1], r), interval * ease))
    gap = (r + 1.0) - w[4]
    return after, nm.clip(ease - w[3] * (gap * gap) + w[5], 1.3, 10.0), reps


def _anki_grown(x):
    """An interval grows by a day at least, softly below."""
    y = x - 1.0
    return nm.maximum(nm.where(nm.value(y) >= 0, y, y * 0.01) + 1.0, x)  # at 0, where training starts, the slope is 1


def _anki_begin(r, w, s_min):
    return _anki_grown(nm.where(r < 4, nm.full(w[0], r), nm.full(w[1], r))), nm.clip(nm.full(w[2], r), 1.3, 5.5)


def _anki_step(state, dt, r, w, s_min):
    interval, ease = state
    late = dt - interval
    early = nm.where(
        r == 2, nm.maximum(dt * w[4], interval * w[4] / 2.0), nm.where(r == 3, nm.maximum(dt * ease, interval), nm.maximum(dt * ease, interval) * ((w[3] + 1.0) / 2.0))
    )
    due = nm.where(r == 2, interval * w[4], nm.where(r == 3, (interval + late / 2.0) * ease, (interval + late) * ease * w[3]))
    after = nm.where(r == 1, interval * w[5], nm.where(nm.value(late) < 0, early, due) * w[6])
    change = nm.where(r == 1, nm.full(-0.2, r), nm.where(r == 2, nm.full(-0.15, r), nm.where(r == 4, nm.full(0.15, r), nm.full(0.0, r))))
    return _anki_grown(after), nm.clip(ease + change, 1.3, 5.5)


# Default weights, bounds and spreads of the models.
S0_BOUND = (S_FLOOR, S0_MAX)
V5_BOUNDS = (
    S0_BOUND, S0_BOUND, S0_BOUND, S0_BOUND, (1.0, 10.0), (0.001, 4.0), (0.001, 4.0), (0.001, 0.75), (0.0, 4.5), (0.0, 0.8), (0.001, 3.5),
    (0.001, 5.0), (0.001, 0.25), (0.001, 0.9), (0.0, 4.0), (0.0, 1.0), (1.0, 6.0), (0.0, 2.0), (0.0, 2.0),
)
MODELS = {
    m.name: m
    for m in (
        Recurrence(
            "FSRSv1", (2.0, 5.0, 3.0, -0.7, -0.2, 1.0, -0.3),
            ((0.1, 10.0), (1.0, 10.0), (0.01, 10.0), (-1.0, -0.01), (-1.0, -0.01), (0.01, 10.0), (-1.0, -0.01)), _v1_begin, _v1_step, exponential,
        ),
        Recurrence(
            "FSRSv2", (1.0, 1.0, 1.0, -1.0, -1.0, 0.2, 3.0, -0.8, -0.2, 1.3, 2.6, -0.2, 0.6, 1.5),
            (
                (0.1, 10.0), (0.01, 10.0), (1.0, 10.0), (-10.0, -0.01), (-10.0, -0.01), (0.0, 1.0), (0.0, 5.0), (-2.0, -0.01), (-2.0, -0.01), (0.01, 2.0),
                (0.0, 5.0), (-2.0, -0.01), (0.01, 1.0), (0.01, 2.0),
            ), _v2_begin, _v2_step, exponential,
        ),
        Recurrence(
            "FSRSv3", (0.9605, 1.7234, 4.8527, -1.1917, -1.2956, 0.0573, 1.7352, -0.1673, 1.065, 1.8907, -0.3832, 0.5867, 1.0721),
            (
                (0.1, 10.0), (0.1, 5.0), (1.0, 10.0), (-5.0, -0.1), (-5.0, -0.1), (0.05, 0.5), (0.0, 2.0), (-0.8, -0.15), (0.01, 1.5), (0.5, 5.0),
                (-2.0, -0.01), (0.01, 0.9), (0.01, 2.0),
            ), _v3_begin, _v3_step, exponential,
        ),
        Recurrence(
            "FSRSv4", (0.4, 0.9, 2.3, 10.9, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61),
            (
                FREE, FREE, FREE, FREE, (1.0, 10.0), (0.1, 5.0), (0.1, 5.0), (0.0, 0.5), (0.0, 3.0), (0.1, 0.8), (0.01, 2.5), (0.5, 5.0), (0.01, 0.2),
                (0.01, 0.9), (0.01, 2.0), (0.0, 1.0), (1.0, 4.0),
            ), _v4_begin, _v4_step, hyperbolic,
            fits_s0=True, frozen_s0=True, later_rows_only=True,
        ),
        Recurrence(
            "FSRS-4.5", (0.4872, 1.4003, 3.7145, 13.8206, 5.1618, 1.2298, 0.8975, 0.031, 1.6474, 0.1367, 1.0461, 2.1072, 0.0793, 0.3246, 1.587, 0.2272, 2.8755),
            (
                FREE, FREE, FREE, FREE, (0.0, 10.0), (0.01, 5.0), (0.01, 5.0), (0.0, 0.8), (0.0, 6.0), (0.0, 0.8), (0.01, 5.0), (0.2, 6.0), (0.01, 0.4),
                (0.01, 0.9), (0.01, 4.0), (0.0, 1.0), (1.0, 10.0),
            ), _v4_begin, _v45_step, power_half,
            fits_s0=True, frozen_s0=True, later_rows_only=True,
            secs_start=(0.0012, 0.0826, 0.8382, 26.2146, 4.8622, 1.0311, 0.8295, 0.0379, 2.0884, 0.4704, 1.2009, 1.7196, 0.1874, 0.1593, 1.5636, 0.2358, 3.3175),
        ),
        Recurrence(
            "FSRS-5",
            (
                0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898,
                0.51655, 0.6621,
            ), V5_BOUNDS, _v5_begin, _v5_step, power_half,
            l2=(6.61, 9.52, 17.69, 27.74, 0.55, 0.28, 0.67, 0.12, 0.4, 0.18, 0.34, 0.27, 0.08, 0.14, 0.57, 0.25, 1.03, 0.27, 0.39), fits_s0=True,
        ),
        Recurrence(
            "FSRS-6",
            (
                0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425,
                0.0912, 0.0658, 0.1542,
            ), (*V5_BOUNDS, (0.0, 0.8), (0.1, 0.8)), _v5_begin, _v6_step, power_trained,
            l2=(6.43, 9.66, 17.58, 27.85, 0.57, 0.28, 0.6, 0.12, 0.39, 0.18, 0.33, 0.3, 0.09, 0.16, 0.57, 0.25, 1.03, 0.31, 0.32, 0.14, 0.27), fits_s0=True,
        ),
        Recurrence(
            "SM2-trainable", (1.0, 6.0, 2.5, 0.02, 7.0, 0.18), (S0_BOUND, S0_BOUND, (1.3, 10.0), (0.0, np.inf), (5.0, np.inf), FREE), _sm2_begin, _sm2_step,
            exponential,
        ),
        Recurrence(
            "Anki", (1.0, 4.0, 2.5, 1.3, 1.2, 0.0, 1.0), ((1.0, 9999.0), (1.0, 9999.0), (1.31, 5.0), (1.0, 5.0), (0.5, 1.3), (0.0, 1.0), (0.5, 2.0)),
            _anki_begin, _anki_step, exponential,
        ),
    )
}
