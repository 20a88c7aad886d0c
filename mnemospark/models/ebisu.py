"""Bayesian half-life model: a Beta prior on recall at a time, updated by each review.

Models are arrays (n, 3) of (alpha, beta, time): all cards of a batch take their k-th review
together, and the searches for a bracket and a root go on for those that have not ended.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed value: the prior (alpha, beta, time).
PRIOR = (0.2, 0.2, 512.0)
Function = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Coefficients of Stirling's series: Bernoulli numbers B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156, -3617 / 122400)
#: From here on the series is exact to the last digits.
LARGE = 10


def gammaln(x) -> np.ndarray:
    """ln of the gamma function of positive x: Stirling's series, reached by the recurrence."""
    x = np.asarray(x, float)
    low = x < LARGE
    steps = np.where(low, x, 1.0)
    product = steps.copy()
    for k in range(1, LARGE):
        product = product * (steps + k)
    z = np.where(low, x + LARGE, x)
    inverse = 1 / (z * z)
    series = np.zeros_like(z)
    for c in reversed(STIRLING):
        series = series * inverse + c
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series / z - np.where(low, np.log(product), 0.0)


def betaln(a, b) -> np.ndarray:
    return gammaln(a) + gammaln(b) - gammaln(a + b)


def recall(model: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, t0 = np.asarray(model, float).T
    return np.exp(betaln(a + t / t0, b) - betaln(a, b))


def bracket(f: Function, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, found): bounds where each f changes sign, by halving and doubling.

    f(rows, x) evaluates the functions numbered rows at x.
    """
    every = np.arange(len(start))
    low, high, found = start / 2, start * 2, np.zeros(len(start), bool)
    f_low, f_high = f(every, low), f(every, high)
    live = every
    for _ in range(300):
        live = live[np.isfinite(f_low[live]) & np.isfinite(f_high[live])]
        a, b = f_low[live], f_high[live]
        done = (a == 0) | (b == 0) | ((a > 0) != (b > 0))
        found[live[done]] = True
        live, a, b = live[~done], a[~done], b[~done]
        if not len(live):
            break
        right = (a > 0) == (a > b)  # falls towards zero to the right
        up, down = live[right], live[~right]
        low[up], f_low[up], high[up] = high[up], f_high[up], high[up] * 2
        f_high[up] = f(up, high[up])
        high[down], f_high[down], low[down] = low[down], f_low[down], low[down] / 2
        f_low[down] = f(down, low[down])
    return low, high, found


def root(f: Function, low: np.ndarray, high: np.ndarray, near: float = 2e-12, rounds: int = 100) -> np.ndarray:
    """Brent's method: inverse quadratic or secant steps kept inside a shrinking bracket."""
    every = np.arange(len(low))
    a, b = low.copy(), high.copy()
    fa, fb = f(every, a), f(every, b)

    def nearer_last(i: np.ndarray) -> None:
        i = i[np.abs(fa[i]) < np.abs(fb[i])]
        a[i], b[i] = b[i], a[i]
        fa[i], fb[i] = fb[i], fa[i]

    nearer_last(every)
    c, fc, d, bisected = a.copy(), fa.copy(), a.copy(), np.ones(len(a), bool)
    live = every
    for _ in range(rounds):
        live = live[(fb[live] != 0) & (np.abs(b[live] - a[live]) >= near)]
        if not len(live):
            break
        x, y, z, fx, fy, fz = (v[live] for v in (a, b, c, fa, fb, fc))
        three = (fx != fz) & (fy != fz)
        quadratic = x * fy * fz / ((fx - fy) * (fx - fz)) + y * fx * fz / ((fy - fx) * (fy - fz)) + z * fx * fy / ((fz - fx) * (fz - fy))
        s = np.where(three, quadratic, y - fy * (y - x) / (fy - fx))
        before = np.where(bisected[live], np.abs(y - z), np.abs(z - d[live]))
        edge = (3 * x + y) / 4
        inside = (np.minimum(edge, y) < s) & (s < np.maximum(edge, y))
        halve = ~inside | (np.abs(s - y) >= before / 2) | (before < near)
        s = np.where(halve, (x + y) / 2, s)
        bisected[live] = halve
        fs = f(live, s)
        d[live], c[live], fc[live] = z, y, fy
        other = (fx > 0) != (fs > 0)
        b[live], fb[live] = np.where(other, s, y), np.where(other, fs, fy)
        a[live], fa[live] = np.where(other, x, s), np.where(other, fx, fs)
        nearer_last(live)
    return b


def update(prior: np.ndarray, passed: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The posteriors, told at the time where mean recall is a half; the prior where there is none."""
    a, b, t0 = prior.T
    step = t / t0

    def weight(rows: np.ndarray, shift: np.ndarray) -> np.ndarray:
        one = betaln(a[rows] + step[rows] + shift, b[rows])
        other = betaln(a[rows] + shift, b[rows])
        gap = -np.expm1(one - other)  # B(a + shift) - B(a + step + shift), as a share of the first
        return np.where(passed[rows], one, other + np.log(gap))

    with np.errstate(all="ignore"):
        every = np.arange(len(t))
        whole = weight(every, np.zeros(len(t)))

        def moment(n: int, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
            """The n-th moment of recall at x times the review's time, given its result."""
            return np.exp(weight(rows, n * step[rows] * x) - whole[rows])

        low, high, found = bracket(lambda rows, x: moment(1, rows, x) - 0.5, 1 / step)
        rows = np.flatnonzero(found)
        x = root(lambda i, v: moment(1, rows[i], v) - 0.5, low[rows], high[rows])
        mean, second = moment(1, rows, x), moment(2, rows, x)
        spread = second - mean * mean
        scale = mean * (1 - mean) / spread - 1
        new = np.stack([mean * scale, (1 - mean) * scale, x * t[rows]], 1)
        good = (spread > 0) & (new[:, 0] > 0) & (new[:, 1] > 0) & np.isfinite(new).all(1)
    out = prior.copy()
    out[rows[good]] = new[good]
    return out


def after(intervals: np.ndarray, ratings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(cards, reviews + 1, 3): the model before each review of each card, and after its last."""
    cards, n = ratings.shape
    out = np.empty((cards, n + 1, 3))
    out[:, 0] = PRIOR
    for k in range(n):
        out[:, k + 1] = out[:, k]
        there = np.flatnonzero(lengths > k)
        out[there, k + 1] = update(out[there, k], ratings[there, k] > 1, np.maximum(intervals[there, k], 0.001))
    return out
