"""Logistic regression on a learner's reviews."""

from __future__ import annotations

import math

import numpy as np

from .learner import Learner
from .training import SEED, Adam, Permutations

# Centres and spreads of the coefficients.
MEAN = np.array([
    -0.9012, -0.6941, -0.6258, -0.4678, 0.3926, 0.1316, 0.3508, -0.3259, -0.2125, -0.1402, 1.2775, 0.0669, 0.3914, 0.5828, 0.9292, 1.1583, 1.4103, 0.9388,
    0.9164, 0.9797, -0.6411, 0.4951, 0.1038, -0.1564, 0.4332, 0.3287, 0.3429, 0.4068, -0.1779, -0.0585, -0.1062, -0.3521, -0.1613, -0.1758,
])
STD = np.array([
    0.2869, 0.2811, 0.2910, 0.2166, 0.1740, 0.1612, 0.1428, 0.1352, 0.1284, 0.0331, 0.4013, 0.2065, 0.2022, 0.1670, 0.2454, 0.2954, 0.2896, 0.3473, 0.5685,
    0.2795, 0.1298, 0.0467, 0.1200, 0.1317, 0.0785, 0.1190, 0.0854, 0.1634, 0.1892, 0.1052, 0.0750, 0.1913, 0.1372, 0.0783,
])
RATE, DECAY, BETAS, EPOCHS, BATCH = 0.2, 0.3, (0.0, 0.85), 10, 2048


def tr(x):
    return (np.log(np.asarray(x, float) + 1e-5) + 1.3) / 5.0


def features(x: Learner) -> np.ndarray:
    """(rows, 34): ten terms times the interval's transform, then 24 plain ones."""
    n = len(x)
    out = np.zeros((n, 34))
    if not n:
        return out
    order = np.lexsort((x.column("review_th"), x.card))
    card, pos = x.card[order], x.column("pos")[order]
    dt, days = x.column("delta_t")[order], np.maximum(x.column("elapsed_days")[order], 0)
    first = np.append(True, card[1:] != card[:-1])
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    r = np.where(pos > 0, x.ratings[card, np.maximum(pos - 1, 0)], 0)
    opening = r[heads][group]
    pe, pd = np.where(first, 0.0, np.append(0.0, dt[:-1])), np.where(first, 0, np.append(0, days[:-1]))
    sd, ls = (pd == 0).astype(float), (days == 0).astype(float)
    fail, success, later = (r == 1).astype(float), (r > 1).astype(float), (~first).astype(float)

    def total(v: np.ndarray) -> np.ndarray:
        c = np.cumsum(v)
        return c - (c[heads] - v[heads])[group]

    sf, nf = total(sd * later * fail), total((1 - sd) * later * fail)
    sp, np_ = total(sd * later * success), total((1 - sd) * later * success)
    passes, same, other, t = total(success), total(sd), total(1 - sd), total(pe)
    marks = np.where(first | (r <= 1), t, 0.0)
    clock = t - np.concatenate([np.maximum.accumulate(part) for part in np.split(marks, heads[1:])])
    out[order] = terms(r, opening, first, ls, sf, nf, sp, np_, passes, same, other, pe, clock, t, dt)
    return out


def terms(r, opening, fr, ls, sf, nf, sp, np_, pn, sn, nn, pe, clock, t, delta_t) -> np.ndarray:
    """(rows, 34) out of the counters that history.logreg_counters names."""
    o2, o3, o4, f2, f3, f4 = (c == k for c in (r, opening) for k in (2, 3, 4))
    fr, ls, g, d = np.asarray(fr, bool), np.asarray(ls, float), opening > 1, tr(delta_t)
    lsf, lnf, lnp, lsp, lsn, lnn = (np.log1p(np.asarray(c, float)) for c in (sf, nf, np_, sp, sn, nn))
    np_later, nf_later = lnp * (1 - ls), lnf * (1 - ls)
    out = np.empty((len(r), 34))
    for k, c in enumerate((1.0, o2, o3, o4, o2 & fr, (r > 2) & fr, lsf, np_later, nf_later, lsp)):
        np.multiply(c, d, out=out[:, k])
    plain = [
        1.0, o2, o3, o4, f2, f3, f4, f2 & fr, f3 & fr, f4 & fr, lsf, np_later, tr(pe), lnf, lnp, lsp * ls, pn > 0, tr(clock), ls, tr(t),
        g * lsf, g * lnf, g * lsn, g * lnn,
    ]
    for k, c in enumerate(plain, 10):
        out[:, k] = c
    return out


class Terms:
    """Terms of a log's rows, made out of its counters for the rows that are asked for."""

    def __init__(self, counters: list[np.ndarray]):
        self.counters = counters

    def __len__(self) -> int:
        return len(self.counters[0])

    def __getitem__(self, rows) -> np.ndarray:
        return terms(*(c[rows] for c in self.counters))

    def part(self, begin: int, n: int) -> Terms:
        return Terms([c[begin : begin + n] for c in self.counters])


def probability(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ coefficients)))


def rate(k: int, steps: int) -> float:
    return RATE * 0.5 * (1 + math.cos(math.pi * k / steps))


def train(x: np.ndarray | Terms, y: np.ndarray) -> np.ndarray:
    """AdamW on residual coefficients, later reviews weighing more, a cosine rate."""
    n = len(x)
    if not n:
        return MEAN
    at = np.arange(n) / (n - 1.0) if n > 1 else np.zeros(n)
    weight = 0.1 + 0.9 * at**4
    rest, adam, draws = np.zeros(len(MEAN)), Adam(len(MEAN), BETAS), Permutations(SEED)
    steps, k = EPOCHS * -(-n // BATCH), 0
    for _ in range(EPOCHS):
        order = draws.draw(n)
        for start in range(0, n, BATCH):
            b = order[start : start + BATCH]
            p = probability(x[b], rest * STD + MEAN)
            g = ((weight[b] * (p - y[b])) @ x[b]) * STD
            rest = rest - rate(k, steps) * (adam.direction(g) + DECAY * rest)
            k += 1
    return rest * STD + MEAN
