"""Many trainings at once: each has its own weights, batches and optimiser, and all take a step together.

A training is a learner's log before a fold, or a partition of it. Cards replay their histories once
a step for all of their rows, longest first, so that a review costs one pass whatever follows it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..config import Settings
from . import numeric as nm
from . import counts, recurrent, regression, training
from .training import BATCH, EPOCHS, LEARNING_RATE, Permutations, cross_entropy


def places(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its group, which is a run of equal elements."""
    n = len(groups)
    heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
    return np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, length of them, one range after another."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def blocks(batches, keys: int, most: int):
    """Columns (each a list of arrays) of about most rows, cut where one of the first keys columns changes."""
    held, size = None, 0
    for b in batches:
        new = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        if not len(new[0]):
            continue
        held = held or [[] for _ in new]
        if size + len(new[0]) >= most:  # the last key may go on
            same = np.all([x == x[-1] for x in new[:keys]], 0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if size and (cut or any(x[-1][-1] != y[0] for x, y in zip(held[:keys], new[:keys], strict=True))):
                yield [[*x, y[:cut]] for x, y in zip(held, new, strict=True)]
                held, size = [[] for _ in new], 0
                new = [x[cut:] for x in new]
        for x, y in zip(held, new, strict=True):
            x.append(y)
        size += len(new[0])
    if size:
        yield held


@dataclass
class Rows:
    """Rows to train on, sorted by training and history length; weights are start (trainings, weights).

    slopes(rows, w) gives probabilities of some rows and, for slopes of the loss by row, the
    gradient (trainings, weights); told(rows, w) the probabilities alone.
    """

    of: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    clipped: Callable
    told: Callable
    slopes: Callable
    frozen: np.ndarray
    l2: np.ndarray


def optimise(x: Rows) -> np.ndarray:
    """training.train for each training: the weights of least loss seen at the epochs' starts and at the end."""
    count, size = x.start.shape
    best, least, w = x.start.copy(), np.full(count, np.inf), x.start.copy()
    n = np.bincount(x.of, minlength=count)
    batch, first = places(x.of) // BATCH, np.append(0, np.cumsum(n))[:-1]
    batches = -(-n // BATCH)
    steps, taken, rate = batches * EPOCHS, np.zeros(count, np.int64), np.full(count, LEARNING_RATE)
    m, v, whole = np.zeros((count, size)), np.zeros((count, size)), np.arange(len(x.of))
    single = bool(len(x.of)) and int(batches.max()) == 1
    draws = {} if single else {b: Permutations() for b in np.flatnonzero(batches > 1)}
    for epoch in range(EPOCHS + 1):
        if single and epoch < EPOCHS:
            p, gradient = x.slopes(whole, w)
        else:
            p = x.told(whole, w)
        now = np.bincount(x.of, x.weight * cross_entropy(p, x.y), count)
        now = (now + (np.square(w - x.start) * x.l2).sum(1)) / np.maximum(n, 1)
        better = (n > 0) & (now < least)
        best[better], least[better] = w[better], now[better]
        if epoch == EPOCHS:
            break
        order = {b: d.draw(int(batches[b])) for b, d in draws.items()}
        for k in range(int(batches.max(initial=0))):
            active = np.flatnonzero(batches > k)
            if single:
                share = (n[active] > 0).astype(float)[:, None]
            else:
                # The k-th drawn batch of each training.
                drawn = np.array([order[b][k] if b in order else 0 for b in active])
                begin = first[active] + drawn * BATCH
                length = np.minimum(n[active] - drawn * BATCH, BATCH)
                rows = ranges(begin, length)
                _, gradient = x.slopes(rows, w)
                share = (length / n[active])[:, None]
            g = gradient[active] + 2 * (w[active] - x.start[active]) * x.l2 * share
            g = np.where(x.frozen, 0.0, g)
            taken[active] += 1
            t = taken[active][:, None].astype(float)
            m[active] = 0.9 * m[active] + (1 - 0.9) * g
            v[active] = 0.999 * v[active] + (1 - 0.999) * g * g
            direction = (m[active] / (1 - 0.9**t)) / (np.sqrt(v[active] / (1 - 0.999**t)) + 1e-8)
            w[active] = x.clipped(w[active] - rate[active][:, None] * direction)
            done, all_ = taken[active], steps[active]
            rate[active] = rate[active] * (1 + np.cos(math.pi * done / all_)) / (1 + np.cos(math.pi * (done - 1) / all_))
    return best


def gradient_of(tape: list, told: list, w: list, y: np.ndarray, weight: np.ndarray, of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, gradient by training) of told, Vars in the order of y; w are Vars by row, whose trainings are of."""
    p = np.concatenate([x.v for x in told])
    slope = weight * (p - y) / np.maximum(p * (1 - p), 1e-12)
    for strict in (False, True):
        for x in tape:
            x.g, x.own = None, False
        start = 0
        for x in told:
            x.g = slope[start : start + len(x.v)]
            start += len(x.v)
        nm.walk_back(tape, strict)
        out = np.stack([np.bincount(of, x.g, count) if x.g is not None else np.zeros(count) for x in w], 1)
        if np.isfinite(out).all():
            break
    tape.clear()  # its Vars hold it: emptied, all go at once
    return p, out


class Histories:
    """Reviews of many trainings sorted by training, card and pos, and the rows to train on."""

    def __init__(self, of, pos, rating, delta, at):
        self.of, self.pos, self.rating, self.delta, self.at = of, pos, rating, delta, at

    def plan(self, rows: np.ndarray) -> tuple:
        """What a pass over some rows needs: cards longest first, and by step their reviews and what is asked."""
        at = self.at[rows]
        pos = self.pos[at].astype(np.int64)
        heads, card = np.unique(at - pos, return_inverse=True)
        longest = np.zeros(len(heads), np.int64)
        np.maximum.at(longest, card, pos)
        order = np.argsort(-longest, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        heads, card, longest = heads[order], place[card], longest[order]
        by = np.argsort(pos, kind="stable")
        most = int(longest[0]) if len(longest) else 0
        ends = np.searchsorted(pos[by], np.arange(most + 2))
        alive = np.searchsorted(-longest, -np.arange(most), "left")
        each = []
        for k in range(most):
            here = heads[: alive[k]] + k
            asked = by[ends[k + 1] : ends[k + 2] if k + 2 < len(ends) else len(by)]
            each.append((int(alive[k]), self.rating[here].astype(float), self.delta[here], card[asked], self.delta[at[asked]]))
        return heads, each, by, int(ends[1]) if most else len(by)

    def run(self, m: recurrent.Recurrence, plan: tuple, w: list, s_min: float) -> list:
        """Probabilities by step for the rows with a history."""
        told, state = [], None
        for alive, r, dt, asked, t in plan[1]:
            here = nm.Taken(w, slice(0, alive))
            if state is None:
                after = m.begin(r, here, s_min)
            else:
                after = m.step(tuple(nm.take(x, slice(0, alive)) for x in state), dt, r, here, s_min)
            state = (nm.clip(after[0], s_min, recurrent.S_MAX), *after[1:])
            if len(asked):
                told.append(m.curve(t, nm.take(state[0], asked), nm.Taken(w, asked)))
        return told


def recurrent_rows(m: recurrent.Recurrence, h: Histories, y, weight, start: np.ndarray, s_min: float) -> Rows:
    """Rows of a recurrent model; those without a history have probability 0 and no slope."""
    of = h.of[h.at]
    known: dict = {}

    def planned(rows):
        if len(rows) != len(of):
            return h.plan(rows)
        if not known:
            known[0] = h.plan(rows)
        return known[0]

    def told(rows, w):
        plan = planned(rows)
        mine = w[h.of[plan[0]]]
        p = np.zeros(len(rows))
        found = h.run(m, plan, [mine[:, k] for k in range(mine.shape[1])], s_min)
        p[plan[2][plan[3] :]] = np.concatenate(found) if found else 0.0
        return p

    def slopes(rows, w):
        plan, tape = planned(rows), []
        mine = h.of[plan[0]]
        by_card = w[mine]
        leaves = [nm.Var(np.ascontiguousarray(by_card[:, k]), tape) for k in range(w.shape[1])]
        found = h.run(m, plan, leaves, s_min)
        p = np.zeros(len(rows))
        if not found:
            return p, np.zeros(w.shape)
        asked = plan[2][plan[3] :]
        p[asked], g = gradient_of(tape, found, leaves, y[rows][asked], weight[rows][asked], mine, len(w))
        return p, g

    frozen = np.arange(start.shape[1]) < (4 if m.frozen_s0 else 0)
    l2 = 1 / np.square(m.l2) if m.l2 else np.zeros(start.shape[1])
    return Rows(of, y, weight, start, functools.partial(m.clipped, s_min=s_min), told, slopes, frozen, l2)


def golden(f: Callable[[np.ndarray], np.ndarray], n: int, low: float, high: float, rounds: int = 200, near: float = 1e-11) -> np.ndarray:
    """training.golden of n functions at once; f takes and gives arrays of n."""
    ratio = (math.sqrt(5) - 1) / 2
    low, high = np.full(n, float(low)), np.full(n, float(high))
    c, d = high - ratio * (high - low), low + ratio * (high - low)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        open_ = np.abs(high - low) >= near
        if not open_.any():
            break
        left, right = open_ & (fc < fd), open_ & ~(fc < fd)
        high, low = np.where(left, d, high), np.where(right, c, low)
        c, d, fc, fd = np.where(right, d, c), np.where(left, c, d), np.where(right, fd, fc), np.where(left, fc, fd)
        x = np.where(left, high - ratio * (high - low), low + ratio * (high - low))
        c, d = np.where(left, x, c), np.where(right, x, d)
        fx = f(x)
        fc, fd = np.where(left, fx, fc), np.where(right, fx, fd)
    return (low + high) / 2


def first_stabilities(m: recurrent.Recurrence, of, first_rating, delta, i, y, count: int, start: np.ndarray, s: Settings) -> np.ndarray:
    """training.initial_stabilities of each training (count, 4), of rows whose trainings are of."""
    mean = np.bincount(of, y, count) / np.maximum(np.bincount(of, minlength=count), 1)
    own = i == 2
    key, dt, hit = of[own] * 4 + first_rating[own] - 1, delta[own], y[own]
    order = np.lexsort((dt, key))
    key, dt, hit = key[order], dt[order], hit[order]
    cells = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (dt[1:] != dt[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(cells, len(key))).astype(float)
    hits = np.add.reduceat(hit, cells) if len(cells) else np.zeros(0)
    dt, cell_key = dt[cells], key[cells]
    problems, of_cell = np.unique(cell_key, return_inverse=True)
    recall = hits / n if s.secs else (hits + mean[cell_key // 4]) / (n + 1)
    default = start[problems % 4]

    def costs(x: np.ndarray) -> np.ndarray:
        p = np.clip(nm.value(m.curve(dt, x[of_cell], start)), 1e-15, 1 - 1e-15)
        total = -np.bincount(of_cell, (recall * np.log(p) + (1 - recall) * np.log(1 - p)) * n, len(problems))
        return total if s.secs else total + np.abs(x - default) / 16

    found = golden(costs, len(problems), s.s_min, recurrent.S0_MAX).tolist() if len(problems) else []
    seen = np.bincount(of_cell, n, len(problems)).tolist()
    fitted: list[dict] = [{} for _ in range(count)]
    counted: list[dict] = [{} for _ in range(count)]
    for problem, value, number in zip(problems.tolist(), found, seen, strict=True):
        fitted[problem // 4][problem % 4 + 1], counted[problem // 4][problem % 4 + 1] = value, number
    return np.array([training.completed(a, b, start[:4], s.s_min, recurrent.S0_MAX) for a, b in zip(fitted, counted, strict=True)]).reshape(count, 4)


def recency(place: np.ndarray, n: np.ndarray, on: bool) -> np.ndarray:
    x = np.where(n > 1, place / np.maximum(n - 1.0, 1.0), 0.0)
    return 0.25 + 0.75 * x**3 if on else np.ones(len(place))


def recurrent_weights(m: recurrent.Recurrence, of, review_th, rating, delta, pos, i, evaluable, count: int, s: Settings) -> np.ndarray:
    """Weights (count, weights) of trainings numbered by of, from reviews sorted by training, card and pos.

    A training whose batch mixes rows with and without a history has no slope there, so its weights
    are undefined from the first epoch on: the first ones stay the best, and it is not run.
    """
    begin = m.weights(s.secs)
    start = np.tile(begin, (count, 1))
    at = np.flatnonzero(evaluable)
    at = at[np.lexsort((review_th[at], of[at]))]
    mine, y = of[at], (rating[at] > 1).astype(float)
    if m.fits_s0:
        start[:, :4] = first_stabilities(m, mine, rating[at - pos[at]].astype(np.int64), delta[at], i[at], y, count, begin, s)
        if s.only_s0 and m.l2:
            return start
    n = np.bincount(mine, minlength=count)
    weight = recency(places(mine), n[mine], s.recency)
    keep = pos[at] <= s.max_seq_len
    if m.later_rows_only:
        keep &= i[at] > 2
    bare = np.bincount(mine[keep & (pos[at] == 0)], minlength=count)
    stays = (bare > 0) & ((bare % BATCH > 0) | (m.curve is recurrent.power_trained))
    out, many = start.copy(), np.bincount(mine[keep], minlength=count) > BATCH
    for long in (False, True):
        chosen = ~stays & (many == long)
        part = keep & chosen[mine]
        if not part.any():
            continue
        rows = np.flatnonzero(part)
        rows = rows[np.lexsort((pos[at[rows]], mine[rows]))]
        h = Histories(of, pos, rating, delta, at[rows])
        out[chosen] = optimise(recurrent_rows(m, h, y[rows], weight[rows], start, s.s_min))[chosen]
    return out


def counted_weights(m: counts.Counted, f: tuple, at, of, pos, y, weight, count: int, s: Settings) -> np.ndarray:
    """Weights (count, weights) of a model on counts: rows at of the features f, in order, train the training of."""
    start = np.tile(m.weights(s.short), (count, 1))
    keep = np.ones(len(at), bool) if m.long_rows else pos <= s.max_seq_len + m.slack
    out, many = start.copy(), np.bincount(of[keep], minlength=count) > BATCH
    for long in (False, True):
        chosen = np.flatnonzero(keep & (many[of] == long))
        if not len(chosen):
            continue
        chosen = chosen[np.lexsort((pos[chosen], of[chosen]))]
        out[many == long] = optimise(counted_rows(m, f, at[chosen], of[chosen], y[chosen], weight[chosen], start))[many == long]
    return out


def counted_rows(m: counts.Counted, f: tuple, at, of, y, weight, start: np.ndarray) -> Rows:
    mine = counts.apart(counts.some(f, at), of)

    def told(rows, w):
        return m.probability(counts.some(mine, rows), w[of[rows]].T)

    def slopes(rows, w):
        tape, by_row = [], w[of[rows]]
        leaves = [nm.Var(np.ascontiguousarray(by_row[:, k]), tape) for k in range(w.shape[1])]
        return gradient_of(tape, [m.probability(counts.some(mine, rows), leaves)], leaves, y[rows], weight[rows], of[rows], len(w))

    size = start.shape[1]
    return Rows(of, y, weight, start, lambda w: np.clip(w, m.low, m.high), told, slopes, np.zeros(size, bool), np.zeros(size))


def regression_weights(x: regression.Terms, begin: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """regression.train of each training, whose rows are the n from begin on."""
    out = np.tile(regression.MEAN, (len(n), 1))
    for k in np.flatnonzero(n > regression.BATCH):
        out[k] = regression.train(x.part(begin[k], n[k]), y[begin[k] : begin[k] + n[k]])
    short = np.flatnonzero((n > 0) & (n <= regression.BATCH))
    if not len(short):
        return out
    n = n[short]
    of, at, first = np.repeat(np.arange(len(n)), n), ranges(begin[short], n), np.cumsum(n) - n
    terms, y = x[at], y[at]
    weight = 0.1 + 0.9 * (places(of) / np.maximum(n - 1.0, 1.0)[of]) ** 4
    rest, adam = np.zeros((len(n), terms.shape[1])), training.Adam((len(n), terms.shape[1]), regression.BETAS)
    for k in range(regression.EPOCHS):  # one batch an epoch, whatever its order
        p = 1 / (1 + np.exp(-np.einsum("ij,ij->i", terms, (rest * regression.STD + regression.MEAN)[of])))
        g = np.add.reduceat(terms * (weight * (p - y))[:, None], first) * regression.STD
        rest = rest - regression.rate(k, regression.EPOCHS) * (adam.direction(g) + regression.DECAY * rest)
    out[short] = rest * regression.STD + regression.MEAN
    return out
