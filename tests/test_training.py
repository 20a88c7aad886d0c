"""Training against plain loops: scalar models, slopes by differences, own batches and draws."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from mnemospark.config import Settings
from mnemospark.models import counts, evaluate, lockstep, onestep, recurrent, regression, replay, training
from mnemospark.models import numeric as nm
from mnemospark.models.learner import Learner, folds
from mnemospark.operators import history
from tests.test_models import learner

SECS = Settings(algo="FSRS-6", secs=True, short=True, recency=True)


class Twister:
    """The Mersenne Twister, word by word."""

    def __init__(self, seed):
        self.state, self.at = [seed], 624
        for i in range(1, 624):
            self.state.append((1812433253 * (self.state[-1] ^ self.state[-1] >> 30) + i) & 0xFFFFFFFF)

    def word(self):
        if self.at == 624:
            for i in range(624):
                y = self.state[i] & 0x80000000 | self.state[(i + 1) % 624] & 0x7FFFFFFF
                self.state[i] = self.state[(i + 397) % 624] ^ y >> 1 ^ (0x9908B0DF if y & 1 else 0)
            self.at = 0
        y = self.state[self.at]
        self.at += 1
        y ^= y >> 11
        y ^= y << 7 & 0x9D2C5680
        y ^= y << 15 & 0xEFC60000
        return y ^ y >> 18

    def permutation(self, n):
        out = list(range(n))
        for i in range(n - 1):
            j = i + self.word() % (n - i)
            out[i], out[j] = out[j], out[i]
        return out


def entropy(p, y):
    return -max(math.log(p), -100) if y else -max(math.log(1 - p), -100)


def slope(f, w, h=1e-6):
    out = []
    for k in range(len(w)):
        up, down = list(w), list(w)
        up[k], down[k] = up[k] + h, down[k] - h
        out.append((f(up) - f(down)) / (2 * h))
    return out


def plain_training(p, rows, start, bounds, batch, pull=None):
    """rows: (history length, weight, y, what p(w, row) takes); pull: (centres, spreads)."""

    def penalty(w):
        return sum((a - c) ** 2 / s**2 for a, c, s in zip(w, *pull, strict=True)) if pull else 0.0

    def summed(w, some):
        return sum(weight * entropy(p(w, row), y) for _, weight, y, row in some)

    ranked = sorted(range(len(rows)), key=lambda k: rows[k][0])
    batches = [[rows[k] for k in ranked[i : i + batch]] for i in range(0, len(rows), batch)]
    w, m, v, draws, steps, best = list(start), [0.0] * len(start), [0.0] * len(start), Twister(2023), 0, None
    for epoch in range(6):
        loss = (summed(w, rows) + penalty(w)) / len(rows)
        if best is None or loss < best[0]:
            best = (loss, list(w))
        if epoch == 5:
            return best[1]
        for b in draws.permutation(len(batches)):
            some = batches[b]
            g = slope(lambda u, some=some: summed(u, some) + penalty(u) * len(some) / len(rows), w)
            rate = 0.04 * (1 + math.cos(math.pi * steps / (5 * len(batches)))) / 2
            steps += 1
            for k in range(len(w)):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= rate * (m[k] / (1 - 0.9**steps)) / (math.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
                w[k] = min(max(w[k], bounds[k][0]), bounds[k][1])


def rows_of(x, keep):
    """(length, weight, y, (history, interval)) of a learner's rows."""
    n, out = len(x), []
    for k, r in enumerate(x.rows.itertuples()):
        history = [(int(x.ratings[x.card[k], j]), float(x.delta[x.card[k], j])) for j in range(r.pos)]
        if keep(r):
            out.append((r.pos, 0.25 + 0.75 * (k / (n - 1)) ** 3, r.y, (history, r.delta_t)))
    return out


def held(s):
    return min(max(s, 0.0001), 36500.0)


def ten(d):
    return min(max(d, 1.0), 10.0)


def half_life(w, row):
    history, t = row
    passed, failed = sum(r > 1 for r, _ in history), sum(r == 1 for r, _ in history)
    return 0.5 ** (t / 2 ** (w[0] * math.sqrt(passed) + w[1] * math.sqrt(failed) + w[2]))


def third(w, row):
    history, t = row
    s = d = None
    for r, dt in history:
        if s is None:
            s, d = w[0] + w[1] * (r - 1), ten(w[2] + w[3] * (r - 3))
        else:
            p = 0.9 ** (dt / s)
            d = ten(w[5] * w[2] + (1 - w[5]) * (d + w[4] * (r - 3)))
            if r > 1:
                s *= 1 + math.exp(w[6]) * (11 - d) * s ** w[7] * (math.exp((1 - p) * w[8]) - 1)
            else:
                s = w[9] * d ** w[10] * s ** w[11] * math.exp((1 - p) * w[12])
        s = held(s)
    return 0.9 ** (t / s)


def recall(w, t, s):
    return (1 + (0.9 ** (-1 / w[20]) - 1) * t / s) ** -w[20]


def sixth(w, row):
    history, t = row
    s = d = None
    for r, dt in history:
        if s is None:
            s, d = w[r - 1], ten(w[4] - math.exp(w[5] * (r - 1)) + 1)
        else:
            p = recall(w, dt, s)
            if dt < 1:
                q = math.exp(w[17] * (r - 3 + w[18])) * s ** -w[19]
                after = s * (max(q, 1) if r > 1 else q)
            elif r > 1:
                factor = {2: w[15], 4: w[16]}.get(r, 1.0)
                after = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - p) * w[10]) - 1) * factor)
            else:
                after = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - p) * w[14]), s / math.exp(w[17] * w[18]))
            d = ten(w[7] * (w[4] - math.exp(3 * w[5]) + 1) + (1 - w[7]) * (d - w[6] * (r - 3) * (10 - d) / 9))
            s = after
        s = held(s)
    return recall(w, t, s)


def test_half_life_training(monkeypatch):
    monkeypatch.setattr(training, "BATCH", 25)
    x = learner(5, 14)
    got = evaluate.counted_weights(counts.MODELS["HLR"], x, np.arange(len(x)), SECS)
    free = [(-math.inf, math.inf)] * 3
    expected = plain_training(half_life, rows_of(x, lambda r: True), (2.5819, -0.8674, 2.7245), free, 25)
    assert np.abs(np.array(expected) - (2.5819, -0.8674, 2.7245)).max() > 0.05
    np.testing.assert_allclose(got, expected, atol=2e-4)


def test_third_version_training(monkeypatch):
    monkeypatch.setattr(training, "BATCH", 25)
    x, m = learner(5, 14), recurrent.MODELS["FSRSv3"]
    got = evaluate.recurrent_weights(m, x, np.arange(len(x)), SECS)
    expected = plain_training(third, rows_of(x, lambda r: r.pos <= 64), m.start, m.bounds, 25)
    np.testing.assert_allclose(got, expected, atol=5e-4)


def test_sixth_version_training_with_its_pull(monkeypatch):
    monkeypatch.setattr(training, "BATCH", 25)
    x, m = learner(4, 14), recurrent.MODELS["FSRS-6"]
    start = evaluate.with_s0(m, x, np.arange(len(x)), SECS, m.weights(True)).tolist()
    got = evaluate.recurrent_weights(m, x, np.arange(len(x)), SECS)
    bounds = [(0.0001, 100.0)] * 4 + list(m.bounds[4:])
    expected = plain_training(sixth, rows_of(x, lambda r: r.pos <= 64), start, bounds, 25, (start, m.l2))
    np.testing.assert_allclose(got, expected, atol=1e-3)


def test_weights_are_of_the_partition_alone():
    """Rows of one partition train as a log of their own: weights by time start anew in it."""
    x, m = learner(6, 12), recurrent.MODELS["FSRSv3"]
    part = x.column("partition")
    at = np.flatnonzero(part == 1)
    cards = np.isin(np.arange(len(x.ratings)), x.card[at])
    own = type(x)(x.rows.iloc[at].reset_index(drop=True), (np.cumsum(cards) - 1)[x.card[at]], x.ratings[cards], x.delta[cards])
    np.testing.assert_allclose(evaluate.recurrent_weights(m, x, at, SECS), evaluate.recurrent_weights(m, own, np.arange(len(at)), SECS), rtol=1e-12)


def test_regression_training(monkeypatch):
    monkeypatch.setattr(regression, "BATCH", 30)
    x = learner(5, 14)
    f, y = regression.features(x), x.column("y").tolist()
    got = regression.train(f, np.array(y, float))
    n, mean, spread = len(y), regression.MEAN.tolist(), regression.STD.tolist()
    rest, v, draws, steps, total = [0.0] * 34, [0.0] * 34, Twister(2023), 0, 10 * math.ceil(n / 30)

    def cost(w, some):
        out = 0.0
        for k in some:
            z = sum(a * (r * s + c) for a, r, s, c in zip(f[k], w, spread, mean, strict=True))
            out += (0.1 + 0.9 * (k / (n - 1)) ** 4) * (math.log1p(math.exp(-abs(z))) + max(z, 0) - y[k] * z)
        return out

    for _ in range(10):
        order = draws.permutation(n)
        for i in range(0, n, 30):
            g = slope(lambda w, some=order[i : i + 30]: cost(w, some), rest)
            rate = 0.1 * (1 + math.cos(math.pi * steps / total))
            steps += 1
            for k in range(34):
                v[k] = 0.85 * v[k] + 0.15 * g[k] ** 2
                rest[k] -= rate * (g[k] / (math.sqrt(v[k] / (1 - 0.85**steps)) + 1e-8) + 0.3 * rest[k])
    np.testing.assert_allclose(got, [r * s + c for r, s, c in zip(rest, spread, mean, strict=True)], atol=2e-3)


def online(x, n, start):
    """The online pass review by review, its slopes by differences of the last transition."""
    w = list(start)
    bounds = [(0.001, 100.0)] * 4 + [(-math.inf, math.inf) if k in (17, 18, 19) else b for k, b in enumerate(recurrent.MODELS["FSRS-6"].bounds[4:], 4)]
    for k, row in enumerate(x.rows.iloc[:n].itertuples()):
        if row.delta_t < 1 or not row.pos:
            continue
        s = d = None
        for j in range(row.pos):
            r, dt = int(x.ratings[x.card[k], j]), float(x.delta[x.card[k], j])
            before = (s, d)
            if s is None:
                s, d = max(0.001, w[r - 1]), ten(w[4] - math.exp(w[5] * (r - 1)) + 1)
                continue
            d = ten(w[7] * (w[4] - math.exp(3 * w[5]) + 1) + (1 - w[7]) * (d - w[6] * (r - 3) * (10 - d) / 9))
            p = recall(w, dt, s)
            if dt < 1:
                q = math.exp(w[17] * (r - 3 + w[18])) * s ** -w[19]
                s *= max(q, 1) if r >= 3 else q
            elif r > 1:
                s *= 1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - p) * w[10]) - 1) * {2: w[15], 4: w[16]}.get(r, 1.0)
            else:
                s = w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - p) * w[14])
            s = max(0.001, s)
        if s <= 0.001:
            continue
        final, y = s, row.y

        def cost(stability, u, t=row.delta_t, y=y):
            p = min(max(recall(u, t, stability), 1e-9), 1 - 1e-9)
            return -math.log(p if y else 1 - p)

        by_s = (cost(final * (1 + 1e-6), w) - cost(final * (1 - 1e-6), w)) / (2e-6 * final)
        g = [0.0] * 21
        g[20] = slope(lambda u, w=w, final=final: cost(final, [*w[:20], u[0]]), [w[20]])[0]
        if row.pos == 1:
            g[r - 1] += 100 * by_s
        else:
            s0, d0 = before
            p = recall(w, dt, s0)
            aim = lambda u: u[7] * (u[4] - math.exp(3 * u[5]) + 1) + (1 - u[7]) * (d0 - u[6] * (r - 3) * (10 - d0) / 9)  # noqa: E731, B023
            shift = d - aim(w)  # the bound of difficulty has no slope of its own

            def last(u, s0=s0, p=p, r=r, aim=aim, shift=shift):
                new = aim(u) + shift
                if r > 1:
                    return s0 * (1 + math.exp(u[8]) * (11 - new) * s0 ** -u[9] * (math.exp((1 - p) * u[10]) - 1) * {2: u[15], 4: u[16]}.get(r, 1.0))
                return u[11] * new ** -u[12] * ((s0 + 1) ** u[13] - 1) * math.exp((1 - p) * u[14])

            left = last(w)
            for i, q in enumerate(slope(last, w)):
                g[i] += by_s * q * (final / left if r == 1 and i != 13 else 1.0)
        w = [min(max(a - 1e-4 * q, low), high) for a, q, (low, high) in zip(w, g, bounds, strict=True)]
    return w


def test_online_training_of_many_learners_together():
    """Learners and folds of different lengths, each as if it were alone, review by review."""
    logs = [learner(6, 12, 1), learner(3, 20, 2), learner(1, 3, 3)]
    start = recurrent.MODELS["FSRS-6"].weights(False)
    tasks = [(x, n, start * (1 + 0.01 * k)) for k, x in enumerate(logs) for n in (0, len(x) // 2, len(x))]
    got = onestep.train(tasks)
    assert got.shape == (9, 21)
    for (x, n, first), w in zip(tasks, got, strict=True):
        np.testing.assert_allclose(w, online(x, n, first), rtol=2e-6, atol=2e-7)
    assert onestep.train([]).shape == (0, 21)


@pytest.mark.parametrize("secs", [True, False])
def test_first_stabilities_by_grid(secs):
    """The floor of each rating's cost on a fine grid, where no repair is needed."""
    x, m = learner(40, 3, 4), recurrent.MODELS["FSRS-6"]
    rows = x.rows[x.rows["i"] == 2]
    mean, start = x.column("y").mean(), m.weights(secs)
    grid, floors, seen = np.geomspace(0.0001 if secs else 0.001, 100, 40000), {}, {}
    for rating, own in rows.groupby("first_rating"):
        total = np.zeros(len(grid))
        for dt, cell in own.groupby("delta_t"):
            n, hits = len(cell), cell["y"].sum()
            share = hits / n if secs else (hits + mean) / (n + 1)
            p = np.clip((1 + (0.9 ** (-1 / start[20]) - 1) * dt / grid) ** -start[20], 1e-15, 1 - 1e-15)
            total -= n * (share * np.log(p) + (1 - share) * np.log(1 - p))
        floors[rating] = grid[(total if secs else total + np.abs(grid - start[rating - 1]) / 16).argmin()]
        seen[rating] = len(own)
    for a, b in ((1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4)):
        if floors[a] > floors[b]:
            floors[b if seen[a] > seen[b] else a] = floors[a if seen[a] > seen[b] else b]
    got = evaluate.with_s0(m, x, np.arange(len(x)), Settings(algo="FSRS-6", secs=secs, short=True), start)
    np.testing.assert_allclose(got[:4], [floors[k] for k in (1, 2, 3, 4)], rtol=2e-3)


def bare(x, some):
    """x with an interval before the first review of some cards, so that it is tested without a history."""
    reviews = reviews_of(x)
    return reviews.assign(delta_t=np.where((reviews["pos"] == 0) & reviews["card_id"].isin(some), 2.0, reviews["delta_t"])).assign(evaluable=lambda r: r["delta_t"] > 0)


def reviews_of(x):
    """All reviews of a learner, sorted by card and pos."""
    rows = [(c, p, x.ratings[c, p], x.delta[c, p]) for c in range(len(x.ratings)) for p in range(x.ratings.shape[1])]
    out = pd.DataFrame(rows, columns=["card_id", "pos", "rating", "delta_t"])
    days = out["delta_t"].astype(int)
    out = out.assign(user_id=7, partition=0, y=(out["rating"] > 1).astype(int), elapsed_days=days, rmse_bins_lapse=0, evaluable=out["delta_t"] > 0)
    out["i"] = (days > 0).groupby(out["card_id"]).cumsum() + 1
    out["first_rating"] = out.groupby("card_id")["rating"].transform("first")
    out["review_th"] = (np.arange(len(out)) * 7919) % 100003
    return out


@pytest.mark.parametrize("algo", list(recurrent.MODELS))
@pytest.mark.parametrize("secs", [True, False])
def test_trainings_together_are_trainings_apart(algo, secs):
    """One batch and several, rows without a history, and a learner without rows to train on."""
    s, m = Settings(algo=algo, secs=secs, short=True, recency=True), recurrent.MODELS[algo]
    logs = [reviews_of(learner(6, 12, 1)), bare(learner(6, 8, 2), [0, 3]), reviews_of(learner(60, 14, 3)), reviews_of(learner(2, 2, 4)), bare(learner(512, 3, 5), range(512))]
    with np.errstate(all="ignore"):
        apart = [evaluate.recurrent_weights(m, x, np.arange(len(x)), s) for x in (Learner.of(f) for f in logs)]
        every = pd.concat([f.assign(of=k) for k, f in enumerate(logs)])
        columns = [every[c].to_numpy() for c in ("of", "review_th", "rating", "delta_t", "pos", "i", "evaluable")]
        together = lockstep.recurrent_weights(m, *columns, len(logs), s)
    np.testing.assert_allclose(together, apart, rtol=2e-6, atol=1e-7)


def test_trainings_cut_into_blocks(spark, monkeypatch):
    """Blocks end between trainings, wherever batches do; a training longer than a block is one still."""
    logs = [reviews_of(learner(5, n, n)).assign(user_id=n) for n in (4, 9, 30, 6, 7)]
    s = Settings(algo="FSRSv3", secs=True, short=True)
    rows = spark.createDataFrame(pd.concat(logs)).selectExpr("*", "cast(0 as long) as fold")
    monkeypatch.setattr(replay, "training", lambda found, s: found)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["user_id"]: r["w"] for r in replay.parameters(rows, s, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [4, 6, 7, 9, 30]
    for f in logs:
        x = Learner.of(f)
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(got[f["user_id"].iloc[0]], evaluate.recurrent_weights(recurrent.MODELS["FSRSv3"], x, np.arange(len(x)), s), atol=1e-9)


@pytest.mark.parametrize("algo", [*counts.MODELS, "LogisticRegression"])
@pytest.mark.parametrize("default", [False, True])
def test_learners_in_blocks_are_learners_apart(spark, monkeypatch, algo, default):
    """One batch and several, learners cut over Arrow batches, one longer than a block and one with too few rows."""
    s = Settings(algo=algo, secs=True, short=True, recency=True, default=default)
    logs = [reviews_of(learner(*shape)).assign(user_id=k) for k, shape in enumerate([(6, 12, 1), (2, 3, 2), (60, 14, 3), (5, 9, 4), (250, 12, 5)])]
    logs = [f.assign(review_th=f["pos"] * 1000 + f["card_id"]) for f in logs]
    monkeypatch.setattr(evaluate, "BLOCK", 150)
    monkeypatch.setattr(evaluate, "PAIRS", 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = evaluate.predictions(spark.createDataFrame(pd.concat(logs)), s).toPandas().set_index(["user_id", "review_th"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = 0
    for f in logs:
        x = Learner.of(f)
        for k, (start, end) in enumerate(folds(len(x), 5) if len(x) >= evaluate.LEAST else []):
            at, test = np.arange(start), np.arange(start, end)
            with np.errstate(all="ignore"):
                if algo in counts.MODELS:
                    m = counts.MODELS[algo]
                    w = evaluate.counted_weights(m, x, at, s)
                    p, text = m.probability(m.prepare(x, test), w), {"0": w.tolist()}
                else:
                    terms = regression.features(x)
                    w = regression.MEAN if default else regression.train(terms[at], x.column("y")[at].astype(float))
                    p, text = regression.probability(terms[test], w), w.tolist()
            mine = got.loc[[(int(f["user_id"].iloc[0]), r) for r in x.column("review_th")[test]]]
            assert (mine["fold"] == k).all() and (mine["time_ms"] > 0).all()
            np.testing.assert_allclose(mine["p"], p, rtol=1e-6, atol=1e-9)
            told = json.loads(mine["parameters"].iloc[0])
            np.testing.assert_allclose(np.ravel(told["0"] if algo in counts.MODELS else told), np.ravel(text["0"] if algo in counts.MODELS else text), atol=2e-6)
            rows += len(test)
    assert rows == len(got) > 3000


def test_a_log_of_regression_rows_is_held_as_counters():
    """What a task holds of a review for the regression is a fraction of its 34 terms."""
    x = learner(40, 14)
    small = dict.fromkeys(("r", "opening"), np.int8) | dict.fromkeys(("fr", "ls"), bool) | dict.fromkeys(("sf", "nf", "sp", "np", "pn", "sn", "nn"), np.int16)
    rng = np.random.default_rng(1)
    held = [rng.integers(0, 2, len(x)).astype(small.get(c, float)) for c in history.COUNTERS]
    terms, y = regression.Terms(held), x.column("y").astype(float)
    assert sum(c.nbytes for c in held) * 5 < terms[:].nbytes
    np.testing.assert_array_equal(regression.train(terms, y), regression.train(terms[:], y))


def test_a_step_leaves_no_tape_behind():
    """Vars and their tape hold each other: a tape that is kept waits for the collector, block after block."""
    tape = []
    w = [nm.Var(np.array([x, x]), tape) for x in (0.3, 0.2)]
    told = nm.exp(-(w[0] * 1.5 + w[1]))
    p, g = lockstep.gradient_of(tape, [told], w, np.array([1.0, 0.0]), np.ones(2), np.zeros(2, int), 1)
    assert not tape and g.shape == (1, 2)
    np.testing.assert_allclose(g[0, 0], 1.5 * g[0, 1])
