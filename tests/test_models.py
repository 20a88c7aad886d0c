"""Known values, finite differences and small loops for the models; no Spark."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mnemospark.config import Settings
from mnemospark.models import counts, ebisu, evaluate, recurrent, regression, training
from mnemospark.models import numeric as nm
from mnemospark.models.learner import Learner, folds

DT, RATINGS = [0.0, 0.3, 9.0, 1.5, 30.0, 4.0], [3, 1, 3, 4, 2, 3]


def learner(n_cards: int = 6, n: int = 12, seed: int = 1) -> Learner:
    rng = np.random.default_rng(seed)
    rows = []
    th = 0
    for card in range(n_cards):
        i, lapses, first = 0, 0, None
        for pos in range(n):
            r = int(rng.integers(1, 5))
            dt = 0.0 if pos == 0 else float(rng.choice([0.4, 1, 3, 8, 20]))
            i += dt >= 1
            first = first or r
            th += 1
            rows.append((7, card, th * 37 % 1009, r, int(r > 1), dt, int(dt), pos, i + 1, lapses, first, dt > 0, card % 2))
            lapses += r == 1
    return Learner.of(pd.DataFrame(rows, columns=evaluate.NEEDED))


def test_permutations_known_vectors():
    # Permutations of 8 that the seed has to give.
    draws = training.Permutations()
    assert [draws.draw(8).tolist() for _ in range(3)] == [[7, 3, 2, 0, 5, 1, 4, 6], [4, 7, 6, 0, 3, 1, 5, 2], [7, 3, 0, 6, 2, 4, 1, 5]]


def test_folds_known_sizes():
    parts = folds(12744, 5)
    assert parts[0] == (12744 - 5 * 2124, 12744 - 4 * 2124) and parts[-1][1] == 12744


def beta_mean(model, power):
    """The mean of p ** power under the model's Beta density, by a sum over logits."""
    a, b, _ = model
    u = np.linspace(-400, 400, 800_001)
    log_p, log_q = -np.logaddexp(0, -u), -np.logaddexp(0, u)
    weight = a * log_p + b * log_q
    weight = np.exp(weight - weight.max())
    return float((weight * np.exp(power * log_p)).sum() / weight.sum())


@pytest.mark.parametrize(("model", "t"), [(ebisu.PRIOR, 3.0), (ebisu.PRIOR, 700.0), ((2.5, 1.7, 20.0), 6.0), ((4.0, 4.0, 5.0), 30.0)])
def test_ebisu_by_numerical_integration(model, t):
    """A review at t multiplies the density by p ** (t / t0), or by what that leaves to 1; the new
    model has that posterior's first two moments of recall at its own time, where the mean is 0.5."""
    one = np.array([model])
    assert ebisu.recall(one, np.array([t]))[0] == pytest.approx(beta_mean(model, t / model[2]), rel=1e-5)
    step = t / model[2]
    for passed in (True, False):
        a, b, after = ebisu.update(one, np.array([passed]), np.array([t]))[0]

        def moment(x, passed=passed):
            if passed:
                return beta_mean(model, step + x) / beta_mean(model, step)
            return (beta_mean(model, x) - beta_mean(model, step + x)) / (1 - beta_mean(model, step))

        first, second = moment(after / model[2]), moment(2 * after / model[2])
        assert first == pytest.approx(0.5, abs=1e-4) and a / (a + b) == pytest.approx(first, abs=1e-4)
        assert a * (a + 1) / ((a + b) * (a + b + 1)) == pytest.approx(second, rel=1e-3)


def test_gammaln():
    x = np.concatenate([np.geomspace(1e-6, 1e8, 4000), np.arange(1, 60) / 2])
    np.testing.assert_allclose(ebisu.gammaln(x), [math.lgamma(v) for v in x], rtol=3e-14, atol=3e-14)


def test_roots_together_are_roots_apart():
    """Functions that end at different rounds, some without a change of sign."""
    at = np.array([0.3, 2.0, 0.02, 700.0, 5.0])

    def f(rows, x):
        return np.where(rows == 4, 1.0 + 0 * x, np.exp(-np.log(2) * x / at[rows]) - 0.5)

    low, high, found = ebisu.bracket(f, np.ones(5))
    assert found.tolist() == [True] * 4 + [False]
    x = ebisu.root(lambda i, v: f(i, v), low[:4], high[:4])
    np.testing.assert_allclose(x, at[:4], rtol=1e-9, atol=3e-12)


def test_ebisu_prior_and_order():
    prior = np.array([ebisu.PRIOR])
    assert ebisu.recall(prior, np.array([512.0]))[0] == pytest.approx(0.5)
    cards = [[(1.0, 3), (4.0, 1), (2.0, 4)], [(30.0, 1)], [(0.5, 2), (3.0, 2)]]
    intervals, ratings = np.zeros((3, 3)), np.zeros((3, 3), int)
    for c, history in enumerate(cards):
        for k, (t, r) in enumerate(history):
            intervals[c, k], ratings[c, k] = t, r
    got = ebisu.after(intervals, ratings, np.array([3, 1, 2]))
    for c, history in enumerate(cards):
        model = prior
        for k, (t, r) in enumerate(history):
            np.testing.assert_allclose(got[c, k], model[0], rtol=1e-9)
            model = ebisu.update(model, np.array([r > 1]), np.array([t]))
        np.testing.assert_allclose(got[c, len(history)], model[0], rtol=1e-9)


def difference(f, w, h=1e-6):
    out = []
    for k in range(len(w)):
        up, down = w.copy(), w.copy()
        up[k] += h
        down[k] -= h
        out.append((f(up) - f(down)) / (2 * h))
    return np.array(out)


@pytest.mark.parametrize("name", list(recurrent.MODELS))
def test_recurrent_gradients(name):
    m = recurrent.MODELS[name]
    w = m.weights(False) * 1.01 + 0.003
    ratings, delta, lengths, t = np.array([RATINGS]), np.array([DT]), np.array([len(DT)]), np.array([7.0])
    got = recurrent.predict(m, ratings, delta, lengths, t, nm.Dual.parameters(w), 0.0001)
    expected = difference(lambda v: recurrent.predict(m, ratings, delta, lengths, t, v, 0.0001)[0], w)
    np.testing.assert_allclose(got.g[0], expected, rtol=3e-4, atol=1e-6)
    assert got.v[0] == pytest.approx(recurrent.predict(m, ratings, delta, lengths, t, w, 0.0001)[0])


@pytest.mark.parametrize("name", list(counts.MODELS))
def test_counting_gradients(name):
    m, x = counts.MODELS[name], learner()
    f = m.prepare(x, np.arange(len(x)))
    w = np.clip(m.weights(True) * 1.01, m.low, m.high)
    got = m.probability(f, nm.Dual.parameters(w))
    row = 17
    expected = difference(lambda v: m.probability(f, v)[row], w)
    np.testing.assert_allclose(got.g[row], expected, rtol=3e-4, atol=1e-6)


def test_empty_history_gives_zero():
    for m in recurrent.MODELS.values():
        assert recurrent.predict(m, np.zeros((1, 0), int), np.zeros((1, 0)), np.array([0]), np.array([3.0]), m.weights(False), 0.01)[0] == 0.0


@pytest.mark.parametrize("name", ["FSRSv3", "FSRSv4", "FSRS-6", "HLR", "Anki"])
def test_training_never_ends_above_its_start(name):
    x, s = learner(8, 14), Settings(algo=name, short=True, secs=True)
    at = np.arange(len(x))
    if name in recurrent.MODELS:
        m = recurrent.MODELS[name]
        start = evaluate.with_s0(m, x, at, s, m.weights(True)) if m.fits_s0 else m.weights(True)
        keep = at[x.column("i") > 2] if m.later_rows_only else at
        objective = evaluate.Recurrent(m, x, keep, np.ones(len(keep)), start, s.s_min)
    else:
        m = counts.MODELS[name]
        objective = evaluate.Counting(m, x, at, np.ones(len(at)), m.weights(True))
    w = training.train(objective)
    assert training.loss(objective, w) <= training.loss(objective, objective.start)


def test_nan_losses_keep_the_start():
    class Broken:
        n, start, lengths, y, weight, frozen = 3, np.array([1.0]), np.zeros(3), np.ones(3), np.ones(3), np.zeros(1, bool)
        predict = staticmethod(lambda w, rows: nm.Dual(np.full(len(rows), np.nan), np.full((len(rows), 1), np.nan)) if isinstance(w[0], nm.Dual) else np.full(len(rows), np.nan))
        clipped = staticmethod(lambda w: w)
        penalty = staticmethod(lambda w: 0.0)
        penalty_gradient = staticmethod(lambda w: np.zeros(1))

    assert training.train(Broken()).tolist() == [1.0]


@given(st.sets(st.integers(1, 4), min_size=2, max_size=4), st.lists(st.floats(0.05, 90), min_size=4, max_size=4))
def test_missing_stabilities_lie_on_the_lines(known, values):
    out = training.filled({r: values[r - 1] for r in known}, np.array([0.4, 1.2, 3.0, 15.0]))
    for r in known:
        assert out[r - 1] == pytest.approx(values[r - 1])
    s1, s2, s3, s4 = np.log(out)
    if len(known) < 4:
        gaps = (0.41 * s1 + 0.59 * s3 - s2, 0.46 * s2 + 0.54 * s4 - s3)
        held = [abs(g) < 1e-6 for g in gaps]
        assert all(held) if len(known) == 2 else any(held)


def test_regression_features_by_hand():
    x = learner(1, 3)
    f = regression.features(x)
    assert f.shape == (2, 34) and np.isfinite(f).all()
    assert f[0, 10] == 1.0 and f[0, 0] == pytest.approx(regression.tr(x.column("delta_t")[0]))


def test_anki_slope_at_the_start_weights():
    """The first interval starts on the bound of 1, where the slope from above counts."""
    m = recurrent.MODELS["Anki"]
    w = m.weights(False)
    args = (np.array([[3]]), np.array([[0.0]]), np.array([1]), np.array([7.0]))
    got = recurrent.predict(m, *args, nm.Dual.parameters(w), 0.0001).g[0, 0]
    up = w.copy()
    up[0] += 1e-6
    above = (recurrent.predict(m, *args, up, 0.0001)[0] - recurrent.predict(m, *args, w, 0.0001)[0]) / 1e-6
    assert got == pytest.approx(above, rel=1e-3) and got > 0


def test_golden_and_local_minimum():
    assert training.golden(lambda v: (v - 3) ** 2, 0, 10) == pytest.approx(3, abs=1e-5)
    assert training.local_minimum(np.cos, 0, 10, 2) == pytest.approx(math.pi, abs=1e-4)
    assert training.local_minimum(lambda v: v, 1, 10, 4) == 1 and training.local_minimum(lambda v: -v, 1, 10, 4) == 10
    two = lambda v: np.minimum((v - 2) ** 2, (v - 8) ** 2 - 1)
    assert training.local_minimum(two, 0.001, 100, 1) == pytest.approx(2, abs=1e-4) and training.local_minimum(two, 0.001, 100, 30) == pytest.approx(8, abs=1e-4)
    assert training.local_minimum(lambda v: abs(v - 3), 0.001, 100, 3) == pytest.approx(3, abs=1e-6)


def test_names():
    s = Settings(algo="FSRS-6", short=True, secs=True, two_buttons=True, only_s0=True, partitions="deck", dev=True)
    assert s.result_name == "FSRS-6-S0-binary-short-secs-deck-dev"
    assert Settings(algo="FSRS-6").s_min == 0.001 and Settings(algo="FSRS-rs").s_min == 0.01 and Settings(secs=True).s_min == 0.0001
