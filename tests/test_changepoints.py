"""Trend with sparse slope changes: a planted change, no change, the optimum's conditions, the band, held-out coverage."""
import numpy as np
import pytest

from revguard.operators import changepoints as cp


def test_planted_change_is_found():
    rng = np.random.default_rng(1)
    t = np.arange(60.)
    y = 1. + .5 * t / 59 + np.where(t > 30, 2. * (t - 30) / 59, 0.) + rng.normal(0, .01, 60)
    f = cp.fit(t, y)
    big = np.abs(f.change) > .2
    near = np.abs(f.at - 30 / 59) < .1
    assert big.any() and near[big].all() and f.change.sum() == pytest.approx(2., abs=.2)
    assert (f.change == 0).sum() >= len(f.at) // 2 and np.abs(f.value(t) - y).max() < .06


def test_a_line_stays_a_line():
    rng = np.random.default_rng(2)
    t = np.arange(48.)
    f = cp.fit(t, 3. - t / 47 + rng.normal(0, .02, 48))
    assert np.abs(f.change).max() < .1 and f.slope == pytest.approx(-1., abs=.1) and f.sigma == pytest.approx(.02, rel=.5)


@pytest.mark.parametrize("penalty", [.0, .01, .3])
def test_descent_meets_the_optimality_conditions(penalty):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=40)
    d = cp.descend(x, y, penalty, np.zeros(6))
    pull = x.T @ (y - x @ d)
    assert np.all(np.abs(pull) <= penalty + 1e-6)
    assert np.allclose(pull[d != 0], penalty * np.sign(d[d != 0]), atol=1e-6)


def test_band_widens_with_the_horizon_and_with_past_turns():
    t = np.arange(60.)
    calm = cp.fit(t, t / 59)
    turned = cp.fit(t, np.abs(t - 30) / 30)
    ahead = np.arange(55., 72.)
    sd = turned.future_sd(ahead)
    assert (sd[ahead <= 59] == 0).all() and (np.diff(sd[ahead >= 59]) > 0).all()
    assert (turned.future_sd(ahead) >= calm.future_sd(ahead)).all()


def test_closed_form_equals_simulated_changes():
    rng = np.random.default_rng(4)
    f = cp.Trend(0., 100., np.linspace(.1, .8, 10), 0., 0., np.full(10, .5), .1)
    h, n = .3, 100_000
    total = np.zeros(n)
    counts = rng.poisson(10 * h, n)
    for k in range(counts.max()):
        mine = counts > k
        total[mine] += rng.laplace(0, .5, mine.sum()) * (h - rng.uniform(0, h, mine.sum()))
    assert f.future_sd(np.array([130.]))[0] == pytest.approx(total.std(), rel=.02)


def test_held_out_coverage():
    """Of series that go on turning as their past did, about nine in ten months ahead lie in the 90 % band."""
    rng = np.random.default_rng(5)
    inside = []
    for _ in range(60):
        t = np.arange(72.)
        turns = np.where(rng.random(72) < .06, rng.laplace(0, .02, 72), 0.)
        y = 1. + np.cumsum(.01 + np.cumsum(turns)) + rng.normal(0, .03, 72)
        f = cp.fit(t[:60], y[:60])
        half = 1.645 * np.sqrt(f.sigma ** 2 + f.future_sd(t[60:66]) ** 2)
        inside += (np.abs(f.value(t[60:66]) - y[60:66]) <= half).tolist()
    assert .6 <= np.mean(inside) <= 1.


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_series(n):
    f = cp.fit(np.arange(float(n)), np.arange(float(n)) + 1.)
    assert np.allclose(f.value(np.arange(float(n))), np.arange(float(n)) + 1., atol=1e-8 if n > 1 else 1e-12)
