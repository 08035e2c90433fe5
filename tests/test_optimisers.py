"""Weights that need a covariance against plain formulas, searches and the conditions of an optimum."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import portfolio, strategy


def returns(n=6, t=200, seed=0):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(t, 1))
    return 0.01 * (common * rng.uniform(0.3, 1.0, n) + rng.normal(size=(t, n)) * rng.uniform(0.4, 1.6, n))


def shrunk_by_loops(x):
    """The published estimator, sum by sum: s the sample covariance, f the constant-correlation target."""
    t, n = x.shape
    y = x - x.mean(axis=0)
    s = [[sum(y[k, i] * y[k, j] for k in range(t)) / t for j in range(n)] for i in range(n)]
    r = sum(s[i][j] / math.sqrt(s[i][i] * s[j][j]) for i in range(n) for j in range(n) if i != j) / (n * (n - 1))
    f = [[s[i][i] if i == j else r * math.sqrt(s[i][i] * s[j][j]) for j in range(n)] for i in range(n)]
    pi = [[sum((y[k, i] * y[k, j] - s[i][j]) ** 2 for k in range(t)) / t for j in range(n)] for i in range(n)]
    theta = lambda i, j: sum((y[k, i] ** 2 - s[i][i]) * (y[k, i] * y[k, j] - s[i][j]) for k in range(t)) / t
    rho = sum(pi[i][i] for i in range(n))
    for i in range(n):
        for j in range(n):
            if i != j:
                rho += r / 2 * (math.sqrt(s[j][j] / s[i][i]) * theta(i, j) + math.sqrt(s[i][i] / s[j][j]) * theta(j, i))
    gamma = sum((f[i][j] - s[i][j]) ** 2 for i in range(n) for j in range(n))
    share = max(0.0, min(1.0, (sum(map(sum, pi)) - rho) / gamma / t))
    return np.array([[share * f[i][j] + (1 - share) * s[i][j] for j in range(n)] for i in range(n)]), share


def clusters_by_hand(s):
    """Single linkage by merging the two nearest groups, then halves of the leaves' order by inverse variance."""
    n = len(s)
    d = [[math.sqrt(max(0.0, (1 - s[i][j] / math.sqrt(s[i][i] * s[j][j])) / 2)) for j in range(n)] for i in range(n)]
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        _, a, b = min((min(d[i][j] for i in groups[a] for j in groups[b]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    return groups[0]


def split(order, s):
    if len(order) == 1:
        return {order[0]: 1.0}
    half = len(order) // 2

    def variance(names):
        v = np.array([1 / s[i][i] for i in names])
        v /= v.sum()
        return v @ np.array([[s[i][j] for j in names] for i in names]) @ v

    left, right = order[:half], order[half:]
    share = 1 - variance(left) / (variance(left) + variance(right))
    return {i: w * share for i, w in split(left, s).items()} | {i: w * (1 - share) for i, w in split(right, s).items()}


@pytest.mark.parametrize("seed", range(3))
def test_covariance(seed):
    x = returns(5, 80, seed)
    got, share = portfolio.shrunk_covariance(x)
    want, plain = shrunk_by_loops(x)
    assert share == pytest.approx(plain) and np.allclose(got, want)
    odd = np.array([[1.0, 2.0], [2.0, 1.0]])
    mended = portfolio.nearest_psd(odd)
    assert np.linalg.eigvalsh(mended).min() > 0 and np.allclose(mended, [[1.5, 1.5], [1.5, 1.5]], atol=1e-8)


@pytest.mark.parametrize("seed", range(4))
def test_schemes(seed):
    s = portfolio.shrunk_covariance(returns(6, 200, seed))[0] * 252
    w = portfolio.risk_parity(s)
    assert w.sum() == pytest.approx(1) and np.allclose(w * (s @ w), (w * (s @ w)).mean())
    w = portfolio.hierarchical(s)
    order = clusters_by_hand(s)
    both = [split(o, s) for o in (order, order[::-1])]  # which of two merged groups stands left is open
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    d = np.sqrt(np.diag(s))
    diagonal = portfolio.hierarchical(np.diag(d**2))
    assert np.allclose(diagonal, (1 / d**2) / (1 / d**2).sum())  # without correlation: inverse variances
    assert both[0].keys() == set(range(6))


def test_hierarchical_of_two_blocks():
    """Two pairs of like names: the order keeps pairs together, and all is as the recursion gives it."""
    s = np.array([[0.04, 0.036, 0.002, 0.002], [0.036, 0.05, 0.002, 0.002], [0.002, 0.002, 0.09, 0.08], [0.002, 0.002, 0.08, 0.1]])
    w = portfolio.hierarchical(s)
    want = split(clusters_by_hand(s), s)
    assert np.allclose(w, [want[i] for i in range(4)])


@pytest.mark.parametrize("cap", [1.0, 0.3])
def test_mean_variance_is_an_optimum(cap):
    rng = np.random.default_rng(1)
    s = portfolio.shrunk_covariance(returns(6, 200, 9))[0] * 252
    mu = rng.normal(0.05, 0.05, 6)
    w = portfolio.mean_variance(mu, s, 3.0, cap)
    worth = lambda v: mu @ v - 1.5 * v @ s @ v
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= cap + 1e-9
    gradient = mu - 3.0 * s @ w
    free = gradient[(w > 1e-6) & (w < cap - 1e-6)]
    level = free.mean() if len(free) else None
    assert level is None or (np.allclose(free, level, atol=1e-6) and (gradient[w <= 1e-6] <= level + 1e-6).all() and (gradient[w >= cap - 1e-6] >= level - 1e-6).all())
    for _ in range(3000):
        v = rng.dirichlet(np.full(6, 0.6))
        if v.max() <= cap:
            assert worth(v) <= worth(w) + 1e-9


def test_black_litterman_closed_form():
    s = portfolio.shrunk_covariance(returns(4, 200, 2))[0] * 252
    market, views = np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.1, 0.0, -0.05, 0.02])
    prior, tau = 3.0 * s @ market, 0.05
    omega = np.diag(np.diag(tau * s))
    gain = tau * s @ np.linalg.inv(tau * s + omega)  # the other form of the same posterior
    assert np.allclose(portfolio.black_litterman(views, market, s, 3.0, tau, 1.0), prior + gain @ (views - prior))
    sure = portfolio.black_litterman(views, market, s, 3.0, tau, 1e9)
    assert np.allclose(sure, prior, atol=1e-6)  # views without weight leave what the market implies


def test_fitted_strategies(spark):
    """Weights of declared strategies equal those of plain numpy on the same window."""
    x = returns(5, 150, 4)
    days = [date(2001, 1, 1) + timedelta(days=k) for k in range(150)]
    close = 100 * np.cumprod(1 + x, axis=0)
    names = "ABCDE"
    rows = [(t, d, k + 1, float(close[k, j]), 10.0, 100.0 + j) for j, t in enumerate(names) for k, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "ticker string, date date, idx int, close double, volume double, mcap double")
    z = daily.select("idx", "ticker", F.lit("mcap").alias("factor"), F.col("mcap").alias("z"))
    market = strategy.Market(daily, z, spark.createDataFrame([(d, k + 1, 100.0) for k, d in enumerate(days)], "date date, idx int, close double"))
    book = [strategy.Declared(scheme, (("mcap", 1.0),), n=4, weighting=scheme, window=80, max_weight=0.4) for scheme in strategy.OPTIMISED]
    got = {}
    for r in strategy.weights(market, book).collect():
        got.setdefault((r.config, r.idx), {})[r.ticker] = r.w
    assert all(w == {t: pytest.approx(0.25) for t in "BCDE"} for (_, idx), w in got.items() if idx == 31)  # too few days: equal
    at = 120
    assert {idx for _, idx in got} == {31, 59, 90, 120}
    change = close[1:] / close[:-1] - 1
    s = portfolio.nearest_psd(portfolio.shrunk_covariance(change[at - 81 : at - 1, 1:])[0]) * 252
    mu = np.array([101.0, 102.0, 103.0, 104.0]) * 0.05 * np.sqrt(np.diag(s))
    want = {
        "risk_parity": portfolio.risk_parity(s), "hrp": portfolio.hierarchical(s), "mvo": portfolio.mean_variance(mu, s, 3.0, 0.4),
        "black_litterman": portfolio.mean_variance(portfolio.black_litterman(mu, np.full(4, 0.25), s), s, 3.0, 0.4),
    }
    for scheme, w in want.items():
        if w.max() <= 0.4 + 1e-9:
            assert [got[scheme, at][t] for t in "BCDE"] == pytest.approx(list(w), abs=1e-6)
        assert sum(got[scheme, at].values()) == pytest.approx(1) and max(got[scheme, at].values()) <= 0.4 + 1e-9
    held = strategy.current_holdings(market, book[:1], "2001-05-10").collect()
    assert {r.ticker: r.weight for r in held} == got["risk_parity", 120] and held[0].price == pytest.approx(close[129, names.index(held[0].ticker)])
