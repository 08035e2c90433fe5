"""Weights of a portfolio. Simple schemes are columns; those that need a covariance run per rebalance in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div


def equal_weight(by: str = "date") -> Column:
    return 1 / F.count(F.lit(1)).over(Window.partitionBy(by))


def value_weights(rows: DataFrame, mcap: str = "mcap", by: str = "date") -> DataFrame:
    """rows with w by size, the median standing in for unknown sizes; equal when none is known."""
    w = Window.partitionBy(by)
    known = F.when(F.col(mcap) > 0, F.col(mcap))
    rows = rows.withColumn("__m", F.coalesce(known, F.percentile(known, F.lit(0.5)).over(w)))
    return rows.withColumn("w", F.coalesce(F.col("__m") / F.sum("__m").over(w), equal_weight(by))).drop("__m")


def inverse_volatility(returns: DataFrame, by: str = "date") -> DataFrame:
    """(by, ticker, r) -> by, ticker, w: one over the standard deviation, the mean of those standing in for unknown ones."""
    rows = returns.groupBy(by, "ticker").agg(safe_div(F.lit(1.0), F.stddev_samp("r")).alias("__i"))
    w = Window.partitionBy(by)
    rows = rows.withColumn("__i", F.coalesce("__i", F.avg("__i").over(w)))
    return rows.select(by, "ticker", (F.col("__i") / F.sum("__i").over(w)).alias("w"))


def capped(rows: DataFrame, cap: float | Column, by: str = "date") -> DataFrame:
    """w at most cap, the excess spread in proportion over the others; equal weights where the cap can't hold.

    In order of weight the largest k names sit at the cap, k the least number for which the scaled rest stays under it.
    """
    w = Window.partitionBy(by).orderBy(F.desc("w"), "ticker")
    whole = Window.partitionBy(by)
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(whole)).withColumn("__k", F.row_number().over(w) - 1)
    lightest = Window.partitionBy(by).orderBy("w", F.desc("ticker"))  # the same order from its end: a running sum costs a row the same, a frame to the end costs it all rows after
    rest = F.sum("w").over(lightest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__scale", safe_div(1 - F.col("__k") * cap, rest)).withColumn("__n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("__first", F.min(F.when(F.col("w") * F.col("__scale") <= cap + 1e-15, F.col("__k"))).over(whole))
    rows = rows.withColumn("__s", F.max(F.when(F.col("__k") == F.col("__first"), F.col("__scale"))).over(whole))
    out = F.when(F.col("__n") * cap <= 1, 1 / F.col("__n")).when(F.col("__k") < F.col("__first"), cap).otherwise(F.col("w") * F.col("__s"))
    return rows.withColumn("w", out).drop("__k", "__scale", "__n", "__first", "__s")


def shrunk_covariance(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance drawn towards constant correlation by the optimal share; population moments.

    The estimator of Ledoit and Wolf, "Honey, I shrunk the sample covariance matrix" (2004), appendix B: `squares` is its
    pi, `theta` its theta, `rho` and `gap` its rho and gamma.
    """
    t, n = x.shape
    y = x - x.mean(axis=0)
    s = y.T @ y / t
    sd = np.sqrt(np.diag(s))
    outer = np.outer(sd, sd)
    corr = s / outer
    mean = (corr.sum() - n) / (n * (n - 1)) if n > 1 else 0.0
    goal = mean * outer
    np.fill_diagonal(goal, np.diag(s))
    squares = (y**2).T @ (y**2) / t - s**2
    theta = (y**3).T @ y / t - np.diag(s)[:, None] * s
    ratio = sd[None, :] / sd[:, None]
    rho = np.trace(squares) + mean / 2 * ((ratio * theta + (ratio * theta).T).sum() - 2 * np.trace(theta))
    gap = ((goal - s) ** 2).sum()
    share = min(1.0, max(0.0, (squares.sum() - rho) / gap / t)) if gap > 0 else 0.0
    return share * goal + (1 - share) * s, share


def nearest_psd(s: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return vectors @ np.diag(np.maximum(values, floor)) @ vectors.T


def risk_parity(s: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal shares of risk: cyclic descent on x's / 2 - sum(log x) / n, then scaled to one."""
    n = len(s)
    x = 1 / np.sqrt(np.diag(s)) / n**0.5
    for _ in range(rounds):
        old = x.copy()
        for i in range(n):
            c = s[i] @ x - s[i, i] * x[i]
            x[i] = (-c + (c * c + 4 * s[i, i] / n) ** 0.5) / (2 * s[i, i])
        if np.abs(x - old).max() < 1e-12:
            break
    return x / x.sum()


def hierarchical(s: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distances orders the names, halves split by inverse variance."""
    n = len(s)
    sd = np.sqrt(np.diag(s))
    d = np.sqrt(np.maximum(0.0, (1 - s / np.outer(sd, sd)) / 2))
    edges, left, near = [], set(range(1, n)), {i: (d[0, i], 0) for i in range(1, n)}
    while left:  # a minimum spanning tree; its edges by length are the single-linkage merges
        i = min(left, key=lambda k: (near[k][0], k))
        edges.append((near[i][0], near[i][1], i))
        left.remove(i)
        for k in left:
            near[k] = min(near[k], (d[i, k], i))
    group = {i: [i] for i in range(n)}
    for _, a, b in sorted(edges):
        a, b = group[a], group[b]
        merged = a + b
        for i in merged:
            group[i] = merged
    order, w = group[0], np.ones(n)

    def variance(names):
        v = 1 / np.diag(s)[names]
        v = v / v.sum()
        return v @ s[np.ix_(names, names)] @ v

    parts = [order]
    while parts:
        parts = [p[k] for p in parts if len(p) > 1 for k in (slice(0, len(p) // 2), slice(len(p) // 2, None))]
        for a, b in zip(parts[::2], parts[1::2], strict=True):
            va, vb = variance(a), variance(b)
            share = 1 - va / (va + vb) if va + vb > 0 else 0.5
            w[a] *= share
            w[b] *= 1 - share
    return w / w.sum()


def mean_variance(mu: np.ndarray, s: np.ndarray, aversion: float = 3.0, cap: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Maximise mu'w - aversion / 2 w'Sw on the capped simplex by accelerated projected gradient steps."""
    n = len(mu)
    cap = max(cap, 1 / n)

    def project(v):
        lo, hi = v.min() - 1, v.max()
        for _ in range(60):  # halves an interval of order one to about 1e-17
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
        return np.clip(v - (lo + hi) / 2, 0, cap)

    step = 1 / (aversion * np.linalg.eigvalsh(s)[-1] + 1e-12)
    w = z = np.full(n, 1 / n)
    k = 0
    for _ in range(steps):
        new = project(z + step * (mu - aversion * s @ z))
        k = k + 1 if (z - new) @ (new - w) <= 0 else 1  # momentum that points back starts anew
        if np.abs(new - w).max() < 1e-12:
            return new
        z = new + (k - 1) / (k + 2) * (new - w)
        w = new
    return w


def black_litterman(views: np.ndarray, market: np.ndarray, s: np.ndarray, aversion: float = 3.0, tau: float = 0.05, doubt: float = 1.0) -> np.ndarray:
    """Posterior mean of returns from what the market's weights imply and absolute views on every name."""
    prior = aversion * s @ market
    p, omega = np.linalg.inv(tau * s), np.diag(1 / (doubt * tau * np.diag(s)))
    return np.linalg.solve(p + omega, p @ prior + omega @ views)


def optimised(returns: DataFrame, scheme: str, by: str = "date", cap: float = 1.0, aversion: float = 3.0, least: int = 60, periods: int = 252) -> DataFrame:
    """(by, idx, ticker, r, score) -> by, ticker, w per rebalance; equal weights under `least` complete rows.

    schemes: risk_parity, hrp, mvo, black_litterman. One call holds the window of one rebalance: names chosen x rows.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="idx", columns="ticker", values="r").dropna()
        names = sorted(rows["ticker"].unique())
        w = np.full(len(names), 1 / len(names))
        if len(wide) >= least and len(wide.columns) == len(names) > 1:
            s = nearest_psd(shrunk_covariance(wide.to_numpy())[0]) * periods
            score = rows.groupby("ticker")["score"].last().reindex(names).fillna(0.0).to_numpy() if "score" in rows else np.zeros(len(names))
            mu = score * 0.05 * np.sqrt(np.diag(s))
            w = {
                "risk_parity": lambda: risk_parity(s), "hrp": lambda: hierarchical(s), "mvo": lambda: mean_variance(mu, s, aversion, cap),
                "black_litterman": lambda: mean_variance(black_litterman(mu, np.full(len(names), 1 / len(names)), s, aversion), s, aversion, cap),
            }[scheme]()
        return pd.DataFrame({by: rows[by].iloc[0], "ticker": names, "w": w})

    kind = dict(returns.dtypes)[by]
    return returns.groupBy(by).applyInPandas(fit, f"{by} {kind}, ticker string, w double")


def sector_capped(rows: DataFrame, cap: float, sector: str = "sector", by: str = "date") -> DataFrame:
    """rows with w such that no sector holds more than cap; inside a sector proportions stay. A name without a sector is one of its own.

    Where the sectors are too few for the cap, w stays as it is.
    """
    label = F.when(F.col(sector).isNotNull(), F.concat(F.lit("s "), F.col(sector))).otherwise(F.concat(F.lit("n "), F.col("ticker")))
    rows = rows.withColumn("__l", label)
    totals = rows.groupBy(by, "__l").agg(F.sum("w").alias("w"))
    few = F.count(F.lit(1)).over(Window.partitionBy(by)) * cap < 1 - 1e-9
    limits = capped(totals.withColumn("__few", few).withColumn("__t", F.col("w")).withColumnRenamed("__l", "ticker"), cap, by)
    limits = limits.select(F.col(by).alias("__by"), F.col("ticker").alias("__s"), F.when(F.col("__few"), 1.0).otherwise(safe_div(F.col("w"), F.col("__t"))).alias("__f"))
    out = rows.join(limits, (F.col(by) == F.col("__by")) & (F.col("__l") == F.col("__s")))
    return out.withColumn("w", F.col("w") * F.coalesce("__f", F.lit(0.0))).drop("__l", "__by", "__s", "__f")


def trade_cost(old_new: DataFrame, commission_bps: float = 5.0, slippage_bps: float = 10.0, by: str = "date", impact: float = 0.0, value: float = 0.0) -> DataFrame:
    """by, cost of rows (by, old, new, and adv if there is impact): traded weight times the linear rate, and market impact.

    Impact is `impact` times the root of traded money (of a portfolio worth `value`) over adv, the money traded a day.
    """
    traded = F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    cost = F.sum(traded) * ((commission_bps + slippage_bps) / 1e4)
    if impact > 0 and value > 0:
        cost = cost + F.sum(F.coalesce(traded * impact * F.sqrt(F.greatest(safe_div(traded * value, F.col("adv")), F.lit(0.0))), F.lit(0.0)))
    return old_new.groupBy(by).agg(cost.alias("cost"))
