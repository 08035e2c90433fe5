"""Parameter search and walk-forward evaluation. Trials and folds are tables; one plan scores them all."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from itertools import product
from random import Random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .timeseries import YEAR


@dataclass(frozen=True)
class Fold:
    no: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def _months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(d.day, last))


def folds(first: date, last: date, train_months: int = 36, test_months: int = 12, embargo_days: int = 30, expanding: bool = True, least_days: int = 60) -> list[Fold]:
    """Successive test windows, each after its training window and an embargo; a last window under least_days is left out."""
    out, test = [], _months(first, train_months)
    while test < last:
        end = min(_months(test, test_months) - timedelta(days=1), last)
        if (end - test).days < least_days:
            break
        start = first if expanding else _months(test, -train_months)
        out.append(Fold(len(out), start, test - timedelta(days=embargo_days + 1), test, end))
        test = _months(test, test_months)
    return out


def fold_table(spark: SparkSession, found: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.no, f.train_start, f.train_end, f.test_start, f.test_end) for f in found], "fold int, train_start date, train_end date, test_start date, test_end date")


def grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def random_params(space: dict[str, tuple], n: int, seed: int = 0) -> list[dict]:
    """space: name -> ('int', lo, hi), ('float', lo, hi) or ('cat', choices)."""
    rnd = Random(seed)
    draw = {"int": lambda s: rnd.randint(s[1], s[2]), "float": lambda s: rnd.uniform(s[1], s[2]), "cat": lambda s: rnd.choice(s[1])}
    return [{k: draw[s[0]](s) for k, s in space.items()} for _ in range(n)]


def expected_improvement(x: np.ndarray, y: np.ndarray, candidates: np.ndarray, length: float = 0.25, noise: float = 1e-4) -> int:
    """The candidate of largest expected improvement under a Gaussian process with a squared-exponential kernel."""
    from statistics import NormalDist

    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1) / length**2)
    sd = y.std() or 1.0
    z = (y - y.mean()) / sd
    k = kernel(x, x) + noise * np.eye(len(x))
    near = kernel(candidates, x)
    mean = near @ np.linalg.solve(k, z)
    spread = np.sqrt(np.maximum(1 - (near * np.linalg.solve(k, near.T).T).sum(1), 1e-12))
    normal = NormalDist()
    gain = [(m - z.max()) * normal.cdf((m - z.max()) / s) + s * normal.pdf((m - z.max()) / s) for m, s in zip(mean, spread, strict=True)]
    return int(np.argmax(gain))


def objective(returns: DataFrame, *by: str, risk_free: float = 0.05, least: int = 60, periods: int = YEAR) -> DataFrame:
    """Annual Sharpe ratio of r by group; minus infinity under `least` rows or without variation."""
    n, sd = F.count("r"), F.stddev_samp("r")
    value = safe_div(F.avg("r") - risk_free / periods, sd) * F.sqrt(F.lit(float(periods)))
    return returns.groupBy(*by).agg(F.when((n >= least) & value.isNotNull(), value).otherwise(F.lit(float("-inf"))).alias("objective"), n.alias("n"))


def calmar_objective(returns: DataFrame, *by: str, order: str = "date", least: int = 60, periods: int = YEAR) -> DataFrame:
    """Annual growth over the worst drawdown by group, NULL returns as 0; minus infinity under `least` rows or without a drawdown."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("__e", F.product(1 + F.coalesce("r", F.lit(0.0))).over(w))
    rows = rows.withColumn("__d", F.col("__e") / F.max("__e").over(w) - 1)
    n = F.count("r")
    growth = F.pow(F.max_by("__e", order), periods / n) - 1
    value = safe_div(growth, F.abs(F.min("__d")))
    return rows.groupBy(*by).agg(F.when((n >= least) & value.isNotNull(), value).otherwise(F.lit(float("-inf"))).alias("objective"), n.alias("n"))


def walk_forward(returns: DataFrame, found: DataFrame, top: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """(chosen: fold, config, objective; tested: fold, date, r) of returns (config, date, r): the best configurations of each
    training window, and their mean return in the test window. Folds are few and broadcast, so one pass serves them all."""
    train = returns.join(F.broadcast(found), F.col("date").between(F.col("train_start"), F.col("train_end")))
    scored = objective(train, "fold", "config", **how)
    best = Window.partitionBy("fold").orderBy(F.desc("objective"), "config")
    chosen = scored.withColumn("place", F.row_number().over(best)).filter((F.col("place") <= top) & (F.col("objective") > float("-inf")))
    test = returns.join(F.broadcast(found), F.col("date").between(F.col("test_start"), F.col("test_end"))).join(chosen.select("fold", "config"), ["fold", "config"])
    return chosen, test.groupBy("fold", "date").agg(F.avg("r").alias("r"))


def weight_grid(spark: SparkSession, names: list[str], step: float = 0.1) -> DataFrame:
    """combo, name, w: all weights in steps that sum to one."""
    n = round(1 / step)
    parts = [p for p in product(range(n + 1), repeat=len(names)) if sum(p) == n]
    return spark.createDataFrame([(i, x, k / n) for i, p in enumerate(parts) for x, k in zip(names, p, strict=True)], "combo int, name string, w double")
