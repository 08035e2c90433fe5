"""Search for parameters inside walk-forward folds. Every configuration is evaluated once, whatever folds and rounds ask for it.

A round evaluates all new configurations of all folds in one plan and writes their returns. Training windows are sums of
moments over the pieces of time between the folds' edges, so a return is read once and not once for each fold it lies in.
All trials of all folds stay in the log: without them neither a deflated Sharpe ratio nor over-fitting can be told.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from . import overfitting, search
from .timeseries import YEAR

#: Random points among which a proposal is chosen, and what a fold tries before it proposes.
CANDIDATES, WARM_UP = 256, 4
OBJECTIVES = ("sharpe", "calmar")
METHODS = ("grid", "random", "bayesian")
#: Least share of the range that the middle half of a chosen parameter may take, and other limits of the gates.
GATES = {"sharpe": 0.5, "deflated_sharpe": 0.95, "stability": 1 / 3, "pbo": 0.3}

Space = dict[str, tuple]
Params = dict[str, object]


def checked(space: Space) -> Space:
    """space: name -> ('int' or 'float', lowest, highest) or ('cat', choices)."""
    for name, (kind, *rest) in space.items():
        good = kind in ("int", "float") and len(rest) == 2 and rest[0] <= rest[1] or kind == "cat" and len(rest) == 1 and len(rest[0]) > 0
        if not good:
            raise ValueError(f"{name}: no such range {kind} {rest}")
    return space


def space_from_json(text: str) -> Space:
    return checked({name: (spec[0], *spec[1:]) for name, spec in json.loads(text).items()})


def lattice(space: Space, steps: int) -> list[Params]:
    """Every combination of `steps` values an axis, from the lowest to the highest; categories whole."""
    axes = {}
    for name, (kind, *rest) in space.items():
        if kind == "cat":
            axes[name] = list(rest[0])
        else:
            values = np.linspace(*rest, steps)
            axes[name] = [float(v) for v in values] if kind == "float" else sorted({round(float(v)) for v in values})
    return search.grid(axes)


def drawn(space: Space, rng: np.random.Generator) -> Params:
    draw = {"int": lambda lo, hi: int(rng.integers(lo, hi + 1)), "float": lambda lo, hi: float(rng.uniform(lo, hi)), "cat": lambda some: some[int(rng.integers(len(some)))]}
    return {name: draw[kind](*rest) for name, (kind, *rest) in space.items()}


def unit(params: Params, space: Space) -> list[float]:
    """Parameters as a point of the unit cube; a category by its place."""
    def one(name, kind, *rest):
        lo, hi, v = (0, len(rest[0]) - 1, list(rest[0]).index(params[name])) if kind == "cat" else (*rest, params[name])
        return (v - lo) / (hi - lo) if hi > lo else 0.5

    return [one(name, *spec) for name, spec in space.items()]


def proposed(done: list[tuple[Params, float]], space: Space, rng: np.random.Generator) -> Params:
    """The random candidate of largest expected improvement over the finite trials; a random one if none is finite."""
    finite = [(p, y) for p, y in done if np.isfinite(y)]
    if not finite:
        return drawn(space, rng)
    candidates = [drawn(space, rng) for _ in range(CANDIDATES)]
    points = lambda some: np.array([unit(p, space) for p in some], float)
    return candidates[search.expected_improvement(points([p for p, _ in finite]), np.array([y for _, y in finite]), points(candidates))]


def key(params: Params) -> str:
    return json.dumps(params, sort_keys=True)


@dataclass(frozen=True)
class Found:
    """log: fold, trial, config, objective, n; chosen: fold, place, config, objective; tested: fold, date, r; returns: config, date, r."""

    log: DataFrame
    chosen: DataFrame
    tested: DataFrame
    returns: DataFrame
    params: dict[str, Params]


def edges(folds: list[search.Fold]) -> list[date]:
    """Where training windows begin or have just ended, ascending."""
    return sorted({d for f in folds for d in (f.train_start, f.train_end + timedelta(days=1))})


def moments(returns: DataFrame, at: list[date]) -> DataFrame:
    """config, piece, n, s, q: number, sum and sum of squares of r; piece is how many edges are not after the date."""
    piece = sum(((F.col("date") >= F.lit(d)).cast("int") for d in at), F.lit(0))
    return returns.filter("r IS NOT NULL").groupBy("config", piece.alias("piece")).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))


def scored(trials: DataFrame, returns: DataFrame, folds: list[search.Fold], objective: str, least: int, periods: int, risk_free: float) -> DataFrame:
    """trials (fold, trial, config) with objective over the fold's training window and n; minus infinity if it has none."""
    spark = returns.sparkSession
    if objective == "calmar":
        window = trials.join(F.broadcast(search.fold_table(spark, folds).select("fold", "train_start", "train_end")), "fold")
        rows = window.join(returns.filter("r IS NOT NULL"), "config").filter("date BETWEEN train_start AND train_end")
        value = search.calmar_objective(rows, "fold", "trial", least=least, periods=periods)
        return trials.join(value, ["fold", "trial"], "left").select("fold", "trial", "config", F.coalesce("objective", F.lit(float("-inf"))).alias("objective"), F.coalesce("n", F.lit(0)).alias("n"))
    at = edges(folds)
    pieces = [(f.no, k) for f in folds for k in range(len(at) + 1) if k and f.train_start <= at[k - 1] <= f.train_end]
    held = trials.join(F.broadcast(spark.createDataFrame(pieces, "fold int, piece int")), "fold").join(moments(returns, at), ["config", "piece"], "left")
    sums = held.groupBy("fold", "trial", "config").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "s", "q")])
    n = F.col("n")
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest((F.col("q") - n * mean * mean) / (n - 1), F.lit(0.0)))
    value = safe_div(mean - risk_free / periods, sd) * F.sqrt(F.lit(float(periods)))
    good = F.when(n >= max(least, 2), value)
    return sums.select("fold", "trial", "config", F.coalesce(good, F.lit(float("-inf"))).alias("objective"), n.cast("long").alias("n"))


def run(
    spark: SparkSession, returns_of: Callable[[dict[str, Params]], DataFrame], space: Space, folds: list[search.Fold], keep: Callable[[DataFrame], DataFrame],
    method: str = "bayesian", trials: int = 24, steps: int = 4, top: int = 1, objective: str = "sharpe", least: int = 60, periods: int = YEAR, risk_free: float = 0.05, seed: int = 0,
) -> Found:
    """Search every fold's training window and test its `top` best configurations, averaged, in its test window.

    returns_of gives config, date, r of configurations by name, from one plan. `keep` writes a table and reads it back.
    A configuration without returns, with fewer than `least` or without variation counts as minus infinity. Grids are
    tried whole; random search tries `trials` points a fold; the Bayesian one starts with max(4, trials / 4) random points,
    then all folds propose one point a round. What the driver holds is folds x trials parameters and objectives.
    """
    checked(space)
    if method not in METHODS or objective not in OBJECTIVES:
        raise ValueError(f"no method {method} or objective {objective}")
    rngs = {f.no: np.random.default_rng(seed + f.no) for f in folds}
    asked: dict[int, list[Params]] = {f.no: [] for f in folds}
    values: dict[tuple[int, int], float] = {}
    known: dict[str, Params] = {}
    log = returns = None
    while True:
        before = {no: len(some) for no, some in asked.items()}
        for no, some in asked.items():
            if method == "grid":
                some += [] if some else lattice(space, steps)
            elif method == "random" or not some:
                some += [drawn(space, rngs[no]) for _ in range((trials if method == "random" else min(trials, max(WARM_UP, trials // 4))) - len(some))]
            elif len(some) < trials:
                some.append(proposed([(p, values[no, k]) for k, p in enumerate(some)], space, rngs[no]))
        fresh = [(no, k, key(p), p) for no, some in asked.items() for k, p in enumerate(some) if k >= before[no]]
        if not fresh:
            break
        new = {c: p for _, _, c, p in fresh if c not in known}
        known |= new
        if new:
            rows = keep(returns_of(new).select("config", "date", "r"))
            returns = rows if returns is None else returns.unionByName(rows)
        table = spark.createDataFrame([(no, k, c) for no, k, c, _ in fresh], "fold int, trial int, config string")
        part = keep(scored(table, returns, folds, objective, least, periods, risk_free))
        log = part if log is None else log.unionByName(part)
        if method == "bayesian":
            values |= {(row.fold, row.trial): row.objective for row in part.collect()}
    best = Window.partitionBy("fold").orderBy(F.desc("objective"), "trial")
    chosen = log.withColumn("place", F.row_number().over(best)).filter((F.col("place") <= top) & ((F.col("objective") > float("-inf")) | (F.col("place") == 1)))
    chosen = keep(chosen.select("fold", "place", "config", "objective"))
    window = chosen.join(F.broadcast(search.fold_table(spark, folds).select("fold", "test_start", "test_end")), "fold")
    tested = window.join(returns.filter("r IS NOT NULL"), "config").filter("date BETWEEN test_start AND test_end")
    return Found(log, chosen, tested.groupBy("fold", "date").agg(F.avg("r").alias("r")), returns, known)


def figures(found: Found, objective: str = "sharpe", periods: int = YEAR, risk_free: float = 0.05) -> DataFrame:
    """One row: folds, trials, days, sharpe of the tested returns, and their deflated Sharpe probability over all trials.

    The spread of Sharpe ratios comes from the log, brought from years to periods; other objectives leave it to the
    returns' own standard error.
    """
    finite = F.when(F.col("objective") > float("-inf"), F.col("objective"))
    tries = found.log.agg(F.count("*").alias("trials"), F.count_distinct("fold").alias("folds"), (F.var_pop(finite) / periods).alias("variance"), F.count(finite).alias("finite")).first()
    variance = tries.variance if objective == "sharpe" and tries.finite > 1 else None
    luck = overfitting.deflated_sharpe(found.tested, max(tries.trials, 1), variance)
    sharpe = (F.col("sharpe") - (risk_free / periods) / F.col("sd")) * F.sqrt(F.lit(float(periods)))
    rows = luck.crossJoin(found.tested.agg(F.stddev_samp("r").alias("sd")))
    return rows.select(F.lit(tries.folds).cast("int").alias("folds"), F.lit(tries.trials).cast("long").alias("trials"), F.col("n").cast("long").alias("days"), sharpe.alias("sharpe"), F.col("probability").alias("deflated_sharpe"))


def stability(found: Found) -> DataFrame:
    """param, folds, low, high, spread of every numeric parameter of the folds' best: quartiles and the middle half's share of the range (NULL if one value)."""
    numbers = [(c, name, float(v)) for c, params in found.params.items() for name, v in params.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    values = found.log.sparkSession.createDataFrame(numbers, "config string, param string, value double")
    rows = found.chosen.filter("place = 1").join(F.broadcast(values), "config")
    low, high = F.percentile("value", F.lit(0.25)), F.percentile("value", F.lit(0.75))
    return rows.groupBy("param").agg(F.count("*").alias("folds"), low.alias("low"), high.alias("high"), safe_div(high - low, F.max("value") - F.min("value")).alias("spread"))


def gates(found: Found, objective: str = "sharpe", periods: int = YEAR, risk_free: float = 0.05, blocks: int = 10) -> DataFrame:
    """gate, value, passed: tested Sharpe and deflated Sharpe above their limits, no parameter's spread above a third (none
    counts as stable), and the probability of over-fitting over all configurations tried below its limit."""
    row = figures(found, objective, periods, risk_free)
    spread = stability(found).agg(F.max("spread").alias("value"))
    days = found.returns.select("date").distinct().withColumn("period", F.row_number().over(Window.orderBy("date")) - 1)
    trials = found.returns.join(F.broadcast(days), "date").select("period", "config", F.coalesce("r", F.lit(0.0)).alias("r"))
    pbo = overfitting.overfitting_share(overfitting.backtest_overfitting(trials, blocks))

    def gate(rows: DataFrame, name: str, value: str, passed: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("gate"), F.col(value).alias("value"), passed.alias("passed"))

    out = gate(row, "sharpe", "sharpe", F.col("sharpe") > GATES["sharpe"]).unionByName(gate(row, "deflated_sharpe", "deflated_sharpe", F.col("deflated_sharpe") > GATES["deflated_sharpe"]))
    out = out.unionByName(gate(spread, "stability", "value", F.coalesce(F.col("value") <= GATES["stability"], F.lit(True))))
    return out.unionByName(gate(pbo, "pbo", "pbo", F.col("pbo") < GATES["pbo"]))
