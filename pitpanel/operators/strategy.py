"""Declared strategies. A declaration is data; many of them compile to one plan in which the strategy is a column.

Scores, universes, selection, weights, back-test, costs and exposures are joins and windows by strategy over panels that
all strategies share. What several declarations have in common (a universe, a timing rule, a window) is computed once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from . import backtest, portfolio, timeseries, universe

REBALANCES = ("month", "quarter")
#: Schemes that need a covariance, and days without which none is estimated (weights are equal then).
OPTIMISED, LEAST_DAYS = ("risk_parity", "hrp", "mvo", "black_litterman"), 60
WEIGHTINGS = ("equal", "value", "inverse_volatility", *OPTIMISED)


@dataclass(frozen=True)
class Declared:
    """A strategy: factor weights, universe, how many names, when and how they are weighted, costs and market timing."""

    name: str
    factors: tuple[tuple[str, float], ...]
    universe: universe.Universe = universe.Universe()
    n: int = 20
    rebalance: str = "month"
    weighting: str = "equal"
    max_weight: float = 1.0
    window: int = 252
    commission_bps: float = 5.0
    slippage_bps: float = 10.0
    impact: float = 0.0
    worth: float = 0.0
    coverage: float = 0.5
    band: float = 1.0
    timing_days: int | None = None
    reentry_days: int = 0
    target_volatility: float | None = None
    volatility_window: int = 63

    def __post_init__(self):
        bad = [
            self.n < 1 and "n is below 1", self.rebalance not in REBALANCES and f"no rebalance {self.rebalance}", self.weighting not in WEIGHTINGS and f"no weighting {self.weighting}",
            not 0 < self.max_weight <= 1 and "max_weight is not within 0 and 1", not any(w for _, w in self.factors) and "no factor has a weight", self.band < 1 and "band is below 1", self.window < 2 and "window is below 2",
        ]
        if any(bad):
            raise ValueError(f"{self.name}: " + "; ".join(b for b in bad if b))

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"factors": dict(self.factors)})

    @classmethod
    def from_json(cls, text: str) -> Declared:
        """The declaration of a JSON object; a key that it does not know is an error, as a misspelt one would be ignored else."""
        raw = json.loads(text)
        _known(raw, cls, raw.get("name"))
        limits = raw.pop("universe", {})
        _known(limits, universe.Universe, raw.get("name"))
        limits = {k: tuple(v) if isinstance(v, list) else v for k, v in limits.items()}
        chosen = raw.pop("factors")
        chosen = chosen.items() if isinstance(chosen, dict) else [(f, 1.0) for f in chosen]
        return cls(factors=tuple((f, float(w)) for f, w in chosen), universe=universe.Universe(**limits), **raw)

    def with_params(self, name: str, params: dict) -> Declared:
        """This strategy with other parameters: fields by name, factor weights as w_<factor>."""
        weights = dict(self.factors) | {k[2:]: float(v) for k, v in params.items() if k.startswith("w_")}
        others = {k: v for k, v in params.items() if not k.startswith("w_")}
        _known(others, Declared, name)
        unknown = set(weights) - {f for f, _ in self.factors}
        if unknown:
            raise KeyError(f"{name}: no factor {sorted(unknown)}")
        return replace(self, name=name, factors=tuple(weights.items()), **others)


def _known(raw: dict, kind: type, name) -> None:
    unknown = set(raw) - {f.name for f in fields(kind)}
    if unknown:
        raise KeyError(f"{name}: unknown {sorted(unknown)}")


@dataclass(frozen=True)
class Market:
    """What strategies run on. daily: ticker, date, idx, close, volume, mcap and what universes ask for, on dense days;
    factors: idx (a signal day), ticker, factor, z; benchmark: date, idx, close."""

    daily: DataFrame
    factors: DataFrame
    benchmark: DataFrame


def _table(strategies: Sequence[Declared], market: Market) -> DataFrame:
    """One row per strategy with its numbers, and the numbers of its universe and timing among the different ones."""
    if len({s.name for s in strategies}) != len(strategies):
        raise ValueError("two strategies have one name")
    limits, timings = _distinct(s.universe for s in strategies), _distinct(map(_timing, strategies))
    rows = [
        (s.name, s.n, s.rebalance, s.weighting, s.max_weight, s.window, (s.commission_bps + s.slippage_bps) / 1e4, s.impact * s.worth**0.5, s.coverage * sum(abs(w) for _, w in s.factors), limits.index(s.universe), timings.index(_timing(s)))
        for s in strategies
    ]
    return market.daily.sparkSession.createDataFrame(rows, "config string, n int, rebalance string, weighting string, cap double, win int, rate double, impact double, least double, limits int, timing int")


def _distinct(values) -> list:
    return list(dict.fromkeys(values))


def _timing(s: Declared) -> tuple:
    return s.timing_days, s.reentry_days if s.timing_days else 0, s.target_volatility, s.volatility_window if s.target_volatility else 0


def scores(market: Market, strategies: Sequence[Declared]) -> DataFrame:
    """config, idx, ticker, score on signal days of each strategy's rebalance: the weighted mean of the factors that are there."""
    spark = market.daily.sparkSession
    weight = spark.createDataFrame([(s.name, f, w) for s in strategies for f, w in s.factors if w], "config string, factor string, w double")
    about = _table(strategies, market).select("config", "rebalance", "least")
    last = backtest.rebalance_dates(market.benchmark.select("date", "idx")).withColumn("quarter", F.month("date") % 3 == 0).drop("date")
    days = last.crossJoin(F.broadcast(about)).filter((F.col("rebalance") == "month") | F.col("quarter")).select("config", "idx", "least")
    rows = market.factors.filter("z IS NOT NULL").join(F.broadcast(weight), "factor").join(F.broadcast(days), ["config", "idx"])
    here = F.sum(F.abs("w"))
    return rows.groupBy("config", "idx", "ticker").agg(F.when(here >= F.first("least"), F.sum(F.col("z") * F.col("w")) / here).alias("score"))


def allowed(market: Market, strategies: Sequence[Declared]) -> DataFrame | None:
    """limits (number of the universe), idx, ticker of the members of each different universe; None if none has a limit."""
    out = None
    for k, limits in enumerate(_distinct(s.universe for s in strategies)):
        found = universe.members(market.daily, limits).select(F.lit(k).alias("limits"), "idx", "ticker")
        out = found if out is None else out.unionByName(found)
    return out


def selected(market: Market, strategies: Sequence[Declared]) -> DataFrame:
    """config, idx, ticker, score and the strategy's row: the n best of its universe that have a price; ties by ticker.

    With a band above 1 names held before stay while they rank within n * band.
    """
    about = _table(strategies, market)
    rows = scores(market, strategies).filter("score IS NOT NULL").withColumn("score", F.round("score", 9)).join(F.broadcast(about), "config")
    priced = market.daily.filter("close IS NOT NULL").select("idx", "ticker")
    rows = rows.join(priced, ["idx", "ticker"], "left_semi").join(allowed(market, strategies), ["limits", "idx", "ticker"], "left_semi")
    best = Window.partitionBy("config", "idx").orderBy(F.desc("score"), "ticker")
    out = rows.withColumn("rank", F.row_number().over(best)).filter("rank <= n").drop("rank")
    for n, band in _distinct((s.n, s.band) for s in strategies if s.band > 1):
        names = [s.name for s in strategies if (s.n, s.band) == (n, band)]
        some = rows.filter(F.col("config").isin(*names))
        held = backtest.with_band(some.select("config", "idx", "ticker", "score"), n, band, "config")
        out = out.filter(~F.col("config").isin(*names)).unionByName(some.join(held.select("config", "idx", "ticker"), ["config", "idx", "ticker"]).select(*out.columns))
    return out


def weights(market: Market, strategies: Sequence[Declared]) -> DataFrame:
    """config, idx, ticker, w by each strategy's scheme, none above its cap (equal where the cap cannot hold).

    Schemes that need a covariance take the returns of the names chosen over `window` days up to the signal; one call holds
    one strategy's names of one signal, n * window numbers.
    """
    change = timeseries.change("close", 1)
    wanted = sorted({s.window for s in strategies if s.weighting == "inverse_volatility"})
    daily = market.daily.withColumn("__r", change)
    spread = F.lit(None).cast("double")
    for n in wanted:
        daily = daily.withColumn(f"__v{n}", timeseries.rolling("__r", n, "std", 2))
        spread = F.when(F.col("win") == n, F.col(f"__v{n}")).otherwise(spread)
    at = daily.select("idx", "ticker", "mcap", *[f"__v{n}" for n in wanted])
    rows = selected(market, strategies).join(at, ["idx", "ticker"]).withColumn("__key", F.concat_ws(" ", "idx", "config"))
    group = Window.partitionBy("config", "idx")
    value, calm = F.when(F.col("mcap") > 0, F.col("mcap")), safe_div(F.lit(1.0), spread)
    raw = F.when(F.col("weighting") == "value", F.coalesce(value, F.percentile(value, F.lit(0.5)).over(group))).when(F.col("weighting") == "inverse_volatility", F.coalesce(calm, F.avg(calm).over(group)))
    plain = rows.filter(~F.col("weighting").isin(*OPTIMISED)).withColumn("w", F.coalesce(raw / F.sum(raw).over(group), 1 / F.count(F.lit(1)).over(group)))
    plain = plain.select("config", "idx", "ticker", "w", "cap", "__key")
    for scheme, cap in _distinct((s.weighting, s.max_weight) for s in strategies if s.weighting in OPTIMISED):
        some = rows.filter((F.col("weighting") == scheme) & (F.col("cap") == cap)).select("config", F.col("idx").alias("signal"), "ticker", "score", "win", "cap", "__key")
        days = some.withColumn("idx", F.explode(F.sequence(F.col("signal") - F.col("win") + 1, F.col("signal"))))
        past = days.join(daily.select("ticker", F.col("idx").cast("int").alias("idx"), F.col("__r").alias("r")), ["ticker", "idx"]).select("__key", "idx", "ticker", "r", "score")
        fitted = portfolio.optimised(past, scheme, "__key", cap, least=LEAST_DAYS)
        plain = plain.unionByName(fitted.join(some.select("config", F.col("signal").alias("idx"), "ticker", "cap", "__key"), ["__key", "ticker"]).select("config", "idx", "ticker", "w", "cap", "__key"))
    return portfolio.capped(plain, F.col("cap"), "__key").select("config", "idx", "ticker", "w")


def current_holdings(market: Market, strategies: Sequence[Declared], as_of: str) -> DataFrame:
    """config, ticker, weight, price on a date: each strategy's weights of its last signal up to it, at the last close up to it."""
    day = F.to_date(F.lit(as_of))
    known = market.benchmark.filter(F.col("date") <= day).agg(F.max("idx").alias("__now"))
    rows = weights(market, strategies).join(F.broadcast(known), F.col("idx") <= F.col("__now"))
    last = F.max("idx").over(Window.partitionBy("config"))
    rows = rows.withColumn("__last", last).filter("idx = __last").select("config", "ticker", F.col("w").alias("weight"))
    price = market.daily.filter((F.col("date") <= day) & F.col("close").isNotNull()).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    return rows.join(price, "ticker").select("config", "ticker", "weight", "price")


def exposures(market: Market, strategies: Sequence[Declared]) -> DataFrame:
    """timing, idx, exposure of each different timing rule: the moving-average switch times the volatility target."""
    out = None
    bench = market.benchmark.withColumn("__r", safe_div(F.col("close"), timeseries.lag("close", 1, F.lit(1))) - 1)
    for k, (days, back, target, window) in enumerate(_distinct(map(_timing, strategies))):
        rows = timeseries.ma_exposure(bench, days, back) if days else bench.withColumn("exposure", F.lit(1.0))
        if target:
            rows = rows.withColumn("exposure", F.col("exposure") * timeseries.volatility_target("__r", target, window))
        rows = rows.select(F.lit(k).alias("timing"), "idx", "exposure")
        out = rows if out is None else out.unionByName(rows)
    return out


def returns(market: Market, strategies: Sequence[Declared]) -> DataFrame:
    """config, idx, ret, turnover: each strategy's daily returns, from one plan.

    A signal's weights trade on the next day and earn from the day after; linear costs and market impact (of the mean
    traded money of 20 days before) fall on a segment's first day. Exposures are those known the day before.
    """
    about = F.broadcast(_table(strategies, market).select("config", "rate", "impact", "timing"))
    held = weights(market, strategies)
    day = market.daily.withColumn("adv", timeseries.rolling(F.col("volume") * F.col("close"), 20, "mean", 1)) if any(s.impact and s.worth for s in strategies) else None
    moves = market.daily.select("ticker", "idx", timeseries.change("close", 1).alias("r"))
    rows = backtest.gross(held, moves, market.benchmark, "config", adv=day).join(about, "config")
    level = exposures(market, strategies).withColumn("exposure", F.coalesce(F.lag("exposure").over(Window.partitionBy("timing").orderBy("idx")), F.lit(1.0)))
    rows = rows.join(F.broadcast(level), ["timing", "idx"], "left")
    cost = F.coalesce(F.col("traded") * F.col("rate") + F.col("strain") * F.col("impact"), F.lit(0.0))
    return rows.select("config", "idx", ((F.col("gross") - cost) * F.coalesce("exposure", F.lit(1.0))).alias("ret"), (F.col("traded") / 2).alias("turnover"))


def summary(rows: DataFrame, periods: int = timeseries.YEAR) -> DataFrame:
    """config, days, total, cagr, vol, sharpe, max_drawdown, turnover of rows (config, idx, ret, turnover)."""
    w = Window.partitionBy("config").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("__e", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)).withColumn("__d", F.col("__e") / F.max("__e").over(w) - 1)
    n, growth = F.count("ret"), F.product(1 + F.coalesce("ret", F.lit(0.0)))
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))
    return curve.groupBy("config").agg(
        n.alias("days"), (growth - 1).alias("total"), (F.pow(growth, periods / n) - 1).alias("cagr"), vol.alias("vol"), safe_div(F.avg("ret") * periods - backtest.RISK_FREE, vol).alias("sharpe"), F.min("__d").alias("max_drawdown"), F.avg("turnover").alias("turnover")
    )
