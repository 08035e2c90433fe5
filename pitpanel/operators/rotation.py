"""Tactical rotation: monthly momentum of a few assets, a canary rule, the best ones held; and an older momentum variant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .timeseries import lag, rolling


def month_ends(daily: DataFrame) -> DataFrame:
    """ticker, date (month end), idx (month number), close: the last close of each month that has any."""
    rows = daily.filter("close IS NOT NULL").groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    return rows.select("ticker", F.col("month").alias("date"), (F.year("month") * 12 + F.month("month")).alias("idx"), "close")


def momentum_13612(v: str = "close") -> Column:
    """12, 4, 2 and 1 times the returns of 1, 3, 6 and 12 months."""
    return sum((k * (safe_div(F.col(v), lag(v, n)) - 1) for k, n in ((12, 1), (4, 3), (2, 6), (1, 12))), F.lit(0.0))


def average_ratio(v: str = "close", n: int = 13) -> Column:
    return safe_div(F.col(v), rolling(v, n, "mean", n))


@dataclass(frozen=True)
class Strategy:
    """Assets to watch (canary), to hold in good times and in bad ones, and how many; `metric` ranks them."""

    name: str
    canary: tuple[str, ...]
    offensive: tuple[str, ...]
    defensive: tuple[str, ...]
    top: int = 1
    top_defensive: int = 1
    metric: str = "mom"

    @property
    def needed(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.canary + self.offensive + self.defensive))


def weights(signals: DataFrame, s: Strategy) -> DataFrame:
    """idx, ticker, w, defensive: of months in which every needed asset has a signal (ticker, idx, mom, and s.metric)."""
    rows = signals.filter(F.col("ticker").isin(*s.needed))
    month = Window.partitionBy("idx")
    rows = rows.withColumn("__n", F.count("mom").over(month)).filter(F.col("__n") == len(s.needed))
    bad = F.coalesce(F.max(F.when(F.col("ticker").isin(*s.canary), F.col("mom") < 0)).over(month), F.lit(False)) if s.canary else F.lit(False)
    rows = rows.withColumn("defensive", bad)
    pool = F.when(F.col("defensive"), F.col("ticker").isin(*s.defensive)).otherwise(F.col("ticker").isin(*s.offensive))
    rows = rows.filter(pool).withColumn("__r", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc(s.metric), "ticker")))
    rows = rows.filter(F.col("__r") <= F.when(F.col("defensive"), s.top_defensive).otherwise(s.top))
    return rows.select("idx", "ticker", (1 / F.count(F.lit(1)).over(Window.partitionBy("idx"))).alias("w"), "defensive")


def run(signals: DataFrame, s: Strategy, cost_bps: float = 10.0) -> DataFrame:
    """idx (month of the return), ret, turnover, defensive: weights of one month earn the returns r of the next."""
    w = weights(signals, s)
    earned = w.join(signals.select("ticker", (F.col("idx") - 1).alias("idx"), "r"), ["ticker", "idx"])
    earned = earned.groupBy("idx").agg(F.sum(F.col("w") * F.col("r")).alias("gross"), F.first("defensive").alias("defensive"))
    months = w.select("idx").distinct()
    old = w.select((F.col("idx") + 1).alias("idx"), "ticker", F.col("w").alias("__old")).join(months, "idx", "left_semi")
    turn = w.join(old, ["idx", "ticker"], "full_outer").groupBy("idx").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0)))).alias("turnover"))
    rows = earned.join(turn, "idx")
    return rows.select((F.col("idx") + 1).alias("idx"), (F.col("gross") - F.col("turnover") * cost_bps / 1e4).alias("ret"), "turnover", "defensive")


def overlay(daily_base: DataFrame, n: int = 200) -> DataFrame:
    """idx (month), invested: whether the base closed the month before above its mean of n days; no mean is not invested."""
    rows = daily_base.withColumn("__ma", rolling("close", n, "mean", n, F.lit(1))).filter("close IS NOT NULL")
    flag = F.coalesce(F.col("close") > F.col("__ma"), F.lit(False))
    rows = rows.groupBy((F.year("date") * 12 + F.month("date") + 1).alias("idx")).agg(F.max_by(flag, "date").alias("invested"))
    return rows


def with_overlay(result: DataFrame, flags: DataFrame) -> DataFrame:
    return result.join(flags, "idx", "left").withColumn("ret", F.when(F.coalesce("invested", F.lit(False)), F.col("ret")).otherwise(0.0))


def tranches(sleeves: DataFrame, n: int) -> DataFrame:
    """idx, ret: mean over n sleeves (sleeve, idx, ret), for months that all of them have."""
    return sleeves.groupBy("idx").agg(F.avg("ret").alias("ret"), F.count("*").alias("__n")).filter(F.col("__n") == n).drop("__n")


def common_window(results: DataFrame, n: int) -> DataFrame:
    """Rows (name, idx, ret) of months that all n configurations have."""
    return results.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("idx"))).filter(F.col("__n") == n).drop("__n")


def summary(results: DataFrame, periods: int = 12) -> DataFrame:
    """name, months, cagr, mdd (from a principal of 1), vol, calmar, sharpe of rows (name, idx, ret)."""
    w = Window.partitionBy("name").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("__e", F.product(1 + F.col("ret")).over(w))
    rows = rows.withColumn("__d", F.col("__e") / F.greatest(F.max("__e").over(w), F.lit(1.0)) - 1)
    n = F.count("ret")
    cagr = F.pow(F.product(1 + F.col("ret")), periods / n) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))
    return rows.groupBy("name").agg(
        n.alias("months"), cagr.alias("cagr"), F.min("__d").alias("mdd"), vol.alias("vol"), safe_div(cagr, F.abs(F.min("__d"))).alias("calmar"), safe_div(F.avg("ret") * periods, vol).alias("sharpe")
    )


def row_momentum(v: str = "close") -> Column:
    """The older score: percent changes of 21, 63, 126 and 252 rows with weights 12, 4, 2, 1."""
    return sum((k * 100 * (safe_div(F.col(v), lag(v, n)) - 1) for k, n in ((12, 21), (4, 63), (2, 126), (1, 252))), F.lit(0.0))


def mean_reversion(series: DataFrame, rows: int = 60, steps: int = 21, dt: float = 1 / 252) -> DataFrame:
    """ticker, theta, mu, sigma, last, forecast, delta of an Ornstein-Uhlenbeck fit to the last `rows` values v.

    Least squares of a value on the one before gives slope and intercept; the slope is held within (0, 1).
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("idx"))
    near = series.filter("v IS NOT NULL").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= rows)
    near = near.withColumn("__y", F.lag("v").over(w))
    fit = near.groupBy("ticker").agg(
        F.regr_slope("__y", "v").alias("b"), F.regr_intercept("__y", "v").alias("a"), F.regr_syy("__y", "v").alias("syy"), F.regr_sxy("__y", "v").alias("sxy"), F.regr_count("__y", "v").alias("n"), F.max_by("v", "idx").alias("last")
    )
    b = F.greatest(F.least(F.col("b"), F.lit(1 - 1e-6)), F.lit(1e-6))
    fit = fit.withColumn("b", b).withColumn("theta", -F.ln("b") / dt).withColumn("mu", F.col("a") / (1 - F.col("b")))
    left = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1)))
    fit = fit.withColumn("sigma", left * F.sqrt(2 * F.col("theta") / (1 - F.col("b") * F.col("b"))))
    fit = fit.withColumn("forecast", F.col("mu") + (F.col("last") - F.col("mu")) * F.exp(-F.col("theta") * steps * dt))
    return fit.select("ticker", "theta", "mu", "sigma", "last", "forecast", (F.col("forecast") - F.col("last")).alias("delta"))


def win_share(fits: DataFrame, draws: int = 1000, steps: int = 21, dt: float = 1 / 252, seed: int = 0) -> DataFrame:
    """ticker, share: how often a name's simulated end value is the largest. End values follow their closed form, one draw each.

    A draw depends on seed, number and ticker alone (Box-Muller on digits of a digest), so any partitioning gives the same.
    """
    def uniform(k: int) -> Column:
        digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("ticker"), F.lit(str(k))).cast("binary"))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48

    runs = fits.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(fits.filter("theta IS NOT NULL"))
    fade = F.exp(-F.col("theta") * steps * dt)
    sd = F.col("sigma") * F.sqrt((1 - fade * fade) / (2 * F.col("theta")))
    runs = runs.withColumn("v", F.col("mu") + (F.col("last") - F.col("mu")) * fade + sd * F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * F.pi() * uniform(1)))
    return runs.groupBy("draw").agg(F.max_by("ticker", F.struct("v", "ticker")).alias("ticker")).groupBy("ticker").agg((F.count("*") / draws).alias("share"))


def simulated(fits: DataFrame, draws: int = 1000, steps: int = 21, dt: float = 1 / 252, seed: int = 0, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """ticker, step, mean and a quantile column (q05, q50, ...) over draws of simulated paths at each step from 0 on.

    A path follows v + theta (mu - v) dt + sigma sqrt(dt) z. Its normal numbers come from digests of seed, draw, ticker
    and step, so paths do not depend on how rows are dealt out; a path is one fold over its steps.
    """
    def uniform(step: Column, k: int) -> Column:
        digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("ticker"), step.cast("string"), F.lit(str(k))).cast("binary"))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48

    def on(path, step):
        z = F.sqrt(-2 * F.ln(uniform(step, 0))) * F.cos(2 * F.pi() * uniform(step, 1))
        v = F.element_at(path, -1)
        return F.concat(path, F.array(v + F.col("theta") * (F.col("mu") - v) * dt + F.col("sigma") * F.sqrt(F.lit(dt)) * z))

    runs = fits.filter("theta IS NOT NULL").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    paths = runs.select("ticker", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col("last").cast("double")), on)).alias("step", "v"))
    return paths.groupBy("ticker", "step").agg(F.avg("v").alias("mean"), *[F.percentile("v", F.lit(q)).alias(f"q{round(100 * q):02d}") for q in quantiles])
