"""Risk and performance of return series as aggregates; every function takes optional grouping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_quantile, safe_div
from .timeseries import drawdown, equity


def metrics(returns: DataFrame, *by: str, periods: int = 12, risk_free: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """n, mean, vol, sharpe, sortino, var, var_normal, cvar, win_rate of r by group."""
    keys = list(by)
    cut = returns.groupBy(*keys).agg(F.percentile("r", F.lit(1 - confidence)).alias("__q"))
    rows = returns.join(F.broadcast(cut), keys) if keys else returns.crossJoin(cut)
    root = F.sqrt(F.lit(float(periods)))
    mean, sd = F.avg("r"), F.stddev_samp("r")
    excess = mean * periods - risk_free
    down = F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * root
    return rows.groupBy(*keys).agg(
        F.count("r").alias("n"), mean.alias("mean"), (sd * root).alias("vol"), safe_div(excess, sd * root).alias("sharpe"), safe_div(excess, down).alias("sortino"),
        F.abs(F.first("__q")).alias("var"), F.abs(mean + normal_quantile(F.lit(1 - confidence)) * sd).alias("var_normal"),
        F.avg(F.when(F.col("r") <= F.col("__q"), F.col("r"))).alias("cvar"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"),
    )


def bundle(returns: DataFrame, *by: str, periods: int = 12, risk_free: float = 0.05) -> DataFrame:
    """n, total, cagr, vol, sharpe, max_drawdown (positive), calmar (of cagr), calmar_mean (of the yearly mean), win_rate of r (idx, r).

    One window and one aggregate. Without a drawdown both ratios are NULL; a NULL return counts as no change of worth.
    """
    keys = list(by) or [F.lit("all")]
    rows = returns.withColumn("__e", equity("r", *keys)).withColumn("__d", drawdown("__e", *keys))
    n, growth = F.count("r"), F.product(1 + F.coalesce("r", F.lit(0.0)))
    cagr = F.when(n > 0, F.pow(growth, periods / n) - 1)
    vol, yearly, worst = F.stddev_samp("r") * F.sqrt(F.lit(float(periods))), F.avg("r") * periods, -F.min("__d")
    return rows.groupBy(*by).agg(
        n.alias("n"), (growth - 1).alias("total"), cagr.alias("cagr"), vol.alias("vol"), safe_div(yearly - risk_free, vol).alias("sharpe"), worst.alias("max_drawdown"),
        safe_div(cagr, worst).alias("calmar"), safe_div(yearly, worst).alias("calmar_mean"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"),
    )


def against_market(pairs: DataFrame, *by: str, periods: int = 12) -> DataFrame:
    """beta, alpha, tracking error, information ratio, correlation of r against m, rows that have both."""
    rows = pairs.filter("r IS NOT NULL AND m IS NOT NULL").withColumn("__x", F.col("r") - F.col("m"))
    root = F.sqrt(F.lit(float(periods)))
    beta = F.coalesce(safe_div(F.covar_samp("r", "m"), F.var_samp("m")), F.lit(1.0))
    error = F.stddev_samp("__x") * root
    return rows.groupBy(*by).agg(
        beta.alias("beta"), ((F.avg("r") - beta * F.avg("m")) * periods).alias("alpha"), error.alias("tracking_error"),
        safe_div(F.avg("__x") * periods, error).alias("information_ratio"), F.corr("r", "m").alias("correlation"),
    )


def captures(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean returns in rising and falling markets and their ratios to the market's own."""
    up, down = F.col("m") > 0, F.col("m") < 0
    mean = lambda c, when: F.avg(F.when(when, F.col(c)))
    return pairs.filter("r IS NOT NULL AND m IS NOT NULL").groupBy(*by).agg(
        mean("r", up).alias("up_mean"), mean("r", down).alias("down_mean"), safe_div(mean("r", up), mean("m", up)).alias("up_capture"),
        safe_div(mean("r", down), mean("m", down)).alias("down_capture"),
    )


def period_statistics(returns: DataFrame, *by: str) -> DataFrame:
    """mean, median, std, min, max, unbiased skewness and excess kurtosis, win rate, average gain and loss."""
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("r") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return returns.groupBy(*by).agg(
        F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.stddev_samp("r").alias("std"), F.min("r").alias("least"), F.max("r").alias("most"),
        F.when(n > 2, skew).alias("skew"), F.when(n > 3, kurt).alias("kurt"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("avg_gain"), F.avg(F.when(F.col("r") < 0, F.col("r"))).alias("avg_loss"),
    )


def by_year(returns: DataFrame, *by: str) -> DataFrame:
    """Compounded return, volatility, ratio, best and worst month, number of rising months of each calendar year."""
    total, vol = F.product(1 + F.col("r")) - 1, F.stddev_samp("r") * F.sqrt(F.lit(12.0))
    rows = returns.filter("r IS NOT NULL").groupBy(*by, F.year("date").alias("year"))
    return rows.agg(total.alias("total"), vol.alias("vol"), safe_div(total, vol).alias("ratio"), F.max("r").alias("best"), F.min("r").alias("worst"), F.count_if(F.col("r") > 0).alias("rising"))


def worst_drawdown(returns: DataFrame, *by: str) -> DataFrame:
    """depth, trough and the peak before it, by group."""
    keys = list(by) or ["ticker"]
    rows = returns.withColumn("__e", equity("r", *keys)).withColumn("__d", drawdown("__e", *keys))
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.max(F.struct("__e", (-F.col("idx")).alias("i"))).over(w))
    worst = F.min(F.struct("__d", "idx", "__p"))
    return rows.groupBy(*keys).agg(worst.alias("w")).select(*keys, F.abs("w.__d").alias("depth"), F.col("w.idx").alias("trough"), (-F.col("w.__p.i")).alias("peak"))


def compounded(returns: DataFrame, *by: str) -> DataFrame:
    """Monthly returns from returns of rows."""
    return returns.filter("r IS NOT NULL").groupBy(*by, F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("r"))


def rolling_compounded(returns: DataFrame, n: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*(by or ("ticker",))).orderBy("idx").rangeBetween(-(n - 1), 0)
    return returns.withColumn("rolled", F.when(F.count("r").over(w) >= n, F.product(1 + F.col("r")).over(w) - 1))


def frequencies(picks: DataFrame, what: str = "ticker") -> DataFrame:
    """Share of rows for each value."""
    return picks.groupBy(what).count().select(what, (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))).alias("share"))
