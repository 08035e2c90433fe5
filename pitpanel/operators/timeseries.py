"""Operators along time: lags, growth, rolling statistics, exposures, drawdowns. Panels have ticker, idx and values."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_div

YEAR = 252


def over(n: int, *by: str):
    """The last n calendar rows, this one included."""
    return Window.partitionBy(*(by or ("ticker",))).orderBy("idx").rangeBetween(-(n - 1), 0)


def lag(v: Column | str, n: int, *by: str) -> Column:
    """The value n calendar rows before (after, if n is negative)."""
    return F.max(v).over(Window.partitionBy(*(by or ("ticker",))).orderBy("idx").rangeBetween(-n, -n))


def rolling(v: Column | str, n: int, how: str = "mean", least: int | None = None, *by: str) -> Column:
    """mean, std, sum, min or max of the last n rows, NULL with fewer than `least` values (n // 2, at least 2)."""
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}[how]
    w = over(n, *by)
    return F.when(F.count(v).over(w) >= (max(2, n // 2) if least is None else least), agg(v).over(w))


def ttm(v: Column | str) -> Column:
    """Sum of the last four quarters, all present."""
    return rolling(v, 4, "sum", 4)


def growth(v: Column | str, n: int) -> Column:
    """(x - x[n before]) over the size of the latter."""
    v = F.col(v) if isinstance(v, str) else v
    return safe_div(v - lag(v, n), F.abs(lag(v, n)))


def momentum(v: Column | str, days: int, skip: int = 0) -> Column:
    return safe_div(lag(v, skip) if skip else (F.col(v) if isinstance(v, str) else v), lag(v, days)) - 1


def change(v: str, n: int = 1, pad: bool = False) -> Column:
    """x / x[n before] - 1; with pad, gaps repeat the last value first (returns of 0 % inside gaps)."""
    if pad:
        filled = F.last(v, ignorenulls=True).over(Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
        return safe_div(filled, F.lag(filled, n).over(Window.partitionBy("ticker").orderBy("idx"))) - 1
    return safe_div(F.col(v), lag(v, n)) - 1


def downside_std(r: str, n: int) -> Column:
    return rolling(F.when(F.col(r) < 0, F.col(r)), n, "std", max(2, n // 4))


def sharpe(r: str, n: int) -> Column:
    return safe_div(rolling(r, n), rolling(r, n, "std")) * F.sqrt(F.lit(float(YEAR)))


def sortino(r: str, n: int) -> Column:
    return safe_div(rolling(r, n), downside_std(r, n)) * F.sqrt(F.lit(float(YEAR)))


def beta(panel: DataFrame, market: DataFrame, n: int, r: str = "r") -> DataFrame:
    """panel with beta: covariance of pairs over the variance of all market days, of the last n rows."""
    m = market.select("idx", F.col("r").alias("__m"), rolling("r", n, "std", max(20, n // 2), F.lit(1)).alias("__s"))
    rows = panel.join(F.broadcast(m), "idx", "left")
    w = over(n)
    pair = (F.col(r) * F.col("__m")).isNotNull()
    cov = F.when(F.sum(pair.cast("int")).over(w) >= max(20, n // 2), F.covar_samp(F.col(r), F.col("__m")).over(w))
    return rows.withColumn("beta", safe_div(cov, F.col("__s") * F.col("__s"))).drop("__m", "__s")


def market_spread(market: DataFrame, spans: list[int]) -> DataFrame:
    """idx, __m (return) and for each span n __s{n}, the deviation of the last n days, as beta divides by."""
    return market.select("idx", F.col("r").alias("__m"), *[rolling("r", n, "std", max(20, n // 2), F.lit(1)).alias(f"__s{n}") for n in spans])


def wilder_rsi(panel: DataFrame, v: str, period: int) -> DataFrame:
    """panel with rsi: gains and losses smoothed with alpha = 1 / period from the first change on.

    The recursion runs along a ticker's rows in one call, so that a row costs the same whatever the period. No average
    loss gives NULL.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        d = pd.Series(rows.column(v).to_pandas().to_numpy(float, na_value=np.nan)).diff()
        smoothed = lambda x: x.ewm(alpha=1.0 / period, adjust=False, ignore_na=True).mean().to_numpy()
        gain, loss = smoothed(d.clip(lower=0)), smoothed((-d).clip(lower=0))
        known = (d.notna().cumsum() >= period).to_numpy() & (np.abs(loss) > 1e-9)
        rsi = 100 - 100 / (1 + np.divide(gain, loss, out=np.zeros(len(d)), where=known))
        return rows.append_column("rsi", pa.array(rsi, pa.float64(), mask=~known))

    return panel.groupBy("ticker").applyInArrow(run, T.StructType([*panel.schema.fields, T.StructField("rsi", T.DoubleType())]))


def forward_return(v: str, horizon: int) -> Column:
    """From the close after the signal's to the close `horizon` rows on."""
    return safe_div(lag(v, -(1 + horizon)), lag(v, -1)) - 1


def ma_exposure(series: DataFrame, n: int, hysteresis: int = 0, v: str = "close") -> DataFrame:
    """series (idx, v) with exposure 1 or 0: above the mean of n rows; out at once, back after `hysteresis` rows above.

    Before n rows there is no mean and the exposure is 1. Runs of days above are numbered as islands, so no loop.
    """
    one = F.lit(1)
    rows = series.withColumn("__ma", rolling(v, n, "mean", n, one)).withColumn("__up", F.when(F.col("__ma").isNotNull(), (F.col(v) > F.col("__ma")).cast("int")))
    if not hysteresis:
        return rows.withColumn("exposure", F.coalesce(F.col("__up").cast("double"), F.lit(1.0))).drop("__ma", "__up")
    w = Window.partitionBy(one).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__downs", F.sum(F.when(F.col("__up") == 0, 1).otherwise(0)).over(w))
    run = F.sum(F.coalesce("__up", F.lit(0))).over(Window.partitionBy(one, "__downs").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("__ma").isNull() | (F.col("__downs") == 0) | ((F.col("__up") == 1) & (run >= hysteresis))
    return rows.withColumn("exposure", inside.cast("double")).drop("__ma", "__up", "__downs")


def volatility_target(r: str, target: float, n: int = 63, low: float = 0.0, high: float = 1.0, *by: str) -> Column:
    vol = rolling(r, n, "std", n, *(by or (F.lit(1),))) * F.sqrt(F.lit(float(YEAR)))
    return F.coalesce(F.greatest(F.least(safe_div(F.lit(target), vol), F.lit(high)), F.lit(low)), F.lit(1.0))


def macro_exposure(signals: list[Column], reduction: float) -> Column:
    """reduction to the power of the number of active signals; NULL is inactive."""
    return F.pow(F.lit(reduction), sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0)))


def combine_exposures(exposures: DataFrame) -> DataFrame:
    """date, exposure: the product over all rows (date, exposure) of a date, NULL as 1, within 0 and 1."""
    return exposures.groupBy("date").agg(F.greatest(F.least(F.product(F.coalesce("exposure", F.lit(1.0))), F.lit(1.0)), F.lit(0.0)).alias("exposure"))


def equity(r: Column | str, *by: str) -> Column:
    """Growth of 1 from returns, NULL as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(Window.partitionBy(*(by or ("ticker",))).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))


def drawdown(e: str, *by: str) -> Column:
    return F.col(e) / F.max(e).over(Window.partitionBy(*(by or ("ticker",))).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - 1


def drawdown_episodes(curve: DataFrame, *by: str) -> DataFrame:
    """Episodes of curve (idx, equity): start, trough, end (NULL if it goes on), depth, rows; keyed by `by`."""
    keys = list(by) or ["ticker"]
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = curve.withColumn("__dd", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("__start", ((F.col("__dd") < 0) & (F.coalesce(F.lag("__dd").over(w), F.lit(0.0)) >= 0)).cast("int"))
    rows = rows.withColumn("__no", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead("idx").over(w))
    rows = rows.filter("__dd < 0").groupBy(*keys, F.col("__no").alias("episode"))
    return rows.agg(F.min("idx").alias("start"), F.min_by("idx", F.struct("__dd", "idx")).alias("trough"), F.max_by("__next", "idx").alias("end"), F.min("__dd").alias("depth"), F.count("*").alias("rows"))


def expanding_quantile(series: DataFrame, v: str, q: float, least: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """idx, cut: the exact quantile (interpolated) of the values of v up to each row that has one; NULL under `least` of them.

    With n values, rows fall into about sqrt(n) blocks of dates and sqrt(n) ranges of values. A block knows how many
    earlier values lie in each range; with its own values up to a row that gives the range which holds the wanted place,
    and that range's values up to the row are sorted. So a row looks at arrays of about sqrt(n) numbers, and rows are
    spread over tasks. The values are read several times, so `keep` may write them first.
    """
    known = keep(series.filter(F.col(v).isNotNull()).select(F.col("idx").cast("int").alias("idx"), F.col(v).cast("double").alias("v")))
    n, first, last = known.agg(F.count("*"), F.min("idx"), F.max("idx")).first()
    if not n:
        return known.select("idx", F.lit(None).cast("double").alias("cut"))
    size = max(1, math.isqrt(n))
    bounds = sorted(set(known.agg(F.percentile_approx("v", [k / size for k in range(1, size)] or [0.5])).first()[0]))
    span = max(1, (last - first + 1) // size)
    rows = known.withColumns({"block": F.floor((F.col("idx") - first) / span).cast("int"), "range": F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("v")))})
    ranges = F.sequence(F.lit(0), F.lit(len(bounds)))
    own = rows.groupBy("block").agg(F.collect_list(F.struct("idx", "range")).alias("own"))
    counts = rows.groupBy("block", "range").agg(F.count("*").alias("n")).groupBy("range").agg(F.collect_list(F.struct("block", "n")).alias("cells"))
    earlier = own.select("block").join(F.broadcast(counts)).select("block", "range", F.aggregate(F.filter("cells", lambda c: c["block"] < F.col("block")), F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n"))
    earlier = earlier.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("range", "n"))).alias("before"))
    here = lambda r: F.coalesce(F.col("before")[r], F.lit(0).cast("long")) + F.size(F.filter("own", lambda o: (o["idx"] <= F.col("idx")) & (o["range"] == r)))
    steps = F.aggregate(ranges, F.array(F.lit(0).cast("long")), lambda s, r: F.concat(s, F.array(F.element_at(s, -1) + here(r))))
    at = rows.select("idx", "block").join(own, "block").join(earlier, "block").select("idx", steps.alias("upto"))
    at = at.withColumn("n", F.element_at("upto", -1)).withColumn("place", (F.col("n") - 1) * F.lit(q))
    low = F.floor("place")
    at = at.withColumn("ks", F.array(low, F.least(low + 1, F.col("n") - 1))).select("idx", "n", (F.col("place") - low).alias("part"), F.posexplode("ks").alias("which", "k"), "upto")
    in_range = F.size(F.filter("upto", lambda u: u <= F.col("k"))) - 1
    at = at.withColumn("range", in_range).withColumn("inside", F.col("k") - F.col("upto")[F.col("range")])
    members = rows.groupBy("range").agg(F.collect_list(F.struct("v", F.col("idx").alias("at"))).alias("members"))
    found = F.array_sort(F.transform(F.filter("members", lambda m: m["at"] <= F.col("idx")), lambda m: m["v"]))[F.col("inside").cast("int")]
    values = at.join(members, "range").groupBy("idx", "n", "part").agg(F.max_by(found, -F.col("which")).alias("lo"), F.max_by(found, "which").alias("hi"))
    return values.select("idx", F.when(F.col("n") >= least, F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("cut"))


def regimes(series: DataFrame, trend: int = 252, window: int = 63, warm: int = 504, q: float = 0.6, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """series (idx, close) with regime: bull or bear by the trend's sign, calm or volatile by the expanding quantile of volatility."""
    one = F.lit(1)
    rows = series.withColumn("__r", safe_div(F.col("close"), lag("close", 1, one)) - 1)
    rows = rows.withColumn("__vol", rolling("__r", window, "std", window, one) * F.sqrt(F.lit(float(YEAR)))).withColumn("__t", safe_div(F.col("close"), lag("close", trend, one)) - 1)
    rows = keep(rows)
    cuts = expanding_quantile(rows, "__vol", q, warm).select(F.col("idx").alias("__at"), F.col("cut").alias("__cut"))
    rows = rows.join(cuts, rows["idx"] == cuts["__at"], "left").drop("__at")
    known = F.col("__t").isNotNull() & F.col("__cut").isNotNull() & F.col("__vol").isNotNull()
    name = F.concat(F.when(F.col("__t") > 0, "bull").otherwise("bear"), F.when(F.col("__vol") > F.col("__cut"), "_volatile").otherwise("_calm"))
    return rows.withColumn("regime", F.when(known, name).otherwise("unknown")).drop("__r", "__vol", "__t", "__cut")
