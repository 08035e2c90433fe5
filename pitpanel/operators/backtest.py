"""Back-tests as joins and windows: signal at a month's end, trade on the next row, profit from the row after."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..functions.columns import safe_div
from .timeseries import YEAR, drawdown, equity

RISK_FREE = 0.05


def rebalance_dates(calendar: DataFrame, period: str = "month") -> DataFrame:
    """date, idx of the last trading day of each period, without the last day of the calendar."""
    last = calendar.groupBy(F.trunc("date", period).alias("p")).agg(F.max(F.struct("date", "idx")).alias("m")).select("m.date", "m.idx")
    return last.join(calendar.agg(F.max("idx").alias("end")), F.col("idx") < F.col("end")).drop("end")


def top_n(scores: DataFrame, n: int, *by: str) -> DataFrame:
    """The n best scores of a date (or of what `by` names); ties go by ticker."""
    w = Window.partitionBy(*(by or ("date",))).orderBy(F.desc("score"), "ticker")
    return scores.filter("score IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def with_band(scores: DataFrame, n: int, keep: float, *by: str) -> DataFrame:
    """by, idx, ticker held: those held before stay while ranked within round(n * keep), the best others fill up.

    A choice depends on the one before, so each strategy's candidates (n * keep names a date) run along its dates in one
    call that holds the n names of the date before and hands out each date's names: time and memory are linear in dates.
    """
    if n * keep == n:
        return top_n(scores, n, *by, "idx").select(*by, "idx", "ticker")
    ranked = top_n(scores, max(n, int(n * keep + 0.5)), *by, "idx").select(*by, "idx", "ticker", "rank")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("idx", "ascending"), ("rank", "ascending")])
        names, dates = rows.column("ticker").to_pylist(), rows.column("idx").to_pylist()
        held, kept, at = set(), [], 0
        while at < len(names):
            end = at
            while end < len(names) and dates[end] == dates[at]:
                end += 1
            stay = [k for k in range(at, end) if names[k] in held][:n]
            fresh = [k for k in range(at, end) if names[k] not in held]
            chosen = (stay + fresh)[:n]
            held = {names[k] for k in chosen}
            kept += chosen
            at = end
        return rows.take(pa.array(kept, pa.int64())).drop_columns(["rank"])

    return ranked.groupBy(*(by or (F.lit("all"),))).applyInArrow(run, StructType([f for f in ranked.schema if f.name != "rank"]))


def segments(weights: DataFrame, calendar: DataFrame, *by: str) -> DataFrame:
    """weights (by, idx of the signal, ticker, w) with seg, first and last: rows in which the holdings earn (idx + 2 on)."""
    w = Window.partitionBy(*by).orderBy("idx")
    order = weights.select(*by, "idx").distinct().withColumn("seg", F.row_number().over(w)).withColumn("last", F.lead("idx").over(w) + 1)
    end = calendar.agg(F.max("idx").alias("end"))
    order = order.crossJoin(F.broadcast(end)).select(*by, "idx", "seg", (F.col("idx") + 2).alias("first"), F.coalesce("last", "end").alias("last"))
    return weights.join(order, [*by, "idx"])


def drift(segs: DataFrame, returns: DataFrame, *by: str) -> DataFrame:
    """by, seg, idx, ticker, w, value: what a holding is worth in its segment, weights drifting with returns (NULL as 0).

    Every holding gets the days of its segment and meets its returns on (ticker, idx), so no row is made that is not kept.
    """
    days = segs.filter("first <= last").select(*by, "seg", "ticker", "w", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("idx"))
    rows = days.join(returns.select("ticker", "idx", "r"), ["ticker", "idx"])
    w = Window.partitionBy(*by, "seg", "ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, "seg", "ticker", "idx", "w", (F.col("w") * F.product(1 + F.coalesce("r", F.lit(0.0))).over(w)).alias("value"))


def gross(weights: DataFrame, returns: DataFrame, calendar: DataFrame, *by: str, adv: DataFrame | None = None) -> DataFrame:
    """by, idx, gross, traded, strain: daily returns before costs; on a segment's first day the weights traded and, with adv
    (ticker, idx of the signal, adv), the sum of traded ** 1.5 / sqrt(adv), to which market impact is in proportion."""
    segs = segments(weights.select(*by, "idx", "ticker", "w"), calendar, *by)
    held = drift(segs, returns, *by)
    daily = held.groupBy(*by, "seg", "idx").agg(F.sum("value").alias("v"), F.sum("w").alias("w0"))
    order = Window.partitionBy(*by, "seg").orderBy("idx")
    daily = daily.withColumn("gross", safe_div(F.col("v"), F.coalesce(F.lag("v").over(order), "w0")) - 1).withColumn("__no", F.row_number().over(order))
    ends = held.groupBy(*by, "seg", "ticker").agg(F.max_by("value", "idx").alias("value"))
    ends = ends.select(*by, (F.col("seg") + 1).alias("seg"), "ticker", safe_div(F.col("value"), F.sum("value").over(Window.partitionBy(*by, "seg"))).alias("old"))
    moved = segs.select(*by, "seg", "ticker", "w", "idx").join(ends, [*by, "seg", "ticker"], "full_outer")
    moved = moved.withColumn("moved", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    strain = F.lit(0.0)
    if adv is not None:
        moved = moved.withColumn("idx", F.max("idx").over(Window.partitionBy(*by, "seg"))).join(adv.select("ticker", "idx", "adv"), ["ticker", "idx"], "left")
        strain = F.coalesce(F.sum(F.col("moved") * F.sqrt(F.greatest(safe_div(F.col("moved"), F.col("adv")), F.lit(0.0)))), F.lit(0.0))
    trade = moved.groupBy(*by, "seg").agg(F.sum("moved").alias("traded"), strain.alias("strain"))
    rows = daily.join(trade, [*by, "seg"])
    first = F.col("__no") == 1
    return rows.select(*by, "idx", "gross", F.when(first, F.col("traded")).alias("traded"), F.when(first, F.col("strain")).alias("strain"))


def run(weights: DataFrame, returns: DataFrame, calendar: DataFrame, cost: float = 0.0015) -> DataFrame:
    """idx, ret, turnover: daily portfolio returns net of costs on the traded weights, charged on a segment's first day."""
    rows = gross(weights, returns, calendar)
    return rows.select("idx", (F.col("gross") - F.coalesce(F.col("traded") * cost, F.lit(0.0))).alias("ret"), (F.col("traded") / 2).alias("turnover"))


def apply_exposure(result: DataFrame, exposure: DataFrame) -> DataFrame:
    """Returns times the exposure of the row before, the last one known; 1 before any."""
    w = Window.partitionBy(F.lit(1)).orderBy("idx")
    rows = exposure.select("idx", F.last("exposure", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__e"))
    rows = rows.select("idx", F.coalesce(F.lag("__e").over(w), F.lit(1.0)).alias("__e"))
    return result.join(rows, "idx", "left").withColumn("ret", F.col("ret") * F.coalesce("__e", F.lit(1.0))).drop("__e")


def stats(result: DataFrame, periods: int = YEAR) -> DataFrame:
    """One row: total, cagr, vol, sharpe, sortino, max_drawdown, calmar, turnover, rebalances."""
    rows = result.withColumn("ticker", F.lit("p")).withColumn("equity", equity("ret"))
    rows = rows.withColumn("dd", drawdown("equity"))
    n, total = F.count("ret"), F.product(1 + F.col("ret")) - 1
    cagr = F.pow(1 + total, periods / n) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(float(periods)))
    excess = F.avg("ret") * periods - RISK_FREE
    return rows.agg(
        total.alias("total"), cagr.alias("cagr"), vol.alias("vol"), safe_div(excess, vol).alias("sharpe"), safe_div(excess, down).alias("sortino"), F.min("dd").alias("max_drawdown"),
        safe_div(cagr, F.abs(F.min("dd"))).alias("calmar"), F.avg("turnover").alias("turnover"), F.count("turnover").alias("rebalances"),
    )


def rebalance_plan(target: DataFrame, current: DataFrame) -> DataFrame:
    """ticker, target, current, diff, action of two tables (ticker, w)."""
    rows = target.select("ticker", F.col("w").alias("target")).join(current.select("ticker", F.col("w").alias("current")), "ticker", "full_outer").fillna(0.0)
    action = F.when((F.col("current") == 0) & (F.col("target") > 0), "BUY").when((F.col("target") == 0) & (F.col("current") > 0), "SELL")
    action = action.when(F.col("target") > F.col("current"), "ADD").when(F.col("target") < F.col("current"), "TRIM").otherwise("HOLD")
    return rows.withColumn("diff", F.col("target") - F.col("current")).withColumn("action", action)


def current_holdings(scores: DataFrame, prices: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """ticker, weight, score, price on a date: the n best of the last scores up to it, equally weighted.

    scores: date, ticker, score; prices: date, ticker, close. Only names with a price on the last trading day up to the
    date count.
    """
    day = F.to_date(F.lit(as_of))
    of = scores.filter(F.col("date") <= day).agg(F.max("date").alias("__d"))
    at = prices.filter(F.col("date") <= day).agg(F.max("date").alias("__d"))
    latest = scores.join(of, F.col("date") == F.col("__d")).select("ticker", "score")
    today = prices.join(at, F.col("date") == F.col("__d")).filter("close IS NOT NULL").select("ticker", F.col("close").alias("price"))
    best = latest.filter("score IS NOT NULL").join(today, "ticker").orderBy(F.desc("score"), "ticker").limit(n)
    return best.select("ticker", (1 / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).alias("weight"), "score", "price")


def share_plan(targets: DataFrame, holdings: DataFrame, prices: DataFrame, cash: float, *by: str) -> DataFrame:
    """by, step, ticker, price, shares, target, trade, action, final_shares, cash, error: whole shares towards target weights.

    targets: ticker, w; holdings: ticker, shares; prices: ticker, price; all with the portfolio in `by`, if there are many.
    A portfolio is worth its priced shares and the cash. First sales, whole positions of names without a target and of
    others what exceeds theirs, then purchases, the largest shortfall first (ties by ticker), each of as many shares as
    its shortfall and the cash left then allow; so cash never falls below zero. `cash` is what is left after a row's step
    and `error` the share of the final worth less the target. Positions without a price are kept and listed, worth nothing
    here; targets without one stay unfilled. Sales are a running sum; one portfolio's purchases are walked in one call.
    """
    keys = [*by, "ticker"]
    rows = holdings.select(*keys, "shares").join(targets.select(*keys, "w"), keys, "full_outer").join(prices.filter("price > 0").select(*keys, "price"), keys, "left")
    rows = rows.select(*keys, F.coalesce("shares", F.lit(0)).cast("long").alias("shares"), F.coalesce("w", F.lit(0.0)).alias("w"), "price").filter("shares > 0 OR w > 0")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    value = F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0))
    rows = rows.withColumn("target", F.col("w") * (F.sum(value).over(whole) + cash))
    short = F.col("target") - value
    sold = F.when(F.col("price").isNull(), 0).when(F.col("w") == 0, F.col("shares")).otherwise(F.floor(F.greatest(-short, F.lit(0.0)) / F.col("price"))).cast("long")
    rows = rows.withColumn("sold", sold).withColumn("most", F.when((short > 0) & F.col("price").isNotNull(), F.floor(short / F.col("price"))).otherwise(0).cast("long"))
    order = Window.partitionBy(*(by or (F.lit(1),))).orderBy(F.col("sold") == 0, F.when(F.col("sold") == 0, -short).otherwise(0.0), "ticker")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("step", F.row_number().over(order) - 1)
    earned = F.col("sold") * F.coalesce("price", F.lit(0.0)) + F.when(F.col("step") == 0, float(cash)).otherwise(0.0)
    rows = rows.withColumn("__sales", F.sum(earned).over(past))
    names = [f"__b{k}" for k in range(len(by))]
    asked = rows.filter("most > 0").select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("step").alias("__step"), "price", "most", "__sales")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__step")
        left, bought, rest = rows["__sales"].iloc[0], [], []
        for price, most in zip(rows["price"], rows["most"], strict=True):
            bought.append(max(min(most, math.floor(left / price)), 0))
            left -= bought[-1] * price
            rest.append(left)
        return rows[[*names, "__step"]].assign(__bought=bought, __rest=rest)

    bought = asked.groupBy(*names).applyInPandas(walk, T.StructType([*asked.select(*names, "__step").schema, T.StructField("__bought", T.LongType()), T.StructField("__rest", T.DoubleType())]))
    same = F.col("step") == F.col("__step")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = rows.join(bought, same, "left")
    after = Window.partitionBy(*(by or (F.lit(1),))).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cash", F.coalesce(F.last("__rest", ignorenulls=True).over(after), "__sales")).withColumn("trade", F.coalesce("__bought", F.lit(0)) - F.col("sold"))
    out = out.withColumn("final_shares", F.col("shares") + F.col("trade"))
    final = F.coalesce(F.col("final_shares") * F.col("price"), F.lit(0.0))
    action = F.when(F.col("trade") > 0, "BUY").when(F.col("trade") < 0, "SELL").otherwise("HOLD")
    error = safe_div(final, F.sum(final).over(whole)) - F.col("w")
    return out.withColumn("error", error).select(*by, "step", "ticker", "price", "shares", "target", "trade", action.alias("action"), "final_shares", "cash", "error")
