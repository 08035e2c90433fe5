"""The older momentum strategy: one asset a month by momentum or by its forecast, out of the aggressive ones or the protective.

Scores of all months and rules come from one pass: the mean-reverting fit of a month is a sliding window over the days'
momentum, so no month is calibrated by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from . import rotation, search

RULES = ("current", "forecast_1m", "forecast_3m", "forecast_6m", "delta")
#: Days of momentum in a fit, least of them for a forecast, days of a month, and bounds of the slope and of the speed.
CALIBRATION, LEAST_DAYS, MONTH = 60, 30, 21
SLOPE, SPEED = (0.001, 0.999), (0.001, 0.1)


def month_scores(daily: DataFrame, window: int = CALIBRATION, least: int = LEAST_DAYS) -> DataFrame:
    """ticker, idx (month), close, r (of the month after) and a score for each of RULES on the last day of every month.

    daily: ticker, date, idx, close on dense days. A momentum fitted over fewer than `least` days forecasts itself.
    """
    days = daily.withColumn("mom", rotation.row_momentum())
    known = days.filter("mom IS NOT NULL")
    order = Window.partitionBy("ticker").orderBy("idx")
    w = order.rowsBetween(-(window - 2), 0)
    known = known.withColumn("prev", F.lag("mom").over(order))
    now = F.when(F.col("prev").isNotNull(), F.col("mom"))
    raw = safe_div(F.covar_pop(now, F.col("prev")).over(w), F.var_pop("prev").over(w))
    known = known.withColumns({"raw": raw, "pairs": F.count("prev").over(w), "y": F.avg(now).over(w), "x": F.avg("prev").over(w)})
    slope = F.greatest(F.least(F.col("raw"), F.lit(SLOPE[1])), F.lit(SLOPE[0]))
    speed = F.greatest(F.least(-F.ln(slope), F.lit(SPEED[1])), F.lit(SPEED[0]))
    mean = (F.col("y") - F.col("raw") * F.col("x")) / (1 - slope)
    ahead = lambda months: F.when((F.col("pairs") + 1 >= least) & F.col("raw").isNotNull(), mean + (F.col("mom") - mean) * F.exp(-speed * months * MONTH)).otherwise(F.col("mom"))
    known = known.select("ticker", "date", F.col("mom").alias("current"), *[ahead(k).alias(f"forecast_{k}m") for k in (1, 3, 6)], (ahead(1) - F.col("mom")).alias("delta"))
    month = (F.year("date") * 12 + F.month("date")).alias("idx")
    last = known.groupBy("ticker", month).agg(F.max_by(F.struct(*RULES), "date").alias("s")).select("ticker", "idx", "s.*")
    ends = daily.filter("close IS NOT NULL").groupBy("ticker", month).agg(F.max_by("close", "date").alias("close"))
    ends = ends.withColumn("r", F.lead("close").over(Window.partitionBy("ticker").orderBy("idx")) / F.col("close") - 1)
    return ends.join(last, ["ticker", "idx"], "left").select("ticker", "idx", "close", "r", *RULES)


def picks(scores: DataFrame, aggressive: tuple[str, ...], protective: tuple[str, ...], default: str) -> DataFrame:
    """rule, idx, ticker, defensive: each rule's asset of a month in which every aggressive asset has a momentum.

    Defensive when an aggressive asset's own score of the rule is below zero (the one-month forecast for `delta`); then the
    best protective asset counts, or `default` if none has a score; ties go by name.
    """
    long = scores.unpivot(["ticker", "idx"], list(RULES), "rule", "score")
    side = long.filter(F.col("ticker").isin(*aggressive, *protective))
    own = F.col("ticker").isin(*aggressive)
    watched = side.filter(own).withColumn("watch", F.explode(F.when(F.col("rule") == "forecast_1m", F.array(F.lit("forecast_1m"), F.lit("delta"))).when(F.col("rule") != "delta", F.array("rule")).otherwise(F.array().cast("array<string>"))))
    state = watched.groupBy("idx", F.col("watch").alias("rule")).agg((F.count("score") == len(set(aggressive))).alias("whole"), F.coalesce(F.bool_or(F.col("score") < 0), F.lit(False)).alias("defensive")).filter("whole").drop("whole")
    pool = side.join(state, ["idx", "rule"]).filter(F.when(F.col("defensive"), F.col("ticker").isin(*protective)).otherwise(own) & F.col("score").isNotNull())
    best = pool.withColumn("place", F.row_number().over(Window.partitionBy("rule", "idx").orderBy(F.desc("score"), "ticker"))).filter("place = 1").select("rule", "idx", "ticker")
    return state.join(best, ["rule", "idx"], "left").select("rule", "idx", F.coalesce("ticker", F.lit(default)).alias("ticker"), "defensive")


def returns(chosen: DataFrame, scores: DataFrame, cost: float = 0.001) -> DataFrame:
    """rule, idx (month of the return), ticker, defensive, ret: what the pick earns in the month after, less a flat cost."""
    rows = chosen.join(scores.select("ticker", "idx", "r"), ["ticker", "idx"]).filter("r IS NOT NULL")
    return rows.select("rule", (F.col("idx") + 1).alias("idx"), "ticker", "defensive", (F.col("r") - cost).alias("ret"))


def components(chosen: DataFrame, scores: DataFrame, core: tuple[str, ...], rule: str = "current") -> DataFrame:
    """name, idx, r: monthly returns of the rule's pick (name `selected`) and of the core assets in the pick's months."""
    months = chosen.filter(F.col("rule") == rule).select("idx", F.col("ticker").alias("__pick"))
    rows = scores.select("ticker", "idx", "r").filter("r IS NOT NULL").join(F.broadcast(months), "idx")
    names = F.array_compact(F.array(F.when(F.col("ticker") == F.col("__pick"), F.lit("selected")), F.when(F.col("ticker").isin(*core), F.col("ticker"))))
    return rows.select(F.explode(names).alias("name"), (F.col("idx") + 1).alias("idx"), "r")


def mixed(parts: DataFrame, weights: DataFrame, cost: float = 0.001) -> DataFrame:
    """combo, idx, r: parts (name, idx, r) held in the weights (combo, name, w) of each combination, rebalanced monthly, less a flat cost."""
    return parts.join(F.broadcast(weights), "name").groupBy("combo", "idx").agg((F.sum(F.col("w") * F.col("r")) - cost).alias("r"))


def optimised(spark: SparkSession, parts: DataFrame, core: tuple[str, ...], step: float = 0.05, cost: float = 0.001, risk_free: float = 0.05, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(weights: combo, name, w; returns: combo, idx, r) of the grid's best combination by annual Sharpe ratio, the first of equal ones."""
    grid = search.weight_grid(spark, ["selected", *core], step)
    every = keep(mixed(parts, grid, cost))
    best = search.objective(every, "combo", risk_free=risk_free, least=12, periods=12).orderBy(F.desc(F.round("objective", 9)), "combo").limit(1).select("combo")
    return grid.join(F.broadcast(best), "combo"), every.join(F.broadcast(best), "combo")


def win_shares(daily: DataFrame, names: tuple[str, ...], draws: int = 1000, window: int = CALIBRATION) -> DataFrame:
    """ticker, share: how often a name's simulated momentum of a month ahead is the largest, from fits of the last days."""
    rows = daily.filter(F.col("ticker").isin(*names)).withColumn("v", rotation.row_momentum())
    return rotation.win_share(rotation.mean_reversion(rows.select("ticker", "idx", "v"), window), draws)
