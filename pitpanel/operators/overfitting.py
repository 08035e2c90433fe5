"""Charges for over-fitting: the best Sharpe ratio that luck gives, the deflated one, and the chance that the pick fails."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf, safe_div

EULER = 0.5772156649015329
_normal = NormalDist()


def expected_best_sharpe(trials: int, variance: float) -> float:
    """Expected maximum of `trials` Sharpe ratios of that variance without skill."""
    if trials <= 1:
        return 0.0
    return variance**0.5 * ((1 - EULER) * _normal.inv_cdf(1 - 1 / trials) + EULER * _normal.inv_cdf(1 - 1 / (trials * 2.718281828459045)))


def deflated_sharpe(returns: DataFrame, trials: int, variance: float | None = None, *by: str) -> DataFrame:
    """sharpe (per period), z: how far it lies above luck, in standard errors that know skewness and kurtosis; NULL under 10 rows.

    With its normal distribution function as probability.
    """
    n = F.count("r").cast("double")
    sr = safe_div(F.avg("r"), F.stddev_samp("r"))
    rows = returns.groupBy(*by).agg(n.alias("n"), sr.alias("sharpe"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    unit = expected_best_sharpe(trials, 1.0)
    var = F.lit(variance) if variance is not None else (1 + 0.5 * F.col("sharpe") * F.col("sharpe")) / F.col("n")
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = (F.col("sharpe") - F.sqrt(var) * unit) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    return rows.withColumn("z", F.when(F.col("n") >= 10, z)).withColumn("probability", normal_cdf(F.col("z")))


def block_moments(trials: DataFrame, blocks: int) -> DataFrame:
    """trials (period from 0, config, r) -> block, config, n, s, ss; earlier blocks take the periods that don't divide."""
    n = trials.agg((F.max("period") + 1).alias("n"))
    rows = trials.crossJoin(F.broadcast(n))
    size, more = F.floor(F.col("n") / blocks), F.col("n") % blocks
    edge = (size + 1) * more
    block = F.when(F.col("period") < edge, F.floor(F.col("period") / (size + 1))).otherwise(more + F.floor((F.col("period") - edge) / size))
    return rows.groupBy(block.cast("int").alias("block"), "config").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))


def _parts(trials: DataFrame, blocks: int) -> DataFrame:
    """One row per config with the moments of each block: n0, s0, q0, n1, ..."""
    held = block_moments(trials, blocks)
    pick = lambda v, i: F.coalesce(F.sum(F.when(F.col("block") == i, F.col(v))), F.lit(0))
    return held.groupBy("config").agg(*[pick(v, i).cast("double").alias(f"{c}{i}") for i in range(blocks) for c, v in (("n", "n"), ("s", "s"), ("q", "ss"))])


def _sharpe(blocks: int, inside: bool) -> Column:
    """Sharpe ratio over the blocks whose bit of `combo` is set (or not set), from their moments; 0 without variation."""
    def total(c):
        bit = lambda i: F.shiftright("combo", i).bitwiseAND(1) == int(inside)
        return sum((F.when(bit(i), F.col(f"{c}{i}")).otherwise(0.0) for i in range(1, blocks)), F.when(bit(0), F.col(f"{c}0")).otherwise(0.0))

    n, s, q = total("n"), total("s"), total("q")
    mean = s / n
    sd = F.sqrt(F.greatest((q - n * mean * mean) / (n - 1), F.lit(0.0)))
    return F.round(F.coalesce(safe_div(mean, sd), F.lit(0.0)), 12)


def backtest_overfitting(trials: DataFrame, blocks: int = 10) -> DataFrame:
    """combo, config, omega, logit: for every choice of half the blocks, the best config there and its rank in the rest.

    A choice is a bit mask of its blocks; all of them are taken. Trials are reduced to blocks' moments, one row a config;
    every config evaluates all masks in its row, and one shuffle by mask finds the best config inside (ties: first by
    name) and its mean rank outside. Tasks are as many as configs first and as many as masks afterwards.
    """
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << blocks) - 1)), lambda m: F.bit_count(m) == blocks // 2)
    rows = _parts(trials, blocks).withColumn("combo", F.explode(masks)).select("combo", "config", _sharpe(blocks, True).alias("inside"), _sharpe(blocks, False).alias("outside"))
    combo = Window.partitionBy("combo")
    rows = rows.withColumn("best", F.first_value(F.struct("config", "outside")).over(combo.orderBy(F.desc("inside"), "config").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    below, same = F.count_if(F.col("outside") < F.col("best.outside")), F.count_if(F.col("outside") == F.col("best.outside"))
    picked = rows.groupBy("combo").agg(F.first("best.config").alias("config"), ((below + (same + 1) / 2) / (F.count("*") + 1)).alias("omega"))
    return picked.withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega"))))


def overfitting_share(picked: DataFrame) -> DataFrame:
    return picked.agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count("*").alias("combos"))
