"""From information coefficients to factor weights: trailing and by regime, and the selection of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank
from .crosssection import neutral, rank_ic

#: Rows of a regime without which its mean says nothing, and names without which a regression says nothing.
LEAST_REGIME_ROWS, LEAST_NAMES = 12, 30


def factor_ics(pairs: DataFrame, least: int = 20) -> DataFrame:
    """date, factor, ic of rows (date, ticker, factor, z, fwd): rank correlations over names that have both; NULL under `least`."""
    rows = pairs.filter("z IS NOT NULL AND fwd IS NOT NULL")
    rows = rows.select("date", "factor", average_rank(F.col("z"), "date", "factor").alias("__a"), average_rank(F.col("fwd"), "date", "factor").alias("__b"))
    varied = (F.stddev_pop("__a") > 0) & (F.stddev_pop("__b") > 0)
    return rows.groupBy("date", "factor").agg(F.when((F.count("*") >= least) & varied, F.corr("__a", "__b")).alias("ic"))


def shares(rows: DataFrame, v: str, *by: str) -> DataFrame:
    """rows with w: the positive part of v over its sum in a group; equal where none is positive."""
    group = Window.partitionBy(*by)
    part = F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))
    total = F.sum(part).over(group)
    return rows.withColumn("w", F.when(total > 0, part / total).otherwise(1 / F.count(F.lit(1)).over(group)))


def trailing_weights(ic: DataFrame, window: int = 756, least: int = 60) -> DataFrame:
    """date, factor, w: in proportion to the mean IC of the last `window` rows up to the date; 0 under `least` rows."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = ic.withColumn("__m", F.when(F.count(F.lit(1)).over(w) >= least, F.avg("ic").over(w)))
    return shares(rows, "__m", "date").select("date", "factor", "w")


def ic_by_regime(ic: DataFrame, regimes: DataFrame) -> DataFrame:
    """factor, regime, ic: mean IC over the dates of a regime (date, regime) that has enough dates."""
    enough = regimes.groupBy("regime").agg(F.count("*").alias("__n")).filter(F.col("__n") >= LEAST_REGIME_ROWS)
    rows = ic.join(regimes, "date").join(enough, "regime")
    return rows.groupBy("factor", "regime").agg(F.avg("ic").alias("ic"))


def weights_by_regime(table: DataFrame) -> DataFrame:
    """regime, factor, w of ic_by_regime: positive ICs in proportion, equal weights where a regime has none."""
    return shares(table.filter("ic IS NOT NULL"), "ic", "regime").select("regime", "factor", "w")


def regime_weights(ic: DataFrame, regimes: DataFrame, least: int = 60, lag: int = 2) -> DataFrame:
    """date, factor, w for every date: mean ICs of earlier dates of the same regime, known by then (more than `lag` rows back).

    Equal weights where fewer than `least` dates are known or fewer than twelve of the regime, or none is positive.
    """
    no = Window.orderBy("date")
    dates = regimes.select("date", "regime", F.row_number().over(no).alias("no"))  # one row a month or day
    rows = ic.join(dates, "date")
    past = Window.partitionBy("factor", "regime").orderBy("no").rangeBetween(Window.unboundedPreceding, -(lag + 1))
    known = (F.col("no") - 1 - lag >= least) & (F.count(F.lit(1)).over(past) >= LEAST_REGIME_ROWS)
    return shares(rows.withColumn("__m", F.when(known, F.avg("ic").over(past))), "__m", "date").select("date", "factor", "w")


def weighted_scores(z: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ticker, score: the weighted sum of z over the factors that have weight; NULL where one of those is missing."""
    rows = z.join(weights, ["date", "factor"]).filter("w > 0")
    return rows.groupBy("date", "ticker").agg(F.when(F.count("z") == F.count("*"), F.sum(F.col("z") * F.col("w"))).alias("score"))


def select_factors(ic: DataFrame, ends: DataFrame, k: int = 5, least_ic: float = 0.0, least: int = 36, lag: int = 2) -> DataFrame:
    """fold, factor, ic of the k best mean ICs above least_ic, from dates up to each end (fold, end) less the last `lag`.

    All factors where fewer than `least` dates are left or none is above.
    """
    dates = ic.select("date").distinct().withColumn("no", F.row_number().over(Window.orderBy("date")))
    last = dates.join(ends, F.col("date") <= F.col("end")).groupBy("fold").agg((F.max("no") - lag).alias("upto"))
    past = Window.partitionBy("factor").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    means = ic.join(dates, "date").select("factor", "no", F.avg("ic").over(past).alias("ic"))  # one pass serves all ends
    rows = last.join(means, F.col("no") == F.col("upto")).withColumn("__r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last("ic"), "factor")))
    rows = rows.withColumn("__good", (F.col("upto") >= least) & (F.col("__r") <= k) & F.coalesce(F.col("ic") > least_ic, F.lit(False)))
    rows = rows.withColumn("__some", F.max("__good").over(Window.partitionBy("fold")))
    return rows.filter("__good OR NOT __some").select("fold", "factor", "ic")


def forward_selection(panel: DataFrame, factors: list[str], ends: DataFrame, k: int = 5, least_ic: float = 0.0, least: int = 36, lag: int = 2) -> DataFrame:
    """fold, step, factor, ic: for each fold (fold, end) factors picked one by one by the mean IC of what is left of them after
    regression on those picked, from dates up to the end less the last `lag`; so nothing after a fold's training counts.

    All factors (step 0) where fewer than `least` dates are left or none is above least_ic. panel: date, ticker, fwd and a
    column for each factor, of one scale. Folds that have picked the same factors share their ICs, and a round scores all
    candidates of all folds; the driver holds a row for each fold, step and factor.
    """
    spark = panel.sparkSession
    dates = panel.select("date").distinct().withColumn("no", F.row_number().over(Window.orderBy("date")))
    upto = {r.fold: r.n - lag for r in dates.join(ends, F.col("date") <= F.col("end")).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    picked: dict[int, list[str]] = {fold: [] for fold, n in upto.items() if n >= least}
    found, open_ = [], set(picked)
    while open_:
        groups: dict[tuple[str, ...], list[int]] = {}
        for fold in open_:
            groups.setdefault(tuple(picked[fold]), []).append(fold)
        scored = None
        for done, folds in groups.items():
            means = candidate_ics(panel, factors, list(done)).join(F.broadcast(dates), "date")
            last = spark.createDataFrame([(fold, upto[fold]) for fold in folds], "fold int, upto int")
            one = means.join(F.broadcast(last), F.col("no") <= F.col("upto")).groupBy("fold", "factor").agg(F.avg("ic").alias("ic"))
            scored = one if scored is None else scored.unionByName(one)
        first = Window.partitionBy("fold").orderBy(F.desc("ic"), "factor")
        best = scored.filter(F.col("ic") > least_ic).withColumn("__r", F.row_number().over(first)).filter("__r = 1").collect()
        for row in best:
            picked[row.fold].append(row.factor)
            found.append((row.fold, len(picked[row.fold]), row.factor, row.ic))
        open_ = {row.fold for row in best if len(picked[row.fold]) < min(k, len(factors))}
    every = [(r.fold, 0, f, None) for r in ends.collect() if not picked.get(r.fold) for f in factors]
    return spark.createDataFrame(found + every, "fold int, step int, factor string, ic double")


def candidate_ics(panel: DataFrame, factors: list[str], picked: list[str]) -> DataFrame:
    """date, factor, ic of every factor not picked: the rank IC of its residual on those picked, in one plan with the factor as a column.

    Dates with fewer than LEAST_NAMES complete names don't count once something is picked.
    """
    long = panel.unpivot(["date", "ticker", "fwd", *picked], [f for f in factors if f not in picked], "factor", "y").withColumn("key", F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "factor"))
    if picked:
        ok = F.col("y").isNotNull()
        for p in picked:
            ok = ok & F.col(p).isNotNull()
        long = long.filter(ok).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter(F.col("__n") >= LEAST_NAMES)
        long = neutral(long.withColumn("__all", F.lit(1)), "y", ["__all"], picked, by="key", out="left")
    else:
        long = long.withColumn("left", F.col("y"))
    rows = long.withColumn("left", F.round("left", 9)).withColumnRenamed("date", "__date").withColumnRenamed("key", "date")
    ics = rank_ic(rows.select("date", "ticker", "fwd", "left"), "left")
    return ics.join(rows.select("date", "__date", "factor").distinct(), "date").select(F.col("__date").alias("date"), "factor", "ic")
