"""Operators across names on one date: winsorising, scores, ranks, buckets, neutralisation, composites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, clipped, normal_quantile, percent_rank, safe_div


def winsor(v: str, p: float, by: str = "date") -> Column:
    """Clipped to the quantiles p and 1 - p of the date (linear interpolation)."""
    w = Window.partitionBy(by)
    return clipped(F.col(v), F.percentile(v, F.lit(p)).over(w), F.percentile(v, F.lit(1 - p)).over(w)) if p else F.col(v)


def zscore(v: str, *by: str) -> Column:
    w = Window.partitionBy(*(by or ("date",)))
    return safe_div(F.col(v) - F.avg(v).over(w), F.stddev_pop(v).over(w))


def rank(v: str, *by: str) -> Column:
    """Average rank over the number of values; with a group, NULL groups give NULL."""
    keys = by or ("date",)
    known = F.lit(True)
    for k in keys[1:]:
        known = known & F.col(k).isNotNull()
    return F.when(known, percent_rank(F.col(v), *keys))


def bucket(v: str, n: int, by: str = "date") -> Column:
    """1 to n by percent rank."""
    return F.ceil(percent_rank(F.col(v), by) * n).cast("int")


def rank_normalised(v: str, by: str = "date") -> Column:
    count = F.count(v).over(Window.partitionBy(by))
    p = percent_rank(F.col(v), by) - 0.5 / count
    return F.when(F.col(v).isNotNull(), normal_quantile(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))))


def neutral_groups(v: Column | str, group: str, by: str = "date") -> Column:
    """Residual on group dummies: the distance to the group's mean; needs as many complete rows as groups and two.

    A mean of doubles depends on the order of the rows in its last bit; of decimals it does not.
    """
    v = F.col(v) if isinstance(v, str) else v
    w = Window.partitionBy(by)
    complete = v.isNotNull() & F.col(group).isNotNull()
    groups = F.size(F.collect_set(F.when(complete, F.col(group))).over(w))
    value = F.when(complete, v)
    enough = F.count(value).over(w) >= groups + 1
    return F.when(complete & enough, v - F.avg(value).over(Window.partitionBy(by, group)))


def neutral_groups_and_size(panel: DataFrame, v: str, group: str, size: str, by: str = "date", out: str = "neutral") -> DataFrame:
    """Residual on group dummies and log size: both are centred by group, then one slope per date (Frisch-Waugh)."""
    ok = F.col(v).isNotNull() & F.col(group).isNotNull() & (F.col(size) > 0)
    inside, whole = Window.partitionBy(by, group), Window.partitionBy(by)
    rows = panel.withColumn("__y", F.when(ok, F.col(v))).withColumn("__x", F.when(ok, F.ln(size)))
    rows = rows.withColumn("__y", F.col("__y") - F.avg("__y").over(inside)).withColumn("__x", F.col("__x") - F.avg("__x").over(inside))
    slope = safe_div(F.sum(F.col("__x") * F.col("__y")).over(whole), F.sum(F.col("__x") * F.col("__x")).over(whole))
    groups = F.size(F.collect_set(F.when(ok, F.col(group))).over(whole))
    enough = F.count("__y").over(whole) >= groups + 2
    return rows.withColumn(out, F.when(enough, F.col("__y") - F.coalesce(slope, F.lit(0.0)) * F.col("__x"))).drop("__y", "__x")


def neutral(panel: DataFrame, v: str, groups: list[str], controls: list[str], by: str = "date", out: str = "neutral") -> DataFrame:
    """Residual of least squares on an intercept, dummies of several groupings and controls, date by date.

    The first grouping is taken out by its means (Frisch-Waugh), the others become 0/1 columns (their values are few and
    read first). Each date's normal equations are sums, so only that small system is solved in Python.
    """
    first, *others = groups
    dummies = [(g, x) for g in others for x in sorted(r[0] for r in panel.select(g).filter(F.col(g).isNotNull()).distinct().collect())[1:]]
    xs = [F.col(c).cast("double") for c in controls] + [(F.col(g) == x).cast("double") for g, x in dummies]
    known = F.col(v).isNotNull()
    for c in [*groups, *controls]:
        known = known & F.col(c).isNotNull()
    inside = Window.partitionBy(by, first)
    names = ["__y", *[f"__x{k}" for k in range(len(xs))]]
    rows = panel.withColumns({name: F.when(known, x) for name, x in zip(names, [F.col(v).cast("double"), *xs], strict=True)})
    rows = rows.withColumns({name: F.col(name) - F.avg(name).over(inside) for name in names})
    pairs = [(i, j) for i in range(len(names)) for j in range(max(i, 1), len(names))]
    sums = rows.groupBy(by).agg(
        (F.count("__y") >= F.count_distinct(first) + len(xs) + 1).alias("__enough"), F.array(*[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j])), F.lit(0.0)) for i, j in pairs]).alias("__sums")
    )

    def solve(batches):
        for batch in batches:
            found = []
            for values in batch["__sums"]:
                m = np.zeros((len(names), len(names)))
                for (i, j), x in zip(pairs, values, strict=True):
                    m[i, j] = m[j, i] = x
                scale = np.sqrt(np.where(np.diag(m)[1:] > 0, np.diag(m)[1:], 1.0))
                found.append((np.linalg.lstsq(m[1:, 1:] / np.outer(scale, scale), m[0, 1:] / scale, rcond=None)[0] / scale).tolist())
            yield pd.DataFrame({"__by": batch["__by"], "__enough": batch["__enough"], "__slopes": found})

    solved = sums.withColumnRenamed(by, "__by").mapInPandas(solve, f"__by {dict(panel.dtypes)[by]}, __enough boolean, __slopes array<double>")
    rows = rows.join(solved, F.col(by).eqNullSafe(F.col("__by")))
    fitted = sum((F.col(name) * F.col("__slopes")[k] for k, name in enumerate(names[1:])), F.lit(0.0))
    return rows.withColumn(out, F.when(F.col("__enough"), F.col("__y") - fitted)).select(*panel.columns, out)


def composite(scores: DataFrame, weights: dict[str, float], coverage: float = 0.5, by: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """scores (by, factor, z) -> score: the weighted mean of what is there; NULL under the coverage of all weights."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("factor")].cast("double")
    rows = scores.withColumn("__w", weight).filter("__w IS NOT NULL")
    total = float(sum(abs(w) for w in weights.values()))
    here = F.sum(F.when(F.col("z").isNotNull(), F.abs("__w")))
    return rows.groupBy(*by).agg(F.when(here >= coverage * total, F.sum(F.col("z") * F.col("__w")) / here).alias("score"))


def composite_by_category(scores: DataFrame, category: dict[str, str], weights: dict[str, float], coverage: float = 0.5) -> DataFrame:
    """Equal weights within a category, then weights across categories."""
    name = F.create_map(*[F.lit(x) for kv in category.items() for x in kv])[F.col("factor")]
    inner = scores.withColumn("__c", name).groupBy("date", "ticker", "__c").agg(F.count("*").alias("__n"), F.count("z").alias("__k"), F.avg("z").alias("__z"))
    inner = inner.select("date", "ticker", F.col("__c").alias("factor"), F.when(F.col("__k") >= coverage * F.col("__n"), F.col("__z")).alias("z"))
    return composite(inner, weights, coverage)


def rank_ic(pairs: DataFrame, score: str = "score", fwd: str = "fwd", least: int = 20) -> DataFrame:
    """date, ic, names: rank correlation of score and forward return over names that have both; NULL under `least` names."""
    rows = pairs.filter(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    rows = rows.select("date", average_rank(F.col(score), "date").alias("__a"), average_rank(F.col(fwd), "date").alias("__b"))
    varied = (F.stddev_pop("__a") > 0) & (F.stddev_pop("__b") > 0)
    return rows.groupBy("date").agg(F.count("*").alias("names"), F.when((F.count("*") >= least) & varied, F.corr("__a", "__b")).alias("ic"))


def ic_summary(ic: DataFrame, horizon: int = 1, *by: str) -> DataFrame:
    """mean, std, ratio, t with the effective number of observations n / horizon (2 at least), hit rate, n."""
    n, mean, sd = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    ratio = safe_div(mean, sd)
    t = ratio * F.sqrt(F.greatest(n / F.lit(float(horizon)), F.lit(2.0)))
    return ic.groupBy(*by).agg(mean.alias("mean_ic"), sd.alias("std_ic"), ratio.alias("ic_ir"), t.alias("t"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("hit_rate"), n.alias("n"))


def quantile_returns(pairs: DataFrame, n: int = 5, score: str = "score", fwd: str = "fwd", least: int = 20) -> DataFrame:
    """date, q, ret, names: mean forward return of each bucket with at least `least` // n names."""
    rows = pairs.filter(F.col(score).isNotNull() & F.col(fwd).isNotNull()).withColumn("q", bucket(score, n))
    return rows.groupBy("date", "q").agg(F.avg(fwd).alias("ret"), F.count("*").alias("names")).filter(F.col("names") >= least // n)


def quantile_report(returns: DataFrame, n: int = 5, horizon: int = 1, *by: str) -> DataFrame:
    """One row (by group): top less bottom bucket (mean, t) and the rank correlation of bucket and mean return."""
    spread = returns.groupBy(*by, "date").agg((F.max(F.when(F.col("q") == n, F.col("ret"))) - F.max(F.when(F.col("q") == 1, F.col("ret")))).alias("s"))
    sd, k = F.stddev_samp("s"), F.count("s")
    spread = spread.groupBy(*by).agg(F.avg("s").alias("spread"), (safe_div(F.avg("s"), sd) * F.sqrt(F.greatest(k / F.lit(float(horizon)), F.lit(2.0)))).alias("spread_t"))
    means = returns.groupBy(*by, "q").agg(F.avg("ret").alias("m"))
    means = means.select(*by, F.col("q").cast("double").alias("q"), average_rank(F.col("m"), *(by or (F.lit(1),))).alias("r")).groupBy(*by).agg(F.corr("q", "r").alias("monotonicity"))
    return spread.join(means, list(by)) if by else spread.crossJoin(means)


#: What a factor has to reach to be promoted: t of the spread, monotonicity, and most turnover of its ranks.
PROMOTION = (2.0, 0.6, 0.15)


def lab(pairs: DataFrame, n: int = 10, horizon: int = 1) -> DataFrame:
    """factor, ic, ic_ir, spread, spread_t, monotonicity, turnover, coverage, promoted of pairs (date, ticker, factor, z, fwd), best spread_t first.

    All factors in one plan, the factor being a column. Turnover is the mean change of a name's percent rank from one date
    to the next, averaged by name first; coverage is the share of names and dates that have a value.
    """
    key = pairs.withColumn("__day", F.col("date")).withColumn("date", F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "factor"))
    days = key.select("date", "factor").distinct()
    ics = rank_ic(key, "z").join(days, "date").groupBy("factor").agg(F.avg("ic").alias("ic"), safe_div(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"))
    report = quantile_report(quantile_returns(key, n, "z").join(days, "date"), n, horizon, "factor")
    ranks = key.withColumn("__p", percent_rank(F.col("z"), "date"))
    moved = ranks.withColumn("__m", F.abs(F.col("__p") - F.lag("__p").over(Window.partitionBy("factor", "ticker").orderBy("__day"))))
    turnover = moved.groupBy("factor", "ticker").agg(F.avg("__m").alias("m")).groupBy("factor").agg(F.avg("m").alias("turnover"))
    coverage = pairs.groupBy("factor").agg((F.count("z") / F.count("*")).alias("coverage"))
    rows = ics.join(report, "factor").join(turnover, "factor").join(coverage, "factor")
    least_t, least_mono, most = PROMOTION
    promoted = (F.abs("spread_t") >= least_t) & (F.col("monotonicity") >= least_mono) & (F.col("turnover") <= most)
    return rows.withColumn("promoted", F.coalesce(promoted, F.lit(False))).orderBy(F.desc(F.abs("spread_t")), "factor")


def membership_turnover(members: DataFrame) -> DataFrame:
    """date, turnover: share of a date's members (idx, ticker) that were none on the date before that has any."""
    order = members.select("date", "idx").distinct().withColumn("no", F.row_number().over(Window.orderBy("idx")))
    rows = members.join(F.broadcast(order.drop("idx")), "date")
    before = rows.select((F.col("no") + 1).alias("no"), "ticker", F.lit(1).alias("__old"))
    return rows.join(before, ["no", "ticker"], "left").filter("no > 1").groupBy("date").agg((1 - F.count("__old") / F.count("*")).alias("turnover"))
