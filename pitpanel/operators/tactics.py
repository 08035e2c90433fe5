"""Registered rotation strategies, evaluated together: a strategy is rows of a table, so one plan runs all of them.

Members say which asset has which part in which strategy; signals are made once for every observation lag that some
strategy needs. Choosing, cash substitution, costs, overlay and sleeves are windows and aggregates by strategy and month.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf, safe_div
from . import overfitting, rotation

#: Rows that each further sleeve observes earlier.
SLEEVE_DAYS = 5


@dataclass(frozen=True)
class Tactic:
    """A rotation strategy. `metric` (mom or ratio) ranks assets; `cash` stands in for defensive assets that are not above it;
    `static` weights are held whatever the signals. `overlay`: out of the market after months that the benchmark ends
    below its mean. `sleeves` observe signals SLEEVE_DAYS apart and share the capital."""

    name: str
    canary: tuple[str, ...] = ()
    offensive: tuple[str, ...] = ()
    defensive: tuple[str, ...] = ()
    top: int = 0
    top_defensive: int = 0
    metric: str = "ratio"
    cash: str | None = None
    static: tuple[tuple[str, float], ...] = ()
    overlay: bool = False
    sleeves: int = 1

    def __post_init__(self):
        if self.metric not in ("mom", "ratio"):
            raise ValueError(f"{self.name}: no metric {self.metric}")
        if not self.static and (min(self.top, self.top_defensive) < 1 or not self.offensive or not self.defensive):
            raise ValueError(f"{self.name}: needs static weights or assets to choose from")

    @property
    def needed(self) -> tuple[str, ...]:
        return tuple(sorted({*self.canary, *self.offensive, *self.defensive, *([self.cash] if self.cash else []), *(t for t, _ in self.static)}))

    def renamed(self, names: dict[str, str]) -> Tactic:
        """The same strategy over other assets."""
        of = lambda some: tuple(names[t] for t in some)
        return replace(self, canary=of(self.canary), offensive=of(self.offensive), defensive=of(self.defensive), cash=self.cash and names[self.cash], static=tuple((names[t], w) for t, w in self.static))


# The assets and rules of two published rotation methods (vigilant and bold asset allocation) and two static mixes.
_BOLD_CANARY = ("SPY", "EFA", "EEM", "AGG")
_BOLD_DEFENSIVE = ("TIP", "DBC", "BIL", "IEF", "TLT", "LQD", "AGG")
_BALANCED = ("SPY", "QQQ", "IWM", "VGK", "EWJ", "EEM", "VNQ", "DBC", "GLD", "TLT", "HYG", "LQD")
_AGGRESSIVE = Tactic("baa_agg", _BOLD_CANARY, ("QQQ", "EEM", "EFA", "AGG"), _BOLD_DEFENSIVE, 1, 3, cash="BIL")
_BALANCE = Tactic("baa_bal", _BOLD_CANARY, _BALANCED, _BOLD_DEFENSIVE, 6, 3, cash="BIL")
REGISTERED = (
    Tactic("spy", static=(("SPY", 1.0),)),
    Tactic("static_60_40", static=(("SPY", 0.6), ("IEF", 0.4))),
    Tactic("vaa_g4", ("SPY", "EFA", "EEM", "AGG"), ("SPY", "EFA", "EEM", "AGG"), ("LQD", "IEF", "SHY"), 1, 1, "mom"),
    _AGGRESSIVE,
    _BALANCE,
    replace(_AGGRESSIVE, name="baa_agg_ma", overlay=True),
    replace(_BALANCE, name="baa_bal_ma", overlay=True),
    replace(_BALANCE, name="baa_bal_tranche", sleeves=4),
    replace(_BALANCE, name="baa_bal_ma_tranche", overlay=True, sleeves=4),
)
BENCHMARK, BASELINE = "SPY", "static_60_40"
#: Limits of the verdict: worst drawdown, least probability of the deflated Sharpe ratio, most probability of over-fitting.
MDD_LIMIT, DSR_LIMIT, PBO_LIMIT = -0.20, 0.95, 0.5


def member_table(spark: SparkSession, tactics: tuple[Tactic, ...]) -> DataFrame:
    """One row per strategy and asset with its parts, and the strategy's rules beside."""
    if len({t.name for t in tactics}) != len(tactics):
        raise ValueError("two strategies have one name")
    rows = [
        (t.name, a, a in t.canary, a in t.offensive, a in t.defensive, a == t.cash, dict(t.static).get(a), bool(t.static), t.cash is not None, t.metric, t.top, t.top_defensive, len(t.needed), t.overlay, t.sleeves)
        for t in tactics for a in t.needed
    ]
    schema = "name string, ticker string, canary boolean, offensive boolean, defend boolean, is_cash boolean, static double, fixed boolean, has_cash boolean, metric string, top int, top_defensive int, needed int, overlay boolean, sleeves int"
    return spark.createDataFrame(rows, schema)


def observed(daily: DataFrame, sleeves: int) -> DataFrame:
    """ticker, date, sleeve, close: what sleeve k sees on a day, the close of k * SLEEVE_DAYS rows before; daily rows are dense."""
    w = Window.partitionBy("ticker").orderBy("date")
    seen = F.array(*[F.struct(F.lit(k).alias("sleeve"), (F.lag("close", k * SLEEVE_DAYS).over(w) if k else F.col("close")).alias("close")) for k in range(sleeves)])
    return daily.select("ticker", "date", seen.alias("s")).select("ticker", "date", F.inline("s"))


def _month(date: str = "date") -> Column:
    return F.year(date) * 12 + F.month(date)


def signals(seen: DataFrame) -> DataFrame:
    """ticker, sleeve, idx (month), close, mom, ratio, r (of the month after): month-end signals of every sleeve; r is of sleeve 0's closes."""
    m = seen.groupBy("ticker", "sleeve", _month().alias("idx")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"))
    w = Window.partitionBy("ticker", "sleeve").orderBy("idx")
    back = lambda n: F.lag("close", n).over(w)
    mom = sum((k * (safe_div(F.col("close"), back(n)) - 1) for k, n in ((12, 1), (4, 3), (2, 6), (1, 12))), F.lit(0.0))
    year = w.rowsBetween(-12, 0)
    ratio = F.when(F.count("close").over(year) == 13, safe_div(F.col("close"), F.avg("close").over(year)))
    m = m.select("ticker", "sleeve", "idx", "close", mom.alias("mom"), ratio.alias("ratio"), (safe_div(F.lead("close").over(w), F.col("close")) - 1).alias("r"))
    same = Window.partitionBy("ticker", "idx")
    return m.withColumn("r", F.max(F.when(F.col("sleeve") == 0, F.col("r"))).over(same))


def weights(signal: DataFrame, members: DataFrame) -> DataFrame:
    """name, sleeve, idx, ticker, w, defensive: of months in which every asset that a strategy needs has a momentum.

    Defensive when any canary's momentum is below zero. The best assets share equally (ties by ticker, those without a
    metric last); a defensive one that is not above the cash asset gives its share to it.
    """
    rows = signal.join(F.broadcast(members), "ticker").filter("sleeve < sleeves")
    month = Window.partitionBy("name", "sleeve", "idx")
    rows = rows.withColumn("complete", F.count("mom").over(month) == F.col("needed")).filter("complete")
    rows = rows.withColumn("score", F.when(F.col("metric") == "mom", F.col("mom")).otherwise(F.col("ratio")))
    rows = rows.withColumn("defensive", F.coalesce(F.bool_or(F.when(F.col("canary"), F.col("mom") < 0)).over(month), F.lit(False)))
    rows = rows.withColumn("cash_score", F.max(F.when(F.col("is_cash"), F.col("score"))).over(month)).withColumn("cash_name", F.max(F.when(F.col("is_cash"), F.col("ticker"))).over(month))
    pool = F.when(F.col("fixed"), F.col("static").isNotNull()).otherwise(F.when(F.col("defensive"), F.col("defend")).otherwise(F.col("offensive")))
    rows = rows.filter(pool).withColumn("place", F.row_number().over(month.orderBy(F.desc_nulls_last("score"), "ticker")))
    rows = rows.filter(F.col("fixed") | (F.col("place") <= F.when(F.col("defensive"), F.col("top_defensive")).otherwise(F.col("top"))))
    share = F.coalesce("static", 1 / F.count(F.lit(1)).over(month))
    kept = ~(F.col("defensive") & F.col("has_cash") & ~F.col("fixed")) | F.coalesce(F.col("score") > F.col("cash_score"), F.lit(False))
    rows = rows.select("name", "sleeve", "idx", F.when(kept, F.col("ticker")).otherwise(F.col("cash_name")).alias("ticker"), share.alias("w"), "defensive")
    return rows.groupBy("name", "sleeve", "idx", "ticker").agg(F.sum("w").alias("w"), F.first("defensive").alias("defensive"))


def sleeve_returns(held: DataFrame, signal: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """name, sleeve, idx (month of the return), ret, turnover, defensive; cost on what weights change from the strategy's month before.

    The last month of the panel has no month after and gives no row; a held asset without a return in any other is an error.
    """
    end = signal.agg((F.max("idx")).alias("end"))
    rows = held.join(F.broadcast(end), F.col("idx") < F.col("end")).join(signal.filter("sleeve = 0").select("ticker", "idx", "r"), ["ticker", "idx"], "left")
    r = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.col("name"), F.lit(": no return of "), F.col("ticker")))).otherwise(F.col("r"))
    months = rows.select("name", "sleeve", "idx").distinct().withColumn("no", F.row_number().over(Window.partitionBy("name", "sleeve").orderBy("idx")))
    rows = rows.withColumn("r", r.cast("double")).join(months, ["name", "sleeve", "idx"])
    now = rows.select("name", "sleeve", "no", "ticker", "w", (F.col("w") * F.col("r")).alias("gross"), "idx", "defensive", F.lit(0.0).alias("old"))
    old = rows.select("name", "sleeve", (F.col("no") + 1).alias("no"), "ticker", F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("gross"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("boolean").alias("defensive"), F.col("w").alias("old"))
    change = now.unionByName(old).groupBy("name", "sleeve", "no", "ticker").agg(F.abs(F.sum("w") - F.sum("old")).alias("moved"), F.sum("gross").alias("gross"), F.max("idx").alias("idx"), F.bool_or("defensive").alias("defensive"))
    month = change.groupBy("name", "sleeve", "no").agg(F.sum("moved").alias("turnover"), F.sum("gross").alias("gross"), F.max("idx").alias("idx"), F.bool_or("defensive").alias("defensive")).filter("idx IS NOT NULL")
    return month.select("name", "sleeve", (F.col("idx") + 1).alias("idx"), (F.col("gross") - F.col("turnover") * cost_bps / 1e4).alias("ret"), "turnover", "defensive")


def invested(seen: DataFrame, benchmark: str, days: int = 200) -> DataFrame:
    """sleeve, idx, invested: whether the benchmark's last observation of the month before lies above its mean of `days` rows."""
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(-(days - 1), 0)
    rows = seen.filter(F.col("ticker") == benchmark)
    above = (F.count("close").over(w) == days) & (F.col("close") > F.avg("close").over(w))
    rows = rows.select("sleeve", "date", F.coalesce(above, F.lit(False)).alias("above"))
    return rows.groupBy("sleeve", (_month() + 1).alias("idx")).agg(F.max_by("above", "date").alias("invested"))


def returns(daily: DataFrame, tactics: tuple[Tactic, ...] = REGISTERED, benchmark: str = BENCHMARK, cost_bps: float = 10.0) -> DataFrame:
    """name, idx, ret, defensive (share of its sleeves' months): every strategy's monthly returns from daily (ticker, date, close).

    daily has a row for every asset and day. The overlay is applied to each sleeve before sleeves are averaged; months
    that not all sleeves of a strategy have are left out, but count in its defensive share.
    """
    members = member_table(daily.sparkSession, tactics)
    seen = observed(daily.join(F.broadcast(members.select("ticker").union(daily.sparkSession.createDataFrame([(benchmark,)], "ticker string")).distinct()), "ticker"), max(t.sleeves for t in tactics))
    signal = signals(seen)
    rows = sleeve_returns(weights(signal, members), signal, cost_bps)
    rows = rows.join(F.broadcast(members.select("name", "overlay", "sleeves").distinct()), "name").join(invested(seen, benchmark), ["sleeve", "idx"], "left")
    rows = rows.withColumn("ret", F.when(F.col("overlay") & ~F.coalesce("invested", F.lit(True)), 0.0).otherwise(F.col("ret")))
    rows = rows.withColumn("__share", F.avg(F.col("defensive").cast("double")).over(Window.partitionBy("name", "sleeve")))
    rows = rows.withColumn("__part", F.col("__share") / F.count(F.lit(1)).over(Window.partitionBy("name", "sleeve")) / F.col("sleeves"))
    rows = rows.withColumn("defensive", F.sum("__part").over(Window.partitionBy("name")))
    months = rows.groupBy("name", "idx").agg(F.avg("ret").alias("ret"), F.first("defensive").alias("defensive"), (F.count(F.lit(1)) == F.first("sleeves")).alias("whole"))
    return months.filter("whole").drop("whole")


def evaluated(months: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(metrics, rows of the common window): growth, drawdown, Calmar, Sharpe and the deflated Sharpe probability over the months that all n have."""
    common = rotation.common_window(months, n)
    figures = rotation.summary(common)
    luck = overfitting.deflated_sharpe(common.withColumnRenamed("ret", "r"), n, None, "name").select("name", F.col("probability").alias("dsr"))
    share = months.groupBy("name").agg(F.max("defensive").alias("defensive"))
    return figures.join(luck, "name").join(share, "name"), common


def matrix(common: DataFrame) -> DataFrame:
    """period (from 0), config, r: the common window as the over-fitting statistics take it."""
    number = common.select("idx").distinct().withColumn("period", F.row_number().over(Window.orderBy("idx")) - 1)
    return common.join(F.broadcast(number), "idx").select("period", F.col("name").alias("config"), F.col("ret").alias("r"))


def verdict(metrics: DataFrame, pbo: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """name, adopted, reasons: limits that a strategy fails, of pbo, mdd, dsr and calmar (not above the baseline's; not asked of itself)."""
    line = metrics.filter(F.col("name") == baseline).select(F.col("calmar").alias("line"))
    rows = metrics.crossJoin(F.broadcast(line)).crossJoin(F.broadcast(pbo.select("pbo")))
    fails = {
        "pbo": F.col("pbo") > PBO_LIMIT, "mdd": F.col("mdd") < MDD_LIMIT, "dsr": F.col("dsr") < DSR_LIMIT, "calmar": (F.col("name") != baseline) & (F.col("calmar") <= F.col("line")),
    }
    reasons = F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in fails.items()])
    return rows.select("name", (reasons == "").alias("adopted"), reasons.alias("reasons"))


def search_cost(daily: DataFrame, blocks: tuple[int, ...] = (8, 10, 12, 16)) -> DataFrame:
    """frequency, measure, config, blocks, value, passed: what having tried so many configurations costs.

    daily: config, date, r. Only dates that all configurations have count (measure `rows`, and `dropped` for the others).
    By day and compounded by month: the probability of over-fitting over all choices of half the blocks (`pbo`, passed
    below PBO_LIMIT) and each configuration's deflated Sharpe probability (`dsr`, passed from DSR_LIMIT on).
    """
    n = daily.select("config").distinct().count()
    rows = daily.filter("r IS NOT NULL").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    common = rows.filter(F.col("__n") == n).drop("__n")
    kept, every = common.select("date").distinct().count(), daily.select("date").distinct().count()
    month = common.groupBy("config", F.last_day("date").alias("date")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    columns = ["frequency", "measure", "config", "blocks", "value", "passed"]
    out = daily.sparkSession.createDataFrame([("daily", "rows", None, None, float(kept), None), ("daily", "dropped", None, None, float(every - kept), None)], "frequency string, measure string, config string, blocks int, value double, passed boolean")
    for frequency, frame in (("daily", common), ("monthly", month)):
        number = frame.select("date").distinct().withColumn("period", F.row_number().over(Window.orderBy("date")) - 1)
        trials = frame.join(F.broadcast(number), "date").select("period", "config", "r")
        for b in blocks:
            pbo = overfitting.overfitting_share(overfitting.backtest_overfitting(trials, b))
            out = out.unionByName(pbo.select(F.lit(frequency).alias("frequency"), F.lit("pbo").alias("measure"), F.lit(None).cast("string").alias("config"), F.lit(b).alias("blocks"), F.col("pbo").alias("value"), (F.col("pbo") < PBO_LIMIT).alias("passed")))
        luck = overfitting.deflated_sharpe(trials, n, None, "config")
        out = out.unionByName(luck.select(F.lit(frequency).alias("frequency"), F.lit("dsr").alias("measure"), "config", F.lit(None).cast("int").alias("blocks"), F.col("probability").alias("value"), (F.col("probability") >= DSR_LIMIT).alias("passed")))
    return out.select(*columns)
