"""Queries over the star-schema tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, fixed, normal_quantile, percent_rank, safe_div, significant_all
from ..operators import backtest, crosssection, overfitting, portfolio, research, risk, rotation, search, store, universe
from ..operators import timeseries as ts
from ..operators.asof import as_of
from ..sources import panels
from . import catalog
from .expr import Tables, across, compile_all, fields, used
from .factor_sql import Grid, factor_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, places: int | None = None) -> DataFrame:
    """Doubles to six significant digits or a number of places, since sums depend on the order of their terms."""
    if places is not None:
        return df.select(*[fixed(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return significant_all(df)


def query(name: str, sql: str | None = None, places: int | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with panels.shared():
                return rounded(fn(spark, sf_dir), places)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def r(x: str, places: int | None = None) -> str:
    """SQL of `rounded`."""
    if places is not None:
        return f"floor(({x}) * 1e{places} + 0.501) / 1e{places}"
    k = "CAST(least(5 - floor(log10(abs(v))), 10) AS INT)"
    each = f"CASE WHEN v IS NULL OR v = 0 OR abs(v) > 1e18 THEN v WHEN {k} >= 0 THEN floor(v * pow(10.0, {k}) + 0.501) / pow(10.0, {k}) ELSE floor(v / pow(10.0, -{k}) + 0.501) * pow(10.0, -{k}) END"
    return f"list_transform([CAST(({x}) AS DOUBLE)], lambda v: {each})[1]"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) END)"


def normal(p: str) -> str:
    """SQL of the normal quantile: Newton steps on a rational start, with the distribution function by its series."""
    start = "CASE WHEN p < 0.5 THEN -1 ELSE 1 END * list_transform([sqrt(-2 * ln(least(p, 1 - p)))], lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))[1]"
    cdf = f"(0.5 + list_reduce(list_prepend({{t: z, s: z, x: z}}, list_transform(range(1, 80), lambda n: {{t: 0.0 + n, s: 0.0, x: 0.0}})), lambda a, b: {{t: a.t * a.x * a.x / (2 * b.t + 1), s: a.s + a.t * a.x * a.x / (2 * b.t + 1), x: a.x}}).s * exp(-z * z / 2) / sqrt(2 * pi()))"
    step = f"list_reduce([{start}, 0.0, 0.0, 0.0, 0.0, 0.0], lambda z, o: z - ({cdf} - p) * sqrt(2 * pi()) * exp(z * z / 2))"
    return f"list_transform([CAST(({p}) AS DOUBLE)], lambda p: {step})[1]"


DAILY = """WITH li AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q, max(l_extendedprice / l_quantity) AS u
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM li)),
p AS (
  SELECT t.ticker, c.date, CAST(c.idx AS INT) AS idx, floor(round(v, 2) / q * 1e4 + 0.501) / 1e4 AS close, floor(u * 1e4 + 0.501) / 1e4 AS closeunadj, q AS volume, round(v, 2) AS mcap
  FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM li) t LEFT JOIN li ON li.ticker = t.ticker AND li.date = c.date
)"""
MONTHLY = """WITH li AS (
  SELECT 'S' || l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2
), p AS (
  SELECT t.ticker, c.date, CAST(year(c.date) * 12 + month(c.date) AS INT) AS idx, floor(round(v, 2) / q * 1e4 + 0.501) / 1e4 AS close, q AS volume, round(v, 2) AS mcap
  FROM (SELECT DISTINCT date FROM li) c CROSS JOIN (SELECT DISTINCT ticker FROM li) t LEFT JOIN li ON li.ticker = t.ticker AND li.date = c.date
)"""
_FIELDS = ", ".join(f"floor(({a} * revenue + {b} * netinc + {c} * quantity) * 1e2 + 0.501) / 1e2 AS {name}" for name, (a, b, c) in panels.FIELDS.items())
FILINGS = f"""WITH fl AS (
  SELECT l_suppkey, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS calendardate, floor(sum(l_extendedprice * (1 - l_discount)) * 1e2 + 0.501) / 1e2 AS revenue,
         floor(sum(l_extendedprice * (1 - l_discount) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * 1e2 + 0.501) / 1e2 AS netinc, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY 1, 2
), fr AS (
  SELECT 'S' || l_suppkey AS ticker, calendardate, CAST(calendardate + CAST(45 + l_suppkey % 20 AS INT) AS DATE) AS datekey, revenue, netinc, {_FIELDS} FROM fl
), f AS (
  SELECT t.ticker, c.calendardate, CAST(year(c.calendardate) * 4 + quarter(c.calendardate) AS INT) AS idx, fr.* EXCLUDE (ticker, calendardate)
  FROM (SELECT DISTINCT calendardate FROM fr) c CROSS JOIN (SELECT DISTINCT ticker FROM fr) t LEFT JOIN fr ON fr.ticker = t.ticker AND fr.calendardate = c.calendardate
)"""
META = """meta AS (SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry, n_name AS location, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BENCH = """b AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS idx, floor(round(v, 2) / q * 1e4 + 0.501) / 1e4 AS close
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1))"""
W1 = "(PARTITION BY ticker ORDER BY idx)"
RET = f", pr AS (SELECT *, {div('close', 'lag(close) OVER ' + W1)} - 1 AS r FROM p)"


def rows(n: int, part: str = "PARTITION BY ticker") -> str:
    return f"({part} ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# sources

query("src_daily_prices", f"{DAILY} SELECT ticker, date, idx, {r('close')} AS close, {r('closeunadj')} AS closeunadj, {r('volume')} AS volume, {r('mcap')} AS mcap FROM p")(panels.daily_prices)
query("src_monthly_prices", f"{MONTHLY} SELECT ticker, date, idx, {r('close')} AS close, {r('volume')} AS volume, {r('mcap')} AS mcap FROM p")(panels.monthly_prices)
query(
    "src_filings",
    f"{FILINGS} SELECT ticker, calendardate, idx, datekey, {r('revenue')} AS revenue, {r('netinc')} AS netinc, {r('gp')} AS gp, {r('assets')} AS assets, {r('equity')} AS equity FROM f",
)(lambda s, d: panels.filings(s, d).select("ticker", "calendardate", "idx", "datekey", "revenue", "netinc", "gp", "assets", "equity"))
query(
    "src_holdings",
    """SELECT 'S' || l_suppkey AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS calendardate, sum(l_quantity) AS inst_shares,
       CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS inst_holders,
       CAST(last_day(CAST(date_trunc('quarter', any_value(l_shipdate)) + INTERVAL 2 MONTH AS DATE)) + 75 AS DATE) AS inst_date FROM lineitem GROUP BY 1, 2""",
)(panels.holdings)
query("src_descriptions", f"WITH {META} SELECT ticker, sector, industry, location, name FROM meta")(panels.descriptions)
query("src_benchmark", f"WITH {BENCH} SELECT date, idx, {r('close')} AS close FROM b")(panels.benchmark)


@query(
    "src_insider_quarters",
    """SELECT 'C' || o_custkey AS ticker, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS calendardate,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice), 2) AS shares,
       CAST(last_day(CAST(date_trunc('quarter', any_value(o_orderdate)) + INTERVAL 2 MONTH AS DATE)) + 3 AS DATE) AS datekey FROM orders GROUP BY 1, 2""",
    places=2,
)
def insider_quarters(spark, sf_dir):
    return store.quarterly_transactions(panels.transactions(spark, sf_dir), panels.quarter_end)


# windows along days: name -> (column over the daily panel with r, SQL over pr)

_SQ = "sqrt(252.0)"


def _roll(fn: str, v: str, n: int, least: int | None = None) -> str:
    least = max(2, n // 2) if least is None else least
    return f"CASE WHEN count({v}) OVER {rows(n)} >= {least} THEN {fn}({v}) OVER {rows(n)} END"


_DAYS = {
    "w_lag": (lambda: ts.lag("close", 5), f"lag(close, 5) OVER {W1}"),
    "w_accel": (lambda: F.col("close") - ts.lag("close", 10), f"close - lag(close, 10) OVER {W1}"),
    "w_momentum": (lambda: ts.momentum("close", 21), f"{div('close', f'lag(close, 21) OVER {W1}')} - 1"),
    "w_momentum_skip": (lambda: ts.momentum("close", 252, 21), f"{div(f'lag(close, 21) OVER {W1}', f'lag(close, 252) OVER {W1}')} - 1"),
    "w_rolling_mean": (lambda: ts.rolling("close", 63), _roll("avg", "close", 63)),
    "w_rolling_std": (lambda: ts.rolling("close", 21, "std"), _roll("stddev_samp", "close", 21)),
    "w_rolling_sum": (lambda: ts.rolling("volume", 21, "sum"), _roll("sum", "volume", 21)),
    "w_rolling_min": (lambda: ts.rolling("close", 21, "min"), _roll("min", "close", 21)),
    "w_rolling_max": (lambda: ts.rolling("close", 21, "max"), _roll("max", "close", 21)),
    "w_change": (lambda: ts.change("close", 5), f"{div('close', f'lag(close, 5) OVER {W1}')} - 1"),
    "w_downside_std": (lambda: ts.downside_std("r", 60), _roll("stddev_samp", "CASE WHEN r < 0 THEN r END", 60, 15)),
    "w_sharpe": (lambda: ts.sharpe("r", 60), f"{div(_roll('avg', 'r', 60), _roll('stddev_samp', 'r', 60))} * {_SQ}"),
    "w_sortino": (lambda: ts.sortino("r", 60), f"{div(_roll('avg', 'r', 60), _roll('stddev_samp', 'CASE WHEN r < 0 THEN r END', 60, 15))} * {_SQ}"),
    "w_forward_return": (lambda: ts.forward_return("close", 21), f"{div(f'lead(close, 22) OVER {W1}', f'lead(close, 1) OVER {W1}')} - 1"),
    "w_volatility": (lambda: ts.rolling("r", 60, "std") * F.sqrt(F.lit(252.0)), f"({_roll('stddev_samp', 'r', 60)}) * {_SQ}"),
    "w_volatility_target": (
        lambda: ts.volatility_target("r", 0.15, 63, 0.0, 1.0, "ticker"),
        f"coalesce(greatest(least({div('0.15', '(' + _roll('stddev_samp', 'r', 63, 63) + f') * {_SQ}')}, CASE WHEN count(r) OVER {rows(63)} >= 63 THEN 1.0 END), CASE WHEN count(r) OVER {rows(63)} >= 63 THEN 0.0 END), 1.0)",
    ),
    "w_log_return": (lambda: F.ln(safe_div(F.col("close"), ts.lag("close", 1))), f"ln({div('close', f'lag(close) OVER {W1}')})"),
    "w_traded": (lambda: universe.traded(), _roll("avg", "volume * close", 20, 5)),
    "w_older_momentum": (
        lambda: rotation.row_momentum(),
        " + ".join(f"{100 * k} * ({div('close', f'lag(close, {n}) OVER {W1}')} - 1)" for k, n in ((12, 21), (4, 63), (2, 126), (1, 252))),
    ),
}


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", ts.change("close", 1))


for _name, (_make, _sql) in _DAYS.items():
    query(_name, f"{DAILY}{RET} SELECT ticker, date, {r(_sql)} AS value FROM pr")(
        lambda s, d, make=_make: with_returns(panels.daily_prices(s, d)).select("ticker", "date", make().alias("value"))
    )

query("w_change_padded", f"{DAILY}, x AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT ticker, date, {r(div('c', f'lag(c) OVER {W1}') + ' - 1')} AS value FROM x")(
    lambda s, d: panels.daily_prices(s, d).select("ticker", "date", ts.change("close", 1, pad=True).alias("value"))
)

# windows along quarters

_QUARTERS = {
    "w_ttm": (lambda: ts.ttm("revenue"), _roll("sum", "revenue", 4, 4)),
    "w_qoq": (lambda: ts.growth("revenue", 1), div(f"revenue - lag(revenue) OVER {W1}", f"abs(lag(revenue) OVER {W1})")),
    "w_yoy": (lambda: ts.growth("netinc", 4), div(f"netinc - lag(netinc, 4) OVER {W1}", f"abs(lag(netinc, 4) OVER {W1})")),
    "w_quarterly_std": (lambda: ts.rolling("netinc", 8, "std", 4), _roll("stddev_samp", "netinc", 8, 4)),
    "w_average_balance": (lambda: (F.col("assets") + ts.lag("assets", 1)) / 2, f"(assets + lag(assets) OVER {W1}) / 2"),
    "p_safe_division": (lambda: safe_div(F.col("netinc"), F.col("revenue")), div("netinc", "revenue")),
    "p_predicate": (lambda: F.when(F.col("netinc").isNotNull(), (F.col("netinc") > 0).cast("double")), "CASE WHEN netinc IS NOT NULL THEN CAST(netinc > 0 AS INT)::DOUBLE END"),
    "p_increased": (
        lambda: F.when((F.col("netinc") - ts.lag("netinc", 4)).isNotNull(), (F.col("netinc") - ts.lag("netinc", 4) > 0).cast("double")),
        f"CASE WHEN netinc - lag(netinc, 4) OVER {W1} IS NOT NULL THEN CAST(netinc - lag(netinc, 4) OVER {W1} > 0 AS INT)::DOUBLE END",
    ),
}
for _name, (_make, _sql) in _QUARTERS.items():
    query(_name, f"{FILINGS} SELECT ticker, calendardate, {r(_sql)} AS value FROM f")(
        lambda s, d, make=_make: panels.filings(s, d).select("ticker", "calendardate", make().alias("value"))
    )


@query(
    "w_beta",
    f"""{DAILY}{RET}, {BENCH}, m AS (SELECT idx, {div('close', 'lag(close) OVER (ORDER BY idx)')} - 1 AS m FROM b),
ms AS (SELECT idx, m, CASE WHEN count(m) OVER {rows(60, '')} >= 30 THEN stddev_samp(m) OVER {rows(60, '')} END AS s FROM m),
x AS (SELECT pr.ticker, pr.date, pr.idx, pr.r, ms.m, ms.s FROM pr LEFT JOIN ms USING (idx))
SELECT ticker, date, {r(div(f'CASE WHEN count(r * m) OVER {rows(60)} >= 30 THEN covar_samp(r, m) OVER {rows(60)} END', 's * s'))} AS value FROM x""",
)
def w_beta(spark, sf_dir):
    market = panels.benchmark(spark, sf_dir).withColumn("r", ts.safe_div(F.col("close"), ts.lag("close", 1, F.lit(1))) - 1)
    return ts.beta(with_returns(panels.daily_prices(spark, sf_dir)), market, 60).select("ticker", "date", F.col("beta").alias("value"))


_RSI = Grid("p")
_RSI_COLUMN = _RSI.add(fields.close.rsi(14))[0]


@query("w_rsi", f"{DAILY}{_RSI.sql()} SELECT ticker, date, {r(_RSI_COLUMN)} AS value FROM {_RSI.last}")
def w_rsi(spark, sf_dir):
    return ts.wilder_rsi(panels.daily_prices(spark, sf_dir), "close", 14).select("ticker", "date", F.col("rsi").alias("value"))


_MA = f"WITH {BENCH}, x AS (SELECT *, CASE WHEN count(close) OVER {rows(200, '')} >= 200 THEN avg(close) OVER {rows(200, '')} END AS ma FROM b)"
query("w_exposure", f"{_MA} SELECT date, idx, {r('close')} AS close, CASE WHEN ma IS NULL OR close > ma THEN 1.0 ELSE 0.0 END::DOUBLE AS exposure FROM x")(
    lambda s, d: ts.ma_exposure(panels.benchmark(s, d), 200)
)
query(
    "w_hysteresis",
    f"""{_MA}, y AS (SELECT *, CASE WHEN ma IS NOT NULL THEN CAST(close > ma AS INT) END AS up FROM x),
z AS (SELECT *, sum(CASE WHEN up = 0 THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS downs FROM y),
w AS (SELECT *, sum(coalesce(up, 0)) OVER (PARTITION BY downs ORDER BY idx) AS run FROM z)
SELECT date, idx, {r('close')} AS close, CASE WHEN ma IS NULL OR downs = 0 OR (up = 1 AND run >= 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS exposure FROM w""",
)(lambda s, d: ts.ma_exposure(panels.benchmark(s, d), 200, 3))
query(
    "w_regimes",
    f"""WITH {BENCH}, a AS (SELECT *, {div('close', 'lag(close) OVER (ORDER BY idx)')} - 1 AS r, {div('close', 'lag(close, 252) OVER (ORDER BY idx)')} - 1 AS t FROM b),
v AS (SELECT *, CASE WHEN count(r) OVER {rows(63, '')} >= 63 THEN stddev_samp(r) OVER {rows(63, '')} * sqrt(252.0) END AS vol FROM a),
c AS (SELECT *, CASE WHEN count(vol) OVER (ORDER BY idx) >= 504 THEN quantile_cont(vol, 0.6) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS cut FROM v)
SELECT date, idx, CASE WHEN t IS NULL OR cut IS NULL OR vol IS NULL THEN 'unknown'
  ELSE (CASE WHEN t > 0 THEN 'bull' ELSE 'bear' END) || (CASE WHEN vol > cut THEN '_volatile' ELSE '_calm' END) END AS regime FROM c""",
)(lambda s, d: ts.regimes(panels.benchmark(s, d), keep=panels.kept).select("date", "idx", "regime"))
query(
    "w_macro_exposure",
    f"WITH {BENCH} SELECT date, {r('pow(0.5, CAST(coalesce(close < lag(close, 21) OVER (ORDER BY idx), false) AS INT) + CAST(coalesce(close < lag(close, 63) OVER (ORDER BY idx), false) AS INT))')} AS exposure FROM b",
)(lambda s, d: panels.benchmark(s, d).select("date", ts.macro_exposure([F.col("close") < ts.lag("close", n, F.lit(1)) for n in (21, 63)], 0.5).alias("exposure")))


@query(
    "w_combined_exposure",
    f"{_MA} SELECT date, (CASE WHEN ma IS NULL OR close > ma THEN 1.0 ELSE 0.0 END * CASE WHEN close < lag(close, 21) OVER (ORDER BY idx) THEN 0.5 ELSE 1.0 END)::DOUBLE AS exposure FROM x",
)
def w_combined_exposure(spark, sf_dir):
    b = panels.benchmark(spark, sf_dir)
    one = ts.ma_exposure(b, 200).select("date", "exposure")
    two = b.select("date", F.when(F.col("close") < ts.lag("close", 21, F.lit(1)), 0.5).otherwise(1.0).alias("exposure"))
    return ts.combine_exposures(one.unionByName(two))


# monthly panel: momentum, equity, drawdowns, risk

MRET = f", pr AS (SELECT *, {div('close', 'lag(close) OVER ' + W1)} - 1 AS r FROM p)"
_13612 = " + ".join(f"{k} * ({div('close', f'lag(close, {n}) OVER {W1}')} - 1)" for k, n in ((12, 1), (4, 3), (2, 6), (1, 12)))
_EQ = f", e AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING) AS equity FROM pr)"
_DD = f"{_EQ}, d AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"


def monthly_returns(spark, sf_dir) -> DataFrame:
    return with_returns(panels.monthly_prices(spark, sf_dir))


query("w_13612", f"{MONTHLY} SELECT ticker, date, {r(_13612)} AS value FROM p")(lambda s, d: panels.monthly_prices(s, d).select("ticker", "date", rotation.momentum_13612().alias("value")))
query("w_average_ratio", f"{MONTHLY} SELECT ticker, date, {r(div('close', _roll('avg', 'close', 13, 13)))} AS value FROM p")(
    lambda s, d: panels.monthly_prices(s, d).select("ticker", "date", rotation.average_ratio().alias("value"))
)
query("w_month_ends", f"{DAILY} SELECT ticker, last_day(date) AS date, CAST(any_value(year(date) * 12 + month(date)) AS INT) AS idx, {r('max_by(close, date)')} AS close FROM p WHERE close IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: rotation.month_ends(panels.daily_prices(s, d))
)
query("w_equity", f"{MONTHLY}{MRET}{_EQ} SELECT ticker, date, {r('equity')} AS equity FROM e")(lambda s, d: monthly_returns(s, d).select("ticker", "date", ts.equity("r").alias("equity")))
query("w_drawdown", f"{MONTHLY}{MRET}{_DD} SELECT ticker, date, {r('dd')} AS dd FROM d")(
    lambda s, d: monthly_returns(s, d).withColumn("e", ts.equity("r")).select("ticker", "date", ts.drawdown("e").alias("dd"))
)
query(
    "w_drawdown_episodes",
    f"""{MONTHLY}{MRET}{_DD}, s AS (SELECT *, CASE WHEN dd < 0 AND coalesce(lag(dd) OVER {W1}, 0) >= 0 THEN 1 ELSE 0 END AS st, lead(idx) OVER {W1} AS nx FROM d),
g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM s)
SELECT ticker, episode, min(idx) AS start, arg_min(idx, (dd, idx)) AS trough, arg_max(COALESCE(nx, -1), idx) AS "end", {r('min(dd)')} AS depth, count(*) AS rows
FROM g WHERE dd < 0 GROUP BY 1, 2""",
)(lambda s, d: ts.drawdown_episodes(monthly_returns(s, d).withColumn("equity", ts.equity("r"))).withColumn("end", F.coalesce("end", F.lit(-1))))
query("w_rolled_returns", f"{MONTHLY}{MRET} SELECT ticker, date, {r(f'CASE WHEN count(r) OVER {rows(12)} >= 12 THEN product(1 + r) OVER {rows(12)} - 1 END')} AS rolled FROM pr")(
    lambda s, d: risk.rolling_compounded(monthly_returns(s, d), 12).select("ticker", "date", "rolled")
)
query(
    "a_risk_metrics",
    f"""{MONTHLY}{MRET}, c AS (SELECT ticker, quantile_cont(r, 0.05) AS q FROM pr GROUP BY 1), y AS (SELECT pr.*, c.q FROM pr JOIN c USING (ticker))
SELECT ticker, count(r) AS n, {r('avg(r)')} AS mean, {r('stddev_samp(r) * sqrt(12.0)')} AS vol, {r(div('avg(r) * 12 - 0.05', 'stddev_samp(r) * sqrt(12.0)'))} AS sharpe,
  {r(div('avg(r) * 12 - 0.05', 'stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(12.0)'))} AS sortino, {r('abs(any_value(q))')} AS var,
  {r('abs(avg(r) - 1.6448536269514722 * stddev_samp(r))')} AS var_normal, {r('avg(CASE WHEN r <= q THEN r END)')} AS cvar, {r('avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INT) END)')} AS win_rate
FROM y GROUP BY ticker""",
)(lambda s, d: risk.metrics(monthly_returns(s, d), "ticker"))
_M0 = "(count(r)::DOUBLE)"
_MM = lambda k: f"(sum(pow(r - mu, {k})) / count(r))"
query(
    "a_period_statistics",
    f"""{MONTHLY}{MRET}, y AS (SELECT *, avg(r) OVER (PARTITION BY ticker) AS mu FROM pr)
SELECT ticker, {r('avg(r)')} AS mean, {r('quantile_cont(r, 0.5)')} AS median, {r('stddev_samp(r)')} AS std, {r('min(r)')} AS least, {r('max(r)')} AS most,
  {r(f'{_MM(3)} / pow({_MM(2)}, 1.5) * sqrt({_M0} * ({_M0} - 1)) / ({_M0} - 2)')} AS skew,
  {r(f'(({_M0} + 1) * ({_MM(4)} / pow({_MM(2)}, 2) - 3) + 6) * ({_M0} - 1) / (({_M0} - 2) * ({_M0} - 3))')} AS kurt,
  {r('avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INT) END)')} AS win_rate, {r('avg(CASE WHEN r > 0 THEN r END)')} AS avg_gain, {r('avg(CASE WHEN r < 0 THEN r END)')} AS avg_loss
FROM y GROUP BY ticker""",
)(lambda s, d: risk.period_statistics(monthly_returns(s, d), "ticker"))
query(
    "a_by_year",
    f"""{MONTHLY}{MRET} SELECT ticker, CAST(year(date) AS INT) AS year, {r('product(1 + r) - 1')} AS total, {r('stddev_samp(r) * sqrt(12.0)')} AS vol,
  {r(div('product(1 + r) - 1', 'stddev_samp(r) * sqrt(12.0)'))} AS ratio, {r('max(r)')} AS best, {r('min(r)')} AS worst, count(*) FILTER (r > 0) AS rising FROM pr WHERE r IS NOT NULL GROUP BY 1, 2""",
)(lambda s, d: risk.by_year(monthly_returns(s, d), "ticker"))
_PAIR = f"{MONTHLY}{MRET}, y AS (SELECT ticker, r, avg(r) OVER (PARTITION BY idx) AS m FROM pr), z AS (SELECT *, r - m AS x FROM y WHERE r IS NOT NULL AND m IS NOT NULL)"


def with_market(spark, sf_dir) -> DataFrame:
    return monthly_returns(spark, sf_dir).withColumn("m", F.avg("r").over(Window.partitionBy("idx")))


query(
    "a_against_market",
    f"""{_PAIR} SELECT ticker, {r('coalesce(' + div('covar_samp(r, m)', 'var_samp(m)') + ', 1.0)')} AS beta,
  {r('(avg(r) - coalesce(' + div('covar_samp(r, m)', 'var_samp(m)') + ', 1.0) * avg(m)) * 12')} AS alpha, {r('stddev_samp(x) * sqrt(12.0)')} AS tracking_error,
  {r(div('avg(x) * 12', 'stddev_samp(x) * sqrt(12.0)'))} AS information_ratio, {r('corr(r, m)')} AS correlation FROM z GROUP BY 1""",
)(lambda s, d: risk.against_market(with_market(s, d), "ticker"))
_CAP = lambda c, op: f"avg(CASE WHEN m {op} 0 THEN {c} END)"
query(
    "a_captures",
    f"{_PAIR} SELECT ticker, {r(_CAP('r', '>'))} AS up_mean, {r(_CAP('r', '<'))} AS down_mean, {r(div(_CAP('r', '>'), _CAP('m', '>')))} AS up_capture, {r(div(_CAP('r', '<'), _CAP('m', '<')))} AS down_capture FROM z GROUP BY 1",
)(lambda s, d: risk.captures(with_market(s, d), "ticker"))
query(
    "a_worst_drawdown",
    f"""{MONTHLY}{MRET}{_DD}, k AS (SELECT *, max((equity, -idx)) OVER (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING) AS pk FROM d),
w AS (SELECT ticker, arg_min(dd, (dd, idx)) AS depth, arg_min(idx, (dd, idx)) AS trough, arg_min(pk, (dd, idx)) AS pk FROM k GROUP BY 1)
SELECT ticker, {r('abs(depth)')} AS depth, trough, CAST(-pk[2] AS INT) AS peak FROM w""",
)(lambda s, d: risk.worst_drawdown(monthly_returns(s, d)))
query("a_monthly_compounding", f"{DAILY}{RET} SELECT ticker, last_day(date) AS month, {r('product(1 + r) - 1')} AS r FROM pr WHERE r IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: risk.compounded(with_returns(panels.daily_prices(s, d)), "ticker")
)
query("a_coverage", """SELECT 'customers' AS name, count(*) AS n_rows, count(DISTINCT 'C' || o_custkey) AS tickers, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders
UNION ALL SELECT 'suppliers', count(*), count(DISTINCT l_suppkey), min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem""")(
    lambda s, d: store.coverage({"customers": (panels.transactions(s, d), "filingdate"), "suppliers": (panels.table(s, d, "lineitem").withColumn("ticker", F.col("l_suppkey")), "l_shipdate")})
)

# cross-sections

_SCORED = f"{MONTHLY}, {META}, x AS (SELECT p.*, meta.sector FROM p LEFT JOIN meta USING (ticker))"


def described(spark, sf_dir) -> DataFrame:
    return panels.monthly_prices(spark, sf_dir).join(panels.descriptions(spark, sf_dir).select("ticker", "sector"), "ticker", "left")


def _pct(v: str, by: str) -> str:
    return f"((rank() OVER (PARTITION BY {by}, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {by}))"


#: Prices have four places; as decimals with room for a mean's they add up exactly.
PRICE = "decimal(28,14)"
_CROSS = {
    "x_winsor": (lambda: crosssection.winsor("mcap", 0.05), "CASE WHEN mcap IS NOT NULL THEN greatest(least(mcap, quantile_cont(mcap, 0.95) OVER (PARTITION BY date)), quantile_cont(mcap, 0.05) OVER (PARTITION BY date)) END"),
    "x_zscore": (lambda: crosssection.zscore("close"), div("close - avg(close) OVER (PARTITION BY date)", "stddev_pop(close) OVER (PARTITION BY date)")),
    "x_zscore_group": (lambda: crosssection.zscore("close", "date", "sector"), div("close - avg(close) OVER (PARTITION BY date, sector)", "stddev_pop(close) OVER (PARTITION BY date, sector)")),
    "x_rank": (lambda: crosssection.rank("mcap"), f"CASE WHEN mcap IS NOT NULL THEN {_pct('mcap', 'date')} END"),
    "x_rank_group": (lambda: crosssection.rank("mcap", "date", "sector"), f"CASE WHEN mcap IS NOT NULL AND sector IS NOT NULL THEN {_pct('mcap', 'date, sector')} END"),
    "x_bucket": (lambda: crosssection.bucket("mcap", 5).cast("double"), f"CASE WHEN mcap IS NOT NULL THEN ceil({_pct('mcap', 'date')} * 5) END"),
    "x_neutral_sector": (
        lambda: crosssection.neutral_groups(F.col("close").cast(PRICE), "sector").cast("double"),
        "CASE WHEN close IS NOT NULL AND sector IS NOT NULL AND count(CASE WHEN sector IS NOT NULL THEN close END) OVER (PARTITION BY date) >= len(list_distinct(list(CASE WHEN close IS NOT NULL THEN sector END) OVER (PARTITION BY date))) + 1 THEN close - avg(close) OVER (PARTITION BY date, sector) END",
    ),
}
for _name, (_make, _sql) in _CROSS.items():
    query(_name, f"{_SCORED} SELECT ticker, date, {r(_sql)} AS value FROM x")(lambda s, d, make=_make: described(s, d).select("ticker", "date", make().alias("value")))

query(
    "x_neutral_sector_size",
    f"""{_SCORED}, y AS (SELECT *, close IS NOT NULL AND sector IS NOT NULL AND mcap > 0 AS ok FROM x),
z AS (SELECT *, CASE WHEN ok THEN close - avg(CASE WHEN ok THEN close END) OVER (PARTITION BY date, sector) END AS yy, CASE WHEN ok THEN ln(mcap) - avg(CASE WHEN ok THEN ln(mcap) END) OVER (PARTITION BY date, sector) END AS xx FROM y),
w AS (SELECT *, {div('sum(xx * yy) OVER (PARTITION BY date)', 'sum(xx * xx) OVER (PARTITION BY date)')} AS slope, count(yy) OVER (PARTITION BY date) AS k,
  len(list_distinct(list(CASE WHEN ok THEN sector END) OVER (PARTITION BY date))) AS g FROM z)
SELECT ticker, date, {r('CASE WHEN k >= g + 2 THEN yy - coalesce(slope, 0.0) * xx END')} AS value FROM w""",
)(lambda s, d: crosssection.neutral_groups_and_size(described(s, d), "close", "sector", "mcap").select("ticker", "date", F.col("neutral").alias("value")))


@query(
    "x_neutral_general",
    f"""{_SCORED}, y AS (SELECT *, CASE WHEN mcap > 0 THEN ln(mcap) END AS size, count(DISTINCT sector) OVER (PARTITION BY date) AS g FROM x),
k AS (SELECT *, close IS NOT NULL AND sector IS NOT NULL AND size IS NOT NULL AND volume IS NOT NULL AS ok FROM y),
c AS (SELECT ticker, date, g, close - avg(close) OVER w AS yy, size - avg(size) OVER w AS a, volume - avg(volume) OVER w AS b FROM k WHERE ok WINDOW w AS (PARTITION BY date, sector)),
m AS (SELECT *, count(*) OVER w AS n, sum(a * a) OVER w AS aa, sum(a * b) OVER w AS ab, sum(b * b) OVER w AS bb, sum(a * yy) OVER w AS ay, sum(b * yy) OVER w AS vy FROM c WINDOW w AS (PARTITION BY date))
SELECT x.ticker, x.date, {r('CASE WHEN n >= g + 3 THEN yy - a * (ay * bb - vy * ab) / (aa * bb - ab * ab) - b * (vy * aa - ay * ab) / (aa * bb - ab * ab) END', 6)} AS value FROM x LEFT JOIN m USING (ticker, date)""",
    places=6,
)
def x_neutral_general(spark, sf_dir):
    rows_ = described(spark, sf_dir).withColumn("size", F.when(F.col("mcap") > 0, F.ln("mcap")))
    return crosssection.neutral(rows_, "close", ["sector"], ["size", "volume"]).select("ticker", "date", F.col("neutral").alias("value"))


@query(
    "x_rank_normalised",
    f"{_SCORED}, y AS (SELECT ticker, date, CASE WHEN mcap IS NOT NULL THEN greatest(least({_pct('mcap', 'date')} - 0.5 / count(mcap) OVER (PARTITION BY date), 1 - 1e-6), 1e-6) END AS p FROM x) SELECT ticker, date, CASE WHEN p IS NOT NULL THEN {r(normal('p'))} END AS value FROM y",
)
def x_rank_normalised(spark, sf_dir):
    return described(spark, sf_dir).select("ticker", "date", crosssection.rank_normalised("mcap").alias("value"))


_Z = lambda v: div(f"{v} - avg({v}) OVER (PARTITION BY date)", f"stddev_pop({v}) OVER (PARTITION BY date)")
_COMPOSITE = f"{MONTHLY}, z AS (SELECT ticker, date, idx, close, {_Z('close')} AS a, {_Z('mcap')} AS b, {_Z('volume')} AS c FROM p)"
_SCORE = "CASE WHEN (a IS NOT NULL)::INT * 2 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 THEN (coalesce(2 * a, 0) - coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT * 2 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) END"


def scores(spark, sf_dir) -> DataFrame:
    """date, ticker, score: a composite of three standardised columns."""
    p = panels.monthly_prices(spark, sf_dir)
    z = p.select("ticker", "date", *[crosssection.zscore(c).alias(c) for c in ("close", "mcap", "volume")]).unpivot(["ticker", "date"], ["close", "mcap", "volume"], "factor", "z")
    return crosssection.composite(z, {"close": 2.0, "mcap": -1.0, "volume": 1.0})


query("x_composite", f"{_COMPOSITE} SELECT date, ticker, {r(_SCORE)} AS score FROM z")(scores)
query("x_composite_categories", f"{_COMPOSITE} SELECT date, ticker, {r('CASE WHEN (CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 1 THEN 1 ELSE 0 END) + (c IS NOT NULL)::INT * 0.5 >= 0.75 THEN (coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 0) + coalesce(c, 0) * 0.5) / ((CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 1 THEN 1 ELSE 0 END) + (c IS NOT NULL)::INT * 0.5) END')} AS score FROM z")(
    lambda s, d: crosssection.composite_by_category(
        panels.monthly_prices(s, d).select("ticker", "date", *[crosssection.zscore(c).alias(c) for c in ("close", "mcap", "volume")]).unpivot(["ticker", "date"], ["close", "mcap", "volume"], "factor", "z"),
        {"close": "price", "mcap": "price", "volume": "flow"}, {"price": 1.0, "flow": 0.5},
    )
)

# research

_FWD = f"{_COMPOSITE}, fw AS (SELECT ticker, date, {div(f'lead(close, 2) OVER {W1}', f'lead(close, 1) OVER {W1}')} - 1 AS fwd FROM p), s AS (SELECT z.date, z.ticker, z.idx, {_SCORE} AS score, fwd FROM z JOIN fw USING (ticker, date)), ok AS (SELECT date, ticker, idx, round(score, 9) AS score, round(fwd, 9) AS fwd FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL)"
_RK = lambda v: f"rank() OVER (PARTITION BY date ORDER BY {v}) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0"
_IC = f"{_FWD}, rk AS (SELECT date, {_RK('score')} AS a, {_RK('fwd')} AS b FROM ok), ic AS (SELECT date, count(*) AS names, CASE WHEN count(*) >= 20 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk GROUP BY 1)"
_QR = f"{_FWD}, qd AS (SELECT date, ticker, idx, fwd, CAST(ceil(({_RK('score')}) / count(*) OVER (PARTITION BY date) * 5) AS INT) AS q FROM ok), qr AS (SELECT date, q, avg(fwd) AS ret, count(*) AS names FROM qd GROUP BY 1, 2 HAVING count(*) >= 4)"


def scored_returns(spark, sf_dir, horizon: int = 1) -> DataFrame:
    fwd = panels.monthly_prices(spark, sf_dir).select("ticker", "date", "idx", ts.forward_return("close", horizon).alias("fwd"))
    return scores(spark, sf_dir).join(fwd, ["ticker", "date"]).withColumn("score", F.round("score", 9)).withColumn("fwd", F.round("fwd", 9))


query("a_rank_ic", f"{_IC} SELECT date, names, {r('ic')} AS ic FROM ic")(lambda s, d: crosssection.rank_ic(scored_returns(s, d)))
query(
    "a_ic_summary",
    f"{_IC} SELECT {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic, {r(div('avg(ic)', 'stddev_samp(ic)'))} AS ic_ir, {r(div('avg(ic)', 'stddev_samp(ic)') + ' * sqrt(greatest(count(ic), 2.0))')} AS t, {r('avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 0 AS INT) END)')} AS hit_rate, count(ic) AS n FROM ic",
)(lambda s, d: crosssection.ic_summary(crosssection.rank_ic(scored_returns(s, d))))
query("a_quantile_returns", f"{_QR} SELECT date, q, {r('ret')} AS ret, names FROM qr")(lambda s, d: crosssection.quantile_returns(scored_returns(s, d)))
query(
    "a_quantile_report",
    f"""{_QR}, sp AS (SELECT date, max(CASE WHEN q = 5 THEN ret END) - max(CASE WHEN q = 1 THEN ret END) AS s FROM qr GROUP BY 1), mn AS (SELECT q, avg(ret) AS m FROM qr GROUP BY 1),
mr AS (SELECT q::DOUBLE AS q, rank() OVER (ORDER BY m)::DOUBLE AS rk FROM mn)
SELECT {r('avg(s)')} AS spread, {r(div('avg(s)', 'stddev_samp(s)') + ' * sqrt(greatest(count(s), 2.0))')} AS spread_t, {r('(SELECT corr(q, rk) FROM mr)')} AS monotonicity FROM sp""",
)(lambda s, d: crosssection.quantile_report(crosssection.quantile_returns(scored_returns(s, d))))
query(
    "a_top_turnover",
    f"""{_QR}, t AS (SELECT DISTINCT date, idx, ticker FROM qd WHERE q = 5), o AS (SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM t)), m AS (SELECT t.*, no FROM t JOIN o USING (date))
SELECT a.date, {r('1 - count(b.ticker) / count(*)::DOUBLE')} AS turnover FROM m a LEFT JOIN m b ON a.no = b.no + 1 AND a.ticker = b.ticker WHERE a.no > 1 GROUP BY 1""",
)(lambda s, d: crosssection.membership_turnover(scored_returns(s, d).filter("score IS NOT NULL AND fwd IS NOT NULL").withColumn("q", crosssection.bucket("score", 5)).filter("q = 5").select("date", "idx", "ticker")))


def _decay(h: int) -> str:
    ic = _IC.replace("lead(close, 2)", f"lead(close, {1 + h})")
    ratio = div("avg(ic)", "stddev_samp(ic)")
    return (
        f"{ic} SELECT {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic, {r(ratio)} AS ic_ir, {r(f'{ratio} * sqrt(greatest(count(ic) / {h}.0, 2.0))')} AS t, "
        f"{r('avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 0 AS INT) END)')} AS hit_rate, count(ic) AS n, {h} AS horizon FROM ic"
    )


@query("a_ic_decay", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(map(_decay, (1, 3, 6))) + ")")
def a_ic_decay(spark, sf_dir):
    rows_ = [crosssection.ic_summary(crosssection.rank_ic(scored_returns(spark, sf_dir, h)), h).withColumn("horizon", F.lit(h)) for h in (1, 3, 6)]
    return rows_[0].unionByName(rows_[1]).unionByName(rows_[2])


# from ICs to weights

_FOUR = ("close", "mcap", "volume", "change")
_RN = lambda v: f"CASE WHEN {v} IS NOT NULL THEN {normal(f'greatest(least({_pct(v, 'date')} - 0.5 / count({v}) OVER (PARTITION BY date), 1 - 1e-6), 1e-6)')} END"
_WIDE = f"""{MONTHLY}, ch AS (SELECT *, {div('close', f'lag(close) OVER {W1}')} - 1 AS change, {div(f'lead(close, 2) OVER {W1}', f'lead(close, 1) OVER {W1}')} - 1 AS fw FROM p),
wide AS (SELECT ticker, date, idx, round(fw, 9) AS fwd, {", ".join(f"round({_RN(c)}, 9) AS {c}" for c in _FOUR)} FROM ch)"""
_FIC = f"""{_WIDE}, zl AS (SELECT date, idx, ticker, fwd, unnest([{", ".join(f"{{factor: '{c}', z: {c}}}" for c in _FOUR)}]) AS f FROM wide),
zr AS (SELECT date, f.factor AS factor, rank() OVER a + (count(*) OVER (PARTITION BY date, f.factor, f.z) - 1) / 2.0 AS a, rank() OVER b + (count(*) OVER (PARTITION BY date, f.factor, fwd) - 1) / 2.0 AS b
  FROM zl WHERE f.z IS NOT NULL AND fwd IS NOT NULL WINDOW a AS (PARTITION BY date, f.factor ORDER BY f.z), b AS (PARTITION BY date, f.factor ORDER BY fwd)),
fic AS (SELECT date, factor, CASE WHEN count(*) >= 20 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM zr GROUP BY 1, 2)"""
_MR = f"""{_FIC}, {BENCH}, ra AS (SELECT *, {div('close', 'lag(close) OVER (ORDER BY idx)')} - 1 AS r, {div('close', 'lag(close, 126) OVER (ORDER BY idx)')} - 1 AS t FROM b),
rv AS (SELECT *, CASE WHEN count(r) OVER {rows(63, '')} >= 63 THEN stddev_samp(r) OVER {rows(63, '')} * sqrt(252.0) END AS vol FROM ra),
rc AS (SELECT *, CASE WHEN count(vol) OVER (ORDER BY idx) >= 126 THEN quantile_cont(vol, 0.6) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS cut FROM rv),
rg AS (SELECT last_day(date) AS date, max_by(CASE WHEN t IS NULL OR cut IS NULL OR vol IS NULL THEN 'unknown' ELSE (CASE WHEN t > 0 THEN 'bull' ELSE 'bear' END) || (CASE WHEN vol > cut THEN '_volatile' ELSE '_calm' END) END, date) AS regime FROM rc GROUP BY 1)"""


def _shares(v: str, by: str, source: str) -> str:
    return f"SELECT *, CASE WHEN sum(greatest(coalesce({v}, 0), 0)) OVER (PARTITION BY {by}) > 0 THEN greatest(coalesce({v}, 0), 0) / sum(greatest(coalesce({v}, 0), 0)) OVER (PARTITION BY {by}) ELSE 1.0 / count(*) OVER (PARTITION BY {by}) END AS w FROM {source}"


def wide_scores(spark, sf_dir) -> DataFrame:
    """date, ticker, fwd and four rank-normalised factors."""
    p = panels.monthly_prices(spark, sf_dir).withColumn("change", ts.change("close"))
    return p.select("date", "ticker", F.round(ts.forward_return("close", 1), 9).alias("fwd"), *[F.round(crosssection.rank_normalised(c), 9).alias(c) for c in _FOUR])


def long_scores(spark, sf_dir) -> DataFrame:
    return wide_scores(spark, sf_dir).unpivot(["date", "ticker", "fwd"], list(_FOUR), "factor", "z")


def month_regimes(spark, sf_dir) -> DataFrame:
    daily = ts.regimes(panels.benchmark(spark, sf_dir), trend=126, warm=126, keep=panels.kept)
    return daily.groupBy(F.last_day("date").alias("date")).agg(F.max_by("regime", "date").alias("regime"))


query("a_factor_ic", f"{_FIC} SELECT date, factor, {r('ic')} AS ic FROM fic")(lambda s, d: research.factor_ics(long_scores(s, d)))
query(
    "x_trailing_weights",
    f"{_FIC}, t AS (SELECT date, factor, CASE WHEN count(*) OVER w >= 24 THEN avg(ic) OVER w END AS m FROM fic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS 35 PRECEDING)), s AS ({_shares('m', 'date', 't')}) SELECT date, factor, {r('w')} AS w FROM s",
)(lambda s, d: research.trailing_weights(research.factor_ics(long_scores(s, d)), 36, 24))
_BYR = f"{_MR}, en AS (SELECT regime FROM rg GROUP BY 1 HAVING count(*) >= 12), br AS (SELECT factor, regime, avg(ic) AS ic FROM fic JOIN rg USING (date) JOIN en USING (regime) GROUP BY 1, 2)"
query("a_ic_by_regime", f"{_BYR} SELECT factor, regime, {r('ic')} AS ic FROM br")(lambda s, d: research.ic_by_regime(research.factor_ics(long_scores(s, d)), month_regimes(s, d)))
query("x_regime_weights", f"{_BYR}, k AS (SELECT * FROM br WHERE ic IS NOT NULL), s AS ({_shares('ic', 'regime', 'k')}) SELECT regime, factor, {r('w')} AS w FROM s")(
    lambda s, d: research.weights_by_regime(research.ic_by_regime(research.factor_ics(long_scores(s, d)), month_regimes(s, d)))
)
query(
    "x_regime_scores",
    f"""{_MR}, dn AS (SELECT *, row_number() OVER (ORDER BY date) AS no FROM rg), x AS (SELECT fic.*, regime, no FROM fic JOIN dn USING (date)),
m AS (SELECT a.date, a.factor, CASE WHEN any_value(a.no) - 3 >= 24 AND count(b.no) >= 12 THEN avg(b.ic) END AS m FROM x a LEFT JOIN x b ON a.factor = b.factor AND a.regime = b.regime AND b.no <= a.no - 3 GROUP BY 1, 2), s AS ({_shares('m', 'date', 'm')}),
sc AS (SELECT zl.date, ticker, CASE WHEN count(f.z) = count(*) THEN sum(f.z * w) END AS score FROM zl JOIN s ON s.date = zl.date AND s.factor = f.factor WHERE w > 0 GROUP BY 1, 2) SELECT date, ticker, {r('score')} AS score FROM sc""",
)(lambda s, d: (lambda z: research.weighted_scores(z.drop("fwd"), research.regime_weights(research.factor_ics(z), month_regimes(s, d), 24, 2)))(long_scores(s, d)))
query(
    "x_select_factors",
    f"""{_FIC}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM fic)), en AS (SELECT y AS fold, make_date(CAST(y AS INT), 12, 31) AS e FROM range(1996, 2002) t(y)),
la AS (SELECT fold, max(no) - 2 AS upto FROM dd JOIN en ON date <= e GROUP BY 1), mm AS (SELECT fold, factor, any_value(upto) AS upto, avg(ic) AS ic FROM la JOIN dd ON no <= upto JOIN fic USING (date) GROUP BY 1, 2),
rr AS (SELECT *, upto >= 36 AND row_number() OVER (PARTITION BY fold ORDER BY ic DESC NULLS LAST, factor) <= 2 AND coalesce(ic > 0, false) AS good FROM mm)
SELECT CAST(fold AS INT) AS fold, factor, {r('ic')} AS ic FROM (SELECT *, bool_or(good) OVER (PARTITION BY fold) AS any_good FROM rr) WHERE good OR NOT any_good""",
)(lambda s, d: research.select_factors(research.factor_ics(long_scores(s, d)), s.range(1996, 2002).select(F.col("id").cast("int").alias("fold"), F.make_date(F.col("id").cast("int"), F.lit(12), F.lit(31)).alias("end")), 2))
_RESID = f"""{_FIC}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM wide)), en AS (SELECT y AS fold, make_date(CAST(y AS INT), 12, 31) AS e FROM range(1996, 2002) t(y)),
la AS (SELECT fold, count(*) - 2 AS upto FROM dd JOIN en ON date <= e GROUP BY 1),
f1 AS (SELECT * FROM (SELECT fold, factor, any_value(upto) AS upto, avg(ic) AS ic, row_number() OVER (PARTITION BY fold ORDER BY avg(ic) DESC NULLS LAST, factor) AS k FROM la JOIN dd ON no <= upto JOIN fic USING (date) WHERE upto >= 36 GROUP BY 1, 2) WHERE k = 1 AND ic > 0),
pr AS (SELECT a.date, a.fwd, a.f.factor AS pick, a.f.z AS x, b.f.z AS y, b.f.factor AS factor FROM zl a JOIN zl b ON a.date = b.date AND a.ticker = b.ticker AND b.f.factor <> a.f.factor WHERE a.f.z IS NOT NULL AND b.f.z IS NOT NULL),
rs AS (SELECT *, round(y - avg(y) OVER w - coalesce(regr_slope(y, x) OVER w, 0) * (x - avg(x) OVER w), 9) AS e, count(*) OVER w AS n FROM pr WINDOW w AS (PARTITION BY date, pick, factor)),
rk2 AS (SELECT date, pick, factor, rank() OVER a + (count(*) OVER (PARTITION BY date, pick, factor, e) - 1) / 2.0 AS a, rank() OVER b + (count(*) OVER (PARTITION BY date, pick, factor, fwd) - 1) / 2.0 AS b
  FROM rs WHERE n >= 30 AND fwd IS NOT NULL WINDOW a AS (PARTITION BY date, pick, factor ORDER BY e), b AS (PARTITION BY date, pick, factor ORDER BY fwd)),
ic2 AS (SELECT date, pick, factor, CASE WHEN count(*) >= 20 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk2 GROUP BY 1, 2, 3),
f2 AS (SELECT * FROM (SELECT fold, i.factor, avg(i.ic) AS ic, row_number() OVER (PARTITION BY fold ORDER BY avg(i.ic) DESC NULLS LAST, i.factor) AS k FROM f1 JOIN dd ON no <= upto JOIN ic2 i ON i.date = dd.date AND pick = f1.factor GROUP BY 1, 2) WHERE k = 1 AND ic > 0)"""
query(
    "x_forward_selection",
    f"""{_RESID} SELECT CAST(fold AS INT) AS fold, CAST(1 AS INT) AS step, factor, {r('ic')} AS ic FROM f1 UNION ALL SELECT CAST(fold AS INT), CAST(2 AS INT), factor, {r('ic')} FROM f2
UNION ALL SELECT CAST(fold AS INT), CAST(0 AS INT), factor, NULL FROM en, (SELECT unnest([{", ".join(repr(c) for c in _FOUR)}]) AS factor) WHERE fold NOT IN (SELECT fold FROM f1)""",
)(
    lambda s, d: research.forward_selection(panels.kept(wide_scores(s, d)), list(_FOUR), s.range(1996, 2002).select(F.col("id").cast("int").alias("fold"), F.make_date(F.col("id").cast("int"), F.lit(12), F.lit(31)).alias("end")), 2)
)

# as-of joins and factors

_ASOF = f"{FILINGS}, m AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date FROM lineitem), g AS (SELECT m.date, t.ticker FROM m CROSS JOIN (SELECT DISTINCT ticker FROM f) t), k AS (SELECT * FROM f WHERE datekey IS NOT NULL), j AS (SELECT g.ticker, g.date, k.calendardate, k.netinc, k.revenue FROM g ASOF LEFT JOIN k ON g.ticker = k.ticker AND g.date >= k.datekey)"
query("j_as_of", f"{_ASOF} SELECT ticker, date, calendardate, {r('netinc')} AS netinc, {r('revenue')} AS revenue FROM j")(
    lambda s, d: as_of(panels.monthly_prices(s, d).select("ticker", "date"), panels.filings(s, d), "ticker", "date", "datekey", ["calendardate"], ["calendardate", "netinc", "revenue"])
)


def factor_tables(spark, sf_dir, prices: Callable[[SparkSession, str], DataFrame] = panels.supplier_daily_prices, fields: set[str] | None = None, dense: bool = True) -> Tables:
    """Windows count trading days, so prices are daily; monthly ones serve expressions without windows only.

    fields: those that will be read; holdings and insiders are left out if they have none. dense: whether quarters without a
    filing have rows.
    """
    quarterly = panels.filings(spark, sf_dir, dense).withColumnRenamed("calendardate", "date")
    if fields is None or KNOWN.keys() & fields:
        quarterly = quarterly.join(panels.holders(spark, sf_dir).withColumnRenamed("calendardate", "date"), ["ticker", "date"], "left")
    daily = prices(spark, sf_dir)
    market = daily.groupBy("idx").agg(F.avg("close").alias("c")).withColumn("r", safe_div(F.col("c"), ts.lag("c", 1, F.lit(1))) - 1)
    sectors = panels.descriptions(spark, sf_dir).select("ticker", "sector")
    if prices is not panels.supplier_daily_prices:
        return Tables(quarterly, daily, sectors, market, KNOWN)
    windows = lambda days, nodes, keep: panels.supplier_windows(spark, sf_dir, days, nodes, keep)
    return Tables(quarterly, daily, sectors, market, KNOWN, panels.supplier_calendar(spark, sf_dir), lambda days: prices(spark, sf_dir, days, fields), windows)


KNOWN = {"inst_shares": "inst_date", "inst_holders": "inst_date", "insider_net_shares": "insider_date"}
#: Growth of a quarterly figure over daily values: refused as an error of grids, before any job.
MIXED_GRIDS = {"DIVYIELD_GROWTH_QOQ", "DIVYIELD_GROWTH_YOY"}
_QUARTER = "last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE))"
_ROLLED = ", ".join(f"CASE WHEN count(mr) OVER w{n} >= {max(20, n // 2)} THEN stddev_samp(mr) OVER w{n} END AS ms{n}" for n in (60, 252))
FACTOR_TABLES = f"""{FILINGS}, {META}, {BENCH},
hd AS (SELECT 'S' || l_suppkey AS ticker, {_QUARTER} AS date, sum(l_quantity) AS inst_shares, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS inst_holders,
  sum(l_quantity * CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END) AS insider_net_shares FROM lineitem GROUP BY 1, 2),
q AS (SELECT f.ticker, f.calendardate AS date, f.idx, f.* EXCLUDE (ticker, calendardate, idx), hd.* EXCLUDE (ticker, date),
  CAST(hd.date + 75 AS DATE) AS inst_date, CAST(hd.date + 3 AS DATE) AS insider_date, sector FROM f LEFT JOIN hd ON f.ticker = hd.ticker AND f.calendardate = hd.date LEFT JOIN meta ON f.ticker = meta.ticker),
sd AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q, max(l_extendedprice / l_quantity) AS u FROM lineitem GROUP BY 1, 2),
s1 AS (SELECT t.ticker, b.date, b.idx, b.close AS m, floor(round(v, 2) / q * 1e4 + 0.501) / 1e4 AS c, floor(u * 1e4 + 0.501) / 1e4 AS u, q, round(v, 2) AS v
  FROM b CROSS JOIN (SELECT DISTINCT ticker FROM sd) t LEFT JOIN sd ON sd.ticker = t.ticker AND sd.date = b.date),
s2 AS (SELECT ticker, date, idx, floor(last_value(c / m IGNORE NULLS) OVER w * m * 1e4 + 0.501) / 1e4 AS close, last_value(u IGNORE NULLS) OVER w AS closeunadj,
  CASE WHEN last_value(v IGNORE NULLS) OVER w IS NOT NULL THEN coalesce(q, 0.0) END AS volume, last_value(v IGNORE NULLS) OVER w AS mcap,
  floor((0.3 * last_value(q IGNORE NULLS) OVER w + 100) * 1e2 + 0.501) / 1e2 AS short_interest FROM s1 WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING)),
m1 AS (SELECT idx, avg(close) AS c FROM s2 GROUP BY 1), m2 AS (SELECT idx, {div('c', 'lag(c) OVER (ORDER BY idx)')} - 1 AS mr FROM m1),
m3 AS (SELECT *, {_ROLLED} FROM m2 WINDOW w60 AS (ORDER BY idx ROWS 59 PRECEDING), w252 AS (ORDER BY idx ROWS 251 PRECEDING)),
d AS (SELECT s2.*, sector, mr, ms60, ms252 FROM s2 LEFT JOIN meta USING (ticker) JOIN m3 USING (idx))"""


class _Columns:
    """The columns of a grid by name, for the SQL of factors."""

    def __init__(self, *columns: str):
        self.columns = columns


LAYOUT = Tables(_Columns(*panels.FIELDS, "revenue", "netinc", "quantity", *KNOWN), _Columns("close", "closeunadj", "volume", "mcap", "short_interest"), known=KNOWN)


def _wanted(names: list[str], scoring: bool) -> dict:
    return {n: catalog.CATALOG[n].scoring() if scoring else catalog.CATALOG[n].expr for n in names}


def _factor_query(names: list[str], scoring: bool = False, prices: Callable[[SparkSession, str], DataFrame] = panels.supplier_daily_prices):
    """Factors on signal dates: each month's last trading day, windows running over all days before it."""

    def run(spark, sf_dir):
        wanted = _wanted(names, scoring)
        tables = factor_tables(spark, sf_dir, prices, used(*wanted.values()), any(across(e, LAYOUT) for e in wanted.values()))
        signals = backtest.rebalance_dates(tables.calendar) if tables.calendar is not None else None
        out = compile_all(tables, wanted, signals)
        return out.unpivot(["ticker", "date"], names, "factor", "value").filter("value IS NOT NULL")

    return run


def _factors(name: str, names: list[str], scoring: bool = False) -> None:
    signals = "SELECT max(date) FROM b GROUP BY date_trunc('month', date) HAVING max(idx) < (SELECT max(idx) FROM b)"
    query(name, factor_sql(FACTOR_TABLES, LAYOUT, _wanted(names, scoring), r) + f" AND date IN ({signals})")(_factor_query(names, scoring))


for _category in ("acceleration", "growth", "flow_proxy", "value_ev", "value_price", "price"):
    _factors(f"f_{_category}", [n for n, x in catalog.CATALOG.items() if x.category == _category and n not in MIXED_GRIDS])
_quality = [n for n, x in catalog.CATALOG.items() if x.category == "quality"]
for _k in range(0, len(_quality), 20):
    _factors(f"f_quality_{_k // 20 + 1}", _quality[_k : _k + 20])
_factors("f_scoring_value", ["PER", "PBR", "SIZE", "EV_EBITDA", "PRR"], True)
query(
    "f_per_pbr",
    f"""{FILINGS}, mli AS (SELECT 'S' || l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS date, round(sum(l_extendedprice), 2) AS mcap FROM lineitem GROUP BY 1, 2),
k AS (SELECT * FROM f WHERE datekey IS NOT NULL), j AS (SELECT a.ticker, a.date, a.mcap, k.netinc, k.equity FROM mli a ASOF LEFT JOIN k ON a.ticker = k.ticker AND a.date >= k.datekey),
u AS (SELECT ticker, date, 'PER' AS factor, {r(div('mcap', 'netinc'))} AS value FROM j UNION ALL SELECT ticker, date, 'PBR', {r(div('mcap', 'equity'))} FROM j) SELECT * FROM u WHERE value IS NOT NULL""",
)(_factor_query(["PER", "PBR"], prices=panels.monthly_prices))
query(
    "f_ttm_ratio",
    f"""{FILINGS}, k AS (SELECT *, {_roll('sum', 'gp', 4, 4)} / CASE WHEN abs(assets) > 1e-9 THEN assets END AS v FROM f), kk AS (SELECT * FROM k WHERE datekey IS NOT NULL),
m AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date FROM lineitem), g AS (SELECT m.date, t.ticker FROM m CROSS JOIN (SELECT DISTINCT ticker FROM f) t)
SELECT g.ticker, g.date, 'GP_A_TTM' AS factor, {r('v')} AS value FROM g ASOF JOIN kk ON g.ticker = kk.ticker AND g.date >= kk.datekey WHERE v IS NOT NULL""",
)(_factor_query(["GP_A_TTM"], prices=panels.monthly_prices))

# two factors of each category against SQL written from their definitions, not from the expression tree

_GROWN = lambda v, n, back=0: div(f"{_at(v, back)} - {_at(v, n + back)}", f"abs({_at(v, n + back)})")


def _at(v: str, n: int) -> str:
    return f"(lag({v}, {n}) OVER {W1})" if n else v


_TTM = lambda v: f"(CASE WHEN count({v}) OVER {rows(4)} >= 4 THEN sum({v}) OVER {rows(4)} END)"
_FILED = {
    "GP_ACCEL_QOQ": f"{_GROWN('gp', 1)} - {_GROWN('gp', 1, 1)}", "NETINC_ACCEL_YOY": f"{_GROWN('netinc', 4)} - {_GROWN('netinc', 4, 4)}",
    "REVENUE_GROWTH_YOY": _GROWN("revenue", 4), "EQUITY_GROWTH_QOQ": _GROWN("equity", 1),
    "ROE": div("netinc", f"((equity + {_at('equity', 1)}) / 2)"), "CURRENT_RATIO": div("assetsc", "liabilitiesc"), "NET_ISSUANCE": div(f"sharesbas - {_at('sharesbas', 4)}", _at("sharesbas", 4)),
}
_BY_HAND = (*_FILED, "INST_HOLDER_CHG", "MOM_3M", "MOM_12_1", "TURNOVER", "EV", "EV_SALES", "PBR", "PER_TTM", "SIZE")
_HAND_DAILY = {
    "MOM_3M": f"{div('close', f'lag(close, 63) OVER {W1}')} - 1", "MOM_12_1": f"{div(f'lag(close, 21) OVER {W1}', f'lag(close, 252) OVER {W1}')} - 1",
    "TURNOVER": div(_roll("avg", "volume * close", 20), "mcap"), "SIZE": "mcap",
}
_HAND = f"""{FACTOR_TABLES},
fq AS (SELECT ticker, date AS period, datekey, {", ".join(f"{v} AS {k}" for k, v in _FILED.items())}, debt, cashneq, revenue, equity, {_TTM('netinc')} AS net4 FROM q),
iq AS (SELECT ticker, inst_date, {_GROWN('inst_holders', 1)} AS INST_HOLDER_CHG FROM q),
dq AS (SELECT ticker, date, mcap, {", ".join(f"{v} AS {k}" for k, v in _HAND_DAILY.items())} FROM d),
sg AS (SELECT * FROM dq WHERE date IN (SELECT max(date) FROM b GROUP BY date_trunc('month', date) HAVING max(idx) < (SELECT max(idx) FROM b))),
pf AS (SELECT sg.*, fk.* EXCLUDE (ticker, period, datekey) FROM sg ASOF LEFT JOIN (SELECT * FROM fq WHERE datekey IS NOT NULL) fk ON fk.ticker = sg.ticker AND sg.date >= fk.datekey),
pi AS (SELECT pf.*, ik.INST_HOLDER_CHG FROM pf ASOF LEFT JOIN (SELECT * FROM iq WHERE inst_date IS NOT NULL) ik ON ik.ticker = pf.ticker AND pf.date >= ik.inst_date),
al AS (SELECT ticker, date, {", ".join((*_FILED, "INST_HOLDER_CHG", *_HAND_DAILY))}, mcap + debt - cashneq AS EV, {div('mcap + debt - cashneq', 'revenue')} AS EV_SALES, {div('mcap', 'equity')} AS PBR, {div('mcap', 'net4')} AS PER_TTM FROM pi)
SELECT ticker, date, factor, {r('value')} AS value FROM (UNPIVOT al ON {", ".join(_BY_HAND)} INTO NAME factor VALUE value)"""
query("f_by_hand", _HAND)(_factor_query(list(_BY_HAND)))


# store

_SPLIT = "TIMESTAMP '1998-01-01'"


def _halves(spark, sf_dir):
    rows_ = panels.transactions(spark, sf_dir).withColumn("calendardate", panels.quarter_end(F.col("filingdate")))
    rows_ = rows_.groupBy("ticker", "calendardate").agg(F.round(F.sum("shares"), 2).alias("shares"), F.max("filingdate").alias("datekey"))
    old = rows_.filter("calendardate < '1998-01-01'")
    new = rows_.filter("calendardate >= '1997-06-01'").withColumn("shares", F.col("shares") * 2)
    return old, new


_HALVES = """WITH t AS (SELECT 'C' || o_custkey AS ticker, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS calendardate,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice), 2) AS shares, max(CAST(o_orderdate AS DATE)) AS datekey FROM orders GROUP BY 1, 2),
old AS (SELECT * FROM t WHERE calendardate < DATE '1998-01-01'), new AS (SELECT ticker, calendardate, shares * 2 AS shares, datekey FROM t WHERE calendardate >= DATE '1997-06-01')"""
_KEYS = ["ticker", "calendardate"]
query("k_insert_first", f"{_HALVES} SELECT ticker, calendardate, {r('shares', 2)} AS shares, datekey FROM old UNION ALL SELECT ticker, calendardate, {r('shares', 2)}, datekey FROM new ANTI JOIN old USING (ticker, calendardate)", places=2)(
    lambda s, d: store.insert_first(*_halves(s, d), _KEYS, ["datekey"])
)
query("k_merge_fields", f"{_HALVES} SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.calendardate, n.calendardate) AS calendardate, {r('coalesce(n.shares, o.shares)', 2)} AS shares, o.datekey FROM old o FULL JOIN new n ON o.ticker = n.ticker AND o.calendardate = n.calendardate", places=2)(
    lambda s, d: store.merge_fields(*_halves(s, d), _KEYS, ["shares"], ["datekey"])
)
query("k_replace_events", f"{_HALVES} SELECT ticker, calendardate, {r('shares', 2)} AS shares, datekey FROM old ANTI JOIN new USING (ticker, calendardate) UNION ALL SELECT ticker, calendardate, {r('shares', 2)}, datekey FROM new", places=2)(
    lambda s, d: store.replace_events(*_halves(s, d), _KEYS, ["datekey"])
)
_ADJUSTED = f"{DAILY}, o AS MATERIALIZED (SELECT ticker, date, close FROM p WHERE close > 0), n AS MATERIALIZED (SELECT ticker, date, CASE WHEN ticker LIKE '%1' THEN close * 0.5 WHEN ticker LIKE '%2' THEN close * (1 + idx % 7) ELSE close END AS close FROM p WHERE close IS NOT NULL), fa AS MATERIALIZED (SELECT ticker, avg(n.close / o.close) AS factor FROM o JOIN n USING (ticker, date) GROUP BY 1 HAVING stddev_pop(n.close / o.close) <= 1e-4 AND abs(avg(n.close / o.close) - 1) > 1e-4)"


def _adjusted(spark, sf_dir):
    p = panels.daily_prices(spark, sf_dir)
    new = F.when(F.col("ticker").endswith("1"), F.col("close") * 0.5).when(F.col("ticker").endswith("2"), F.col("close") * (1 + F.col("idx") % 7)).otherwise(F.col("close"))
    return p, store.adjustment_factors(p, p.withColumn("close", new))


query("k_adjustment_factors", f"{_ADJUSTED} SELECT ticker, {r('factor')} AS factor FROM fa")(lambda s, d: _adjusted(s, d)[1])
query("k_rescale", f"{_ADJUSTED} SELECT p.ticker, p.date, {r('p.close * coalesce(factor, 1.0)')} AS close FROM p LEFT JOIN fa USING (ticker)")(
    lambda s, d: store.rescale(*_adjusted(s, d)).select("ticker", "date", "close")
)
query("k_cache_metadata", f"{DAILY} SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n_rows FROM p WHERE close IS NOT NULL GROUP BY 1")(lambda s, d: store.cache_metadata(panels.daily_prices(s, d)))
query(
    "k_missing_ranges",
    f"{DAILY}, md AS (SELECT ticker, min(date) AS f, max(date) AS l FROM p WHERE close IS NOT NULL GROUP BY 1) SELECT ticker, DATE '1995-01-01' AS start, least(DATE '2002-01-01', CAST(f - 1 AS DATE)) AS \"end\" FROM md WHERE DATE '1995-01-01' < f UNION ALL SELECT ticker, greatest(DATE '1995-01-01', CAST(l + 1 AS DATE)), DATE '2002-01-01' FROM md WHERE DATE '2002-01-01' > l",
)(lambda s, d: store.missing_ranges(store.cache_metadata(panels.daily_prices(s, d)), "1995-01-01", "2002-01-01"))
query("k_date_gaps", f"{DAILY}, g AS (SELECT ticker, date, CAST(date - lag(date) OVER {W1.replace('idx', 'date')} AS INT) AS gap FROM p WHERE close IS NOT NULL) SELECT ticker, date, gap FROM g WHERE gap > 4")(
    lambda s, d: store.date_gaps(panels.daily_prices(s, d))
)
query("s_union_distinct", "SELECT 'S' || s_suppkey AS ticker FROM supplier UNION SELECT 'S' || l_suppkey FROM lineitem")(
    lambda s, d: panels.descriptions(s, d).select("ticker").union(panels.table(s, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey"))).distinct()
)
query("s_common_dates", "SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders")(
    lambda s, d: panels.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).intersect(panels.table(s, d, "orders").select(F.to_date("o_orderdate")))
)
query("s_missing_names", "SELECT 'C' || c_custkey AS ticker FROM customer EXCEPT SELECT 'C' || o_custkey FROM orders")(
    lambda s, d: panels.table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("ticker")).distinct().join(panels.transactions(s, d).select("ticker"), "ticker", "left_anti")
)

# universe

_UNI = f"{MONTHLY}, {META}, x AS (SELECT p.*, sector, location, name FROM p LEFT JOIN meta USING (ticker)), y AS (SELECT *, {_roll('avg', 'volume * close', 20, 5)} AS adv, CASE WHEN mcap IS NOT NULL THEN {_pct('mcap', 'date')} END AS pr FROM x)"


def _named(spark, sf_dir):
    return panels.monthly_prices(spark, sf_dir).join(panels.descriptions(spark, sf_dir), "ticker", "left")


_UNIVERSES = {
    "u_price": (universe.Universe(least_price=1200.0), "close >= 1200"),
    "u_traded": (universe.Universe(least_traded=100000.0), "adv >= 100000"),
    "u_mcap_band": (universe.Universe(least_mcap=50000.0, most_mcap=500000.0), "mcap >= 50000 AND mcap <= 500000"),
    "u_small": (universe.Universe(small_share=0.3), "pr <= 0.3"),
    "u_static": (universe.Universe(without_sectors=("ASIA",), without_locations="nation_1|nation_2", without_names="[05]$"), "NOT coalesce(sector = 'ASIA', false) AND NOT coalesce(regexp_matches(location, '(?i)nation_1|nation_2'), false) AND NOT coalesce(regexp_matches(name, '[05]$'), false)"),
    "u_all": (universe.Universe(least_price=1000.0, least_traded=50000.0, small_share=0.8, sectors=("EUROPE", "AMERICA", "ASIA")), "close >= 1000 AND adv >= 50000 AND pr <= 0.8 AND sector IN ('EUROPE', 'AMERICA', 'ASIA')"),
}
for _name, (_limits, _sql) in _UNIVERSES.items():
    query(_name, f"{_UNI} SELECT ticker, date, {r('mcap')} AS mcap FROM y WHERE {_sql}")(lambda s, d, limits=_limits: universe.members(_named(s, d), limits).select("ticker", "date", "mcap"))


@query("u_profitable", f"{_ASOF} SELECT ticker, date, {r('netinc')} AS netinc FROM j WHERE netinc > 0")
def u_profitable(spark, sf_dir):
    p = as_of(panels.monthly_prices(spark, sf_dir), panels.filings(spark, sf_dir), "ticker", "date", "datekey", ["calendardate"], ["netinc"])
    return universe.members(p, universe.Universe(profitable=True)).select("ticker", "date", "netinc")


_DISTRESS = factor_sql(
    FACTOR_TABLES.replace("\nd AS (", "\nd_daily AS (").replace("WITH fl", MONTHLY + ", fl", 1)
    + ",\nd AS (SELECT p.*, sector FROM p LEFT JOIN meta USING (ticker))",
    LAYOUT, {"altman_z": catalog.altman_z()}, lambda v: v,
)


@query("u_distress", f"SELECT p.ticker, p.date, p.idx, {r('value')} AS altman_z FROM ({MONTHLY} SELECT * FROM p) p LEFT JOIN ({_DISTRESS}) USING (ticker, date) WHERE coalesce(value >= 1.81, true)")
def u_distress(spark, sf_dir):
    z = compile_all(factor_tables(spark, sf_dir, panels.monthly_prices), {"altman_z": catalog.altman_z()})
    return universe.members(z, universe.Universe(without_distress=True))


# selection, back-tests, rotation

_TOP = f"{_COMPOSITE}, sc AS (SELECT date, ticker, idx, round({_SCORE}, 9) AS score FROM z), tp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM sc WHERE score IS NOT NULL)"
query("t_top_n", f"{_TOP} SELECT date, ticker, {r('score')} AS score, CAST(rank AS INT) AS rank FROM tp WHERE rank <= 10")(lambda s, d: backtest.top_n(scores(s, d).withColumn("score", F.round("score", 9)), 10))
query(
    "t_rebalance_dates",
    f"{DAILY}, m AS (SELECT date_trunc('month', date) AS k, max(date) AS date, max(idx) AS idx FROM cal GROUP BY 1) SELECT date, CAST(idx AS INT) AS idx FROM m WHERE idx < (SELECT max(idx) FROM cal)",
)(lambda s, d: backtest.rebalance_dates(panels.daily_prices(s, d).select("date", "idx").distinct()))


def chosen(spark, sf_dir, n: int = 10) -> DataFrame:
    """idx, ticker, w: equal weights of the n best each month."""
    months = panels.monthly_prices(spark, sf_dir).select("date", "idx").distinct()
    top = backtest.top_n(scores(spark, sf_dir).withColumn("score", F.round("score", 9)), n)
    return top.join(F.broadcast(months), "date").select("idx", "ticker", portfolio.equal_weight("idx").alias("w"))


_W = f"{_TOP}, w AS (SELECT idx, ticker, 1.0 / count(*) OVER (PARTITION BY idx) AS w FROM tp WHERE rank <= 10)"
query("b_equal_weight", f"{_W} SELECT idx, ticker, {r('w')} AS w FROM w")(chosen)
query(
    "b_value_weight",
    f"{_TOP}, w AS (SELECT tp.date, tp.ticker, CASE WHEN mcap > 0 THEN mcap END AS m FROM tp JOIN p USING (ticker, date) WHERE rank <= 10), v AS (SELECT *, coalesce(m, quantile_cont(m, 0.5) OVER (PARTITION BY date)) AS mm FROM w) SELECT date, ticker, {r('coalesce(mm / sum(mm) OVER (PARTITION BY date), 1.0 / count(*) OVER (PARTITION BY date))')} AS w FROM v",
)(
    lambda s, d: portfolio.value_weights(
        backtest.top_n(scores(s, d).withColumn("score", F.round("score", 9)), 10).join(panels.monthly_prices(s, d).select("ticker", "date", "mcap"), ["ticker", "date"])
    ).select("date", "ticker", "w")
)
query("b_inverse_volatility", f"{MONTHLY}{MRET}, i AS (SELECT CAST(year(date) AS INT) AS year, ticker, {div('1.0', 'stddev_samp(r)')} AS v FROM pr GROUP BY 1, 2), j AS (SELECT year, ticker, coalesce(v, avg(v) OVER (PARTITION BY year)) AS v FROM i) SELECT year, ticker, {r('v / sum(v) OVER (PARTITION BY year)')} AS w FROM j")(
    lambda s, d: portfolio.inverse_volatility(monthly_returns(s, d).withColumn("year", F.year("date")), "year")
)
query(
    "b_capped",
    f"""{MONTHLY}, w AS (SELECT date, ticker, mcap / sum(mcap) OVER (PARTITION BY date) AS w FROM p WHERE mcap > 0),
k AS (SELECT *, row_number() OVER o - 1 AS k, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY date) AS n FROM w WINDOW o AS (PARTITION BY date ORDER BY w DESC, ticker)),
s AS (SELECT date, min(k) AS k FROM k WHERE w * (1 - k * 0.03) / rest <= 0.03 + 1e-15 GROUP BY 1), f AS (SELECT k.date, k.k AS first, (1 - k.k * 0.03) / rest AS scale FROM k JOIN s ON s.date = k.date AND s.k = k.k)
SELECT k.date, ticker, {r('CASE WHEN n * 0.03 <= 1 THEN 1.0 / n WHEN k < first THEN 0.03 ELSE w * scale END')} AS w FROM k LEFT JOIN f USING (date)""",
)(lambda s, d: portfolio.capped(portfolio.value_weights(panels.monthly_prices(s, d).filter("mcap > 0")), 0.03).select("date", "ticker", "w"))


query(
    "b_sector_cap",
    f"""{MONTHLY}, {META}, w AS (SELECT p.date, p.ticker, coalesce('s ' || sector, 'n ' || p.ticker) AS s, mcap / sum(mcap) OVER (PARTITION BY date) AS w FROM p LEFT JOIN meta USING (ticker) WHERE mcap > 0),
t AS (SELECT date, s, sum(w) AS w FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER o - 1 AS k, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY date) AS n FROM t WINDOW o AS (PARTITION BY date ORDER BY w DESC, s)),
m AS (SELECT date, min(k) AS k FROM k WHERE w * (1 - k * 0.3) / rest <= 0.3 + 1e-15 GROUP BY 1), f AS (SELECT k.date, k.k AS first, (1 - k.k * 0.3) / rest AS scale FROM k JOIN m ON m.date = k.date AND m.k = k.k),
l AS (SELECT k.date, s, CASE WHEN n * 0.3 < 1 - 1e-9 THEN 1.0 WHEN k < first THEN 0.3 / w ELSE scale END AS g FROM k LEFT JOIN f USING (date))
SELECT w.date, ticker, {r('w * g')} AS w FROM w JOIN l USING (date, s)""",
)(
    lambda s, d: portfolio.sector_capped(
        portfolio.value_weights(panels.monthly_prices(s, d).filter("mcap > 0")).join(panels.descriptions(s, d).select("ticker", "sector"), "ticker", "left"), 0.3
    ).select("date", "ticker", "w")
)
query(
    "b_trade_cost",
    f"""{_W}, c AS (SELECT coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.ticker, b.ticker) AS ticker, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS t FROM w a FULL JOIN w b ON a.idx = b.idx + 1 AND a.ticker = b.ticker)
SELECT c.idx, {r(f"sum(t) * 0.0015 + sum(coalesce(t * 0.1 * sqrt({div('t * 1e6', 'p.volume * p.close')}), 0))")} AS cost FROM c LEFT JOIN p ON p.ticker = c.ticker AND p.idx = c.idx GROUP BY 1""",
)(
    lambda s, d: portfolio.trade_cost(
        (lambda w: w.withColumnRenamed("w", "new").join(w.select((F.col("idx") + 1).alias("idx"), "ticker", F.col("w").alias("old")), ["idx", "ticker"], "full_outer"))(chosen(s, d))
        .join(panels.monthly_prices(s, d).select("idx", "ticker", (F.col("volume") * F.col("close")).alias("adv")), ["idx", "ticker"], "left"),
        by="idx", impact=0.1, value=1e6,
    )
)
_NOW = f"""{_TOP}, la AS (SELECT ticker, round(score, 9) AS score FROM sc WHERE date = (SELECT max(date) FROM sc WHERE date <= DATE '1999-06-15')),
td AS (SELECT ticker, close AS price FROM p WHERE close IS NOT NULL AND date = (SELECT max(date) FROM p WHERE date <= DATE '1999-06-15')),
hn AS (SELECT ticker, score, price FROM la JOIN td USING (ticker) WHERE score IS NOT NULL ORDER BY score DESC, ticker LIMIT 15)"""


def holdings_now(spark, sf_dir) -> DataFrame:
    return backtest.current_holdings(scores(spark, sf_dir).withColumn("score", F.round("score", 9)), panels.monthly_prices(spark, sf_dir), "1999-06-15", 15)


query("b_current_holdings", f"{_NOW} SELECT ticker, {r('1.0 / count(*) OVER ()')} AS weight, {r('score')} AS score, {r('price')} AS price FROM hn")(holdings_now)


def month_calendar(spark, sf_dir) -> DataFrame:
    return panels.monthly_prices(spark, sf_dir).select("date", "idx").distinct()


def book(spark, sf_dir) -> DataFrame:
    return backtest.run(chosen(spark, sf_dir), monthly_returns(spark, sf_dir).select("ticker", "idx", "r"), month_calendar(spark, sf_dir))


_BOOK = f"""{_W}, pr AS (SELECT *, {div('close', 'lag(close) OVER ' + W1)} - 1 AS r FROM p), od AS (SELECT idx, row_number() OVER (ORDER BY idx) AS seg, lead(idx) OVER (ORDER BY idx) + 1 AS l FROM (SELECT DISTINCT idx FROM w)),
sg AS (SELECT w.*, seg, od.idx + 2 AS f, coalesce(l, (SELECT max(idx) FROM p)) AS l FROM w JOIN od USING (idx)),
hd AS (SELECT seg, sg.ticker, pr.idx AS day, w, w * product(1 + coalesce(r, 0)) OVER (PARTITION BY seg, sg.ticker ORDER BY pr.idx ROWS UNBOUNDED PRECEDING) AS v FROM sg JOIN pr ON pr.ticker = sg.ticker AND pr.idx BETWEEN f AND l),
dy AS (SELECT seg, day, sum(v) AS v, sum(w) AS w0 FROM hd GROUP BY 1, 2), gr AS (SELECT *, {div('v', 'coalesce(lag(v) OVER (PARTITION BY seg ORDER BY day), w0)')} - 1 AS g, row_number() OVER (PARTITION BY seg ORDER BY day) AS n FROM dy),
en AS (SELECT seg + 1 AS seg, ticker, v / sum(v) OVER (PARTITION BY seg) AS e FROM (SELECT *, row_number() OVER (PARTITION BY seg, ticker ORDER BY day DESC) AS n FROM hd) WHERE n = 1),
td AS (SELECT coalesce(a.seg, b.seg) AS seg, sum(abs(coalesce(w, 0) - coalesce(e, 0))) AS t FROM sg a FULL JOIN en b ON a.seg = b.seg AND a.ticker = b.ticker GROUP BY 1),
bk AS (SELECT CAST(day AS INT) AS idx, g - CASE WHEN n = 1 THEN t * 0.0015 ELSE 0 END AS ret, CASE WHEN n = 1 THEN t / 2 END AS turnover FROM gr JOIN td USING (seg))"""
query("b_backtest", f"{_BOOK} SELECT idx, {r('ret')} AS ret, {r('turnover')} AS turnover FROM bk")(book)
query(
    "b_stats",
    f"""{_BOOK}, e AS (SELECT *, product(1 + ret) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS q FROM bk), d AS (SELECT *, q / max(q) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
a AS (SELECT product(1 + ret) - 1 AS total, pow(product(1 + ret), 12.0 / count(ret)) - 1 AS cagr, stddev_samp(ret) * sqrt(12.0) AS vol, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(12.0) AS dn, avg(ret) * 12 - 0.05 AS ex, min(dd) AS mdd, avg(turnover) AS tv, count(turnover) AS n FROM d)
SELECT {r('total')} AS total, {r('cagr')} AS cagr, {r('vol')} AS vol, {r('ex / vol')} AS sharpe, {r('ex / dn')} AS sortino, {r('mdd')} AS max_drawdown, {r('cagr / abs(mdd)')} AS calmar, {r('tv')} AS turnover, n AS rebalances FROM a""",
)(lambda s, d: backtest.stats(book(s, d), 12))
query(
    "b_band",
    f"""{_TOP.replace("WITH ", "WITH RECURSIVE ", 1)}, cd AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k, list(ticker ORDER BY rank) AS names FROM tp WHERE rank <= 15 GROUP BY idx),
fo AS (SELECT k, idx, names[1:10] AS held FROM cd WHERE k = 1 UNION ALL
  SELECT cd.k, cd.idx, (list_filter(names, lambda t: list_contains(held, t))[1:10] || list_filter(names, lambda t: NOT list_contains(held, t)))[1:10] FROM fo JOIN cd ON cd.k = fo.k + 1)
SELECT idx, unnest(held) AS ticker FROM fo""",
)(lambda s, d: backtest.with_band(scores(s, d).withColumn("score", F.round("score", 9)).join(F.broadcast(month_calendar(s, d)), "date"), 10, 1.5))


def _windowed(spark, sf_dir) -> DataFrame:
    """For each month the last 36 months, this one included, of the ten names chosen in it: rebalance, idx, ticker, r, score."""
    p = monthly_returns(spark, sf_dir).select("ticker", "idx", F.coalesce("r", F.lit(0.0)).alias("r"))
    score = scores(spark, sf_dir).join(F.broadcast(month_calendar(spark, sf_dir)), "date").select(F.col("idx").alias("rebalance"), "ticker", F.round("score", 9).alias("score"))
    names = chosen(spark, sf_dir).select(F.col("idx").alias("rebalance"), "ticker").join(score, ["rebalance", "ticker"])
    months = names.select("*", F.explode(F.sequence(F.col("rebalance") - 35, F.col("rebalance"))).alias("idx"))
    return months.join(p, ["ticker", "idx"]).select("rebalance", "idx", "ticker", "r", "score")


for _scheme in ("risk_parity", "hrp", "mvo", "black_litterman"):
    query(f"b_{_scheme}")(lambda s, d, scheme=_scheme: portfolio.optimised(_windowed(s, d), scheme, "rebalance", 0.4, least=24, periods=12))

ROTATION = rotation.Strategy("brands", ("Brand#1", "Brand#2"), ("Brand#3", "Brand#4", "Brand#5", "Brand#6"), ("Brand#7", "Brand#8"), top=2)
_ROT = f"""{DAILY}, me AS (SELECT ticker, CAST(year(date) * 12 + month(date) AS INT) AS idx, max_by(close, date) AS close FROM p WHERE close IS NOT NULL GROUP BY 1, 2),
sg AS (SELECT *, {_13612} AS mom, {div('close', f'lag(close) OVER {W1}')} - 1 AS r FROM me), nd AS (SELECT *, count(mom) OVER (PARTITION BY idx) AS k FROM sg WHERE ticker IN ({', '.join(repr(x) for x in ROTATION.needed)})),
fl AS (SELECT *, coalesce(max(CASE WHEN ticker IN ('Brand#1', 'Brand#2') THEN CAST(mom < 0 AS INT) END) OVER (PARTITION BY idx), 0) = 1 AS defensive FROM nd WHERE k = {len(ROTATION.needed)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY mom DESC, ticker) AS n FROM fl WHERE CASE WHEN defensive THEN ticker IN ('Brand#7', 'Brand#8') ELSE ticker IN ('Brand#3', 'Brand#4', 'Brand#5', 'Brand#6') END),
w AS (SELECT idx, ticker, defensive, 1.0 / count(*) OVER (PARTITION BY idx) AS w FROM rk WHERE n <= CASE WHEN defensive THEN 1 ELSE 2 END),
er AS (SELECT w.idx, sum(w * r) AS g, bool_or(defensive) AS defensive FROM w JOIN sg ON sg.ticker = w.ticker AND sg.idx = w.idx + 1 GROUP BY 1),
ow AS (SELECT idx + 1 AS idx, ticker, w AS o FROM w WHERE idx + 1 IN (SELECT idx FROM w)), tn AS (SELECT coalesce(w.idx, ow.idx) AS idx, sum(abs(coalesce(w, 0) - coalesce(o, 0))) AS t FROM w FULL JOIN ow ON w.idx = ow.idx AND w.ticker = ow.ticker GROUP BY 1),
rs AS (SELECT CAST(er.idx + 1 AS INT) AS idx, g - t * 0.001 AS ret, t AS turnover, defensive FROM er JOIN tn USING (idx))"""


def rotation_signals(spark, sf_dir) -> DataFrame:
    m = rotation.month_ends(panels.daily_prices(spark, sf_dir))
    order = Window.partitionBy("ticker").orderBy("idx")
    back = lambda n: F.lag("close", n).over(order)
    mom = sum((k * (safe_div(F.col("close"), back(n)) - 1) for k, n in ((12, 1), (4, 3), (2, 6), (1, 12))), F.lit(0.0))
    return m.select("ticker", "idx", mom.alias("mom"), (safe_div(F.col("close"), back(1)) - 1).alias("r"))


query("b_rotation_weights", f"{_ROT} SELECT idx, ticker, {r('w')} AS w, defensive FROM w")(lambda s, d: rotation.weights(rotation_signals(s, d), ROTATION))
query("b_rotation", f"{_ROT} SELECT idx, {r('ret')} AS ret, {r('turnover')} AS turnover, defensive FROM rs")(lambda s, d: rotation.run(rotation_signals(s, d), ROTATION))
query(
    "b_rotation_summary",
    f"""{_ROT}, q AS (SELECT *, product(1 + ret) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM rs), dd AS (SELECT *, e / greatest(max(e) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS d FROM q),
a AS (SELECT count(ret) AS months, pow(product(1 + ret), 12.0 / count(ret)) - 1 AS cagr, min(d) AS mdd, stddev_samp(ret) * sqrt(12.0) AS vol, avg(ret) * 12 AS m FROM dd)
SELECT 'brands' AS name, months, {r('cagr')} AS cagr, {r('mdd')} AS mdd, {r('vol')} AS vol, {r(div('cagr', 'abs(mdd)'))} AS calmar, {r(div('m', 'vol'))} AS sharpe FROM a""",
)(lambda s, d: rotation.summary(rotation.run(rotation_signals(s, d), ROTATION).withColumn("name", F.lit("brands"))))
query("b_rotation_overlay", f"{_ROT}, {BENCH}, ma AS (SELECT *, CASE WHEN count(close) OVER {rows(200, '')} >= 200 THEN avg(close) OVER {rows(200, '')} END AS ma FROM b), fg AS (SELECT CAST(year(date) * 12 + month(date) + 1 AS INT) AS idx, max_by(coalesce(close > ma, false), date) AS invested FROM ma GROUP BY 1) SELECT rs.idx, {r('CASE WHEN coalesce(invested, false) THEN ret ELSE 0.0 END')} AS ret FROM rs LEFT JOIN fg USING (idx)")(
    lambda s, d: rotation.with_overlay(rotation.run(rotation_signals(s, d), ROTATION), rotation.overlay(panels.benchmark(s, d))).select("idx", "ret")
)


def _late(k: int) -> str:
    """_ROT with momentum from closes of 5 k rows before, returns as they are."""
    late = f"(SELECT ticker, CAST(year(date) * 12 + month(date) AS INT) AS idx, max_by(c, date) AS close FROM (SELECT *, {'lag(close, ' + str(5 * k) + ') OVER ' + W1 if k else 'close'} AS c FROM p) WHERE c IS NOT NULL GROUP BY 1, 2)"
    plain = f"sg AS (SELECT l.ticker, l.idx, l.mom, o.r FROM (SELECT *, {_13612} AS mom FROM {late}) l JOIN (SELECT *, {div('close', f'lag(close) OVER {W1}')} - 1 AS r FROM me) o USING (ticker, idx)), "
    a, b = _ROT.index("sg AS ("), _ROT.index("nd AS (")
    return f"SELECT {k} AS sleeve, idx, ret FROM ({_ROT[:a]}{plain}{_ROT[b:]} SELECT * FROM rs)"


@query("b_rotation_tranches", f"SELECT idx, {r('avg(ret)')} AS ret FROM ({' UNION ALL '.join(map(_late, range(4)))}) GROUP BY idx HAVING count(*) = 4")
def b_rotation_tranches(spark, sf_dir):
    daily = panels.daily_prices(spark, sf_dir)
    plain = rotation_signals(spark, sf_dir)
    sleeves = None
    for k in range(4):
        late = daily.withColumn("close", ts.lag("close", 5 * k) if k else F.col("close"))
        m = rotation.month_ends(late).select("ticker", "idx", rotation.momentum_13612().alias("mom")).join(plain.select("ticker", "idx", "r"), ["ticker", "idx"])
        one = rotation.run(m, ROTATION).select(F.lit(k).alias("sleeve"), "idx", "ret")
        sleeves = one if sleeves is None else sleeves.unionByName(one)
    return rotation.tranches(sleeves, 4)


_OU = f"""{DAILY}, s AS (SELECT ticker, idx, ln(close) AS v, row_number() OVER (PARTITION BY ticker ORDER BY idx DESC) AS n FROM p WHERE close IS NOT NULL),
x AS (SELECT *, lead(v) OVER (PARTITION BY ticker ORDER BY idx) AS y FROM s WHERE n <= 60),
f AS (SELECT ticker, greatest(least(regr_slope(y, v), 1 - 1e-6), 1e-6) AS b, regr_intercept(y, v) AS a, regr_syy(y, v) AS syy, regr_sxy(y, v) AS sxy, regr_count(y, v) AS n, arg_max(v, idx) AS last FROM x GROUP BY 1),
g AS (SELECT *, -ln(b) * 252 AS theta, a / (1 - b) AS mu, sqrt(greatest(syy - b * sxy, 0) / greatest(n - 2, 1)) AS left_ FROM f),
ou AS (SELECT ticker, theta, mu, left_ * sqrt(2 * theta / (1 - b * b)) AS sigma, last, mu + (last - mu) * exp(-theta * 21 / 252) AS forecast FROM g)"""


@query("b_mean_reversion", f"{_OU} SELECT ticker, {r('theta')} AS theta, {r('mu')} AS mu, {r('sigma')} AS sigma, {r('last')} AS last, {r('forecast')} AS forecast, {r('forecast - last')} AS delta FROM ou")
def b_mean_reversion(spark, sf_dir):
    return rotation.mean_reversion(panels.daily_prices(spark, sf_dir).select("ticker", "idx", F.ln("close").alias("v")))


_DRAW = lambda k: f"(CAST('0x' || substr(md5('0-' || draw || '-' || ticker || '-{k}'), 1, 12) AS BIGINT) + 0.5) / pow(2.0, 48)"


@query(
    "b_win_share",
    f"""{_OU}, z AS (SELECT draw, ou.*, sqrt(-2 * ln({_DRAW(0)})) * cos(2 * pi() * {_DRAW(1)}) AS e, exp(-theta * 21 / 252) AS fade FROM ou CROSS JOIN range(1000) t(draw)),
v AS (SELECT draw, arg_max(ticker, (mu + (last - mu) * fade + sigma * sqrt((1 - fade * fade) / (2 * theta)) * e, ticker)) AS ticker FROM z WHERE theta IS NOT NULL GROUP BY 1)
SELECT ticker, {r('count(*) / 1000.0')} AS share FROM v GROUP BY 1""",
)
def b_win_share(spark, sf_dir):
    return rotation.win_share(b_mean_reversion(spark, sf_dir))


query("b_rebalance_plan", f"{_W}, k AS (SELECT max(idx) AS m FROM w), a AS (SELECT ticker, w FROM w, k WHERE idx = m), b AS (SELECT ticker, w FROM w, k WHERE idx = m - 1), j AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.w, 0) AS target, coalesce(b.w, 0) AS current FROM a FULL JOIN b ON a.ticker = b.ticker) SELECT ticker, {r('target')} AS target, {r('current')} AS current, {r('target - current')} AS diff, CASE WHEN current = 0 AND target > 0 THEN 'BUY' WHEN target = 0 AND current > 0 THEN 'SELL' WHEN target > current THEN 'ADD' WHEN target < current THEN 'TRIM' ELSE 'HOLD' END AS action FROM j")(
    lambda s, d: (lambda w, m: backtest.rebalance_plan(w.join(m, F.col("idx") == F.col("m")), w.join(m, F.col("idx") == F.col("m") - 1)))(chosen(s, d), chosen(s, d).agg(F.max("idx").alias("m")))
)

# over-fitting, search


def trials(spark, sf_dir) -> DataFrame:
    """period, config, r: monthly returns of the brands, gaps as 0."""
    m = rotation.month_ends(panels.daily_prices(spark, sf_dir))
    first = m.agg(F.min("idx").alias("lo"))
    change = safe_div(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("idx"))) - 1
    return m.crossJoin(F.broadcast(first)).select((F.col("idx") - F.col("lo")).alias("period"), F.col("ticker").alias("config"), F.round(F.coalesce(change, F.lit(0.0)), 9).alias("r"))


_TR = f"{DAILY}, me AS (SELECT ticker AS config, CAST(year(date) * 12 + month(date) AS INT) AS idx, max_by(close, date) AS close FROM p WHERE close IS NOT NULL GROUP BY 1, 2), tr AS (SELECT idx - (SELECT min(idx) FROM me) AS period, config, round(coalesce({div('close', 'lag(close) OVER (PARTITION BY config ORDER BY idx)')} - 1, 0.0), 9) AS r FROM me)"
_UNIT = overfitting.expected_best_sharpe(25, 1.0)
query(
    "a_deflated_sharpe",
    f"""{_TR}, mo AS (SELECT *, avg(r) OVER (PARTITION BY config) AS mu FROM tr), g AS (SELECT config, count(r)::DOUBLE AS n, avg(r) / stddev_samp(r) AS sr, {_MM(3)} / pow({_MM(2)}, 1.5) AS sk, {_MM(4)} / pow({_MM(2)}, 2) AS ku FROM mo GROUP BY 1)
SELECT config, n, {r('sr')} AS sharpe, {r('sk')} AS skew, {r('ku')} AS kurt, {r(f'(sr - sqrt((1 + 0.5 * sr * sr) / n) * {_UNIT!r}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr)')} AS z FROM g""",
)(lambda s, d: overfitting.deflated_sharpe(trials(s, d), 25, None, "config").drop("probability"))
_BLOCKS = f"""{_TR}, nn AS (SELECT max(period) + 1 AS n FROM tr), bl AS (SELECT CAST(CASE WHEN period < (n // 6 + 1) * (n % 6) THEN period // (n // 6 + 1) ELSE n % 6 + (period - (n // 6 + 1) * (n % 6)) // (n // 6) END AS INT) AS block, config, r FROM tr, nn)"""
query("a_block_moments", f"{_BLOCKS} SELECT block, config, count(r) AS n, {r('sum(r)')} AS s, {r('sum(r * r)')} AS ss FROM bl GROUP BY 1, 2")(lambda s, d: overfitting.block_moments(trials(s, d), 6))
_OMEGA = f"""{_BLOCKS.replace("n // 6", "n // 10").replace("n % 6", "n % 10")}, mom AS (SELECT block, config, count(r) AS n, sum(r) AS s, sum(r * r) AS ss FROM bl GROUP BY 1, 2),
cb AS (SELECT combo FROM range(1024) t(combo) WHERE bit_count(combo) = 5),
sm AS (SELECT combo, config, (combo >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM cb, mom GROUP BY 1, 2, 3),
sh AS (SELECT *, round(coalesce({div('s / n', 'sqrt(greatest((ss - n * (s / n) * (s / n)) / (n - 1), 0.0))')}, 0.0), 12) AS sharpe FROM sm),
be AS (SELECT combo, config FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY sharpe DESC, config) AS k FROM sh WHERE inside) WHERE k = 1),
om AS (SELECT combo, config, (rank() OVER (PARTITION BY combo ORDER BY sharpe) + (count(*) OVER (PARTITION BY combo, sharpe) - 1) / 2.0) / (count(*) OVER (PARTITION BY combo) + 1) AS omega FROM sh WHERE NOT inside)"""
query("a_overfitting", f"{_OMEGA} SELECT CAST(combo AS INT) AS combo, config, {r('omega')} AS omega, {r('ln(omega / (1 - omega))')} AS logit FROM om SEMI JOIN be USING (combo, config)")(
    lambda s, d: overfitting.backtest_overfitting(trials(s, d), 10)
)
query("a_overfitting_share", f"{_OMEGA} SELECT {r('avg(CAST(ln(omega / (1 - omega)) < 0 AS INT))')} AS pbo, count(*) AS combos FROM om SEMI JOIN be USING (combo, config)")(
    lambda s, d: overfitting.overfitting_share(overfitting.backtest_overfitting(trials(s, d), 10))
)


def _fold_returns(spark, sf_dir) -> DataFrame:
    return with_returns(panels.daily_prices(spark, sf_dir)).filter("r IS NOT NULL").select(F.col("ticker").alias("config"), "date", F.round("r", 9).alias("r"))


FOLDS = search.folds(date(1995, 1, 2), date(2001, 11, 4))


def folds_sql(first: str, last: str) -> str:
    """SQL of the folds (fo: fold, training a to b, test c to d), one test year after the other from three years on; for WITH RECURSIVE."""
    return f"""fs AS (SELECT 0 AS fold, {first} AS a, CAST({first} + INTERVAL 36 MONTH AS DATE) AS c, {last} AS l UNION ALL SELECT fold + 1, a, CAST(c + INTERVAL 12 MONTH AS DATE), l FROM fs WHERE CAST(c + INTERVAL 12 MONTH AS DATE) < l),
fo AS (SELECT fold, a, CAST(c - 31 AS DATE) AS b, c, CAST(least(CAST(c + INTERVAL 12 MONTH AS DATE) - 1, l) AS DATE) AS d FROM fs WHERE c < l AND least(CAST(c + INTERVAL 12 MONTH AS DATE) - 1, l) - c >= 60)"""


_WF = f"""{DAILY.replace("WITH li", "WITH RECURSIVE li", 1)}{RET}, {folds_sql("DATE '1995-01-02'", "DATE '2001-11-04'")}, rr AS (SELECT ticker AS config, date, round(r, 9) AS r FROM pr WHERE r IS NOT NULL),
ob AS (SELECT fold, config, count(r) AS n, CASE WHEN count(r) >= 60 AND abs(stddev_samp(r)) > 1e-9 THEN (avg(r) - 0.05 / 252) / stddev_samp(r) * sqrt(252.0) ELSE '-inf'::DOUBLE END AS objective FROM rr JOIN fo ON date BETWEEN a AND b GROUP BY 1, 2),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY objective DESC, config) AS place FROM ob) WHERE place <= 2 AND objective > '-inf'::DOUBLE)"""
query("b_fold_choice", f"{_WF} SELECT CAST(fold AS INT) AS fold, config, {r('objective')} AS objective, n, CAST(place AS INT) AS place FROM ch")(
    lambda s, d: search.walk_forward(_fold_returns(s, d), search.fold_table(s, FOLDS), 2)[0].select("fold", "config", "objective", "n", "place")
)
query("b_walk_forward", f"{_WF} SELECT CAST(fo.fold AS INT) AS fold, date, {r('avg(r)')} AS r FROM rr JOIN fo ON date BETWEEN c AND d JOIN ch ON ch.fold = fo.fold AND ch.config = rr.config GROUP BY 1, 2")(
    lambda s, d: search.walk_forward(_fold_returns(s, d), search.fold_table(s, FOLDS), 2)[1]
)


query(
    "a_calmar_objective",
    f"""{_TR}, e AS (SELECT *, product(1 + coalesce(r, 0)) OVER w AS e FROM tr WINDOW w AS (PARTITION BY config ORDER BY period ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, e / max(e) OVER (PARTITION BY config ORDER BY period ROWS UNBOUNDED PRECEDING) - 1 AS d FROM e)
SELECT config, {r("CASE WHEN count(r) >= 24 AND abs(min(d)) > 1e-9 THEN (pow(arg_max(e, period), 12.0 / count(r)) - 1) / abs(min(d)) ELSE '-inf'::DOUBLE END")} AS objective, count(r) AS n FROM g GROUP BY 1""",
)(lambda s, d: search.calmar_objective(trials(s, d), "config", order="period", least=24, periods=12))


@query(
    "b_weight_grid",
    f"""{_TR}, cb AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS combo, [a, b, c, d] AS k FROM range(5) t1(a), range(5) t2(b), range(5) t3(c), range(5) t4(d) WHERE a + b + c + d = 4),
rr AS (SELECT combo, period, sum(k[CAST(substr(config, 7) AS INT)] / 4.0 * r) AS r FROM cb, tr WHERE config IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') GROUP BY 1, 2)
SELECT CAST(combo AS INT) AS combo, {r("CASE WHEN count(r) >= 12 AND abs(stddev_samp(r)) > 1e-9 THEN (avg(r) - 0.05 / 12) / stddev_samp(r) * sqrt(12.0) ELSE '-inf'::DOUBLE END")} AS objective, count(r) AS n FROM rr GROUP BY 1""",
)
def b_weight_grid(spark, sf_dir):
    names = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
    combos = search.weight_grid(spark, names, 0.25)
    rows_ = trials(spark, sf_dir).join(F.broadcast(combos), F.col("config") == F.col("name")).groupBy("combo", "period").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return search.objective(rows_, "combo", least=12, periods=12)


@query("p_normal_quantile", f"SELECT i AS id, {r(normal('i / 1000.0'))} AS z FROM range(1, 1000) t(i)")
def p_normal_quantile(spark, sf_dir):
    return spark.range(1, 1000).select(F.col("id"), normal_quantile(F.col("id") / 1000).alias("z"))


query("p_percent_rank", "SELECT p_partkey, " + r("(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(p_size) OVER (PARTITION BY p_brand)") + " AS pct FROM part")(
    lambda s, d: panels.table(s, d, "part").select("p_partkey", percent_rank(F.col("p_size"), "p_brand").alias("pct"))
)
query("p_average_rank", "SELECT s_suppkey, (rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0)::DOUBLE AS rk FROM supplier")(
    lambda s, d: panels.table(s, d, "supplier").select("s_suppkey", average_rank(F.col("s_acctbal"), "s_nationkey").alias("rk"))
)
query("event_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, " + r("sum(value)") + " AS total FROM events GROUP BY 1, 2")(
    lambda s, d: panels.table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
)
