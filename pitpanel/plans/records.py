"""Queries of stored tables, of as-of joins on dates, of orders in whole shares, and of what else works on records, with SQL by hand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, backtest, crosssection, risk, rotation, store, universe
from ..operators import timeseries as ts
from ..sources import panels, tables
from .queries import _ASOF, _BOOK, _FIC, _NOW, _OU, _W, _pct, _DD, BENCH, DAILY, FILINGS, META, MONTHLY, MRET, b_mean_reversion, book, chosen, div, holdings_now, long_scores, monthly_returns, query, r, rows


def new_store(spark) -> tables.Store:
    """A store of its own in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "file://" + tempfile.mkdtemp(prefix="store-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_stores"
    return tables.Store(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")


def stored_prices(spark, sf_dir) -> tables.Store:
    """Prices up to 1997, restated ones from mid-1997 to 1999 without volumes, then what is missing."""
    source = panels.kept(panels.daily_prices(spark, sf_dir).filter("close IS NOT NULL").select("ticker", "date", "close", "volume"))
    kept = new_store(spark)
    kept.load("prices", source.filter("date < DATE '1998-01-01'"))
    again = source.filter("date BETWEEN DATE '1997-06-01' AND DATE '1999-12-31'").select("ticker", "date", (F.col("close") * 2).alias("close"))
    kept.load("prices", again)
    kept.load("prices", again)
    kept.fill(source.select("ticker"), "1992-01-01", "2002-12-31", lambda ranges: source.join(ranges, "ticker").filter("date BETWEEN start AND end").select(*source.columns))
    return kept


_STORED = f"""{DAILY}, st AS (SELECT ticker, date, CASE WHEN date BETWEEN DATE '1997-06-01' AND DATE '1999-12-31' THEN close * 2 ELSE close END AS close,
  CASE WHEN date NOT BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' THEN volume END AS volume FROM p WHERE close IS NOT NULL)"""
query("k_stored_prices", f"{_STORED} SELECT ticker, date, {r('close')} AS close, {r('volume')} AS volume FROM st")(lambda s, d: stored_prices(s, d).read("prices").select("ticker", "date", "close", "volume"))
query("k_stored_span", f"{_STORED} SELECT ticker, date, {r('close')} AS close FROM st WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-15' AND ticker IN ('Brand#3', 'Brand#7')")(
    lambda s, d: stored_prices(s, d).between("prices", "1996-03-01", "1998-02-15", ["Brand#3", "Brand#7"], ["ticker", "date", "close"])
)
query("k_stored_metadata", f"{_STORED} SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n_rows FROM st GROUP BY 1")(lambda s, d: stored_prices(s, d).metadata())




@query("k_stored_cleared", f"{_STORED} SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n_rows FROM st WHERE ticker NOT IN ('Brand#3', 'Brand#7') GROUP BY 1")
def k_stored_cleared(spark, sf_dir):
    """Two names are cleared, and the folders that no pointer names are deleted."""
    kept = stored_prices(spark, sf_dir)
    kept.clear("prices", ["Brand#3", "Brand#7"])
    kept.purge("prices")
    return kept.metadata()


@query("k_stored_filings", f"{FILINGS} SELECT ticker, calendardate, datekey, 'ARQ' AS dimension, {r('revenue')} AS revenue, {r('netinc')} AS netinc FROM f WHERE datekey IS NOT NULL")
def k_stored_filings(spark, sf_dir):
    """Filings arrive in two loads of which the second restates the first one's last year; the first filing of a quarter stays."""
    source = panels.kept(panels.filings(spark, sf_dir).filter("datekey IS NOT NULL").select("ticker", "calendardate", "datekey", "revenue", "netinc"))
    kept = new_store(spark)
    kept.load("fundamentals", source.filter("calendardate < DATE '1998-06-30'"))
    restated = source.filter("calendardate BETWEEN DATE '1997-06-30' AND DATE '1998-03-31'").withColumns({"datekey": F.date_add("datekey", 30), "revenue": F.col("revenue") * 3})
    kept.load("fundamentals", restated.unionByName(source.filter("calendardate >= DATE '1998-06-30'")))
    return kept.read("fundamentals").select("ticker", "calendardate", "datekey", "dimension", "revenue", "netinc")


_TX = "t AS (SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1, 2), l AS (SELECT ticker, CAST(date + 10 AS DATE) AS date FROM t)"


def _bought(spark, sf_dir) -> DataFrame:
    found = panels.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return found.agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))


for _name, _ahead, _days, _sql in (("j_nearest_before", False, 8, "l.date >= t.date"), ("j_nearest_after", True, 30, "l.date <= t.date")):
    query(_name, f"WITH {_TX}, j AS (SELECT l.ticker, l.date, t.date AS f, amount FROM l ASOF LEFT JOIN t ON l.ticker = t.ticker AND {_sql}) SELECT ticker, date, CASE WHEN abs(f - date) <= {_days} THEN f END AS found, CASE WHEN abs(f - date) <= {_days} THEN {r('amount')} END AS amount FROM j")(
        lambda s, d, ahead=_ahead, days=_days: (lambda t: asof.nearest(t.select("ticker", F.date_add("date", 10).alias("date")), t, "ticker", "date", "date", ["amount"], ahead, days))(_bought(s, d))
    )
query(
    "j_months_before",
    f"{DAILY}, k AS (SELECT ticker, date, close FROM p WHERE close IS NOT NULL), a AS (SELECT ticker, date, close, CAST(date - INTERVAL 3 MONTH AS DATE) AS ask FROM p) SELECT a.ticker, a.date, {r(div('a.close', 'k.close') + ' - 1')} AS grown FROM a ASOF LEFT JOIN k ON a.ticker = k.ticker AND a.ask >= k.date",
)(lambda s, d: asof.months_before(panels.daily_prices(s, d).select("ticker", "date", "close"), 3).select("ticker", "date", (F.when(F.abs("start") > 1e-9, F.col("close") / F.col("start")) - 1).alias("grown")))

query(
    "b_share_plan",
    f"""{_NOW.replace("WITH ", "WITH RECURSIVE ", 1)}, ho AS (SELECT 'S' || s_suppkey AS ticker, CAST(s_suppkey % 7 AS BIGINT) AS shares FROM supplier), tg AS (SELECT ticker, 1.0 / count(*) OVER () AS w FROM hn),
x AS (SELECT ticker, coalesce(shares, 0) AS shares, coalesce(w, 0) AS w, CASE WHEN price > 0 THEN price END AS price FROM ho FULL JOIN tg USING (ticker) LEFT JOIN (SELECT ticker, price FROM td WHERE price > 0) USING (ticker) WHERE coalesce(shares, 0) > 0 OR coalesce(w, 0) > 0),
y AS (SELECT *, w * (sum(coalesce(shares * price, 0)) OVER () + 20000) AS target FROM x), sh AS (SELECT *, target - coalesce(shares * price, 0) AS short FROM y),
so AS (SELECT *, CAST(CASE WHEN price IS NULL THEN 0 WHEN w = 0 THEN shares ELSE floor(greatest(-short, 0) / price) END AS BIGINT) AS sold, CAST(CASE WHEN short > 0 AND price IS NOT NULL THEN floor(short / price) ELSE 0 END AS BIGINT) AS most FROM sh),
o AS (SELECT *, row_number() OVER (ORDER BY sold = 0, CASE WHEN sold = 0 THEN -short ELSE 0 END, ticker) AS k FROM so),
wk AS (SELECT 0 AS k, 20000.0::DOUBLE AS cash, 0::BIGINT AS trade UNION ALL
  SELECT o.k, c - coalesce(b * price, 0), b - sold FROM (SELECT o.*, wk.cash + coalesce(sold * price, 0) AS c, greatest(least(most, coalesce(CAST(floor((wk.cash + coalesce(sold * price, 0)) / price) AS BIGINT), 0)), 0) AS b FROM wk JOIN o ON o.k = wk.k + 1) o),
zf AS (SELECT o.*, wk.cash, trade, shares + trade AS final_shares FROM o JOIN wk USING (k))
SELECT CAST(k - 1 AS INT) AS step, ticker, {r('price')} AS price, shares, {r('target')} AS target, trade, CASE WHEN trade > 0 THEN 'BUY' WHEN trade < 0 THEN 'SELL' ELSE 'HOLD' END AS action, final_shares, {r('cash')} AS cash,
  {r('coalesce(final_shares * price, 0) / sum(coalesce(final_shares * price, 0)) OVER () - w')} AS error FROM zf""",
)(
    lambda s, d: backtest.share_plan(
        holdings_now(s, d).select("ticker", F.col("weight").alias("w")), panels.table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), (F.col("s_suppkey") % 7).alias("shares")),
        panels.monthly_prices(s, d).filter("date = DATE '1999-05-31'").select("ticker", F.col("close").alias("price")), 20000.0,
    )
)

_U = lambda k: f"(CAST('0x' || substr(md5('0-' || draw || '-' || ticker || '-' || (step + 1) || '-{k}'), 1, 12) AS BIGINT) + 0.5) / pow(2.0, 48)"
query(
    "b_simulated",
    f"""{_OU.replace("WITH ", "WITH RECURSIVE ", 1)}, pa AS (SELECT ticker, theta, mu, sigma, draw, 0 AS step, last AS v FROM ou CROSS JOIN range(500) t(draw) WHERE theta IS NOT NULL UNION ALL
SELECT ticker, theta, mu, sigma, draw, step + 1, v + theta * (mu - v) / 252 + sigma * sqrt(1.0 / 252) * sqrt(-2 * ln({_U(0)})) * cos(2 * pi() * {_U(1)}) FROM pa WHERE step < 21)
SELECT ticker, CAST(step AS INT) AS step, {r('avg(v)')} AS mean, {r('quantile_cont(v, 0.05)')} AS q05, {r('quantile_cont(v, 0.5)')} AS q50, {r('quantile_cont(v, 0.95)')} AS q95 FROM pa GROUP BY 1, 2""",
)(lambda s, d: rotation.simulated(panels.kept(b_mean_reversion(s, d)), 500))


_MONTHS = f"mb AS (SELECT CAST(year(date) * 12 + month(date) AS INT) AS idx, max_by(close, date) AS close FROM b GROUP BY 1), ea AS (SELECT idx, CASE WHEN count(close) OVER {rows(6, '')} < 6 OR close > avg(close) OVER {rows(6, '')} THEN 1.0 ELSE 0.0 END AS e FROM mb), el AS (SELECT idx, lag(e) OVER (ORDER BY idx) AS e FROM ea)"


@query("b_timed_backtest", f"{_BOOK}, {BENCH}, {_MONTHS} SELECT bk.idx, {r('ret * coalesce(e, 1.0)')} AS ret FROM bk LEFT JOIN el USING (idx)")
def b_timed_backtest(spark, sf_dir):
    bench = panels.benchmark(spark, sf_dir).groupBy((F.year("date") * 12 + F.month("date")).alias("idx")).agg(F.max_by("close", "date").alias("close"))
    return backtest.apply_exposure(book(spark, sf_dir), ts.ma_exposure(bench, 6)).select("idx", "ret")


_CAGR, _VOL = "CASE WHEN count(r) > 0 THEN pow(product(1 + coalesce(r, 0)), 12.0 / count(r)) - 1 END", "stddev_samp(r) * sqrt(12.0)"
query(
    "a_metric_bundle",
    f"""{MONTHLY}{MRET}{_DD} SELECT ticker, count(r) AS n, {r('product(1 + coalesce(r, 0)) - 1')} AS total, {r(_CAGR)} AS cagr, {r(_VOL)} AS vol, {r(div('avg(r) * 12 - 0.05', _VOL))} AS sharpe, {r('-min(dd)')} AS max_drawdown,
  {r(div(_CAGR, '-min(dd)'))} AS calmar, {r(div('avg(r) * 12', '-min(dd)'))} AS calmar_mean, {r('avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INT) END)')} AS win_rate FROM d GROUP BY ticker""",
)(lambda s, d: risk.bundle(monthly_returns(s, d), "ticker"))
query("a_pick_shares", f"{_W} SELECT ticker, {r('count(*) / (SELECT count(*) FROM w)::DOUBLE')} AS share FROM w GROUP BY 1")(lambda s, d: risk.frequencies(chosen(s, d)))
query("u_industry", f"WITH {META} SELECT ticker, sector, industry FROM meta WHERE (sector = 'ASIA' AND regexp_matches(industry, '(?i)nation_1|nation_2')) OR sector = 'EUROPE'")(
    lambda s, d: panels.descriptions(s, d).filter(universe.industry_mask(F.col("sector"), F.col("industry"), {"east": ("ASIA", ("nation_1", "nation_2")), "west": ("EUROPE", ())})).select("ticker", "sector", "industry")
)


@query(
    "u_profitable_year",
    f"{_ASOF.replace('k AS (SELECT * FROM f WHERE', f'k AS (SELECT *, CASE WHEN count(netinc) OVER {rows(4)} >= 4 THEN sum(netinc) OVER {rows(4)} END AS ttm FROM f QUALIFY').replace('k.netinc, k.revenue', 'k.ttm')} SELECT ticker, date, {r('ttm')} AS netinc_ttm FROM j WHERE ttm > 0",
)
def u_profitable_year(spark, sf_dir):
    filed = panels.filings(spark, sf_dir).withColumn("netinc_ttm", ts.ttm("netinc"))
    p = asof.as_of(panels.monthly_prices(spark, sf_dir), filed, "ticker", "date", "datekey", ["calendardate"], ["netinc_ttm"])
    return universe.members(p, universe.Universe(profitable_year=True)).select("ticker", "date", "netinc_ttm")


query("k_duplicate_dates", "SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda s, d: store.duplicate_dates(panels.transactions(s, d).withColumnRenamed("filingdate", "date"))
)
query("j_validity", f"{FILINGS} SELECT ticker, datekey, {r('revenue')} AS revenue, lead(datekey) OVER (PARTITION BY ticker ORDER BY datekey) AS valid_to FROM f WHERE datekey IS NOT NULL")(
    lambda s, d: asof.validity(panels.filings(s, d), "ticker", "datekey", ["calendardate"]).select("ticker", "datekey", "revenue", "valid_to")
)

query(
    "a_factor_lab",
    f"""{_FIC}, zf AS (SELECT date, ticker, fwd, f.factor AS factor, f.z AS z FROM zl), ok AS (SELECT * FROM zf WHERE z IS NOT NULL AND fwd IS NOT NULL),
qd AS (SELECT date, factor, fwd, CAST(ceil({_pct('z', 'date, factor')} * 10) AS INT) AS q FROM ok), qr AS (SELECT date, factor, q, avg(fwd) AS ret FROM qd GROUP BY 1, 2, 3 HAVING count(*) >= 2),
sp AS (SELECT factor, date, max(CASE WHEN q = 10 THEN ret END) - max(CASE WHEN q = 1 THEN ret END) AS s FROM qr GROUP BY 1, 2), sq AS (SELECT factor, avg(s) AS spread, {div('avg(s)', 'stddev_samp(s)')} * sqrt(greatest(count(s), 2.0)) AS spread_t FROM sp GROUP BY 1),
mo AS (SELECT factor, corr(q::DOUBLE, rk) AS monotonicity FROM (SELECT factor, q, rank() OVER (PARTITION BY factor ORDER BY avg(ret))::DOUBLE AS rk FROM qr GROUP BY 1, 2) GROUP BY 1),
pc AS (SELECT date, ticker, factor, CASE WHEN z IS NOT NULL THEN {_pct('z', 'date, factor')} END AS p FROM zf), mv AS (SELECT factor, ticker, abs(p - lag(p) OVER (PARTITION BY factor, ticker ORDER BY date)) AS m FROM pc),
tv AS (SELECT factor, avg(m) AS turnover FROM (SELECT factor, ticker, avg(m) AS m FROM mv GROUP BY 1, 2) GROUP BY 1), cv AS (SELECT factor, count(z) / count(*)::DOUBLE AS coverage FROM zf GROUP BY 1),
ii AS (SELECT factor, avg(ic) AS ic, {div('avg(ic)', 'stddev_samp(ic)')} AS ic_ir FROM fic GROUP BY 1)
SELECT factor, {r('ic')} AS ic, {r('ic_ir')} AS ic_ir, {r('spread')} AS spread, {r('spread_t')} AS spread_t, {r('monotonicity')} AS monotonicity, {r('turnover')} AS turnover, {r('coverage')} AS coverage,
  coalesce(abs(spread_t) >= 2 AND monotonicity >= 0.6 AND turnover <= 0.15, false) AS promoted FROM ii JOIN sq USING (factor) JOIN mo USING (factor) JOIN tv USING (factor) JOIN cv USING (factor)""",
)(lambda s, d: crosssection.lab(panels.kept(long_scores(s, d))))
