"""Queries of declared strategies and of the search for their parameters, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import backtest, crosssection, search, strategy, walkforward
from ..operators.universe import Universe
from ..sources import panels
from .queries import BENCH, DAILY, RET, _Z, div, folds_sql, normal, query, r, rows
from .rotations import _cdf, pbo_sql

FACTORS = ("close", "mcap", "volume")
DECLARED = (
    strategy.Declared("large_timed", (("close", 2.0), ("mcap", -1.0), ("volume", 1.0)), n=6, timing_days=200, reentry_days=5, slippage_bps=15.0),
    strategy.Declared("small_quarterly", (("mcap", -1.0), ("volume", 1.0)), Universe(least_price=1000.0, least_traded=1000.0), n=8, rebalance="quarter", weighting="value", max_weight=0.16, impact=0.1, worth=1e6),
    strategy.Declared("calm", (("volume", 1.0),), Universe(least_traded=500.0), n=5, weighting="inverse_volatility", window=126, max_weight=0.3, target_volatility=0.15),
)


def market(spark, sf_dir) -> strategy.Market:
    """Brands on trading days; factors are their standardised columns on the last day of each month."""
    daily, bench = panels.daily_prices(spark, sf_dir), panels.benchmark(spark, sf_dir)
    last = backtest.rebalance_dates(bench.select("date", "idx")).select("idx")
    at = daily.join(F.broadcast(last), "idx")
    z = at.select("idx", "ticker", *[crosssection.zscore(c).alias(c) for c in FACTORS]).unpivot(["idx", "ticker"], list(FACTORS), "factor", "z")
    return strategy.Market(daily, z, bench)


def _v(x) -> str:
    return "NULL" if x is None else repr(x)


def book_sql(declared) -> str:
    """SQL of the daily returns (bk: config, idx, ret, turnover) of strategies, every one a row of cfg."""
    cfg = ", ".join(
        "(" + ", ".join(map(_v, (s.name, s.n, int(s.rebalance == "quarter"), s.weighting, s.max_weight, s.window, (s.commission_bps + s.slippage_bps) / 1e4, s.impact, s.worth, s.coverage, s.timing_days, s.reentry_days, s.target_volatility, s.volatility_window, s.universe.least_price, s.universe.least_traded))) + ")"
        for s in declared
    )
    fw = ", ".join(f"({s.name!r}, {f!r}, {w!r})" for s in declared for f, w in s.factors if w)
    windows = sorted({s.window for s in declared if s.weighting == "inverse_volatility"})
    spread = " UNION ALL ".join(f"SELECT {n} AS win, ticker, idx, CASE WHEN count(r) OVER {rows(n)} >= 2 THEN stddev_samp(r) OVER {rows(n)} END AS sdv FROM pr" for n in windows or [2])
    days = sorted({s.timing_days for s in declared if s.timing_days}) or [2]
    vols = sorted({s.volatility_window for s in declared if s.target_volatility}) or [2]
    own = lambda n: rows(n, "PARTITION BY config")
    mean = " ".join(f"WHEN {n} THEN CASE WHEN count(close) OVER {own(n)} >= {n} THEN avg(close) OVER {own(n)} END" for n in days)
    sd = " ".join(f"WHEN {n} THEN CASE WHEN count(m) OVER {own(n)} >= {n} THEN stddev_samp(m) OVER {own(n)} END" for n in vols)
    return f"""{DAILY}{RET}, {BENCH},
cfg AS (SELECT * FROM (VALUES {cfg}) t(config, n, qe, scheme, cap, win, rate, impact, worth, coverage, days, back, target, volwin, price, traded)),
fw AS (SELECT * FROM (VALUES {fw}) t(config, factor, w)),
sd AS (SELECT max(date) AS date, max(idx) AS idx FROM b GROUP BY date_trunc('month', date) HAVING max(idx) < (SELECT max(idx) FROM b)),
ad AS (SELECT ticker, date, idx, close, closeunadj, mcap, CASE WHEN count(volume * close) OVER {rows(20)} >= 5 THEN avg(volume * close) OVER {rows(20)} END AS adv5, avg(volume * close) OVER {rows(20)} AS adv1 FROM p),
zz AS (SELECT ticker, idx, {', '.join(f"{_Z(c)} AS {c}" for c in FACTORS)} FROM p WHERE idx IN (SELECT idx FROM sd)),
zl AS (UNPIVOT zz ON {', '.join(FACTORS)} INTO NAME factor VALUE z),
ft AS (SELECT config, coverage * sum(abs(w)) AS least FROM fw JOIN cfg USING (config) GROUP BY config, coverage),
sc AS (SELECT config, idx, ticker, round(sum(z * w) / sum(abs(w)), 9) AS score FROM zl JOIN fw USING (factor) JOIN ft USING (config) WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(abs(w)) >= any_value(least)),
tp AS (SELECT sc.*, a.mcap, row_number() OVER (PARTITION BY config, sc.idx ORDER BY score DESC, sc.ticker) AS k, cfg.n, scheme, cap, win FROM sc JOIN cfg USING (config) JOIN sd ON sd.idx = sc.idx AND (qe = 0 OR month(sd.date) % 3 = 0)
  JOIN ad a ON a.ticker = sc.ticker AND a.idx = sc.idx AND a.close IS NOT NULL AND (price IS NULL OR coalesce(closeunadj, close) >= price) AND (traded IS NULL OR adv5 >= traded)),
rv AS ({spread}),
w0 AS (SELECT tp.*, CASE scheme WHEN 'value' THEN CASE WHEN mcap > 0 THEN mcap END WHEN 'inverse_volatility' THEN {div('1.0', 'sdv')} END AS raw FROM tp LEFT JOIN rv ON rv.win = tp.win AND rv.ticker = tp.ticker AND rv.idx = tp.idx WHERE k <= n),
w1 AS (SELECT *, CASE scheme WHEN 'value' THEN coalesce(raw, quantile_cont(raw, 0.5) OVER g) WHEN 'inverse_volatility' THEN coalesce(raw, avg(raw) OVER g) END AS x FROM w0 WINDOW g AS (PARTITION BY config, idx)),
w2 AS (SELECT config, idx, ticker, cap, coalesce(x / sum(x) OVER g, 1.0 / count(*) OVER g) AS w FROM w1 WINDOW g AS (PARTITION BY config, idx)),
w3 AS (SELECT *, row_number() OVER o - 1 AS k, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY config, idx) AS m FROM w2 WINDOW o AS (PARTITION BY config, idx ORDER BY w DESC, ticker)),
w4 AS (SELECT config, idx, min(k) AS first FROM w3 WHERE w * (1 - k * cap) / rest <= cap + 1e-15 GROUP BY 1, 2),
w5 AS (SELECT w3.config, w3.idx, first, (1 - k * cap) / rest AS scale FROM w3 JOIN w4 ON w4.config = w3.config AND w4.idx = w3.idx AND k = first),
w AS (SELECT w3.config, w3.idx, ticker, CASE WHEN m * cap <= 1 THEN 1.0 / m WHEN k < first THEN cap ELSE w * scale END AS w FROM w3 LEFT JOIN w5 USING (config, idx)),
od AS (SELECT config, idx, row_number() OVER q AS seg, lead(idx) OVER q + 1 AS l FROM (SELECT DISTINCT config, idx FROM w) WINDOW q AS (PARTITION BY config ORDER BY idx)),
sg AS (SELECT w.*, seg, od.idx + 2 AS f, coalesce(l, (SELECT max(idx) FROM b)) AS l FROM w JOIN od USING (config, idx)),
hd AS (SELECT config, seg, sg.ticker, pr.idx AS day, w, w * product(1 + coalesce(r, 0)) OVER (PARTITION BY config, seg, sg.ticker ORDER BY pr.idx ROWS UNBOUNDED PRECEDING) AS v FROM sg JOIN pr ON pr.ticker = sg.ticker AND pr.idx BETWEEN f AND l),
dy AS (SELECT config, seg, day, sum(v) AS v, sum(w) AS w0 FROM hd GROUP BY 1, 2, 3),
gr AS (SELECT *, {div('v', 'coalesce(lag(v) OVER (PARTITION BY config, seg ORDER BY day), w0)')} - 1 AS g, row_number() OVER (PARTITION BY config, seg ORDER BY day) AS n FROM dy),
en AS (SELECT config, seg + 1 AS seg, ticker, v / sum(v) OVER (PARTITION BY config, seg) AS e FROM (SELECT *, row_number() OVER (PARTITION BY config, seg, ticker ORDER BY day DESC) AS n FROM hd) WHERE n = 1),
mv AS (SELECT coalesce(a.config, e.config) AS config, coalesce(a.seg, e.seg) AS seg, coalesce(a.ticker, e.ticker) AS ticker, abs(coalesce(w, 0) - coalesce(e, 0)) AS t FROM sg a FULL JOIN en e ON a.config = e.config AND a.seg = e.seg AND a.ticker = e.ticker),
td AS (SELECT mv.config, mv.seg, sum(t) AS t, sum(t) * any_value(rate) + coalesce(sum(t * any_impact * sqrt(greatest({div('t * any_worth', 'adv1')}, 0))), 0) AS cost
  FROM (SELECT mv.*, od.idx, rate, impact AS any_impact, worth AS any_worth FROM mv JOIN od USING (config, seg) JOIN cfg USING (config)) mv LEFT JOIN ad ON ad.ticker = mv.ticker AND ad.idx = mv.idx GROUP BY 1, 2),
bm AS (SELECT *, {div('close', 'lag(close) OVER (ORDER BY idx)')} - 1 AS m FROM b),
b1 AS (SELECT config, idx, back, target, CASE days {mean} END AS ma, close, CASE volwin {sd} END * sqrt(252.0) AS vol FROM bm, cfg),
b2 AS (SELECT *, sum(CASE WHEN ma IS NOT NULL AND close <= ma THEN 1 ELSE 0 END) OVER (PARTITION BY config ORDER BY idx) AS downs FROM b1),
b3 AS (SELECT *, sum(CASE WHEN close > ma THEN 1 ELSE 0 END) OVER (PARTITION BY config, downs ORDER BY idx) AS run FROM b2),
ex AS (SELECT config, idx, lag(CASE WHEN ma IS NULL OR (back = 0 AND close > ma) OR (back > 0 AND (downs = 0 OR close > ma AND run >= back)) THEN 1.0 ELSE 0.0 END * CASE WHEN target IS NULL OR vol IS NULL OR vol <= 1e-9 THEN 1.0 ELSE least(target / vol, 1.0) END) OVER (PARTITION BY config ORDER BY idx) AS e FROM b3),
bk AS (SELECT gr.config, CAST(day AS INT) AS idx, (g - CASE WHEN n = 1 THEN cost ELSE 0 END) * coalesce(e, 1.0) AS ret, CASE WHEN n = 1 THEN t / 2 END AS turnover FROM gr JOIN td USING (config, seg) LEFT JOIN ex ON ex.config = gr.config AND ex.idx = day)"""


_DECLARED = book_sql(DECLARED)
query("b_declared_weights", f"{_DECLARED} SELECT config, CAST(idx AS INT) AS idx, ticker, {r('w')} AS w FROM w")(lambda s, d: strategy.weights(market(s, d), DECLARED))
query("b_declared_returns", f"{_DECLARED} SELECT config, idx, {r('ret', 9)} AS ret, {r('turnover', 9)} AS turnover FROM bk", places=9)(lambda s, d: strategy.returns(market(s, d), DECLARED))
query(
    "b_declared_summary",
    f"""{_DECLARED}, e AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY config ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM bk), d AS (SELECT *, e / max(e) OVER (PARTITION BY config ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
a AS (SELECT config, count(ret) AS days, product(1 + coalesce(ret, 0)) AS g, stddev_samp(ret) * sqrt(252.0) AS vol, avg(ret) * 252 - 0.05 AS x, min(dd) AS mdd, avg(turnover) AS tv FROM d GROUP BY 1)
SELECT config, days, {r('g - 1')} AS total, {r('pow(g, 252.0 / days) - 1')} AS cagr, {r('vol')} AS vol, {r(div('x', 'vol'))} AS sharpe, {r('mdd')} AS max_drawdown, {r('tv')} AS turnover FROM a""",
)(lambda s, d: strategy.summary(strategy.returns(market(s, d), DECLARED)))
query(
    "b_declared_now",
    f"""{_DECLARED}, la AS (SELECT config, max(idx) AS idx FROM w WHERE idx <= (SELECT max(idx) FROM b WHERE date <= DATE '1999-06-15') GROUP BY 1), pc AS (SELECT ticker, max_by(close, date) AS price FROM p WHERE close IS NOT NULL AND date <= DATE '1999-06-15' GROUP BY 1)
SELECT config, ticker, {r('w')} AS weight, {r('price')} AS price FROM w JOIN la USING (config, idx) JOIN pc USING (ticker)""",
)(lambda s, d: strategy.current_holdings(market(s, d), DECLARED, "1999-06-15"))
#: One strategy under each scheme that needs a covariance; no SQL, tests hold the weights against plain numpy.
FITTED = tuple(strategy.Declared(scheme, (("mcap", -1.0), ("volume", 1.0)), n=6, rebalance="quarter", weighting=scheme, window=120, max_weight=0.4) for scheme in strategy.OPTIMISED)


@query("b_declared_fitted")
def b_declared_fitted(spark, sf_dir):
    """On closes that stand where a day has no trade, so that windows have complete rows."""
    at = market(spark, sf_dir)
    past = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return strategy.weights(strategy.Market(at.daily.withColumn("close", F.last("close", ignorenulls=True).over(past)), at.factors, at.benchmark), FITTED)


# search inside walk-forward

BASE = strategy.Declared("base", (("close", 2.0), ("mcap", -1.0), ("volume", 1.0)), n=6)
SPACE = {"n": ("int", 4, 8), "rebalance": ("cat", ["month", "quarter"]), "w_close": ("float", 0.0, 2.0)}


def tried(spark, sf_dir, method: str, **how) -> walkforward.Found:
    """A search over BASE's parameters in the folds of the table's own calendar."""
    at = market(spark, sf_dir)
    bench = panels.kept(at.benchmark)
    at = strategy.Market(panels.kept(at.daily), panels.kept(at.factors), bench)
    first, last = bench.agg(F.min("date"), F.max("date")).first()

    def returns_of(configs):
        rows_ = strategy.returns(at, [BASE.with_params(name, params) for name, params in configs.items()])
        return rows_.join(F.broadcast(bench.select("idx", "date")), "idx").select("config", "date", F.round("ret", 9).alias("r"))

    return walkforward.run(spark, returns_of, SPACE, search.folds(first, last), panels.kept, method, **how)


GRID = {walkforward.key(p): p for p in walkforward.lattice(SPACE, 2)}
_ORDER = ", ".join(f"({k}, {c!r}, {p['n']!r}, {p['w_close']!r})" for k, (c, p) in enumerate(GRID.items()))
_GRID = f"""{book_sql([BASE.with_params(c, p) for c, p in GRID.items()]).replace("WITH li", "WITH RECURSIVE li", 1)},
tr AS (SELECT * FROM (VALUES {_ORDER}) t(trial, config, p_n, p_close)), {folds_sql("(SELECT min(date) FROM b)", "(SELECT max(date) FROM b)")},
rr AS MATERIALIZED (SELECT config, date, round(ret, 9) AS r FROM bk JOIN b USING (idx) WHERE ret IS NOT NULL),
lg AS MATERIALIZED (SELECT fo.fold, trial, tr.config, coalesce(CASE WHEN count(r) >= 60 AND abs(stddev_samp(r)) > 1e-9 THEN (avg(r) - 0.05 / 252) / stddev_samp(r) * sqrt(252.0) END, '-inf'::DOUBLE) AS objective, count(r) AS n
  FROM fo CROSS JOIN tr LEFT JOIN rr ON rr.config = tr.config AND rr.date BETWEEN fo.a AND fo.b GROUP BY 1, 2, 3),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY objective DESC, trial) AS place FROM lg) WHERE place <= 2 AND (objective > '-inf'::DOUBLE OR place = 1)),
te AS (SELECT ch.fold, date, avg(r) AS r FROM ch JOIN fo USING (fold) JOIN rr ON rr.config = ch.config AND rr.date BETWEEN fo.c AND fo.d GROUP BY 1, 2)"""
_FIGURES = f"""{_GRID}, va AS (SELECT count(*) AS trials, count(DISTINCT fold) AS folds, var_pop(objective) FILTER (objective > '-inf'::DOUBLE) / 252 AS v FROM lg),
mm AS (SELECT *, avg(r) OVER () AS mu FROM te), sg2 AS (SELECT count(r)::DOUBLE AS n, avg(r) / stddev_samp(r) AS sr, stddev_samp(r) AS sdv, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS sk, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) AS ku FROM mm),
fg AS (SELECT folds, trials, n, (sr - 0.05 / 252 / sdv) * sqrt(252.0) AS sharpe, {_cdf(f"(sr - sqrt(v) * ((1 - 0.5772156649015329) * {normal('1 - 1.0 / trials')} + 0.5772156649015329 * {normal('1 - 1 / (trials * exp(1))')})) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12))")} AS dsr FROM sg2, va)"""
_STABLE = f"""st AS (SELECT param, count(*) AS folds, quantile_cont(v, 0.25) AS low, quantile_cont(v, 0.75) AS high, {div('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'max(v) - min(v)')} AS spread
  FROM (SELECT 'n' AS param, p_n::DOUBLE AS v FROM ch JOIN tr USING (trial) WHERE place = 1 UNION ALL SELECT 'w_close', p_close::DOUBLE FROM ch JOIN tr USING (trial) WHERE place = 1) GROUP BY 1)"""

query("b_search_log", f"{_GRID} SELECT CAST(fold AS INT) AS fold, trial, config, {r('objective')} AS objective, n FROM lg")(lambda s, d: tried(s, d, "grid", steps=2, top=2).log)
query("b_search_choice", f"{_GRID} SELECT CAST(fold AS INT) AS fold, CAST(place AS INT) AS place, config, {r('objective')} AS objective FROM ch")(lambda s, d: tried(s, d, "grid", steps=2, top=2).chosen)
query("b_search_returns", f"{_GRID} SELECT CAST(fold AS INT) AS fold, date, {r('r', 9)} AS r FROM te", places=9)(lambda s, d: tried(s, d, "grid", steps=2, top=2).tested)
query("b_search_figures", f"{_FIGURES} SELECT CAST(folds AS INT) AS folds, trials, CAST(n AS BIGINT) AS days, {r('sharpe')} AS sharpe, {r('dsr', 6)} AS deflated_sharpe FROM fg")(
    lambda s, d: walkforward.figures(tried(s, d, "grid", steps=2, top=2)).withColumn("deflated_sharpe", fixed(F.col("deflated_sharpe"), 6))
)
query("b_search_stability", f"{_GRID}, {_STABLE} SELECT param, folds, {r('low')} AS low, {r('high')} AS high, {r('spread')} AS spread FROM st")(lambda s, d: walkforward.stability(tried(s, d, "grid", steps=2, top=2)))
query(
    "a_search_gates",
    f"""{_FIGURES}, {_STABLE}, pm AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY date) - 1 AS period, config, coalesce(r, 0.0) AS r FROM (SELECT config, date, round(ret, 9) AS r FROM bk JOIN b USING (idx))), pb AS ({pbo_sql('pm', 10)}),
ga AS (SELECT 'sharpe' AS gate, sharpe AS value, sharpe > 0.5 AS passed FROM fg UNION ALL SELECT 'deflated_sharpe', dsr, dsr > 0.95 FROM fg UNION ALL SELECT 'stability', max(spread), coalesce(max(spread) <= 1.0 / 3, true) FROM st UNION ALL SELECT 'pbo', pbo, pbo < 0.3 FROM pb)
SELECT gate, {r('value', 6)} AS value, passed FROM ga""",
    places=6,
)(lambda s, d: walkforward.gates(tried(s, d, "grid", steps=2, top=2)))
query("b_search_bayesian")(lambda s, d: tried(s, d, "bayesian", trials=7).log)
