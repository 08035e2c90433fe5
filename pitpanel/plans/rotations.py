"""Queries of the registered rotation strategies and of what having searched costs, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import overfitting, risk, tactics, vigilant
from ..operators import timeseries as ts
from ..sources import panels
from .queries import DAILY, W1, div, query, r

#: The strategies' assets stand for brands here: in alphabetical order, one after the other.
ASSETS = {t: f"Brand#{k}" for k, t in enumerate(sorted({a for s in tactics.REGISTERED for a in s.needed}), 1)}
TACTICS = tuple(t.renamed(ASSETS) for t in tactics.REGISTERED)
BENCHMARK = ASSETS[tactics.BENCHMARK]


def carried(spark, sf_dir) -> DataFrame:
    """ticker, date, close: daily closes of the assets, the last one standing where a day has no trade."""
    past = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = panels.daily_prices(spark, sf_dir).filter(F.col("ticker").isin(*ASSETS.values()))
    return rows.select("ticker", "date", F.last("close", ignorenulls=True).over(past).alias("close"))


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)


_MEMBERS = ", ".join(
    "(" + ", ".join(map(_value, (t.name, a, a in t.canary, a in t.offensive, a in t.defensive, a == t.cash, dict(t.static).get(a), bool(t.static), t.cash is not None, t.metric, t.top, t.top_defensive, len(t.needed), t.overlay, t.sleeves))) + ")"
    for t in TACTICS for a in t.needed
)
_G = "(PARTITION BY ticker, sleeve ORDER BY m)"
_MOM = " + ".join(f"{k} * ({div('c', f'lag(c, {n}) OVER {_G}')} - 1)" for k, n in ((12, 1), (4, 3), (2, 6), (1, 12)))
_ROWS = "(PARTITION BY ticker, sleeve ORDER BY m ROWS 12 PRECEDING)"
_WEIGHTS = f"""{DAILY}, mem AS (SELECT * FROM (VALUES {_MEMBERS}) t(name, ticker, canary, offensive, defend, is_cash, static, fixed, has_cash, metric, top, topd, needed, overlay, sleeves)),
cl AS (SELECT ticker, date, idx, last_value(close IGNORE NULLS) OVER {W1} AS close FROM p WHERE ticker IN (SELECT ticker FROM mem)),
se AS ({" UNION ALL ".join(f"SELECT {k} AS sleeve, ticker, date, {f'lag(close, {5 * k}) OVER {W1}' if k else 'close'} AS c FROM cl" for k in range(4))}),
mo AS (SELECT sleeve, ticker, CAST(year(date) * 12 + month(date) AS INT) AS m, max_by(c, date) FILTER (c IS NOT NULL) AS c FROM se GROUP BY 1, 2, 3),
sg AS (SELECT *, {_MOM} AS mom, CASE WHEN count(c) OVER {_ROWS} = 13 THEN {div('c', f'avg(c) OVER {_ROWS}')} END AS ratio, {div(f'lead(c) OVER {_G}', 'c')} - 1 AS r FROM mo),
jn AS (SELECT mem.*, sleeve, m, mom, CASE WHEN metric = 'mom' THEN mom ELSE ratio END AS s FROM sg JOIN mem USING (ticker) WHERE sleeve < sleeves),
kk AS (SELECT *, count(mom) OVER g AS have, coalesce(max(CASE WHEN canary THEN CAST(mom < 0 AS INT) END) OVER g, 0) = 1 AS def, max(CASE WHEN is_cash THEN s END) OVER g AS cs, max(CASE WHEN is_cash THEN ticker END) OVER g AS cn
  FROM jn WINDOW g AS (PARTITION BY name, sleeve, m)),
qq AS (SELECT *, row_number() OVER (PARTITION BY name, sleeve, m ORDER BY s DESC NULLS LAST, ticker) AS n FROM kk WHERE have = needed AND CASE WHEN fixed THEN static IS NOT NULL WHEN def THEN defend ELSE offensive END),
hh AS (SELECT *, coalesce(static, 1.0 / count(*) OVER (PARTITION BY name, sleeve, m)) AS v FROM qq WHERE fixed OR n <= CASE WHEN def THEN topd ELSE top END),
w AS (SELECT name, sleeve, m, CASE WHEN def AND has_cash AND NOT fixed AND NOT coalesce(s > cs, false) THEN cn ELSE ticker END AS asset, sum(v) AS w, bool_or(def) AS def FROM hh GROUP BY 1, 2, 3, 4)"""
_RETURNS = f"""{_WEIGHTS},
xx AS (SELECT w.*, r, dense_rank() OVER (PARTITION BY name, w.sleeve ORDER BY w.m) AS no FROM w JOIN sg ON sg.ticker = asset AND sg.m = w.m AND sg.sleeve = 0 WHERE w.m < (SELECT max(m) FROM sg)),
tn AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.sleeve, b.sleeve) AS sleeve, coalesce(a.no, b.no + 1) AS no, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS t FROM xx a FULL JOIN xx b ON a.name = b.name AND a.sleeve = b.sleeve AND a.no = b.no + 1 AND a.asset = b.asset GROUP BY 1, 2, 3),
gr AS (SELECT name, sleeve, no, any_value(m) AS m, sum(w * r) AS g, bool_or(def) AS def FROM xx GROUP BY 1, 2, 3),
bm AS (SELECT sleeve, date, c, avg(c) OVER y AS ma, count(c) OVER y AS n FROM se WHERE ticker = '{BENCHMARK}' WINDOW y AS (PARTITION BY sleeve ORDER BY date ROWS 199 PRECEDING)),
iv AS (SELECT sleeve, CAST(year(date) * 12 + month(date) + 1 AS INT) AS idx, max_by(n = 200 AND coalesce(c > ma, false), date) AS up FROM bm GROUP BY 1, 2),
sr AS (SELECT gr.name, gr.sleeve, any_value(sleeves) AS sleeves, m + 1 AS idx, any_value(CASE WHEN overlay AND NOT coalesce(up, true) THEN 0.0 ELSE g - t * 0.001 END) AS ret, any_value(def) AS def
  FROM gr JOIN tn USING (name, sleeve, no) JOIN mem USING (name) LEFT JOIN iv ON iv.sleeve = gr.sleeve AND iv.idx = m + 1 GROUP BY gr.name, gr.sleeve, m),
ds AS (SELECT name, avg(d) AS defensive FROM (SELECT name, sleeve, avg(CAST(def AS INT)) AS d FROM sr GROUP BY 1, 2) GROUP BY 1),
rs AS (SELECT name, idx, avg(ret) AS ret, any_value(defensive) AS defensive FROM sr JOIN ds USING (name) GROUP BY 1, 2 HAVING count(*) = any_value(sleeves))"""


def _cdf(z: str) -> str:
    """SQL of the normal distribution function: its series within 7 of zero."""
    series = "list_reduce(list_prepend({t: z, s: z}, list_transform(range(1, 121), lambda n: {t: 0.0 + n, s: 0.0})), lambda a, b: {t: a.t * z * z / (2 * b.t + 1), s: a.s + a.t * z * z / (2 * b.t + 1)}).s"
    return f"list_transform([CAST(({z}) AS DOUBLE)], lambda z: CASE WHEN z >= 7 THEN 1.0 WHEN z <= -7 THEN 0.0 ELSE 0.5 + {series} * exp(-z * z / 2) / sqrt(2 * pi()) END)[1]"


def _dsr(trials: int, source: str) -> str:
    """SQL of the deflated Sharpe probability of r by config, over rows with mu, the config's mean."""
    m = lambda k: f"avg(pow(r - mu, {k}))"
    unit = repr(overfitting.expected_best_sharpe(trials, 1.0))
    z = f"(sr - sqrt((1 + 0.5 * sr * sr) / n) * {unit}) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12))"
    return f"SELECT config, {_cdf(z)} AS dsr FROM (SELECT config, count(r)::DOUBLE AS n, avg(r) / stddev_samp(r) AS sr, {m(3)} / pow({m(2)}, 1.5) AS sk, {m(4)} / pow({m(2)}, 2) AS ku FROM (SELECT *, avg(r) OVER (PARTITION BY config) AS mu FROM {source}) GROUP BY 1)"


def pbo_sql(source: str, blocks: int) -> str:
    """SQL of pbo over source (period, config, r): every half of the blocks as a mask, joined with the blocks' moments."""
    size = f"n // {blocks}"
    block = f"CAST(CASE WHEN period < ({size} + 1) * (n % {blocks}) THEN period // ({size} + 1) ELSE n % {blocks} + (period - ({size} + 1) * (n % {blocks})) // ({size}) END AS INT)"
    sharpe = f"round(coalesce({div('s / n', 'sqrt(greatest((ss - n * (s / n) * (s / n)) / (n - 1), 0.0))')}, 0.0), 12)"
    return f"""SELECT avg(CAST(omega < 0.5 AS INT)) AS pbo, count(*) AS combos FROM (
SELECT combo, config, (rank() OVER (PARTITION BY combo ORDER BY o) + (count(*) OVER (PARTITION BY combo, o) - 1) / 2.0) / (count(*) OVER (PARTITION BY combo) + 1) AS omega, row_number() OVER (PARTITION BY combo ORDER BY i DESC, config) AS k FROM (
SELECT combo, config, max(sharpe) FILTER (inside) AS i, max(sharpe) FILTER (NOT inside) AS o FROM (
SELECT combo, config, inside, {sharpe} AS sharpe FROM (SELECT combo, config, (combo >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM (SELECT combo FROM range({1 << blocks}) t(combo) WHERE bit_count(combo) = {blocks // 2}),
(SELECT block, config, count(r) AS n, sum(r) AS s, sum(r * r) AS ss FROM (SELECT {block} AS block, config, r FROM {source}, (SELECT max(period) + 1 AS n FROM {source})) GROUP BY 1, 2) GROUP BY 1, 2, 3)) GROUP BY 1, 2)) WHERE k = 1"""


_METRICS = f"""{_RETURNS}, cw AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY idx) AS k FROM rs) WHERE k = {len(TACTICS)}),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM cw), dd AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY name ORDER BY idx ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS d FROM eq),
mt AS (SELECT name, count(ret) AS months, pow(product(1 + ret), 12.0 / count(ret)) - 1 AS cagr, min(d) AS mdd, stddev_samp(ret) * sqrt(12.0) AS vol, avg(ret) * 12 AS mean, any_value(defensive) AS defensive FROM dd GROUP BY 1),
mx AS (SELECT idx - (SELECT min(idx) FROM cw) AS gap, dense_rank() OVER (ORDER BY idx) - 1 AS period, name AS config, ret AS r FROM cw),
ls AS ({_dsr(len(TACTICS), "mx")}),
me AS (SELECT mt.*, {div('cagr', 'abs(mdd)')} AS calmar, {div('mean', 'vol')} AS sharpe, dsr FROM mt JOIN ls ON ls.config = mt.name)"""

query("b_registered_weights", f"{_WEIGHTS} SELECT name, CAST(sleeve AS INT) AS sleeve, m AS idx, asset AS ticker, {r('w')} AS w, def AS defensive FROM w")(
    lambda s, d: tactics.weights(tactics.signals(tactics.observed(carried(s, d), 4)), tactics.member_table(s, TACTICS))
)
query("b_registered_returns", f"{_RETURNS} SELECT name, CAST(idx AS INT) AS idx, {r('ret', 9)} AS ret, {r('defensive', 9)} AS defensive FROM rs", places=9)(
    lambda s, d: tactics.returns(carried(s, d), TACTICS, BENCHMARK)
)


def _evaluated(spark, sf_dir):
    return tactics.evaluated(panels.kept(tactics.returns(carried(spark, sf_dir), TACTICS, BENCHMARK)), len(TACTICS))


query("b_registered_metrics", f"{_METRICS} SELECT name, months, {r('cagr')} AS cagr, {r('mdd')} AS mdd, {r('vol')} AS vol, {r('calmar')} AS calmar, {r('sharpe')} AS sharpe, {r('dsr')} AS dsr, {r('defensive')} AS defensive FROM me")(
    lambda s, d: _evaluated(s, d)[0]
)


@query(
    "a_registered_verdict",
    f"""{_METRICS}, pb AS ({pbo_sql('mx', 10)})
SELECT *, reasons = '' AS adopted FROM (SELECT name, concat_ws(',', CASE WHEN pbo > 0.5 THEN 'pbo' END, CASE WHEN mdd < -0.2 THEN 'mdd' END, CASE WHEN dsr < 0.95 THEN 'dsr' END,
  CASE WHEN name <> 'static_60_40' AND calmar <= (SELECT calmar FROM me WHERE name = 'static_60_40') THEN 'calmar' END) AS reasons FROM me, pb)""",
)
def a_registered_verdict(spark, sf_dir):
    metrics, common = _evaluated(spark, sf_dir)
    return tactics.verdict(metrics, overfitting.overfitting_share(overfitting.backtest_overfitting(tactics.matrix(common), 10)))




@query(
    "a_registered_compare",
    f"""{_RETURNS}, bq AS (SELECT m + 1 AS idx, r AS m FROM sg WHERE sleeve = 0 AND ticker = '{BENCHMARK}'), pj AS (SELECT name, ret AS r, m, ret - m AS x FROM rs JOIN bq USING (idx) WHERE ret IS NOT NULL AND m IS NOT NULL),
cb AS (SELECT *, coalesce({div('covar_samp(r, m) OVER n', 'var_samp(m) OVER n')}, 1.0) AS b FROM pj WINDOW n AS (PARTITION BY name))
SELECT name, {r('any_value(b)', 9)} AS beta, {r('(avg(r) - any_value(b) * avg(m)) * 12', 9)} AS alpha, {r('stddev_samp(x) * sqrt(12.0)', 9)} AS tracking_error, {r(div('avg(x) * 12', 'stddev_samp(x) * sqrt(12.0)'), 9)} AS information_ratio, {r('corr(r, m)', 9)} AS correlation FROM cb GROUP BY 1""",
    places=9,
)
def a_registered_compare(spark, sf_dir):
    """Every registered strategy against the benchmark's own months."""
    daily = panels.kept(carried(spark, sf_dir))
    market = tactics.signals(tactics.observed(daily.filter(F.col("ticker") == BENCHMARK), 1)).select((F.col("idx") + 1).alias("idx"), F.col("r").alias("m"))
    pairs = tactics.returns(daily, TACTICS, BENCHMARK).select("name", "idx", F.col("ret").alias("r")).join(F.broadcast(market), "idx")
    return risk.against_market(pairs, "name")


_COST_PARTS = [f"SELECT '{f}' AS frequency, 'pbo' AS measure, NULL AS config, {b} AS blocks, pbo AS value, pbo < 0.5 AS passed FROM ({pbo_sql(t, b)})" for f, t in (("daily", "td"), ("monthly", "tm")) for b in (8, 10, 12, 16)]
_COST_PARTS += [f"SELECT '{f}', 'dsr', config, NULL, dsr, dsr >= 0.95 FROM ({_dsr(25, t)})" for f, t in (("daily", "td"), ("monthly", "tm"))]


@query(
    "a_search_cost",
    f"""{DAILY}, cc AS (SELECT ticker, date, idx, last_value(close IGNORE NULLS) OVER {W1} AS close FROM p), rr AS (SELECT ticker AS config, date, round({div('close', f'lag(close) OVER {W1}')} - 1, 9) AS r FROM cc),
co AS MATERIALIZED (SELECT config, date, r FROM (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM rr WHERE r IS NOT NULL) WHERE k = 25),
td AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY date) - 1 AS period, config, r FROM co),
tm AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY date) - 1 AS period, config, r FROM (SELECT config, last_day(date) AS date, product(1 + r) - 1 AS r FROM co GROUP BY 1, 2)),
al AS (SELECT 'daily' AS frequency, 'rows' AS measure, NULL AS config, NULL AS blocks, count(DISTINCT date)::DOUBLE AS value, NULL AS passed FROM co
  UNION ALL SELECT 'daily', 'dropped', NULL, NULL, (SELECT count(DISTINCT date) FROM rr)::DOUBLE - count(DISTINCT date), NULL FROM co UNION ALL {' UNION ALL '.join(_COST_PARTS)})
SELECT frequency, measure, config, CAST(blocks AS INT) AS blocks, {r('value')} AS value, CAST(passed AS BOOLEAN) AS passed FROM al""",
)
def a_search_cost(spark, sf_dir):
    daily = panels.daily_prices(spark, sf_dir).withColumn("r", F.round(ts.change("close", 1, True), 9))
    return tactics.search_cost(panels.kept(daily.select(F.col("ticker").alias("config"), "date", "r")))


# the older momentum strategy

# Its assets and the weights beside the selected one.
AGGRESSIVE, PROTECTIVE, DEFAULT, CORE = ("SPY", "EFA", "EEM", "AGG"), ("LQD", "IEF", "SHY"), "SHY", ("SPY", "TLT", "GLD", "BIL")
MIX = {"selected": 0.5, "SPY": 0.125, "TLT": 0.125, "GLD": 0.125, "BIL": 0.125}
_AGG, _PRO, _CORE = (tuple(ASSETS[t] for t in some) for some in (AGGRESSIVE, PROTECTIVE, CORE))
_IN = lambda some: "(" + ", ".join(map(repr, some)) + ")"


def carried_days(spark, sf_dir) -> DataFrame:
    past = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return panels.daily_prices(spark, sf_dir).filter(F.col("ticker").isin(*ASSETS.values())).select("ticker", "date", "idx", F.last("close", ignorenulls=True).over(past).alias("close"))


def _picked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scores = panels.kept(vigilant.month_scores(carried_days(spark, sf_dir)))
    return vigilant.picks(scores, _AGG, _PRO, ASSETS[DEFAULT]), scores


_ROWMOM = " + ".join(f"{100 * k} * ({div('close', f'lag(close, {n}) OVER {W1}')} - 1)" for k, n in ((12, 21), (4, 63), (2, 126), (1, 252)))
_AHEAD = lambda k: f"CASE WHEN pairs + 1 >= {vigilant.LEAST_DAYS} AND raw IS NOT NULL THEN mu + (mom - mu) * exp(-speed * {21 * k}) ELSE mom END"
_VIG = f"""{DAILY}, cl AS (SELECT ticker, date, idx, last_value(close IGNORE NULLS) OVER {W1} AS close FROM p WHERE ticker IN {_IN(ASSETS.values())}),
ms AS (SELECT *, {_ROWMOM} AS mom FROM cl), mp AS (SELECT *, lag(mom) OVER {W1} AS prev FROM ms WHERE mom IS NOT NULL),
ft AS (SELECT *, regr_slope(mom, prev) OVER q AS raw, regr_intercept(mom, prev) OVER q AS icpt, count(prev) OVER q AS pairs FROM mp WINDOW q AS (PARTITION BY ticker ORDER BY idx ROWS {vigilant.CALIBRATION - 2} PRECEDING)),
fu AS (SELECT *, greatest(least(raw, {vigilant.SLOPE[1]}), {vigilant.SLOPE[0]}) AS sl FROM ft), fv AS (SELECT *, greatest(least(-ln(sl), {vigilant.SPEED[1]}), {vigilant.SPEED[0]}) AS speed, icpt / (1 - sl) AS mu FROM fu),
fw AS (SELECT ticker, CAST(year(date) * 12 + month(date) AS INT) AS m, date, mom AS current, {", ".join(f"{_AHEAD(k)} AS forecast_{k}m" for k in (1, 3, 6))}, {_AHEAD(1)} - mom AS delta FROM fv),
fx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, m ORDER BY date DESC) AS k FROM fw) WHERE k = 1),
me AS (SELECT ticker, CAST(year(date) * 12 + month(date) AS INT) AS m, max_by(close, date) AS c FROM cl WHERE close IS NOT NULL GROUP BY 1, 2), mr AS (SELECT *, lead(c) OVER (PARTITION BY ticker ORDER BY m) / c - 1 AS r FROM me),
lo AS ({" UNION ALL ".join(f"SELECT '{k}' AS rule, ticker, m, {k} AS score, {'forecast_1m' if k == 'delta' else k} AS safety FROM fx" for k in vigilant.RULES)}),
sx AS (SELECT rule, m, min(safety) < 0 AS defensive FROM lo WHERE ticker IN {_IN(_AGG)} GROUP BY 1, 2 HAVING count(safety) = {len(set(_AGG))}),
bx AS (SELECT lo.rule, lo.m, ticker, row_number() OVER (PARTITION BY lo.rule, lo.m ORDER BY score DESC, ticker) AS k FROM lo JOIN sx ON sx.rule = lo.rule AND sx.m = lo.m WHERE score IS NOT NULL AND CASE WHEN defensive THEN ticker IN {_IN(_PRO)} ELSE ticker IN {_IN(_AGG)} END),
pk AS (SELECT sx.rule, sx.m, coalesce(ticker, '{ASSETS[DEFAULT]}') AS ticker, defensive FROM sx LEFT JOIN bx ON bx.rule = sx.rule AND bx.m = sx.m AND k = 1),
co AS (SELECT 'selected' AS name, pk.m + 1 AS idx, r FROM pk JOIN mr USING (ticker, m) WHERE rule = 'current' AND r IS NOT NULL UNION ALL SELECT mr.ticker, pk.m + 1, mr.r FROM pk JOIN mr ON mr.m = pk.m WHERE rule = 'current' AND mr.r IS NOT NULL AND mr.ticker IN {_IN(_CORE)})"""
query("b_vigilant_scores", f"{_VIG} SELECT ticker, m AS idx, {', '.join(f'{r(k)} AS {k}' for k in vigilant.RULES)} FROM fx")(
    lambda s, d: vigilant.month_scores(carried_days(s, d)).filter("current IS NOT NULL").select("ticker", "idx", *vigilant.RULES)
)
query("b_vigilant_picks", f"{_VIG} SELECT rule, m AS idx, ticker, defensive FROM pk")(lambda s, d: _picked(s, d)[0])
query("b_vigilant_returns", f"{_VIG} SELECT rule, CAST(pk.m + 1 AS INT) AS idx, ticker, defensive, {r('r - 0.001', 9)} AS ret FROM pk JOIN mr USING (ticker, m) WHERE r IS NOT NULL", places=9)(lambda s, d: vigilant.returns(*_picked(s, d)))
query("b_vigilant_components", f"{_VIG} SELECT name, CAST(idx AS INT) AS idx, {r('r', 9)} AS r FROM co", places=9)(lambda s, d: vigilant.components(*_picked(s, d), _CORE))
_MIXED = {("selected" if t == "selected" else ASSETS[t]): w for t, w in MIX.items()}
query(
    "b_vigilant_mix",
    f"{_VIG}, wt AS (SELECT * FROM (VALUES {', '.join(f'({t!r}, {w!r})' for t, w in _MIXED.items())}) t(name, w)) SELECT CAST(idx AS INT) AS idx, {r('sum(w * r) - 0.001', 9)} AS r FROM co JOIN wt USING (name) GROUP BY 1",
    places=9,
)(lambda s, d: vigilant.mixed(vigilant.components(*_picked(s, d), _CORE), s.createDataFrame([(0, t, w) for t, w in _MIXED.items()], "combo int, name string, w double")).select("idx", "r"))


@query(
    "b_vigilant_optimised",
    f"""{_VIG}, cb AS (SELECT row_number() OVER (ORDER BY a, b, c, e, f) - 1 AS combo, [a, b, c, e, f] AS k FROM range(11) t1(a), range(11) t2(b), range(11) t3(c), range(11) t4(e), range(11) t5(f) WHERE a + b + c + e + f = 10),
nm AS (SELECT * FROM (VALUES {', '.join(f'({k}, {t!r})' for k, t in enumerate(('selected', *_CORE), 1))}) t(i, name)), mxr AS (SELECT combo, idx, sum(k[i] / 10.0 * r) - 0.001 AS r FROM cb, co JOIN nm USING (name) GROUP BY 1, 2),
ob AS (SELECT combo, CASE WHEN count(r) >= 12 AND abs(stddev_samp(r)) > 1e-9 THEN (avg(r) - 0.05 / 12) / stddev_samp(r) * sqrt(12.0) ELSE '-inf'::DOUBLE END AS o FROM mxr GROUP BY 1), bo AS (SELECT combo FROM ob ORDER BY round(o, 9) DESC, combo LIMIT 1)
SELECT CAST(combo AS INT) AS combo, name, CAST(NULL AS INT) AS idx, {r('k[i] / 10.0')} AS w, NULL::DOUBLE AS r FROM bo JOIN cb USING (combo), nm UNION ALL SELECT CAST(combo AS INT), NULL, CAST(idx AS INT), NULL, {r('r')} FROM mxr JOIN bo USING (combo)""",
)
def b_vigilant_optimised(spark, sf_dir):
    """The best weights (name, w) and the returns (idx, r) of that combination."""
    weights, rows = vigilant.optimised(spark, panels.kept(vigilant.components(*_picked(spark, sf_dir), _CORE)), _CORE, 0.1, keep=panels.kept)
    weights = weights.select("combo", "name", F.lit(None).cast("int").alias("idx"), "w", F.lit(None).cast("double").alias("r"))
    return weights.unionByName(rows.select("combo", F.lit(None).cast("string").alias("name"), "idx", F.lit(None).cast("double").alias("w"), "r"))


query("b_vigilant_win_shares")(lambda s, d: vigilant.win_shares(carried_days(s, d), (*_AGG, *_PRO), 500))
