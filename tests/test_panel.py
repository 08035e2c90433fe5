"""Operators of panels on small hand-made inputs."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import average_rank, normal_quantile, safe_div, significant
from pitpanel.operators import backtest, crosssection, overfitting, portfolio, rotation, search, store
from pitpanel.operators import timeseries as ts
from pitpanel.operators.asof import as_of, as_of_each
from pitpanel.plans import catalog, queries
from pitpanel.plans.expr import GridError, MissingFieldError, Tables, across, compile_all, fields
from pitpanel.sources import files, panels


def panel(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, i, float(v) if v is not None else None) for i, v in enumerate(values)], "ticker string, idx int, close double")


def values(df, column, order="idx"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_safe_division_is_null_near_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1e-12), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5]


def test_average_rank_matches_pandas(spark):
    v = [3.0, 1.0, None, 3.0, 2.0]
    got = values(panel(spark, v).withColumn("rk", average_rank(F.col("close"))), "rk")
    want = pd.Series(v).rank()
    assert [None if np.isnan(x) else x for x in want] == got


def test_normal_quantile(spark):
    from statistics import NormalDist

    rows = spark.range(1, 200).select((F.col("id") / 200).alias("p")).withColumn("z", normal_quantile(F.col("p"))).collect()
    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in rows) < 1e-13


def test_growth_of_a_loss_that_halves_is_positive(spark):
    assert values(panel(spark, [-100, -50]).withColumn("g", ts.growth("close", 1)), "g") == [None, 0.5]


def test_rolling_matches_pandas_with_gaps(spark):
    v = [1.0, None, 3.0, 4.0, None, None, 8.0, 9.5]
    want = pd.Series(v).rolling(4, min_periods=2).std()
    got = values(panel(spark, v).withColumn("s", ts.rolling("close", 4, "std")), "s")
    assert np.allclose(want, pd.Series(got, dtype=float), equal_nan=True)


def test_rsi_matches_the_recursion(spark):
    v = 100 + np.cumsum(np.random.default_rng(1).normal(size=120))
    d = pd.Series(v).diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 9, adjust=False, min_periods=9).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 9, adjust=False, min_periods=9).mean()
    got = pd.Series(values(ts.wilder_rsi(panel(spark, v), "close", 9), "rsi"), dtype=float)
    assert np.allclose(100 - 100 / (1 + up / down), got, equal_nan=True, atol=1e-9)


def test_forward_return_skips_a_day(spark):
    got = values(panel(spark, [100, 100, 200, 200, 200, 200]).withColumn("f", ts.forward_return("close", 1)), "f")
    assert got == [1.0, 0.0, 0.0, 0.0, None, None]


@pytest.mark.parametrize("k", [1, 3])
def test_hysteresis_matches_the_loop(spark, k):
    v = 100 + np.cumsum(np.random.default_rng(5).normal(size=150))
    got = values(ts.ma_exposure(panel(spark, v), 10, k), "exposure")
    ma, state, run, want = pd.Series(v).rolling(10).mean(), 1.0, 0, []
    for x, m in zip(v, ma, strict=True):
        if not np.isnan(m):
            run = run + 1 if x > m else 0
            state = 0.0 if x <= m else 1.0 if run >= k else state
        want.append(state)
    assert got == want


def test_drawdown_episodes(spark):
    df = panel(spark, [100, 90, 95, 101, 80]).withColumn("equity", F.col("close"))
    rows = ts.drawdown_episodes(df).orderBy("start").collect()
    assert [(r.start, r.trough, r.end, round(r.depth, 4)) for r in rows] == [(1, 1, 3, -0.1), (4, 4, None, round(80 / 101 - 1, 4))]


def test_as_of_takes_the_last_filing_even_if_null(spark):
    q = spark.createDataFrame([("A", date(2020, 3, 31), date(2020, 5, 15), 100.0), ("A", date(2020, 6, 30), date(2020, 8, 14), None)], "ticker string, period date, known date, v double")
    d = spark.createDataFrame([("A", date(2020, 4, 30)), ("A", date(2020, 5, 15)), ("A", date(2020, 8, 13)), ("A", date(2020, 8, 14))], "ticker string, date date")
    got = values(as_of(d, q, "ticker", "date", "known", ["period"], ["v", "period"]), "v", "date")
    assert got == [None, 100.0, 100.0, None]


def tables(spark):
    q = spark.createDataFrame([("A", 8000 + i, date(2020 + i // 4, 3 * (i % 4) + 1, 28), date(2020 + i // 4, 3 * (i % 4) + 2, 15), 100.0 + 10 * i, 1000.0) for i in range(8)], "ticker string, idx int, date date, datekey date, revenue double, assets double")
    d = spark.createDataFrame([("A", i, date(2020 + i // 12, i % 12 + 1, 20), 5.0 + i) for i in range(24)], "ticker string, idx int, date date, close double")
    return Tables(q, d)


def test_expressions_compile_on_both_grids(spark):
    out = {r.date: r for r in compile_all(tables(spark), {"ttm": fields.revenue.ttm(), "stock": fields.assets.ttm(), "mixed": fields.close / fields.revenue}).collect()}
    assert out[date(2020, 1, 20)].mixed is None and out[date(2020, 2, 20)].mixed == 6.0 / 100
    assert out[date(2020, 11, 20)].ttm == 460.0 and out[date(2020, 11, 20)].stock == 1000.0


def test_expressions_on_the_wrong_grid_raise(spark):
    with pytest.raises(GridError):
        tables(spark).grid(fields.close.yoy())
    with pytest.raises(GridError):
        tables(spark).grid(fields.revenue.mom(21))
    with pytest.raises(MissingFieldError):
        tables(spark).grid(fields.nothing)


def test_catalog_has_all_factors():
    assert len(catalog.CATALOG) == 158
    assert catalog.CATALOG["PER"].scoring().describe() == "winsor(div(1.0, div(mcap, netinc)), 0.01)"
    assert set(catalog.available({"SEP"})) == {k for k, v in catalog.CATALOG.items() if v.requires == ("SEP",)}


#: These want returns below 0 on a quarter of the days.
FEW_FALLS = {"SORTINO", "SORTINO_MOM_60D", "SORTINO_MOM_120D", "SORTINO_MOM_200D"}


@pytest.mark.parametrize("name", ["f_acceleration", "f_growth", "f_flow_proxy", "f_value_ev", "f_value_price", "f_price", "f_quality_1", "f_quality_2", "f_quality_3"])
def test_every_registered_factor_gives_rows(spark, name):
    """Windows of up to 252 trading days have their values on the daily grid."""
    category, _, part = name.removeprefix("f_").partition("_") if "quality" in name else (name.removeprefix("f_"), "", "")
    wanted = [n for n, x in catalog.CATALOG.items() if x.category == category and n not in queries.MIXED_GRIDS]
    wanted = wanted[20 * (int(part) - 1) : 20 * int(part)] if part else wanted
    got = {r.factor for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").select("factor").distinct().collect()}
    assert got == set(wanted) and wanted


def test_growth_of_a_daily_figure_is_refused():
    for name in queries.MIXED_GRIDS:
        with pytest.raises(GridError):
            queries.LAYOUT.grid(catalog.CATALOG[name].expr)


def test_factors_that_need_many_falling_days_give_rows_on_dense_prices(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 600)))
    daily = spark.createDataFrame([("A", date.fromordinal(730000 + i), i, float(c)) for i, c in enumerate(close)], "ticker string, date date, idx int, close double")
    quarterly = spark.createDataFrame([], "ticker string, date date, idx int, datekey date, revenue double")
    out = compile_all(Tables(quarterly, daily), {n: catalog.CATALOG[n].expr for n in sorted(FEW_FALLS)})
    assert all(n > 100 for n in out.select([F.count(n) for n in FEW_FALLS]).first())


def test_factors_on_a_few_days_equal_those_on_all_days(spark):
    """Windows, lags of windows and lags of promoted figures, for names with gaps, taken on a few days only."""
    rng = np.random.default_rng(8)
    days, names = 420, 3
    rows = [(f"T{k}", date.fromordinal(730000 + i), i, None if i < 40 * k or rng.random() < 0.03 else float(x), float(rng.integers(1, 90))) for k in range(names) for i, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, days))), 1)]
    daily = spark.createDataFrame(rows, "ticker string, date date, idx int, close double, volume double").withColumns({"mcap": F.col("close") * 50, "closeunadj": F.col("close"), "short_interest": F.col("volume") + 3})
    filed = spark.createDataFrame([(f"T{k}", date.fromordinal(730000 + 91 * q), q, date.fromordinal(730030 + 91 * q), 100.0 + q * q + k) for k in range(names) for q in range(5)], "ticker string, date date, idx int, datekey date, sharesbas double")
    market = daily.groupBy("idx").agg((F.avg("close") / 100 - 1).alias("r"))
    picked = spark.createDataFrame([(date.fromordinal(730000 + i), i) for i in (5, 130, 300, 419)], "date date, idx int")
    tables = Tables(filed, daily, market=market)
    wanted = {n: x.expr for n, x in catalog.CATALOG.items() if x.category == "price" or n.startswith(("MA_ACCEL", "VOL_"))} | {"SHORT": catalog.CATALOG["SHORT_INT_CHG"].expr}
    some = {(r.ticker, r.idx): r for r in compile_all(tables, wanted, picked).collect()}
    every = {(r.ticker, r.idx): r for r in compile_all(tables, wanted).collect()}
    assert len(some) == names * 4
    for key, row in some.items():
        for n in wanted:
            a, b = row[n], every[key][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (key, n, a, b)
    assert all(any(r[n] is not None for r in some.values()) for n in wanted if n not in FEW_FALLS)


def test_supplier_prices_come_from_trades_and_for_days_asked(spark):
    sf = "/root/testdata/sf0.001"
    every = panels.supplier_daily_prices(spark, sf)
    assert "Join Cross" not in every._jdf.queryExecution().optimizedPlan().toString()
    days = panels.supplier_calendar(spark, sf)
    picked = days.filter("idx % 97 IN (1, 5)")
    asked = panels.supplier_daily_prices(spark, sf, picked)
    assert asked.count() == picked.count() * every.select("ticker").distinct().count() and every.count() == days.count() * every.select("ticker").distinct().count()
    assert asked.exceptAll(every.filter("idx % 97 IN (1, 5)")).isEmpty()


def test_names_and_days_without_figures_need_no_trades(spark):
    sf = "/root/testdata/sf0.001"
    picked = panels.supplier_calendar(spark, sf).filter("idx % 97 IN (1, 5)")
    asked, bare = panels.supplier_daily_prices(spark, sf, picked), panels.supplier_daily_prices(spark, sf, picked, {"revenue"})
    columns = ["ticker", "date", "idx"]
    assert bare.select(columns).exceptAll(asked.select(columns)).isEmpty() and asked.select(columns).exceptAll(bare.select(columns)).isEmpty()
    assert "__at" not in plan_of(spark, "f_growth") and "__at" in plan_of(spark, "f_value_price")


def test_windows_over_filings_need_no_rows_of_quarters_without_one(spark, tmp_path):
    sf = str(tmp_path)
    lines = panels.table(spark, "/root/testdata/sf0.001", "lineitem")
    lines.filter("l_suppkey % 3 > 0 OR month(l_shipdate) > 3 OR year(l_shipdate) % 2 = 0").write.parquet(f"{sf}/lineitem.parquet")
    w = Window.partitionBy("ticker").orderBy("idx")
    made = lambda dense: panels.filings(spark, sf, dense).withColumns({"a": ts.lag("assets", 4), "g": ts.growth("netinc", 1), "t": ts.ttm("revenue")}).filter("datekey IS NOT NULL")
    every, there = made(True), made(False)
    gaps = panels.filings(spark, sf, False).withColumn("d", F.col("idx") - F.lag("idx").over(w)).filter("d > 1")
    assert not gaps.isEmpty() and not there.isEmpty()
    assert every.exceptAll(there).isEmpty() and there.exceptAll(every).isEmpty()
    assert "Join Cross" not in plan_of(spark, "f_value_price")
    assert across(fields.revenue.zscore(), queries.LAYOUT) and not across(fields.mcap.zscore() / fields.revenue, queries.LAYOUT)


def test_rounding_of_all_columns_takes_each_logarithm_once(spark):
    odd = [0.0, -0.0, 123456.5, -123456.5, 0.1234565, 1e-12, -7e-11, 9.999995, 1e18, 1.0000005e18, 3e18, -4e30, float("inf"), float("nan"), None]
    frame = spark.createDataFrame([(i, v, v) for i, v in enumerate(odd)], "i int, v double, u double")
    got = queries.rounded(frame)
    want = frame.select("i", significant(F.col("v")).alias("v"), significant(F.col("u")).alias("u"))
    assert got.columns == want.columns and [str(r) for r in got.orderBy("i").collect()] == [str(r) for r in want.orderBy("i").collect()]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LOG10") == 2


def plan_of(spark, name):
    return queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_factors_of_several_sources_read_the_lines_once_for_holders_and_once_for_trades(spark):
    assert plan_of(spark, "f_flow_proxy").count("Relation [l_orderkey") == 2


def test_as_of_several_dates_at_once(spark):
    q = spark.createDataFrame([("A", 1, 10, 20, 1.0), ("A", 2, 30, None, None), ("A", 3, 30, 25, 3.0), ("B", 1, None, 5, 4.0)], "ticker string, period int, k int, j int, v double")
    d = spark.createDataFrame([(t, at) for t in "AB" for at in (9, 10, 22, 25, 30)], "ticker string, date int")
    both = as_of_each(d, q.withColumn("w", F.col("v") * 10), "ticker", "date", ["period"], {"k": ["period", "v"], "j": ["w"]})
    for known, columns in (("k", ["period", "v"]), ("j", ["w"])):
        alone = as_of(d, q.withColumn("w", F.col("v") * 10), "ticker", "date", known, ["period"], columns)
        assert sorted(map(str, both.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))
    assert {(r.ticker, r.date): (r.period, r.w) for r in both.collect()}[("A", 30)] == (3, 30.0)


@pytest.mark.parametrize("name", ["f_quality_3", "f_acceleration"])
def test_windows_of_days_take_trades_and_no_dense_rows(spark, name):
    plan = plan_of(spark, name)
    assert "FlatMapGroupsInArrow" in plan and "sequence(" not in plan


def test_days_of_trades_equal_the_daily_prices(spark):
    sf = "/root/testdata/sf0.001"
    every = panels.supplier_daily_prices(spark, sf).filter("ticker = 'S3'").toPandas().sort_values("idx")
    trade = panels._trading_days(spark, sf).toPandas().sort_values("idx")
    trades = panels._supplier_days(spark, sf).filter("ticker = 'S3'").toPandas().merge(trade, on="date")
    made = panels.days_of_trades({c: trades[c].to_numpy() for c in ("idx", "close", "closeunadj", "volume", "mcap")}, trade["__trade"].to_numpy())
    assert len(trades) > 10 and all(np.array_equal(v, every[c].to_numpy(float), equal_nan=True) for c, v in made.items())


def test_days_of_a_block_of_names_equal_the_daily_prices(spark):
    sf, picked = "/root/testdata/sf0.001", ["S3", "S5", "S8"]
    every = panels.supplier_daily_prices(spark, sf).filter(F.col("ticker").isin(picked)).toPandas().sort_values(["ticker", "idx"])
    trade = panels._trading_days(spark, sf).toPandas().sort_values("idx")
    trades = panels._supplier_days(spark, sf).filter(F.col("ticker").isin(picked)).toPandas().merge(trade, on="date").sample(frac=1, random_state=1)
    names = trades["ticker"].map(picked.index).to_numpy()
    made = panels.days_of_trades({c: trades[c].to_numpy() for c in ("idx", "close", "volume", "mcap")}, trade["__trade"].to_numpy(), names)
    assert made.keys() == {"close", "volume", "mcap", "short_interest"}
    assert all(np.array_equal(v, every[c].to_numpy(float).reshape(3, -1), equal_nan=True) for c, v in made.items())


def test_windows_of_days_take_suppliers_in_blocks_and_only_figures_read(spark):
    plan = plan_of(spark, "f_acceleration")
    assert "shiftright(l_suppkey" in plan and "l_extendedprice#" in plan and "max((l_extendedprice" not in plan


@pytest.mark.parametrize(("name", "most"), [("f_quality_3", 8), ("f_acceleration", 8), ("f_growth", 7), ("f_value_price", 8)])
def test_windows_of_one_depth_run_in_one_pass(spark, name, most):
    assert plan_of(spark, name).count("Window [") <= most


@pytest.mark.parametrize("name", ["f_value_price", "f_scoring_value", "f_value_ev", "f_growth"])
def test_trades_between_signal_dates_become_one_before_the_sort(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Relation [l_orderkey") == 1 and "max(__at#" in plan


def test_optimised_weights_are_of_the_names_chosen_at_each_rebalance(spark):
    sf = "/root/testdata/sf0.01"
    chosen = {(r.idx, r.ticker) for r in queries.chosen(spark, sf).collect()}
    rows = queries.QUERIES["b_risk_parity"](spark, sf).collect()
    assert {(r.rebalance, r.ticker) for r in rows} == chosen and len({r.ticker for r in rows}) > 10
    assert np.allclose(pd.DataFrame([r.asDict() for r in rows]).groupby("rebalance")["w"].sum(), 1, atol=1e-4)


def test_overfitting_share_takes_ten_blocks_and_win_share_a_thousand_draws(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["a_overfitting_share"](spark, sf).first().combos == 252
    shares = [r.share * 1000 for r in queries.QUERIES["b_win_share"](spark, sf).collect()]
    assert sum(shares) == pytest.approx(1000) and any(round(x) % 5 for x in shares)


def test_upserts(spark):
    old = spark.createDataFrame([("A", 1, 1.0, 5)], "t string, k int, v double, d int")
    new = spark.createDataFrame([("A", 1, 9.0, 6), ("B", 1, 2.0, 8), ("B", 1, 3.0, 7), (None, 1, 4.0, 1)], "t string, k int, v double, d int")
    assert sorted((r.t, r.v) for r in store.insert_first(old, new, ["t", "k"], ["d"]).collect()) == [("A", 1.0), ("B", 3.0)]
    assert sorted((r.t, r.v) for r in store.merge_fields(old, new, ["t", "k"], ["v"], ["d"]).collect()) == [("A", 9.0), ("B", 3.0)]
    assert sorted((r.t, r.v) for r in store.replace_events(old, new, ["t", "k"], ["d"]).collect()) == [("A", 9.0), ("B", 3.0)]


def test_adjustment_factor(spark):
    schema = "ticker string, date date, close double"
    old = spark.createDataFrame([("A", date(2020, 1, 1), 200.0), ("A", date(2020, 1, 2), 210.0)], schema)
    new = spark.createDataFrame([("A", date(2020, 1, 1), 100.0), ("A", date(2020, 1, 2), 105.0)], schema)
    assert [(r.ticker, r.factor) for r in store.adjustment_factors(old, new).collect()] == [("A", 0.5)]
    assert store.adjustment_factors(old, old).isEmpty()


def test_rank_ic_of_a_perfect_factor(spark):
    rows = spark.createDataFrame([(1, float(i), i * 2.0) for i in range(25)], "date int, score double, fwd double")
    assert crosssection.rank_ic(rows).first().ic == pytest.approx(1.0)
    assert crosssection.rank_ic(rows.limit(10)).first().ic is None


def test_neutral_prices_do_not_depend_on_the_order_of_rows(spark):
    """A residual of 1116.32499 lies on the edge of two roundings, and the mean of doubles falls on either side of it."""
    rng = np.random.default_rng(0)
    units = rng.integers(80_000_000, 160_000_000, 20)
    units[-1] = 19 * units[0] - 20 * 11163250 + 2 - units[1:-1].sum()  # the first less the mean is 1116.32499
    rows = [(f"d{k:03d}", "A", i, float(u) / 1e4) for k in range(200) for i, u in [(int(i), int(units[i])) for i in rng.permutation(20)]]
    frame = spark.createDataFrame(rows, "date string, sector string, i int, close double").coalesce(1)
    got = frame.withColumn("value", significant(queries._CROSS["x_neutral_sector"][0]())).filter("i = 0").select("value").distinct().collect()
    assert [r.value for r in got] == [1116.33]


def test_general_and_closed_neutralisation_agree(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(1, f"T{i}", float(rng.normal()), "ab"[i % 2], float(rng.uniform(1, 9))) for i in range(30)], "date int, ticker string, v double, g string, size double")
    a = crosssection.neutral_groups_and_size(rows, "v", "g", "size").orderBy("ticker").collect()
    b = crosssection.neutral(rows.withColumn("l", F.ln("size")), "v", ["g"], ["l"]).orderBy("ticker").collect()
    assert np.allclose([r.neutral for r in a], [r.neutral for r in b])


def test_single_asset_backtest_is_buy_and_hold(spark):
    r = [0.0, 0.01, 0.02, -0.01, 0.03]
    returns = spark.createDataFrame([("A", i, x) for i, x in enumerate(r)], "ticker string, idx int, r double")
    weights = spark.createDataFrame([(0, "A", 1.0)], "idx int, ticker string, w double")
    out = backtest.run(weights, returns, returns.select("idx"), cost=0.0).orderBy("idx").collect()
    assert [(x.idx, round(x.ret, 12)) for x in out] == [(2, 0.02), (3, -0.01), (4, 0.03)]


def test_band_keeps_incumbents(spark):
    s = spark.createDataFrame([(1, "A", 3.0), (1, "B", 2.0), (1, "C", 1.0), (2, "C", 3.0), (2, "A", 2.0), (2, "B", 1.0)], "idx int, ticker string, score double")
    held = {(r.idx, r.ticker) for r in backtest.with_band(s, 1, 2.0).collect()}
    assert held == {(1, "A"), (2, "A")}


def test_weights():
    s = np.diag(np.array([0.01, 0.02, 0.04, 0.08]) ** 2)
    rp = portfolio.risk_parity(s)
    assert np.allclose(rp * np.sqrt(np.diag(s)), (rp * np.sqrt(np.diag(s)))[0])
    assert portfolio.hierarchical(s).sum() == pytest.approx(1) and portfolio.hierarchical(s)[0] == max(portfolio.hierarchical(s))
    w = portfolio.mean_variance(np.array([0.3, 0.1, 0.1, 0.1]), s, cap=0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-9 and w[0] == pytest.approx(0.4)
    _, share = portfolio.shrunk_covariance(np.random.default_rng(0).normal(size=(60, 15)))
    assert 0 <= share <= 1


def test_capped(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.05), (1, "c", 0.05)], "date int, ticker string, w double")
    assert [round(r.w, 9) for r in portfolio.capped(df, 0.4).orderBy("ticker").collect()] == [0.4, 0.3, 0.3]


def test_capped_adds_up_lighter_names_in_one_pass(spark):
    rng = np.random.default_rng(3)
    w = np.round(rng.pareto(1.0, 400) + 0.01, 2)
    out = portfolio.capped(spark.createDataFrame([("d", f"T{i:03d}", float(x)) for i, x in enumerate(w)], "date string, ticker string, w double"), 0.03)
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
    left, at = w / w.sum(), np.zeros(400, bool)
    while (left > 0.03 + 1e-12).any():
        at |= left > 0.03 + 1e-12
        left = np.where(at, 0.03, w / w[~at].sum() * (1 - 0.03 * at.sum()))
    got = {r.ticker: r.w for r in out.collect()}
    assert np.allclose([got[f"T{i:03d}"] for i in range(400)], left)


def test_overfitting_matches_brute_force(spark):
    from itertools import combinations

    m = np.random.default_rng(2).normal(size=(41, 5))
    df = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i in range(41) for j in range(5)], "period int, config string, r double")
    got = {r.combo: r.omega for r in overfitting.backtest_overfitting(df, 4).collect()}
    blocks = np.array_split(np.arange(41), 4)
    sharpe = lambda x: x.mean(0) / x.std(0, ddof=1)
    for c in combinations(range(4), 2):
        inside = np.concatenate([blocks[b] for b in c])
        outside = np.concatenate([blocks[b] for b in range(4) if b not in c])
        best = sharpe(m[inside]).argmax()
        assert got[sum(1 << b for b in c)] == pytest.approx((sharpe(m[outside]).argsort().argsort()[best] + 1) / 6)


def test_folds_have_an_embargo():
    found = search.folds(date(2000, 1, 1), date(2006, 12, 31))
    assert len(found) == 4 and all((f.test_start - f.train_end).days > 30 for f in found)


def test_expected_improvement_prefers_the_better_side():
    x = np.array([[0.0], [0.5], [1.0]])
    assert search.expected_improvement(x, np.array([0.0, 1.0, 2.0]), np.array([[0.1], [0.9]])) == 1


def test_rotation_needs_every_asset(spark):
    s = rotation.Strategy("s", ("A",), ("A", "B"), ("C",))
    sig = spark.createDataFrame([("A", 1, -1.0, 0.0), ("B", 1, 2.0, 0.0), ("C", 1, 0.1, 0.0), ("A", 2, 1.0, 0.1), ("B", 2, 2.0, 0.1), ("C", 2, None, 0.1), ("C", 3, 1.0, 0.5)], "ticker string, idx int, mom double, r double")
    assert [(r.idx, r.ticker, r.defensive) for r in rotation.weights(sig, s).collect()] == [(1, "C", True)]
    assert [(r.idx, round(r.ret, 6)) for r in rotation.run(sig, s, 10.0).collect()] == [(2, 0.099)]


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("aapl, msft\nAAPL spy\n")
    assert [r.ticker for r in files.read_tickers(spark, f"file://{tmp_path}/t.txt").collect()] == ["AAPL", "MSFT", "SPY"]
    (tmp_path / "r.json").write_text('{"86400": 0.5, "0": -0.25}')
    assert [(str(r.date), r.r) for r in files.read_returns(spark, f"file://{tmp_path}/r.json").collect()] == [("1970-01-01", -0.25), ("1970-01-02", 0.5)]
    (tmp_path / "d.csv").write_text("ticker,date,marketcap,ev\nA,2020-01-02,2.5,x\n")
    row = files.read_csv(spark, f"file://{tmp_path}/d.csv", "daily").first()
    assert (row.mcap, row.ev) == (2.5e6, None)


def test_streaming_first_filing_wins(spark, tmp_path):
    from pitpanel.sources.tables import Store
    from pitpanel.streaming.ingest import event_stream, ingest

    schema, kept = "ticker string, calendardate date, datekey date, inst_shares double", Store(spark, f"file://{tmp_path}/store")
    day = date.fromisoformat
    for rows in ([("A", day("2020-03-31"), day("2020-05-15"), 1.0)], [("A", day("2020-03-31"), day("2020-04-15"), 9.0), ("B", day("2021-03-31"), day("2021-05-15"), 2.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest(event_stream(spark, f"file://{tmp_path}/in", schema), kept, "institutions", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted((r.ticker, r.inst_shares) for r in kept.read("institutions").collect()) == [("A", 1.0), ("B", 2.0)]

