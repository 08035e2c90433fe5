"""Orders in whole shares, bands, as-of joins on dates, selection inside folds, paths and readers on small hand-made tables."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import asof, backtest, research, rotation, store
from pitpanel.plans import catalog
from pitpanel.sources import files


def plain_plan(targets, holdings, prices, cash):
    """Sales of whole positions and of what exceeds a target, then purchases by shortfall under the cash that is left."""
    worth = sum(n * prices[t] for t, n in holdings.items() if t in prices) + cash
    trades = {}
    for t, n in holdings.items():
        if t in prices:
            sold = n if not targets.get(t) else int(max(n * prices[t] - targets[t] * worth, 0) / prices[t])
            trades[t], cash = -sold, cash + sold * prices[t]
    short = {t: w * worth - holdings.get(t, 0) * prices[t] for t, w in targets.items() if t in prices}
    for t in sorted((t for t in short if short[t] > 0), key=lambda t: (-short[t], t)):
        bought = min(int(short[t] / prices[t]), int(cash / prices[t]))
        trades[t] = trades.get(t, 0) + bought
        cash -= bought * prices[t]
    return trades, cash


@pytest.mark.parametrize("seed", range(4))
def test_share_plan(spark, seed):
    rnd = random.Random(seed)
    names = [f"N{k}" for k in range(9)]
    prices = {t: rnd.choice([1.5, 20.0, 99.0, 333.0]) for t in names[1:]}  # N0 has no price
    holdings = {t: rnd.randint(1, 40) for t in rnd.sample(names, 5)} | {"N0": 7}
    chosen = rnd.sample(names[1:], 4)
    targets = dict(zip(chosen, [0.4, 0.3, 0.2, 0.1], strict=True))
    cash = rnd.choice([0.0, 50.0, 5000.0])
    frame = lambda d, c: spark.createDataFrame([("p", t, v) for t, v in d.items()], f"book string, ticker string, {c}")
    rows = backtest.share_plan(frame(targets, "w double"), frame(holdings, "shares int"), frame(prices, "price double"), cash, "book").collect()
    got = {r.ticker: r for r in rows}
    trades, left = plain_plan(targets, holdings, prices, cash)
    assert {t: r.trade for t, r in got.items() if r.trade} == {t: n for t, n in trades.items() if n}
    assert all(r.cash >= -1e-9 for r in rows) and max(rows, key=lambda r: r.step).cash == pytest.approx(left)
    assert got["N0"].price is None and got["N0"].final_shares == 7 and got["N0"].action == "HOLD"
    kinds = [r.action for r in sorted(rows, key=lambda r: r.step) if r.action != "HOLD"]
    assert kinds == sorted(kinds, reverse=True)  # sales come before purchases


def test_share_plan_of_many_positions_is_linear(spark):
    n = 60_000
    rows = spark.range(n).select(F.concat(F.lit("T"), "id").alias("ticker"), (F.col("id") % 7).alias("shares"), (1.0 + F.col("id") % 89).alias("price"))
    plan = backtest.share_plan(spark.createDataFrame([("T3", 0.5), ("T5", 0.5)], "ticker string, w double"), rows.select("ticker", "shares"), rows.select("ticker", "price"), 20000.0)
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    held = rows.selectExpr("sum(shares * price)").first()[0]
    last = plan.orderBy(F.desc("step")).first()
    worth = plan.selectExpr("sum(final_shares * price)").first()[0]
    assert 0 <= last.cash < 100 and abs(worth + last.cash - held - 20000) < 1e-3
    assert plan.filter("final_shares > 0").count() == 2


def test_band_against_a_plain_walk(spark):
    rnd = random.Random(1)
    rows = [(c, d, f"N{k}", rnd.random()) for c in "xy" for d in range(40) for k in range(20)]
    got = {}
    for r in backtest.with_band(spark.createDataFrame(rows, "config string, idx int, ticker string, score double"), 5, 1.6, "config").collect():
        got.setdefault((r.config, r.idx), set()).add(r.ticker)
    for c in "xy":
        held: list[str] = []
        for d in range(40):
            ranked = [t for _, t in sorted((-s, t) for cc, dd, t, s in rows if (cc, dd) == (c, d))][:8]
            held = ([t for t in ranked if t in held] + [t for t in ranked if t not in held])[:5]
            assert got[c, d] == set(held)


def test_nearest_and_months_before(spark):
    left = spark.createDataFrame([("A", date(2020, 1, 10)), ("A", date(2020, 3, 1)), ("B", date(2020, 1, 10)), (None, date(2020, 1, 1))], "k string, at date")
    right = spark.createDataFrame([("A", date(2020, 1, 8), 1.0), ("A", date(2020, 1, 20), None), ("A", None, 5.0), ("C", date(2020, 1, 9), 2.0)], "k string, known date, v double")
    pick = lambda **how: {(r.k, r["at"].month): (r.found and r.found.day, r.v) for r in asof.nearest(left, right, "k", "at", "known", ["v"], **how).collect()}
    assert pick() == {("A", 1): (8, 1.0), ("A", 3): (20, None), ("B", 1): (None, None), (None, 1): (None, None)}
    assert pick(ahead=True)["A", 1] == (20, None) and pick(ahead=True)["A", 3] == (None, None)
    assert pick(most_days=10)["A", 3] == (None, None) and pick(most_days=2)["A", 1] == (8, 1.0)
    prices = spark.createDataFrame([("A", date(2020, 1, 31), 1.0), ("A", date(2020, 2, 10), None), ("A", date(2020, 3, 31), 3.0), ("A", date(2020, 5, 31), 5.0)], "ticker string, date date, close double")
    assert [r.start for r in asof.months_before(prices, 1).orderBy("date").collect()] == [None, None, 1.0, 3.0]


def selection_panel(spark, months, names=40):
    rng = np.random.default_rng(3)
    rows = []
    for m in range(months):
        good, noise = rng.normal(size=names), rng.normal(size=names)
        fwd = good + 0.5 * noise + 0.3 * rng.normal(size=names) if m < 45 else -good  # turns round after the training's end
        for k in range(names):
            rows.append((date(2000 + m // 12, m % 12 + 1, 28), f"N{k}", float(fwd[k]), float(good[k]), float(good[k] + 0.01 * rng.normal()), float(noise[k])))
    return spark.createDataFrame(rows, "date date, ticker string, fwd double, good double, twin double, noise double")


def test_forward_selection_stops_at_the_end_of_training(spark):
    panel, factors = selection_panel(spark, 60), ["good", "twin", "noise"]
    ends = spark.createDataFrame([(1, date(2003, 9, 30)), (2, date(2002, 1, 31)), (3, date(2004, 12, 31))], "fold int, end date")
    got = {}
    for r in research.forward_selection(panel, factors, ends, k=2).orderBy("fold", "step", "factor").collect():
        got.setdefault(r.fold, []).append((r.step, r.factor))
    assert got[1][0][1] in ("good", "twin") and got[1][1] == (2, "noise")  # the twin adds nothing, so the second pick is the other one
    assert got[2] == [(0, "good"), (0, "noise"), (0, "twin")]  # too few months: all
    later = panel.withColumn("fwd", F.when(F.col("date") > "2003-09-30", -F.col("fwd")).otherwise(F.col("fwd")))
    again = {(r.fold, r.step): r.ic for r in research.forward_selection(later, factors, ends.filter("fold = 1"), k=2).collect()}
    first = {(r.fold, r.step): r.ic for r in research.forward_selection(panel, factors, ends.filter("fold = 1"), k=2).collect()}
    assert again == pytest.approx(first)  # nothing after the end counts
    none = research.forward_selection(panel, factors, ends.filter("fold = 1"), k=2, least_ic=2.0).collect()
    assert {(r.step, r.factor) for r in none} == {(0, f) for f in factors}


def test_simulated_paths(spark):
    fits = spark.createDataFrame([("A", 5.0, 2.0, 0.3, 1.0), ("B", None, 1.0, 1.0, 1.0)], "ticker string, theta double, mu double, sigma double, last double")
    rows = {r.step: r for r in rotation.simulated(fits, draws=4000, steps=63).collect()}
    assert set(rows) == set(range(64)) and (rows[0].mean, rows[0].q05, rows[0].q95) == (1.0, 1.0, 1.0)
    dt, fade = 1 / 252, (1 - 5.0 / 252) ** 63
    sd = 0.3 * (dt * (1 - fade**2) / (1 - (1 - 5.0 * dt) ** 2)) ** 0.5
    assert rows[63].mean == pytest.approx(2 - fade, abs=0.01)
    assert rows[63].q95 - rows[63].q50 == pytest.approx(1.645 * sd, rel=0.1) and rows[63].q50 - rows[63].q05 == pytest.approx(1.645 * sd, rel=0.1)


def test_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"ticker": "A", "date": "2020-01-02", "marketcap": "1.5"}, {"ticker": "B", "date": null, "marketcap": "x"}]')
    (tmp_path / "b.json").write_text('{"columns": ["ticker", "marketcap"], "data": [["A", "2"], ["B", null]]}')
    rows = files.standard(files.read_payload(spark, f"file://{tmp_path}/a.json"), "daily").orderBy("ticker").collect()
    assert [(r.ticker, r.mcap) for r in rows] == [("A", 1.5e6), ("B", None)]
    assert [(r.ticker, r.marketcap) for r in files.read_payload(spark, f"file://{tmp_path}/b.json").collect()] == [("A", "2"), ("B", None)]


def test_contracts(spark):
    rows = [("A", date(2020, 5, 1), date(2020, 3, 31)), ("B", date(2020, 2, 1), date(2020, 3, 31))]
    filed = spark.createDataFrame(rows, "ticker string, datekey date, reportperiod date")
    with pytest.raises(store.ContractError, match="B"):
        store.check_known_dates(filed)
    assert store.check_known_dates(filed.filter("ticker = 'A'")).count() == 1
    by_quarter = filed.select("ticker", "datekey", F.col("reportperiod").alias("calendardate"))
    assert store.check_known_dates(by_quarter).count() == 2  # within the grace of a quarter
    prices = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 2.0)], "ticker string, close double")
    assert [r.ticker for r in files.wanted_only(prices, ["A", "C"]).collect()] == ["A", "C"]
    with pytest.raises(ValueError, match="B"):
        files.wanted_only(prices, ["A", "B"])


def test_csv_contract_branch(spark, tmp_path):
    line = lambda k, known: f"T{k},ARQ,2020-03-31,2020-03-31,{known}"
    good = [line(k, "2020-05-15") for k in range(500)]
    header = "ticker,dimension,calendardate,reportperiod,datekey"
    (tmp_path / "few.csv").write_text("\n".join([header, *good, line("bad", "2020-01-01")]))
    (tmp_path / "many.csv").write_text("\n".join([header, *good[:100], *[line(k, "2020-01-01") for k in range(50)]]))
    assert files.read_csv(spark, f"file://{tmp_path}/few.csv", "fundamentals").count() == 500
    with pytest.raises(store.ContractError):
        files.read_csv(spark, f"file://{tmp_path}/many.csv", "fundamentals")


def test_a_factor_name_is_registered_once():
    with pytest.raises(ValueError, match="PER"):
        catalog._add("value_price", "PER", catalog.f.netinc)


def test_streaming_windows_drop_late_events(spark, tmp_path):
    from pitpanel.streaming.ingest import event_stream, event_windows

    schema, start = "ts timestamp, event_type string, value double", datetime(2020, 1, 1, 10)
    at = lambda m: start + timedelta(minutes=m)
    batches = [[(at(5), "view", 1.0), (at(50), "view", 2.0)], [(at(130), "buy", 4.0)], [(at(20), "view", 100.0)], [(at(300), "buy", 1.0)]]
    (tmp_path / "in").mkdir()
    stream = event_windows(event_stream(spark, f"file://{tmp_path}/in", schema), "1 hour", late="10 minutes")
    for rows in batches:  # one batch after the other, from one checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.start.hour, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[10, "view"] == (2, 3.0) and got[12, "buy"] == (1, 4.0)  # the late event of minute 20 is not counted


@pytest.mark.parametrize("n, q", [(1, 0.6), (7, 0.5), (260, 0.6), (300, 0.0), (300, 1.0)])
def test_expanding_quantile(spark, n, q):
    from pitpanel.operators.timeseries import expanding_quantile

    rng = np.random.default_rng(n)
    values = [None if rng.random() < 0.1 and n > 1 else float(round(rng.normal(), 1)) for _ in range(n)]  # gaps and many ties
    rows = [(100 + 2 * k, v) for k, v in enumerate(values)]
    got = {r.idx: r.cut for r in expanding_quantile(spark.createDataFrame(rows, "idx int, v double").repartition(3), "v", q, 3).collect()}
    for k, (idx, v) in enumerate(rows):
        past = [x for x in values[: k + 1] if x is not None]
        if v is not None:
            assert got.pop(idx) == (None if len(past) < 3 else pytest.approx(np.quantile(past, q), abs=1e-12))
    assert not got


def test_reports_are_written_in_order_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("B", 1.5), ("A", 2.5), ("C", None)], "ticker string, score double").repartition(3)
    for _ in range(2):  # the second report replaces the first
        files.write_csv(rows, f"file://{tmp_path}/csv", "-score", "ticker")
        files.write_json(rows, f"file://{tmp_path}/json", "ticker")
    parts = lambda kind: [line for p in sorted((tmp_path / kind).glob("part-*")) for line in p.read_text().splitlines()]
    assert [line for line in parts("csv") if line != "ticker,score"] == ["A,2.5", "B,1.5", "C,"]
    assert parts("json") == ['{"ticker":"A","score":2.5}', '{"ticker":"B","score":1.5}', '{"ticker":"C","score":null}']


def test_returns_are_read_back_as_written(spark, tmp_path):
    rows = [(date(2020, 12, 30), 0.01), (date(2020, 12, 31), -0.02), (date(2021, 1, 4), 0.0), (date(2021, 1, 5), None)]
    files.write_returns(spark.createDataFrame(rows, "date date, r double"), f"file://{tmp_path}/oos")
    assert [tuple(x) for x in files.read_returns(spark, f"file://{tmp_path}/oos").collect()] == rows[:3]


def test_bundle_by_hand(spark):
    from pitpanel.operators import risk

    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, -0.5), ("a", 4, 0.2), ("b", 1, 0.1), ("b", 2, 0.1), ("c", 1, None)], "k string, idx int, r double")
    a, b, c = risk.bundle(rows, "k").orderBy("k").collect()
    assert (a.n, a.max_drawdown) == (3, 0.5) and abs(a.total + 0.1) < 1e-12 and abs(a.win_rate - 2 / 3) < 1e-12
    assert abs(a.calmar - (0.9**4 - 1) / 0.5) < 1e-12 and abs(a.calmar_mean - 0.2 / 3 * 12 / 0.5) < 1e-12
    assert b.max_drawdown == 0 and b.calmar is None and b.calmar_mean is None and abs(b.total - 0.21) < 1e-12
    assert (c.n, c.total, c.cagr, c.sharpe) == (0, 0.0, None, None)
