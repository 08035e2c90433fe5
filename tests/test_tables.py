"""Stored tables: load, reload, restate, read back; loads that are cut short; pruning."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pitpanel.sources import tables

PRICE = "ticker string, date date, close double, volume double"


@pytest.fixture
def kept(spark, tmp_path):
    return tables.Store(spark, f"file://{tmp_path}/store")


def prices(spark, *rows):
    return spark.createDataFrame([(t, date.fromisoformat(d), c, v) for t, d, c, v in rows], PRICE)


def held(store, table="prices", *columns):
    return sorted(tuple(r) for r in store.read(table).select(*(columns or ("ticker", "date", "close", "volume"))).collect())


def test_prices_merge_fields(spark, kept):
    assert kept.read("prices").collect() == [] and kept.pointer("prices") == (0, {})
    first = prices(spark, ("A", "2019-12-31", 1.0, None), ("A", "2020-01-02", 2.0, None), (None, "2020-01-02", 9.0, 9.0))
    assert kept.load("prices", first) == 2
    assert kept.load("prices", first) == 0  # a re-run adds nothing and moves no pointer
    assert kept.pointer("prices")[0] == 1
    assert kept.load("prices", prices(spark, ("A", "2020-01-02", None, 5.0), ("B", "2020-01-03", 3.0, 1.0))) == 1
    assert held(kept) == [("A", date(2019, 12, 31), 1.0, None), ("A", date(2020, 1, 2), 2.0, 5.0), ("B", date(2020, 1, 3), 3.0, 1.0)]
    assert len(set(kept.pointer("prices")[1].values())) == 2  # 2019 still lies in the first batch
    kept.purge("prices")
    assert len(held(kept)) == 3


def test_first_filing_wins_and_defaults(spark, kept):
    rows = spark.createDataFrame([("A", "2020-03-31", "2020-05-01", "10", "x"), ("A", "2020-03-31", "2020-04-20", "8", "1"), ("B", None, "2020-05-01", "1", "1")], "ticker string, calendardate string, datekey string, Revenue string, netinc string")
    assert kept.load("fundamentals", rows) == 1
    later = spark.createDataFrame([("A", "2020-03-31", "2020-04-01", 99.0)], "ticker string, calendardate string, datekey string, revenue double")
    assert kept.load("fundamentals", later) == 0
    assert held(kept, "fundamentals", "ticker", "dimension", "revenue", "netinc") == [("A", "ARQ", 8.0, 1.0)]


def test_events_are_replaced(spark, kept):
    schema = "ticker string, date date, action string, value double"
    kept.load("actions", spark.createDataFrame([("A", date(2020, 1, 2), "split", 2.0), ("A", date(2020, 1, 2), "dividend", 0.5)], schema))
    kept.load("actions", spark.createDataFrame([("A", date(2020, 1, 2), "split", 4.0)], schema))
    assert held(kept, "actions", "ticker", "action", "value") == [("A", "dividend", 0.5), ("A", "split", 4.0)]
    kept.load("members", spark.createDataFrame([("A", date(2020, 1, 2), "added")], "ticker string, date date, action string"))
    kept.load("tickers", spark.createDataFrame([("A", "Tech"), ("A", "Other")], "ticker string, sector string"))
    assert kept.read("tickers").count() == 1 and kept.read("members").count() == 1


def test_a_load_cut_short_leaves_no_part(spark, kept, monkeypatch):
    kept.load("prices", prices(spark, ("A", "2020-01-02", 2.0, 1.0)))
    before = held(kept)
    monkeypatch.setattr(kept, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        kept.load("prices", prices(spark, ("A", "2020-01-03", 3.0, 1.0), ("A", "2021-01-03", 3.0, 1.0)))
    monkeypatch.undo()
    assert held(kept) == before
    boom = prices(spark, ("A", "2020-01-03", 3.0, 1.0)).withColumn("close", F.when(F.col("close") > 0, F.raise_error(F.lit("bad row")).cast("double")))
    with pytest.raises(Exception, match="bad row"):
        kept.load("prices", boom)
    assert held(kept) == before
    kept.purge("prices")
    assert held(kept) == before


def test_of_two_loads_from_one_pointer_the_second_fails(spark, kept):
    kept.load("prices", prices(spark, ("A", "2020-01-02", 2.0, 1.0)))
    stale = kept.pointer("prices")
    kept.load("prices", prices(spark, ("A", "2020-01-03", 2.0, 1.0)))
    with pytest.raises(tables.Conflict):
        kept._point("prices", stale[0] + 1, stale[1])
    assert len(held(kept)) == 2


def test_pruning(spark, kept):
    kept.load("prices", prices(spark, *[("A", f"{y}-06-01", float(y), 1.0) for y in range(2010, 2020)], ("B", "2015-06-01", 1.0, 1.0)))
    rows = kept.between("prices", "2014-01-01", "2015-12-31", ["A"], ["ticker", "date", "close"])
    assert [r.close for r in rows.orderBy("date").collect()] == [2014.0, 2015.0]
    assert len(rows.inputFiles()) == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(ticker,A)" in plan and "GreaterThanOrEqual(date,2014-01-01)" in plan and "volume" not in plan.split("ReadSchema")[1]


def test_missing_ranges_only(spark, kept):
    source = prices(spark, *[(t, f"2020-01-{d:02d}", float(d), 1.0) for t in "ABC" for d in range(1, 29)])
    kept.load("prices", source.filter("ticker = 'A' AND date BETWEEN '2020-01-05' AND '2020-01-10'"))
    asked = []

    def fetch(ranges):
        asked.extend((r.ticker, r.start.day, r.end.day) for r in ranges.collect())
        return source.join(ranges, "ticker").filter("date BETWEEN start AND end").select(*source.columns)

    wanted = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    assert kept.fill(wanted, "2020-01-01", "2020-01-20", fetch) == 1
    assert sorted(asked) == [("A", 1, 4), ("A", 11, 20), ("B", 1, 20)]
    assert [(r.ticker, r.n_rows) for r in kept.metadata().collect()] == [("A", 20), ("B", 20)]
    asked.clear()
    assert kept.fill(wanted, "2020-01-01", "2020-01-20", fetch) == 0 and asked == []
    kept.clear("prices", ["A"])
    assert [r.ticker for r in kept.metadata().collect()] == ["B"]
    kept.clear("prices")
    assert kept.read("prices").collect() == []


def test_splits_leave_no_jump(spark, kept):
    kept.load("prices", prices(spark, ("A", "2020-01-02", 200.0, 1.0), ("A", "2020-01-03", 204.0, 1.0), ("B", "2020-01-02", 10.0, 1.0)))
    kept.rescale(prices(spark, ("A", "2020-01-02", 100.0, 1.0), ("A", "2020-01-03", 102.0, 1.0), ("A", "2020-01-06", 103.0, 1.0), ("B", "2020-01-03", 10.1, 1.0)))
    assert [(t, c) for t, _, c, _ in held(kept)] == [("A", 100.0), ("A", 102.0), ("A", 103.0), ("B", 10.0), ("B", 10.1)]
