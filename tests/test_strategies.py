"""Declared strategies, search inside walk-forward and registered rotations on small hand-made tables."""

import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.functions.columns import normal_cdf
from pitpanel.operators import search, strategy, tactics, walkforward
from pitpanel.operators.universe import Universe
from pitpanel.sources import panels

DAYS = [date(2000, 1, 3) + timedelta(days=k) for k in range(1500)]
SPACE = {"n": ("int", 1, 9), "w": ("float", -1.0, 1.0), "kind": ("cat", ["a", "b", "c"])}


def plain_returns(p):
    k = np.arange(len(DAYS))
    wave = 0.01 * np.sin(k * (0.3 + 0.01 * p["n"])) + 0.001 * math.cos(3 * p["w"]) + 0.0005 * (p["kind"] == "b") * (k > 700)
    return np.round(wave, 9) if p["n"] != 9 else np.full(len(DAYS), np.nan)  # a configuration that fails


def plain_objective(r):
    r = r[~np.isnan(r)]
    if len(r) < 60 or r.std(ddof=1) <= 1e-9:
        return -math.inf
    return (r.mean() - 0.05 / 252) / r.std(ddof=1) * math.sqrt(252)


def plain_search(folds, trials, seed):
    """One fold and one trial after the other."""
    out = []
    for f in folds:
        rng, done = np.random.default_rng(seed + f.no), []
        inside = np.array([f.train_start <= d <= f.train_end for d in DAYS])
        for k in range(trials):
            p = walkforward.drawn(SPACE, rng) if k < max(4, trials // 4) else walkforward.proposed(done, SPACE, rng)
            done.append((p, plain_objective(plain_returns(p)[inside])))
            out.append((f.no, k, walkforward.key(p), done[-1][1]))
    return out


def returns_of(spark):
    def make(configs):
        rows = [(c, d, None if math.isnan(r) else float(r)) for c, p in configs.items() for d, r in zip(DAYS, plain_returns(p), strict=True)]
        return spark.createDataFrame(rows, "config string, date date, r double")

    return make


@pytest.mark.parametrize("method", ["bayesian", "random", "grid"])
def test_search_matches_a_plain_loop(spark, method):
    folds = search.folds(DAYS[0], DAYS[-1], 24, 6)
    assert len(folds) >= 3
    found = walkforward.run(spark, returns_of(spark), SPACE, folds, panels.kept, method, trials=7, steps=2, top=2, seed=5)
    log = {(r.fold, r.trial): (r.config, r.objective) for r in found.log.collect()}
    if method == "bayesian":
        want = plain_search(folds, 7, 5)
    else:
        rngs = {f.no: np.random.default_rng(5 + f.no) for f in folds}
        params = {f.no: walkforward.lattice(SPACE, 2) if method == "grid" else [walkforward.drawn(SPACE, rngs[f.no]) for _ in range(7)] for f in folds}
        inside = {f.no: np.array([f.train_start <= d <= f.train_end for d in DAYS]) for f in folds}
        want = [(no, k, walkforward.key(p), plain_objective(plain_returns(p)[inside[no]])) for no, some in params.items() for k, p in enumerate(some)]
    assert len(log) == len(want)
    for no, k, config, value in want:
        assert log[no, k][0] == config and log[no, k][1] == pytest.approx(value, rel=1e-6)
    chosen = {(r.fold, r.place): r.config for r in found.chosen.collect()}
    tested = {(r.fold, r.date): r.r for r in found.tested.collect()}
    for f in folds:
        ranked = sorted((x for x in want if x[0] == f.no), key=lambda x: (-x[3], x[1]))[:2]
        assert [chosen[f.no, 1], chosen[f.no, 2]] == [x[2] for x in ranked]
        mean = np.mean([plain_returns(found.params[x[2]]) for x in ranked], axis=0)
        for d, r in zip(DAYS, mean, strict=True):
            assert ((f.no, d) in tested) == (f.test_start <= d <= f.test_end)
            if (f.no, d) in tested:
                assert tested[f.no, d] == pytest.approx(r)
    assert walkforward.figures(found).first().trials == len(want)
    assert {r.gate for r in walkforward.gates(found).collect()} == set(walkforward.GATES)


def test_calmar_objective_in_folds(spark):
    folds = search.folds(DAYS[0], DAYS[-1], 24, 12)
    found = walkforward.run(spark, returns_of(spark), {"n": ("int", 8, 9)} | {k: SPACE[k] for k in ("w", "kind")}, folds, panels.kept, "grid", steps=2, objective="calmar")
    for row in found.log.collect():
        r = plain_returns(found.params[row.config])[[folds[row.fold].train_start <= d <= folds[row.fold].train_end for d in DAYS]]
        if np.isnan(r).all():
            assert row.objective == -math.inf and row.n == 0
        else:
            curve = np.cumprod(1 + r)
            assert row.objective == pytest.approx((curve[-1] ** (252 / len(r)) - 1) / abs((curve / np.maximum.accumulate(curve) - 1).min()), rel=1e-6)


def test_spaces():
    assert walkforward.lattice({"a": ("int", 1, 4), "b": ("cat", ["x", "y"])}, 3) == [{"a": a, "b": b} for a in (1, 2, 4) for b in ("x", "y")]
    assert walkforward.unit({"n": 9, "w": 0.0, "kind": "b"}, SPACE) == [1.0, 0.5, 0.5]
    assert walkforward.space_from_json('{"n": ["int", 1, 3], "k": ["cat", ["a"]]}') == {"n": ("int", 1, 3), "k": ("cat", ["a"])}
    for bad in ({"n": ("int", 3, 1)}, {"n": ("log", 1, 2)}, {"n": ("cat", [])}):
        with pytest.raises(ValueError):
            walkforward.checked(bad)


def test_declarations():
    s = strategy.Declared("s", (("value", 1.0), ("size", -2.0)), Universe(least_price=5.0, without_sectors=("Financial",)), n=30, timing_days=200)
    assert strategy.Declared.from_json(s.to_json()) == s
    assert strategy.Declared.from_json('{"name": "t", "factors": ["value"], "rebalance": "quarter"}').factors == (("value", 1.0),)
    other = s.with_params("x", {"n": 7, "w_size": 0.5, "weighting": "value"})
    assert (other.name, other.n, dict(other.factors)["size"], other.weighting) == ("x", 7, 0.5, "value")
    for params in ({"n_stock": 3}, {"w_growth": 1.0}):
        with pytest.raises(KeyError):
            s.with_params("x", params)
    with pytest.raises(KeyError):
        strategy.Declared.from_json('{"name": "t", "factors": ["value"], "univrse": {}}')
    for wrong in ({"n": 0}, {"rebalance": "week"}, {"weighting": "lucky"}, {"max_weight": 0.0}):
        with pytest.raises(ValueError):
            strategy.Declared("s", (("value", 1.0),), **wrong)


@pytest.fixture(scope="module")
def market(spark):
    """Four names over 150 days; B jumps by half on the day of the first month's signal."""
    days = [date(2001, 1, 1) + timedelta(days=k) for k in range(150)]
    price = {"A": lambda k: 100 * 1.001**k, "B": lambda k: 50.0 * (1.5 if k >= 30 else 1.0), "C": lambda k: 10 * 0.999**k, "D": lambda k: None if k > 80 else 20.0}
    rows = [(t, d, k + 1, None if of(k) is None else float(of(k)), 10.0, 100.0 * (1 + "ABCD".index(t))) for t, of in price.items() for k, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "ticker string, date date, idx int, close double, volume double, mcap double")
    z = daily.select("idx", "ticker", F.lit("mcap").alias("factor"), F.col("mcap").alias("z"))
    bench = spark.createDataFrame([(d, k + 1, 100.0 - k * 0.1) for k, d in enumerate(days)], "date date, idx int, close double")
    return strategy.Market(daily, z, bench)


def test_strategies_do_not_see_ahead(market):
    book = [strategy.Declared("up", (("mcap", -1.0),), n=2), strategy.Declared("down", (("mcap", 1.0),), n=1, slippage_bps=95.0), strategy.Declared("timed", (("mcap", -1.0),), n=2, timing_days=20)]
    chosen = {(r.config, r.idx): set() for r in strategy.weights(market, book).collect()}
    for r in strategy.weights(market, book).collect():
        chosen[r.config, r.idx].add(r.ticker)
    assert chosen["up", 31] == {"A", "B"} and chosen["down", 31] == {"D"} and chosen["down", 90] == {"C"}  # D has no price any more
    rows = {(r.config, r.idx): r for r in strategy.returns(market, book).collect()}
    assert min(i for c, i in rows if c == "up") == 33  # signal on row 31, trade on 32, the jump of row 31 is not earned
    assert max(r.ret for (c, _), r in rows.items() if c == "up") < 0.01
    assert rows["down", 33].ret == pytest.approx(-0.01) and rows["down", 33].turnover == pytest.approx(0.5)
    assert all(r.ret == 0 for (c, i), r in rows.items() if c == "timed" and i > 33)
    assert {r.config for r in strategy.summary(strategy.returns(market, book)).collect()} == {"up", "down", "timed"}
    with pytest.raises(ValueError):
        strategy.returns(market, [book[0], book[0]])


def test_universe_and_caps(market):
    book = [strategy.Declared("all", (("mcap", 1.0),), n=4, weighting="value", max_weight=0.3), strategy.Declared("dear", (("mcap", 1.0),), Universe(least_price=30.0), n=4)]
    first = [r for r in strategy.weights(market, book).collect() if r.idx == 31]
    by = {(r.config, r.ticker): r.w for r in first}
    assert {t for c, t in by if c == "dear"} == {"A", "B"} and by["dear", "A"] == 0.5
    assert sum(w for (c, _), w in by.items() if c == "all") == pytest.approx(1) and by["all", "D"] == pytest.approx(0.3) and by["all", "C"] == pytest.approx(0.3)


def test_band_in_a_strategy(spark, market):
    """B and C change places each month: without a band the pick follows, with one the first stays."""
    z = market.daily.select("idx", "ticker", F.lit("flip").alias("factor"), F.when(F.col("ticker") == "B", F.when(F.col("idx") % 2 == 1, 2.0).otherwise(1.0)).when(F.col("ticker") == "C", 1.5).otherwise(0.0).alias("z"))
    at = strategy.Market(market.daily, z, market.benchmark)
    book = [strategy.Declared("plain", (("flip", 1.0),), n=1), strategy.Declared("banded", (("flip", 1.0),), n=1, band=2.0)]
    got = {(r.config, r.idx): r.ticker for r in strategy.weights(at, book).collect()}
    assert {t for (c, _), t in got.items() if c == "banded"} == {"B"}
    assert all(got["plain", i] == ("B" if i % 2 == 1 else "C") for c, i in got if c == "plain") and "C" in got.values()
    with pytest.raises(ValueError):
        strategy.Declared("s", (("flip", 1.0),), band=0.5)


def signal_rows(spark, rows):
    return spark.createDataFrame([(t, 0, i, 1.0, m, s, r) for t, i, m, s, r in rows], "ticker string, sleeve int, idx int, close double, mom double, ratio double, r double")


def test_rotation_cash_and_static_weights(spark):
    book = (
        tactics.Tactic("dual", ("A",), ("A",), ("B", "C", "D"), 1, 3, cash="D"), tactics.Tactic("mix", static=(("A", 0.6), ("B", 0.4))),
        tactics.Tactic("plain", ("A",), ("A",), ("B", "C"), 1, 2, "mom"),
    )
    rows = [(t, i, m, s, 0.1) for i in (1, 2, 3) for t, m, s in (("A", -1.0 if i == 1 else 1.0, 1.2), ("B", 0.5, 1.1), ("C", 0.4, 0.8), ("D", 0.1, 1.0))]
    signal = signal_rows(spark, rows)
    held = tactics.weights(signal, tactics.member_table(spark, book))
    got = {(r.name, r.idx, r.ticker): round(r.w, 6) for r in held.collect()}
    assert {k: v for k, v in got.items() if k[:2] == ("dual", 1)} == {("dual", 1, "B"): round(1 / 3, 6), ("dual", 1, "D"): round(2 / 3, 6)}  # C and D itself are not above D
    assert {k: v for k, v in got.items() if k[:2] == ("mix", 1)} == {("mix", 1, "A"): 0.6, ("mix", 1, "B"): 0.4}
    assert got["plain", 1, "B"] == 0.5 and got["dual", 2, "A"] == 1.0
    out = {(r.name, r.idx): r for r in tactics.sleeve_returns(held, signal, 100.0).collect()}
    assert sorted(i for n, i in out if n == "dual") == [2, 3]  # the last month has none after it
    assert out["mix", 2].ret == pytest.approx(0.1 - 0.01) and out["mix", 3].ret == pytest.approx(0.1) and out["dual", 3].turnover == pytest.approx(2.0)
    with pytest.raises(Exception, match="no return of A"):
        tactics.sleeve_returns(held, signal_rows(spark, [(t, i, m, s, None if (t, i) == ("A", 2) else r) for t, i, m, s, r in rows])).collect()


def test_rotation_declarations(spark):
    assert len(tactics.REGISTERED) == 9 and all(t.needed for t in tactics.REGISTERED)
    with pytest.raises(ValueError):
        tactics.Tactic("nothing")
    with pytest.raises(ValueError):
        tactics.member_table(spark, (tactics.REGISTERED[0], tactics.REGISTERED[0]))


def test_verdict_gives_reasons(spark):
    metrics = spark.createDataFrame([("good", 0.5, -0.1, 0.99), ("base", 0.3, -0.3, 0.5), ("weak", 0.2, -0.1, None)], "name string, calmar double, mdd double, dsr double")
    pbo = spark.createDataFrame([(0.4,)], "pbo double")
    assert {r.name: (r.adopted, r.reasons) for r in tactics.verdict(metrics, pbo, "base").collect()} == {"good": (True, ""), "base": (False, "mdd,dsr"), "weak": (False, "calmar")}


def test_normal_cdf(spark):
    values = [-8.0, -6.5, -3.0, -1e-9, 0.0, 0.3, 2.0, 6.9, 7.5, None]
    for z, p in spark.createDataFrame([(v,) for v in values], "z double").select("z", normal_cdf(F.col("z"))).collect():
        assert p is None if z is None else p == pytest.approx(NormalDist().cdf(z), abs=1e-12)
