"""The workbench, storage, search and streams."""

import json

import pytest
from pyspark.sql import functions as F

from factorloom.lab import Lab, Pool
from factorloom.library import FactorFile, FactorPool, FactorStore, analyse, correlations, load_folder
from factorloom.operators import backtest, search
from factorloom.sources import bars, filters, sinks
from factorloom.streaming import rollup


@pytest.fixture(scope="module")
def daily(spark, sf_dir):
    return bars.period_bars(spark, sf_dir, "month").cache()


@pytest.fixture(scope="module")
def lab(daily):
    x = Lab(daily, config=backtest.BacktestConfig(quantiles=3), search_config=search.SearchConfig(population=4, generations=1, max_depth=3, elite=1))
    x.register("mom", "close / delay(close, 1) - 1")
    x.register("calm", "-std(close, 6)")
    return x


def test_lab(lab):
    assert lab.list() == ["calm", "mom"]
    p = lab.calc()
    assert set(p.columns) == {"factor", "trading_date", "symbol", "raw", "winsored", "zscored", "cap_neued", "qcut"}
    assert lab.run_bt().metrics.count() == 2 and lab.evaluate().count() == 2
    assert sum(m.count() for m in lab.backtest_each(1)) == 2
    s = lab.run_strategy({"type": "equal_weight"})
    assert lab.run_opt(s.where("symbol < 3 and trading_date < '1995-06-01'"), "risk_parity").count() == 15
    assert lab.run_multi().metrics.count() == 1
    best = lab.run_gp(["close", "vol"]).best
    assert best.fitness > -1e6


def test_own_functions(lab):
    lab.define("halve", 1, lambda x: x / 2)
    lab.register("half", "halve(close) / close")
    assert {round(r["half"], 9) for r in lab.values(["half"]).collect()} == {0.5}
    lab.unregister("half")
    with pytest.raises(ValueError, match="built in"):
        lab.define("abs", 1, lambda x: x)


def test_tear_sheet_and_metadata(spark, lab, daily, sf_dir):
    sheet = lab.tear_sheet("mom")
    assert set(sheet) == {"nav", "ic", "group_ic", "daily", "metrics"} and {r["grp"] for r in sheet["nav"].select("grp").distinct().collect()} == {0, 1, 2, 3}
    assert "lineitem" in {r["name"] for r in filters.tables(spark, sf_dir).collect()}
    assert ("close", "double") in {tuple(r) for r in filters.columns(daily).collect()}
    assert set(filters.check_bars(daily).first()) == {0}


def test_batches_skip_failures(lab):
    failed = []
    lab.register("broken", "nosuchcolumn + 1")
    got = list(lab.backtest_each(1, lambda names, e: failed.append(names)))
    lab.unregister("broken")
    assert failed == [["broken"]] and len(got) == 2


def test_year_reset(lab):
    lab.reset = "year"
    first = lab.values(["mom"]).where("month(trading_date) = 1")
    lab.reset = None
    assert first.where("mom is not null").count() == 0


def test_policies_agree(daily, lab):
    want = None
    for policy in ("all", "recent", "n", "none", "budget"):
        lab.pool = Pool(policy, budget=1)
        lab.set_duration("1995-01-01", "1995-12-31")
        got = sorted(tuple(r) for r in lab.evaluate().select("factor", F.round("ic_mean", 9)).collect())
        assert want is None or got == want
        want = got
    lab.set_filter("")
    with pytest.raises(ValueError, match="unknown policy"):
        Pool("lucky")


def test_prefilter(daily):
    assert daily.where(filters.parse_prefilter("like '1%'")).where("cast(symbol as string) like '1%'").count() == 0
    with pytest.raises(ValueError, match="can't read"):
        filters.parse_prefilter("symbol ~ 3")


def test_sources():
    assert "pe_ttm" in bars.fields("1d") and "pre_close" in bars.fields("5m") and "pe" not in bars.fields("1h")
    assert bars.can_aggregate("5m", "1d") and not bars.can_aggregate("1d", "5m")
    assert bars.SourceConfig.from_env({"FACTORLOOM_PATH": "/x"}).path == "/x"


def test_canonical(spark):
    df = spark.createDataFrame([(2.0, 10.0, 30.0, 5.0)], "close double, volume double, amount double, free_float_shares double")
    r = bars.canonical(df).first()
    assert (r["vol"], r["vwap"], r["cap"]) == (10.0, 30.0, 10.0)


def test_sinks(spark, lab, tmp_path):
    sinks.write_factors(lab.calc(["mom"]), str(tmp_path / "f"))
    assert "qcut" in spark.read.parquet(str(tmp_path / "f")).columns
    sinks.write_factors(lab.calc(["mom"]), str(tmp_path / "c"), "csv", True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns[:3] == ["factor", "symbol", "date"]
    sinks.write_nav(lab.run_bt(["mom"]).nav, str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "n")).columns == ["date", "nv", "group"]


def test_store(spark, tmp_path, lab):
    s = FactorStore(tmp_path)
    a = s.register("close / open", {"ic_mean": 0.05}, ["x"])
    assert s.register("close/open") == a and len(s.list()) == 1
    b = s.register("-std(close, 5)", {"ic_mean": 0.01, "turnover": 0.5})
    assert [r["id"] for r in s.search("std")] == [b] and [r["id"] for r in s.search(tag="x")] == [a] and len(s.search(least_ic=0.03)) == 1
    values = lab.values(["mom"]).withColumnRenamed("mom", "value")
    assert s.write_values(a, values) == 1 and s.write_values(a, values) == 2
    assert s.read_values(spark, a).count() == values.count()
    s.export(tmp_path / "e.json")
    t = FactorStore(tmp_path / "other")
    assert t.load(tmp_path / "e.json") == 2 and t.get(a)["expression"] == "close/open"
    assert correlations(s.table(spark)).count() == 1
    assert s.delete(b) and not s.delete(b)
    json.loads((tmp_path / "factors.json").read_text())
    found = analyse(t.list())
    assert found["usage"]["ts_std"] == 1 and 0 < found["confidence"] < 1


def test_factor_files(tmp_path):
    f = FactorFile("m", 'close / "'.replace(' / "', " / open"), "ratio of \"two\"", tags=["t"], readonly=True)
    f.save(tmp_path / "m.al")
    assert load_folder(tmp_path)["m"] == FactorFile("m", "close / open", 'ratio of "two"', "ratio", ["t"], True)
    with pytest.raises(PermissionError):
        f.save(tmp_path / "m.al")


def test_pool():
    p = FactorPool(max_size=2)
    assert p.admit("close / open", 0.01, 0.02) == "added"
    assert p.admit("close / open", 0.01, 0.09) == "duplicate"
    assert p.admit("ts_mean(vol, 5)", 0.01, 0.05) == "added"
    assert p.admit("cs_rank(high)", 0.01, 0.01) == "below_minimum"
    assert p.admit("cs_rank(high)", 0.01, 0.03) == "added" and len(p.entries) == 2
    p.round({"ts_mean(vol, 5)"})
    assert [e["survived"] for e in p.entries] == [1]


def test_search_is_seeded(daily, lab):
    a = lab.run_gp(["close", "vol"])
    b = lab.run_gp(["close", "vol"])
    assert [search.text(x.tree) for x in a.population] == [search.text(x.tree) for x in b.population]
    assert not search.valid(search.Bin("/", search.Col("a"), search.Num(0.0)), 5)
    assert not search.valid(search.Call("ts_mean", (search.Col("a"), search.Num(1.0))), 5)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", f"2024-01-{1 + i // 20:02d} 10:{i % 20:02d}:00", float(i % 7), 1.0) for i in range(60)]
    ev = spark.createDataFrame(rows, "symbol string, t string, price double, size double").selectExpr("symbol", "cast(t as timestamp) as ts", "price", "size")
    ev.write.parquet(str(tmp_path / "ev"))
    q = rollup.rollup(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("r").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("r").collect())) == sorted(map(tuple, rollup.rollup(ev).collect()))
    day = ev.groupBy("symbol", F.to_date("ts").alias("trading_date")).agg(F.max_by("price", "ts").alias("close")).coalesce(1)
    day.write.parquet(str(tmp_path / "day"))
    q = rollup.ema(spark.readStream.schema(day.schema).parquet(str(tmp_path / "day")), 0.4).writeStream.format("memory").queryName("e").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    from factorloom.functions.ema import with_ema

    want = with_ema(day, {"ema": ("close", 0.4)}).select("symbol", "trading_date", "ema")
    rounded = lambda df: sorted((r["symbol"], r["trading_date"], round(r["ema"], 9)) for r in df.collect())
    assert rounded(spark.table("e")) == rounded(want)
