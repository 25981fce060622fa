"""Physical plans: what is read, pushed down and shuffled."""

import re

from pyspark.sql import functions as F

from factorloom import queries
from factorloom.operators import backtest
from factorloom.sources import filters


def plan(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanges(df):
    """Shuffles by key in the plan's tree."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_scan_reads_only_what_a_formula_needs(spark, sf_dir):
    p = plan(queries.QUERIES["ts_mean"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp(_ntz)?>", p)


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", 2.0)], "symbol int, d string, close double").withColumn("trading_date", F.to_date("d"))
    df.drop("d").write.parquet(str(tmp_path / "bars"))
    p = plan(spark.read.parquet(str(tmp_path / "bars")).where(filters.parse_prefilter("2024-01-01:2024-02-01, close > 1")).select("symbol"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(trading_date.*GreaterThan\(close", p)


def test_aggregates_are_partial_before_the_shuffle(spark, sf_dir):
    p = plan(queries.QUERIES["grp_wcr"](spark, sf_dir))
    assert "partial_sum" in p and exchanges(queries.QUERIES["grp_wcr"](spark, sf_dir)) <= 2


def test_no_python_in_window_queries(spark, sf_dir):
    for name in ("cs_pipeline", "ts_rank", "ts_wma", "bt_ic", "st_signal", "opt_topk", "risk_dd"):
        assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, sf_dir))), name


def test_labels_need_two_shuffles_at_most(spark):
    df = spark.createDataFrame([("f", "2024-01-01", "s", 1.0)], "factor string, d string, symbol string, value double").withColumn("trading_date", F.to_date("d"))
    assert exchanges(backtest.weights(backtest.groups(df, 5), 5)) <= 3
