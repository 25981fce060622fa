"""Formulas: grammar, aliases, simplification, and the values of functions on small vectors."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.plans.ast import Bin, Call, Col, Neg, Num, dimension, is_factor, simplify, text
from factorloom.plans.compiler import compute
from factorloom.plans.parser import FormulaError, parse


@pytest.mark.parametrize("bad", ["", "  ", "a > b", "foo(x)", "(a", "a b", "a +", "ts_mean()", "ts_mean(a, 2, 3)", "7h:close", "1d:median(5m:vol)", "a ) b", "3x"])
def test_errors(bad):
    with pytest.raises(FormulaError):
        parse(bad)


def test_grammar():
    assert parse("close") == Col("close") == parse("1d:close")
    assert parse("5m:vol") == Col("vol", "5m")
    assert parse("a + b * c") == Bin("+", Col("a"), Bin("*", Col("b"), Col("c")))
    assert parse("-a * b") == Bin("*", Neg(Col("a")), Col("b"))
    assert parse("RANK(a)") == Call("cs_rank", (Col("a"),))
    assert parse("Corr(a, b, 5)") == Call("ts_correlation", (Col("a"), Col("b"), Num(5.0)))
    assert parse("1d:avg(5m:vol)") == Call("mean", (Col("vol", "5m"),), "1d")
    assert parse("1.5e2 + .5") == Num(150.5)
    assert parse("ts_delay(a, -(-3))").args[1] == Num(3.0)


def test_simplify_keeps_missing_values():
    assert simplify(parse("a * 0")) == Bin("*", Col("a"), Num(0.0))
    assert parse("a - a") == Bin("-", Col("a"), Col("a"))
    assert parse("(a + 0) * 1 / 1") == Col("a")
    assert parse("2 * 3 + a") == Bin("+", Num(6.0), Col("a"))


def test_dimensions():
    assert dimension(parse("close / open")) == "ratio" and is_factor(parse("close / open"))
    assert dimension(parse("close * vol")) == "amount"
    assert dimension(parse("close + vol")) == "unknown" and not is_factor(parse("close"))


trees = st.recursive(
    st.sampled_from("abc").map(Col) | st.floats(0.5, 9).map(Num),
    lambda t: st.builds(Bin, st.sampled_from("+-*/"), t, t) | st.builds(Neg, t) | st.builds(lambda x: Call("abs", (x,)), t) | st.builds(lambda x, y: Call("max", (x, y)), t, t),
    max_leaves=12,
)


@given(trees)
@settings(max_examples=150, deadline=None)
def test_text_round_trip(tree):
    once = parse(text(tree))
    assert parse(text(once)) == once


def column(spark, formula, values, **more):
    """The values of a formula over one symbol's rows."""
    rows = [("s", f"2024-01-{i + 1:02d}", v, *(m[i] for m in more.values())) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"symbol string, d string, x double{''.join(f', {k} double' for k in more)}").selectExpr("symbol", "cast(d as date) as trading_date", "x", *more)
    return [r["v"] for r in compute({"v": formula}, df).orderBy("trading_date").collect()]


@pytest.mark.parametrize(
    ("formula", "values", "want"),
    [
        ("ts_mean(x, 3)", [1, 2, 3, 4, 5], [1, 1.5, 2, 3, 4]),
        ("ts_sum(x, 3)", [1, 2, 3, 4, 5], [1, 3, 6, 9, 12]),
        ("ts_max(x, 3)", [1, 5, 3, 2, 4], [1, 5, 5, 5, 4]),
        ("ts_min(x, 3)", [3, 1, 5, 2, 4], [3, 1, 1, 1, 2]),
        ("delay(x, 2)", [1, 2, 3, 4, 5], [None, None, 1, 2, 3]),
        ("delta(x, 1)", [10, 12, 11, 15, 14], [None, 2, -1, 4, -1]),
        ("sign(x)", [-2, -1, 0, 1, 2], [-1, -1, 0, 1, 1]),
        ("ts_sum(x, 2)", [None, None, 3, None, 5], [0, 0, 3, 3, 5]),
        ("ts_count(x, 2)", [None, None, 3, None, 5], [0, 0, 1, 1, 1]),
        ("ts_std(x, 3)", [4, None, 4, 4], [None, None, 0, 0]),
        ("ts_argmax(x, 3)", [5, 5, 1, None], [1, 2, 3, 3]),
        ("highday(x, 3)", [5, 5, 1, None], [0, 0, 1, 2]),
        ("lowday(x, 3)", [1, 1, 2, None], [0, 1, 2, 2]),
        ("ts_rank(x, 3)", [1, 3, None, 2], [0, 0.5, 0, 1 / 3 * 0 + 0]),
        ("ema(x, 4, 2)", [None, 2, None, 4], [None, 2, 2, 3]),
        ("1 / (x - 2)", [1, 2, 3], [-1, None, 1]),
        ("if(x, 1, -1)", [None, 0, 2], [-1, -1, 1]),
        ("power(x, -1)", [2, 4, 0], [0.5, 0.25, None]),
        ("ts_rsquare(x, 3)", [1, 2, None], [0, 1, None]),
        ("ts_mean(x, 100)", [1, 3], [1, 2]),
    ],
)
def test_vectors(spark, formula, values, want):
    got = column(spark, formula, [None if v is None else float(v) for v in values])
    assert [None if g is None else round(g, 9) for g in got] == [None if v is None else round(v, 9) for v in want]


def test_constant_sides(spark):
    assert column(spark, "corr(x, y, 3)", [1.0, 2.0, 3.0], y=[5.0, 5.0, 5.0]) == [None] * 3
    assert column(spark, "corr(x, y, 3)", [1.0, 2.0, 3.0], y=[2.0, 4.0, 6.0])[2] == pytest.approx(1)


def test_correlation_window_compat(spark):
    rows = [("s", f"2024-01-{i + 1:02d}", float(i * i % 7), float(i % 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, d string, x double, y double").selectExpr("symbol", "cast(d as date) as trading_date", "x", "y")
    a = [r["v"] for r in compute({"v": "corr(x, y, 3)"}, df, compat=True).orderBy("trading_date").collect()]
    b = [r["v"] for r in compute({"v": "corr(x, y, 20)"}, df).orderBy("trading_date").collect()]
    assert a == b


def dates(spark, per_date, formula, extra=()):
    rows = [(f"s{j:02d}", f"2024-01-{i + 1:02d}", *v) if isinstance(v, tuple) else (f"s{j:02d}", f"2024-01-{i + 1:02d}", v) for i, day in enumerate(per_date) for j, v in enumerate(day)]
    df = spark.createDataFrame(rows, "symbol string, d string, x double" + "".join(f", {c} double" for c in extra)).selectExpr("symbol", "cast(d as date) as trading_date", "x", *extra)
    out = {}
    for r in compute({"v": formula}, df).orderBy("trading_date", "symbol").collect():
        out.setdefault(r["trading_date"], []).append(r["v"])
    return list(out.values())


def test_cross_section(spark):
    assert dates(spark, [[3.0, 1.0, 2.0, 5.0, 4.0]], "cs_rank(x)")[0] == pytest.approx([0.4, 0, 0.2, 0.8, 0.6])
    assert dates(spark, [[1.0, 2.0, 100.0, 4.0, 5.0]], "winsor(x)")[0] == [1, 2, 100, 4, 5]
    assert dates(spark, [[3.0, 1.0, 2.0], [2.0, 2.0, 1.0]], "to_percentiles(x)") == [[1, 0, 0.5], [0.75, 0.75, 0]]
    assert dates(spark, [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]], "zscore_rows(x)") == [[-1, 0, 1], [0, 0, 0]]
    z = dates(spark, [[1.0, 2.0, 3.0, 4.0, 5.0], [9.0, 7.0, 1.0, 2.0, 3.0]], "zscore(x)")
    for day in z:
        assert sum(day) == pytest.approx(0) and sum(v * v for v in day) / 4 == pytest.approx(1)
    n = dates(spark, [[(10.0 * i, float(i)) for i in range(1, 13)]], "cap_neu(x, c)", ("c",))[0]
    assert sum(n) == pytest.approx(0, abs=1e-9) and any(abs(v) > 1e-6 for v in n)
    few = dates(spark, [[(float(i), 2.0) for i in range(5)]], "cap_neu(x, c)", ("c",))[0]
    assert few == [0, 1, 2, 3, 4]
    assert dates(spark, [[1.0, 1.0, 2.0, None, 3.0]], "qcut(x, 4)")[0] == [0, 0, 2, None, 3]


def test_frequency_aggregates(spark):
    rows = [("s", "2024-01-01", b, float(b), None if b == 1 else 2.0) for b in range(4)]
    i = spark.createDataFrame(rows, "symbol string, d string, bar int, close double, vol double").selectExpr("symbol", "cast(d as date) as trading_date", "bar", "close", "vol")
    day = spark.createDataFrame([("s", "2024-01-01", 8.0)], "symbol string, d string, close double").selectExpr("symbol", "cast(d as date) as trading_date", "close")
    got = compute({"n": "1d:count(5m:vol)", "s": "1d:sum(5m:vol * 5m:close) + 1", "mix": "1d:mean(5m:vol) * close", "p": "1d:product(5m:vol)"}, day, i).first()
    assert (got["n"], got["s"], got["mix"], got["p"]) == (4, 11, 16, 8)
    with pytest.raises(ValueError, match="window functions below"):
        compute({"v": "1d:sum(ts_mean(5m:vol, 2))"}, day, i)


def test_nan_becomes_missing(spark):
    from factorloom.sources.bars import clean

    got = clean(spark.createDataFrame([(math.nan,), (math.inf,), (1.0,)], "x double")).collect()
    assert [r["x"] for r in got] == [None, None, 1.0]


def test_one_shuffle_for_one_partitioning(spark):
    """All rolling functions of a level share the exchange by symbol."""
    rows = [("s", "2024-01-01", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, d string, x double").selectExpr("symbol", "cast(d as date) as trading_date", "x")
    plan = compute({f"f{w}": f"ts_mean(x, {w}) + ts_std(x, {w}) - ts_slope(x, {w})" for w in range(2, 12)}, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
