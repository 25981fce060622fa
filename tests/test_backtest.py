"""Backtests on small matrices with known answers, and against a plain restatement."""

import numpy as np
import pytest

from factorloom.operators import backtest, metrics, prices
from factorloom.operators.backtest import BacktestConfig, simulate


def frame(spark, matrix, name="value"):
    rows = [(f"2024-01-{i + 1:02d}", f"s{j}", None if v is None else float(v)) for i, day in enumerate(matrix) for j, v in enumerate(day)]
    return spark.createDataFrame(rows, f"d string, symbol string, {name} double").selectExpr("cast(d as date) as trading_date", "symbol", name, "'f' as factor")


def grid(spark, returns, close=None, tradable=None):
    rows = []
    for i, day in enumerate(returns):
        for j, v in enumerate(day):
            c = 1.0 if close is None else float(close[i][j])
            rows.append((f"2024-01-{i + 1:02d}", f"s{j}", c if close is None else 1.0, c, c, float(v), True if tradable is None else bool(tradable[i][j])))
    return spark.createDataFrame(rows, "d string, symbol string, open double, close double, vwap double, fwd_ret double, tradable boolean").selectExpr("cast(d as date) as trading_date", "symbol", "open", "close", "vwap", "fwd_ret", "tradable")


F34 = [[1, 2, 3, 4], [4, 3, 2, 1], [2, 3, 4, 1]]
R34 = [[0.01, 0.02, 0.03, 0.04], [0.04, 0.03, 0.02, 0.01], [0.02, 0.01, 0.03, 0.02]]


def test_small_backtest(spark):
    out = backtest.run(frame(spark, F34), grid(spark, R34), BacktestConfig(quantiles=4))
    assert out.returns.count() == 8 and out.ic.count() == 2
    m = out.metrics.first()
    assert m["ic_mean"] == pytest.approx(1.0)
    got = [r["passive_ret"] for r in out.daily.orderBy("trading_date").collect()]
    assert got == pytest.approx([0.025, 0.025])


def test_passive_leaves_out_untradable(spark):
    p = grid(spark, [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3]], tradable=[[1, 1, 0], [0, 0, 0]])
    assert [r["passive_ret"] for r in backtest.passive(p).orderBy("trading_date").collect()] == pytest.approx([0.15, 0.0])


def test_drift():
    label, close = np.array([[1, 2]] * 3), np.array([[1.0, 1], [1, 1], [2, 1]])
    c = BacktestConfig(quantiles=2, rebalance_freq=2, buy_commission=0, sell_commission=0)
    r = simulate(label, np.full((3, 2), 0.5), np.ones((3, 2), bool), np.ones((3, 2)), close, np.ones((3, 2)), c)
    assert r[0, 0] == pytest.approx(0, abs=0.01) and r[1, 0] == pytest.approx(1.0, abs=0.01)


def plain(label, weight, tradable, open_, close, vwap, c):
    """One group and one name at a time, from the description."""
    days, assets = label.shape
    out = np.zeros((days - 1, c.quantiles))
    for g in range(c.quantiles):
        nv, held = 1.0, np.zeros(assets)
        for d in range(1, days):
            if (d - 1) % c.rebalance_freq == 0:
                pool = [a for a in range(assets) if label[d - 1, a] == g + 1 and tradable[d, a]]
                cash = sum(held[a] * open_[d, a] for a in range(assets) if tradable[d, a] and held[a] != 0)
                cash = nv if cash <= 0 else cash
                if not pool:
                    new = nv if not held.any() and not c.strict_empty else max(float(held @ close[d]), 0.0)
                else:
                    w = {a: weight[d - 1, a] for a in pool if weight[d - 1, a] > 0}
                    total = sum(w.values()) or len(pool)
                    nxt = np.where(tradable[d], 0.0, held)
                    for a in pool:
                        nxt[a] = cash * (w[a] / total if a in w else 1 / len(pool)) / open_[d, a]
                    fee = sum(abs(nxt[a] - held[a]) * vwap[d, a] * (c.buy_fee if nxt[a] > held[a] else c.sell_fee) for a in range(assets))
                    new, held = max(float(nxt @ close[d]) - fee, 0.0), nxt
            else:
                new = max(float(held @ close[d]), 0.0) if held.any() or c.strict_empty else nv
            out[d - 1, g] = new / nv - 1
            nv = new
    return out


@pytest.mark.parametrize("freq", [1, 3])
def test_against_plain(freq):
    rng = np.random.default_rng(freq)
    days, assets = 30, 12
    label, weight = rng.integers(0, 4, (days, assets)), rng.random((days, assets))
    tradable = rng.random((days, assets)) > 0.2
    close = np.cumprod(1 + rng.normal(0, 0.02, (days, assets)), axis=0)
    open_, vwap = close * (1 + rng.normal(0, 0.01, close.shape)), close * (1 + rng.normal(0, 0.005, close.shape))
    c = BacktestConfig(quantiles=3, rebalance_freq=freq)
    np.testing.assert_allclose(simulate(label, weight, tradable, open_, close, vwap, c), plain(label, weight, tradable, open_, close, vwap, c), atol=1e-12)


def test_empty_pool_at_first():
    z, one = np.zeros((3, 2), int), np.ones((3, 2))
    label = np.array([[0, 0], [1, 1], [1, 1]])
    args = (label, one, one > 0, one, one, one)
    assert simulate(*args, BacktestConfig(quantiles=1))[0, 0] == 0
    assert simulate(*args, BacktestConfig(quantiles=1, strict_empty=True))[0, 0] == -1
    assert not z.any()


def test_groups_skip_short_dates_and_ties(spark):
    g = backtest.groups(frame(spark, [[1, None, None, None], [1, 1, 2, 2]]), 2)
    got = [r["label"] for r in g.orderBy("trading_date", "symbol").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 2]


def test_turnovers(spark):
    lab = frame(spark, [[1, 2], [1, 2], [2, 1]]).withColumn("label", __import__("pyspark").sql.functions.col("value").cast("int"))
    assert backtest.label_turnover(lab).first()["turnover"] == pytest.approx(0.5)


def test_metrics_edges(spark):
    s = frame(spark, [[0.1], [-0.5], [None], [0.2]], "ret")
    m = metrics.metrics(s, "ret").first()
    assert m["total_return"] == pytest.approx(1.1 * 0.5 * 1.2 - 1)
    assert m["max_drawdown"] == pytest.approx(0.5)
    flat = metrics.metrics(frame(spark, [[0.0], [0.0]], "ret"), "ret").first()
    assert flat["sharpe"] == 0 and flat["calmar"] is None
    c = [r["cum"] for r in metrics.cumulative(s, "ret").orderBy("trading_date").collect()]
    assert c[:2] == pytest.approx([0.1, -0.45]) and c[2:] == [None, None]


def test_price_grid(spark):
    rows = [("a", "2024-01-01", 1.0, 2.0, 1.0, 2.0, 10.0, 20.0, 1.0), ("a", "2024-01-03", 2.0, 2.0, 2.0, 4.0, 10.0, 20.0, 2.0), ("b", "2024-01-02", 1.0, 1.0, 1.0, 1.0, 0.0, 5.0, 1.0)]
    b = spark.createDataFrame(rows, "symbol string, d string, open double, high double, low double, close double, vol double, amount double, adjust_factor double").selectExpr("*", "cast(d as date) as trading_date")
    g = {(r["symbol"], r["trading_date"].day): r for r in prices.price_grid(b).collect()}
    assert len(g) == 6
    assert g["a", 1]["close"] == 1.0 and g["a", 2]["close"] == 4.0 and g["a", 2]["open"] is None
    assert g["a", 1]["fwd_ret"] == pytest.approx(3.0) and g["a", 3]["fwd_ret"] == 0.0
    assert g["a", 1]["tradable"] and not g["a", 2]["tradable"] and g["b", 2]["vwap"] is None


def test_returns_alone_make_prices(spark):
    g = prices.from_returns(frame(spark, [[0.1], [0.2], [0.0]], "ret"))
    assert [r["close"] for r in g.orderBy("trading_date").collect()] == pytest.approx([1.0, 1.1, 1.32])
