"""Strategies, optimisers, covariances, risk, attribution."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import covariance, optimize, risk, strategies


@pytest.fixture(scope="module")
def two_regimes(spark):
    """100 days, 50 assets, 3 factors: the first leads returns in the calm half, the second in the other, the third never."""
    rng = np.random.default_rng(11)
    days, assets = 100, 50
    calm = np.arange(days)[:, None] < days // 2
    lead, lag, idle = rng.normal(size=(3, days, assets))
    ret = np.where(calm, 0.01 * lead, 0.03 * lag - 0.01 * lead) + rng.normal(0, np.where(calm, 0.004, 0.02), (days, assets))
    date = pd.date_range("2024-01-01", periods=days).repeat(assets).date
    df = pd.DataFrame({"symbol": np.tile(np.arange(assets), days), "trading_date": date, "fwd_ret": ret.ravel(), "f0": lead.ravel(), "f1": lag.ravel(), "f2": idle.ravel()})
    return spark.createDataFrame(df).cache()


NAMES = ["f0", "f1", "f2"]


@pytest.mark.parametrize("tag", sorted(strategies.STRATEGIES))
def test_every_strategy(two_regimes, tag):
    out = strategies.combine(two_regimes, NAMES, {"type": tag})
    assert out.count() == 5000 and out.where("signal is not null").count() > 0


def test_unknown_strategy(two_regimes):
    with pytest.raises(ValueError, match="unknown strategy"):
        strategies.combine(two_regimes, NAMES, {"type": "oracle"})


def test_no_look_ahead(two_regimes):
    """Weights learned on the training dates don't change with what comes later."""
    train = two_regimes.where("trading_date < '2024-03-01'")
    a = strategies.ic_weights(train, NAMES)
    b = strategies.ic_weights(train.where("true"), NAMES)
    np.testing.assert_allclose(a, b)
    assert a.sum() == pytest.approx(1) and (a >= 0).all()


def test_ridge_matches_numpy(two_regimes):
    x = two_regimes.toPandas()
    m = x[NAMES].to_numpy()
    want = np.linalg.solve(m.T @ m + (0.1 + 1e-10) * np.eye(3), m.T @ x["fwd_ret"].to_numpy())
    np.testing.assert_allclose(strategies.ridge_weights(two_regimes, NAMES, 0.1), want, rtol=1e-8)


COV, ALPHA = np.array([[0.04, 0.01], [0.01, 0.09]]), np.array([0.08, 0.12])


def test_solvers():
    np.testing.assert_allclose(optimize.unconstrained(COV, ALPHA, 2.0), np.linalg.inv(COV) @ ALPHA / 2)
    assert optimize.fully_invested(COV, ALPHA, 2.0).sum() == pytest.approx(1)
    rp = optimize.risk_parity(COV)
    parts = risk.component_volatility(rp, COV)
    assert parts.sum() == pytest.approx(np.sqrt(rp @ COV @ rp)) and parts[0] == pytest.approx(parts[1])
    for kind in ("max_sharpe", "min_variance", "turnover_aware", "risk_parity", "max_diversification"):
        w = optimize.optimise_date(kind, ALPHA, COV)
        assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    with pytest.raises(ValueError, match="unknown optimiser"):
        optimize.optimise_date("magic", ALPHA, COV)


def test_constraints():
    n = 6
    cov, alpha = np.eye(n) * 0.04, np.linspace(0.01, 0.06, n)
    c = optimize.Constraints(max_position=0.3, max_assets=5, groups=(optimize.GroupLimit((4, 5), most=0.4),))
    w = optimize.constrained(cov, alpha, 3.0, c)
    assert np.count_nonzero(np.abs(w) > 1e-9) <= 5 and w.sum() == pytest.approx(1)
    neutral = optimize.constrained(cov, alpha, 3.0, optimize.Constraints(long_only=False, market_neutral=True, full_investment=False))
    assert neutral.sum() == pytest.approx(0, abs=1e-6)
    assert optimize.Constraints().feasible(np.array([0.5, 0.6])) == ["full_investment"]
    assert optimize.Constraints(leverage=1.0, long_only=False).feasible(np.array([1.5, -0.5])) == ["leverage"]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("leverage", [None, 1.4])
def test_optimality(seed, leverage):
    """Karush-Kuhn-Tucker: feasible, no slope left, and multipliers only at bounds, with the right sign."""
    rng = np.random.default_rng(seed)
    n = 12
    cov = (f := rng.normal(0, 0.02, (n, 30))) @ f.T / 30 + 1e-5 * np.eye(n)
    gain = rng.normal(0, 0.001, n)
    rows, between = np.vstack([np.ones(n), np.arange(n) < 4, rng.normal(size=n)]), np.array([[1, 1], [0.1, 0.3], [-0.2, 0.2]])
    low = 0.0 if leverage is None else -0.5
    got = optimize.quadratic(cov, gain, low, 0.5, rows, between, leverage=leverage)
    w, tol = got.weights, 1e-6
    assert got.gap < tol and got.slope < 1e-5
    assert (w >= low - tol).all() and (w <= 0.5 + tol).all() and leverage is None or np.abs(w).sum() <= 1.4 + tol
    assert ((rows @ w >= between[:, 0] - tol) & (rows @ w <= between[:, 1] + tol)).all()
    small = 1e-6 * np.diag(cov).mean() + 1e-9
    for m, x, a, z in ((got.box, w, np.full(n, low), np.full(n, 0.5)), (got.rows, rows @ w, *between.T)):
        assert (x[m > small] > z[m > small] - 1e-4).all() and (x[m < -small] < a[m < -small] + 1e-4).all()
    value = lambda x: 0.5 * x @ cov @ x - gain @ x
    for _ in range(200):  # no feasible neighbour is better
        other = w + rng.normal(0, 0.01, n) * (rng.random(n) < 0.4)
        other += (1 - other.sum()) / n
        inside = (other >= low).all() and (other <= 0.5).all() and ((rows @ other >= between[:, 0]) & (rows @ other <= between[:, 1] + 1e-9))[1:].all()
        if inside and (leverage is None or np.abs(other).sum() <= leverage):
            assert value(other) > value(w) - 1e-9


def test_trading_costs():
    """A fee above every slope difference keeps the old weights; none forgets them; between, what moves moves for a reason."""
    rng = np.random.default_rng(3)
    cov, gain, before = np.diag(rng.uniform(0.01, 0.04, 6)), rng.normal(0, 0.01, 6), np.full(6, 1 / 6)
    assert optimize.quadratic(cov, gain, before=before, trade=1.0).weights == pytest.approx(before, abs=1e-6)
    free = optimize.quadratic(cov, gain).weights
    assert optimize.quadratic(cov, gain, before=before, trade=0.0).weights == pytest.approx(free, abs=1e-6)
    some = optimize.quadratic(cov, gain, before=before, trade=0.003)
    moved = np.flatnonzero((np.abs(some.weights - before) > 1e-4) & (some.weights > 1e-4))
    assert len(moved) and some.box[moved] == pytest.approx(0.003 * np.sign(some.weights - before)[moved], abs=1e-6)


@pytest.mark.parametrize("n", [2, 15, 80])
def test_risk_parity_and_diversification(n):
    rng = np.random.default_rng(n)
    cov = np.cov(rng.normal(0, rng.uniform(0.01, 0.05, n), (24, n)).T) + 1e-10 * np.eye(n)
    w = optimize.risk_parity(cov)
    part = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and (w > 0).all() and part == pytest.approx(np.full(n, part.mean()), rel=1e-5)
    ratio = lambda x: x @ np.sqrt(np.diag(cov)) / np.sqrt(x @ cov @ x)
    best = optimize.max_diversification(cov)
    assert best.sum() == pytest.approx(1) and (best > -1e-9).all()
    assert all(ratio(best) >= ratio(x) - 1e-6 for x in rng.dirichlet(np.ones(n), 200))


def test_views_reach_the_weights(spark):
    cov, none = np.diag([0.04, 0.04, 0.04]), np.zeros(3)
    plain = optimize.optimise_date("black_litterman", none, cov, views=optimize.Views(((1, 0, 0),), (0.04,), (1e-9,)))
    sure = optimize.optimise_date("black_litterman", none, cov, views=optimize.Views(((1, 0, 0),), (0.2,), (1e6,)))
    assert plain == pytest.approx(np.full(3, 1 / 3), abs=1e-4) and sure[0] > 0.5


def test_black_litterman():
    pi = optimize.implied_returns(2.5, COV, np.array([0.6, 0.4]))
    sure = optimize.posterior_returns(pi, 0.05, COV, np.array([[1.0, 0.0]]), np.array([0.2]), np.array([[1e9]]))
    none = optimize.posterior_returns(pi, 0.05, COV, np.array([[1.0, 0.0]]), np.array([0.2]), np.array([[1e-12]]))
    assert sure[0] == pytest.approx(0.2, rel=1e-4) and none == pytest.approx(pi, rel=1e-4)


def test_covariances():
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([1, 2, 3, 4.0])
    np.testing.assert_allclose(covariance.sample(x), np.cov(x.T), rtol=1e-10)
    y = x.copy()
    y[:150, 0] = np.nan
    assert covariance.sample(y)[0, 1] == pytest.approx(np.cov(y[150:, 0], y[150:, 1])[0, 1])
    for t in ("identity", "constant_correlation", "single_factor"):
        m, d = covariance.ledoit_wolf(x, t)
        assert 0 <= d <= 1 and (np.linalg.eigvalsh(m) > 0).all()
    assert (np.linalg.eigvalsh(covariance.newey_west(x)) > -1e-9).all()
    assert covariance.ewma(x[:1]) == pytest.approx(np.outer(x[0], x[0]))
    assert np.diag(covariance.factor_model(x, 2)) == pytest.approx(np.diag(np.cov(x.T)), rel=1e-6)


def series(spark, values):
    return spark.createDataFrame([(f"2024-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)], "d string, ret double").selectExpr("cast(d as date) as trading_date", "ret")


def test_risk_figures(spark):
    r = [-0.05, -0.02, 0.01, 0.02, 0.03, -0.01, 0.0, 0.04, 0.05, -0.03]
    s = series(spark, r)
    v = s.agg(risk.var_historical(F.col("ret"), 0.9).alias("v")).first()["v"]
    assert v == pytest.approx(0.03)
    c = risk.cvar_historical(s, level=0.9).first()
    assert c["cvar"] == pytest.approx(0.05)
    assert risk.t_quantile(0.05, 5) == pytest.approx(-2.015048, abs=1e-4)
    assert risk.var_monte_carlo(0, 0.01) == pytest.approx(0.01645, rel=0.03)
    w = risk.worst_drawdown(series(spark, [0.1, -0.2, 0.0, 0.5, -0.1])).first()
    assert w["max_drawdown"] == pytest.approx(0.2) and (w["peak_date"].day, w["trough_date"].day, w["recovery_date"].day) == (1, 2, 4)
    assert risk.rolling(s, 4, 3).count() == 3
    a = risk.analyse(s, level=0.9).first()
    assert a["cvar"] == c["cvar"] and a["var"] == v and a["max_drawdown"] > 0


def test_factor_model(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2024-01-{d + 1:02d}", f"s{a}", x := float(rng.normal()), y := float(rng.normal()), 2 * x - y) for d in range(3) for a in range(8)]
    df = spark.createDataFrame(rows, "d string, symbol string, a double, b double, fwd_ret double").selectExpr("cast(d as date) as trading_date", "symbol", "a", "b", "fwd_ret")
    for r in risk.factor_returns(df, ["a", "b"]).collect() + risk.factor_returns(df, ["a", "b"], huber=1.5).collect():
        assert (r["a"], r["b"], r["r2"]) == pytest.approx((2, -1, 1))
    x = risk.orthogonalise(rng.normal(size=(10, 3)))
    assert abs(x[:, 0] @ x[:, 2]) < 1e-9
    d = risk.decompose(np.array([0.5, 0.5]), np.eye(2), COV, np.array([0.01, 0.01]))
    assert d.total_risk**2 == pytest.approx(d.factor_risk**2 + d.specific_risk**2)


def test_stress_and_attribution(spark):
    s = risk.stress(np.array([1.0]), np.array([[1.0]]), np.array([[0.04]]), np.array([0.0]), ["Beta"], 100.0, "covid_2020")
    assert s["factor_losses"] == {"Beta": pytest.approx(-50.0)} and s["loss"] == pytest.approx(-50 + 100 * np.sqrt(0.1))
    df = spark.createDataFrame([("x", 0.6, 0.5, 0.1, 0.05), ("y", 0.4, 0.5, 0.0, 0.02)], "sector string, wp double, wb double, rp double, rb double")
    b = {r["sector"]: r for r in risk.brinson(df).collect()}
    assert sum(r["allocation"] + r["selection"] + r["interaction"] for r in b.values()) == pytest.approx(0.06 - 0.035)
    f = np.random.default_rng(2).normal(size=(50, 2))
    a = risk.factor_attribution(0.001 + f @ [0.5, -0.2], f)
    assert a["betas"] == pytest.approx([0.5, -0.2]) and a["r2"] == pytest.approx(1)
    assert risk.performance_attribution(np.array([1.0, 1.0]), f, 0.5)["specific"] == pytest.approx(0.5 - f.mean(axis=0).sum())


def test_day_loop(spark, two_regimes):
    few = two_regimes.where("symbol < 4 and trading_date < '2024-01-15'").select("symbol", "trading_date", "fwd_ret", F.col("f0").alias("signal"), F.lit("p").alias("portfolio"))
    out = optimize.optimise(few, "risk_parity", 10).groupBy("trading_date").agg(F.sum("weight").alias("s")).collect()
    assert len(out) == 14 and all(r["s"] == pytest.approx(1) for r in out)
