"""Risk of portfolios and series: volatility, value at risk, drawdown, factor models, stress, attribution."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(trading_date, ret) of weights (trading_date, symbol, weight) and returns (trading_date, symbol, fwd_ret)."""
    return weights.join(returns, ["trading_date", "symbol"]).groupBy("trading_date").agg(F.sum(F.col("weight") * F.col("fwd_ret")).alias("ret"))


def volatility(ret: Column) -> Column:
    """Annualised sample deviation, an aggregate."""
    return F.stddev_samp(ret) * sqrt(YEAR)


def _sorted(ret: Column) -> Column:
    return F.sort_array(F.collect_list(ret))


def var_historical(ret: Column, level: float = 0.95) -> Column:
    """The loss at the place floor((1 - level) * n) of the sorted returns, an aggregate over one series."""
    place = F.least(F.floor(F.lit(round(1 - level, 12)) * F.count(ret)), F.count(ret) - 1).cast("int")
    return -F.get(_sorted(ret), place)


def var_normal(ret: Column, level: float = 0.95) -> Column:
    return -(F.avg(ret) + F.lit(NormalDist().inv_cdf(1 - level)) * F.stddev_samp(ret))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on its integrated density."""
    c = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * np.pi)

    def cdf(x: float) -> float:
        u = np.linspace(0, abs(x), 4001)
        area = np.trapezoid(c * (1 + u * u / df) ** (-(df + 1) / 2), u)
        return 0.5 + np.sign(x) * area

    lo, hi = -200.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def var_student(ret: Column, level: float = 0.95, df: float = 5.0) -> Column:
    """Scaled so that the t distribution has the sample's deviation."""
    return -(F.avg(ret) + F.lit(t_quantile(1 - level, df) * sqrt((df - 2) / df)) * F.stddev_samp(ret))


def var_monte_carlo(mean: float, deviation: float, level: float = 0.95, draws: int = 100_000, seed: int = 42) -> float:
    r = np.sort(np.random.Generator(np.random.PCG64(seed)).normal(mean, deviation, draws))
    return float(-r[int((1 - level) * draws)])


def cvar_historical(df: DataFrame, ret: str = "ret", level: float = 0.95) -> DataFrame:
    """(var, cvar): the loss and the mean loss strictly beyond it."""
    v = df.agg(var_historical(F.col(ret), level).alias("var"))
    joined = df.join(F.broadcast(v))
    return joined.agg(F.first("var").alias("var"), F.coalesce(-F.avg(F.when(F.col(ret) < -F.col("var"), F.col(ret))), F.first("var")).alias("cvar"))


def cvar_normal(ret: Column, level: float = 0.95) -> Column:
    n = NormalDist()
    z = n.inv_cdf(1 - level)
    return -(F.avg(ret) - F.lit(n.pdf(z) / (1 - level)) * F.stddev_samp(ret))


def drawdowns(df: DataFrame, ret: str = "ret") -> DataFrame:
    """(trading_date, nv, peak, drawdown) of one series, in order."""
    w = Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    nv = df.withColumn("nv", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    peak = nv.withColumn("peak", F.greatest(F.lit(1.0), F.max("nv").over(w)))
    return peak.select("trading_date", "nv", "peak", F.try_divide(F.col("peak") - F.col("nv"), F.col("peak")).alias("drawdown"))


def worst_drawdown(df: DataFrame, ret: str = "ret") -> DataFrame:
    """(max_drawdown, peak_date, trough_date, recovery_date)."""
    d = drawdowns(df, ret)
    t = d.agg(F.max("drawdown").alias("max_drawdown"), F.max_by(F.struct("trading_date", "peak"), F.struct("drawdown", F.datediff(F.lit("9999-01-01"), "trading_date"))).alias("t"))
    j = d.join(F.broadcast(t))
    before = (F.col("nv") >= F.col("t.peak")) & (F.col("trading_date") <= F.col("t.trading_date"))
    after = (F.col("nv") >= F.col("t.peak")) & (F.col("trading_date") > F.col("t.trading_date"))
    return j.agg(F.first("max_drawdown").alias("max_drawdown"), F.max(F.when(before, F.col("trading_date"))).alias("peak_date"), F.first("t.trading_date").alias("trough_date"), F.min(F.when(after, F.col("trading_date"))).alias("recovery_date"))


def analyse(df: DataFrame, ret: str = "ret", level: float = 0.95) -> DataFrame:
    """One row of figures of one series."""
    c = F.col(ret)
    one = df.agg(F.avg(c).alias("mean"), volatility(c).alias("volatility"), var_historical(c, level).alias("var"), var_normal(c, level).alias("var_normal"), var_student(c, level).alias("var_student"), cvar_normal(c, level).alias("cvar_normal"))
    return one.join(F.broadcast(cvar_historical(df, ret, level).select("cvar"))).join(F.broadcast(worst_drawdown(df, ret)))


def component_volatility(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    total = sqrt(max(float(w @ cov @ w), 0.0))
    return w * (cov @ w) / total if total > 1e-15 else np.zeros_like(w)


def rolling(df: DataFrame, window: int, step: int, ret: str = "ret", level: float = 0.95) -> DataFrame:
    """(start, end_date, n, volatility, var, mean): figures of windows of rows of one series."""
    numbered = df.withColumn("_i", F.row_number().over(Window.orderBy("trading_date")) - 1)
    last = F.floor(F.col("_i") / step).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / step)).cast("int")
    each = numbered.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))
    r = F.col(ret)
    return each.groupBy("win").agg(F.min("trading_date").alias("start"), F.max("trading_date").alias("end_date"), F.count(F.lit(1)).alias("n"), volatility(r).alias("volatility"), var_historical(r, level).alias("var"), F.avg(r).alias("mean")).where(F.col("n") == window).drop("win")


# --- factor model ---


def orthogonalise(x: np.ndarray) -> np.ndarray:
    """Gram-Schmidt on columns, in order."""
    out = x.astype(float).copy()
    for j in range(out.shape[1]):
        for k in range(j):
            den = out[:, k] @ out[:, k]
            if den > 1e-15:
                out[:, j] -= (out[:, k] @ out[:, j]) / den * out[:, k]
    return out


def regress(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, huber: float | None = None) -> np.ndarray:
    """Least squares with a ridge of 1e-10; weighted, or reweighted for outliers beyond huber robust deviations."""
    w = np.ones(len(y)) if weights is None else weights
    beta = np.zeros(x.shape[1])
    for _ in range(1 if huber is None else 20):
        a, b = (x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), (x * w[:, None]).T @ y
        try:
            new = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if huber is not None:
            e = y - x @ new
            s = max(np.median(np.abs(e - np.median(e))) * 1.4826, 1e-12)
            w = (np.ones(len(y)) if weights is None else weights) * np.minimum(1.0, huber * s / np.maximum(np.abs(e), 1e-300))
            if np.allclose(new, beta, atol=1e-10):
                break
        beta = new
    return beta


def factor_returns(df: DataFrame, exposures: list[str], ret: str = "fwd_ret", weight: str | None = None, huber: float | None = None, orthogonal: bool = False) -> DataFrame:
    """(trading_date, one return a factor, r2, n): cross-sectional regressions, a date at a time; dates with too few rows are left out."""
    cols = [*exposures, ret, *([weight] if weight else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[cols].to_numpy(dtype=float, na_value=np.nan)
        a = a[np.isfinite(a).all(axis=1)]
        k = len(exposures)
        if len(a) < k + 2:
            return pd.DataFrame({"trading_date": [], **{e: [] for e in exposures}, "r2": [], "n": []})
        x, y = a[:, :k], a[:, k]
        x = orthogonalise(x) if orthogonal else x
        b = regress(x, y, a[:, k + 1] if weight else None, huber)
        rest, total = ((y - x @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({"trading_date": [pdf["trading_date"].iloc[0]], **{e: [v] for e, v in zip(exposures, b, strict=True)}, "r2": [1 - rest / total if total > 1e-15 else 0.0], "n": [len(y)]})

    schema = "trading_date date, " + ", ".join(f"`{e}` double" for e in exposures) + ", r2 double, n long"
    return df.select("trading_date", *cols).groupBy("trading_date").applyInPandas(run, schema)


@dataclass
class Decomposition:
    factor_risk: float
    specific_risk: float
    total_risk: float
    contributions: np.ndarray


def decompose(weights: np.ndarray, exposures: np.ndarray, factor_cov: np.ndarray, specific_var: np.ndarray) -> Decomposition:
    """Risk of a portfolio by factors and the rest."""
    e = exposures.T @ weights
    f, s = float(e @ factor_cov @ e), float((weights**2 * specific_var).sum())
    total = sqrt(max(f + s, 0.0))
    return Decomposition(sqrt(max(f, 0.0)), sqrt(max(s, 0.0)), total, e * (factor_cov @ e) / total if total > 1e-15 else 0 * e)


# --- stress ---

#: Named scenarios (shocks in factor deviations; multipliers of variances and of cross terms).
SCENARIOS = {
    "gfc_2008": {"shocks": {"Beta": -3.0, "Momentum": -2.0}, "volatility": 3.0, "correlation": 2.0},
    "china_2015": {"shocks": {"Beta": -2.0, "Momentum": -1.0, "Liquidity": -3.0}, "volatility": 2.0, "correlation": 1.0},
    "covid_2020": {"shocks": {"Beta": -2.5}, "volatility": 2.5, "correlation": 1.0},
}


def stress(weights: np.ndarray, exposures: np.ndarray, factor_cov: np.ndarray, specific_var: np.ndarray, names: list[str], nav: float, scenario: str | dict) -> dict:
    """A portfolio under a scenario: loss by factor, one stressed deviation on top, and the value after both.

    Both are signed changes of value that are added; the deviation enters as it is, so it offsets shocks.
    """
    s = SCENARIOS[scenario] if isinstance(scenario, str) else scenario
    e = exposures.T @ weights
    mult = np.where(np.eye(len(e), dtype=bool), 1.0, s["correlation"]) * s["volatility"]
    own = np.where(np.isfinite(specific_var) & (specific_var > 0), specific_var, 0.0)
    vol = sqrt(max(float(e @ (factor_cov * mult) @ e) + s["volatility"] * float((weights**2 * own).sum()), 0.0))
    losses = {n: float(e[i] * s["shocks"][n] * sqrt(factor_cov[i, i]) * nav) for i, n in enumerate(names) if s["shocks"].get(n)}
    total = sum(losses.values()) + vol * nav
    return {"stressed_volatility": vol, "factor_losses": losses, "loss": total, "nav": max(nav + total, 0.0), "loss_share": total / nav if nav > 0 else 0.0}


# --- attribution ---


def brinson(df: DataFrame, against_total: bool = True) -> DataFrame:
    """(sector, allocation, selection, interaction) of rows (sector, wp, wb, rp, rb): portfolio and benchmark weights and returns of assets."""
    s = df.groupBy("sector").agg(F.sum("wp").alias("wp"), F.sum("wb").alias("wb"), F.sum(F.col("wp") * F.col("rp")).alias("_p"), F.sum(F.col("wb") * F.col("rb")).alias("_b"))
    s = s.withColumn("rp", F.coalesce(F.try_divide(F.col("_p"), F.col("wp")), F.lit(0.0))).withColumn("rb", F.coalesce(F.try_divide(F.col("_b"), F.col("wb")), F.lit(0.0)))
    total = s.agg(F.sum("_b").alias("_rb"))
    base = F.col("_rb") if against_total else F.lit(0.0)
    out = s.join(F.broadcast(total))
    return out.select("sector", ((F.col("wp") - F.col("wb")) * (F.col("rb") - base)).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))


def factor_attribution(returns: np.ndarray, factors: np.ndarray) -> dict:
    """OLS of a return series on factor series: betas, mean contributions, alpha, r2."""
    x = np.column_stack([np.ones(len(returns)), factors])
    b = np.linalg.lstsq(x, returns, rcond=None)[0]
    rest, total = ((returns - x @ b) ** 2).sum(), ((returns - returns.mean()) ** 2).sum()
    return {"alpha": float(b[0]), "betas": b[1:], "contributions": b[1:] * factors.mean(axis=0), "r2": float(1 - rest / total) if total > 1e-15 else 0.0}


def performance_attribution(exposures: np.ndarray, factor_returns_: np.ndarray, total_return: float) -> dict:
    """Exposure times mean factor return, and what is left."""
    part = exposures * factor_returns_.mean(axis=0)
    return {"contributions": part, "specific": total_return - float(part.sum())}


def ic_statistics(joined: DataFrame, value: str = "value", ret: str = "fwd_ret", lags: int = 4) -> DataFrame:
    """(factor, rank_ic_mean, rank_ic_ir, ic_mean, ic_ir, t_stat, positive_ratio, autocorr_1 ..): Spearman by average ranks of complete pairs."""
    from ..functions.crosssection import rank0
    from .backtest import pearson

    ok = joined.where(F.col(value).isNotNull() & F.col(ret).isNotNull())
    ranked = ok.withColumn("_a", rank0(F.col(value), "factor")).withColumn("_b", rank0(F.col(ret), "factor"))
    daily = ranked.groupBy("factor", "trading_date").agg(pearson(F.col("_a"), F.col("_b"), 3).alias("ric"), pearson(F.col(value), F.col(ret), 3).alias("ic"))
    w = Window.partitionBy("factor").orderBy("trading_date")
    lagged = daily.where("ric is not null").withColumns({f"_l{k}": F.lag("ric", k).over(w) for k in range(1, lags + 1)})
    ir = lambda c: F.when(F.stddev_samp(c) > 0, F.try_divide(F.avg(c), F.stddev_samp(c)))
    return lagged.groupBy("factor").agg(
        F.avg("ric").alias("rank_ic_mean"), ir("ric").alias("rank_ic_ir"), F.avg("ic").alias("ic_mean"), ir("ic").alias("ic_ir"),
        (ir("ric") * F.sqrt(F.count("ric"))).alias("t_stat"), F.avg((F.col("ric") > 0).cast("double")).alias("positive_ratio"),
        *[pearson(F.col("ric"), F.col(f"_l{k}"), 3).alias(f"autocorr_{k}") for k in range(1, lags + 1)],
    )
