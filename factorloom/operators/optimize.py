"""Portfolio weights: simple rules as window expressions, optimisers as numpy on one date's covariance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .covariance import ESTIMATORS


@dataclass(frozen=True)
class GroupLimit:
    members: tuple[int, ...]
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class ExposureLimit:
    exposures: tuple[float, ...]
    target: float = 0.0
    tolerance: float = 0.05


@dataclass(frozen=True)
class Constraints:
    long_only: bool = True
    full_investment: bool = True
    market_neutral: bool = False
    min_position: float | None = None
    max_position: float | None = None
    max_assets: int | None = None
    leverage: float | None = None
    turnover_limit: float | None = None
    groups: tuple[GroupLimit, ...] = field(default=())
    exposures: tuple[ExposureLimit, ...] = field(default=())

    def feasible(self, w: np.ndarray, before: np.ndarray | None = None, tol: float = 1e-6) -> list[str]:
        """What weights violate."""
        out = []
        if self.long_only and (w < -tol).any():
            out.append("long_only")
        if self.full_investment and not self.market_neutral and abs(w.sum() - 1) > tol:
            out.append("full_investment")
        if self.market_neutral and abs(w.sum()) > tol:
            out.append("market_neutral")
        held = w[np.abs(w) > tol]
        if self.max_position is not None and (held > self.max_position + tol).any():
            out.append("max_position")
        if self.min_position is not None and (np.abs(held) < self.min_position - tol).any():
            out.append("min_position")
        if self.max_assets is not None and len(held) > self.max_assets:
            out.append("max_assets")
        if self.leverage is not None and np.abs(w).sum() > self.leverage + tol:
            out.append("leverage")
        if self.turnover_limit is not None and before is not None and np.abs(w - before).sum() > self.turnover_limit + tol:
            out.append("turnover")
        for g in self.groups:
            s = w[list(g.members)].sum()
            if g.most is not None and s > g.most + tol or g.least is not None and s < g.least - tol:
                out.append("group")
        for e in self.exposures:
            if abs(np.dot(e.exposures, w) - e.target) > e.tolerance + tol:
                out.append("exposure")
        return out


# --- rules that are window expressions over (trading_date, symbol, signal) ---


def top_k(df: DataFrame, k: int = 100, market_neutral: bool = False) -> DataFrame:
    """1/K on the K largest signals of a date; or equal long and short halves."""
    order = Window.partitionBy("trading_date").orderBy(F.col("signal").desc_nulls_last(), "symbol")
    back = Window.partitionBy("trading_date").orderBy(F.col("signal").asc_nulls_last(), "symbol")
    n = F.count("signal").over(Window.partitionBy("trading_date"))
    if market_neutral:
        half = max(1, k // 2)
        w = F.when(F.row_number().over(order) <= half, 1.0 / half).when(F.row_number().over(back) <= half, -1.0 / half).otherwise(0.0)
    else:
        w = F.when(F.row_number().over(order) <= F.least(F.lit(k), n), 1.0 / F.least(F.lit(k), n)).otherwise(0.0)
    return df.withColumn("weight", F.when(F.col("signal").isNotNull(), w).otherwise(0.0))


def signal_proportional(df: DataFrame) -> DataFrame:
    """Shares of the positive signals; missing on dates without one."""
    s = F.greatest(F.col("signal"), F.lit(0.0))
    return df.withColumn("weight", F.try_divide(F.when(F.col("signal").isNotNull(), s).otherwise(0.0), F.sum(s).over(Window.partitionBy("trading_date"))))


def inverse_volatility(df: DataFrame, lookback: int = 60, ret: str = "fwd_ret") -> DataFrame:
    """Shares of 1/deviation over the rows before, the current return left out."""
    past = Window.partitionBy("symbol").orderBy("trading_date").rowsBetween(-lookback, -1)
    df = df.withColumn("_v", F.stddev_samp(ret).over(past))
    inv = F.when(F.col("_v") > 1e-12, 1.0 / F.col("_v"))
    return df.withColumn("_i", inv).withColumn("weight", F.coalesce(F.try_divide(F.col("_i"), F.sum("_i").over(Window.partitionBy("trading_date"))), F.lit(0.0))).drop("_v", "_i")


# --- alpha mappings: per-date expressions over `signal` ---


def map_alpha(df: DataFrame, kind: str, scale: float = 1.0, bins: int = 5, cut: float = 3.0, power: float = 0.5) -> DataFrame:
    """df with alpha: linear, rank (-0.5 .. 0.5), quantile (-1 .. 1 by bin), zscore (clipped), boxcox of the size with the sign kept."""
    from ..functions.crosssection import rank0

    w, s = Window.partitionBy("trading_date"), F.col("signal")
    n = F.count(s).over(w)
    if kind == "linear":
        alpha: Column = s * scale
    elif kind == "rank":
        alpha = F.when(n > 1, (F.try_divide(rank0(s), n - 1) - 0.5) * scale)
    elif kind == "quantile":
        b = F.least(F.floor(rank0(s) * bins / n), F.lit(bins - 1))
        alpha = F.when(s.isNotNull(), (b / F.lit(max(bins - 1, 1)) * 2 - 1) * scale)
    elif kind == "zscore":
        z = F.try_divide(s - F.avg(s).over(w), F.stddev_samp(s).over(w))
        alpha = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(cut)), F.lit(-cut))) * scale
    elif kind == "boxcox":
        size = F.abs(s)
        alpha = F.signum(s) * (F.ln(1 + size) if abs(power) < 1e-12 else (F.pow(1 + size, F.lit(power)) - 1) / power) * scale
    else:
        raise ValueError(f"unknown mapping {kind}")
    return df.withColumn("alpha", alpha)


# --- costs: expressions over `trade` (a change of weight) and `volume` ---


def cost(kind: str, trade: Column, volume: Column | None = None, rate: float = 0.001, eta: float = 0.1) -> Column:
    """none, linear rate*|d|, impact eta*sqrt(|d|/v)*|d|, or composite of both."""
    d = F.abs(trade)
    impact = lambda: F.when(volume > 0, eta * F.sqrt(d / volume) * d).otherwise(0.0)
    table: dict[str, Callable[[], Column]] = {"none": lambda: F.lit(0.0), "linear": lambda: rate * d, "quadratic": impact, "composite": lambda: rate * d + impact()}
    if kind not in table:
        raise ValueError(f"unknown cost {kind}")
    return table[kind]()


def cost_gradient(kind: str, trade: np.ndarray, volume: np.ndarray, rate: float = 0.001, eta: float = 0.1) -> np.ndarray:
    lin = rate * np.sign(trade)
    imp = 1.5 * eta * np.sqrt(np.abs(trade) / np.maximum(volume, 1e-300)) * np.sign(trade)
    return {"none": 0 * trade, "linear": lin, "quadratic": imp, "composite": lin + imp}[kind]


# --- solvers ---


def unconstrained(cov: np.ndarray, alpha: np.ndarray, aversion: float) -> np.ndarray:
    return np.linalg.solve(cov, alpha / aversion)


def fully_invested(cov: np.ndarray, alpha: np.ndarray, aversion: float) -> np.ndarray:
    """The stationary point under weights that sum to 1."""
    x, y = np.linalg.solve(cov, alpha / aversion), np.linalg.solve(cov, np.ones(len(alpha)))
    if abs(y.sum()) < 1e-12:
        raise ValueError("the system is singular")
    return x - (x.sum() - 1) / y.sum() * y


def onto_l1_ball(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point whose absolute values sum to radius at most."""
    if np.abs(v).sum() <= radius:
        return v
    u = np.sort(np.abs(v))[::-1]
    excess = (np.cumsum(u) - radius) / np.arange(1, len(u) + 1)
    cut = excess[np.flatnonzero(u > excess)[-1]]
    return np.sign(v) * np.maximum(np.abs(v) - cut, 0.0)


@dataclass
class Solution:
    weights: np.ndarray
    gap: float  # how far constraints are missed
    slope: float  # norm of what the multipliers leave of the gradient
    box: np.ndarray  # multipliers: of the box (and of trading), of the rows, of the leverage
    rows: np.ndarray
    ball: np.ndarray


def quadratic(cov: np.ndarray, gain: np.ndarray, low: float = 0.0, high: float = np.inf, rows: np.ndarray | None = None, between: np.ndarray | None = None, before: np.ndarray | None = None, trade: float = 0.0, leverage: float | None = None, tol: float = 1e-9, rounds: int = 10_000) -> Solution:
    """min 1/2 w'cov w - gain'w + trade |w - before|_1, with low <= w <= high, rows w inside `between`, and |w|_1 <= leverage.

    Alternating directions: one linear system that is factored once for a step size, and exact projections of the three
    copies of w (box and trading; rows; leverage). Everything is convex, so what it converges to is the optimum.
    """
    n = len(gain)
    b = np.ones((1, n)) if rows is None else rows
    span = np.ones((len(b), 2)) if between is None else between
    size = np.linalg.norm(b, axis=1)
    b, span = b / size[:, None], span / size[:, None]
    scale = max(float(np.mean(np.diag(cov))), float(np.abs(gain).max(initial=0.0)), 1e-12)
    q, g, fee = cov / scale, gain / scale, trade / scale
    copies = 1 + (leverage is not None)
    rho, firm = 1.0, 100.0  # rows are held more firmly
    # duals are scaled: u = multiplier / step
    w = np.full(n, 1.0 / n) if before is None else before.astype(float)
    x, ux, y, uy, v, uv = w.copy(), np.zeros(n), b @ w, np.zeros(len(b)), w.copy(), np.zeros(n)
    system = None
    for k in range(rounds):
        if system is None:
            system = np.linalg.inv(q + rho * (copies * np.eye(n) + firm * b.T @ b))
        pull = (x - ux) + firm * b.T @ (y - uy) + ((v - uv) if leverage is not None else 0.0)
        w = system @ (g + rho * pull)
        old = (x, y, v)
        t = w + ux
        if before is not None and fee:
            t = before + np.sign(t - before) * np.maximum(np.abs(t - before) - fee / rho, 0.0)
        x = np.clip(t, low, high)
        y = np.clip(b @ w + uy, span[:, 0], span[:, 1])
        ux, uy = ux + w - x, uy + b @ w - y
        missed = max(np.abs(w - x).max(), np.abs(b @ w - y).max())
        moved = np.abs(x - old[0] + firm * b.T @ (y - old[1])).max()
        if leverage is not None:
            v = onto_l1_ball(w + uv, leverage)
            uv = uv + w - v
            missed, moved = max(missed, np.abs(w - v).max()), max(moved, np.abs(v - old[2]).max())
        if missed < tol and rho * moved < tol:
            break
        if k % 50 == 49 and not 0.2 < (ratio := np.sqrt((missed + 1e-15) / (rho * moved + 1e-15))) < 5.0:  # keep both residuals alike
            step = float(np.clip(ratio, 0.1, 10.0))
            rho, ux, uy, uv, system = rho * step, ux / step, uy / step, uv / step, None
    box, row, ball = rho * ux * scale, rho * firm * uy * scale / size, rho * uv * scale if leverage is not None else np.zeros(n)
    slope = cov @ w - gain + box + (b * size[:, None]).T @ row + ball
    return Solution(x, float(missed), float(np.abs(slope).max() / scale), box, row, ball)


def constrained(cov: np.ndarray, alpha: np.ndarray, aversion: float, c: Constraints, before: np.ndarray | None = None, penalty: float | None = None) -> np.ndarray:
    """The weights of best utility alpha'w / aversion - 1/2 w'cov w - penalty |w - before|_1 under all constraints.

    All are convex but max_assets and min_position: of the solution without these, the largest assets (that reach the
    least position) are kept, and the problem is solved again on them with the least position as their bound.
    """
    n = len(alpha)
    high = np.inf if c.max_position is None else max(c.max_position, 0.0 if c.market_neutral else 1.0 / n)
    low = 0.0 if c.long_only else -high
    rows, between = [], []
    if c.market_neutral or c.full_investment:
        rows.append(np.ones(n))
        between.append([0.0, 0.0] if c.market_neutral else [1.0, 1.0])
    for limit in c.groups:
        rows.append(np.isin(np.arange(n), limit.members).astype(float))
        between.append([-np.inf if limit.least is None else limit.least, np.inf if limit.most is None else limit.most])
    for e in c.exposures:
        rows.append(np.asarray(e.exposures, float))
        between.append([e.target - e.tolerance, e.target + e.tolerance])

    def solve(own: np.ndarray, floor: float) -> np.ndarray:
        w, some = np.zeros(n), np.array(rows).reshape(-1, n)[:, own]
        full = some.any(axis=1)
        lines, bounds = (some[full], np.array(between)[full]) if full.any() else (np.zeros((1, len(own))) + 1.0, np.array([[-np.inf, np.inf]]))
        room = max(high, 1.0 / len(own)) if np.isfinite(high) and not c.market_neutral else high
        w[own] = quadratic(cov[np.ix_(own, own)], alpha[own] / aversion, max(low, floor), room, lines, bounds, None if before is None else before[own], penalty or 0.0, c.leverage).weights
        return w

    w = solve(np.arange(n), low)
    keep = np.argsort(-np.abs(w), kind="stable")[: c.max_assets or n]
    if c.min_position is not None:
        keep = keep[np.abs(w[keep]) >= c.min_position]
    if len(keep) < n and len(keep) and (c.max_assets is not None or c.min_position is not None):
        w = solve(np.sort(keep), c.min_position if c.min_position is not None and c.long_only else low)
    return w


def risk_parity(cov: np.ndarray, rounds: int = 200, tol: float = 1e-12) -> np.ndarray:
    """Long-only weights whose risk contributions w_i (cov w)_i are all equal.

    These are, up to their sum, the minimum of the strictly convex 1/2 y'C y - mean(log y) over volatility-scaled
    weights y with correlations C, found by Newton's method with step halving.
    """
    n = len(cov)
    if n < 2:
        raise ValueError("risk parity takes two assets at least")
    vol = np.sqrt(np.diag(cov))
    c = cov / np.outer(vol, vol)
    value = lambda y: 0.5 * y @ c @ y - np.log(y).mean()
    y = np.full(n, 1.0 / np.sqrt(max(c.sum(), 1e-12)))
    for _ in range(rounds):
        slope = c @ y - 1.0 / (n * y)
        move = np.linalg.solve(c + np.diag(1.0 / (n * y * y)), -slope)
        fall = -slope @ move
        if fall < tol:
            break
        step = 1.0
        while (y + step * move <= 0).any() or value(y + step * move) > value(y) - 0.25 * step * fall:
            step /= 2
            if step < 1e-12:
                break
        y = np.maximum(y + step * move, 1e-300)
    w = y / vol
    return w / w.sum()


def max_diversification(cov: np.ndarray, long_only: bool = True) -> np.ndarray:
    """The highest ratio of mean volatility to portfolio volatility: minimum variance on correlations, scaled back."""
    vol = np.sqrt(np.diag(cov))
    c, one = cov / np.outer(vol, vol), np.zeros(len(cov))
    y = quadratic(c, one).weights if long_only else np.linalg.solve(c, one + 1.0)
    w = y / vol
    return w / w.sum()


def implied_returns(aversion: float, cov: np.ndarray, market: np.ndarray) -> np.ndarray:
    return aversion * cov @ market


def posterior_returns(implied: np.ndarray, tau: float, cov: np.ndarray, pick: np.ndarray, views: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Black-Litterman mean from implied returns and views with the given precision."""
    prior = np.linalg.inv(cov) / tau
    return np.linalg.solve(prior + pick.T @ precision @ pick, prior @ implied + pick.T @ precision @ views)


@dataclass(frozen=True)
class Views:
    """Views on returns: pick @ returns is views, with this precision; market: weights that the market holds (equal ones, if None)."""

    pick: tuple[tuple[float, ...], ...]
    views: tuple[float, ...]
    precision: tuple[float, ...]
    tau: float = 0.05
    market: tuple[float, ...] | None = None

    def returns(self, cov: np.ndarray, aversion: float) -> np.ndarray:
        market = np.full(len(cov), 1.0 / len(cov)) if self.market is None else np.asarray(self.market)
        return posterior_returns(implied_returns(aversion, cov, market), self.tau, cov, np.asarray(self.pick), np.asarray(self.views), np.diag(self.precision))


def optimise_date(kind: str, signal: np.ndarray, cov: np.ndarray, before: np.ndarray | None = None, c: Constraints | None = None, with_cost: bool = False, aversion: float = 3.0, views: Views | None = None) -> np.ndarray:
    """Weights of one date. With a cost model the turnover penalty is 0.001, else the turnover limit serves as the penalty."""
    c = c or Constraints()
    penalty = 0.001 if with_cost else c.turnover_limit
    if kind == "black_litterman" and views is not None:
        signal = views.returns(cov, aversion)
    if kind in ("max_sharpe", "max_ir", "black_litterman"):
        return constrained(cov, signal, aversion, c, before, penalty)
    if kind == "min_variance":
        none = np.zeros(len(cov))
        if c.long_only:
            return quadratic(cov, none).weights
        return fully_invested(cov, none, 1.0) if c.full_investment else unconstrained(cov, none, 1.0)
    if kind == "turnover_aware":
        return quadratic(cov, signal / aversion, before=before, trade=0.1).weights
    if kind == "risk_parity":
        return risk_parity(cov)
    if kind == "max_diversification":
        return max_diversification(cov, c.long_only)
    raise ValueError(f"unknown optimiser {kind}")


def optimise(df: DataFrame, kind: str, lookback: int = 60, constraints: Constraints | None = None, estimator: str = "sample", with_cost: bool = False, look_ahead: bool = False, views: Views | None = None) -> DataFrame:
    """(portfolio, trading_date, symbol, weight) of a frame (portfolio, trading_date, symbol, signal, fwd_ret).

    Dates depend on the weights before, so a portfolio is one ordered pass; portfolios run beside each other. The
    covariance window ends the day before (look_ahead: with the day's own forward return). views: for black_litterman,
    in the order of the portfolio's symbols.
    """
    c = constraints or Constraints()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = pdf.pivot_table(index="trading_date", columns="symbol", values="signal", dropna=False)
        ret = pdf.pivot_table(index="trading_date", columns="symbol", values="fwd_ret", dropna=False).reindex(index=sig.index, columns=sig.columns)
        s, r, out, before = sig.to_numpy(float), ret.to_numpy(float), [], None
        for day in range(len(s)):
            past = r[max(0, day - lookback) : day + look_ahead]
            cov = ESTIMATORS[estimator](past) if len(past) >= 2 else np.eye(s.shape[1])
            cov = np.where(np.isfinite(cov), cov, 0.0) + 1e-10 * np.eye(len(cov))
            before = optimise_date(kind, np.where(np.isfinite(s[day]), s[day], 0.0), cov, before, c, with_cost, views=views)
            out.append(before)
        n = s.shape[1]
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], "trading_date": np.repeat(np.asarray(sig.index), n), "symbol": np.tile(np.asarray(sig.columns), len(s)), "weight": np.concatenate(out)})

    kind_of = df.schema["symbol"].dataType.simpleString()
    return df.groupBy("portfolio").applyInPandas(run, f"portfolio string, trading_date date, symbol {kind_of}, weight double")
