"""Combining factors into one signal. Factors are columns of a wide frame (symbol, trading_date, fwd_ret, f1, f2, ...).

Row work is column expressions and per-date windows; what a strategy learns is a few numbers a factor, found by
aggregates (moments, correlations) and solved on the driver at the size of the number of factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import to_percentiles, zscore_rows
from .backtest import pearson


def _apply(df: DataFrame, names: list[str], make, out: str) -> DataFrame:  # noqa: ANN001
    """df with a column f"{out}{i}" of each factor through a stepped per-date function."""
    steps, ends, used = [], {}, []
    for i, n in enumerate(names):
        own, end = make(F.col(n), f"_{out}p{i}")
        ends[f"{out}{i}"] = end
        for k, s in enumerate(own):
            while len(steps) <= k:
                steps.append({})
            steps[k] |= s
            used += s
    for s in [*steps, ends]:
        df = df.withColumns(s)
    return df.drop(*used)


def _mean(cols: list[Column]) -> Column:
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def _weighted(cols: list[Column], w: np.ndarray) -> Column:
    """Weighted mean over the factors that are there."""
    top = sum((F.coalesce(c * float(x), F.lit(0.0)) for c, x in zip(cols, w, strict=True)), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), float(x)).otherwise(0.0) for c, x in zip(cols, w, strict=True)), F.lit(0.0))
    return F.when(F.abs(den) > 1e-12, F.try_divide(top, den))


def _select(df: DataFrame, signal: Column) -> DataFrame:
    return df.select("symbol", "trading_date", signal.alias("signal"))


def equal_weight(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean of the factors that are there."""
    return _select(df, _mean([F.col(n) for n in names]))


def rank_average(df: DataFrame, names: list[str], missing_as_zero: bool = False) -> DataFrame:
    """Mean percentile less one half."""
    df = _apply(df, names, to_percentiles, "_r")
    cols = [F.col(f"_r{i}") for i in range(len(names))]
    if missing_as_zero:
        return _select(df, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / len(cols) - 0.5)
    return _select(df, _mean(cols) - 0.5)


def signal_weighted(df: DataFrame, names: list[str], population: bool = False) -> DataFrame:
    """Scores weighted by their own size."""
    from ..functions.crosssection import cs_scale

    df = _apply(df, names, cs_scale if population else zscore_rows, "_z")
    cols = [F.col(f"_z{i}") for i in range(len(names))]
    top = sum((F.coalesce(c * F.abs(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    den = sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return _select(df, F.when(den > 1e-12, F.try_divide(top, den)).when(_mean(cols).isNotNull(), 0.0))


def ic_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(trading_date, one IC column a factor)."""
    return df.groupBy("trading_date").agg(*[pearson(F.col(n), F.col("fwd_ret"), 2, 0.0).alias(n) for n in names])


def ic_weights(df: DataFrame, names: list[str], lookback: int | None = None, ratio: bool = False) -> np.ndarray:
    """Positive parts of mean ICs (or of their ratios to deviation) over the last dates, as shares; uniform if none is."""
    ics = ic_table(df, names)
    if lookback:
        ics = ics.orderBy(F.desc("trading_date")).limit(lookback)
    aggs = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)] + [F.stddev_samp(n).alias(f"s{i}") for i, n in enumerate(names)]
    r = ics.agg(*aggs).first()
    m = np.array([r[f"m{i}"] or 0.0 for i in range(len(names))])
    if ratio:
        s = np.array([r[f"s{i}"] or 0.0 for i in range(len(names))])
        m = np.divide(m, s, out=np.zeros_like(m), where=s > 1e-12)
    m = np.maximum(m, 0.0)
    return m / m.sum() if m.sum() > 1e-12 else np.full(len(names), 1.0 / len(names))


def ic_weighted(df: DataFrame, names: list[str], train: DataFrame | None = None, lookback: int | None = None, ratio: bool = False) -> DataFrame:
    w = ic_weights(train if train is not None else df, names, lookback, ratio)
    df = _apply(df, names, zscore_rows, "_z")
    return _select(df, _weighted([F.col(f"_z{i}") for i in range(len(names))], w))


def moments(df: DataFrame, names: list[str], target: str | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, X'X, X'y) over complete rows in one aggregate."""
    need = [*names, *([target] if target else [])]
    ok = df.where(" and ".join(f"`{n}` is not null" for n in need))
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in pairs]]
    if target:
        aggs += [F.sum(F.col(n) * F.col(target)).alias(f"y{i}") for i, n in enumerate(names)]
    r = ok.agg(*aggs).first()
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = r[f"x{i}_{j}"] or 0.0
    return r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(k)]), xx, np.array([r[f"y{i}"] or 0.0 for i in range(k)]) if target else np.zeros(k)


def varimax(loadings: np.ndarray, rounds: int = 100, tol: float = 1e-8) -> np.ndarray:
    p, k = loadings.shape
    r, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ r
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x @ np.diag((x**2).sum(axis=0)) / p))
        r = u @ v
        if s.sum() - last < tol:
            break
        last = s.sum()
    return loadings @ r


def factor_zoo_compress(df: DataFrame, names: list[str], components: int = 1, rotate: bool = False, train: DataFrame | None = None) -> DataFrame:
    """Principal components of complete rows, weighted by the shares of variance they explain."""
    n, mean, xx, _ = moments(train if train is not None else df, names)
    cov = (xx - n * np.outer(mean, mean)) / max(n - 1, 1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:components]
    load = vec[:, order] * np.sign(vec[np.abs(vec[:, order]).argmax(axis=0), order])
    if rotate and components > 1:
        load = varimax(load)
    share = val[order] / max(val.sum(), 1e-12)
    w = load @ share
    x = [F.col(n_) - float(m) for n_, m in zip(names, mean, strict=True)]
    return _select(df, sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0)))


def ridge_weights(df: DataFrame, names: list[str], alpha: float = 1.0) -> np.ndarray:
    """No intercept."""
    _, _, xx, xy = moments(df, names, "fwd_ret")
    return np.linalg.solve(xx + (alpha + 1e-10) * np.eye(len(names)), xy)


def ridge_combine(df: DataFrame, names: list[str], alpha: float = 1.0, train: DataFrame | None = None) -> DataFrame:
    w = ridge_weights(train if train is not None else df, names, alpha)
    return _select(df, sum((F.col(n) * float(v) for n, v in zip(names, w, strict=True)), F.lit(0.0)))


def market_states(df: DataFrame) -> DataFrame:
    """(trading_date, mean, dispersion, momentum, volatility): four features of the market on each date, from the past only."""
    daily = df.groupBy("trading_date").agg(F.avg("fwd_ret").alias("r"), F.stddev_samp("fwd_ret").alias("d"))
    w = Window.orderBy("trading_date")
    past = daily.withColumn("mean", F.lag("r").over(w)).withColumn("dispersion", F.lag("d").over(w))
    back = w.rowsBetween(-20, -1)
    return past.withColumn("momentum", F.sum("r").over(back)).withColumn("volatility", F.stddev_samp("r").over(back)).select("trading_date", "mean", "dispersion", "momentum", "volatility")


@dataclass
class KMeans:
    centers: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return ((z[:, None, :] - self.centers[None]) ** 2).sum(axis=2).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, seed: int = 0, restarts: int = 10) -> KMeans:
    """Seeded k-means++ on standardised features; the best of the restarts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    z, best = (x - mean) / scale, None
    k = min(k, len(z))
    for _ in range(restarts):
        c = z[rng.integers(len(z))][None]
        while len(c) < k:
            d = ((z[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))]])
        for _ in range(50):
            of = ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([z[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((z - c[of]) ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, c)
    return KMeans(best[1], mean, scale)


def _states(df: DataFrame, k: int, seed: int) -> DataFrame:
    """(trading_date, state): dates are clustered by the features of the first half; one row a date."""
    f = market_states(df).orderBy("trading_date").toPandas()
    x = f[["mean", "dispersion", "momentum", "volatility"]].to_numpy(dtype=float)
    x = np.where(np.isfinite(x), x, 0.0)
    model = kmeans(x[: max(k, len(x) // 2)], k, seed)
    f["state"] = model.of(x)
    return df.sparkSession.createDataFrame(f[["trading_date", "state"]], "trading_date date, state int")


def state_ics(df: DataFrame, names: list[str], states: DataFrame) -> dict[int, np.ndarray]:
    r = ic_table(df, names).join(F.broadcast(states), "trading_date").groupBy("state").agg(*[F.avg(n).alias(n) for n in names]).collect()
    return {x["state"]: np.array([x[n] or 0.0 for n in names]) for x in r}


def state_aware(df: DataFrame, names: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """Weights by the ICs of the date's market state (positive parts; uniform where none is)."""
    states = _states(df, k, seed)
    ics = state_ics(df, names, states)
    df = _apply(df.join(F.broadcast(states), "trading_date"), names, zscore_rows, "_z")
    cols, signal = [F.col(f"_z{i}") for i in range(len(names))], F.lit(None).cast("double")
    for s, ic in sorted(ics.items()):
        w = np.maximum(ic, 0.0)
        w = w / w.sum() if w.sum() > 1e-12 else np.full(len(names), 1.0 / len(names))
        signal = F.when(F.col("state") == s, _weighted(cols, w)).otherwise(signal)
    return _select(df, signal)


def factor_comfort_zone(df: DataFrame, names: list[str], k: int = 3, percentile: float = 0.5, seed: int = 0) -> DataFrame:
    """A factor takes part in the states where its IC reaches its own percentile over states."""
    states = _states(df, k, seed)
    ics = state_ics(df, names, states)
    cut = np.quantile(np.array(list(ics.values())), percentile, axis=0)
    df = _apply(df.join(F.broadcast(states), "trading_date"), names, zscore_rows, "_z")
    cols, signal = [F.col(f"_z{i}") for i in range(len(names))], F.lit(None).cast("double")
    for s, ic in sorted(ics.items()):
        on = (ic >= cut).astype(float)
        signal = F.when(F.col("state") == s, _weighted(cols, on) if on.any() else _mean(cols)).otherwise(signal)
    return _select(df, signal)


#: Tags of strategies in configurations.
STRATEGIES = {
    "equal_weight": equal_weight,
    "rank_average": rank_average,
    "signal_weighted": signal_weighted,
    "ic_weighted": ic_weighted,
    "ic_ir_weighted": lambda df, names, **o: ic_weighted(df, names, ratio=True, **o),
    "factor_zoo_compress": factor_zoo_compress,
    "ridge_combine": ridge_combine,
    "state_aware": state_aware,
    "factor_comfort_zone": factor_comfort_zone,
}


def combine(df: DataFrame, names: list[str], config: dict) -> DataFrame:
    """Run the strategy of a tagged configuration, e.g. {"type": "ridge_combine", "alpha": 0.1}."""
    options = dict(config)
    tag = options.pop("type")
    if tag not in STRATEGIES:
        raise ValueError(f"unknown strategy {tag}")
    return STRATEGIES[tag](df, names, **options)
