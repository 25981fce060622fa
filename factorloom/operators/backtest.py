"""Quantile backtests: groups, weights, net asset values, returns, information coefficients.

Panels are long (factor, trading_date, symbol, value). Everything but the net asset value, which depends on its own
past, is window and aggregate expressions; that one is a grouped pass over one factor's panel at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import rank0


@dataclass(frozen=True)
class BacktestConfig:
    """Fixed defaults: ten groups, daily rebalancing, fees of 5 and 15 and slippage of 10 basis points a side."""

    quantiles: int = 10
    rebalance_freq: int = 1
    long_top_n: int = 1
    short_top_n: int = 1
    weight_method: str = "equal"  # or "weighted"
    buy_commission: float = 0.0005
    sell_commission: float = 0.0015
    buy_slippage: float = 0.001
    sell_slippage: float = 0.001
    long_ratio: float = 1.0
    short_ratio: float = 1.0
    strict_empty: bool = False  # an empty pool before the first purchase is worth nothing, instead of the cash

    @property
    def buy_fee(self) -> float:
        return self.buy_commission + self.buy_slippage

    @property
    def sell_fee(self) -> float:
        return self.sell_commission + self.sell_slippage


def groups(panel: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """panel with `label`: 1 .. bins by average-tie rank, 0 for missing values and on dates with fewer than bins values."""
    v = F.col(value)
    n = F.count(v).over(Window.partitionBy("trading_date", "factor"))
    label = F.floor(rank0(v, "factor") * bins / n) + 1
    return panel.withColumn("label", F.when(v.isNotNull() & (n >= bins), F.least(label, F.lit(bins))).otherwise(0).cast("int"))


def weights(labelled: DataFrame, bins: int, method: str = "equal", value: str = "value") -> DataFrame:
    """labelled with `weight`: shares of 1/bins, equal within a group or by value (0 where the group's values sum to 0)."""
    w = Window.partitionBy("trading_date", "factor", "label")
    if method == "equal":
        weight = 1.0 / bins / F.count(F.lit(1)).over(w)
    else:
        total = F.sum(value).over(w)
        weight = F.when(total != 0, F.try_divide(F.col(value), total)).otherwise(0.0)
    return labelled.withColumn("weight", F.when(F.col("label") > 0, weight).otherwise(0.0))


def from_quantiles(panel: DataFrame, bins: int, qcut: str = "qcut") -> DataFrame:
    """panel with `label` from a quantile column that starts at 0."""
    return panel.withColumn("label", F.coalesce(F.least(F.col(qcut) + 1, F.lit(bins)), F.lit(0)).cast("int"))


def simulate(label: np.ndarray, weight: np.ndarray, tradable: np.ndarray, open_: np.ndarray, close: np.ndarray, vwap: np.ndarray, config: BacktestConfig) -> np.ndarray:
    """Group returns (days - 1, groups) of day x asset matrices; all groups advance together.

    Labels and weights of a day are traded at the next day's open. On rebalancing days the value of tradable holdings
    is spread over the pool, holdings that can't be traded stay, fees reduce the reported value but not the shares.
    """
    days, assets = label.shape
    g = np.arange(1, config.quantiles + 1)[:, None]
    shares, nv = np.zeros((config.quantiles, assets)), np.ones(config.quantiles)
    out = np.zeros((days - 1, config.quantiles))
    value = np.where(np.isfinite(close), close, 0.0)
    for day in range(1, days):
        if (day - 1) % config.rebalance_freq:
            now = np.maximum((np.maximum(shares, 0.0) * value[day]).sum(axis=1), 0.0)
            if not config.strict_empty:
                now = np.where((shares != 0).any(axis=1), now, nv)
        else:
            can = tradable[day]
            pool = (label[day - 1] == g) & can
            count = pool.sum(axis=1)
            cash = (np.where(can & (shares != 0), shares, 0.0) * np.where(can, open_[day], 0.0)).sum(axis=1)
            cash = np.where(cash <= 0, nv, cash)
            w = np.where(np.isfinite(weight[day - 1]) & (weight[day - 1] > 0), weight[day - 1], 0.0)
            total = (w * pool).sum(axis=1)
            total = np.where(total == 0, count, total)
            with np.errstate(divide="ignore", invalid="ignore"):
                alloc = np.where(w > 0, w / total[:, None], 1.0 / count[:, None]) * cash[:, None]
                bought = np.where(np.isfinite(open_[day]) & (open_[day] > 0), alloc / open_[day], 0.0)
            new = np.where(pool, bought, np.where(can, 0.0, shares))
            delta = new - shares
            price = np.where(np.isfinite(vwap[day]) & (vwap[day] > 0), vwap[day], 0.0)
            rate = np.where(delta > 0, config.buy_fee, config.sell_fee)
            fee = (np.where(np.abs(delta) > 1e-15, np.abs(delta), 0.0) * rate * price).sum(axis=1)
            empty = count == 0
            new[empty] = shares[empty]
            now = np.maximum((new * value[day]).sum(axis=1) - np.where(empty, 0.0, fee), 0.0)
            if not config.strict_empty:
                now = np.where(empty & ~(shares != 0).any(axis=1), nv, now)
            shares = new
        with np.errstate(divide="ignore", invalid="ignore"):
            out[day - 1] = now / nv - 1.0
        nv = now
    return out


def group_returns(weighted: DataFrame, prices: DataFrame, config: BacktestConfig) -> DataFrame:
    """(factor, trading_date, grp, ret): returns of each group from the second date on.

    The value of a group depends on its own past, so one grouped pass a factor takes the whole grid (a name may be held
    through days without a label). The rows of a date are gathered into one first, prices once for all factors, so what
    is sorted and shuffled by factor is a row a date; it becomes date x symbol matrices of about 50 bytes a cell. Factors run
    beside each other.
    """
    day = F.unix_date("trading_date").alias("day")
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    sent, told = ("open", "close", "vwap", "tradable"), ("label", "weight")
    grid = prices.select(day, "symbol", *number(*sent)).groupBy("day").agg(F.collect_list(F.struct("symbol", *sent)).alias("grid"))
    marks = weighted.where("label > 0").select("factor", day, "symbol", *number(*told)).groupBy("factor", "day").agg(F.collect_list(F.struct("symbol", *told)).alias("marks"))
    factors = weighted.select("factor").distinct()
    none = lambda of: F.lit(None).cast(of.dtypes[-1][1]).alias(of.columns[-1])
    rows = grid.join(F.broadcast(factors)).select("factor", "day", "grid", none(marks)).unionByName(marks.select("factor", "day", none(grid), "marks"))

    def run(t: pa.Table) -> pa.Table:
        days, day = np.unique(t.column("day").to_numpy(), return_inverse=True)
        parts = [t.column(c).combine_chunks() for c in ("grid", "marks")]
        names, places = None, []
        for x in parts:
            size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            flat = x.flatten()
            coded = flat.field("symbol").dictionary_encode()
            if names is None:  # names in their order; those that only have labels don't exist for trading
                names = coded.dictionary.take(pc.sort_indices(coded.dictionary))
            at = pc.fill_null(pc.index_in(coded.dictionary, names), -1).to_numpy(zero_copy_only=False)
            places.append((flat, np.repeat(day, size), at[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)))
        shape = (len(days), len(names))
        there = np.zeros(shape, bool)
        there[places[0][1], places[0][2]] = True

        def matrix(c: str, fill: float, part: int) -> np.ndarray:
            flat, d, n = places[part]
            m, on = np.full(shape, fill), n >= 0
            x = flat.field(c).to_numpy(zero_copy_only=False)
            m[d[on], n[on]] = (np.nan_to_num(x, nan=fill) if fill == 0 else x)[on]
            return m

        keep = there.any(axis=1)  # so with dates
        days = days[keep]
        if len(days) < 2:
            return pa.table({"factor": pa.array([], pa.string()), "day": pa.array([], pa.int32()), "grp": pa.array([], pa.int32()), "ret": pa.array([], pa.float64())})
        label = np.where(there, matrix("label", 0.0, 1), 0.0)[keep].astype(int)
        r = simulate(label, matrix("weight", np.nan, 1)[keep], matrix("tradable", 0.0, 0)[keep] > 0.5, *(matrix(c, np.nan, 0)[keep] for c in ("open", "close", "vwap")), config)
        n, k = len(r), config.quantiles
        return pa.table({"factor": pa.array([t.column("factor")[0].as_py()] * (n * k), pa.string()), "day": pa.array(np.repeat(days[1:], k).astype(np.int32)), "grp": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), "ret": pa.array(r.ravel())})

    out = rows.groupBy("factor").applyInArrow(run, "factor string, day int, grp int, ret double")
    return out.select("factor", F.date_from_unix_date("day").alias("trading_date"), "grp", "ret")


def nav(returns: DataFrame, ret: str = "ret", by: tuple[str, ...] = ("factor", "grp")) -> DataFrame:
    """returns with nv: the running product of 1 + return, missing ones skipped."""
    w = Window.partitionBy(*by).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("nv", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def long_short(returns: DataFrame, config: BacktestConfig) -> DataFrame:
    """(factor, trading_date, long_ret, short_ret, ls_ret)."""
    top = F.sum(F.when(F.col("grp") > config.quantiles - config.long_top_n, F.col("ret"))) / config.long_top_n * config.long_ratio
    low = -F.sum(F.when(F.col("grp") <= config.short_top_n, F.col("ret"))) / config.short_top_n * config.short_ratio
    return returns.groupBy("factor", "trading_date").agg(top.alias("long_ret"), low.alias("short_ret")).withColumn("ls_ret", F.col("long_ret") + F.col("short_ret"))


def passive(prices: DataFrame) -> DataFrame:
    """(trading_date, passive_ret): mean forward return of what can be traded, 0 if nothing can."""
    return prices.groupBy("trading_date").agg(F.coalesce(F.avg(F.when(F.col("tradable"), F.col("fwd_ret"))), F.lit(0.0)).alias("passive_ret"))


def pearson(x: Column, y: Column, least: int = 2, flat: float | None = None) -> Column:
    """Aggregate Pearson over complete pairs: NULL below `least` pairs, `flat` where a side is constant."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    den = F.sqrt(F.var_pop(a) * F.var_pop(b))
    r = F.when(den > 1e-15, F.try_divide(F.covar_pop(a, b), den))
    return F.when(F.count(a) >= least, r if flat is None else F.coalesce(r, F.lit(flat)))


def ic_series(joined: DataFrame, value: str = "value", ret: str = "fwd_ret", within: Column | None = None) -> DataFrame:
    """(factor, trading_date, ic): per-date correlation of value and forward return; the last date is left out."""
    x = F.col(value) if within is None else F.when(within, F.col(value))
    last = joined.agg(F.max("trading_date").alias("_last"))
    return joined.groupBy("factor", "trading_date").agg(pearson(x, F.col(ret), 2, 0.0).alias("ic")).join(F.broadcast(last)).where(F.col("trading_date") < F.col("_last")).drop("_last")


def next_day_ic(joined: DataFrame) -> DataFrame:
    """(factor, trading_date, ic) of a factor and the return of the next present row."""
    nxt = F.lead("fwd_ret").over(Window.partitionBy("factor", "symbol").orderBy("trading_date"))
    return joined.withColumn("_next", nxt).groupBy("factor", "trading_date").agg(pearson(F.col("value"), F.col("_next"), 2, 0.0).alias("ic"))


def ic_stats(ic: DataFrame) -> DataFrame:
    """(factor, ic_mean, ic_std, ic_ir, n_days); the ratio is missing without deviation."""
    s = F.stddev_samp("ic")
    return ic.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), s.alias("ic_std"), F.when(s > 0, F.try_divide(F.avg("ic"), s)).alias("ic_ir"), F.count("ic").alias("n_days"))


def group_ic(joined: DataFrame, config: BacktestConfig) -> DataFrame:
    """(factor, trading_date, long_ic, short_ic, both_ic) over the labels of the top and bottom groups."""
    top, low = F.col("label") > config.quantiles - config.long_top_n, (F.col("label") >= 1) & (F.col("label") <= config.short_top_n)
    part = lambda on: pearson(F.when(on, F.col("value")), F.col("fwd_ret"), 2, 0.0)
    return joined.groupBy("factor", "trading_date").agg(part(top).alias("long_ic"), part(low).alias("short_ic"), part(top | low).alias("both_ic"))


def label_turnover(labelled: DataFrame) -> DataFrame:
    """(factor, turnover): share of (symbol, date) pairs whose label differs from the date before, 0 counting as one."""
    before = F.lag("label").over(Window.partitionBy("factor", "symbol").orderBy("trading_date"))
    return labelled.withColumn("_b", before).where(F.col("_b").isNotNull()).groupBy("factor").agg(F.avg((F.col("label") != F.col("_b")).cast("double")).alias("turnover"))


def weight_turnover(weighted: DataFrame) -> DataFrame:
    """(factor, weight_turnover): mean over dates of half the summed change of weights."""
    before = F.lag("weight").over(Window.partitionBy("factor", "symbol").orderBy("trading_date"))
    daily = weighted.withColumn("_b", before).where(F.col("_b").isNotNull()).groupBy("factor", "trading_date").agg((F.sum(F.abs(F.col("weight") - F.col("_b"))) / 2).alias("t"))
    return daily.groupBy("factor").agg(F.avg("t").alias("weight_turnover"))


def turnovers(weighted: DataFrame) -> DataFrame:
    """(factor, turnover, weight_turnover) of label_turnover and weight_turnover, in one pass over the panel."""
    w = Window.partitionBy("factor", "symbol").orderBy("trading_date")
    pairs = weighted.select("factor", "trading_date", "label", "weight", F.lag("label").over(w).alias("_l"), F.lag("weight").over(w).alias("_w"))
    half = F.sum(F.when(F.col("_w").isNotNull(), F.abs(F.col("weight") - F.col("_w")))) / 2
    daily = pairs.groupBy("factor", "trading_date").agg(F.sum((F.col("label") != F.col("_l")).cast("double")).alias("moved"), F.count("_l").alias("n"), half.alias("t"))
    return daily.groupBy("factor").agg(F.try_divide(F.sum("moved"), F.sum("n")).alias("turnover"), F.avg("t").alias("weight_turnover"))


def positions(labelled: DataFrame, bins: int, long_n: int = 1, short_n: int = 1) -> DataFrame:
    """labelled with position: 1 in the top groups, -1 in the bottom ones, else 0."""
    return labelled.withColumn("position", F.when(F.col("label") > bins - long_n, 1.0).when((F.col("label") >= 1) & (F.col("label") <= short_n), -1.0).otherwise(0.0))


def combine_equal(panel: DataFrame, name: str = "combined") -> DataFrame:
    """The sum of all factors over their number, missing values counting as 0."""
    n = panel.agg(F.countDistinct("factor").alias("_n"))
    return panel.join(F.broadcast(n)).groupBy("trading_date", "symbol").agg((F.sum(F.coalesce("value", F.lit(0.0))) / F.first("_n")).alias("value")).withColumn("factor", F.lit(name))


@dataclass
class BacktestResult:
    """DataFrames of one or many factors."""

    labelled: DataFrame
    returns: DataFrame
    nav: DataFrame
    daily: DataFrame
    ic: DataFrame
    group_ic: DataFrame
    metrics: DataFrame


def run(panel: DataFrame, prices: DataFrame, config: BacktestConfig | None = None, labelled: DataFrame | None = None) -> BacktestResult:
    """The whole backtest of a panel; `labelled` takes ready labels instead."""
    from .metrics import metrics

    config = config or BacktestConfig()
    labelled = labelled if labelled is not None else groups(panel, config.quantiles)
    weighted = weights(labelled, config.quantiles, config.weight_method).persist(StorageLevel.MEMORY_AND_DISK)  # returns, IC and turnover read it
    joined = weighted.join(prices.select("trading_date", "symbol", "fwd_ret", "tradable"), ["trading_date", "symbol"])
    ic = ic_series(joined)
    returns = group_returns(weighted, prices, config).persist(StorageLevel.MEMORY_AND_DISK)  # small, and all that follows reads it
    ls = long_short(returns, config)
    first = Window.orderBy("trading_date")
    bench = prices.select("trading_date").distinct().withColumn("_next", F.lead("trading_date").over(first)).join(passive(prices), "trading_date")
    daily = ls.join(bench.select(F.col("_next").alias("trading_date"), "passive_ret"), "trading_date", "left")
    all_metrics = metrics(daily, "ls_ret").join(ic_stats(ic), "factor", "left").join(turnovers(weighted), "factor", "left")
    return BacktestResult(labelled, returns, nav(returns), daily, ic, group_ic(joined, config), all_metrics)


def run_ic(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """IC statistics only."""
    return ic_stats(ic_series(panel.join(prices.select("trading_date", "symbol", "fwd_ret"), ["trading_date", "symbol"])))


def run_with_qcut(panel: DataFrame, prices: DataFrame, config: BacktestConfig | None = None, qcut: str = "qcut") -> BacktestResult:
    config = config or BacktestConfig()
    return run(panel, prices, config, from_quantiles(panel, config.quantiles, qcut))


def run_multi(panel: DataFrame, prices: DataFrame, config: BacktestConfig | None = None) -> BacktestResult:
    """All factors of the panel as one."""
    return run(combine_equal(panel), prices, config)


def factor_returns(panel: DataFrame, prices: DataFrame, config: BacktestConfig | None = None) -> DataFrame:
    """Group net asset values and the long-short curve of a factor, side by side (tear-sheet data)."""
    r = run(panel, prices, config)
    ls = nav(r.daily, "ls_ret", ("factor",)).select("factor", "trading_date", F.lit(0).alias("grp"), F.col("ls_ret").alias("ret"), "nv")
    return r.nav.select("factor", "trading_date", "grp", "ret", "nv").unionByName(ls)
