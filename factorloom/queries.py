"""Registered queries of the engine over the supplied tables, each with its SQL in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import crosssection as cs
from .functions.groupagg import expand
from .operators import backtest, covariance, metrics, optimize, prices, risk, search, strategies
from .oracles import FORMULAS, INTRADAY_FORMULAS, ORACLES
from .plans import corpus
from .plans.compiler import compute
from .plans.pipeline import cross_section, factor_panel
from .sources import bars, filters

__all__ = ["ORACLES", "QUERIES"]
Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 8
#: Symbols of a portfolio at most: a covariance of 8 MB.
PORTFOLIO = 1000


def r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, so that the order of summation doesn't show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + 0.0


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with x (volume, missing where divisible by 7) and y (trades)."""
    b = bars.period_bars(spark, sf_dir, "week")
    return b.withColumn("x", F.when(F.col("vol") % 7 != 0, F.col("vol"))).withColumn("y", F.col("trades"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.period_bars(spark, sf_dir, "month")
    return b.withColumn("x", F.when(F.col("vol") % 7 != 0, F.col("vol"))).withColumn("y", F.col("trades"))


def formula(source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute({"value": source}, weekly(spark, sf_dir)).select("symbol", "trading_date", r("value").alias("value"))


def intraday_formula(source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute({"value": source}, None, bars.intraday_bars(spark, sf_dir)).select("symbol", "trading_date", r("value").alias("value"))


def slice_momentum_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum to quantiles to the mean next return of each (date, quantile)."""
    b = weekly(spark, sf_dir)
    q = compute({"q": "qcut(zscore(y / ts_delay(y, 1) - 1), 5)"}, b)
    ahead = prices.price_grid(b.withColumn("close", F.col("y"))).select("symbol", "trading_date", "fwd_ret")
    out = q.where("q is not null").join(ahead, ["symbol", "trading_date"]).groupBy("trading_date", F.col("q").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd_ret"), 4).alias("mean_ret"))
    return out


def cs_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = weekly(spark, sf_dir).withColumn("cap", F.col("y") * 100)
    p = cross_section(b.withColumn("f", F.col("x")), ["f"])
    return p.select("symbol", "trading_date", r("winsored").alias("winsored"), r("zscored").alias("zscored"), r("cap_neued", 4).alias("cap_neued"))


def price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = prices.price_grid(weekly(spark, sf_dir).withColumn("close", F.col("y")))
    return g.select("symbol", "trading_date", "close", r("fwd_ret").alias("fwd_ret"), "tradable")


def flt_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = monthly(spark, sf_dir).where(filters.parse_prefilter("1996-01-01:1997-12-31, symbols like '1%', symbols not like '%7', vol > 100 and y >= 3"))
    return b.select("symbol", "trading_date", "vol", "y")


def flt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.QueryFilter(("vol", "y"), (1, 2, 3, 5), "1996-01-01", "1997-12-31", ("vol > 200 or y < 5",)).apply(monthly(spark, sf_dir))


def meta_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.symbols(weekly(spark, sf_dir))


def meta_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.date_range(weekly(spark, sf_dir))


def ohlcv_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filters.daily_rollup(bars.intraday_bars(spark, sf_dir))
    return d.select("symbol", "trading_date", *[r(c).alias(c) for c in ("open", "high", "low", "close", "vol")])


def grp_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.intraday_bars(spark, sf_dir)
    return b.select("symbol", "trading_date", "bar", *[r(expand(k, F.col("vol"))).alias(f"vol_{k}") for k in ("sum", "mean", "count", "min", "max", "std", "var")])


def cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor values with their sizes: a left join on (symbol, date)."""
    b = monthly(spark, sf_dir)
    cap = prices.cap_map(b.withColumn("cap", F.when(F.col("y") > 3, F.col("y") * 100)))
    return b.select("symbol", "trading_date", "x").join(cap, ["symbol", "trading_date"], "left").select("symbol", "trading_date", "x", "cap")


# --- backtest ---


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors on monthly bars."""
    b = monthly(spark, sf_dir)
    one = b.select(F.lit("vol").alias("factor"), "trading_date", "symbol", F.col("x").alias("value"))
    return one.unionByName(b.select(F.lit("trades").alias("factor"), "trading_date", "symbol", F.col("y").alias("value")))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that are whole numbers, so that returns agree to the last digit."""
    b = monthly(spark, sf_dir)
    return prices.price_grid(b.withColumn("close", F.col("y")).withColumn("open", F.col("y")).withColumn("high", F.col("y") + 1).withColumn("low", F.col("y")).withColumn("amount", F.col("y") * F.col("vol")))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.groups(_panel(spark, sf_dir), 5).join(_grid(spark, sf_dir).select("trading_date", "symbol", "fwd_ret", "tradable"), ["trading_date", "symbol"])


CONFIG = backtest.BacktestConfig(quantiles=5)


def bt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.groups(_panel(spark, sf_dir), 5).select("factor", "trading_date", "symbol", "label")


def bt_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = backtest.groups(_panel(spark, sf_dir), 5)
    e, w = backtest.weights(g, 5), backtest.weights(g, 5, "weighted")
    keys = ["factor", "trading_date", "symbol"]
    return e.select(*keys, r("weight").alias("equal")).join(w.select(*keys, r("weight").alias("weighted")), keys)


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the groups, traded with fees."""
    w = backtest.weights(backtest.groups(_panel(spark, sf_dir), 5), 5)
    return backtest.group_returns(w, _grid(spark, sf_dir), CONFIG)


def bt_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.nav(_traded(spark, sf_dir)).select("factor", "trading_date", "grp", r("ret").alias("ret"), r("nv").alias("nv"))


def bt_longshort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.long_short(_traded(spark, sf_dir), CONFIG).select("factor", "trading_date", r("long_ret").alias("long_ret"), r("short_ret").alias("short_ret"), r("ls_ret").alias("ls_ret"))


def bt_passive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.passive(_grid(spark, sf_dir)).select("trading_date", r("passive_ret").alias("passive_ret"))


def bt_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.ic_series(_joined(spark, sf_dir)).select("factor", "trading_date", r("ic").alias("ic"))


def bt_ic_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.next_day_ic(_joined(spark, sf_dir)).select("factor", "trading_date", r("ic").alias("ic"))


def bt_group_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.group_ic(_joined(spark, sf_dir), CONFIG).select("factor", "trading_date", r("long_ic").alias("long_ic"), r("short_ic").alias("short_ic"), r("both_ic").alias("both_ic"))


def bt_ic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.ic_stats(backtest.ic_series(_joined(spark, sf_dir))).select("factor", r("ic_mean").alias("ic_mean"), r("ic_std").alias("ic_std"), r("ic_ir").alias("ic_ir"), "n_days")


def bt_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = backtest.groups(_panel(spark, sf_dir), 5)
    return backtest.label_turnover(g).join(backtest.weight_turnover(backtest.weights(g, 5)), "factor").select("factor", r("turnover").alias("turnover"), r("weight_turnover").alias("weight_turnover"))


def bt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the long-short strategy of each factor; rounded, as a win is anything over 0."""
    daily = backtest.long_short(_traded(spark, sf_dir), CONFIG).withColumn("ls_ret", F.round("ls_ret", 10))
    return metrics.metrics(daily, "ls_ret").select("factor", *[r(c).alias(c) for c in ("total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "win_rate", "calmar")])


def bt_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = backtest.passive(_grid(spark, sf_dir)).withColumn("factor", F.lit("passive")).withColumn("ret", F.col("passive_ret") / 10)
    return backtest.nav(metrics.cumulative(s, "ret"), "ret", ("factor",)).select("trading_date", r("cum").alias("cum"), r("nv").alias("nv"))


def bt_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.positions(backtest.groups(_panel(spark, sf_dir), 5), 5).select("factor", "trading_date", "symbol", "position")


def bt_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.combine_equal(_panel(spark, sf_dir)).select("trading_date", "symbol", r("value").alias("value"))


def bt_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole backtest of two formulas: pipeline, groups, fees, metrics."""
    b = monthly(spark, sf_dir)
    p = factor_panel({"reversal": "-(close / ts_delay(close, 1) - 1)", "calm": "-ts_std(close, 6)"}, b, bins=5)
    out = backtest.run_with_qcut(p.withColumn("value", F.col("cap_neued")), prices.price_grid(b), CONFIG).metrics
    return out.select("factor", *[r(c).alias(c) for c in out.columns if c != "factor"])


# --- strategies, optimisation, risk ---


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = monthly(spark, sf_dir)
    ahead = _grid(spark, sf_dir).select("symbol", "trading_date", "fwd_ret")
    return b.select("symbol", "trading_date", F.col("x").alias("a"), F.col("y").alias("b")).join(ahead, ["symbol", "trading_date"])


def _signal(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select("symbol", "trading_date", r("signal", digits).alias("signal"))


def strategy(config: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(strategies.combine(_wide(spark, sf_dir), ["a", "b"], config))


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).withColumn("signal", F.col("a") - 40)


def opt_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.top_k(_sig(spark, sf_dir), 10).select("symbol", "trading_date", r("weight").alias("weight"))


def opt_topk_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.top_k(_sig(spark, sf_dir), 10, True).select("symbol", "trading_date", r("weight").alias("weight"))


def opt_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.signal_proportional(_sig(spark, sf_dir)).select("symbol", "trading_date", r("weight").alias("weight"))


def opt_invvol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.inverse_volatility(_sig(spark, sf_dir), 12).select("symbol", "trading_date", r("weight").alias("weight"))


def alpha_map(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.map_alpha(_sig(spark, sf_dir), kind).select("symbol", "trading_date", r("alpha").alias("alpha"))


def cost_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = optimize.signal_proportional(_sig(spark, sf_dir))
    d = F.col("weight") - F.lag("weight", 1, 0.0).over(Window.partitionBy("symbol").orderBy("trading_date"))
    out = w.withColumn("d", d)
    return out.select("symbol", "trading_date", *[r(optimize.cost(k, F.col("d"), F.col("b")), 9).alias(k) for k in ("none", "linear", "quadratic", "composite")])


def optimiser(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols and dates, in equal portfolios of at most PORTFOLIO symbols, whose covariance fits a task."""
    rows = _sig(spark, sf_dir).withColumn("signal", F.col("signal") / 1000)
    symbols = rows.select("symbol").distinct()
    n = max(1, -(-symbols.count() // PORTFOLIO))
    place = F.row_number().over(Window.orderBy("symbol")) % n
    of = symbols.select("symbol", (F.lit(kind) if n == 1 else F.concat(F.lit(f"{kind}-"), place.cast("string"))).alias("portfolio"))
    return optimize.optimise(rows.join(of, "symbol"), kind, 24).select("portfolio", "symbol", "trading_date", r("weight", 4).alias("weight"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.passive(_grid(spark, sf_dir)).select("trading_date", (F.col("passive_ret") / 10).alias("ret"))


def risk_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = optimize.signal_proportional(_sig(spark, sf_dir))
    return risk.portfolio_returns(w.select("trading_date", "symbol", "weight"), w.select("trading_date", "symbol", "fwd_ret")).select("trading_date", r("ret").alias("ret"))


def risk_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).agg(r(risk.volatility(F.col("ret"))).alias("volatility"))


def risk_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ret")
    return _returns(spark, sf_dir).agg(r(risk.var_historical(c)).alias("historical"), r(risk.var_normal(c)).alias("normal"))


def risk_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.cvar_historical(_returns(spark, sf_dir)).select(r("var").alias("var"), r("cvar").alias("cvar"))


def risk_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ret")
    return _returns(spark, sf_dir).agg(r(risk.var_student(c), 6).alias("student"), r(risk.cvar_normal(c), 6).alias("cvar_normal"))


def risk_dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.drawdowns(_returns(spark, sf_dir)).select("trading_date", r("drawdown").alias("drawdown"))


def risk_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.worst_drawdown(_returns(spark, sf_dir))
    return out.select(r("max_drawdown").alias("max_drawdown"), *[F.col(c).cast("string").alias(c) for c in ("peak_date", "trough_date", "recovery_date")])


def risk_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rolling(_returns(spark, sf_dir), 12, 3).select("start", "end_date", "n", r("volatility").alias("volatility"), r("var").alias("var"), r("mean").alias("mean"))


def risk_barra(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.factor_returns(_wide(spark, sf_dir), ["a", "b"])
    return out.select("trading_date", r("a", 6).alias("a"), r("b", 6).alias("b"), r("r2", 6).alias("r2"), "n")


def risk_factor_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of factor returns by each estimator."""
    x = risk.factor_returns(_wide(spark, sf_dir), ["a", "b"]).orderBy("trading_date").select("a", "b").toPandas().to_numpy(float)
    rows = [(k, i, j, float(np.round(m[i, j], 9))) for k, f in covariance.ESTIMATORS.items() for m in [f(x)] for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "estimator string, i int, j int, cov double")


def risk_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = risk.factor_returns(_wide(spark, sf_dir), ["a", "b"]).orderBy("trading_date").select("a", "b").toPandas().to_numpy(float)
    cov, w, e = covariance.sample(x), np.array([0.6, 0.4]), np.array([[1.0, 0.2], [0.3, -0.5]])
    rows = []
    for k in risk.SCENARIOS:
        s = risk.stress(w, e, cov, np.array([0.01, 0.02]), ["Beta", "Momentum"], 100.0, k)
        rows.append((k, float(np.round(s["stressed_volatility"], 6)), float(np.round(s["loss"], 6)), float(np.round(s["nav"], 6))))
    return spark.createDataFrame(rows, "scenario string, stressed_volatility double, loss double, nav double")


def brinson(against_total: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _wide(spark, sf_dir).groupBy("symbol").agg(F.sum("b").alias("hold"), F.avg("fwd_ret").alias("ret"))
    s = bars.sectors(spark, sf_dir).join(b, "symbol")
    total = s.agg(F.sum("hold").alias("_t"))
    rows = s.join(F.broadcast(total)).select("sector", (F.col("hold") / F.col("_t")).alias("wp"), F.col("bench_weight").alias("wb"), F.col("ret").alias("rp"), F.col("ret").alias("rb"))
    return risk.brinson(rows, against_total).select("sector", r("allocation").alias("allocation"), r("selection").alias("selection"), r("interaction").alias("interaction"))


def ic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.ic_statistics(_joined(spark, sf_dir))
    return out.select("factor", *[r(c).alias(c) for c in out.columns if c != "factor"])


# --- search and corpus ---


def gp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short seeded search over all symbols."""
    b = monthly(spark, sf_dir)
    c = search.SearchConfig(population=8, generations=2, max_depth=3, elite=2, seed=7)
    found = search.search(b, prices.price_grid(b).select("symbol", "trading_date", "fwd_ret"), ["close", "vol", "vwap"], c)
    rows = [(i, search.text(x.tree), float(round(x.fitness, 6))) for i, x in enumerate(found.population)]
    return spark.createDataFrame(rows, "place int, formula string, fitness double")


def formula_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formulas of the corpus in one staged plan: count and mean of each."""
    df = compute(corpus.FORMULAS, monthly(spark, sf_dir).withColumn("returns_", F.lit(None).cast("double")))
    names = list(corpus.FORMULAS)
    out = df.agg(*[F.count(n).alias(f"c_{n}") for n in names], *[F.avg(n).alias(f"m_{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"c_{n}").alias("n"), r(F.col(f"m_{n}"), 4).alias("mean")) for n in names])
    return out.select(F.explode(rows).alias("x")).select("x.factor", "x.n", "x.mean")


def sector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.sectors(spark, sf_dir).select("symbol", "sector", r("bench_weight").alias("bench_weight"))


def cs_to_percentiles_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard scores along a symbol's history."""
    steps, end = cs.zscore_cols(F.col("x"), "_p")
    df = monthly(spark, sf_dir)
    for s in steps:
        df = df.withColumns(s)
    return df.select("symbol", "trading_date", r(end).alias("value"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        slice_momentum_quantiles, cs_pipeline, price_matrix, flt_prefilter, flt_query, meta_symbols, meta_date_range, ohlcv_rollup, grp_expand, cap_join,
        bt_groups, bt_weights, bt_nav, bt_longshort, bt_passive, bt_ic, bt_ic_next, bt_group_ic, bt_ic_stats, bt_turnover, bt_metrics, bt_cumulative, bt_positions, bt_multi, bt_full,
        opt_topk, opt_topk_neutral, opt_signal, opt_invvol, cost_models, risk_portfolio, risk_vol, risk_var, risk_cvar, risk_student, risk_dd, risk_worst, risk_rolling, risk_barra,
        risk_factor_cov, risk_stress, ic_statistics, gp_search, formula_corpus, sector_weights, cs_to_percentiles_cols,
    )
}
QUERIES |= {k: partial(formula, f) for k, (f, _) in FORMULAS.items()}
QUERIES |= {k: partial(intraday_formula, f) for k, (f, _) in INTRADAY_FORMULAS.items()}
QUERIES |= {
    f"st_{k}": partial(strategy, c)
    for k, c in {
        "equal": {"type": "equal_weight"}, "rankavg": {"type": "rank_average"}, "signal": {"type": "signal_weighted"}, "icw": {"type": "ic_weighted"}, "icir": {"type": "ic_ir_weighted"},
        "ridge": {"type": "ridge_combine", "alpha": 1.0}, "pca": {"type": "factor_zoo_compress"}, "state_aware": {"type": "state_aware"}, "comfort_zone": {"type": "factor_comfort_zone"},
    }.items()
}
QUERIES |= {f"alpha_{k}": partial(alpha_map, k) for k in ("linear", "rank", "quantile", "zscore", "boxcox")}
QUERIES |= {f"opt_{k}": partial(optimiser, k) for k in ("max_sharpe", "min_variance", "turnover_aware", "risk_parity", "max_diversification")}
QUERIES |= {"brinson": partial(brinson, True), "brinson_plain": partial(brinson, False)}
