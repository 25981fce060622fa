"""Performance figures of return series, by factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def log_growth(r: Column) -> Column:
    """ln(1 + r), nothing for a loss of everything."""
    return F.when(r > -1, F.ln(1 + r)).when(r.isNotNull(), 0.0)


def cumulative(df: DataFrame, ret: str, by: tuple[str, ...] = ("factor",)) -> DataFrame:
    """df with cum: the compounded return so far; missing from the first missing return on."""
    w = Window.partitionBy(*by).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count(F.lit(1)).over(w) == F.count(ret).over(w)
    return df.withColumn("cum", F.when(whole, F.exp(F.sum(log_growth(F.col(ret))).over(w)) - 1))


def metrics(df: DataFrame, ret: str, by: tuple[str, ...] = ("factor",)) -> DataFrame:
    """total_return, annual_return, volatility, sharpe, max_drawdown, win_rate, calmar of each series."""
    r = F.col(ret)
    w = Window.partitionBy(*by).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = df.withColumn("_nv", F.product(1 + F.coalesce(r, F.lit(0.0))).over(w)).withColumn("_peak", F.greatest(F.lit(1.0), F.max("_nv").over(w)))
    s, n = F.stddev_samp(r), F.count(F.lit(1))
    total = F.exp(F.coalesce(F.sum(log_growth(r)), F.lit(0.0))) - 1
    out = curve.groupBy(*by).agg(
        total.alias("total_return"),
        (F.pow(1 + total, F.lit(float(YEAR)) / n) - 1).alias("annual_return"),
        (s * YEAR**0.5).alias("volatility"),
        F.when(s > 0, F.try_divide(F.avg(r), s) * YEAR**0.5).otherwise(0.0).alias("sharpe"),
        F.max(F.try_divide(F.col("_peak") - F.col("_nv"), F.col("_peak"))).alias("max_drawdown"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.try_divide(F.col("annual_return"), F.col("max_drawdown"))))
