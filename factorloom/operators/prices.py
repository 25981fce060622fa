"""The price grid: every date by every symbol, adjusted prices, forward returns, tradability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SourceConfig


def price_grid(bars: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """symbol, trading_date, open, high, low, close, vwap, fwd_ret, tradable, adj.

    vwap comes from amount and volume; prices are scaled by the adjustment factor over the symbol's last one; a
    missing close takes the next one; the forward return is 0 where it is unknown; tradable means high > low.
    The dates travel as one array row, so the grid is an explode, not a join of two tables.
    """
    config = config or SourceConfig(volume_unit=1.0, amount_unit=1.0)
    adj = F.col("adjust_factor") if "adjust_factor" in bars.columns else F.lit(1.0)
    have = bars.select("symbol", "trading_date", "open", "high", "low", "close", F.when(F.col("vol") > 0, F.col("amount") * (config.amount_unit / config.volume_unit) / F.col("vol")).alias("vwap"), adj.alias("adj"))
    dates = bars.agg(F.array_sort(F.collect_set("trading_date")).alias("dates"))
    grid = bars.select("symbol").distinct().join(F.broadcast(dates)).select("symbol", F.explode("dates").alias("trading_date"))
    full = grid.join(have, ["symbol", "trading_date"], "left")
    order = Window.partitionBy("symbol").orderBy("trading_date")
    last = F.last("adj", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scale = F.try_divide(F.col("adj"), last)
    scaled = full.select("symbol", "trading_date", *[(F.col(c) * scale).alias(c) for c in ("open", "high", "low", "close", "vwap")], "adj")
    filled = scaled.withColumn("close", F.first("close", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    ahead = F.try_divide(F.lead("close").over(order), F.col("close")) - 1
    return filled.withColumn("fwd_ret", F.coalesce(ahead, F.lit(0.0))).withColumn("tradable", F.coalesce(F.col("high") > F.col("low"), F.lit(False)))


def from_returns(returns: DataFrame) -> DataFrame:
    """A grid made of returns alone: prices compound them from 1 (symbol, trading_date, ret)."""
    order = Window.partitionBy("symbol").orderBy("trading_date")
    before = F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    close = F.exp(F.coalesce(before, F.lit(0.0)))
    out = returns.withColumn("close", close)
    return out.select("symbol", "trading_date", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.col("close").alias("vwap"), F.coalesce("ret", F.lit(0.0)).alias("fwd_ret"), F.lit(True).alias("tradable"), F.lit(1.0).alias("adj"))


def cap_map(bars: DataFrame) -> DataFrame:
    """(symbol, trading_date, cap) where it is positive."""
    return bars.where(F.col("cap") > 0).select("symbol", "trading_date", "cap")


def first_symbols(grid: DataFrame, n: int) -> DataFrame:
    """The first n symbols in order."""
    few = grid.select("symbol").distinct().orderBy("symbol").limit(n)
    return grid.join(few, "symbol", "left_semi")
