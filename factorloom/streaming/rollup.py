"""Unbounded bars: daily roll-up with a watermark, and the recursive average as keyed state. Both equal the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rollup(events: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """(symbol, trading_date, open, high, low, close, vol) of events (symbol, ts, price, size); late ones beyond the delay are left out."""
    w = F.window("ts", window)
    return (
        events.withWatermark("ts", delay)
        .groupBy(w, "symbol")
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("vol"))
        .select("symbol", F.to_date("window.start").alias("trading_date"), "open", "high", "low", "close", "vol")
    )


def ema(bars: DataFrame, alpha: float) -> DataFrame:
    """(symbol, trading_date, ema) of (symbol, trading_date, close) rows that arrive in order of date within a symbol."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("trading_date", kind="stable")
            out = []
            for v in pdf["close"].tolist():
                if v is not None and v == v:
                    y = v if y is None else alpha * v + (1 - alpha) * y
                out.append(y)
            yield pd.DataFrame({"symbol": pdf["symbol"], "trading_date": pdf["trading_date"], "ema": pd.Series(out, index=pdf.index, dtype="float64")})
        if y is not None:
            state.update((y,))

    kind = bars.schema["symbol"].dataType.simpleString()
    return bars.select("symbol", "trading_date", "close").groupBy("symbol").applyInPandasWithState(step, f"symbol {kind}, trading_date date, ema double", "y double", "append", GroupStateTimeout.NoTimeout)
