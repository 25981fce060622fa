"""Recursive moving average, one pass over each symbol's history in Arrow batches.

alpha = m / n (0.5 outside (0, 1]); leading missing values stay missing, an inner one carries the average on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def alpha(n: float, m: float) -> float:
    a = m / n if n else 0.5
    return a if 0 < a <= 1 else 0.5


def ema(x: np.ndarray, a: float) -> np.ndarray:
    """NaN is missing."""
    out, y = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x.tolist()):
        if v == v:
            y = v if y != y else a * v + (1 - a) * y
        out[i] = y
    return out


def with_ema(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """df with a column for each name -> (input column, alpha); all are made in one grouped pass over symbols."""
    schema = StructType([*df.schema.fields, *[StructField(k, DoubleType()) for k in wanted]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trading_date", kind="stable")
        for k, (c, a) in wanted.items():
            y = ema(pdf[c].to_numpy(dtype=float, na_value=np.nan), a)
            pdf[k] = pd.array(np.where(np.isnan(y), None, y), dtype="Float64")
        return pdf

    return df.groupBy("symbol").applyInPandas(run, schema)
