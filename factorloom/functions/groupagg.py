"""Aggregates of a finer frequency by (symbol, trading_date): reduced to one row, or spread over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

GROUP: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "count": lambda x: F.count(F.lit(1)).cast("double"),  # rows, whether x is missing or not
    "min": F.min,
    "max": F.max,
    "std": lambda x: F.when(F.count(x) >= 2, F.stddev_samp(x)),
    "var": lambda x: F.when(F.count(x) >= 2, F.var_samp(x)),
    "product": F.product,
}
GROUP_ALIASES = {"add": "sum", "avg": "mean", "average": "mean", "cnt": "count", "stdev": "std", "variance": "var"}


def expand(name: str, x: Column) -> Column:
    """The group's value on each of its rows."""
    w = Window.partitionBy("symbol", "trading_date")
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "product": F.product}
    if name in plain:
        return plain[name](x).over(w)
    if name == "count":
        return F.count(F.lit(1)).over(w).cast("double")
    return F.when(F.count(x).over(w) >= 2, (F.stddev_samp if name == "std" else F.var_samp)(x).over(w))
