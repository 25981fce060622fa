"""Result sinks: factor tables and net-asset-value tables, partitioned where they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_factors(panel: DataFrame, path: str, format: str = "parquet", debug: bool = False) -> None:  # noqa: A002
    """factor, symbol, date, cap_neued, qcut (and the stages before in debug)."""
    extra = [c for c in ("raw", "winsored", "zscored") if debug and c in panel.columns]
    out = panel.select("factor", "symbol", F.date_format("trading_date", "yyyy-MM-dd").alias("date"), *extra, "cap_neued", "qcut")
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if format == "csv" else writer.partitionBy("factor").format(format).save(path)


def write_nav(nav: DataFrame, path: str) -> None:
    """date, nv, group."""
    nav.select(F.date_format("trading_date", "yyyy-MM-dd").alias("date"), "nv", F.col("grp").alias("group")).write.mode("overwrite").option("header", True).csv(path)
