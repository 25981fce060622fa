"""The per-date pipeline of a factor: winsorise, z-score, neutralise for size, cut into quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import cap_neu, qcut, winsor, zscore
from .compiler import compute


def cross_section(df: DataFrame, names: list[str], cap: str = "cap", bins: int = 10) -> DataFrame:
    """Long rows (factor, trading_date, symbol, raw, winsored, zscored, cap_neued, qcut); dates of one row are NULL.

    All factors go through the same steps at once, so that each step is one pass over one partitioning by date.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy("trading_date"))
    df = df.select("symbol", "trading_date", F.col(cap).alias("_cap"), rows.alias("_rows"), *[F.col(n).alias(f"_f{i}") for i, n in enumerate(names)])

    def stage(df: DataFrame, out: str, make) -> DataFrame:  # noqa: ANN001
        steps, ends, used = [], {}, []
        for i in range(len(names)):
            own, end = make(i)
            ends[f"_{out}{i}"] = F.when(F.col("_rows") >= 2, end)
            for k, step in enumerate(own):
                while len(steps) <= k:
                    steps.append({})
                steps[k] |= step
                used += step
        for step in [*steps, ends]:
            df = df.withColumns(step)
        return df.drop(*used)

    df = stage(df, "w", lambda i: winsor(F.col(f"_f{i}"), f"_pw{i}"))
    df = stage(df, "z", lambda i: zscore(F.col(f"_w{i}"), f"_pz{i}"))
    df = stage(df, "c", lambda i: cap_neu(F.col(f"_z{i}"), F.col("_cap"), f"_pc{i}"))
    df = stage(df, "q", lambda i: qcut(F.col(f"_c{i}"), f"_pq{i}", bins))
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"_f{i}").alias("raw"), F.col(f"_w{i}").alias("winsored"), F.col(f"_z{i}").alias("zscored"), F.col(f"_c{i}").alias("cap_neued"), F.col(f"_q{i}").alias("qcut")) for i, n in enumerate(names)])
    return df.select("symbol", "trading_date", F.explode(rows).alias("x")).select("x.factor", "trading_date", "symbol", "x.raw", "x.winsored", "x.zscored", "x.cap_neued", "x.qcut")


def factor_panel(formulas: dict[str, str], daily: DataFrame, intraday: DataFrame | None = None, bins: int = 10) -> DataFrame:
    return cross_section(compute(formulas, daily, intraday, keep=("cap",)), list(formulas), bins=bins)
