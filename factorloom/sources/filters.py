"""Scan-time predicates: the pre-filter mini-language and a filter builder. All become pushed-down column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATES = re.compile(r"^\s*(\d{4}-?\d{2}-?\d{2})?\s*:\s*(\d{4}-?\d{2}-?\d{2})?\s*$")
_LIKE = re.compile(r"^\s*(?:(symbols?)\s+)?(not\s+)?like\s+'?([^']+?)'?\s*$", re.I)
_COMPARE = re.compile(r"^\s*(\w+)\s*(<=|>=|!=|<>|=|<|>)\s*('[^']*'|[-+.\deE]+)\s*$")


def _date(text: str) -> Column:
    digits = text.replace("-", "")
    return F.lit(f"{digits[:4]}-{digits[4:6]}-{digits[6:]}").cast("date")


def _compare(name: str, op: str, value: str) -> Column:
    v = F.lit(value[1:-1]) if value.startswith("'") else F.lit(float(value))
    c = F.col(name)
    return {"<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v, "=": c == v, "!=": c != v, "<>": c != v}[op]


def parse_prefilter(text: str) -> Column:
    """Clauses separated by commas or semicolons, all of which hold: `start:end` (inclusive, either may be missing),
    `symbols like 'p'`, `symbols not like 'p'`, bare `like p` (excludes), and comparisons joined by AND / OR."""
    out = F.lit(True)
    for clause in filter(str.strip, re.split(r"[;,]", text)):
        if m := _DATES.match(clause):
            if m[1]:
                out = out & (F.col("trading_date") >= _date(m[1]))
            if m[2]:
                out = out & (F.col("trading_date") <= _date(m[2]))
        elif m := _LIKE.match(clause):
            like = F.col("symbol").cast("string").like(m[3])
            out = out & (~like if m[2] or not m[1] else like)
        else:
            either = F.lit(False)
            for alternative in re.split(r"\s+or\s+", clause, flags=re.I):
                every = F.lit(True)
                for one in re.split(r"\s+and\s+", alternative, flags=re.I):
                    m = _COMPARE.match(one)
                    if not m:
                        raise ValueError(f"can't read the filter {one!r}")
                    every = every & _compare(*m.groups())
                either = either | every
            out = out & either
    return out


@dataclass(frozen=True)
class QueryFilter:
    """Columns, symbols, inclusive dates and conditions of a scan."""

    columns: tuple[str, ...] = ()
    symbols: tuple = ()
    start: str | None = None
    end: str | None = None
    conditions: tuple[str, ...] = field(default=())

    def apply(self, df: DataFrame) -> DataFrame:
        if self.symbols:
            df = df.where(F.col("symbol").isin(list(self.symbols)))
        if self.start or self.end:
            df = df.where(parse_prefilter(f"{self.start or ''}:{self.end or ''}"))
        for c in self.conditions:
            df = df.where(parse_prefilter(c))
        return df.select("symbol", "trading_date", *self.columns) if self.columns else df


def symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct()


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path) of the Parquet tables of a folder, listed by Spark's own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = sorted((f.getPath().getName().removesuffix(".parquet"), f.getPath().toString()) for f in found if f.getPath().getName().endswith(".parquet"))
    return spark.createDataFrame(rows, "name string, path string")


def columns(df: DataFrame) -> DataFrame:
    """(name, type) of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def check_bars(df: DataFrame) -> DataFrame:
    """One row of counts that should be zero: missing keys, repeated keys, high below low, negative volume."""
    keys = df.groupBy("symbol", "trading_date").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("high") < F.col("low"), 1).otherwise(0)).alias("_hl"), F.sum(F.when(F.col("vol") < 0, 1).otherwise(0)).alias("_v"))
    return keys.agg(F.sum(F.when(F.col("symbol").isNull() | F.col("trading_date").isNull(), F.col("_n")).otherwise(0)).alias("missing_keys"), F.sum(F.col("_n") - 1).alias("repeated_keys"), F.sum("_hl").alias("high_below_low"), F.sum("_v").alias("negative_volume"))


def daily_rollup(df: DataFrame, order: str = "bar") -> DataFrame:
    """Intraday bars to daily ones; first and last are by bar order, so they are deterministic."""
    return df.groupBy("symbol", "trading_date").agg(
        F.min_by("close", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("vol").alias("vol"),
    )
