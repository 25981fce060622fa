"""Bar views, field catalogue and ingest rules.

Canonical bars are long DataFrames keyed by (symbol, trading_date[, bar]); a missing value is NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Canonical fields by frequency.
COMMON_FIELDS = ("close", "open", "high", "low", "vol", "amount", "vwap")
DAILY_FIELDS = (
    "prev_close", "change", "change_pct", "adjust_factor", "up_limit", "down_limit", "turnover_rate", "free_turnover_rate", "volume_ratio",
    "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dividend_yield", "dividend_yield_ttm", "total_shares", "float_shares", "free_float_shares",
    "market_cap", "float_market_cap",
)
INTRADAY_FIELDS = ("pre_close", "pct_chg")
#: Frequencies from fine to coarse.
FREQUENCIES = ("1m", "5m", "15m", "30m", "1h", "1d", "1w", "1mo")


@dataclass(frozen=True)
class SourceConfig:
    """Where bars are and in which units (volume in lots, amount in thousands)."""

    path: str = ""
    daily: str = "stock_1d"
    intraday: str = "stock_5m"
    volume_unit: float = 100.0
    amount_unit: float = 1000.0
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str]) -> SourceConfig:
        """FACTORLOOM_* settings override the defaults."""
        get = lambda k, d: env.get(f"FACTORLOOM_{k}", d)
        return cls(get("PATH", ""), get("DAILY", "stock_1d"), get("INTRADAY", "stock_5m"), float(get("VOLUME_UNIT", "100")), float(get("AMOUNT_UNIT", "1000")))

    def read(self, spark: SparkSession, frequency: str = "1d", format: str = "parquet") -> DataFrame:  # noqa: A002
        """Scan a bar table; columns and filters are pushed into it by the planner. format 'jdbc' takes its options from here."""
        name = self.daily if frequency == "1d" else self.intraday
        if format == "jdbc":
            return clean(spark.read.format("jdbc").options(**self.options, dbtable=name).load())
        return clean(spark.read.format(format).options(**self.options).load(f"{self.path}/{name}.parquet" if format == "parquet" else f"{self.path}/{name}"))


def fields(frequency: str) -> tuple[str, ...]:
    """Canonical fields that a frequency has."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency {frequency}")
    extra = DAILY_FIELDS if frequency == "1d" else INTRADAY_FIELDS if frequency in ("1m", "5m") else ()
    return COMMON_FIELDS + extra


def can_aggregate(fine: str, coarse: str) -> bool:
    return FREQUENCIES.index(coarse) > FREQUENCIES.index(fine)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clean(df: DataFrame) -> DataFrame:
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in df.schema.fields])


def canonical(df: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """Renames and derived columns: vol, vwap (from amount and volume) and cap (close times free float)."""
    config, have = config or SourceConfig(), set(df.columns)
    if "volume" in have and "vol" not in have:
        df = df.withColumnRenamed("volume", "vol")
    if {"amount", "vol"} <= set(df.columns) and "vwap" not in have:
        df = df.withColumn("vwap", F.when(F.col("vol") > 0, F.col("amount") * (config.amount_unit / config.volume_unit) / F.col("vol")))
    if {"close", "free_float_shares"} <= have and "cap" not in have:
        cap = F.col("close") * F.col("free_float_shares")
        df = df.withColumn("cap", F.when(cap > 0, cap))
    return df


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period_bars(spark: SparkSession, sf_dir: str, period: str = "week") -> DataFrame:
    """Bars of suppliers by week or month from order lines: one aggregate on (symbol, trading_date), partial before the shuffle."""
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date(F.date_trunc(period, "l_shipdate")).alias("trading_date")).agg(
        F.avg(price).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
        F.sum("l_quantity").alias("vol"),
        F.sum("l_extendedprice").alias("amount"),
        F.avg("l_discount").alias("_d"),
        F.count(F.lit(1)).cast("double").alias("trades"),
    )
    return bars.withColumn("open", F.col("vwap") * (1 - F.col("_d"))).withColumn("cap", F.col("close") * F.col("trades") * 100).drop("_d")


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of users from events."""
    ev = _table(spark, sf_dir, "events").select("user_id", "ts", "value", "props")
    vol = F.get_json_object("props", "$.k").cast("double")
    bar = (F.floor((F.hour("ts") * 60 + F.minute("ts")) / 5)).cast("int")
    return ev.groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trading_date"), bar.alias("bar")).agg(
        F.avg("value").alias("close"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(vol).alias("vol"), F.sum(F.col("value") * vol).alias("amount")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, bench_weight): suppliers by region, benchmark weight by positive balance."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    w = F.greatest(F.col("s_acctbal"), F.lit(0.0))
    total = s.agg(F.sum(w).alias("_t"))
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .join(F.broadcast(total))
        .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"), (w / F.col("_t")).alias("bench_weight"))
    )
