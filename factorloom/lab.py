"""The workbench: register formulas, compute panels, backtest, combine, optimise and search, with cached inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.elementwise import define
from .operators import backtest, optimize, prices, search, strategies
from .plans.ast import Node
from .plans.compiler import compute
from .plans.parser import parse
from .plans.pipeline import cross_section
from .sources.filters import parse_prefilter


class Pool:
    """Kept DataFrames under a policy: all, recent (one), n (the n last used), none, budget (planned bytes, last used first)."""

    def __init__(self, policy: str = "all", n: int = 3, budget: int | None = None) -> None:
        if policy not in ("all", "recent", "n", "none", "budget"):
            raise ValueError(f"unknown policy {policy}")
        self.limit = {"all": None, "recent": 1, "n": n, "none": 0, "budget": None}[policy]
        self.budget = budget if policy == "budget" else None
        self.kept: dict[str, DataFrame] = {}

    @staticmethod
    def planned_bytes(df: DataFrame) -> int:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)  # the last used is the last
            return self.kept[key]
        df = make()
        if self.limit == 0:
            return df
        self.kept[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.kept) > 1 and (self.limit is not None and len(self.kept) > self.limit or self.budget is not None and sum(map(self.planned_bytes, self.kept.values())) > self.budget):
            self.kept.pop(next(iter(self.kept))).unpersist()
        return self.kept[key]

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


@dataclass
class Lab:
    """Daily bars (with cap), optional intraday bars, and the settings of a study."""

    daily: DataFrame
    intraday: DataFrame | None = None
    config: backtest.BacktestConfig = field(default_factory=backtest.BacktestConfig)
    search_config: search.SearchConfig = field(default_factory=search.SearchConfig)
    pool: Pool = field(default_factory=Pool)
    compat: bool = False
    reset: str | None = None  # "year": windows start anew each year
    formulas: dict[str, Node] = field(default_factory=dict)
    prefilter: str = ""

    def set_filter(self, text: str) -> None:
        """A pre-filter of the bars; cached inputs are dropped."""
        parse_prefilter(text)
        self.prefilter = text
        self.pool.clear()

    def set_duration(self, start: str, end: str) -> None:
        self.set_filter(f"{start}:{end}")

    def register(self, name: str, formula: str) -> None:
        self.formulas[name] = parse(formula)

    def define(self, name: str, arguments: int, f: Callable[..., Column]) -> None:
        """A function of one's own for formulas."""
        define(name, arguments, f)

    def unregister(self, name: str) -> None:
        self.formulas.pop(name)

    def list(self) -> list[str]:
        return sorted(self.formulas)

    def bars(self) -> DataFrame:
        return self.daily.where(parse_prefilter(self.prefilter)) if self.prefilter else self.daily

    def grid(self) -> DataFrame:
        return self.pool.get("grid", lambda: prices.price_grid(self.bars()))

    def values(self, names: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """symbol, trading_date and a column a factor."""
        trees = {n: self.formulas[n] for n in names or self.list()}
        daily = self.bars()
        if self.reset != "year":
            return compute(trees, daily, self.intraday, keep, self.compat)
        # a year is part of the symbol, so that no window reaches over it
        split = lambda df: df.withColumn("symbol", F.struct(F.col("symbol"), F.year("trading_date").alias("y")))
        out = compute(trees, split(daily), split(self.intraday) if self.intraday is not None else None, keep, self.compat)
        return out.withColumn("symbol", F.col("symbol.symbol"))

    def calc(self, names: list[str] | None = None) -> DataFrame:
        """The factor panel after the per-date pipeline."""
        names = names or self.list()
        return cross_section(self.values(names, ("cap",)), names, bins=self.config.quantiles)

    def run_bt(self, names: list[str] | None = None) -> backtest.BacktestResult:
        return backtest.run_with_qcut(self.calc(names).withColumn("value", F.col("cap_neued")), self.grid(), self.config)

    def tear_sheet(self, name: str) -> dict[str, DataFrame]:
        """Everything about one factor: group curves with the long-short one, ICs, group ICs, daily returns, metrics."""
        out = self.run_bt([name])
        ls = backtest.nav(out.daily, "ls_ret", ("factor",)).select("factor", "trading_date", F.lit(0).alias("grp"), F.col("ls_ret").alias("ret"), "nv")
        return {"nav": out.nav.select("factor", "trading_date", "grp", "ret", "nv").unionByName(ls), "ic": out.ic, "group_ic": out.group_ic, "daily": out.daily, "metrics": out.metrics}

    def evaluate(self, names: list[str] | None = None) -> DataFrame:
        return backtest.run_ic(self.calc(names).withColumn("value", F.col("cap_neued")), self.grid())

    def backtest_each(self, batch: int = 20, on_error: Callable[[list[str], Exception], None] | None = None):  # noqa: ANN201
        """Metrics of all factors, batch after batch, so that a plan stays small; a failing batch is reported and skipped if on_error is given."""
        names = self.list()
        for a in range(0, len(names), batch):
            try:
                yield self.run_bt(names[a : a + batch]).metrics
            except Exception as e:
                if on_error is None:
                    raise
                on_error(names[a : a + batch], e)

    def wide(self, names: list[str] | None = None) -> DataFrame:
        """Factors beside forward returns."""
        return self.values(names).join(self.grid().select("symbol", "trading_date", "fwd_ret"), ["symbol", "trading_date"])

    def run_strategy(self, config: dict, names: list[str] | None = None) -> DataFrame:
        names = names or self.list()
        return strategies.combine(self.wide(names), names, config)

    def run_multi(self, names: list[str] | None = None) -> backtest.BacktestResult:
        return backtest.run_multi(self.calc(names).withColumn("value", F.col("cap_neued")), self.grid(), self.config)

    def run_opt(self, signal: DataFrame, kind: str = "max_sharpe", **options) -> DataFrame:  # noqa: ANN003
        rows = signal.join(self.grid().select("symbol", "trading_date", "fwd_ret"), ["symbol", "trading_date"]).withColumn("portfolio", F.lit(kind))
        return optimize.optimise(rows, kind, **options)

    def run_gp(self, columns: list[str], usage: dict[str, float] | None = None) -> search.SearchResult:
        return search.search(self.bars(), self.grid().select("symbol", "trading_date", "fwd_ret"), columns, self.search_config, usage)
