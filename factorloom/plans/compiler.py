"""Formulas to a staged DataFrame plan.

Windows can't nest, so a formula tree is cut at its window nodes. A node's level is one more than that of the deepest
window node below it; all window nodes of a level, of all formulas, are added in as few selects as their steps need,
time-series ones (partitioned by symbol) before per-date ones. Equal subtrees are made once. Aggregates of a finer
frequency become one groupBy that the daily frame is joined to. Elementwise parts stay inline for code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..functions.crosssection import CROSS_SECTION
from ..functions.ema import alpha, with_ema
from ..functions.groupagg import GROUP
from ..functions.timeseries import DEFAULT_WINDOW, NEEDS_ROW, ROW, TIMESERIES, by_symbol
from .ast import Bin, Call, Col, Neg, Node, Num, children, walk
from .parser import parse

#: Window functions of one select; more would make generated code too large.
BATCH = 40


@dataclass
class Compiler:
    daily: DataFrame | None = None
    intraday: DataFrame | None = None
    keep: tuple[str, ...] = ()
    compat: bool = False  # correlation and covariance over 20 rows whatever the formula says
    made: dict[Node, str] = field(default_factory=dict)

    def compile(self, formulas: dict[str, str | Node]) -> DataFrame:
        """symbol, trading_date, the kept columns, and a column for each formula."""
        trees = {k: parse(v) if isinstance(v, str) else v for k, v in formulas.items()}
        df = self._base(trees)
        levels: dict[int, list[Call]] = {}
        for tree in trees.values():
            for n in walk(tree):
                if self._is_window(n) and n not in self.made:
                    same = levels.setdefault(self._level(n), [])
                    if n not in same:
                        same.append(n)
        if any(n.name in NEEDS_ROW for same in levels.values() for n in same):
            df = df.withColumn(ROW, F.row_number().over(by_symbol()))
        for level in sorted(levels):
            df = self._stage(df, levels[level])
        out = [self.column(tree).cast("double").alias(k) for k, tree in trees.items()]
        return df.select("symbol", "trading_date", *self.keep, *out)

    def _base(self, trees: dict[str, Node]) -> DataFrame:
        groups = list(dict.fromkeys(n for t in trees.values() for n in walk(t) if isinstance(n, Call) and n.freq))
        plain = {n.name for t in trees.values() for n in walk(t) if isinstance(n, Col) and not self._inside_group(t, n)}
        if not groups:
            if self.daily is None:
                raise ValueError("there are no daily bars")
            return self.daily.select("symbol", "trading_date", *sorted((plain | set(self.keep)) - {"symbol", "trading_date"}))
        if self.intraday is None:
            raise ValueError("there are no intraday bars")
        aggs = []
        for i, g in enumerate(groups):
            if any(self._is_window(n) for n in walk(g.args[0])):
                raise ValueError("window functions below a frequency aggregate are not supported")
            aggs.append(GROUP[g.name](self.column(g.args[0])).alias(f"_g{i}"))
        reduced = self.intraday.groupBy("symbol", "trading_date").agg(*aggs)
        self.made |= {g: f"_g{i}" for i, g in enumerate(groups)}
        need = sorted(plain | set(self.keep))
        if not need:
            return reduced
        if self.daily is None:
            raise ValueError("there are no daily bars")
        return reduced.join(self.daily.select("symbol", "trading_date", *need), ["symbol", "trading_date"], "left")

    def _inside_group(self, tree: Node, col: Col) -> bool:
        """Whether every use of the column is below a frequency aggregate."""

        def outside(n: Node) -> bool:
            if n == col:
                return True
            return not (isinstance(n, Call) and n.freq) and any(outside(c) for c in children(n))

        return not outside(tree)

    def _is_window(self, n: Node) -> bool:
        return isinstance(n, Call) and not n.freq and (n.name in TIMESERIES or n.name in CROSS_SECTION or n.name in ("ts_sma", "total"))

    def _level(self, n: Node) -> int:
        below = max((self._level(c) for c in children(n)), default=0)
        return below + 1 if self._is_window(n) and n not in self.made else below

    def _stage(self, df: DataFrame, nodes: list[Call]) -> DataFrame:
        ema = [n for n in nodes if n.name == "ts_sma"]
        series = [n for n in nodes if n.name in TIMESERIES]
        dates = [n for n in nodes if n.name in CROSS_SECTION]
        if totals := [n for n in nodes if n.name == "total"]:  # one row of sums, so no task holds the table
            sums = df.agg(*[F.sum(self.column(n.args[0])).alias(self._name(n)) for n in totals])
            df = df.crossJoin(F.broadcast(sums))
            self.made |= {n: self._name(n) for n in totals}
        for a in range(0, len(series), BATCH):
            cols = {}
            for n in series[a : a + BATCH]:
                cols[self._name(n)] = self._series(n)
            df = df.withColumns(cols)
            self.made |= {n: self._name(n) for n in series[a : a + BATCH]}
        for a in range(0, len(dates), BATCH):
            steps, ends = [], {}
            for n in dates[a : a + BATCH]:
                own, end = self._dates(n)
                ends[self._name(n)] = end
                for k, step in enumerate(own):
                    while len(steps) <= k:
                        steps.append({})
                    steps[k] |= step
            used = [c for step in steps for c in step]
            for step in [*steps, ends]:
                df = df.withColumns(step)
            df = df.drop(*used)
            self.made |= {n: self._name(n) for n in dates[a : a + BATCH]}
        if ema:
            inputs, wanted = {}, {}
            for n in ema:
                name = self._name(n)
                inputs[f"{name}in"] = self.column(n.args[0]).cast("double")
                size, m = self._literal(n.args[1], DEFAULT_WINDOW), self._literal(n.args[2], 2.0) if len(n.args) > 2 else 2.0
                wanted[name] = (f"{name}in", alpha(size, m))
            df = with_ema(df.withColumns(inputs), wanted).drop(*inputs)
            self.made |= {n: self._name(n) for n in ema}
        return df

    def _name(self, n: Node) -> str:
        return self.made.get(n) or f"_n{abs(hash_of(n)):x}"

    def _literal(self, n: Node, default: float) -> float:
        return n.value if isinstance(n, Num) else default

    def _series(self, n: Call) -> Column:
        count, kinds, f = TIMESERIES[n.name]
        xs = [self.column(a) for a in n.args[:count]]
        more = []
        for k, kind in enumerate(kinds):
            given = n.args[count + k] if count + k < len(n.args) else None
            if kind == "q":
                more.append(self._literal(given, 0.5) if given is not None else 0.5)
            else:
                default = 1 if kind == "k" else DEFAULT_WINDOW
                w = round(self._literal(given, default)) if given is not None else default
                more.append(max(1, w) if not (n.name == "ts_sum" and w == 0) else 0)
        if self.compat and n.name in ("ts_correlation", "ts_covariance"):
            more = [DEFAULT_WINDOW]
        return f(*xs, *more)

    def _dates(self, n: Call):  # noqa: ANN202
        p = f"{self._name(n)}_"
        count, literal, f = CROSS_SECTION[n.name]
        xs = [self.column(a).cast("double") for a in n.args[:count]]
        if literal and len(n.args) > count:
            return f(*xs, p, int(self._literal(n.args[count], 10)))
        return f(*xs, p)

    def column(self, n: Node) -> Column:
        """The expression of a node over what has been made so far."""
        if n in self.made:
            return F.col(self.made[n])
        if isinstance(n, Num):
            return F.lit(n.value)
        if isinstance(n, Col):
            return F.col(n.name)
        if isinstance(n, Neg):
            return -self.column(n.arg)
        if isinstance(n, Bin):
            a, b = self.column(n.left), self.column(n.right)
            return a + b if n.op == "+" else a - b if n.op == "-" else a * b if n.op == "*" else E.divide(a, b)
        xs = [self.column(a) for a in n.args]
        if n.name in ("min", "max"):
            return (E.least if n.name == "min" else E.greatest)(*xs)
        if n.name in E.ELEMENTWISE:
            return E.ELEMENTWISE[n.name][1](*xs)
        raise ValueError(f"{n.name} has not been made")


def hash_of(n: Node) -> int:
    """The same in every process."""
    import zlib

    from .ast import text

    t = text(n).encode()
    return zlib.crc32(t) << 32 | zlib.adler32(t)


def compute(formulas: dict[str, str | Node], daily: DataFrame | None = None, intraday: DataFrame | None = None, keep: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    return Compiler(daily, intraday, keep, compat).compile(formulas)
