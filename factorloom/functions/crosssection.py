"""Per-date functions. Each is a list of steps; a step is a set of columns that may use window functions over the
columns of the steps before, since windows can't nest. Functions that are run together share their steps' windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Steps = tuple[list[dict[str, Column]], Column]
MIN_PAIRS = 10


def by_date(*more: str) -> WindowSpec:
    return Window.partitionBy("trading_date", *more)


def rank0(x: Column, *more: str) -> Column:
    """Average-tie rank from 0 among the values of the date; NULL for a missing one."""
    order = Window.partitionBy("trading_date", *more).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy("trading_date", *more, x))
    return F.when(x.isNotNull(), F.rank().over(order) - 1 + (ties - 1) / 2)


def cs_rank(x: Column, p: str) -> Steps:
    return [{f"{p}a": x}, {f"{p}r": rank0(F.col(f"{p}a")) / F.count(f"{p}a").over(by_date())}], F.col(f"{p}r")


def cs_scale(x: Column, p: str) -> Steps:
    w, v = by_date(), F.col(f"{p}a")
    s = F.stddev_pop(v).over(w)
    return [{f"{p}a": x}, {f"{p}r": F.when((F.count(v).over(w) >= 2) & (s >= 1e-10), F.try_divide(v - F.avg(v).over(w), s))}], F.col(f"{p}r")


def winsor(x: Column, p: str, k: float = 3.0) -> Steps:
    """Clip to the mean -+ k sample deviations."""
    w, v = by_date(), F.col(f"{p}a")
    m, s = F.avg(v).over(w), F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0))
    return [{f"{p}a": x}, {f"{p}r": F.when(v.isNotNull(), F.least(F.greatest(v, m - k * s), m + k * s))}], F.col(f"{p}r")


def zscore(x: Column, p: str) -> Steps:
    w, v = by_date(), F.col(f"{p}a")
    s = F.stddev_samp(v).over(w)
    return [{f"{p}a": x}, {f"{p}r": F.when(s >= 1e-10, F.try_divide(v - F.avg(v).over(w), s))}], F.col(f"{p}r")


def cap_neu(x: Column, cap: Column, p: str) -> Steps:
    """Residual of x on ln(cap), by its population deviation; x itself with too few pairs or a flat residual."""
    w, v, l = by_date(), F.col(f"{p}x"), F.col(f"{p}l")
    first = {f"{p}v": x, f"{p}x": F.when(cap > 0, x), f"{p}l": F.when((cap > 0) & x.isNotNull(), F.ln(cap))}
    var = F.var_pop(l).over(w)
    beta = F.when(var > 1e-10, F.try_divide(F.covar_pop(v, l).over(w), var)).otherwise(0.0)
    second = {f"{p}e": v - F.avg(v).over(w) - beta * (l - F.avg(l).over(w)), f"{p}n": F.count(l).over(w)}
    e = F.col(f"{p}e")
    s = F.stddev_pop(e).over(w)
    flat = (F.col(f"{p}n") < MIN_PAIRS) | (s <= 1e-10) | s.isNull()
    third = {f"{p}r": F.when(flat, F.col(f"{p}v")).otherwise(F.try_divide(e - F.avg(e).over(w), s))}
    return [first, second, third], F.col(f"{p}r")


def qcut(x: Column, p: str, bins: int = 10) -> Steps:
    steps, r = cs_rank(x, p)
    return steps, F.when(r.isNotNull(), F.least(F.lit(float(bins - 1)), F.floor(r * bins).cast("double")))


def to_percentiles(x: Column, p: str) -> Steps:
    n = F.count(f"{p}a").over(by_date())
    return [{f"{p}a": x}, {f"{p}r": F.when(n > 1, F.try_divide(rank0(F.col(f"{p}a")), n - 1)).when(F.col(f"{p}a").isNotNull(), 0.0)}], F.col(f"{p}r")


def zscore_rows(x: Column, p: str, over: WindowSpec | None = None) -> Steps:
    """Sample deviation; fewer than two values are missing, no deviation is 0."""
    w, v = over if over is not None else by_date(), F.col(f"{p}a")
    s = F.stddev_samp(v).over(w)
    z = F.when(s < 1e-15, 0.0).otherwise(F.try_divide(v - F.avg(v).over(w), s))
    return [{f"{p}a": x}, {f"{p}r": F.when(v.isNotNull() & (F.count(v).over(w) >= 2), z)}], F.col(f"{p}r")


def zscore_cols(x: Column, p: str) -> Steps:
    return zscore_rows(x, p, Window.partitionBy("symbol"))


#: name -> (series arguments, has a literal of bins, function)
CROSS_SECTION: dict[str, tuple[int, bool, Callable[..., Steps]]] = {
    "cs_rank": (1, False, cs_rank),
    "cs_scale": (1, False, cs_scale),
    "winsor": (1, False, winsor),
    "zscore": (1, False, zscore),
    "cap_neu": (2, False, cap_neu),
    "qcut": (1, True, qcut),
    "to_percentiles": (1, False, to_percentiles),
    "zscore_rows": (1, False, zscore_rows),
    "zscore_cols": (1, False, zscore_cols),
}
