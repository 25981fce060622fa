"""Rolling functions over the last w present rows of a symbol, the current one included; short windows emit.

Each takes columns and literals and gives one expression of window functions over one frame, so that all functions
of a stage share a shuffle and a sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Name of the row number by symbol that place-based functions use.
ROW = "_rn"
DEFAULT_WINDOW = 20


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trading_date")


def frame(w: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(w - 1), 0)


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def ts_mean(x: Column, w: int) -> Column:
    return F.avg(x).over(frame(w))


def ts_sum(x: Column, w: int) -> Column:
    over = frame(w) if w else by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.sum(x).over(over), F.lit(0.0))


def ts_count(x: Column, w: int) -> Column:
    return F.count(x).over(frame(w)).cast("double")


def ts_max(x: Column, w: int) -> Column:
    return F.max(x).over(frame(w))


def ts_min(x: Column, w: int) -> Column:
    return F.min(x).over(frame(w))


def ts_std(x: Column, w: int) -> Column:
    """Population deviation of at least two values."""
    return F.when(F.count(x).over(frame(w)) >= 2, F.stddev_pop(x).over(frame(w)))


def ts_rank(x: Column, w: int) -> Column:
    """Share of the rows of the window with a smaller value; 0 where the current value is missing."""
    values = F.collect_list(x).over(frame(w))
    below = F.size(F.filter(values, lambda v: v < x))
    return F.when(x.isNotNull(), below / F.count(F.lit(1)).over(frame(w))).otherwise(0.0)


def _place(x: Column, w: int, largest: bool, earliest: bool) -> Column:
    """Row number of the extreme of the window."""
    rn = F.col(ROW)
    tie = -rn if largest == earliest else rn
    key = F.when(x.isNotNull(), F.struct(x.alias("v"), tie.alias("t")))
    return (F.max_by(rn, key) if largest else F.min_by(rn, key)).over(frame(w))


def ts_argmax(x: Column, w: int) -> Column:
    return (F.col(ROW) - _place(x, w, True, True) + 1).cast("double")


def ts_argmin(x: Column, w: int) -> Column:
    return (F.col(ROW) - _place(x, w, False, True) + 1).cast("double")


def ts_lowday(x: Column, w: int) -> Column:
    return (F.col(ROW) - _place(x, w, False, True)).cast("double")


def ts_highday(x: Column, w: int) -> Column:
    return (F.col(ROW) - _place(x, w, True, False)).cast("double")


def ts_correlation(x: Column, y: Column, w: int) -> Column:
    """Pearson over complete pairs, from moments: the built-in one raises on a constant side."""
    x, y = _both(x, y)
    over = frame(w)
    n = F.count(x).over(over)
    den = n * F.sqrt(F.var_pop(x).over(over) * F.var_pop(y).over(over))
    return F.when((n >= 2) & (den > 1e-10), F.try_divide(F.covar_pop(x, y).over(over) * n, den))


def ts_covariance(x: Column, y: Column, w: int) -> Column:
    x, y = _both(x, y)
    return F.when(F.count(x).over(frame(w)) >= 2, F.covar_samp(x, y).over(frame(w)))


def ts_wma(x: Column, w: int) -> Column:
    """Weights 0.9 to the age, over the values that are there."""
    values = F.collect_list(F.struct(x.alias("v"))).over(frame(w))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda s, v: F.struct((s["a"] * 0.9 + F.coalesce(v["v"], F.lit(0.0))).alias("a"), (s["b"] * 0.9 + F.when(v["v"].isNotNull(), 1.0).otherwise(0.0)).alias("b"))
    return F.aggregate(values, zero, step, lambda s: F.when(s["b"] > 0, s["a"] / s["b"]))


def ts_product(x: Column, w: int) -> Column:
    return F.product(x).over(frame(w))


def ts_decay_linear(x: Column, w: int) -> Column:
    """Weights 1 (oldest row) to the number of rows."""
    over, rn = frame(w), F.col(ROW)
    before = rn - F.count(F.lit(1)).over(over)
    here = F.when(x.isNotNull(), rn)
    top = F.sum(x * rn).over(over) - before * F.sum(x).over(over)
    return F.try_divide(top, F.sum(here).over(over) - before * F.count(x).over(over))


def ts_delay(x: Column, k: int) -> Column:
    return F.lag(x, k).over(by_symbol())


def ts_delta(x: Column, k: int) -> Column:
    return x - F.lag(x, k).over(by_symbol())


def ts_quantile(x: Column, w: int, q: float = 0.5) -> Column:
    return F.percentile(x, min(1.0, max(0.0, q))).over(frame(w))


def ts_slope(x: Column, w: int) -> Column:
    return F.when(F.count(x).over(frame(w)) >= 2, F.regr_slope(x, F.col(ROW).cast("double")).over(frame(w)))


def ts_rsquare(x: Column, w: int) -> Column:
    """0 in windows of one row, missing where a value of the window is or where all values are equal."""
    over = frame(w)
    rows, n = F.count(F.lit(1)).over(over), F.count(x).over(over)
    return F.when(rows < 2, 0.0).when((n == rows) & (n * F.var_pop(x).over(over) > 1e-12), F.regr_r2(x, F.col(ROW).cast("double")).over(over))


def ts_resi(x: Column, w: int) -> Column:
    """The current value less the fitted line."""
    over, rn = frame(w), F.col(ROW).cast("double")
    fit = F.regr_intercept(x, rn).over(over) + F.regr_slope(x, rn).over(over) * rn
    return F.when(x.isNotNull() & (F.count(x).over(over) >= 2), x - fit)


def returns(x: Column) -> Column:
    before = F.lag(x).over(by_symbol())
    return F.when(before == 0, 0.0).otherwise(F.try_divide(x, before) - 1)


def cumsum(x: Column) -> Column:
    return F.sum(x).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def cumprod(x: Column) -> Column:
    return F.product(x).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


#: name -> (series arguments, kinds of literals: w window, k lag, q share, function)
TIMESERIES: dict[str, tuple[int, str, Callable[..., Column]]] = {
    "ts_mean": (1, "w", ts_mean),
    "ts_sum": (1, "w", ts_sum),
    "ts_count": (1, "w", ts_count),
    "ts_max": (1, "w", ts_max),
    "ts_min": (1, "w", ts_min),
    "ts_std": (1, "w", ts_std),
    "ts_rank": (1, "w", ts_rank),
    "ts_argmax": (1, "w", ts_argmax),
    "ts_argmin": (1, "w", ts_argmin),
    "ts_lowday": (1, "w", ts_lowday),
    "ts_highday": (1, "w", ts_highday),
    "ts_correlation": (2, "w", ts_correlation),
    "ts_covariance": (2, "w", ts_covariance),
    "ts_wma": (1, "w", ts_wma),
    "ts_product": (1, "w", ts_product),
    "ts_decay_linear": (1, "w", ts_decay_linear),
    "ts_delay": (1, "k", ts_delay),
    "ts_delta": (1, "k", ts_delta),
    "ts_quantile": (1, "wq", ts_quantile),
    "ts_slope": (1, "w", ts_slope),
    "ts_rsquare": (1, "w", ts_rsquare),
    "ts_resi": (1, "w", ts_resi),
    "returns": (1, "", returns),
    "cumsum": (1, "", cumsum),
    "cumprod": (1, "", cumprod),
}
NEEDS_ROW = frozenset("ts_argmax ts_argmin ts_lowday ts_highday ts_decay_linear ts_slope ts_rsquare ts_resi".split())
