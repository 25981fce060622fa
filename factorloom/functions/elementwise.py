"""Elementwise functions of the formula language as JVM column expressions. NULL is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.bars import finite

#: Divisors nearer to zero than this give a missing value; equality has the same tolerance.
TINY = 1e-10


def divide(n: Column, d: Column) -> Column:
    return F.when(F.abs(d) >= TINY, F.try_divide(n, d))


def modulo(n: Column, d: Column) -> Column:
    return F.when(F.abs(d) >= TINY, F.try_mod(n, d))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a comparison with a missing value is false."""
    return F.when(condition, 1.0).otherwise(0.0)


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def pick(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def safe_pow(x: Column, n: Column) -> Column:
    return finite(F.pow(x, n))


#: name -> (number of arguments, function of columns)
ELEMENTWISE: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "sign": (1, sign),
    "log": (1, lambda x: F.when(x > 0, F.ln(x))),
    "log10": (1, lambda x: F.when(x > 0, F.log10(x))),
    "sqrt": (1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "exp": (1, lambda x: finite(F.exp(x))),
    "neg": (1, lambda x: -x),
    "not": (1, lambda x: flag(x == 0)),
    "power": (2, safe_pow),
    "mod": (2, modulo),
    "and": (2, lambda a, b: flag((a != 0) & (b != 0))),
    "or": (2, lambda a, b: flag((a != 0) | (b != 0))),
    "if": (3, lambda c, a, b: pick(c > 0, a, b)),
    "gt": (2, lambda a, b: flag(a > b)),
    "lt": (2, lambda a, b: flag(a < b)),
    "ge": (2, lambda a, b: flag(a >= b)),
    "le": (2, lambda a, b: flag(a <= b)),
    "eq": (2, lambda a, b: flag(F.abs(a - b) < TINY)),
    "ne": (2, lambda a, b: flag(F.abs(a - b) >= TINY)),
    "quesval": (4, lambda t, x, a, b: pick(x > t, a, b)),
    "quesval2": (4, lambda x, y, a, b: pick(x > y, a, b)),
}


def define(name: str, arguments: int, f: Callable[..., Column]) -> None:
    """Add a function of one's own to the language: columns in, column out (a pandas UDF's result will do)."""
    low = name.lower()
    if low in BUILT_IN:
        raise ValueError(f"{name} is built in")
    ELEMENTWISE[low] = (arguments, f)


BUILT_IN = frozenset(ELEMENTWISE) | {"min", "max", "sum"}


def least(*xs: Column) -> Column:
    """The smallest value that is there."""
    return xs[0] if len(xs) == 1 else F.least(*xs)


def greatest(*xs: Column) -> Column:
    return xs[0] if len(xs) == 1 else F.greatest(*xs)
