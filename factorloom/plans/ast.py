"""Formula trees, their simplification, and the advisory algebra of dimensions."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """A formula."""


@dataclass(frozen=True)
class Num(Node):
    value: float


@dataclass(frozen=True)
class Col(Node):
    name: str
    freq: str = "1d"


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Neg(Node):
    arg: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    freq: str | None = None  # set for aggregates of a finer frequency


def children(n: Node) -> tuple[Node, ...]:
    return (n.left, n.right) if isinstance(n, Bin) else (n.arg,) if isinstance(n, Neg) else n.args if isinstance(n, Call) else ()


def walk(n: Node):  # noqa: ANN201
    yield n
    for c in children(n):
        yield from walk(c)


def size(n: Node) -> int:
    return sum(1 for _ in walk(n))


def depth(n: Node) -> int:
    return 1 + max((depth(c) for c in children(n)), default=0)


def columns(n: Node) -> set[tuple[str, str]]:
    return {(x.freq, x.name) for x in walk(n) if isinstance(x, Col)}


def text(n: Node) -> str:
    """A formula that parses to the same tree."""
    if isinstance(n, Num):
        return repr(n.value)
    if isinstance(n, Col):
        return n.name if n.freq == "1d" else f"{n.freq}:{n.name}"
    if isinstance(n, Neg):
        return f"-({text(n.arg)})"
    if isinstance(n, Bin):
        return f"({text(n.left)} {n.op} {text(n.right)})"
    return f"{n.freq + ':' if n.freq else ''}{n.name}({', '.join(map(text, n.args))})"


def simplify(n: Node) -> Node:
    """Fold constants and neutral elements. x*0 and x-x stay: they must keep missing values missing."""
    if isinstance(n, Neg):
        a = simplify(n.arg)
        return Num(-a.value) if isinstance(a, Num) else a.arg if isinstance(a, Neg) else Neg(a)
    if isinstance(n, Call):
        return Call(n.name, tuple(map(simplify, n.args)), n.freq)
    if not isinstance(n, Bin):
        return n
    a, b = simplify(n.left), simplify(n.right)
    if isinstance(a, Num) and isinstance(b, Num):
        if n.op == "+":
            return Num(a.value + b.value)
        if n.op == "-":
            return Num(a.value - b.value)
        if n.op == "*":
            return Num(a.value * b.value)
        if n.op == "/" and abs(b.value) >= 1e-10:
            return Num(a.value / b.value)
    if b == Num(0.0) and n.op in "+-":
        return a
    if a == Num(0.0) and n.op == "+":
        return b
    if b == Num(1.0) and n.op in "*/":
        return a
    if a == Num(1.0) and n.op == "*":
        return b
    return Bin(n.op, a, b)


#: Dimension by part of a column's name, first match.
DIMENSION_WORDS = (
    ("ret", "return"), ("pct", "return"), ("change", "return"), ("turnover", "ratio"), ("ratio", "ratio"), ("yield", "ratio"), ("pe", "ratio"), ("pb", "ratio"), ("ps", "ratio"),
    ("amount", "amount"), ("cap", "amount"), ("vol", "volume"), ("shares", "volume"), ("close", "price"), ("open", "price"), ("high", "price"), ("low", "price"), ("vwap", "price"), ("price", "price"), ("limit", "price"),
)
FACTOR_DIMENSIONS = frozenset(("ratio", "dimensionless", "return"))


def dimension(n: Node) -> str:
    """Advisory: price, volume, amount, return, ratio, dimensionless or unknown."""
    if isinstance(n, Num):
        return "dimensionless"
    if isinstance(n, Col):
        if n.name == "vwap":
            return "price"
        low = n.name.lower()
        return next((d for w, d in DIMENSION_WORDS if (w in low.split("_") if len(w) == 2 else w in low)), "unknown")
    if isinstance(n, Neg):
        return dimension(n.arg)
    if isinstance(n, Bin):
        a, b = dimension(n.left), dimension(n.right)
        if n.op in "+-":
            return a if a == b or b == "dimensionless" else b if a == "dimensionless" else "unknown"
        if n.op == "/":
            return "ratio" if a == b else a if b in ("dimensionless", "ratio") else "price" if (a, b) == ("amount", "volume") else "unknown"
        plain = ("dimensionless", "ratio")
        return a if b in plain else b if a in plain else "amount" if {a, b} == {"price", "volume"} else "unknown"
    keep = ("ts_mean", "ts_sum", "ts_max", "ts_min", "ts_std", "ts_delay", "ts_delta", "ts_sma", "ts_wma", "ts_decay_linear", "ts_quantile", "abs", "min", "max", "winsor", "sum", "mean", "std")
    return dimension(n.args[0]) if n.name in keep and n.args else "return" if n.name == "returns" else "dimensionless"


def is_factor(n: Node) -> bool:
    return dimension(n) in FACTOR_DIMENSIONS
