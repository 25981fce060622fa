"""Genetic programming over formulas: seeded on the driver, one Spark job a generation.

Trees, crossover, mutation and selection are small and live on the driver. All new formulas of a generation are
compiled into one plan, and one aggregate returns the moments of all of them: a few numbers a formula.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import Bin, Call, Col, Neg, Node, Num, children, depth, size, text, walk
from ..plans.compiler import compute
from .backtest import pearson

#: Windows that formulas are made with, and how many new formulas one plan may hold.
WINDOWS = (3, 5, 10, 20)
PLAN_FORMULAS = 40
UNARY = ("abs", "sign", "log", "sqrt", "neg", "cs_rank", "cs_scale")
SERIES = ("ts_mean", "ts_std", "ts_max", "ts_min", "ts_sum", "ts_delay", "ts_delta", "ts_rank", "ts_decay_linear")
PAIRS = ("ts_correlation", "ts_covariance")


@dataclass(frozen=True)
class SearchConfig:
    population: int = 50
    generations: int = 10
    max_depth: int = 5
    tournament: int = 5
    crossover: float = 0.7
    mutation: float = 0.3
    elite: int = 5
    ic_weight: float = 0.5
    ir_weight: float = 0.3
    turnover_weight: float = 0.1
    complexity_weight: float = 0.1
    train_share: float = 0.6
    validation_share: float = 0.2
    seed: int = 42
    seeds: tuple[str, ...] = ()


@dataclass
class Candidate:
    tree: Node
    fitness: float = -math.inf
    ic: float = 0.0
    ir: float = 0.0
    turnover: float = 0.0


@dataclass
class SearchResult:
    best: Candidate
    population: list[Candidate]
    history: list[dict] = field(default_factory=list)


def generate(rng: random.Random, columns: list[str], limit: int, usage: dict[str, float] | None = None) -> Node:
    """A random tree; `usage` weighs functions."""
    if limit <= 1 or rng.random() < 0.25:
        return Col(rng.choice(columns)) if rng.random() < 0.85 else Num(round(rng.uniform(0.5, 5.0), 2))
    names = ["+", "-", "*", "/", *UNARY, *SERIES, *PAIRS]
    name = rng.choices(names, [usage.get(n, 1.0) if usage else 1.0 for n in names])[0]
    sub = lambda: generate(rng, columns, limit - 1, usage)
    if name in "+-*/":
        return Bin(name, sub(), sub())
    if name == "neg":
        return Neg(sub())
    if name in UNARY:
        return Call(name, (sub(),))
    w = Num(float(rng.choice(WINDOWS)))
    return Call(name, (sub(), w)) if name in SERIES else Call(name, (sub(), sub(), w))


def replace(tree: Node, at: int, new: Node) -> Node:
    """tree with its at-th node (in order of walk) replaced."""
    count = -1

    def go(n: Node) -> Node:
        nonlocal count
        count += 1
        if count == at:
            count += size(n) - 1
            return new
        if isinstance(n, Bin):
            left = go(n.left)
            return Bin(n.op, left, go(n.right))
        if isinstance(n, Neg):
            return Neg(go(n.arg))
        if isinstance(n, Call):
            return Call(n.name, tuple(go(a) for a in n.args), n.freq)
        return n

    return go(tree)


def is_window_literal(tree: Node, at: int) -> bool:
    """Whether the node is a literal that sets a window."""
    nodes = list(walk(tree))
    target = nodes[at]
    return isinstance(target, Num) and any(isinstance(n, Call) and n.args and n.args[-1] is target and (n.name in SERIES or n.name in PAIRS) for n in nodes)


def crossover(rng: random.Random, a: Node, b: Node, limit: int) -> Node:
    """A subtree of b in place of one of a."""
    for _ in range(8):
        i, part = rng.randrange(size(a)), rng.choice(list(walk(b)))
        if not is_window_literal(a, i):
            out = replace(a, i, part)
            if depth(out) <= limit:
                return out
    return a


def mutate(rng: random.Random, tree: Node, columns: list[str], limit: int, usage: dict[str, float] | None = None) -> Node:
    """A new subtree, window or function."""
    i = rng.randrange(size(tree))
    n = list(walk(tree))[i]
    if is_window_literal(tree, i):
        return replace(tree, i, Num(float(rng.choice(WINDOWS))))
    if isinstance(n, Call) and n.name in SERIES and rng.random() < 0.5:
        return replace(tree, i, Call(rng.choice(SERIES), n.args))
    out = replace(tree, i, generate(rng, columns, max(1, limit - 2), usage))
    return out if depth(out) <= limit else tree


TEMPLATES = (
    lambda c, v: Bin("-", Num(0.0), Call("ts_correlation", (Call("cs_rank", (c,)), Call("cs_rank", (v,)), Num(10.0)))),
    lambda c, v: Bin("/", Bin("-", c, Call("ts_mean", (c, Num(20.0)))), Call("ts_std", (c, Num(20.0)))),
    lambda c, v: Call("cs_rank", (Call("ts_delta", (c, Num(5.0))),)),
    lambda c, v: Bin("*", Call("sign", (Call("ts_delta", (v, Num(1.0))),)), Neg(Call("ts_delta", (c, Num(1.0))))),
)


def smart_mutation(rng: random.Random, tree: Node, columns: list[str]) -> Node:
    """A known pattern, alone or added to the tree."""
    new = rng.choice(TEMPLATES)(Col(rng.choice(columns)), Col(rng.choice(columns)))
    return new if rng.random() < 0.5 else Bin("+", tree, new)


def shape(n: Node) -> str:
    """A tree with its constants left out."""
    if isinstance(n, Num):
        return "#"
    if isinstance(n, Col):
        return n.name
    head = n.op if isinstance(n, Bin) else "neg" if isinstance(n, Neg) else n.name
    return f"{head}({','.join(map(shape, children(n)))})"


def similarity(a: Node, b: Node) -> float:
    """Twice the shared subtrees (as shapes) over all of both."""
    x, y = [shape(n) for n in walk(a)], [shape(n) for n in walk(b)]
    left = list(y)
    shared = 0
    for s in x:
        if s in left:
            left.remove(s)
            shared += 1
    return 2 * shared / (len(x) + len(y))


def valid(n: Node, limit: int) -> bool:
    """No division by a constant zero, windows of two at least, a column somewhere, depth within the limit."""
    if depth(n) > limit or not any(isinstance(x, Col) for x in walk(n)):
        return False
    for x in walk(n):
        if isinstance(x, Bin) and x.op == "/" and (isinstance(x.right, Num) and abs(x.right.value) < 1e-10 or x.left == x.right):
            return False
        if isinstance(x, Call) and (x.name in SERIES or x.name in PAIRS):
            w = x.args[-1]
            if not isinstance(w, Num) or w.value < (1 if x.name in ("ts_delay", "ts_delta") else 2):
                return False
    return True


def complexity(n: Node) -> float:
    return size(n) + depth(n)


def fitness(ic: float, ir: float, turnover: float, tree: Node, c: SearchConfig) -> float:
    """Weighted IC and IR less turnover and complexity; a tiny IC is penalised and its IR not counted."""
    weak = 0.001
    penalty = (weak - ic) * 100 if ic < weak else 0.0
    busy = 1 - math.exp(-turnover / 0.1)
    k = complexity(tree)
    return c.ic_weight * (ic - penalty) + c.ir_weight * (ir if ic >= weak else 0.0) - c.turnover_weight * busy - c.complexity_weight * (math.log(k) / 10 if k > 1 else 0.0) - size(tree) ** 2 / 1000


def split_dates(df: DataFrame, c: SearchConfig) -> tuple[str, str]:
    """The last dates of the training and validation parts."""
    dates = df.select("trading_date").distinct()
    r = dates.agg(F.sort_array(F.collect_set("trading_date")).alias("d")).first()["d"]
    at = lambda x: str(r[min(len(r) - 1, max(0, int(len(r) * x) - 1))])
    return at(c.train_share), at(c.train_share + c.validation_share)


def evaluate(trees: list[Node], bars: DataFrame, returns: DataFrame, last: str | None = None) -> list[tuple[float, float, float]]:
    """(|IC| mean, IR, turnover of the top fifth) of each tree: one plan and one row of results for PLAN_FORMULAS trees."""
    out = []
    for a in range(0, len(trees), PLAN_FORMULAS):
        some = trees[a : a + PLAN_FORMULAS]
        names = [f"f{i}" for i in range(len(some))]
        df = compute(dict(zip(names, some, strict=True)), bars).join(returns, ["symbol", "trading_date"])
        if last:
            df = df.where(F.col("trading_date") <= F.lit(last).cast("date"))
        w, s = Window.partitionBy("trading_date"), Window.partitionBy("symbol").orderBy("trading_date")
        df = df.withColumns({f"t{i}": F.when(F.col(n).isNotNull(), F.percent_rank().over(w.orderBy(F.col(n).desc_nulls_last())) < 0.2) for i, n in enumerate(names)})
        df = df.withColumns({f"b{i}": F.lag(f"t{i}").over(s) for i in range(len(names))})
        hold = lambda i: F.try_divide(F.sum((F.col(f"t{i}") & F.col(f"b{i}")).cast("int")), F.sum((F.col(f"t{i}") | F.col(f"b{i}")).cast("int")))
        daily = df.groupBy("trading_date").agg(*[pearson(F.col(n), F.col("fwd_ret"), 2).alias(f"c{i}") for i, n in enumerate(names)], *[hold(i).alias(f"h{i}") for i in range(len(names))])
        aggs = [x for i in range(len(names)) for x in (F.avg(f"c{i}").alias(f"m{i}"), F.stddev_samp(f"c{i}").alias(f"s{i}"), F.avg(f"h{i}").alias(f"u{i}"))]
        r = daily.agg(*aggs).first()
        for i in range(len(names)):
            m, d, u = r[f"m{i}"], r[f"s{i}"], r[f"u{i}"]
            out.append((abs(m), abs(m) / d if d and d > 1e-12 else 0.0, 1 - u if u is not None else 1.0) if m is not None else (math.nan, 0.0, 1.0))
    return out


def search(bars: DataFrame, returns: DataFrame, columns: list[str], config: SearchConfig | None = None, usage: dict[str, float] | None = None) -> SearchResult:
    """Evolve formulas over bars; returns is (symbol, trading_date, fwd_ret). The same seed gives the same result."""
    from ..plans.parser import parse

    c = config or SearchConfig()
    rng, known, history = random.Random(c.seed), {}, []
    last = split_dates(bars, c)[0]
    trees = [parse(s) for s in c.seeds]
    while len(trees) < c.population:
        t = generate(rng, columns, c.max_depth, usage)
        if valid(t, c.max_depth):
            trees.append(t)
    population: list[Candidate] = []
    for generation in range(c.generations):
        new = [t for t in dict.fromkeys(trees) if text(t) not in known]
        for t, (ic, ir, turn) in zip(new, evaluate(new, bars, returns, last), strict=True):
            known[text(t)] = Candidate(t, -1e6 if math.isnan(ic) else fitness(ic, ir, turn, t, c), 0.0 if math.isnan(ic) else ic, ir, turn)
        population = sorted((known[text(t)] for t in trees), key=lambda x: (-x.fitness, text(x.tree)))
        history.append({"generation": generation, "best": population[0].fitness, "formula": text(population[0].tree)})
        families: dict[str, int] = {}
        for x in population:
            families[shape(x.tree)] = families.get(shape(x.tree), 0) + 1

        def pick(population=population, families=families) -> Node:  # noqa: ANN001
            group = rng.sample(population, min(c.tournament, len(population)))
            return max(group, key=lambda x: x.fitness - 0.01 * (families[shape(x.tree)] - 1)).tree

        trees = [x.tree for x in population[: c.elite]]
        for _ in range(100 * c.population):
            if len(trees) >= c.population:
                break
            t = crossover(rng, pick(), pick(), c.max_depth) if rng.random() < c.crossover else pick()
            if rng.random() < c.mutation:
                t = smart_mutation(rng, t, columns) if rng.random() < 0.2 else mutate(rng, t, columns, c.max_depth, usage)
            if valid(t, c.max_depth) and t not in trees:
                trees.append(t)
        while len(trees) < c.population:
            trees.append(generate(rng, columns, c.max_depth, usage))
    return SearchResult(population[0], population, history)
