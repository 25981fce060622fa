"""Stored factors: definitions in TOML, records in JSON, values in Parquet by factor and version; pool and usage statistics."""

from __future__ import annotations

import hashlib
import json
import time
import tomllib
from collections import Counter
from dataclasses import asdict, dataclass, field
from itertools import combinations
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.search import SERIES, similarity
from .plans.ast import Call, Num, dimension, text, walk
from .plans.parser import parse


@dataclass
class FactorFile:
    """A factor definition: name, expression, description, dimension, tags, readonly."""

    name: str
    expression: str
    description: str = ""
    dimension: str = ""
    tags: list[str] = field(default_factory=list)
    readonly: bool = False

    @classmethod
    def load(cls, path: str | Path) -> FactorFile:
        with open(path, "rb") as f:
            d = tomllib.load(f)
        d = d.get("factor", d)
        out = cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})
        out.dimension = out.dimension or dimension(parse(out.expression))
        return out

    def save(self, path: str | Path) -> None:
        if Path(path).exists() and FactorFile.load(path).readonly:
            raise PermissionError(f"{path} is read-only")
        quote = lambda s: json.dumps(s, ensure_ascii=False)
        lines = [f"{k} = {quote(v) if isinstance(v, str | list) else str(v).lower()}" for k, v in asdict(self).items()]
        Path(path).write_text("\n".join(lines) + "\n")


def load_folder(*folders: str | Path) -> dict[str, FactorFile]:
    """All definitions; later folders win."""
    return {f.name: f for d in folders if Path(d).is_dir() for f in (FactorFile.load(p) for p in sorted(Path(d).glob("*.al")))}


class FactorStore:
    """Records in one JSON file, values in a Parquet table partitioned by factor and version."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.file = self.folder / "factors.json"
        self.records: dict[str, dict] = json.loads(self.file.read_text()) if self.file.exists() else {}

    def _write(self) -> None:
        self.file.write_text(json.dumps(self.records, indent=1, sort_keys=True))

    @staticmethod
    def id_of(expression: str) -> str:
        return hashlib.sha256(text(parse(expression)).encode()).hexdigest()

    def register(self, expression: str, metrics: dict | None = None, tags: list[str] | None = None, **more) -> str:  # noqa: ANN003
        key, now = self.id_of(expression), int(time.time())
        old = self.records.get(key, {})
        self.records[key] = {"id": key, "expression": expression, "created_at": old.get("created_at", now), "updated_at": now, "metrics": metrics or old.get("metrics", {}), "tags": tags or old.get("tags", []), "version": old.get("version", 0), **more}
        self._write()
        return key

    def update(self, key: str, **values) -> None:  # noqa: ANN003
        self.records[key] |= values | {"updated_at": int(time.time())}
        self._write()

    def get(self, key: str) -> dict | None:
        return self.records.get(key)

    def delete(self, key: str) -> bool:
        found = self.records.pop(key, None) is not None
        self._write()
        return found

    def list(self) -> list[dict]:
        return sorted(self.records.values(), key=lambda r: r["id"])

    def search(self, words: str = "", tag: str | None = None, least_ic: float | None = None) -> list[dict]:
        return [r for r in self.list() if words.lower() in r["expression"].lower() and (tag is None or tag in r["tags"]) and (least_ic is None or abs(r["metrics"].get("ic_mean", 0.0)) >= least_ic)]

    def export(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.list(), indent=1))

    def load(self, path: str | Path) -> int:
        rows = json.loads(Path(path).read_text())
        self.records |= {r["id"]: r for r in rows}
        self._write()
        return len(rows)

    def write_values(self, key: str, values: DataFrame) -> int:
        """(symbol, trading_date, value) as a new version."""
        version = self.records[key]["version"] + 1
        values.select("symbol", "trading_date", "value").write.mode("overwrite").parquet(f"{self.folder}/values/factor_id={key}/version={version}")
        self.update(key, version=version)
        return version

    def read_values(self, spark: SparkSession, key: str, version: int | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/values/factor_id={key}/version={version or self.records[key]['version']}")

    def table(self, spark: SparkSession) -> DataFrame:
        """Records as a table."""
        rows = [(r["id"], r["expression"], float(r["metrics"].get("ic_mean", 0.0)), float(r["metrics"].get("ic_ir", 0.0)), float(r["metrics"].get("turnover", 0.0)), r["tags"]) for r in self.list()]
        return spark.createDataFrame(rows, "id string, expression string, ic_mean double, ic_ir double, turnover double, tags array<string>")


@dataclass
class FactorPool:
    """Factors kept by rank IC: near copies are rejected, similar ones flagged, the worst goes when it is full."""

    max_size: int = 100
    reject: float = 0.95
    flag: float = 0.80
    entries: list[dict] = field(default_factory=list)

    def admit(self, expression: str, ic: float, rank_ic: float) -> str:
        tree = parse(expression)
        near = max((similarity(tree, parse(e["expression"])) for e in self.entries), default=0.0)
        if near >= self.reject:
            return "duplicate"
        if len(self.entries) >= self.max_size:
            if rank_ic <= self.entries[-1]["rank_ic"]:
                return "below_minimum"
            self.entries.pop()
        self.entries.append({"expression": expression, "ic": ic, "rank_ic": rank_ic, "survived": 0})
        self.entries.sort(key=lambda e: -e["rank_ic"])
        return "flagged" if near >= self.flag else "added"

    def round(self, decayed: set[str]) -> None:
        """One more round: decayed factors go, the rest survive."""
        self.entries = [e | {"survived": e["survived"] + 1} for e in self.entries if e["expression"] not in decayed]


def usage(records: list[dict], top: float = 0.3) -> dict[str, float]:
    """How often good factors (by |IC|) use a function against all factors; weights for the search."""
    ranked = sorted(records, key=lambda r: -abs(r["metrics"].get("ic_mean", 0.0)))
    count = lambda rows: Counter(n.name for r in rows for n in walk(parse(r["expression"])) if isinstance(n, Call))
    good, all_ = count(ranked[: max(1, int(len(ranked) * top))]), count(ranked)
    total_good, total_all = max(1, sum(good.values())), max(1, sum(all_.values()))
    return {k: (good[k] + 1) / (total_good + len(all_)) / ((v + 1) / (total_all + len(all_))) for k, v in all_.items()}


def pattern(expression: str) -> str:
    """momentum, reversion, volatility, volume_price, cross_section or other."""
    tree = parse(expression)
    names = {n.name for n in walk(tree) if isinstance(n, Call)}
    cols = {n.name for n in walk(tree) if hasattr(n, "freq") and not isinstance(n, Call)}
    if names & {"ts_correlation", "ts_covariance"} and "vol" in cols:
        return "volume_price"
    if names & {"ts_std"}:
        return "volatility"
    if names & {"ts_delta", "ts_delay", "returns"}:
        return "reversion" if text(tree).startswith("-(") else "momentum"
    if names & {"cs_rank", "cs_scale", "zscore"}:
        return "cross_section"
    return "other"


def analyse(records: list[dict]) -> dict:
    """Usage, co-occurrence, patterns, windows, correlations of size and IC, and advice with a confidence that grows with the records."""
    trees = [parse(r["expression"]) for r in records]
    functions = [sorted({n.name for n in walk(t) if isinstance(n, Call)}) for t in trees]
    windows = Counter(int(n.args[-1].value) for t in trees for n in walk(t) if isinstance(n, Call) and n.name in SERIES and isinstance(n.args[-1], Num))
    weights = usage(records) if records else {}
    return {
        "usage": Counter(f for fs in functions for f in fs),
        "pairs": Counter(p for fs in functions for p in combinations(fs, 2)),
        "patterns": Counter(pattern(r["expression"]) for r in records),
        "windows": windows,
        "weights": weights,
        "recommended": sorted((k for k, v in weights.items() if v > 1.0), key=lambda k: -weights[k]),
        "confidence": 1 - 1 / (1 + len(records) / 20),
    }


def correlations(table: DataFrame) -> DataFrame:
    """Correlations of the records' figures."""
    from .operators.backtest import pearson

    return table.agg(pearson(F.abs("ic_mean"), F.abs("ic_ir")).alias("ic_ir"), pearson(F.abs("ic_mean"), F.col("turnover")).alias("ic_turnover"), pearson(F.abs("ic_mean"), F.length("expression").cast("double")).alias("ic_length"))
