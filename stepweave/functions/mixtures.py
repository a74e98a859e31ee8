"""Mixtures of data sets: weights and filters, kept as YAML."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.hashing import mixture


@dataclass
class Part:
    name: str
    weight: float = 1.0
    filter: dict[str, Any] = field(default_factory=dict)  # criteria of an index query


@dataclass
class Mixture:
    name: str
    datasets: list[Part]
    seed: int = 42

    @classmethod
    def of(cls, weights: Iterable[tuple[str, float]], name: str = "mixture", seed: int = 42) -> Mixture:
        return cls(name, [Part(n, w) for n, w in weights], seed)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Mixture:
        import yaml

        d = yaml.safe_load(Path(path).read_text())
        return cls(d["name"], [Part(x["name"], x.get("weight", 1.0), x.get("filter") or {}) for x in d["datasets"]], d.get("seed", 42))

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self)))

    def sample(self, index: DataFrame, dataset: str = "dataset_name", key: str = "episode_id") -> DataFrame:
        """The index's rows that the parts' filters take, in shares as their weights are (see hashing.mixture)."""
        from stepweave.operators.index import Query

        takes = [(F.col(dataset) == p.name) & Query(**p.filter).condition() for p in self.datasets]
        return mixture(index.where(reduce(lambda a, b: a | b, takes)), {p.name: p.weight for p in self.datasets}, dataset, key, self.seed)
