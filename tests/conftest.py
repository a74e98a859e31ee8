"""One small session for all tests, and makers of steps."""

from __future__ import annotations

import os
import sys
from pathlib import Path
from typing import Any

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from stepweave.session import local_session, ship

    s = ship(local_session(4, 4, "4g"))
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(df: Any) -> list[tuple[str, ...]]:
    """Rows of a pandas frame as sorted texts, columns by name."""

    def text(x: Any) -> str:
        if hasattr(x, "tolist") and not isinstance(x, (str, float, int)):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(text, x)) + "]"
        if x is None or str(x) in ("NaT", "<NA>", "nan"):
            return "null"
        if isinstance(x, (float, int)) and not isinstance(x, bool):
            return f"{x:.4f}".rstrip("0").rstrip(".") if x else "0"  # a column of integers with nulls is one of floats
        return str(x)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql: str, some: bool = True) -> None:
        mine, theirs = query(spark, DATA).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert canonical(mine) == canonical(theirs)
        assert len(mine) or not some

    return check


@pytest.fixture
def make_steps(spark):
    """make(episodes): episodes are lists of dicts; what a dict lacks has an ordinary value."""
    from stepweave.sources.schema import STEPS

    def make(*episodes: list[dict[str, Any]], ids: list[str] | None = None):
        rows = []
        for e, steps in enumerate(episodes):
            for i, s in enumerate(steps):
                last = i == len(steps) - 1
                base = {"episode_id": ids[e] if ids else f"e{e}", "dataset_id": "d", "episode_index": e, "step_index": i, "is_first": i == 0, "is_last": last, "is_terminal": last, "timestamp": i * 0.1, "action": None if last else [0.0] * 7, "reward": 0.0, "discount": 1.0, "observation": {}}
                rows.append({k: (base | s)[k] for k in base})
        return spark.createDataFrame([tuple(r.values()) for r in rows], STEPS)

    return make


def value(num: list[float] | None = None, dtype: str = "float32", shape: list[int] | None = None, text: str | None = None, data: bytes | None = None) -> tuple:
    return (dtype if text is None else "string", shape if shape is not None else [len(num or [])], num, data, text)


@pytest.fixture(scope="session")
def observe():
    return value
