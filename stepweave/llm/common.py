"""What the operators share: where to keep intermediate tables, and batches of rows."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm import textnp
from stepweave.session import new_path, shared_dir  # noqa: F401

#: Rows of a long key that may be broadcast; beyond it a shuffled join does the same.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are handled at once in a Python worker; a longer text is handled alone.
BATCH_CHARS = 1_000_000
#: The texts' name on the way to Python.
TEXT = "text"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quoted(name: str) -> Column:
    """The column of just this name, whatever it has in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, made: Iterable[str]) -> list[str]:
    """df's columns without those that made ones of the same name, in whatever case, replace."""
    gone = {n.lower() for n in made}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has in any case: name, with underscores before it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = "_" + name
    return name


def whole_id(name: str) -> Column:
    """An id as a number; what is none counts as null."""
    return quoted(name).try_cast("long")


def carried(docs: DataFrame, text_col: str, stay: list[str], *more: Column) -> tuple[DataFrame, list[str]]:
    """The texts (TEXT) and the columns stay under names of their own, and these; a text that stays is there once."""
    names = [TEXT if c.lower() == text_col.lower() and docs.schema[c].dataType == T.StringType() else f"c{k}" for k, c in enumerate(stay)]
    return docs.select(quoted(text_col).cast("string").alias(TEXT), *more, *[quoted(c).alias(n) for c, n in zip(stay, names, strict=True) if n != TEXT]), names


#: What this worker keeps from task to task, by the kind of task.
_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return _KEPT.setdefault(kind, {})


def task_begins(kind: str = "") -> None:
    """Called as a task begins in a worker, which may have run other kinds of tasks: what those kept goes."""
    old = [k for k, x in _KEPT.items() if x and k != kind]
    for k in old:
        _KEPT[k].clear()
    if old:
        release()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, kind: str = "") -> DataFrame:
    """df.mapInArrow; its workers give memory back after each task, since they stay for the next ones."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_begins(kind)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def release() -> None:
    """Gives unused memory back to the system."""
    textnp.forget()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def fits(ids: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ids has at most limit rows; it stops counting beyond that."""
    return ids.limit(limit + 1).count() <= limit


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose key is (left_anti: isn't) in the one column of ids, which are integers. ids is broadcast only if it is small."""
    ids = ids.select(quoted(ids.columns[0]).alias(name := unused(df, "sought")))
    return df.join(F.broadcast(ids) if fits(ids) else ids, whole_id(key) == F.col(name), how)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about so many bytes of text at most, a row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist() if n else []
        begin = size = 0
        for i, x in enumerate(sizes):
            if i > begin and (size + x > chars or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += x
        yield batch.slice(begin, n - begin)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = TEXT) -> list[str | None]:
    return column(batch, name).to_pylist()
