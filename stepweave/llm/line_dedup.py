"""Removal of lines that are found on many sites.

Each line's hash gets a HyperLogLog sketch of the sites that have it; sketches of the same line merge in the aggregation,
so that only one small row a line and task is shuffled. Lines whose estimate is clearly below or above the threshold are
decided by it; those near it get an exact distinct count. A line that reaches the threshold stays where it comes first
(smallest doc_id, then place) and goes everywhere else.

Lines are compared by a 64-bit hash of their text without outer spaces. Lines of fewer than min_chars characters, blank
ones included, always stay.

Defined cases: null text, null doc_id or one that is no integer: the row stays as it is and its lines don't count. Null
site: a site of its own. Rows of the same doc_id are one document: a line that comes first there stays in each of them. Of
equal lines in one document the first place is first. A text that loses all its lines becomes empty; no row goes. Very long
texts: whole. Empty tables: no rows. Other columns stay, whatever they are called; one that is called as the count of
removed lines, in whatever case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import BROADCAST_ROWS, TEXT, column, cut, fits, map_arrow, others, quoted, semi, slices, texts_of, whole_id

LG_K = 12
#: Three standard errors of a sketch of 2**12 registers.
MARGIN = 0.05


def _key(line: Column | str) -> Column:
    return F.xxhash64(F.trim(line))


def lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """key, site, id, place of each line that counts."""
    rows = docs.select(whole_id(id_col).alias("id"), F.coalesce(quoted(site_col).cast("string"), F.lit("\0")).alias("site"), quoted(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    each = rows.select("id", "site", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return each.where(F.length(F.trim("line")) >= min_chars).select(_key("line").alias("key"), "site", "id", "place")


def spread_lines(docs: DataFrame, min_sites: int = 3, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """key, id, place: of each line that is on at least min_sites sites, and where it comes first."""
    each = lines(docs, min_chars, id_col, text_col, site_col)
    sketched = each.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"))
    possible = cut(sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - MARGIN))).select("key", "sites", "first.id", "first.place"))
    clear = possible.where(F.col("sites") > min_sites * (1 + MARGIN)).select("key", "id", "place")
    near = possible.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("key", "id", "place")
    exact = semi(each, near.select("key"), "key").groupBy("key").agg(F.countDistinct("site").alias("exact")).where(F.col("exact") >= min_sites).select("key")
    return clear.union(near.join(exact, "key", "left_semi").select("key", "id", "place"))


def _cleaner(spread, min_chars: int, fields: list[tuple[str, str]]):
    """fields: names, and the columns or results that they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places = spread.value
        first = dict(zip(keys.tolist(), zip(docs.tolist(), places.tolist(), strict=True), strict=True))
        digest = xxhash.xxh64_intdigest
        for b in slices(batches):
            out, gone = [], []
            for i, text in zip(column(b, "id").to_pylist(), texts_of(b), strict=True):
                if text is None or i is None:
                    out.append(text)
                    gone.append(0)
                    continue
                stay, every = [], text.split("\n")
                for place, line in enumerate(every):
                    bare = line.strip(" ")
                    if len(bare) >= min_chars:
                        h = digest(bare.encode(), 42)
                        at = first.get(h - (1 << 64) if h >> 63 else h)
                        if at is not None and at != (i, place):
                            continue
                    stay.append(line)
                out.append("\n".join(stay) if len(stay) < len(every) else text)
                gone.append(len(every) - len(stay))
            made = {TEXT: pa.array(out, pa.string()), "gone": pa.array(gone, pa.int32())}
            yield pa.record_batch([made[c] if c in made else column(b, c) for _, c in fields], names=[n for n, _ in fields])

    return run


def remove_spread_lines(docs: DataFrame, min_sites: int = 3, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with text_col without its spread lines, and removed_col (if named): how many lines went."""
    spread = cut(spread_lines(docs, min_sites, min_chars, id_col, text_col, site_col))
    columns = others(docs, [removed_col] * bool(removed_col))
    fields = [(c, TEXT if c.lower() == text_col.lower() else f"c{k}") for k, c in enumerate(columns)] + [(removed_col, "gone")] * bool(removed_col)
    rows = docs.select(whole_id(id_col).alias("id"), quoted(text_col).cast("string").alias(TEXT), *[quoted(n).alias(c) for n, c in fields if c not in (TEXT, "gone")])
    if fits(spread, broadcast_rows):
        found = spread.toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((found.key.to_numpy(np.int64), found.id.to_numpy(np.int64), found.place.to_numpy(np.int64)))
        schema = T.StructType([T.StructField(n, T.StringType()) if c == TEXT else T.StructField(n, T.IntegerType()) if c == "gone" else docs.schema[n] for n, c in fields])
        return map_arrow(rows, _cleaner(shared, min_chars, fields), schema)
    first = spread.select("key", F.col("id").alias("first_id"), F.col("place").alias("first_place"))
    goes = lines(docs, min_chars, id_col, text_col, site_col).join(first, "key").where("id <> first_id or place <> first_place")
    goes = goes.groupBy("id").agg(F.collect_set("place").alias("places"))
    left = F.array_join(F.filter(F.split(TEXT, "\n", -1), lambda _, i: ~F.array_contains("places", i)), "\n")
    made = {TEXT: F.when(F.col("places").isNull() | F.col(TEXT).isNull(), F.col(TEXT)).otherwise(left), "gone": F.when(F.col(TEXT).isNull(), 0).otherwise(F.coalesce(F.size("places"), F.lit(0))).cast("int")}
    return rows.join(goes, "id", "left").select(*[made.get(c, F.col(c)).alias(n) for n, c in fields])
