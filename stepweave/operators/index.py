"""The episode index: how it is built, asked and sliced."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stepweave.functions.keys import is_image
from stepweave.functions.versions import CURRENT
from stepweave.sources.schema import EPISODES, conform


def build(steps: DataFrame, tasks: DataFrame | None = None, split: Column | str = "train", action_space_type: str = "custom", source_uri: str = "", invalid: DataFrame | None = None, files: DataFrame | None = None, row_ranges: bool = True) -> DataFrame:
    """A row for each episode, in the index's columns.

    Start and end are the first and last step's times. tasks: episode_id, task_id, task_text; invalid: episode_id; files:
    episode_id, file. Rows in a file are counted over the episodes of the same file, by episode_index; without files over
    all, by way of sums of buckets, or not at all (row_ranges=False: from 0 to 0). No window is over steps.
    """
    i = F.col("step_index")
    keys = F.map_keys(F.map_filter("observation", lambda k, _: is_image(k)))
    cameras = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set(keys)), lambda k: F.element_at(F.split(k, r"\."), -1))))
    optional = [F.min_by(c, i).alias(c) for c in ("robot_id", "task_text") if c in steps.columns and not (c == "task_text" and tasks is not None)]
    agg = steps.groupBy("episode_id").agg(
        F.first("dataset_id").alias("dataset_name"), F.min("episode_index").alias("episode_index"), F.count("*").cast("int").alias("num_steps"),
        F.min_by("timestamp", i).alias("start_timestamp"), F.max_by("timestamp", i).alias("end_timestamp"), F.array_join(cameras, ",").alias("camera_set"), *optional)
    if tasks is not None:
        agg = agg.join(tasks.select("episode_id", "task_id", "task_text"), "episode_id", "left")
    if invalid is not None:
        agg = agg.join(invalid.select("episode_id").distinct().withColumn("invalid", F.lit(True)), "episode_id", "left").withColumn("invalid", F.coalesce("invalid", F.lit(False)))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    agg = agg.withColumns({"duration_secs": F.col("end_timestamp") - F.col("start_timestamp"), "split": lit(split), "action_space_type": F.lit(action_space_type), "source_uri": F.lit(source_uri), "video_offsets": F.lit("{}"), "schema_version": F.lit(CURRENT)})
    if files is not None:
        end = F.sum("num_steps").over(W.partitionBy("parquet_file").orderBy("episode_index").rowsBetween(W.unboundedPreceding, 0))
        agg = agg.join(files.select("episode_id", F.col("file").alias("parquet_file")), "episode_id", "left").withColumn("parquet_row_end", end)
    elif row_ranges:
        ends = frame_offsets(agg).select("episode_id", F.col("frame_end").alias("parquet_row_end"))
        agg = agg.join(ends, "episode_id", "left").withColumn("parquet_file", F.lit(""))
    if files is not None or row_ranges:
        agg = agg.withColumn("parquet_row_start", F.col("parquet_row_end") - F.col("num_steps"))
    full = conform(agg, EPISODES, {"robot_id": "unknown"})
    return full


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index at path; columns that the files lack have their defaults."""
    from stepweave.sources.schema import EPISODE_DEFAULTS

    return conform(spark.read.parquet(path), EPISODES, EPISODE_DEFAULTS)


@dataclass
class Query:
    """Criteria that all must hold; None: no matter. Null values meet no criterion."""

    split: str | None = None
    dataset_name: str | None = None
    invalid: bool | None = None
    min_steps: int | None = None
    max_steps: int | None = None
    cameras: list[str] | None = None
    camera_set: str | None = None
    robot_id: str | list[str] | None = None
    action_space_type: str | None = None
    task_id: int | list[int] | None = None
    task_text_regex: str | None = None

    def condition(self) -> Column:
        """camera_set is looked for inside the joined names ('front' is in 'front_left'); cameras are whole names."""
        many = lambda v: list(v) if isinstance(v, (list, tuple, set)) else [v]
        terms: list[Column] = [F.col(c).isin(*many(v)) for c, v in (("robot_id", self.robot_id), ("task_id", self.task_id)) if v is not None]
        if self.task_text_regex is not None:
            terms.append(F.col("task_text").rlike("(?iu)" + self.task_text_regex))
        if self.min_steps is not None:
            terms.append(F.col("num_steps") >= self.min_steps)
        if self.max_steps is not None:
            terms.append(F.col("num_steps") <= self.max_steps)
        if self.camera_set is not None:
            terms.append(F.col("camera_set").contains(self.camera_set))
        terms += [F.array_contains(F.split("camera_set", ","), c) for c in self.cameras or ()]
        terms += [F.col(c) == v for c in ("action_space_type", "invalid", "split", "dataset_name") if (v := getattr(self, c)) is not None]
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    def terms(self) -> dict[str, object]:
        return {k: v for k, v in asdict(self).items() if v is not None}


def query(index: DataFrame, q: Query | None = None) -> DataFrame:
    return index if q is None else index.where(q.condition())


def query_ids(index: DataFrame, q: Query | None = None) -> DataFrame:
    return query(index, q).select("episode_id")


def count(index: DataFrame, q: Query | None = None) -> int:
    return query(index, q).count()


def where_sql(index: DataFrame, predicate: str, limit: int | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows that meet an SQL predicate over the index's columns; no subqueries, no other names."""
    bare = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", " ", predicate, flags=re.DOTALL)  # without texts and comments
    if re.search(r"\b(select|with|from|table|values)\b", re.sub(r"\bis\s+(not\s+)?distinct\s+from\b", " ", bare, flags=re.IGNORECASE), re.IGNORECASE):
        raise ValueError("a predicate has no subquery")
    df = index.select(*(columns or index.columns)).where(predicate)
    return df.orderBy("episode_id").limit(limit) if limit else df


def valid_only(index: DataFrame) -> DataFrame:
    return index.where(~F.col("invalid"))


def slice_steps(steps: DataFrame, index: DataFrame) -> DataFrame:
    """The steps of the index's episodes."""
    return steps.join(index.select("episode_id"), "episode_id", "left_semi")


def without(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """The steps of all other episodes."""
    return steps.join(episodes.select("episode_id"), "episode_id", "left_anti")


def first_episodes(steps: DataFrame, n: int | None) -> DataFrame:
    """Steps of the first n episodes by episode_index; 0 or None: all."""
    if not n:
        return steps
    return slice_steps(steps, steps.select("episode_id", "episode_index").distinct().orderBy("episode_index").limit(n))


def frame_offsets(index: DataFrame, order: str = "episode_index") -> DataFrame:
    """episode_id, frame_start, frame_end: running over all episodes.

    Sums of buckets of episodes come first, so that no task has to sort all of them.
    """
    width = 65_536
    b = index.select("episode_id", order, "num_steps").withColumn("_b", F.floor(F.col(order) / width))
    sums = b.groupBy("_b").agg(F.sum("num_steps").alias("s"))
    before = sums.withColumn("_base", F.sum("s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", F.coalesce("_base", F.lit(0)).alias("_base"))
    inner = F.sum("num_steps").over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    df = b.withColumn("_end", inner).join(before, "_b").withColumn("frame_end", F.col("_base") + F.col("_end"))
    return df.select("episode_id", (F.col("frame_end") - F.col("num_steps")).alias("frame_start"), "frame_end")


def with_frame_index(steps: DataFrame, offsets: DataFrame) -> DataFrame:
    return steps.join(offsets, "episode_id").withColumn("frame_index", F.col("frame_start") + F.col("step_index")).drop("frame_start", "frame_end")


def overlaps(index: DataFrame, across_files: bool = False) -> DataFrame:
    """Episodes whose row range begins before the one before it ends, in the same file (or, across_files, in any)."""
    w = (W.orderBy if across_files else W.partitionBy("parquet_file").orderBy)("parquet_row_start", "parquet_row_end", "episode_id")
    before = F.lag("parquet_row_end").over(w)
    return index.withColumn("previous_end", before).where(F.col("parquet_row_start") < F.col("previous_end")).select("episode_id", "parquet_file", "parquet_row_start", "previous_end")
