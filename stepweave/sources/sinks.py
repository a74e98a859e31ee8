"""Writers: compiled steps, their metadata, exports, reports and provenance."""

from __future__ import annotations

import hashlib
import html
import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.functions.versions import CURRENT
from stepweave.operators import index as X
from stepweave.operators import shards, stats
from stepweave.sources.schema import DatasetSpec, FeatureSpec


@dataclass(frozen=True)
class Layout:
    """Where the parts of a compiled data set are."""

    root: str

    def __getattr__(self, name: str) -> str:
        places = {"data": "data", "videos": "videos", "meta": "meta", "info": "meta/info.json", "tasks": "meta/tasks.jsonl", "stats": "meta/stats.json", "episodes": "meta/episodes/episodes.parquet", "index": "meta/episodes.parquet", "manifest": "meta/manifest.json", "checksums": "meta/checksums.json", "findings": "meta/findings", "report": "meta/validation.json", "card": "README.md", "spec": "meta/spec.json"}
        if name not in places:
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{places[name]}"

    def steps_file(self, chunk: int, shard: int) -> str:
        return f"{self.data}/chunk-{chunk:03d}/steps_{shard:05d}.parquet"

    def video_file(self, camera: str, shard: int) -> str:
        return f"{self.videos}/{camera}/shard_{shard:05d}.mp4"


def step_columns(steps: DataFrame, spec: DatasetSpec | None = None, lossless: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Steps as they are stored: a typed column for each observation, '.' as '_'; images are left out, texts are strings.

    lossless: also reward, discount and the episode's id. also: more columns that are there.
    """
    if spec is None:
        keys = [r.key for r in steps.select(F.explode(F.map_keys("observation")).alias("key")).distinct().orderBy("key").collect()]  # one a feature
        features = {k: FeatureSpec("string" if k.endswith("language") else "float32") for k in keys}
    else:
        features = spec.observation
    v = lambda k: F.try_element_at("observation", F.lit(k))
    made = []
    for k, f in features.items():
        name = k.replace(".", "_")
        if "image" in k:
            made.append(F.lit(None).cast("string").alias(name))
        elif f.dtype in ("string", "bytes"):
            made.append(v(k)["str"].alias(name))
        else:
            made.append((v(k)["num"].cast("array<float>") if f.dtype == "float32" else v(k)["num"]).alias(name))
    extra = ["episode_id", "reward", "discount"] if lossless else []
    frame = ["frame_index"] if "frame_index" in steps.columns else []
    return steps.select("episode_index", "step_index", *frame, "timestamp", "is_first", "is_last", "is_terminal", F.col("action").cast("array<float>").alias("action"), *extra, *made, *also)


def write_steps(steps: DataFrame, path: str, rows_per_shard: int = 10_000, chunk_episodes: int = 1000, spec: DatasetSpec | None = None, lossless: bool = True, once: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Writes steps under path/data in folders chunk=.../shard=..., whole episodes each; returns episode_index, shard, chunk, file.

    Shards follow the episodes' order and sizes only, so a repeated write gives the same ones. once(df, name): a table that is
    read several times, to be kept somewhere.
    """
    sizes = once(steps.groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), F.count("*").alias("num_steps")), "sizes")
    placed = once(shards.flush_shards(sizes, rows_per_shard, chunk_episodes), "placed")
    # a row an episode, so that steps are joined once, and shuffled again only to their shards
    where = X.frame_offsets(sizes).join(sizes.select("episode_id", "episode_index"), "episode_id").join(placed.drop("file"), "episode_index").drop("episode_index", "frame_end")
    joined = steps.join(where, "episode_id").withColumn("frame_index", F.col("frame_start") + F.col("step_index"))
    df = step_columns(joined, spec, lossless, ("shard", "chunk"))
    out = df.repartition("chunk", "shard").sortWithinPartitions("chunk", "shard", "episode_index", "step_index").write.mode("overwrite")
    (df.limit(0).write.mode("overwrite") if placed.isEmpty() else out.partitionBy("chunk", "shard")).parquet(Layout(path).data)  # folders alone have no schema
    return placed


def _put(path: str, text: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return path


def write_info(index: DataFrame, spec: DatasetSpec, path: str) -> dict[str, Any]:
    total = index.agg(F.count("*").alias("episodes"), F.sum("num_steps").alias("frames"), F.count_distinct("task_text").alias("tasks")).first()
    features = {k: {"dtype": f.dtype, "shape": list(f.shape)} for k, f in (dict(spec.observation) | ({"action": spec.action} if spec.action else {})).items()}
    info = {"version": CURRENT, "robot_type": spec.dataset_id, "fps": spec.control_rate_hz, "total_episodes": total.episodes, "total_frames": total.frames or 0, "total_tasks": total.tasks, "splits": {"train": f"0:{total.episodes}"}, "data_path": "data/chunk={chunk}/shard={shard}", "features": features}
    _put(Layout(path).info, json.dumps(info, indent=2))
    return info


def write_tasks(catalog: DataFrame, path: str) -> None:
    """tasks.jsonl in the order of ids; the catalog is a dimension table and goes through the driver."""
    rows = catalog.orderBy("task_id").toLocalIterator()
    _put(Layout(path).tasks, "".join(json.dumps({"task_index": r.task_id, "task": r.task_text}, ensure_ascii=False) + "\n" for r in rows))


def write_stats(table: DataFrame, path: str) -> None:
    _put(Layout(path).stats, stats.to_json(table))


def write_episode_meta(index: DataFrame, path: str) -> None:
    index.select("episode_id", F.array("task_id").alias("tasks"), F.col("num_steps").cast("bigint").alias("length")).write.mode("overwrite").parquet(Layout(path).episodes)


def write_index(index: DataFrame, path: str) -> None:
    """The queryable index; an empty one is written as well."""
    index.write.mode("overwrite").parquet(Layout(path).index)


def write_findings(findings: DataFrame, path: str, format: str = "json", append: bool = False) -> None:
    findings.write.mode("append" if append else "overwrite").format(format).save(Layout(path).findings)


def write_report(report: DataFrame, path: str) -> dict[str, Any]:
    row = report.first().asDict()
    _put(Layout(path).report, json.dumps(row, indent=2))
    return row


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings.select([c for c in findings.columns]).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/findings.csv")


def report_html(report: DataFrame, findings: DataFrame, limit: int = 1000) -> str:
    """A page of the report's numbers, the findings by code, and the first limit findings (how many there are is said)."""
    row, first = report.first().asDict(), findings.orderBy("episode_id", "ord", "step_index").limit(limit).collect()
    codes = findings.groupBy("severity", "code").agg(F.count("*").alias("n")).orderBy("severity", "code").collect()  # one a code
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(v if v is not None else ''))}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    total = sum(c.n for c in codes)
    parts = [table(["", ""], row.items()), table(["severity", "code", "findings"], codes), f"<p>{len(first)} of {total} findings</p>", table(["severity", "code", "episode", "step", "field", "message"], [(f.severity, f.code, f.episode_id, f.step_index, f.field, f.message) for f in first])]
    return "<!doctype html><meta charset='utf-8'><title>Validation</title>" + "".join(parts)


def write_report_html(report: DataFrame, findings: DataFrame, path: str) -> str:
    return _put(f"{path.rstrip('/')}/meta/validation.html", report_html(report, findings))


def merge(*parts: DataFrame) -> DataFrame:
    """The steps of several data sets as one: columns that some lack are null there; ids that more than one has are told apart by the set's id."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    owners = every.select("episode_id", "dataset_id").distinct().groupBy("episode_id").agg(F.count("*").alias("_owners"))
    shared = owners.where("_owners > 1").select("episode_id", F.lit(True).alias("_shared"))
    df = every.join(shared, "episode_id", "left")
    return df.withColumn("episode_id", F.when(F.col("_shared"), F.concat_ws("/", "dataset_id", "episode_id")).otherwise(F.col("episode_id"))).select(*every.columns)


def encode_videos(frames: DataFrame, placed: DataFrame, path: str, command: list[str], order: str = "episode_index") -> DataFrame:
    """camera, shard, file, frames: each shard's frames, in order, through an external encoder's standard input.

    frames: camera, episode_index, step_index, height, width, data (RGB bytes); placed: camera, episode_index, shard (see
    shards.pack). command: the encoder, with {width}, {height} and {out} to be filled in. A shard is one task's; its frames
    come sorted and are piped one by one, never held together.
    """
    layout = Layout(path)
    df = frames.join(placed.select("camera", order, "shard"), ["camera", order]).repartition("camera", "shard").sortWithinPartitions("camera", "shard", order, "step_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = process = out = None
        n, rows = 0, []

        def close() -> None:
            if process is not None:
                process.stdin.close()
                if process.wait():
                    raise RuntimeError(f"{command[0]} failed on {out}: {process.returncode}")
                rows.append((*key, out, n))

        for b in batches:
            for r in b.to_pylist():
                if (r["camera"], r["shard"]) != key:
                    close()
                    key, n, out = (r["camera"], r["shard"]), 0, layout.video_file(r["camera"], r["shard"])
                    Path(out).parent.mkdir(parents=True, exist_ok=True)
                    process = subprocess.Popen([x.format(width=r["width"], height=r["height"], out=out) for x in command], stdin=subprocess.PIPE)
                process.stdin.write(r["data"])
                n += 1
        close()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["camera", "shard", "file", "frames"])

    return df.select("camera", F.col("shard").cast("int").alias("shard"), order, "step_index", "height", "width", "data").mapInArrow(run, "camera string, shard int, file string, frames long")


def export_schema(spec: DatasetSpec) -> T.StructType:
    """A nested row type of an episode: steps with observation, action, reward, discount and flags."""
    kinds = {"float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.BinaryType(), "string": T.StringType(), "bool": T.BooleanType()}
    kind = lambda f: kinds.get(f.dtype, T.StringType()) if f.dtype in ("uint8", "string") or not f.shape else T.ArrayType(kinds.get(f.dtype, T.DoubleType()))
    observation = T.StructType([T.StructField(k.removeprefix("observation."), kind(f), True, {"dtype": f.dtype, "shape": list(f.shape)}) for k, f in spec.observation.items()])
    action = spec.action or FeatureSpec("float32", (7,))
    flags = [T.StructField(n, T.BooleanType()) for n in ("is_first", "is_last", "is_terminal")]
    step = T.StructType([T.StructField("observation", observation), T.StructField("action", kind(action), True, {"shape": list(action.shape)}), T.StructField("reward", T.FloatType()), T.StructField("discount", T.FloatType()), *flags])
    return T.StructType([T.StructField("episode_id", T.StringType()), T.StructField("steps", T.ArrayType(step))])


def nested(steps: DataFrame, spec: DatasetSpec, parity: bool = False) -> DataFrame:
    """An episode a row, in export_schema. A missing last action is zeros; a missing reward 0; a missing discount 1.

    parity: a discount of 0 becomes 1 as well.
    """
    width = spec.action.shape[0] if spec.action and spec.action.shape else 7
    discount = F.coalesce("discount", F.lit(1.0))
    if parity:
        discount = F.when(discount == 0, 1.0).otherwise(discount)
    v = lambda k: F.try_element_at("observation", F.lit(k))
    observed = F.struct(*[(v(k)["str"] if f.dtype == "string" else v(k)["bin"] if f.dtype == "uint8" else v(k)["num"]).alias(k.removeprefix("observation.")) for k, f in spec.observation.items()])
    step = F.struct("step_index", observed.alias("observation"), F.coalesce("action", F.array_repeat(F.lit(0.0), width)).alias("action"), F.coalesce("reward", F.lit(0.0)).alias("reward"), discount.alias("discount"), "is_first", "is_last", "is_terminal")
    rows = steps.groupBy("episode_id").agg(F.array_sort(F.collect_list(step), lambda a, b: a["step_index"] - b["step_index"]).alias("steps"))
    return rows.select("episode_id", F.transform("steps", lambda s: s.dropFields("step_index")).alias("steps"))


def episode_records(steps: DataFrame, parity: bool = False) -> DataFrame:
    """episode_id, episode_index, record: an Example of each episode, as record files hold it."""
    from stepweave.sources.examples import encode_episodes

    parts = F.struct("step_index", "is_first", "is_last", "is_terminal", "reward", "discount", "action", F.map_entries("observation").alias("observation"))
    rows = steps.groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), F.array_sort(F.collect_list(parts), lambda a, b: a["step_index"] - b["step_index"]).alias("steps"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = encode_episodes(b.column(0).to_pylist(), b.column(2), parity)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(records, pa.binary())], names=["episode_id", "episode_index", "record"])

    return rows.mapInArrow(encode, "episode_id string, episode_index long, record binary")


def write_nested(steps: DataFrame, spec: DatasetSpec, path: str, episodes_per_shard: int = 100, format: str = "parquet", parity: bool = False) -> None:
    """Nested episodes in shards of so many (format: parquet; or tfrecord: Examples in the record framing)."""
    if format == "tfrecord":
        from stepweave.sources.records import RecordSource

        steps.sparkSession.dataSource.register(RecordSource)
        df = shards.by_hundreds(episode_records(steps, parity), episodes_per_shard)
        df.repartition("shard").sortWithinPartitions("shard", "episode_index").select("shard", "record").write.format("records").mode("overwrite").save(path)
        return
    index = steps.groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"))
    df = shards.by_hundreds(nested(steps, spec, parity).join(index, "episode_id"), episodes_per_shard).drop("episode_index")
    df.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def export_info(index: DataFrame, spec: DatasetSpec, path: str) -> None:
    total = index.agg(F.count("*").alias("n"), F.sum("num_steps").alias("steps")).first()
    _put(f"{path.rstrip('/')}/dataset_info.json", json.dumps({"name": spec.dataset_id, "version": CURRENT, "splits": [{"name": "train", "num_examples": total.n, "num_steps": total.steps or 0}]}, indent=2))


def checksums(spark: SparkSession, path: str, bits: int = 256) -> DataFrame:
    """file (under path), sha of every file of meta, data and videos; files are read part by part, so of any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/[._][^/]*$|/manifest\.json$|/checksums\.json$"))
    name = F.regexp_extract("path", r"/((?:meta|data|videos)/.*)$", 1)

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in parts:
            out = []
            for p in pdf["path"]:
                system, where = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                h = hashlib.new(f"sha{bits}")
                with system.open_input_stream(where) as f:
                    while part := f.read(1 << 22):
                        h.update(part)
                out.append(h.hexdigest())
            yield pd.DataFrame({"file": pdf["file"], "sha": out})

    return files.select("path", name.alias("file")).where("file <> ''").mapInPandas(digest, "file string, sha string")


def write_checksums(spark: SparkSession, path: str) -> None:
    rows = checksums(spark, path).orderBy("file").toLocalIterator()
    _put(Layout(path).checksums, json.dumps({r.file: r.sha for r in rows}, indent=2, sort_keys=True))


@dataclass
class Manifest:
    """What was made, of what, and how. The build id follows from the inputs alone unless at is given."""

    dataset_id: str
    config: dict[str, Any] = field(default_factory=dict)
    sources: list[str] = field(default_factory=list)
    transforms: list[str] = field(default_factory=list)
    validators: list[str] = field(default_factory=list)
    status: str = "running"
    parent_build_id: str = ""
    at: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.config, sort_keys=True, default=str).encode()).hexdigest()[:16]

    @property
    def build_id(self) -> str:
        parts = f"{self.config_hash}:{self.at}" if self.at else json.dumps([self.dataset_id, self.config_hash, self.sources, self.transforms, self.validators])
        return hashlib.sha256(parts.encode()).hexdigest()[:12]

    @staticmethod
    def git() -> dict[str, Any]:
        def run(*a: str) -> str | None:
            done = subprocess.run(["git", *a], capture_output=True, text=True, check=False)
            return done.stdout.strip() if not done.returncode else None

        status = run("status", "--porcelain")
        return {"commit": run("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}

    def seal(self, path: str, status: str = "sealed") -> str:
        self.status = status
        return _put(Layout(path).manifest, json.dumps(asdict(self) | {"config_hash": self.config_hash, "build_id": self.build_id, "written": datetime.now(UTC).isoformat(), "git": self.git()}, indent=2, default=str))

    @classmethod
    def load(cls, path: str) -> Manifest:
        d = json.loads(Path(Layout(path).manifest).read_text())
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})


def verify(index: DataFrame, rows: int, across_files: bool = False) -> list[str]:
    """What is wrong with the index: rows that don't add up, overlapping ranges."""
    total = index.agg(F.sum("num_steps")).first()[0] or 0
    problems = [] if total == rows else [f"{rows} rows are stored, the index has {total}"]
    n = X.overlaps(index, across_files).count()
    return problems + ([f"{n} row ranges overlap"] if n else [])


def finalize(spark: SparkSession, index: DataFrame, path: str, manifest: Manifest) -> None:
    """Verified, checked and sealed; a manifest of a failed build is written before the error is raised."""
    problems = verify(index, spark.read.parquet(Layout(path).data).count())
    if problems:
        manifest.extra["problems"] = problems
        manifest.seal(path, "failed")
        raise ValueError("; ".join(problems))
    write_checksums(spark, path)
    manifest.seal(path)


def write_slice(index: DataFrame, q: X.Query, path: str, steps: DataFrame | None = None, slice_id: str = "slice", parent_build_id: str = "") -> dict[str, Any]:
    """A view (the index alone), or with steps a copy of exactly its episodes' steps; and a manifest."""
    chosen = X.query(index, q)
    write_index(chosen, path)
    if steps is not None:
        X.slice_steps(steps, chosen).write.mode("overwrite").parquet(Layout(path).data)
    kept = index.sparkSession.read.parquet(Layout(path).index)
    manifest = {"slice_id": slice_id, "parent_build_id": parent_build_id, "mode": "view" if steps is None else "copy", "filter": q.terms(), "num_episodes": kept.count(), "ids": Layout(path).index}
    _put(Layout(path).manifest, json.dumps(manifest, indent=2, default=str))
    return manifest


def card(index: DataFrame) -> DataFrame:
    """One row: totals, robots, cameras (both sorted) and the first ten tasks."""
    robots = F.array_sort(F.collect_set("robot_id"))
    cameras = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("camera_set", ","), lambda c: c != "")))))
    tasks = F.slice(F.array_sort(F.collect_set("task_text")), 1, 10)
    return index.agg(F.count("*").alias("num_episodes"), F.coalesce(F.sum("num_steps"), F.lit(0)).alias("num_steps"), robots.alias("robots"), cameras.alias("cameras"), tasks.alias("tasks"))


def write_card(index: DataFrame, name: str, path: str) -> str:
    r = card(index).first()
    bullets = lambda xs: "".join(f"- {x}\n" for x in xs) or "- none\n"
    return _put(Layout(path).card, f"# {name}\n\n{r.num_episodes} episodes, {r.num_steps} steps.\n\n## Robots\n{bullets(r.robots)}\n## Cameras\n{bullets(r.cameras)}\n## Tasks\n{bullets(r.tasks)}")
