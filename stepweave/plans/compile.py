"""From a source to a compiled data set: transforms, validation, triage, writing; each stage a lazy table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import index as X
from stepweave.operators import stats
from stepweave.operators import transforms as T
from stepweave.operators import validators as V
from stepweave.plans.logs import timed
from stepweave.session import new_path, remove
from stepweave.sources import sinks
from stepweave.sources.adapters import Adapter, select_slice
from stepweave.sources.schema import DatasetSpec

#: Transforms by the names that pipeline files use.
TRANSFORMS: dict[str, Callable[..., T.Transform]] = {
    "identity": T.chain, "normalize_actions": T.normalize_actions, "pad_action": T.pad_actions, "map_action_space": T.map_action_space, "select_camera": T.select_camera, "resize_images": T.resize_images,
    "image_standardize": T.standardize_images, "timestamp_canonicalize": T.repair_timestamps, "resample": T.resample, "task_text": lambda **k: task_text(**k), "history": T.history,
}
#: Other spellings of parameters.
_SPELLINGS = {"camera": "name", "camera_name": "name", "target_size": "size", "control_rate_hz": "rate_hz", "target_rate_hz": "rate_hz", "action_bounds": "bounds", "source_space": "source", "target_space": "target", "default_text": "default"}


def register(kind: dict[str, Any], name: str) -> Callable:
    """A decorator that adds a function to TRANSFORMS, VALIDATORS or any such table."""

    def add(f: Callable) -> Callable:
        kind[name] = f
        return f

    return add


def lookup(kind: dict[str, Any], name: str) -> Any:
    if name not in kind:
        raise KeyError(f"{name!r} is none of {', '.join(sorted(kind))}")
    return kind[name]


def task_text(default: str = "", allow_empty: bool = True) -> T.Transform:
    """A task_text column, in one form, from wherever an episode has it."""

    def run(df: DataFrame) -> DataFrame:
        texts = T.task_texts(df, default, allow_empty).select("episode_id", F.col("task_text").alias("_text"))
        return df.join(texts, "episode_id").withColumn("task_text", F.col("_text")).drop("_text")

    return run


def from_config(config: dict[str, Any]) -> list[tuple[str, T.Transform]]:
    """[(name, transform)] of {'transforms': [{'name': ..., 'params': {...}}, 'name', ...]}."""
    out = []
    for t in config.get("transforms") or []:
        name, params = (t, {}) if isinstance(t, str) else (t.get("name") or t.get("type"), t.get("params") or {k: v for k, v in t.items() if k not in ("name", "type", "params")})
        params = {_SPELLINGS.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in params.items()}
        out.append((name, lookup(TRANSFORMS, name)(**params)))
    return out


def load_config(path: str, dataset: str | None = None) -> dict[str, Any]:
    """A YAML file; what it has under datasets.<dataset> replaces the same keys, one level deep."""
    import yaml

    with open(path) as f:
        config = yaml.safe_load(f) or {}
    for k, v in (config.get("datasets", {}).get(dataset) or {}).items() if dataset else ():
        config[k] = {**config[k], **v} if isinstance(v, dict) and isinstance(config.get(k), dict) else v
    return config


@dataclass
class Result:
    success: bool
    report: dict[str, Any]
    path: str
    index: DataFrame = field(repr=False)
    findings: DataFrame = field(repr=False)


@dataclass
class Compiler:
    """Built by its methods, then asked to validate or to compile."""

    dataset_id: str
    fail_fast: bool = False
    severities: dict[str, str] = field(default_factory=dict)
    transforms: list[tuple[str, T.Transform]] = field(default_factory=list)
    validators: list[str] = field(default_factory=lambda: list(V.VALIDATORS))
    rows_per_shard: int = 10_000
    without_rate: dict[str, Callable[[float], T.Transform]] = field(default_factory=dict)

    def add_transform(self, name: str, transform: T.Transform | None = None, **params: Any) -> Compiler:
        if transform is None and name == "timestamp_canonicalize" and "rate_hz" not in params:
            self.without_rate[name] = lambda hz: lookup(TRANSFORMS, name)(rate_hz=hz, **params)
        self.transforms.append((name, transform or lookup(TRANSFORMS, name)(**params)))
        return self

    def add_validator(self, name: str) -> Compiler:
        lookup(V.VALIDATORS, name)
        if name not in self.validators:
            self.validators.append(name)
        return self

    def transformed(self, steps: DataFrame, spec: DatasetSpec | None = None) -> DataFrame:
        """Through all transforms; those that were given by name and no rate of their own take the spec's."""
        for name, transform in self.transforms:
            if name in self.without_rate and spec is not None and spec.control_rate_hz:
                transform = self.without_rate[name](spec.control_rate_hz)
            steps = steps.transform(transform)
        return steps

    def findings(self, steps: DataFrame, spec: DatasetSpec | None, episodes: DataFrame) -> DataFrame:
        table = spec.frame(steps.sparkSession) if spec else None
        return V.override(V.validate(steps, episodes, table, self.validators, spec.control_rate_hz if spec else None), self.severities)

    def validate_only(self, source: DataFrame | Adapter, spark: SparkSession, max_episodes: int | None = None, spec: DatasetSpec | None = None) -> tuple[DataFrame, DataFrame]:
        """findings, report of the first max_episodes episodes; nothing is written."""
        steps = source if isinstance(source, DataFrame) else source.steps(spark)
        steps = X.first_episodes(steps, max_episodes)
        episodes = steps.select("episode_id").distinct()
        findings = self.findings(self.transformed(steps, spec), spec, episodes)
        return findings, V.report(episodes, findings)

    def compile(self, source: DataFrame | Adapter, spark: SparkSession, path: str, selector: str | None = None, max_episodes: int | None = None, spec: DatasetSpec | None = None) -> Result:
        """Episodes with errors are left out, those with warnings are marked invalid; steps, index and metadata are written.

        The transformed steps are written once and read by all that follows; so are those of episodes without errors where
        others have some, and each table of a row an episode.
        """
        steps = select_slice(source, selector) if isinstance(source, DataFrame) else source.steps(spark, selector)
        steps = X.first_episodes(steps, max_episodes)
        staged = new_path(spark, "staged")

        def once(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
            return spark.read.parquet(f"{staged}/{name}")

        with timed("transform", dataset=self.dataset_id):
            ready = once(self.transformed(steps, spec), "steps")
        episodes = once((steps if self.transforms else ready).select("episode_id").distinct(), "episodes")
        with timed("validate", dataset=self.dataset_id):
            sinks.write_findings(self.findings(ready, spec, episodes), path, "parquet")
        findings = spark.read.parquet(sinks.Layout(path).findings)
        if self.fail_fast:
            V.fail_on(findings)
        verdicts = once(V.triage(episodes, findings), "verdicts")
        errors = verdicts.where("verdict = 'error'")
        kept = ready if errors.isEmpty() else once(X.without(ready, errors), "kept")
        texts = once(T.with_task_ids(once(T.task_texts(kept, allow_empty=True), "texts")), "tasks")
        spec = spec or DatasetSpec(self.dataset_id)
        with timed("write", dataset=self.dataset_id):
            placed = sinks.write_steps(kept, path, self.rows_per_shard, spec=spec if spec.observation else None, once=once)
            files = texts.join(placed.select("episode_index", F.format_string("data/chunk=%d/shard=%d", "chunk", "shard").alias("file")), "episode_index").select("episode_id", "file")
            sinks.write_index(X.build(kept, texts, action_space_type=spec.action_space_type, invalid=verdicts.where("verdict = 'invalid'"), files=files), path)
        index = spark.read.parquet(sinks.Layout(path).index)
        sinks.write_info(index, spec, path)
        sinks.write_tasks(T.task_catalog(texts), path)
        sinks.write_stats(stats.feature_stats(kept), path)
        sinks.write_episode_meta(index, path)
        report = sinks.write_report(V.report(episodes, findings), path)
        manifest = sinks.Manifest(self.dataset_id, {"selector": selector, "max_episodes": max_episodes, "rows_per_shard": self.rows_per_shard}, [self.dataset_id], [n for n, _ in self.transforms], self.validators)
        sinks.finalize(spark, index, path, manifest)
        remove(spark, staged)
        return Result(not report["error_findings"] or report["valid_episodes"] + report["invalid_episodes"] > 0, report, path, index, findings)


def training_steps(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    """A compiled data set's steps, without those of invalid episodes."""
    steps = spark.read.parquet(sinks.Layout(path).data)
    return X.slice_steps(steps, X.valid_only(X.read(spark, sinks.Layout(path).index))) if skip_invalid else steps
