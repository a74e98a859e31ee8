"""Evaluation of rollouts: results to metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Protocol:
    tasks: list[str] = field(default_factory=list)
    episodes_per_task: int = 25
    seeds: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4])
    max_steps: int = 200
    headless: bool = True

    @classmethod
    def from_yaml(cls, path: str | Path) -> Protocol:
        import yaml

        return cls(**(yaml.safe_load(Path(path).read_text()) or {}))

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.__dict__))


def metrics(results: DataFrame) -> DataFrame:
    """task (null: all), n_episodes, n_successes, success_rate, mean_reward, mean_steps; both levels in one pass. No results: no rows."""
    agg = results.groupingSets([["task"], []], "task").agg(
        F.grouping("task").alias("_all"), F.count("episode_idx").alias("n_episodes"), F.count_if("success").alias("n_successes"), F.avg("total_reward").alias("mean_reward"), F.avg("num_steps").alias("mean_steps"))
    rate = F.when(F.col("n_episodes") > 0, F.col("n_successes") / F.col("n_episodes")).otherwise(0.0)
    return agg.select(F.when(F.col("_all") == 0, F.col("task")).alias("task"), "n_episodes", "n_successes", rate.alias("success_rate"), F.coalesce("mean_reward", F.lit(0.0)).alias("mean_reward"), F.coalesce("mean_steps", F.lit(0.0)).alias("mean_steps"))


def save(results: DataFrame, path: str) -> None:
    """results as CSV, and summary.json."""
    results.write.mode("overwrite").option("header", True).csv(f"{path}/results")
    rows = [r.asDict() for r in metrics(results).orderBy(F.col("task").asc_nulls_last()).collect()]  # as many as there are tasks
    overall = next((r for r in rows if r["task"] is None), {"task": None, "n_episodes": 0, "n_successes": 0, "success_rate": 0.0, "mean_reward": 0.0, "mean_steps": 0.0})
    Path(path, "summary.json").write_text(json.dumps({"overall": overall, "tasks": {r["task"]: r for r in rows if r["task"] is not None}}, indent=2))
