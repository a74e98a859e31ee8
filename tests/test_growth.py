"""What must not grow faster than the input: tasks, shuffles, what one task holds."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stepweave.operators import shards
from stepweave.operators import transforms as T
from stepweave.operators import validators as V
from stepweave.sources import adapters as S
from stepweave.sources import examples, records

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_many_record_files_are_few_tasks(tmp_path):
    for k in range(1000):
        (tmp_path / f"shard-{k:05d}.tfrecord").write_bytes(b"".join(records.frame(b"x" * (k % 7)) for _ in range(k % 3)))
    parts = records._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) <= 64 and sum(len(p.paths) for p in parts) == 1000
    counts = records._Reader({"path": str(tmp_path), "counts": "true"})
    assert [n for p in parts for _, n, _ in counts.read(p)] == [k % 3 for k in range(1000)]


def test_episodes_encoded_and_read_by_columns_are_the_same():
    value = lambda num=None, data=None, text=None: {"dtype": "x", "shape": [1], "num": num, "bin": data, "str": text}
    some = [{}, {"a.b": value([1.5, None or 2.0])}, {"a.b": value([]), "language": value(text="é" * 70)}, {"image": value(data=b"\x00" * 300), "z": None, "n": value()}]
    episodes = [[{"step_index": i, "is_first": i == 0, "is_last": None, "is_terminal": True, "reward": None if i % 2 else i / 3, "discount": [None, 0.0, 0.5][i % 3], "action": None if i == 2 else [0.1] * (i * 20), "observation": some[(i + e) % 4]} for i in range(n)] for e, n in enumerate((5, 0, 1, 9))]
    listed = [[s | {"observation": [{"key": k, "value": v} for k, v in s["observation"].items()]} for s in x] for x in episodes]
    kind = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("num", pa.list_(pa.float64())), ("bin", pa.binary()), ("str", pa.string())])
    step = pa.struct([("step_index", pa.int32()), *[(n, pa.bool_()) for n in ("is_first", "is_last", "is_terminal")], ("reward", pa.float64()), ("discount", pa.float64()), ("action", pa.list_(pa.float64())), ("observation", pa.list_(pa.struct([("key", pa.string()), ("value", kind)])))])
    column = pa.array([[], *listed], pa.list_(step)).slice(1)
    ids = [f"e{k}" for k in range(len(episodes))]
    for parity in (False, True):
        made = examples.encode_episodes(ids, column, parity)
        assert made == [examples.encode_episode(i, x, parity) for i, x in zip(ids, episodes, strict=True)]
    for spec in (None, {"a.b": ("float64", [2]), "observation.language": ("string", [])}):
        got = examples.step_arrays(made, spec).to_pylist()
        assert [[s | {"observation": dict(s["observation"])} for s in x] for x in got] == [examples.step_rows(r, spec)[1] for r in made]


def test_checksums_of_all_lengths():
    slow = lambda data: __import__("functools").reduce(lambda c, b: records._SLOW[(c ^ b) & 0xFF] ^ (c >> 8), data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    data = random.Random(1).randbytes(20_000)
    assert all(records.crc32c(data[:n]) == slow(data[:n]) for n in (*range(40), 2047, 2048, 2049, 2055, 2064, 5000, 16_390, 20_000))


def test_steps_are_shuffled_once(spark):
    text = plan(S.order_steps(spark, DATA).groupBy("episode_id").count())
    assert text.count("Exchange hashpartitioning(episode_id") == text.count("Exchange hashpartitioning") == 2  # lines and orders


def test_shards_do_not_depend_on_buckets(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET", 7)
    draw = random.Random(2)
    sizes = [(k * 3, draw.choice((0, 1, 2, 9, 30, 120))) for k in range(300)]
    expected, used, shard = [], 0, 0
    for k, n in sizes:
        expected.append((k, shard))
        used += n
        if used >= 40:
            shard, used = shard + 1, 0
    last = {s: k for k, (_, s) in enumerate(expected)}
    got = shards.flush_shards(spark.createDataFrame(sizes, "episode_index long, num_steps long"), 40, 5).orderBy("episode_index").collect()
    assert [tuple(r) for r in got] == [(k, s, last[s] // 5, f"chunk-{last[s] // 5:03d}/steps_{s:05d}.parquet") for k, s in expected]


def test_one_task_places_shards_and_makes_nothing_else(spark):
    sizes = S.order_steps(spark, DATA).groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), F.count("*").alias("num_steps"))
    assert "Coalesce 1" not in plan(shards.flush_shards(sizes)) + plan(shards.pack(sizes, 40))


def test_tasks_become_more_as_files_do(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_BYTES", 1000)
    text = plan(S.order_steps(spark, DATA))
    assert int(text.split("Exchange hashpartitioning(episode_id#")[1].split(", ")[1].split(")")[0]) > 40


def test_no_windows_or_copies_of_rows_for_distinct_counts(spark):
    steps = S.order_steps(spark, DATA)
    assert plan(V.structure(steps)).count("Window") <= plan(steps).count("Window")
    assert "Expand" not in plan(V.coded(steps))


def test_repair_reads_steps_twice_at_most(spark):
    fixed = S.order_steps(spark, DATA).transform(T.repair_timestamps())
    assert "FlatMapGroupsInPandas" not in plan(fixed) and plan(fixed).count("FileScan") <= 4  # lines and orders


def test_report_makes_findings_once(spark):
    findings = spark.createDataFrame([("a", "ERROR"), ("a", "WARN"), ("b", "WARN"), ("x", "INFO")], "episode_id string, severity string").repartition(3)
    episodes = spark.createDataFrame([("a",), ("b",), ("c",)], "episode_id string")
    report = V.report(episodes, findings)
    assert plan(report).count("RoundRobinPartitioning(3)") == 1 and tuple(report.first()) == (3, 1, 1, 1, 1, 2, 1)
    assert tuple(V.report(episodes.limit(0), findings.limit(0)).first()) == (0,) * 7


def test_images_of_several_shapes_are_resized_as_one_by_one():
    draw = np.random.default_rng(3)
    for how in T._RESIZE:
        for kind in ("uint8", "float32"):
            images = [draw.integers(0, 255, (5, 7, 3)).astype(kind) for _ in range(9)]
            joined = np.stack(images).transpose(1, 2, 0, 3).reshape(5, 7, 27)
            got = T._RESIZE[how](joined, 3, 4).reshape(3, 4, 9, 3).transpose(2, 0, 1, 3)
            assert all(np.array_equal(x, T._RESIZE[how](i, 3, 4)) for x, i in zip(got, images, strict=True))
