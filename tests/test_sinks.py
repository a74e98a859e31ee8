import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepweave.operators import index as X
from stepweave.operators import validators as V
from stepweave.plans import cli
from stepweave.plans import compile as C
from stepweave.plans import logs
from stepweave.sources import examples, records, sinks
from stepweave.sources.adapters import Adapter, directory, probe, record_steps
from stepweave.sources.schema import DatasetSpec, FeatureSpec


@pytest.fixture
def steps(make_steps, observe):
    obs = {"observation.state": observe([1.0, 2.0]), "observation.language": observe(text="go")}
    good = [{"observation": obs, "action": [1.0, 2.0], "reward": 0.5, "discount": 0.0} for _ in range(4)] + [{"observation": obs}]
    bad = [dict(s) for s in good]
    bad[0] = bad[0] | {"timestamp": 99.0}
    return make_steps(good, good, bad, [dict(s, timestamp=i * 5.0) for i, s in enumerate(good)])


def test_compile_end_to_end(steps, spark, tmp_path):
    out = str(tmp_path / "c")
    r = C.Compiler("d", rows_per_shard=6).add_transform("pad_action", target_dim=3).add_validator("timestamps").compile(steps, spark, out)
    index = {x.episode_id: (x.parquet_file, x.parquet_row_start, x.parquet_row_end) for x in r.index.collect()}
    assert index == {"e0": ("data/chunk=0/shard=0", 0, 5), "e1": ("data/chunk=0/shard=0", 5, 10), "e3": ("data/chunk=0/shard=1", 0, 5)} and not (tmp_path / "c/_staged").exists()
    rows = spark.read.parquet(f"{out}/{index['e1'][0]}").collect()
    assert {x.episode_id for x in rows[5:10]} == {"e1"} and {x.episode_id for x in rows[:5]} == {"e0"}
    assert r.success and r.report["error_episodes"] == 1 and r.report["invalid_episodes"] == 1 and r.report["valid_episodes"] == 2
    stored = spark.read.parquet(f"{out}/data")
    assert stored.count() == 15 and [len(a) for a in stored.where("action is not null").toPandas()["action"]] == [3] * 12
    assert sorted(stored.toPandas()["frame_index"]) == list(range(15))
    assert stored.groupBy("episode_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()
    assert {"observation_state", "observation_language", "reward", "discount"} <= set(stored.columns)
    index = X.read(spark, f"{out}/meta/episodes.parquet")
    assert sorted((x.episode_id, x.invalid, x.task_text) for x in index.collect()) == [("e0", False, "go"), ("e1", False, "go"), ("e3", True, "go")]
    info = json.loads(Path(out, "meta/info.json").read_text())
    assert info["total_episodes"] == 3 and info["total_frames"] == 15
    assert json.loads(Path(out, "meta/tasks.jsonl").read_text()) == {"task_index": 0, "task": "go"}
    assert json.loads(Path(out, "meta/stats.json").read_text())["action"]["mean"] == [1.0, 2.0, 0.0]
    m = json.loads(Path(out, "meta/manifest.json").read_text())
    assert m["status"] == "sealed" and m["transforms"] == ["pad_action"] and len(m["build_id"]) == 12
    assert json.loads(Path(out, "meta/checksums.json").read_text())
    assert C.training_steps(spark, out).count() == 10 and C.training_steps(spark, out, skip_invalid=False).count() == 15
    with pytest.raises(V.ValidationFailed):
        C.Compiler("d", fail_fast=True).compile(steps, spark, out)


def test_validate_only(steps, spark):
    findings, report = C.Compiler("d").validate_only(Adapter("d", lambda s: steps), spark, max_episodes=2)
    assert findings.count() == 0 and report.first().episodes == 2


def test_slices(steps, spark, tmp_path):
    index = X.build(steps)
    m = sinks.write_slice(index, X.Query(min_steps=9), str(tmp_path / "none"))
    assert m["num_episodes"] == 0 and spark.read.parquet(f"{tmp_path}/none/meta/episodes.parquet").count() == 0
    m = sinks.write_slice(index, X.Query(task_id=0), str(tmp_path / "all"), steps)
    assert m["mode"] == "copy" and m["filter"] == {"task_id": 0} and spark.read.parquet(f"{tmp_path}/all/data").count() == steps.count()


def test_manifest(tmp_path):
    a, b = (sinks.Manifest("d", {"x": 1, "y": k}) for k in (1, 2))
    assert a.build_id == sinks.Manifest("d", {"y": 1, "x": 1}).build_id != b.build_id
    assert len(a.config_hash) == 16 and sinks.Manifest("d", a.config, at="now").build_id != a.build_id
    a.seal(str(tmp_path))
    assert sinks.Manifest.load(str(tmp_path)).status == "sealed"


def test_verify_and_checksums(steps, spark, tmp_path):
    index = X.build(steps)
    assert sinks.verify(index, 20) == [] and sinks.verify(index, 21)
    broken = index.withColumn("parquet_row_start", F.lit(0).cast("bigint"))
    assert "overlap" in sinks.verify(broken, 20)[0]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/a.txt").write_bytes(b"abc")
    r = sinks.checksums(spark, str(tmp_path)).first()
    assert r.file == "meta/a.txt" and r.sha == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_nested_export(steps, spark, tmp_path):
    spec = probe(steps, "d")
    assert spec.action == FeatureSpec("float32", (2,)) and set(spec.observation) == {"observation.state", "observation.language"}
    sinks.write_nested(steps, spec, str(tmp_path / "n"), 2)
    back = spark.read.parquet(str(tmp_path / "n"))
    assert sorted(r.shard for r in back.collect()) == [0, 0, 1, 1]
    last = back.where("episode_id = 'e0'").first().steps[-1]
    assert last.action == [0.0, 0.0] and last.is_last and back.where("episode_id = 'e0'").first().steps[0].discount == 0.0
    assert sinks.nested(steps, spec, parity=True).first().steps[0].discount == 1.0
    assert [f.name for f in sinks.export_schema(spec)["steps"].dataType.elementType.fields][:2] == ["observation", "action"]
    sinks.write_nested(steps, spec, str(tmp_path / "r"), 2, "tfrecord")
    spark.dataSource.register(records.RecordSource)
    got = spark.read.format("records").load(str(tmp_path / "r"))
    name, lists = examples.decode_episode(bytes(got.orderBy("path", "position").first().record))
    assert got.count() == 4 and name == "e0" and len(lists["is_first"]) == 5 and len(lists["action"][-1]) == 0
    again = record_steps(spark, str(tmp_path / "r"), "d", spec).orderBy("episode_index", "step_index").collect()
    was = steps.orderBy("episode_index", "step_index").collect()
    assert [(r.step_index, r.is_first, r.is_last, r.is_terminal, r.action, r.reward, r.observation["observation.state"].num) for r in again] == [(r.step_index, r.is_first, r.is_last, r.is_terminal, r.action, r.reward, r.observation["observation.state"].num) for r in was]


def test_the_specs_rate_counts(steps, spark, tmp_path):
    slow = steps.withColumn("timestamp", F.col("step_index") * 0.5)
    spec = DatasetSpec("d", control_rate_hz=2.0)
    names = ["timestamps"]
    assert C.Compiler("d", validators=names).validate_only(slow, spark, spec=spec)[0].count() == 0
    assert C.Compiler("d", validators=names).validate_only(slow, spark)[0].count() == 16
    still = steps.withColumn("timestamp", F.lit(0.0))
    fixed = C.Compiler("d").add_transform("timestamp_canonicalize").transformed(still, spec)
    assert [r.timestamp for r in fixed.where("episode_id = 'e0'").orderBy("step_index").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_no_episodes(steps, spark, tmp_path):
    r = C.Compiler("d").compile(steps.limit(0), spark, str(tmp_path / "none"))
    assert r.index.count() == 0 and spark.read.parquet(str(tmp_path / "none/data")).count() == 0


def test_examples_round_trip():
    features = {"a": [b"x", "y"], "b": [1.5, -2.0], "c": [-1, 3, 2**40], "d": "text", "e": [], "f": True}
    back = examples.decode_example(examples.encode_example(features))
    assert (back["a"], back["b"].tolist(), back["c"].tolist(), back["d"], list(back["e"]), back["f"].tolist()) == ([b"x", b"y"], [1.5, -2.0], [-1, 3, 2**40], [b"text"], [], [1])
    # by hand: {'n': int64 list [1, 300]}, not packed
    raw = bytes([0x0A, 0x0E, 0x0A, 0x0C, 0x0A, 0x01]) + b"n" + bytes([0x12, 0x07, 0x1A, 0x05, 0x08, 0x01, 0x08, 0xAC, 0x02])
    assert examples.decode_example(raw)["n"].tolist() == [1, 300]
    flat = examples.encode_example({"steps/is_first": [1, 0], "steps/is_last": [0, 1], "steps/action": [1.0, 2.0, 3.0, 4.0], "steps/observation/state": [0.5, 1.5], "steps/language_instruction": ["go", "go"]})
    name, rows = examples.step_rows(flat)
    assert name == "" and [r["action"] for r in rows] == [[1.0, 2.0], [3.0, 4.0]] and rows[1]["observation"]["observation.state"]["num"] == [1.5] and rows[0]["observation"]["observation.language_instruction"]["str"] == "go"
    with pytest.raises(ValueError, match="ends inside"):
        examples.decode_example(raw[:-1])


def test_videos_go_through_the_encoder(spark, tmp_path):
    frames = spark.createDataFrame([(c, e, i, 2, 2, bytes([e * 10 + i] * 12)) for c in ("front", "wrist") for e in range(3) for i in range(2)], "camera string, episode_index long, step_index int, height int, width int, data binary")
    placed = spark.createDataFrame([(c, e, e // 2) for c in ("front", "wrist") for e in range(3)], "camera string, episode_index long, shard int")
    out = sinks.encode_videos(frames, placed, str(tmp_path), ["sh", "-c", "cat > {out}"]).collect()
    assert sorted((r.camera, r.shard, r.frames) for r in out) == [("front", 0, 4), ("front", 1, 2), ("wrist", 0, 4), ("wrist", 1, 2)]
    assert (tmp_path / "videos/front/shard_00000.mp4").read_bytes() == b"".join(bytes([k] * 12) for k in (0, 1, 10, 11))
    with pytest.raises(Exception, match="failed on"):
        sinks.encode_videos(frames, placed, str(tmp_path), ["sh", "-c", "cat > /dev/null; exit 3"]).collect()


def test_merge_of_data_sets(steps, spark):
    other = steps.withColumn("dataset_id", F.lit("other")).withColumn("more", F.lit(1))
    both = sinks.merge(steps.where("episode_index < 2"), other)
    assert both.count() == steps.where("episode_index < 2").count() + steps.count()
    ids = {r.episode_id for r in both.select("episode_id").distinct().collect()}
    assert {"d/e0", "other/e0", "e2"} <= ids and "e0" not in ids


def test_reports_and_logs(steps, tmp_path):
    findings = V.length(steps, 6, 100)
    page = sinks.report_html(V.report(steps.select("episode_id").distinct(), findings), findings)
    assert page.startswith("<!doctype html>") and "too short" in page
    out = io.StringIO()
    logs.configure(stream=out)
    with logs.context(job="x"), logs.timed("work", part=1) as more:
        more["rows"] = 3
    with pytest.raises(ZeroDivisionError), logs.timed("bad"):
        1 / 0
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["message"] == "work" and (first["job"], first["part"], first["rows"]) == ("x", 1, 3) and first["seconds"] >= 0 and second["failed"] == "ZeroDivisionError" and "job" not in second


def test_record_framing(tmp_path):
    assert records.crc32c(b"123456789") == 0xE3069283
    p = tmp_path / "x.tfrecord"
    p.write_bytes(records.frame(b"") + records.frame(b"hello"))
    assert list(records.read_records(str(p))) == [b"", b"hello"]
    p.write_bytes(p.read_bytes()[:-1])
    with pytest.raises(ValueError, match="ends inside"):
        list(records.read_records(str(p)))
    p.write_bytes(records.frame(b"hello").replace(b"hello", b"hallo"))
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_records(str(p)))


def test_card_and_reports(steps, tmp_path):
    index = X.build(steps.withColumn("robot_id", F.lit("arm")))
    text = Path(sinks.write_card(index, "mine", str(tmp_path))).read_text()
    assert "4 episodes, 20 steps" in text and "- arm" in text
    sinks.write_findings(V.timestamps(steps), str(tmp_path))
    assert sinks.write_report(V.report(index, V.timestamps(steps)), str(tmp_path))["error_findings"] == 1


def test_cli(steps, spark, tmp_path, capsys):
    steps.write.parquet(str(tmp_path / "s"))
    assert directory(spark, str(tmp_path / "s")).count() == 20
    assert cli.main(["validate", str(tmp_path / "s")], spark) == 1
    assert cli.main(["compile", str(tmp_path / "s"), str(tmp_path / "o")], spark) == 1
    assert cli.main(["slice", str(tmp_path / "o"), str(tmp_path / "v"), "--where", "num_steps > 3", "--limit", "1"], spark) == 0
    assert X.read(spark, f"{tmp_path}/v/meta/episodes.parquet").count() == 1
    assert cli.main(["inspect", str(tmp_path / "o")], spark) == 0 and '"num_episodes": 3' in capsys.readouterr().out
    assert cli.main(["nothing"], spark) == 2


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("writer: {rows: 1, codec: a}\ndatasets: {x: {writer: {rows: 2}}}\n")
    assert C.load_config(str(p), "x")["writer"] == {"rows": 2, "codec": "a"} and C.load_config(str(p))["writer"]["rows"] == 1
    table: dict = {}
    C.register(table, "f")(len)
    assert C.lookup(table, "f") is len
    assert DatasetSpec("d").rows() == []
