import math

import pytest
from pyspark.sql import functions as F

from stepweave.operators import validators as V
from stepweave.sources.schema import ActionMetadata, DatasetSpec, FeatureSpec


def found(df):
    return sorted((r.severity, r.ord, r.episode_id, r.step_index, r.field) for r in df.collect())


def test_a_good_episode_has_no_findings(make_steps, observe):
    df = make_steps([{"observation": {"observation.state": observe([0.0] * 7)}} for _ in range(10)])
    spec = DatasetSpec("d", {"observation.state": FeatureSpec("float32", (7,))}, FeatureSpec("float32", (7,)))
    assert found(V.validate(df, df.select("episode_id").distinct(), spec.frame(df.sparkSession))) == []


def test_rlds(make_steps, spark):
    df = make_steps([{"is_first": False}, {"is_first": True}, {"is_last": True, "is_terminal": True}, {"is_last": False, "is_terminal": True, "action": [1.0]}])
    assert [(s, o, i) for s, o, _, i, _ in found(V.rlds(df))] == [("ERROR", 101, 0), ("ERROR", 102, 3), ("ERROR", 104, 1), ("ERROR", 105, 2), ("WARN", 103, 3), ("WARN", 106, 3)]
    quiet = make_steps([{"is_last": True}, {"is_first": True}])  # at the ends only the own flag is looked at
    assert found(V.rlds(quiet)) == []
    everyone = spark.createDataFrame([("e0",), ("none",)], "episode_id string")
    assert ("ERROR", 100, "none", None, None) in found(V.rlds(df, everyone))


def test_length(make_steps, spark):
    df = make_steps([{}], [{}] * 4)
    assert [(s, e) for s, _, e, _, _ in found(V.length(df, 2, 3))] == [("ERROR", "e0"), ("WARN", "e1")]
    assert [(e) for _, _, e, _, _ in found(V.length(df, 1, 9, spark.createDataFrame([("x",)], "episode_id string")))] == ["x"]


def test_timestamps(make_steps):
    df = make_steps([{"timestamp": t} for t in (0.0, 0.2, 0.1, 0.1, 0.5)])
    assert [(s, i) for s, _, _, i, _ in found(V.timestamps(df))] == [("ERROR", 2), ("WARN", 4)]
    assert found(V.timestamps(make_steps([{"timestamp": 5.0}]))) == []


def test_action_sanity(make_steps):
    nan, inf = float("nan"), float("inf")
    df = make_steps([{"action": [nan, 0.0]}, {}], [{"action": [0.0, 11.0]}, {"action": [-12.0, 0.0]}, {}], [{"action": [inf, 0.0]}, {}])
    assert [(s, o, e, i) for s, o, e, i, _ in found(V.action_sanity(df))] == [("ERROR", 402, "e0", None), ("ERROR", 402, "e2", None), ("WARN", 401, "e1", 0), ("WARN", 401, "e2", 0)]
    outlier = make_steps([{"action": [0.0]} for _ in range(40)] + [{"action": [9.0]}, {}])
    assert [(o, i) for _, o, _, i, _ in found(V.action_sanity(outlier))] == [(403, 40)]
    few = make_steps([{"action": [0.0]} for _ in range(20)] + [{"action": [9.0]}, {}])
    assert found(V.action_sanity(few)) == []
    assert math.isnan(nan)


def test_schema(make_steps, observe):
    df = make_steps([{"observation": {"a": observe([1.0], "float64"), "b": observe([1.0], "int8"), "c": observe([1.0, 2.0]), "t": observe(text="x")}, "action": [1.0]}, {"action": [1.0, 2.0]}, {}])
    spec = DatasetSpec("d", {k: FeatureSpec(t, (1,)) for k, t in (("a", "float32"), ("b", "uint8"), ("c", "float32"), ("t", "float32"), ("z", "float32"))}, FeatureSpec("int32", (2,))).frame(df.sparkSession)
    assert [(s, o, i, f) for s, o, _, i, f in found(V.schema(df, spec))] == [("ERROR", 501, None, "z"), ("ERROR", 504, 0, "action"), ("WARN", 502, None, "b"), ("WARN", 503, None, "c")]
    assert ("ERROR", 503) in [(s, o) for s, o, *_ in found(V.schema(df, spec, strict=True))]


def test_images(make_steps, observe):
    k = "observation.images."
    img = lambda dtype="uint8", shape=(2, 2, 3), num=None: observe(num, dtype, list(shape))
    df = make_steps([{"observation": {k + "a": img(), k + "b": img(shape=(2,)), k + "c": img(shape=(0, 2, 3)), k + "d": img("float32", num=[float("inf")]), k + "e": observe(text="x")}}, {"observation": {k + "a": img(shape=(3, 2, 3)), k + "f": img(), k + "b": img(shape=(2,)), k + "c": img(shape=(0, 2, 3)), k + "d": img("float32", num=[1.0])}}])
    got = [(o, i, f[-1]) for _, o, _, i, f in found(V.image_integrity(df))]
    assert sorted(got) == sorted([(603, 0, "b"), (603, 1, "b"), (604, 0, "c"), (604, 1, "c"), (602, 0, "d"), (602, 1, "d"), (605, 0, "d"), (601, 0, "e")])
    assert [(s, o, i, f[-1]) for s, o, _, i, f in found(V.image_alignment(df))] == [("ERROR", 701, 1, "e"), ("ERROR", 703, 1, "a"), ("WARN", 702, 1, "f")]
    assert found(V.image_alignment(make_steps([{}, {"observation": {k + "a": img()}}]))) == []


def test_structure(make_steps, observe):
    df = make_steps([{}, {}], [{"is_last": True}, {"observation": {"a": observe([1.0])}}])
    assert [(r.n_first, r.n_last, r.key_sets, r.consistent) for r in V.structure(df).orderBy("episode_id").collect()] == [(1, 1, 1, True), (1, 2, 2, False)]


def test_triage_modes_and_summaries(make_steps):
    df = make_steps([{"timestamp": 1.0}, {"timestamp": 0.0}, {"timestamp": 9.0}], [{"timestamp": 0.0}, {"timestamp": 9.0}], [{}])
    episodes, f = df.select("episode_id").distinct(), V.timestamps(df)
    verdicts = lambda m: {r.episode_id: (r.verdict, r.flagged) for r in V.triage(episodes, f, m).collect()}
    assert verdicts("collect") == {"e0": ("error", True), "e1": ("invalid", False), "e2": ("valid", False)}
    assert verdicts("quarantine")["e1"] == ("invalid", True)
    with pytest.raises(V.ValidationFailed, match="e0"):
        verdicts("fail_fast")
    assert {tuple(r) for r in V.summary(f).collect()} == {("ERROR", "timestamps", 1), ("WARN", "timestamps", 2)}
    assert [tuple(r) for r in V.summary(f, first_decides=True).collect()] == [("ERROR", "timestamps", 3)]
    r = V.report(episodes, f).first()
    assert (r.episodes, r.valid_episodes, r.invalid_episodes, r.error_episodes, r.error_findings, r.warn_findings) == (3, 1, 1, 1, 1, 2)
    assert {r.severity for r in V.override(f, {"timestamps": "INFO"}).collect()} == {"INFO"}
    assert {r.code for r in V.coded(df, episodes=episodes).collect()} >= {"W201", "W202", "W003", "W004"}


def test_documented_rules(spark, make_steps, observe):
    img = lambda data=bytes(range(256)) * 3, shape=(16, 16, 3), dtype="uint8": observe(data=data, shape=list(shape), dtype=dtype)
    fine = {"observation": {"observation.state": observe([1.0]), "observation.images.front": img(), "observation.images.wrist": img(), "observation.language": observe(text="go")}, "reward": None, "is_terminal": False}
    one = lambda **k: fine | {"observation": {**fine["observation"], **{f"observation.{a.replace('_', '.')}": v for a, v in k.items()}}}
    nan, inf = float("nan"), float("inf")
    df = make_steps(
        [fine] * 5 + [fine | {"is_terminal": True}], [one(state=observe([nan])), one(state=observe([inf])), one(state=observe([1.0, 2.0])), one(state=observe([1.0], "float64")), fine],
        [one(images_front=img(dtype="int8")), one(images_front=img(shape=(16, 24, 2))), one(images_front=img(b"\0" * 768)), one(images_front=img(b"\0" * 12, (2, 2, 3))), fine],
        [fine | {"action": [nan] * 7}, fine | {"action": [inf] * 7}, fine | {"action": [11.0] * 7, "timestamp": 0.5}, fine | {"timestamp": None}, fine | {"action": [0.0] * 7, "reward": 1.0, "timestamp": 3.0}],
        [{"is_first": False, "observation": {"observation.language": observe(data=b"x", shape=[], dtype="string")}}, {"is_terminal": None}], [fine | {"observation": {"observation.images.front": img()}}] * 5,
    )
    spec = DatasetSpec("", {"observation.images.front": FeatureSpec("uint8", (16, 16, 3)), "observation.images.wrist": FeatureSpec("uint8", (16, 16, 3))}, control_rate_hz=10.0, cameras=["front", "wrist"])
    episodes = df.select("episode_id").distinct().union(spark.createDataFrame([("none",)], "episode_id string"))
    got: dict = {}
    for r in V.coded(df.withColumn("robot_id", F.when(F.col("episode_id") != "e1", "arm")), spec, episodes).collect():
        assert r.message == V.CODES[r.code] and r.severity == {"E": "ERROR", "W": "WARN", "I": "INFO"}[r.code[0]]
        got.setdefault(r.episode_id, set()).add((r.code, r.step_index, (r.field or "").removeprefix("observation.")))
    s, f = "state", "images.front"
    assert got["e0"] == set() if "e0" in got else True
    assert got["e1"] == {("W101", 0, s), ("W102", 1, s), ("E005", None, s), ("E006", None, s), ("W006", 4, ""), ("W502", 0, "")}
    assert got["e2"] == {("W301", 0, f), ("W302", 1, f), ("I301", 2, f), ("I302", 1, f), ("E005", None, f), ("E006", None, f), ("W006", 4, "")}
    assert got["e3"] >= {("W103", 0, ""), ("W104", 1, ""), ("W105", 1, ""), ("I201", 3, ""), ("W002", 4, ""), ("W003", 4, ""), ("W202", 2, ""), ("I202", None, "")}
    assert got["e4"] >= {("E001", None, ""), ("E004", None, ""), ("W001", 1, ""), ("W004", None, ""), ("W008", 0, ""), ("W402", None, "images.front"), ("W402", None, "images.wrist")}
    assert got["e5"] == {("W402", None, "images.wrist"), ("I401", None, ""), ("W007", None, ""), ("W006", 4, "")}
    assert got["none"] == {("E003", None, "")} and got[None] == {("W501", None, ""), ("W503", None, "")}


def test_action_metadata(spark):
    df = spark.createDataFrame([("a", "ee_delta_7", 7), ("b", "ee_abs_7", 6), ("c", "custom", 0)], "dataset_id string, action_space_type string, dim int")
    assert sorted(r.dataset_id for r in V.action_metadata(df).collect()) == ["b", "c"]
    assert ActionMetadata("ee_delta_7", 6).problems() and not ActionMetadata("joint_abs", 9).problems()
    assert ActionMetadata.from_dict({"action_type": "joint_abs", "gripper_range": [0, 2]}).gripper_range == (0, 2)
