import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import actions as A
from stepweave.functions.text import decoded, normalize_text
from stepweave.operators import stats
from stepweave.operators import transforms as T
from stepweave.plans import compile as C


def column(df, name="action"):
    return [r[0] for r in df.orderBy("episode_index", "step_index").select(name).collect()]


def test_repair_timestamps(make_steps):
    times = [0.0, 0.0, 0.05, 1.0, None]
    df = make_steps([{"timestamp": t} for t in times]).transform(T.repair_timestamps(10.0))
    assert column(df, "timestamp") == pytest.approx([0.0, 0.1, 0.2, 1.0, 1.1])
    long = make_steps([{"timestamp": t} for t in times]).transform(T.repair_timestamps(10.0, fold_steps=2))
    assert column(long, "timestamp") == pytest.approx(column(df, "timestamp"))


def test_resample(make_steps):
    df = make_steps([{"timestamp": t, "reward": float(i)} for i, t in enumerate([0.0, 0.12, 0.31, 0.5])], [{"timestamp": 3.0}, {"timestamp": 3.0}]).transform(T.resample(10.0))
    rows = df.where("episode_index = 0").orderBy("step_index").collect()
    assert [r.reward for r in rows] == [0, 1, 1, 2, 2]
    assert [r.is_first for r in rows] == [True] + [False] * 4 and [r.is_last for r in rows] == [False] * 4 + [True] and rows[-1].is_terminal
    assert df.where("episode_index = 1").count() == 2  # lasts no time: as it was


def test_resample_against_numpy(make_steps):
    rng = np.random.default_rng(3)
    t = np.round(np.cumsum(rng.uniform(0, 0.3, 40)), 3)
    df = make_steps([{"timestamp": float(x), "reward": float(i)} for i, x in enumerate(t)]).transform(T.resample(7.0))
    target = np.arange(t[0], t[-1], 1 / 7.0)
    assert [int(r) for r in column(df, "reward")] == [int(np.argmin(np.abs(t - x))) for x in target]


def test_normalize_actions(make_steps):
    df = make_steps([{"action": [0.0, 5.0]}, {"action": [10.0, 5.0]}, {"action": [5.0, 5.0]}, {}])
    assert column(df.transform(T.normalize_actions())) == [[-1.0, 1.0], [1.0, 1.0], [0.0, 1.0], None]  # the second doesn't vary: itself, clipped
    assert column(df.transform(T.normalize_actions((0.0, 10.0)))) == [[-1.0, 0.0], [1.0, 0.0], [0.0, 0.0], None]
    assert column(df.transform(T.normalize_actions((0.0, 1.0), clip=False)))[1] == [19.0, 9.0]
    assert column(df.transform(T.normalize_actions(scope="dataset")))[0] == [-1.0, 1.0]


def test_nan_stays(spark):
    df = spark.range(1).select(A.to_unit(F.array(F.lit(float("nan")), F.lit(9.0)), 0.0, 1.0).alias("a"))
    a = df.first().a
    assert math.isnan(a[0]) and a[1] == 1.0


def test_pad_and_map(make_steps):
    df = make_steps([{"action": [1.0, 2.0, 3.0]}], [{"action": [float(x) for x in range(10)]}])
    assert column(df.transform(T.pad_actions(5, 9.0))) == [[1, 2, 3, 9, 9], [0, 1, 2, 3, 4]]
    assert column(df.transform(T.map_action_space("custom", "ee_delta_7"))) == [[1, 2, 3, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 9]]
    assert column(df.transform(T.map_action_space("custom", "ee_delta_7", 3)))[1] == [0, 1, 2, 3, 4, 5, 3]
    assert column(df.transform(T.map_action_space("custom", "joint_6")))[1] == [0, 1, 2, 3, 4, 5]
    assert len(column(df.transform(T.map_action_space("custom", "joint_7_gripper")))[0]) == 8


def test_to_env(spark):
    assert spark.range(1).select(A.to_env(F.array(F.lit(2.0), F.lit(-3.0)), 3).alias("a")).first().a == [1.0, -1.0, 0.0]


def test_select_camera(make_steps, observe):
    img = lambda n: {f"observation.images.{n}": observe(None, "uint8", [1, 1, 3], data=b"abc")}
    df = make_steps([{"observation": img("wrist") | img("front")}, {"observation": img("wrist")}], [{"observation": img("b") | img("a")}], [{"observation": {}}])
    keys = column(df.transform(T.select_camera()).select("episode_index", "step_index", F.array_sort(F.map_keys("observation")).alias("k")), "k")
    c = "observation.images.canonical"
    assert [c in k for k in keys] == [True, False, True, False]
    named = df.transform(T.select_camera("wrist", target_key="x"))
    assert [("x" in k) for k in column(named.select("episode_index", "step_index", F.map_keys("observation").alias("k")), "k")] == [True, True, False, False]


def test_images(make_steps, observe):
    x = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    df = make_steps([{"observation": {"observation.images.front": observe(None, "uint8", [4, 6, 3], data=x.tobytes()), "observation.state": observe([1.0])}}])
    v = df.transform(T.resize_images((2, 3))).first().observation
    assert np.array_equal(np.frombuffer(v["observation.images.front"]["bin"], np.uint8).reshape(2, 3, 3), x[[0, 2]][:, [0, 2, 4]])
    assert v["observation.state"]["num"] == [1.0]
    chw = make_steps([{"observation": {"observation.images.front": observe(None, "uint8", [3, 4, 6], data=x.transpose(2, 0, 1).tobytes())}}])
    w = chw.transform(T.standardize_images((4, 6), channels_first=True, dtype="float32")).first().observation["observation.images.front"]
    assert w["shape"] == [3, 4, 6] and w["dtype"] == "float32"
    both = chw.transform(T.standardize_images((2, 3), interpolation="bilinear", record_shapes=True)).first()
    assert both.image_shapes == {"observation.images.front": [3, 4, 6]} and both.observation["observation.images.front"]["shape"] == [2, 3, 3]
    # halved: each place takes 1 : 3 : 3 : 1 of those around it, what there is of them
    line = np.array([[[0], [10], [20], [30]]], np.uint8)
    assert T.bilinear(line, 1, 2).ravel().tolist() == [7, 23] and T.bilinear(line, 1, 4).ravel().tolist() == [0, 10, 20, 30] and T.bilinear(line, 1, 8).ravel().tolist() == [0, 2, 8, 12, 18, 22, 28, 30]
    none = make_steps([{"observation": None}, {"observation": {}}]).transform(T.resize_images((2, 2)))
    assert [r.observation for r in none.orderBy("step_index").collect()] == [None, {}]


def test_task_texts(make_steps, observe):
    lang = lambda t: {"observation.language": observe(text=t)}
    df = make_steps([{"observation": lang(" pick  up ")}], [{"observation": lang("open")}], [{"observation": lang("pick up")}], [{}]).withColumn("instruction", F.when(F.col("episode_index") == 3, "from metadata"))
    texts = T.task_texts(df)
    got = {r.episode_index: (r.task_id, r.task_text) for r in T.with_task_ids(texts).collect()}
    assert got == {0: (0, "pick up"), 1: (1, "open"), 2: (0, "pick up"), 3: (2, "from metadata")}
    with pytest.raises(Exception, match="no task text"):
        T.task_texts(make_steps([{}])).collect()
    assert T.task_texts(make_steps([{}]), "do", False).first().task_text == "do"


def test_normalize_text(spark):
    rows = [("ｆｕｌｌ　ｗｉｄｔｈ",), (" a\t\n b ",), (None,), ("",), ("é",)]
    df = spark.createDataFrame(rows, "t string").select(normalize_text(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["full width", "a b", "", "", "é"]
    b = spark.createDataFrame([(b"a\xffb",), (None,)], "b binary").select(decoded("b").alias("x"))
    assert [r.x for r in b.collect()] == ["a�b", None]


def test_stats_and_standardizing(make_steps, spark, observe):
    df = make_steps([{"action": [1.0, 2.0, 3.0], "observation": {"observation.state": observe([4.0])}}, {"action": [2.0, 3.0, 4.0]}, {}])
    s = stats.feature_stats(df)
    a = s.where("feature = 'action'").orderBy("dim").collect()
    assert [r["mean"] for r in a] == [1.5, 2.5, 3.5] and {r["count"] for r in a} == {2} and [r["std"] for r in a] == [0.5] * 3
    again = stats.from_json(spark, stats.to_json(s))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, s.select(again.columns).collect()))
    there = df.transform(T.normalize_features(s))
    assert column(there)[0] == [-1.0] * 3
    assert column(there.transform(T.normalize_features(s, undo=True)))[:2] == [[1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]
    with pytest.raises(Exception, match="different widths"):
        stats.feature_stats(make_steps([{"action": [1.0]}, {"action": [1.0, 2.0]}, {}])).collect()


def test_chain_and_config(make_steps):
    df = make_steps([{"action": [1.0, 2.0]}, {}])
    assert T.chain()(df) is df
    steps = C.from_config({"transforms": ["identity", {"name": "pad_action", "params": {"target_dim": 3}}, {"name": "normalize_actions", "action_bounds": [0, 4]}]})
    assert [n for n, _ in steps] == ["identity", "pad_action", "normalize_actions"]
    assert column(T.chain(*[t for _, t in steps])(df)) == [[-0.5, 0.0, -1.0], None]
    with pytest.raises(KeyError, match="none of"):
        C.from_config({"transforms": ["nothing"]})


def test_history_and_series(make_steps):
    df = make_steps([{"action": [float(i)]} for i in range(4)])
    assert column(df.transform(T.history(1)), "action_history")[2] == [[1.0], [2.0]]
    assert T.episode_series(df).first().actions == [[0.0], [1.0], [2.0]]
