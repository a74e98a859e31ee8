import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepweave.functions import hashing as H
from stepweave.functions import keys as K
from stepweave.functions import versions as N
from stepweave.operators import evaluate, shards
from stepweave.operators import index as X
from stepweave.sources import adapters as S
from stepweave.sources.schema import EPISODES, DatasetSpec, FeatureSpec, TaskCatalog, missing_columns, names


def ids(df):
    return sorted(r.episode_id for r in df.collect())


@pytest.fixture
def index(spark):
    rows = [("a", "d", "r1", 0, "Open É", 3, 0.2, 0.0, 0.2, "front,wrist", "custom", False), ("b", "d", "r2", 1, "close", 5, 0.4, 0.0, 0.4, "front_left", "custom", True), ("c", "e", "r3", 0, None, None, 0.0, 0.0, 0.0, "", "joint_abs", False)]
    df = spark.createDataFrame(rows, "episode_id string, dataset_name string, robot_id string, task_id int, task_text string, num_steps int, duration_secs double, start_timestamp double, end_timestamp double, camera_set string, action_space_type string, invalid boolean")
    return df.withColumn("split", F.lit("train"))


@pytest.mark.parametrize(
    ("q", "want"),
    [
        (X.Query(), "abc"), (X.Query(robot_id="r1"), "a"), (X.Query(robot_id=["r1", "r3"]), "ac"), (X.Query(task_id=0), "ac"), (X.Query(task_id=[1, 2]), "b"), (X.Query(task_text_regex="é$"), "a"), (X.Query(task_text_regex="o"), "ab"),
        (X.Query(min_steps=3), "ab"), (X.Query(max_steps=3), "a"), (X.Query(min_steps=4, max_steps=4), ""), (X.Query(camera_set="front"), "ab"), (X.Query(cameras=["front"]), "a"), (X.Query(invalid=True), "b"), (X.Query(invalid=False), "ac"),
        (X.Query(action_space_type="custom", dataset_name="d", split="train"), "ab"), (X.Query(split="val"), ""), (X.Query(robot_id=[]), ""),
    ],
)
def test_query(index, q, want):
    assert "".join(ids(X.query_ids(index, q))) == want
    assert X.count(index, q) == len(want)


def test_where_sql(index):
    assert ids(X.where_sql(index, "num_steps BETWEEN 1 AND 4 OR robot_id LIKE 'r3'")) == ["a", "c"]
    assert ids(X.where_sql(index, "true", limit=2)) == ["a", "b"]
    with pytest.raises(ValueError, match="subquery"):
        X.where_sql(index, "episode_id IN (SELECT 1)")
    assert ids(X.valid_only(index)) == ["a", "c"]


def test_build(make_steps, observe):
    img = {f"observation.images.{n}": observe(None, "uint8", [1, 1, 3]) for n in ("wrist", "front")}
    df = make_steps([{"timestamp": 5.0, "observation": img}, {"timestamp": 9.0}, {"timestamp": 1.0}], [{}])
    rows = X.build(df).orderBy("episode_id").collect()
    a = rows[0]
    assert list(a.asDict()) == names(EPISODES)
    assert (a.num_steps, a.start_timestamp, a.end_timestamp, a.duration_secs, a.camera_set, a.robot_id, a.split, a.parquet_row_start, a.parquet_row_end) == (3, 5.0, 1.0, -4.0, "front,wrist", "unknown", "train", 0, 3)
    assert (rows[1].parquet_row_start, rows[1].parquet_row_end, rows[1].camera_set) == (3, 4, "")
    assert missing_columns(df) == [n for n in names(EPISODES) if n != "episode_id"]


def test_read_fills_missing_columns(spark, tmp_path, index):
    index.select("episode_id", "num_steps").write.parquet(str(tmp_path / "i"))
    r = X.read(spark, str(tmp_path / "i")).where("episode_id = 'a'").first()
    assert (r.robot_id, r.split, r.action_space_type, r.video_offsets, r.task_id, r.task_text, r.num_steps) == ("unknown", "train", "custom", "{}", 0, "", 3)


def test_slices(make_steps):
    df = make_steps([{}, {}], [{}], [{}] * 3)
    assert X.slice_steps(df, X.query(X.build(df), X.Query(min_steps=2))).count() == 5
    assert X.without(df, df.where("episode_index = 2")).count() == 3
    assert X.first_episodes(df, 2).count() == 3 and X.first_episodes(df, 0) is df
    assert S.select_slice(df, "[1:2]").count() == 1 and S.select_slice(df, "[1:]").count() == 4 and S.select_slice(df, "[0:0]").count() == 0
    for bad in ("1", "1:2:3"):
        with pytest.raises(ValueError, match="slice"):
            S.parse_selector(bad)


def test_offsets_and_overlaps(spark):
    df = spark.createDataFrame([("a", 0, 5), ("b", 1, 5), ("c", 70_000, 2)], "episode_id string, episode_index bigint, num_steps int")
    assert {r.episode_id: (r.frame_start, r.frame_end) for r in X.frame_offsets(df).collect()} == {"a": (0, 5), "b": (5, 10), "c": (10, 12)}
    r = spark.createDataFrame([("a", "f", 0, 5), ("b", "f", 4, 6), ("c", "g", 3, 9)], "episode_id string, parquet_file string, parquet_row_start bigint, parquet_row_end bigint")
    assert ids(X.overlaps(r)) == ["b"] and ids(X.overlaps(r, across_files=True)) == ["b", "c"]


def test_splits(spark):
    import hashlib

    df = spark.range(2000).select(F.format_string("ep_%d", "id").alias("e"))
    rows = df.select("e", H.split_md5(F.col("e")).alias("m"), H.split_sha256(F.col("e")).alias("s"), H.derived_seed(7, F.col("e")).alias("d")).collect()
    for r in rows:
        for name, got in (("md5", r.m), ("sha256", r.s)):
            x = int(hashlib.new(name, f"42:{r.e}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
            assert got == ("train" if x < 0.8 else "val" if x < 0.8 + 0.1 else "test")
        assert r.d == H.derive_seed(7, r.e)
    again = df.repartition(7).select("e", H.split_md5(F.col("e")).alias("m")).collect()
    assert {(r.e, r.m) for r in again} == {(r.e, r.m) for r in rows}
    assert [r.e for r in H.choice(df, "e", 5).collect()] == [r.e for r in H.choice(df.repartition(5), "e", 5).collect()]
    assert all(2 <= r.x < 5 for r in df.select(H.integers(F.col("e"), 2, 5).alias("x")).collect())


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.dictionaries(st.text("ab_", min_size=1, max_size=3), st.integers(), min_size=1, max_size=3), lambda x: st.dictionaries(st.text("ab_", min_size=1, max_size=3), x, min_size=1, max_size=3), max_leaves=9))
def test_flatten_round_trip(tree):
    assert K.unflatten(K.flatten(tree)) == tree


def test_keys(spark):
    df = spark.createDataFrame([("observation.images.Front-Left x",), ("observation.depth.d",), ("observation.state",)], "k string")
    rows = df.select(K.camera(F.col("k")).alias("c"), K.is_image(F.col("k")).alias("i"), K.normalized(F.col("k")).alias("n")).collect()
    assert [r.c for r in rows] == ["Front-Left x", "d", None] and [r.i for r in rows] == [True, False, False] and rows[0].n == "observation.images.front_left_x"
    assert K.image_key("A b-c") == "observation.images.a_b_c" and K.depth_key("D") == "observation.depth.d" and K.normalize_key("A-b C") == "a_b_c"
    nested = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit(2).alias("d")).alias("c")).alias("a"))
    flat = K.flatten_columns(nested)
    assert flat.columns == ["a.b", "a.c.d"] and K.unflatten_columns(flat).first() == nested.first()
    assert S.probe_schema(nested.select(F.col("a").alias("observation")).schema, "x").observation == {"observation.b": FeatureSpec("int32"), "observation.c.d": FeatureSpec("int32")}


def test_versions():
    assert N.parse("1.2.3") == (1, 2, 3) and N.compare("1.2.0", "1.10.0") == -1 and N.compare("1.0.0", "1.0.0") == 0
    assert N.can_read("1.0.9", "1.0.0") and not N.can_read("1.1.0", "1.0.0") and not N.can_read("2.0.0", "1.9.0")
    with pytest.raises(ValueError):
        N.check("2.0.0")
    with pytest.raises(ValueError):
        N.parse("1.x")
    assert N.normalize_dtype("float32") == "float32"


def test_pack(spark):
    sizes = spark.createDataFrame(list(enumerate([4, 4, 4, 9, 1])), "episode_index bigint, num_steps int")
    rows = shards.pack(sizes, 10).orderBy("episode_index").collect()
    assert [r.shard for r in rows] == [0, 0, 1, 2, 2] and [r.start for r in rows] == [0, 4, 0, 0, 9]
    two = sizes.withColumn("camera", F.lit("a")).union(sizes.withColumn("camera", F.lit("b")))
    assert shards.pack(two, 10, group="camera").where("camera = 'b'").orderBy("episode_index").select("shard").toPandas()["shard"].tolist() == [r.shard for r in rows]
    flushed = shards.flush_shards(sizes, 8, 2).orderBy("episode_index").collect()
    assert [(r.shard, r.chunk) for r in flushed] == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2)]
    assert flushed[-1].file == "chunk-002/steps_00002.parquet"
    assert shards.pack(sizes.limit(0), 10).count() == 0


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, True, 1.0, 10), ("a", 1, False, 0.0, 20), ("b", 0, True, 3.0, 6)], "task string, episode_idx int, success boolean, total_reward double, num_steps int")
    rows = {r.task: tuple(r)[1:] for r in evaluate.metrics(df).collect()}
    assert rows["a"] == (2, 1, 0.5, 0.5, 15.0) and rows[None][:2] == (3, 2)
    assert evaluate.metrics(df.limit(0)).count() == 0
    evaluate.save(df.limit(0), str(tmp_path))
    assert '"n_episodes": 0' in (tmp_path / "summary.json").read_text()


def test_spec_and_catalog(tmp_path):
    c = TaskCatalog()
    assert [c.add(t) for t in ("a", "b", "a")] == [0, 1, 0] and c.text_of(1) == "b" and c.id_of("z") is None and len(c) == 2
    c.to_jsonl(tmp_path / "t.jsonl")
    assert TaskCatalog.from_jsonl(tmp_path / "t.jsonl") == c
    s = DatasetSpec("d", {"observation.images.a": FeatureSpec("uint8", (2, 2, 3), is_video=True), "observation.state": FeatureSpec("float32", (7,))}, FeatureSpec("float32", (7,)), cameras=["a"], tasks=c)
    assert DatasetSpec.from_json(s.to_json()) == s and s.has_video and s.n_cameras == 1 and list(s.image_features()) == ["observation.images.a"] and s.state_feature().shape == (7,)


def test_registry(spark):
    df = S.registry(spark)
    assert df.count() == 12
    best = {r.name: r.c for r in df.select("name", S.recommended_camera(F.col("cameras")).alias("c")).collect()}
    assert best["droid"] == "exterior_image_1_left" and best["taco_play"] == "rgb_static" and best["bridge"] == "image_0"
