"""Queries of what is written and read back, and of the smaller parts, each with SQL for the same rows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import actions as A
from stepweave.functions import hashing as H
from stepweave.functions import keys as K
from stepweave.functions import versions as N
from stepweave.functions.mixtures import Mixture, Part
from stepweave.functions.text import decoded
from stepweave.operators import evaluate, shards, stats
from stepweave.operators import index as X
from stepweave.operators import transforms as T
from stepweave.operators import validators as V
from stepweave.plans import compile as C
from stepweave.plans.queries import _EVENTS, _INDEX, _ORDERS, _VECTORS, _damaged, _with, query, r6
from stepweave.session import new_path
from stepweave.sources import adapters as S
from stepweave.sources import sinks
from stepweave.sources.schema import STEPS, DatasetSpec, FeatureSpec, TaskCatalog, conform
from stepweave.streaming.validate import RESULT, validate_stream

_SPEC = DatasetSpec("orders", {"observation.state": FeatureSpec("float32", (2,)), "observation.language": FeatureSpec("string")}, FeatureSpec("float32", (4,)), control_rate_hz=1 / 86_400)


# -- compiled data sets --


def _compiled(spark: SparkSession, d: str, **k) -> str:
    """Order steps, compiled: gaps of over two days are warned of, steps back in time are errors."""
    path = new_path(spark, "compiled")
    C.Compiler("orders", validators=["timestamps"], rows_per_shard=5000).compile(S.order_steps(spark, d), spark, path, spec=_SPEC, **k)
    return path


#: The verdicts of the compiler, and what it keeps.
_KEPT = """
, g AS (SELECT *, lag(ts) OVER (PARTITION BY episode_id ORDER BY step_index) AS b FROM steps),
bad AS (SELECT episode_id, bool_or(ts < b) AS error, bool_or(ts - b > (1.0 / (1.0 / 86400.0)) * 2.0) AS warn FROM g GROUP BY 1),
kept AS (SELECT s.*, coalesce(warn, false) AS invalid FROM steps s JOIN bad USING (episode_id) WHERE NOT coalesce(error, false))"""
_SHARDS = """
, sz AS (SELECT episode_id, episode_index, any_value(n) AS n, any_value(invalid) AS invalid, row_number() OVER (ORDER BY episode_index) AS k FROM kept GROUP BY 1, 2),
p AS (SELECT k, episode_id, episode_index, n, invalid, 0 AS shard, n AS used, CAST(0 AS BIGINT) AS row_start FROM sz WHERE k = 1
  UNION ALL SELECT sz.k, sz.episode_id, sz.episode_index, sz.n, sz.invalid, p.shard + CASE WHEN p.used >= 5000 THEN 1 ELSE 0 END, CASE WHEN p.used >= 5000 THEN sz.n ELSE p.used + sz.n END, CASE WHEN p.used >= 5000 THEN 0 ELSE p.used END FROM p JOIN sz ON sz.k = p.k + 1),
placed AS (SELECT *, (max(k) OVER (PARTITION BY shard) - 1) // 1000 AS chunk FROM p)"""


@query(_with(_ORDERS, _INDEX) + _KEPT + _SHARDS + """
, cat AS (SELECT task_text, CAST(row_number() OVER (ORDER BY min(i.episode_index), task_text) - 1 AS INTEGER) AS task_id FROM ix i JOIN sz USING (episode_id) GROUP BY 1)
SELECT episode_id, invalid, CAST(n AS INTEGER) AS num_steps, robot_id, task_id, task_text, printf('data/chunk=%d/shard=%d', chunk, shard) AS parquet_file, CAST(row_start AS BIGINT) AS parquet_row_start, CAST(row_start + n AS BIGINT) AS parquet_row_end, camera_set, start_timestamp, end_timestamp
FROM placed JOIN ix USING (episode_id) JOIN cat USING (task_text)""")
def compiled_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of a compiled data set: files and the rows in them."""
    index = X.read(spark, sinks.Layout(_compiled(spark, d)).index)
    return index.select("episode_id", "invalid", "num_steps", "robot_id", "task_id", "task_text", "parquet_file", "parquet_row_start", "parquet_row_end", "camera_set", "start_timestamp", "end_timestamp")


@query(_with(_ORDERS) + _KEPT + " SELECT episode_id, step_index, ts AS timestamp, round(CAST(action[1] AS FLOAT), 3) AS first, l_quantity AS state FROM kept WHERE NOT invalid")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    """What a loader reads of a compiled data set."""
    df = C.training_steps(spark, _compiled(spark, d))
    return df.select("episode_id", "step_index", "timestamp", F.round(F.get("action", F.lit(0)), 3).alias("first"), F.get("observation_state", F.lit(0)).cast("double").alias("state"))


@query(_with(_ORDERS) + _KEPT + _SHARDS + """
, fr AS (SELECT episode_id, sum(n) OVER (ORDER BY episode_index) - n AS f FROM sz)
SELECT k.episode_id, k.step_index, CAST(f + k.step_index AS BIGINT) AS frame_index, CAST(shard AS INTEGER) AS shard, CAST(chunk AS INTEGER) AS chunk, k.is_first, k.is_last FROM kept k JOIN placed USING (episode_id) JOIN fr ON fr.episode_id = k.episode_id""")
def stored_steps(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(sinks.Layout(_compiled(spark, d)).data)
    return df.select("episode_id", "step_index", "frame_index", F.col("shard").cast("int").alias("shard"), F.col("chunk").cast("int").alias("chunk"), "is_first", "is_last")


@query(_with(_ORDERS) + _KEPT + """
SELECT 'frames' AS name, CAST(count(*) AS DOUBLE) AS value FROM kept UNION ALL SELECT 'episodes', count(DISTINCT episode_id) FROM kept UNION ALL SELECT 'tasks', count(DISTINCT task_text) FROM kept
UNION ALL SELECT 'errors', count(*) FROM bad WHERE coalesce(error, false) UNION ALL SELECT 'invalid', count(*) FROM bad WHERE NOT coalesce(error, false) AND coalesce(warn, false) UNION ALL SELECT 'sealed', 1
UNION ALL SELECT 'catalog', count(DISTINCT task_text) FROM kept UNION ALL SELECT 'meta_steps', count(*) FROM kept
UNION ALL SELECT 'state_mean', round(avg(l_quantity), 4) FROM kept UNION ALL SELECT 'state_max', max(l_quantity) FROM kept UNION ALL SELECT 'width', 4""")
def compiled_metadata(spark: SparkSession, d: str) -> DataFrame:
    """info.json, tasks.jsonl, stats.json, the episodes' meta, the report and the manifest of a compiled data set, read back."""
    at = sinks.Layout(_compiled(spark, d))
    info, report = (json.loads(Path(p).read_text()) for p in (at.info, at.report))
    read = {r.feature + str(r.dim): r for r in stats.from_json(spark, Path(at.stats).read_text()).collect()}  # a row a feature and dimension
    state = read["observation.state0"]
    meta = spark.read.parquet(at.episodes).agg(F.sum("length")).first()[0]
    rows = {"frames": info["total_frames"], "episodes": info["total_episodes"], "tasks": info["total_tasks"], "errors": report["error_episodes"], "invalid": report["invalid_episodes"], "sealed": sinks.Manifest.load(str(at.root)).status == "sealed"}
    rows |= {"catalog": len(TaskCatalog.from_jsonl(at.tasks)), "meta_steps": meta, "state_mean": round(state["mean"], 4), "state_max": state["max"], "width": info["features"]["action"]["shape"][0]}
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "name string, value double")


@query(_with(_ORDERS) + _KEPT + " SELECT episode_id, step_index, CASE WHEN ts < b THEN 'ERROR' ELSE 'WARN' END AS severity FROM g WHERE ts < b OR ts - b > (1.0 / (1.0 / 86400.0)) * 2.0")
def stored_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings by the spec's own rate, as the compiler writes them."""
    return spark.read.parquet(sinks.Layout(_compiled(spark, d)).findings).select("episode_id", "step_index", "severity")


@query(_with(_ORDERS) + _KEPT + " SELECT k.episode_id, count(*) AS n, round(sum(ts), 2) AS total FROM kept k WHERE n >= 2 GROUP BY 1")
def slice_copy(spark: SparkSession, d: str) -> DataFrame:
    """A slice of a compiled data set, copied with its steps, and read."""
    whole, out = sinks.Layout(_compiled(spark, d)), new_path(spark, "slice")
    sinks.write_slice(X.read(spark, whole.index), X.Query(min_steps=2), out, spark.read.parquet(whole.data))
    return spark.read.parquet(sinks.Layout(out).data).groupBy("episode_id").agg(F.count("*").alias("n"), F.round(F.sum("timestamp"), 2).alias("total"))


# -- records --


@query(_with(_ORDERS) + """
, o AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS e FROM (SELECT DISTINCT episode_index FROM steps WHERE n >= 5))
SELECT printf('read_%06d', e) AS episode_id, step_index, step_index = 0 AS is_first, is_last, is_terminal, round(step_index * 0.1, 6) AS timestamp, round(CAST(reward AS FLOAT), 1) AS reward, CASE WHEN is_last THEN 0.0 ELSE 1.0 END AS discount,
  CASE WHEN action IS NULL THEN -1 ELSE len(action) END AS width, round(CAST(coalesce(action[2], 0) AS FLOAT), 1) AS second, l_quantity AS state, rf || ' ' || ls AS language
FROM steps JOIN o USING (episode_index)""")
def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Episodes written as record files of Examples, and read as a source."""
    path, whole = new_path(spark, "records"), S.order_steps(spark, d)
    long = whole.groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), F.count("*").alias("n")).where("n >= 5")
    # episodes are numbered by file and place: shards of 100 by the order of ids need dense numbers
    dense = X.frame_offsets(long.withColumn("num_steps", F.lit(1))).select("episode_id", F.col("frame_start").alias("e"))
    steps = whole.withColumn("observation", F.map_filter("observation", lambda k, _: ~K.is_image(k)))
    steps = steps.join(dense, "episode_id").withColumn("episode_index", F.col("e")).drop("e")
    sinks.write_nested(steps, _SPEC, path, 100, "tfrecord")
    back = S.record_steps(spark, path, "read", _SPEC)
    state, language = F.col("observation")["observation.state"]["num"][0], F.col("observation")["observation.language"]["str"]
    return back.select(
        "episode_id", "step_index", "is_first", "is_last", "is_terminal", r6("timestamp"), F.round(F.col("reward").cast("float"), 1).alias("reward"), "discount", F.coalesce(F.size("action"), F.lit(-1)).alias("width"),
        F.round(F.coalesce(F.get("action", F.lit(1)), F.lit(0)).cast("float"), 1).alias("second"), state.alias("state"), language.alias("language"))


@query(_with(_ORDERS) + " SELECT episode_id, episode_index, step_index, dataset_id, is_last, reward, discount FROM (SELECT *, 'folder' AS dataset_id, CAST(0 AS DOUBLE) AS discount FROM steps)")
def directory_source(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files in Spark's own formats, with columns that it lacks filled in."""
    path = new_path(spark, "folder")
    S.order_steps(spark, d).drop("observation", "discount", "dataset_id").write.option("compression", "gzip").json(path)
    return S.directory(spark, path, "json", "folder").select("episode_id", "episode_index", "step_index", "dataset_id", "is_last", "reward", "discount")


@query(_with(_ORDERS) + " SELECT episode_id, count(*) AS n FROM steps WHERE episode_index >= 10 AND episode_index < 5000 GROUP BY 1")
def adapter_contract(spark: SparkSession, d: str) -> DataFrame:
    with S.Adapter("orders", lambda s: S.order_steps(s, d)) as a:
        return a.steps(spark, "[10:5000]").groupBy("episode_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS episode_index, CAST(count(*) AS INTEGER) AS n, CASE WHEN l_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS dataset_id, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 1 END AS more FROM lineitem WHERE l_orderkey % 3 < 2 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def merged_sets(spark: SparkSession, d: str) -> DataFrame:
    steps = S.order_steps(spark, d)
    a, b = (steps.where(F.col("episode_index") % 3 == k).withColumn("dataset_id", F.lit(n)) for k, n in enumerate("ab"))
    return sinks.merge(a, b.withColumn("more", F.lit(1))).groupBy("episode_index", "dataset_id", "more").agg(F.count("*").cast("int").alias("n"))


# -- rules and rates --


@query(_with(_ORDERS) + """
, o AS (SELECT episode_id, step_index, n, ts, is_last, is_terminal, task_text, reward, rf, ls, l_tax, l_quantity, action,
    (CASE WHEN is_last THEN is_first AND l_quantity <= 49 OR l_quantity = 7 AND is_first ELSE l_quantity = 7 OR is_first AND l_quantity <= 49 END) AS first, l_tax < 0.01 AND NOT is_last AS terminal, lag(ts) OVER (PARTITION BY episode_id ORDER BY step_index) AS b FROM steps),
a AS (SELECT *, CASE WHEN is_last AND l_tax > 0.04 THEN true ELSE action IS NOT NULL END AS acts, CASE WHEN is_last AND l_tax > 0.04 THEN greatest(l_quantity, l_tax) WHEN action IS NOT NULL THEN list_max(action) END AS most FROM o),
e AS (SELECT episode_id, any_value(n) AS n, count(*) FILTER (first) AS firsts, count(*) FILTER (first AND step_index = 0) AS right_first, min(step_index) FILTER (is_last AND acts) AS w2, min(step_index) FILTER (is_last AND NOT terminal) AS w6, min(step_index) FILTER (is_last) AS w3,
    min(step_index) FILTER (acts AND most > 40) AS w105, min(step_index) FILTER (ts < b) AS w201, min(step_index) FILTER (ts - b > 2.0 / (1.0 / 86400.0)) AS w202, max(ts - b) AS mx, min(ts - b) AS mn, avg(ts - b) AS av, count(DISTINCT CASE rf WHEN 'N' THEN 0 WHEN 'R' THEN 2 ELSE 1 END) AS keys FROM a GROUP BY 1)
SELECT 'E001' AS code, episode_id, CAST(NULL AS INTEGER) AS step_index FROM e WHERE firsts <> 1 OR right_first <> 1 UNION ALL SELECT 'E004', episode_id, NULL FROM e WHERE keys > 1 UNION ALL SELECT 'W004', episode_id, NULL FROM e WHERE n < 3 UNION ALL SELECT 'W005', episode_id, NULL FROM e WHERE n > 6
UNION ALL SELECT 'W002', episode_id, w2 FROM e WHERE w2 IS NOT NULL UNION ALL SELECT 'W003', episode_id, w3 FROM e WHERE w3 IS NOT NULL UNION ALL SELECT 'W006', episode_id, w6 FROM e WHERE w6 IS NOT NULL UNION ALL SELECT 'W105', episode_id, w105 FROM e WHERE w105 IS NOT NULL
UNION ALL SELECT 'W201', episode_id, w201 FROM e WHERE w201 IS NOT NULL UNION ALL SELECT 'W202', episode_id, w202 FROM e WHERE w202 IS NOT NULL UNION ALL SELECT 'I202', episode_id, NULL FROM e WHERE mx - av > 0.1 * av OR av - mn > 0.1 * av""")
def documented_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule pack over the damaged orders; rules about fields and images are in field_rules."""
    found = V.coded(_damaged(spark, d), DatasetSpec("orders", control_rate_hz=1 / 86_400, action_space_type="joint_abs"), min_length=3, max_length=6, bounds=(-40.0, 40.0), sigma=1e9)
    return found.where("field is null and episode_id is not null").select("code", "episode_id", "step_index")


@query(_with(_ORDERS) + """
, f AS (SELECT episode_id, any_value(n) AS n, count(*) FILTER (rf <> 'N') AS fronts, count(*) FILTER (rf = 'R') AS wrists, count(DISTINCT ls) FILTER (rf <> 'N') AS sizes, min(step_index) FILTER (rf <> 'N' AND ls = 'O') AS other FROM steps GROUP BY 1)
SELECT 'W401' AS code, episode_id, CAST(NULL AS INTEGER) AS step_index, 'observation.images.front' AS field FROM f WHERE fronts > 0 AND fronts < n UNION ALL SELECT 'W401', episode_id, NULL, 'observation.images.wrist' FROM f WHERE wrists > 0 AND wrists < n
UNION ALL SELECT 'E006', episode_id, NULL, 'observation.images.front' FROM f WHERE sizes > 1 UNION ALL SELECT 'I302', episode_id, other, 'observation.images.front' FROM f WHERE other IS NOT NULL
UNION ALL SELECT 'W402', episode_id, NULL, 'observation.images.front' FROM f WHERE fronts = 0 UNION ALL SELECT 'W402', episode_id, NULL, 'observation.images.wrist' FROM f WHERE wrists = 0
UNION ALL SELECT 'I401', episode_id, NULL, NULL FROM f WHERE fronts > 0 AND wrists = 0""")
def field_rules(spark: SparkSession, d: str) -> DataFrame:
    spec = DatasetSpec("orders", {"observation.images.front": FeatureSpec("uint8", (64, 64, 3)), "observation.images.wrist": FeatureSpec("uint8", (64, 64, 3))}, cameras=["front", "wrist"])
    found = V.coded(S.order_steps(spark, d), spec)
    return found.where("code in ('W401', 'E006', 'I302', 'W402', 'I401')").select("code", "episode_id", "step_index", "field")


@query(_with(_ORDERS) + """
, r AS (SELECT episode_id, step_index, ts AS t FROM steps WHERE step_index = 0 UNION ALL SELECT s.episode_id, s.step_index, CASE WHEN s.ts > r.t THEN s.ts ELSE r.t + 86400.0 END FROM r JOIN steps s ON s.episode_id = r.episode_id AND s.step_index = r.step_index + 1)
SELECT episode_id, step_index, round(t, 2) AS timestamp FROM r""")
def repair_at_the_specs_rate(spark: SparkSession, d: str) -> DataFrame:
    c = C.Compiler("orders").add_transform("timestamp_canonicalize")
    return c.transformed(S.order_steps(spark, d), _SPEC).select("episode_id", "step_index", F.round("timestamp", 2).alias("timestamp"))


@query("""
WITH v(dim, action_space_type) AS (SELECT CAST(p_size AS INTEGER), CASE p_size % 4 WHEN 0 THEN 'ee_delta_7' WHEN 1 THEN 'ee_abs_7' WHEN 2 THEN 'joint_abs' ELSE 'custom' END FROM part)
SELECT dim, action_space_type, count(*) AS n FROM v WHERE action_space_type LIKE 'ee%' AND dim <> 7 GROUP BY ALL""")
def action_metadata_rules(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("ee_delta_7", "ee_abs_7", "joint_abs", "custom"))), F.col("p_size") % 4 + 1)
    specs = spark.read.parquet(f"{d}/part.parquet").select(F.concat_ws(":", "p_size", kind).alias("dataset_id"), kind.alias("action_space_type"), F.col("p_size").alias("dim"))
    parts = F.split("dataset_id", ":")
    return V.action_metadata(specs).groupBy(parts[0].cast("int").alias("dim"), parts[1].alias("action_space_type")).agg(F.count("*").alias("n"))


@query(_with(_ORDERS) + ", l AS (SELECT episode_id, any_value(n) AS n FROM steps GROUP BY 1) SELECT 'INFO' AS severity, 'episode_length' AS code, count(*) AS n FROM l WHERE n < 3 OR n > 7 HAVING count(*) > 0")
def overridden_severities(spark: SparkSession, d: str) -> DataFrame:
    found = V.override(V.length(S.order_steps(spark, d), 3, 7), {"episode_length": "INFO"})
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


# -- index and configuration --


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, num_steps FROM ix WHERE episode_id IN ('orders_000001', 'orders_000007') OR (robot_id = '1-URGENT' AND task_text LIKE '%from%') OR num_steps IN (1, 7)")
def where_sql_with_words(spark: SparkSession, d: str) -> DataFrame:
    """A predicate whose texts hold words of queries."""
    index = X.build(S.order_steps(spark, d), row_ranges=False)
    return X.where_sql(index, "episode_id IN ('orders_000001', 'orders_000007') OR (robot_id = '1-URGENT' AND task_text LIKE '%from%') OR num_steps IN (1, 7)", columns=["episode_id", "num_steps", "robot_id", "task_text"]).select("episode_id", "num_steps")


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, 'unknown' AS robot_id, 'train' AS split, 'custom' AS action_space_type, false AS invalid, num_steps FROM ix")
def index_defaults(spark: SparkSession, d: str) -> DataFrame:
    """An index whose files lack columns."""
    path = new_path(spark, "index")
    X.build(S.order_steps(spark, d), row_ranges=False).select("episode_id", "num_steps").write.parquet(path)
    return X.read(spark, path).select("episode_id", "robot_id", "split", "action_space_type", "invalid", "num_steps")


@query(_with(_ORDERS) + " SELECT s.episode_id, count(*) AS n FROM steps s JOIN (SELECT episode_id FROM (SELECT DISTINCT episode_id, episode_index FROM steps) ORDER BY episode_index LIMIT 50) USING (episode_id) GROUP BY 1")
def first_episodes(spark: SparkSession, d: str) -> DataFrame:
    return X.first_episodes(S.order_steps(spark, d), 50).groupBy("episode_id").agg(F.count("*").alias("n"))


@query(_with(_ORDERS) + ", w AS (SELECT episode_id, episode_index, any_value(n) AS n FROM steps GROUP BY 1, 2) SELECT episode_id, CAST(sum(n) OVER (ORDER BY episode_index) - n AS BIGINT) AS parquet_row_start, CAST(sum(n) OVER (ORDER BY episode_index) AS BIGINT) AS parquet_row_end FROM w")
def index_row_ranges(spark: SparkSession, d: str) -> DataFrame:
    return X.build(S.order_steps(spark, d)).select("episode_id", "parquet_row_start", "parquet_row_end")


@query(_with(_ORDERS) + " SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST(x AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM (SELECT episode_id, step_index, unnest(list_resize(action, 6, 0.0)) AS x, unnest(range(1, 7)) AS d FROM steps WHERE action IS NOT NULL)")
def configured_chain(spark: SparkSession, d: str) -> DataFrame:
    """Transforms by name and parameters, as a pipeline file has them."""
    chain = C.from_config({"transforms": ["identity", {"name": "pad_action", "params": {"target_dim": 6}}]})
    df = T.chain(*[t for _, t in chain])(S.order_steps(spark, d))
    return df.where("action is not null").select("episode_id", "step_index", F.posexplode("action").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("float"), 4) + F.lit(0.0).cast("float"))


# -- small functions --


@query("SELECT p_partkey, lower(replace(replace(p_type, ' ', '_'), '-', '_')) AS key, CASE WHEN p_size % 3 < 2 THEN lower(replace(p_brand, '#', '_')) END AS camera FROM part")
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.translate("p_brand", "#", "_"))
    key = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(K.IMAGES), name)).when(F.col("p_size") % 3 == 1, F.concat(F.lit(K.DEPTH), name)).otherwise(F.concat(F.lit("observation."), name))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", K.normalized(F.col("p_type")).alias("key"), K.camera(key).alias("camera"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def nested_names(spark: SparkSession, d: str) -> DataFrame:
    """Columns to structs by dotted names, and flat again."""
    flat = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("a.key"), F.col("o_custkey").alias("a.b.cust"), F.col("o_orderstatus").alias("s"))
    back = K.flatten_columns(K.unflatten_columns(flat))
    return back.select(F.col("`a.key`").alias("o_orderkey"), F.col("`a.b.cust`").alias("o_custkey"), F.col("s").alias("o_orderstatus"))


def _flat(df: DataFrame, c: Column) -> DataFrame:
    return df.where("action is not null").select("episode_id", "step_index", F.posexplode(c).alias("dim", "x")).withColumn("x", F.round(F.col("x"), 4) + F.lit(0.0))


@query(_with(_VECTORS) + ", x AS (SELECT episode_id, step_index, unnest(list_transform(list_resize(action, 66, 0.0), lambda v: greatest(-0.1, least(0.1, v)))) AS x, unnest(range(0, 66)) AS d FROM vs WHERE action IS NOT NULL) SELECT episode_id, step_index, CAST(d AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM x")
def env_actions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.embedding_steps(spark, d), A.to_env(F.col("action"), 66, -0.1, 0.1))


@query(_with(_VECTORS) + """
, x AS (SELECT episode_id, step_index, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM vs WHERE action IS NOT NULL)
SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM x""")
def standardize_and_back(spark: SparkSession, d: str) -> DataFrame:
    steps = S.embedding_steps(spark, d)
    table = stats.feature_stats(steps)
    there = steps.transform(T.normalize_features(table)).transform(T.normalize_features(table, undo=True))
    return _flat(there, F.col("action"))


@query(_with(_EVENTS) + " SELECT episode_id, CAST(any_value(n) - 1 AS INTEGER) AS n_actions, CAST(any_value(n) AS INTEGER) AS n_states, round(sum(CASE WHEN NOT is_last THEN value ELSE 0 END), 3) AS total FROM ev GROUP BY 1")
def episode_series(spark: SparkSession, d: str) -> DataFrame:
    df = T.episode_series(S.event_steps(spark, d))
    return df.select("episode_id", F.size("actions").alias("n_actions"), F.size("states").alias("n_states"), F.round(F.aggregate("actions", F.lit(0.0), lambda a, x: a + x[0]), 3).alias("total"))


@query(_with(_EVENTS) + " SELECT episode_id, step_index, value AS state, false AS has_image FROM ev")
def policy_inputs(spark: SparkSession, d: str) -> DataFrame:
    df = S.event_steps(spark, d).transform(T.to_policy())
    return df.select("episode_id", "step_index", F.col("state")[0].alias("state"), F.col("image").isNotNull().alias("has_image"))


@query("SELECT a, b, CAST(CASE WHEN (a // 100) <> (b // 100) THEN sign((a // 100) - (b // 100)) ELSE sign(a - b) END AS INTEGER) AS compared, (a // 100) = (b // 100) AND (a // 10) % 10 <= (b // 10) % 10 AS readable FROM (SELECT DISTINCT 100 + n_nationkey * 7 AS a FROM nation) x, (SELECT DISTINCT 100 + n_nationkey * 9 AS b FROM nation) y")
def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of three digits against each other: a handful, on the driver."""
    keys = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]  # 25 rows
    dots = lambda v: f"{v // 100}.{v // 10 % 10}.{v % 10}"
    rows = [(a, b, N.compare(dots(a), dots(b)), N.can_read(dots(a), dots(b))) for a in {100 + k * 7 for k in keys} for b in {100 + k * 9 for k in keys}]
    return spark.createDataFrame(rows, "a long, b long, compared int, readable boolean")


@query("WITH s AS (SELECT o_orderkey, CAST(('0x' || substr(sha256('42:' || o_orderkey), 1, 8)) AS BIGINT) AS s FROM orders) SELECT o_orderkey, round(2.0 + s / 4294967295.0 * 3.0, 6) AS u, CAST(10 + s % 5 AS BIGINT) AS i FROM s")
def seeded_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.round(H.uniform(F.col("o_orderkey"), 42, 2.0, 5.0), 6).alias("u"), H.integers(F.col("o_orderkey"), 10, 15).cast("long").alias("i"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 25")
def seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    return H.choice(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", 25)


@query("SELECT task, count(*) AS n, round(avg(total_reward), 4) AS mean_reward FROM (SELECT o_orderpriority AS task, o_totalprice AS total_reward FROM orders) GROUP BY 1")
def evaluation_files(spark: SparkSession, d: str) -> DataFrame:
    """Results of an evaluation, saved as files and read."""
    path, o = new_path(spark, "evaluation"), spark.read.parquet(f"{d}/orders.parquet")
    Path(path).mkdir(parents=True)
    evaluate.save(o.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").cast("int").alias("episode_idx"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("total_reward"), F.lit(1).alias("num_steps")), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/results")
    return back.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("total_reward"), 4).alias("mean_reward"))


@query(_with(_EVENTS) + ", l AS (SELECT *, lag(ts) OVER (PARTITION BY episode_id ORDER BY step_index) AS b FROM ev) SELECT episode_id, count(*) AS num_steps, count(*) FILTER (is_first) AS n_first, count(*) FILTER (is_last) AS n_last, count(*) FILTER (ts < b) AS goes_back, CAST(0 AS BIGINT) AS out_of_place, true AS complete, CAST(0 AS BIGINT) AS late FROM l GROUP BY 1")
def streamed_validation(spark: SparkSession, d: str) -> DataFrame:
    """Events' steps as a stream of files, validated as they arrive."""
    source, out = new_path(spark, "stream"), new_path(spark, "validated")
    steps = S.event_steps(spark, d).select("episode_id", "step_index", "is_first", "is_last", "timestamp")
    steps.repartition(4, "episode_id").write.parquet(source)
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(source)
    found = validate_stream(stream)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("append").parquet(out)

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RESULT).parquet(out)


@query(_with(_ORDERS) + " SELECT episode_id, step_index, 'none' AS dataset_id, CAST(0 AS DOUBLE) AS discount FROM steps")
def conformed_steps(spark: SparkSession, d: str) -> DataFrame:
    df = S.order_steps(spark, d).select("episode_id", "step_index")
    return conform(df, STEPS, {"dataset_id": "none"}).select("episode_id", "step_index", "dataset_id", "discount")


# -- files of smaller things --


@query(_with(_ORDERS, _INDEX) + """
, x AS (SELECT *, CAST(('0x' || substr(sha256('7:' || robot_id || ':' || episode_id), 1, 8)) AS BIGINT) / 4294967295.0 AS s FROM ix)
SELECT robot_id, count(*) AS n FROM x WHERE (robot_id = '1-URGENT' AND num_steps >= 3 AND s < 0.5) OR (robot_id = '5-LOW' AND s < 1.0) GROUP BY 1""")
def mixture_from_a_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mixture.yaml").removeprefix("file:")
    Mixture("m", [Part("1-URGENT", 1.0, {"min_steps": 3}), Part("5-LOW", 2.0)], 7).to_yaml(path)
    index = X.build(S.order_steps(spark, d), row_ranges=False)
    return Mixture.from_yaml(path).sample(index, "robot_id").groupBy("robot_id").agg(F.count("*").alias("n"))


@query(_with(_EVENTS) + " SELECT episode_id, step_index, is_first, round(ts, 4) AS timestamp, value AS state FROM ev")
def steps_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Steps to texts of JSON and back."""
    steps = conform(S.event_steps(spark, d), STEPS)
    back = steps.select(F.to_json(F.struct(*steps.columns)).alias("j")).select(F.from_json("j", steps.schema).alias("s")).select("s.*")
    return back.select("episode_id", "step_index", "is_first", F.round("timestamp", 4).alias("timestamp"), F.col("observation")["observation.state"]["num"][0].alias("state"))


@query("SELECT printf('%s/%d', o_orderpriority, o_orderkey) AS episode, round(CAST(('0x' || substr(sha256('42:' || o_orderpriority || '/' || o_orderkey || ':noise'), 1, 8)) AS BIGINT) / 4294967295.0, 6) AS noise FROM orders")
def episode_noise(spark: SparkSession, d: str) -> DataFrame:
    """A number for each episode and purpose, whatever the partitioning."""
    episode = F.concat_ws("/", "o_orderpriority", "o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(episode.alias("episode"), F.round(H.uniform(F.concat(episode, F.lit(":noise"))), 6).alias("noise"))


@query("SELECT doc_id, text FROM documents")
def decoded_bytes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", decoded(F.encode("text", "UTF-8")).alias("text"))


@query(_with(_ORDERS) + " SELECT episode_id, CASE WHEN n < 3 THEN 'ERROR' ELSE 'WARN' END AS severity, CASE WHEN n < 3 THEN 'too short' ELSE 'very long' END AS message FROM (SELECT DISTINCT episode_id, n FROM steps) WHERE n < 3 OR n > 7")
def findings_as_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "findings")
    sinks.write_findings_csv(V.length(S.order_steps(spark, d), 3, 7), path)
    return spark.read.option("header", True).csv(f"{path}/findings.csv").select("episode_id", "severity", "message")


@query("SELECT 'meta/' || r_regionkey || '.txt' AS file, sha256(r_name) AS sha FROM region UNION ALL SELECT 'data/x/' || r_regionkey || '.bin', sha256(r_name || r_name) FROM region")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    path = Path(new_path(spark, "sums").removeprefix("file:"))
    for r in spark.read.parquet(f"{d}/region.parquet").collect():  # five rows
        for name, text in ((f"meta/{r.r_regionkey}.txt", r.r_name), (f"data/x/{r.r_regionkey}.bin", r.r_name * 2), ("meta/.hidden", ""), ("other.txt", "")):
            (path / name).parent.mkdir(parents=True, exist_ok=True)
            (path / name).write_text(text)
    return sinks.checksums(spark, str(path))


@query("""
WITH RECURSIVE z AS (SELECT event_type AS camera, user_id AS e, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM events GROUP BY 1, 2),
p AS (SELECT camera, e, n, k, 0 AS shard, n AS used FROM z WHERE k = 1 UNION ALL SELECT z.camera, z.e, z.n, z.k, p.shard + CASE WHEN p.used + z.n > 40 THEN 1 ELSE 0 END, CASE WHEN p.used + z.n > 40 THEN z.n ELSE p.used + z.n END FROM p JOIN z ON z.camera = p.camera AND z.k = p.k + 1)
SELECT camera, CAST(shard AS INTEGER) AS shard, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(n) * 12 AS BIGINT) AS bytes FROM p GROUP BY ALL""")
def encoded_videos(spark: SparkSession, d: str) -> DataFrame:
    """Frames through an encoder that only keeps them: an event is a frame, its type the camera, a user the episode."""
    path = new_path(spark, "videos").removeprefix("file:")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("camera"), F.col("user_id").alias("episode_index"), F.col("event_id").cast("int").alias("step_index"))
    frames = e.withColumns({"height": F.lit(2), "width": F.lit(2), "data": F.repeat(F.lit("x"), 12).cast("binary")})
    placed = shards.pack(frames.groupBy("camera", "episode_index").agg(F.count("*").alias("num_steps")), 40, group="camera")
    done = sinks.encode_videos(frames, placed, path, ["sh", "-c", "cat > {out}"])
    sizes = {(r.camera, r.shard): (r.frames, Path(r.file).stat().st_size) for r in done.collect()}  # a row a file
    return spark.createDataFrame([(c, s, n, b) for (c, s), (n, b) in sizes.items()], "camera string, shard int, frames long, bytes long")


@query(_with(_ORDERS) + " SELECT episode_id, step_index, [2, 3, 3] AS shape, CAST(l_quantity AS INTEGER) + 32 AS low, CAST(l_quantity AS INTEGER) + 32 AS high, [4, 4, 3] AS was FROM steps WHERE rf = 'R'")
def resized_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of one shade each, made smaller by interpolation."""
    shade = F.char((F.col("observation")["observation.state"]["num"][0] + 32).cast("int"))
    one = F.map_from_arrays(F.array(F.lit("observation.images.front")), F.array(S.image(F.repeat(shade, 48), F.array(F.lit(4), F.lit(4), F.lit(3)))))
    steps = S.order_steps(spark, d).where(F.map_contains_key("observation", "observation.images.wrist")).withColumn("observation", one)
    v = F.col("observation")["observation.images.front"]
    places = F.transform(F.sequence(F.lit(1), F.length(v["bin"])), lambda i: F.ascii(F.substring(v["bin"].cast("string"), i, F.lit(1))))
    out = steps.transform(T.standardize_images((2, 3), interpolation="bilinear", record_shapes=True))
    return out.select("episode_id", "step_index", v["shape"].alias("shape"), F.array_min(places).alias("low"), F.array_max(places).alias("high"), F.col("image_shapes")["observation.images.front"].alias("was"))


@query(_with(_ORDERS) + " SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST(x AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM (SELECT episode_id, step_index, unnest(list_resize(action, 5, 1.5)) AS x, unnest(range(1, 6)) AS d FROM steps WHERE action IS NOT NULL)")
def configured_for_a_data_set(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline file in which a data set has values of its own."""
    path = new_path(spark, "pipeline.yaml").removeprefix("file:")
    Path(path).write_text("transforms: [{name: pad_action, params: {target_dim: 9}}]\ndatasets:\n  orders:\n    transforms: [{name: pad_action, params: {target_dim: 5, pad_value: 1.5}}]\n")
    df = T.chain(*[t for _, t in C.from_config(C.load_config(path, "orders"))])(S.order_steps(spark, d))
    return df.where("action is not null").select("episode_id", "step_index", F.posexplode("action").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("float"), 4) + F.lit(0.0).cast("float"))
