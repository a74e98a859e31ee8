"""Queries of the trajectory operators over the whole driver tables, each with SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import hashing as H
from stepweave.functions.text import collapsed, normalize_text
from stepweave.operators import evaluate, shards, stats
from stepweave.operators import index as X
from stepweave.operators import transforms as T
from stepweave.operators import validators as V
from stepweave.plans import compile as C
from stepweave.sources import adapters as S
from stepweave.sources import sinks
from stepweave.sources.schema import DatasetSpec, FeatureSpec
from stepweave.streaming.validate import sessions, window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Steps of both sources in SQL.
_ORDERS = """
s0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), steps AS (
  SELECT printf('orders_%06d', l_orderkey) AS episode_id, l_orderkey AS episode_index, CAST(i AS INTEGER) AS step_index, i = 0 AS is_first, i = n - 1 AS is_last, i = n - 1 AND o_orderstatus = 'F' AS is_terminal,
    epoch_us(l_shipdate) / 1000000.0 AS ts, CASE WHEN i < n - 1 THEN [l_quantity, l_extendedprice, l_discount, l_tax] END AS action, l_extendedprice * (1 - l_discount) AS reward, n,
    o_orderpriority AS robot_id, o_orderstatus || ' ' || o_orderpriority AS task_text, l_returnflag AS rf, l_linestatus AS ls, l_quantity, l_tax,
    CASE WHEN l_returnflag = 'R' THEN ['front', 'wrist'] WHEN l_returnflag = 'N' THEN [] ELSE ['front'] END AS cameras
  FROM s0
)"""
_EVENTS = """
e0 AS (SELECT *, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
ev AS (SELECT printf('events_%06d', user_id) AS episode_id, user_id AS episode_index, CAST(i AS INTEGER) AS step_index, i = 0 AS is_first, i = n - 1 AS is_last, t - min(t) OVER (PARTITION BY user_id) AS ts, value, event_type, n FROM e0)"""
_VECTORS = """
v0 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
vs AS (SELECT printf('embeddings_%06d', label) AS episode_id, CAST(i AS INTEGER) AS step_index, CASE WHEN i < n - 1 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS action, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS state FROM v0)"""
_INDEX = """
ix AS (
  SELECT episode_id, any_value(episode_index) AS episode_index, arg_min(robot_id, step_index) AS robot_id, arg_min(task_text, step_index) AS task_text, CAST(count(*) AS INTEGER) AS num_steps,
    arg_min(ts, step_index) AS start_timestamp, arg_max(ts, step_index) AS end_timestamp, arg_max(ts, step_index) - arg_min(ts, step_index) AS duration_secs,
    array_to_string(list_sort(list_distinct(flatten(list(cameras)))), ',') AS camera_set
  FROM steps GROUP BY episode_id
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


def order_index(spark: SparkSession, d: str) -> DataFrame:
    return X.build(S.order_steps(spark, d), row_ranges=False)


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


# -- index and queries over it --


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, robot_id, task_text, num_steps, duration_secs, start_timestamp, end_timestamp, camera_set FROM ix")
def episode_index(spark: SparkSession, d: str) -> DataFrame:
    return order_index(spark, d).select("episode_id", "robot_id", "task_text", "num_steps", "duration_secs", "start_timestamp", "end_timestamp", "camera_set")


@query(_with(_ORDERS) + """
, w AS (SELECT episode_index, episode_id, count(*) AS n FROM steps GROUP BY ALL), o AS (SELECT *, sum(n) OVER (ORDER BY episode_index) AS e FROM w)
SELECT episode_id, CAST(e - n AS BIGINT) AS frame_start, CAST(e AS BIGINT) AS frame_end FROM o""")
def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = S.order_steps(spark, d).groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), F.count("*").alias("num_steps"))
    return X.frame_offsets(sizes)


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id FROM ix WHERE robot_id IN ('1-URGENT', '2-HIGH') AND regexp_matches(task_text, 'f [12]-', 'i') AND num_steps BETWEEN 3 AND 8 AND contains(camera_set, 'front')")
def index_filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return X.query_ids(order_index(spark, d), X.Query(robot_id=["1-URGENT", "2-HIGH"], task_text_regex="f [12]-", min_steps=3, max_steps=8, camera_set="front"))


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, camera_set FROM ix WHERE contains(camera_set, 'nt,wr')")
def camera_substring(spark: SparkSession, d: str) -> DataFrame:
    return X.query(order_index(spark, d), X.Query(camera_set="nt,wr")).select("episode_id", "camera_set")


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, camera_set FROM ix WHERE list_contains(string_split(camera_set, ','), 'wrist')")
def camera_exact(spark: SparkSession, d: str) -> DataFrame:
    return X.query(order_index(spark, d), X.Query(cameras=["wrist"])).select("episode_id", "camera_set")


@query(_with(_ORDERS, _INDEX) + " SELECT episode_id, num_steps FROM ix WHERE num_steps >= 4 AND task_text LIKE 'O%' AND robot_id IN ('5-LOW') ORDER BY episode_id LIMIT 20")
def index_where_sql(spark: SparkSession, d: str) -> DataFrame:
    return X.where_sql(order_index(spark, d), "num_steps >= 4 AND task_text LIKE 'O%' AND robot_id IN ('5-LOW')", limit=20).select("episode_id", "num_steps")


@query(_with(_ORDERS, _INDEX) + " SELECT count(*) AS n FROM ix WHERE num_steps <= 2")
def index_count(spark: SparkSession, d: str) -> DataFrame:
    return X.query(order_index(spark, d), X.Query(max_steps=2)).agg(F.count("*").alias("n"))


@query(_with(_ORDERS, _INDEX) + " SELECT s.episode_id, s.step_index, s.reward FROM steps s WHERE EXISTS (SELECT 1 FROM ix WHERE ix.episode_id = s.episode_id AND num_steps >= 6)")
def slice_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = S.order_steps(spark, d)
    return X.slice_steps(steps, X.query(X.build(steps, row_ranges=False), X.Query(min_steps=6))).select("episode_id", "step_index", "reward")


@query(_with(_ORDERS) + " SELECT episode_id, step_index FROM steps WHERE episode_index >= 100 AND episode_index < 200")
def selector_slice(spark: SparkSession, d: str) -> DataFrame:
    return S.select_slice(S.order_steps(spark, d), "[100:200]").select("episode_id", "step_index")


@query("""
WITH r AS (SELECT 'e' || o_orderkey AS episode_id, o_orderpriority AS parquet_file, o_orderkey AS parquet_row_start, o_orderkey + o_custkey % 7 AS parquet_row_end FROM orders),
l AS (SELECT *, lag(parquet_row_end) OVER (PARTITION BY parquet_file ORDER BY parquet_row_start, parquet_row_end, episode_id) AS previous_end FROM r)
SELECT episode_id, parquet_file, parquet_row_start, previous_end FROM l WHERE parquet_row_start < previous_end""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("e"), "o_orderkey").alias("episode_id"), F.col("o_orderpriority").alias("parquet_file"), F.col("o_orderkey").alias("parquet_row_start"), (F.col("o_orderkey") + F.col("o_custkey") % 7).alias("parquet_row_end"))
    return X.overlaps(ranges)


# -- splits and seeds --


def _split_sql(digest: str) -> str:
    share = f"(CAST(('0x' || substr({digest}('42:' || episode_id), 1, 8)) AS BIGINT) / 4294967295.0)"
    return _with(_ORDERS) + f", ids AS (SELECT DISTINCT episode_id FROM steps) SELECT episode_id, CASE WHEN {share} < 0.8 THEN 'train' WHEN {share} < 0.9 THEN 'val' ELSE 'test' END AS split FROM ids"


def _order_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.order_steps(spark, d).select("episode_id").distinct()


@query(_split_sql("md5"))
def split_md5(spark: SparkSession, d: str) -> DataFrame:
    return _order_ids(spark, d).select("episode_id", H.split_md5(F.col("episode_id")).alias("split"))


@query(_split_sql("sha256"))
def split_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _order_ids(spark, d).select("episode_id", H.split_sha256(F.col("episode_id")).alias("split"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('7:' || o_orderkey), 1, 8)) AS BIGINT) AS seed FROM orders")
def derived_seeds(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", H.derived_seed(7, F.col("o_orderkey")).alias("seed"))


@query("""
WITH x AS (SELECT o_orderkey, o_orderpriority, CAST(('0x' || substr(sha256('42:' || o_orderpriority || ':' || o_orderkey), 1, 8)) AS BIGINT) / 4294967295.0 AS s FROM orders)
SELECT o_orderpriority, count(*) AS n FROM x WHERE s < CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.5 WHEN '5-LOW' THEN 0.25 ELSE 0 END GROUP BY 1""")
def mixture_sample(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return H.mixture(orders, {"1-URGENT": 2.0, "2-HIGH": 1.0, "5-LOW": 0.5}, "o_orderpriority", "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(_with(_ORDERS, _INDEX) + """
, p AS (SELECT *, CAST(('0x' || substr(md5('42:' || episode_id), 1, 8)) AS BIGINT) / 4294967295.0 AS b FROM ix WHERE num_steps >= 3 AND regexp_matches(task_text, 'urgent|high', 'i'))
SELECT robot_id, CASE WHEN b < 0.8 THEN 'train' WHEN b < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS episodes, round(avg(num_steps), 6) AS mean_steps FROM p GROUP BY ALL""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Steps to index, filter, split, aggregate."""
    found = X.query(order_index(spark, d), X.Query(min_steps=3, task_text_regex="urgent|high"))
    df = found.withColumn("split", H.split_md5(F.col("episode_id")))
    return df.groupBy("robot_id", "split").agg(F.count("*").alias("episodes"), F.round(F.avg("num_steps"), 6).alias("mean_steps"))


# -- validators --

_F = ["severity", "code", "episode_id", "step_index", "field", "ord"]
_RLDS = """
SELECT 'WARN' AS severity, 'rlds_invariants' AS code, episode_id, step_index, CAST(NULL AS VARCHAR) AS field, 103 AS ord FROM steps WHERE is_last AND l_tax > 0.04
UNION ALL SELECT 'WARN', 'rlds_invariants', episode_id, step_index, NULL, 106 FROM steps WHERE l_tax < 0.01 AND NOT is_last
UNION ALL SELECT 'ERROR', 'rlds_invariants', episode_id, step_index, NULL, 104 FROM steps WHERE l_quantity = 7 AND NOT is_first AND NOT is_last
UNION ALL SELECT 'ERROR', 'rlds_invariants', episode_id, step_index, NULL, 101 FROM steps WHERE is_first AND l_quantity <> 7 AND l_quantity > 49"""


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Order steps with flags and actions that break the rules here and there, as their values decide."""
    q, tax = F.col("observation")["observation.state"]["num"][0], F.col("observation")["observation.state"]["num"][1]
    return S.order_steps(spark, d).withColumns({
        "action": F.when(F.col("is_last") & (tax > 0.04), F.array(q, tax, q, tax)).otherwise(F.col("action")),
        "is_terminal": (tax < 0.01) & ~F.col("is_last"),
        "is_first": F.when(F.col("is_last"), F.col("is_first") & (q <= 49) | (q == 7) & F.col("is_first")).otherwise((q == 7) | F.col("is_first") & (q <= 49)),
    })


@query(_with(_ORDERS) + _RLDS)
def validate_rlds(spark: SparkSession, d: str) -> DataFrame:
    return V.rlds(_damaged(spark, d)).select(*_F)


_LENGTH = "SELECT CASE WHEN n < 3 THEN 'ERROR' ELSE 'WARN' END AS severity, 'episode_length' AS code, episode_id, CAST(NULL AS INTEGER) AS step_index, CAST(NULL AS VARCHAR) AS field, CASE WHEN n < 3 THEN 201 ELSE 202 END AS ord FROM (SELECT DISTINCT episode_id, n FROM steps) WHERE n < 3 OR n > 7"


@query(_with(_ORDERS) + _LENGTH)
def validate_length(spark: SparkSession, d: str) -> DataFrame:
    return V.length(S.order_steps(spark, d), 3, 7).select(*_F)


_TIMES = """
, g AS (SELECT *, lag(ts) OVER (PARTITION BY episode_id ORDER BY step_index) AS b FROM steps), times AS (
SELECT 'ERROR' AS severity, 'timestamps' AS code, episode_id, step_index, CAST(NULL AS VARCHAR) AS field, 301 AS ord FROM g WHERE ts < b
UNION ALL SELECT 'WARN', 'timestamps', episode_id, step_index, NULL, 302 FROM g WHERE ts - b > 0.2)"""


@query(_with(_ORDERS) + _TIMES + " SELECT * FROM times")
def validate_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return V.timestamps(S.order_steps(spark, d)).select(*_F)


@query(_with(_VECTORS) + """
, a AS (SELECT * FROM vs WHERE action IS NOT NULL), x AS (SELECT episode_id, step_index, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM a),
z AS (SELECT *, abs(x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 1 ELSE stddev_pop(x) OVER w END AS z FROM x WINDOW w AS (PARTITION BY episode_id, d))
SELECT 'WARN' AS severity, 'action_sanity' AS code, episode_id, min(step_index) AS step_index, CAST(NULL AS VARCHAR) AS field, 401 AS ord FROM z WHERE x < -0.3 OR x > 0.3 GROUP BY episode_id
UNION ALL SELECT 'WARN', 'action_sanity', episode_id, min(step_index), NULL, 403 FROM z WHERE z > 2.5 GROUP BY episode_id""")
def validate_action(spark: SparkSession, d: str) -> DataFrame:
    return V.action_sanity(S.embedding_steps(spark, d), (-0.3, 0.3), 2.5).select(*_F)


_SPEC = DatasetSpec("orders", {"observation.state": FeatureSpec("float64", (2,)), "observation.images.front": FeatureSpec("uint8", (64, 64, 3), is_video=True), "observation.images.wrist": FeatureSpec("uint8", (64, 64, 3))}, FeatureSpec("float32", (5,)))


@query(_with(_ORDERS) + """
, f AS (SELECT * FROM steps WHERE step_index = 0)
SELECT 'ERROR' AS severity, 'schema' AS code, episode_id, CAST(NULL AS INTEGER) AS step_index, 'observation.images.front' AS field, 501 AS ord FROM f WHERE rf = 'N'
UNION ALL SELECT 'ERROR', 'schema', episode_id, NULL, 'observation.images.wrist', 501 FROM f WHERE rf <> 'R'
UNION ALL SELECT 'WARN', 'schema', episode_id, NULL, 'observation.images.wrist', 502 FROM f WHERE rf = 'R'
UNION ALL SELECT 'WARN', 'schema', episode_id, NULL, 'observation.images.front', 503 FROM f WHERE rf <> 'N' AND ls = 'O'
UNION ALL SELECT 'ERROR', 'schema', episode_id, min(step_index), 'action', 504 FROM steps WHERE action IS NOT NULL GROUP BY episode_id""")
def validate_schema(spark: SparkSession, d: str) -> DataFrame:
    return V.schema(S.order_steps(spark, d), _SPEC.frame(spark)).select(*_F)


@query(_with(_ORDERS) + " SELECT 'WARN' AS severity, 'image_integrity' AS code, episode_id, step_index, 'observation.images.wrist' AS field, 602 AS ord FROM steps WHERE rf = 'R'")
def validate_images(spark: SparkSession, d: str) -> DataFrame:
    return V.image_integrity(S.order_steps(spark, d)).select(*_F)


@query(_with(_ORDERS) + """
, r AS (SELECT s.*, f.rf AS rf0, f.ls AS ls0 FROM steps s JOIN steps f ON s.episode_id = f.episode_id AND f.step_index = 0 WHERE f.rf <> 'N')
SELECT 'ERROR' AS severity, 'image_alignment' AS code, episode_id, step_index, 'observation.images.front' AS field, 701 AS ord FROM r WHERE rf = 'N'
UNION ALL SELECT 'ERROR', 'image_alignment', episode_id, step_index, 'observation.images.wrist', 701 FROM r WHERE rf0 = 'R' AND rf <> 'R'
UNION ALL SELECT 'WARN', 'image_alignment', episode_id, step_index, 'observation.images.wrist', 702 FROM r WHERE rf0 <> 'R' AND rf = 'R'
UNION ALL SELECT 'ERROR', 'image_alignment', episode_id, step_index, 'observation.images.front', 703 FROM r WHERE rf <> 'N' AND (ls = 'O') <> (ls0 = 'O')""")
def validate_alignment(spark: SparkSession, d: str) -> DataFrame:
    return V.image_alignment(S.order_steps(spark, d)).select(*_F)


@query(_with(_ORDERS) + """
, k AS (SELECT episode_id, count(*) FILTER (is_first) AS n_first, count(*) FILTER (is_last) AS n_last, count(DISTINCT CASE WHEN rf IN ('N', 'R') THEN rf ELSE 'A' END) AS key_sets FROM steps GROUP BY ALL)
SELECT *, key_sets = 1 AS consistent FROM k""")
def structure_check(spark: SparkSession, d: str) -> DataFrame:
    return V.structure(S.order_steps(spark, d))


_FOUND = _TIMES + f", lens AS ({_LENGTH}), found AS (SELECT * FROM times UNION ALL SELECT * FROM lens)"


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    steps = S.order_steps(spark, d)
    return steps.select("episode_id").distinct(), V.timestamps(steps).unionByName(V.length(steps, 3, 7))


@query(_with(_ORDERS) + _FOUND + """
, worst AS (SELECT episode_id, max(CASE severity WHEN 'ERROR' THEN 2 ELSE 1 END) AS w FROM found GROUP BY 1)
SELECT episode_id, CASE w WHEN 2 THEN 'error' WHEN 1 THEN 'invalid' ELSE 'valid' END AS verdict, coalesce(w, 0) >= 1 AS flagged FROM (SELECT DISTINCT episode_id FROM steps) LEFT JOIN worst USING (episode_id)""")
def triage(spark: SparkSession, d: str) -> DataFrame:
    return V.triage(*_found(spark, d), mode="quarantine")


@query(_with(_ORDERS) + _FOUND + " SELECT severity, code, count(*) AS n FROM found GROUP BY ALL")
def summary_true(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(_found(spark, d)[1])


@query(_with(_ORDERS) + _FOUND + " SELECT arg_min(severity, episode_id || lpad(CAST(ord AS VARCHAR), 4, '0') || lpad(CAST(coalesce(step_index, 0) AS VARCHAR), 6, '0')) AS severity, code, count(*) AS n FROM found GROUP BY code")
def summary_parity(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(_found(spark, d)[1], first_decides=True)


@query(_with(_ORDERS) + _FOUND + " SELECT severity, count(*) AS n FROM found GROUP BY severity")
def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return V.by_severity(_found(spark, d)[1])


@query(_with(_ORDERS) + _FOUND + """
, worst AS (SELECT episode_id, max(CASE severity WHEN 'ERROR' THEN 2 ELSE 1 END) AS w FROM found GROUP BY 1), v AS (SELECT DISTINCT s.episode_id, coalesce(w, 0) AS w FROM steps s LEFT JOIN worst USING (episode_id))
SELECT count(*) AS episodes, count(*) FILTER (w = 0) AS valid_episodes, count(*) FILTER (w = 1) AS invalid_episodes, count(*) FILTER (w = 2) AS error_episodes,
(SELECT count(*) FROM found WHERE severity = 'ERROR') AS error_findings, (SELECT count(*) FROM found WHERE severity = 'WARN') AS warn_findings, CAST(0 AS BIGINT) AS info_findings FROM v""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return V.report(*_found(spark, d))


@query(_with(_ORDERS) + _FOUND + " SELECT episode_id, step_index FROM steps s WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.episode_id = s.episode_id AND severity = 'ERROR')")
def reject_errors(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)[1].where("severity = 'ERROR'")
    return X.without(S.order_steps(spark, d), found).select("episode_id", "step_index")


# -- statistics and transforms --


@query(_with(_VECTORS) + """
, x AS (SELECT 'action' AS feature, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM vs UNION ALL SELECT 'observation.state', unnest(state), generate_subscripts(state, 1) FROM vs)
SELECT feature, CAST(d - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS count FROM x GROUP BY ALL""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.feature_stats(S.embedding_steps(spark, d)).select("feature", "dim", *[r6(c) for c in ("mean", "std", "min", "max")], "count")


_FLAT = "SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST(x AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM"


def _flat(df: DataFrame) -> DataFrame:
    return df.where("action is not null").select("episode_id", "step_index", F.posexplode("action").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("float"), 4) + F.lit(0.0).cast("float"))


@query(_with(_VECTORS) + """
, x AS (SELECT episode_id, step_index, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM vs WHERE action IS NOT NULL),
b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM x WINDOW w AS (PARTITION BY episode_id, d))
SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST(greatest(-1, least(1, CASE WHEN hi - lo < 1e-8 THEN x ELSE 2 * (x - lo) / (hi - lo) - 1 END)) AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM b""")
def normalize_actions_episode(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.embedding_steps(spark, d).transform(T.normalize_actions()))


@query(_with(_VECTORS) + " SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST(greatest(-1, least(1, 2 * (x + 0.25) / 0.5 - 1)) AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM (SELECT episode_id, step_index, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM vs WHERE action IS NOT NULL)")
def normalize_actions_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.embedding_steps(spark, d).transform(T.normalize_actions((-0.25, 0.25))))


@query(_with(_ORDERS) + f" {_FLAT} (SELECT episode_id, step_index, unnest(list_resize(action, 7, 0.5)) AS x, unnest(range(1, 8)) AS d FROM steps WHERE action IS NOT NULL)")
def pad_actions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.order_steps(spark, d).transform(T.pad_actions(7, 0.5)))


@query(_with(_VECTORS) + f" {_FLAT} (SELECT episode_id, step_index, unnest(list_append(action[1:6], action[64])) AS x, unnest(range(1, 8)) AS d FROM vs WHERE action IS NOT NULL)")
def map_action_space(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.embedding_steps(spark, d).transform(T.map_action_space("custom", "ee_delta_7")))


@query(_with(_ORDERS, _INDEX) + ", c AS (SELECT task_text, min(episode_index) AS f FROM ix GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY f, task_text) - 1 AS INTEGER) AS task_id, task_text FROM c")
def task_catalog(spark: SparkSession, d: str) -> DataFrame:
    return T.task_catalog(T.task_texts(S.order_steps(spark, d)))


@query(_with(_ORDERS, _INDEX) + ", c AS (SELECT task_text, row_number() OVER (ORDER BY min(episode_index), task_text) - 1 AS i FROM ix GROUP BY 1) SELECT episode_id, CAST(i AS INTEGER) AS task_id FROM ix JOIN c USING (task_text)")
def episode_task_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.with_task_ids(T.task_texts(S.order_steps(spark, d))).select("episode_id", "task_id")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents")
def collapse_white_space(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", collapsed(F.col("text")).alias("text"))


#: The table has letters with accents, but none that only NFKC changes; the others are in the tests.
@query("SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'), ' ') AS text FROM conversations")
def normalize_task_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", normalize_text(F.col("text")).alias("text"))


@query(_with(_ORDERS) + """
, r AS (SELECT episode_id, step_index, ts AS t FROM steps WHERE step_index = 0 UNION ALL SELECT s.episode_id, s.step_index, CASE WHEN s.ts > r.t THEN s.ts ELSE r.t + 0.1 END FROM r JOIN steps s ON s.episode_id = r.episode_id AND s.step_index = r.step_index + 1)
SELECT episode_id, step_index, round(t, 4) AS timestamp FROM r""")
def timestamp_repair(spark: SparkSession, d: str) -> DataFrame:
    return S.order_steps(spark, d).transform(T.repair_timestamps()).select("episode_id", "step_index", F.round("timestamp", 4).alias("timestamp"))


#: A rate of one step in six hours, for events that are hours apart.
_RATE = 1 / 21_600


@query(_with(_EVENTS) + """
, e AS (SELECT episode_id, max(ts) AS z, CAST(ceil(max(ts) / 21600.0) AS INTEGER) AS k FROM ev GROUP BY 1), j AS (SELECT episode_id, unnest(range(0, k)) AS j FROM e WHERE z > 0)
SELECT j.episode_id, CAST(j.j AS INTEGER) AS step_index, arg_min(ev.value, (abs(ev.ts - j.j * 21600.0), ev.step_index)) AS reward FROM j JOIN ev ON ev.episode_id = j.episode_id GROUP BY ALL""")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return S.event_steps(spark, d).transform(T.resample(_RATE)).select("episode_id", "step_index", "reward")


@query(_with(_EVENTS) + """
, sz AS (SELECT episode_index, n, row_number() OVER (ORDER BY episode_index) AS k FROM (SELECT DISTINCT episode_index, n FROM ev)),
p AS (SELECT k, episode_index, n, 0 AS shard, CAST(0 AS BIGINT) AS start FROM sz WHERE k = 1
  UNION ALL SELECT sz.k, sz.episode_index, sz.n, p.shard + CASE WHEN p.start + p.n + sz.n > 500 THEN 1 ELSE 0 END, CASE WHEN p.start + p.n + sz.n > 500 THEN 0 ELSE p.start + p.n END FROM p JOIN sz ON sz.k = p.k + 1)
SELECT episode_index, CAST(shard AS INTEGER) AS shard, start FROM p""")
def shard_packing(spark: SparkSession, d: str) -> DataFrame:
    sizes = S.event_steps(spark, d).groupBy("episode_index").agg(F.count("*").alias("num_steps"))
    return shards.pack(sizes, 500)


@query(_with(_EVENTS) + """
, sz AS (SELECT episode_index, n, row_number() OVER (ORDER BY episode_index) AS k FROM (SELECT DISTINCT episode_index, n FROM ev)),
p AS (SELECT k, episode_index, 0 AS shard, n AS used FROM sz WHERE k = 1 UNION ALL SELECT sz.k, sz.episode_index, p.shard + CASE WHEN p.used >= 500 THEN 1 ELSE 0 END, CASE WHEN p.used >= 500 THEN sz.n ELSE p.used + sz.n END FROM p JOIN sz ON sz.k = p.k + 1)
SELECT episode_index, CAST(shard AS INTEGER) AS shard, CAST((max(k) OVER (PARTITION BY shard) - 1) // 20 AS INTEGER) AS chunk FROM p""")
def shard_flush(spark: SparkSession, d: str) -> DataFrame:
    sizes = S.event_steps(spark, d).groupBy("episode_index").agg(F.count("*").alias("num_steps"))
    return shards.flush_shards(sizes, 500, 20).drop("file")


@query(_with(_EVENTS) + " SELECT episode_id, step_index, round(list_sum(list(value) OVER w), 4) AS s FROM ev WHERE NOT is_last WINDOW w AS (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def history_windows(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("action_history", F.lit(0.0), lambda a, x: a + x[0])
    return S.event_steps(spark, d).transform(T.history(3)).where("not is_last").select("episode_id", "step_index", F.round(total, 4).alias("s"))


# -- evaluation, cards, joins, text --


@query("""
SELECT o_orderpriority AS task, count(*) AS n_episodes, count(*) FILTER (o_orderstatus = 'F') AS n_successes, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_rate, round(avg(o_totalprice), 4) AS mean_reward, round(avg(o_custkey % 200), 6) AS mean_steps
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    results = o.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").cast("int").alias("episode_idx"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("total_reward"), (F.col("o_custkey") % 200).cast("int").alias("num_steps"))
    return evaluate.metrics(results).select("task", "n_episodes", "n_successes", r6("success_rate"), F.round("mean_reward", 4).alias("mean_reward"), r6("mean_steps"))


@query(_with(_ORDERS, _INDEX) + """
SELECT count(*) AS num_episodes, CAST(sum(num_steps) AS BIGINT) AS num_steps, list_sort(list(DISTINCT robot_id)) AS robots, list_sort(list_distinct(list_filter(flatten(list(string_split(camera_set, ','))), lambda c: c <> ''))) AS cameras, list_sort(list(DISTINCT task_text))[1:10] AS tasks FROM ix""")
def dataset_card(spark: SparkSession, d: str) -> DataFrame:
    return sinks.card(order_index(spark, d))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{r}', '{next((p for p in S.PREFERRED if p in c), c[0])}')" for n, (r, c) in S.KNOWN.items()) + ") t(name, robot, camera)")
def recommended_cameras(spark: SparkSession, d: str) -> DataFrame:
    return S.registry(spark).select("name", "robot", S.recommended_camera(F.col("cameras")).alias("camera"))


@query(_with(_ORDERS) + " SELECT episode_id, step_index, l_quantity AS q, CASE WHEN (arg_min(rf, step_index) OVER (PARTITION BY episode_id)) <> 'N' AND rf <> 'N' THEN true ELSE false END AS has FROM steps")
def select_camera(spark: SparkSession, d: str) -> DataFrame:
    df = S.order_steps(spark, d).transform(T.select_camera())
    return df.select("episode_id", "step_index", F.col("observation")["observation.state"]["num"][0].alias("q"), F.map_contains_key("observation", "observation.images.canonical").alias("has"))


@query(_with(_ORDERS) + ", m AS (SELECT o_orderkey AS k, o_orderpriority FROM orders) SELECT printf('orders_%06d', l_orderkey) AS episode_id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS reward, count(*) AS n, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def robot_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with the nation of their customer, through dimension tables whose size the optimiser checks."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    per = S.order_steps(spark, d).groupBy("episode_id", "episode_index").agg(F.round(F.sum("reward"), 4).alias("reward"), F.count("*").alias("n"))
    at = read("orders").select(F.col("o_orderkey").alias("episode_index"), "o_custkey").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return per.join(at, "episode_index").select("episode_id", "reward", "n", "n_name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    df = window_counts(spark.read.parquet(f"{d}/events.parquet"))
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    df = sessions(spark.read.parquet(f"{d}/events.parquet"), gap="6 hours")
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT printf('conversations_%06d', conv_id) AS episode_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS step_index, text FROM conversations")
def conversation_episodes(spark: SparkSession, d: str) -> DataFrame:
    return S.conversation_steps(spark, d).select("episode_id", "step_index", F.col("observation")["observation.language"]["str"].alias("text"))


@query(_with(_ORDERS) + " SELECT episode_id, count(*) AS n, round(sum(reward), 4) AS reward, round(sum(list_sum(coalesce(action, [0.0, 0.0, 0.0, 0.0]))), 4) AS actions FROM steps GROUP BY 1")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    spec = DatasetSpec("orders", {"observation.state": FeatureSpec("float32", (2,))}, FeatureSpec("float32", (4,)))
    add = lambda f: F.round(F.aggregate("steps", F.lit(0.0), lambda a, s: a + f(s)), 4)
    actions = add(lambda s: F.aggregate(s["action"], F.lit(0.0), lambda b, x: b + x))
    return sinks.nested(S.order_steps(spark, d), spec).select("episode_id", F.size("steps").cast("bigint").alias("n"), add(lambda s: s["reward"]).alias("reward"), actions.alias("actions"))


@query(_with(_VECTORS) + """
, x AS (SELECT episode_id, step_index, unnest(action) AS x, generate_subscripts(action, 1) AS d FROM vs WHERE action IS NOT NULL), m AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY d)
SELECT episode_id, step_index, CAST(d - 1 AS INTEGER) AS dim, round(CAST((x - m) / CASE WHEN s > 1e-8 THEN s ELSE 1 END AS FLOAT), 4) + CAST(0 AS FLOAT) AS x FROM x JOIN m USING (d)""")
def standardize_actions(spark: SparkSession, d: str) -> DataFrame:
    steps = S.embedding_steps(spark, d)
    return _flat(steps.transform(T.normalize_features(stats.feature_stats(steps))))


@query(_with(_ORDERS) + " SELECT DISTINCT 'orders' AS dataset_id, CAST(4 AS INTEGER) AS width, ['observation.images.front', 'observation.images.wrist', 'observation.language', 'observation.state'] AS features FROM steps")
def probe_spec(spark: SparkSession, d: str) -> DataFrame:
    spec = S.probe(S.order_steps(spark, d), "orders")
    return spark.createDataFrame([(spec.dataset_id, spec.action.shape[0], sorted(spec.observation))], "dataset_id string, width int, features array<string>")


_PARTS = ("validate_timestamps", "validate_schema", "validate_images", "validate_alignment")


@query("WITH found AS (" + " UNION ALL ".join(f"SELECT severity, episode_id FROM ({SQL[n]})" for n in _PARTS) + " UNION ALL SELECT 'WARN', episode_id FROM (" + _with(_ORDERS) + """ SELECT DISTINCT episode_id FROM steps WHERE action IS NOT NULL AND (list_max(action) > 10 OR list_min(action) < -10)))
, worst AS (SELECT episode_id, max(CASE severity WHEN 'ERROR' THEN 2 ELSE 1 END) AS w FROM found GROUP BY 1), v AS (SELECT e.episode_id, coalesce(w, 0) AS w FROM (SELECT DISTINCT printf('orders_%06d', l_orderkey) AS episode_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e LEFT JOIN worst USING (episode_id))
SELECT count(*) AS episodes, count(*) FILTER (w = 0) AS valid_episodes, count(*) FILTER (w = 1) AS invalid_episodes, count(*) FILTER (w = 2) AS error_episodes,
(SELECT count(*) FROM found WHERE severity = 'ERROR') AS error_findings, (SELECT count(*) FROM found WHERE severity = 'WARN') AS warn_findings, CAST(0 AS BIGINT) AS info_findings FROM v""")
def validate_all(spark: SparkSession, d: str) -> DataFrame:
    """Every validator, triaged into one report."""
    return C.Compiler("orders").validate_only(S.order_steps(spark, d), spark, spec=_SPEC)[1]
