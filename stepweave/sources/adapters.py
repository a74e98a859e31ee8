"""Sources of trajectories: adapters that give a steps table, an episodes' source table, and a spec."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stepweave.functions.keys import leaves
from stepweave.sources.schema import STEPS, VALUE, DatasetSpec, FeatureSpec, conform


def parse_selector(selector: str | None) -> tuple[int | None, int | None]:
    """'[a:b]' as (a, b); either side may be absent."""
    if not selector:
        return None, None
    parts = selector.strip().strip("[]").split(":")
    if len(parts) != 2:
        raise ValueError(f"not a slice: {selector!r}")
    a, b = (int(x) if x.strip() else None for x in parts)
    return a, b


def select_slice(df: DataFrame, selector: str | None, index: str = "episode_index") -> DataFrame:
    """Rows of the episodes from a up to, not including, b."""
    a, b = parse_selector(selector)
    for x, keep in ((a, F.col(index) >= F.lit(a)), (b, F.col(index) < F.lit(b))):
        if x is not None:
            df = df.where(keep)
    return df


def numeric(values: Column, dtype: str = "float32", shape: Column | None = None) -> Column:
    """An observation's value of numbers."""
    return F.struct(F.lit(dtype).alias("dtype"), (shape if shape is not None else F.array(F.size(values))).alias("shape"), values.cast("array<double>").alias("num"), F.lit(None).cast("binary").alias("bin"), F.lit(None).cast("string").alias("str"))


def textual(text: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("string").alias("dtype"), F.array().cast("array<int>").alias("shape"), none.cast("array<double>").alias("num"), none.cast("binary").alias("bin"), text.alias("str"))


def image(data: Column, shape: Column, dtype: str = "uint8") -> Column:
    none = F.lit(None)
    return F.struct(F.lit(dtype).alias("dtype"), shape.cast("array<int>").alias("shape"), none.cast("array<double>").alias("num"), data.cast("binary").alias("bin"), none.cast("string").alias("str"))


@dataclass
class Adapter:
    """A source: probe() describes it, steps() and episodes() read it. read makes the steps from a session."""

    dataset_id: str
    read: Callable[[SparkSession], DataFrame]
    robot_id: str = "unknown"
    control_rate_hz: float = 10.0

    def __enter__(self) -> Adapter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def steps(self, spark: SparkSession, selector: str | None = None) -> DataFrame:
        return select_slice(self.read(spark), selector)

    def probe(self, spark: SparkSession) -> DatasetSpec:
        return probe(self.read(spark), self.dataset_id, self.control_rate_hz)


def probe(steps: DataFrame, dataset_id: str, control_rate_hz: float = 10.0) -> DatasetSpec:
    """The features in a steps table: keys, types and shapes of observations, and the action's width."""
    each = steps.select(F.explode("observation").alias("key", "v")).groupBy("key").agg(F.min_by(F.struct("v.dtype", "v.shape"), F.struct("v.dtype", "v.shape")).alias("x"))
    rows = each.select("key", "x.dtype", "x.shape").orderBy("key").collect()  # as many as there are features
    observation = {r.key: FeatureSpec(r.dtype, tuple(r.shape or ()), is_video=len(r.shape or ()) >= 3 and r.shape[-1] in (1, 3, 4)) for r in rows}
    width = steps.agg(F.max(F.size("action")).alias("n")).first().n  # of the widest action there is
    return DatasetSpec(dataset_id, observation, FeatureSpec("float32", (width,)) if width is not None and width >= 0 else None, control_rate_hz, cameras=sorted({k.rpartition(".")[2] for k in observation if "image" in k}))


def probe_schema(schema: T.StructType, dataset_id: str) -> DatasetSpec:
    """A spec from column types alone, nested structs as dotted names."""
    kinds = {T.FloatType: "float32", T.DoubleType: "float64", T.IntegerType: "int32", T.LongType: "int64", T.ShortType: "int16", T.ByteType: "int8", T.BooleanType: "bool", T.StringType: "string", T.BinaryType: "uint8"}
    observation, action = {}, None
    for path, f in leaves(schema):
        t, rank = f.dataType, 0
        while isinstance(t, T.ArrayType):
            t, rank = t.elementType, rank + 1
        feature = FeatureSpec(f.metadata.get("dtype", kinds.get(type(t), "string")), tuple(f.metadata.get("shape", [-1] * rank)), is_video=bool(f.metadata.get("is_video", False)))
        if path[-1] == "action":
            action = feature
        elif path[0] == "observation":
            observation[".".join(path)] = feature
    return DatasetSpec(dataset_id, observation, action, cameras=sorted(k.rpartition(".")[2] for k in observation if "image" in k))


#: Bytes of a source's files for each task that reads its steps in order.
TASK_BYTES = 1 << 20


def _tasks(rows: DataFrame) -> int:
    """As many tasks as the rows' files ask for, and one for each core at least; Spark's own number where it doesn't know their size."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(rows.sparkSession.sparkContext.defaultParallelism, min(size // TASK_BYTES, 10_000))


def _episode_name(dataset_id: str, index: Column) -> Column:
    return F.format_string(f"{dataset_id}_%06d", index)


def from_rows(rows: DataFrame, dataset_id: str, order: list[str], episode: str = "episode_index", action: Column | None = None, timestamp: Column | None = None, keep_last_action: bool = False) -> DataFrame:
    """Steps of any table: the order inside an episode makes step_index and the flags; the last step's action is dropped.

    Without timestamps they are step_index / 10. Rows are shuffled once, by episode_id: what groups or joins steps by it needs
    no other shuffle, and tasks become more as the rows do.
    """
    key, name = [F.col(o) for o in order], _episode_name(dataset_id, F.col(episode))
    rows = rows.withColumn("episode_id", name).repartition(_tasks(rows), "episode_id")
    every = W.partitionBy(episode, "episode_id")
    i = (F.row_number().over(every.orderBy(*key)) - 1).cast("int")
    last = i == F.count("*").over(every) - 1
    df = rows.withColumns({"step_index": i, "is_last": last}).withColumn("is_first", F.col("step_index") == 0)
    made = {
        "dataset_id": F.lit(dataset_id),
        "timestamp": (F.col("step_index") * 0.1) if timestamp is None else timestamp,
        "action": F.lit(None).cast("array<double>") if action is None else action if keep_last_action else F.when(~F.col("is_last"), action),
    }
    return df.withColumns(made)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as an episode: what a line sells is the action, its sum the reward."""
    line = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", _episode_name("orders", F.col("o_orderkey")).alias("episode_id"))
    steps = from_rows(
        line.withColumn("episode_index", F.col("l_orderkey")), "orders", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"],
        action=F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"), timestamp=seconds(F.col("l_shipdate")),
    )
    # by both, as the steps are by episode_id and sorted by the key
    df = steps.join(orders.repartition(_tasks(line), "episode_id"), ["l_orderkey", "episode_id"])
    camera = F.when(F.col("l_returnflag") != "N", F.map_from_arrays(F.array(F.lit("observation.images.front")), F.array(image(F.lit(None), F.when(F.col("l_linestatus") == "O", F.array(F.lit(32), F.lit(32), F.lit(3))).otherwise(F.array(F.lit(64), F.lit(64), F.lit(3)))))))
    wrist = F.when(F.col("l_returnflag") == "R", F.map_from_arrays(F.array(F.lit("observation.images.wrist")), F.array(image(F.lit(None), F.array(F.lit(64), F.lit(64), F.lit(3)), "float32"))))
    none = F.create_map().cast(f"map<string,{VALUE}>")
    state = F.map_from_arrays(F.array(F.lit("observation.state"), F.lit("observation.language")), F.array(numeric(F.array("l_quantity", "l_tax")), textual(F.concat_ws(" ", "l_returnflag", "l_linestatus"))))
    return df.withColumns({
        "is_terminal": F.col("is_last") & (F.col("o_orderstatus") == "F"), "reward": F.col("l_extendedprice") * (1 - F.col("l_discount")), "discount": F.when(F.col("is_last"), 0.0).otherwise(1.0),
        "observation": F.map_concat(state, F.coalesce(camera, none), F.coalesce(wrist, none)), "robot_id": F.col("o_orderpriority"), "task_text": F.concat_ws(" ", "o_orderstatus", "o_orderpriority"),
    }).select(*[c for c in _STEP_COLUMNS], "robot_id", "task_text")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as an episode."""
    df = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    at = seconds(F.col("ts"))
    steps = from_rows(df.withColumn("episode_index", F.col("user_id")), "events", ["ts", "event_id"], action=F.array("value"), timestamp=at - F.min(at).over(W.partitionBy("episode_index", "episode_id")))
    state = F.map_from_arrays(F.array(F.lit("observation.state")), F.array(numeric(F.array("value"))))
    made = {"is_terminal": F.col("is_last"), "reward": F.col("value"), "discount": F.lit(1.0), "observation": state, "robot_id": F.lit("web"), "task_text": F.col("event_type")}
    return steps.withColumns(made).select(*_STEP_COLUMNS, "robot_id", "task_text", "props")


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as an episode of language only."""
    df = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet"))
    steps = from_rows(df.withColumn("episode_index", F.col("conv_id").cast("bigint")), "conversations", ["turn", "role", "text"])
    text = F.map_from_arrays(F.array(F.lit("observation.language")), F.array(textual(F.col("text"))))
    made = {"is_terminal": F.col("is_last"), "reward": F.lit(None).cast("double"), "discount": F.lit(None).cast("double"), "observation": text, "robot_id": F.col("role"), "task_text": F.col("text")}
    return steps.withColumns(made).select(*_STEP_COLUMNS, "robot_id", "task_text")


def embedding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors as an episode of wide actions."""
    df = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    vector = F.col("embedding").cast("array<double>")
    steps = from_rows(df.withColumn("episode_index", F.col("label").cast("bigint")), "embeddings", ["vec_id"], action=vector)
    state = F.map_from_arrays(F.array(F.lit("observation.state")), F.array(numeric(vector)))
    made = {"is_terminal": F.col("is_last"), "reward": F.lit(0.0), "discount": F.lit(1.0), "observation": state, "robot_id": F.lit("encoder"), "task_text": F.concat(F.lit("label "), F.col("label").cast("string"))}
    return steps.withColumns(made).select(*_STEP_COLUMNS, "robot_id", "task_text")


_STEP_COLUMNS = ["episode_id", "dataset_id", "episode_index", "step_index", "is_first", "is_last", "is_terminal", "timestamp", "action", "reward", "discount", "observation"]


def directory(spark: SparkSession, path: str, format: str = "parquet", dataset_id: str | None = None) -> DataFrame:
    """Steps of a folder of files in any format that Spark reads, in the model's columns."""
    df = spark.read.format(format).load(path)
    return conform(df, STEPS, {"dataset_id": dataset_id or os.path.basename(path.rstrip("/"))})


_PARSED = f"path string, position long, steps array<struct<is_terminal:boolean,reward:double,discount:double,action:array<double>,observation:map<string,{VALUE}>>>"


def record_steps(spark: SparkSession, path: str, dataset_id: str, spec: DatasetSpec | None = None, check: bool = True) -> DataFrame:
    """Steps of record files of Examples: episodes are numbered by file and place, flags and times are made anew.

    The last step's action is dropped. Only a file's number of episodes is counted over all files, never a step.
    """
    from stepweave.sources.examples import step_arrays
    from stepweave.sources.records import RecordSource

    spark.dataSource.register(RecordSource)
    files = spark.read.format("records").option("path", path)
    raw = files.option("check", str(check).lower()).load()
    features = {k: (f.dtype, list(f.shape)) for k, f in spec.observation.items()} if spec else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                yield pa.record_batch([b.column(0), b.column(1), step_arrays(b.column(2).to_pylist(), features)], names=["path", "position", "steps"])

    rows = raw.mapInArrow(parse, _PARSED)
    files = files.option("counts", "true").load().select("path", F.col("position").alias("n"))  # a row a file
    begin = files.select("path", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    each = rows.join(begin, "path").withColumn("episode_index", F.col("begin") + F.col("position")).withColumn("n", F.size("steps"))
    each = each.select("episode_index", "n", F.posexplode("steps").alias("step_index", "s")).withColumn("is_last", F.col("step_index") == F.col("n") - 1)
    made = {"episode_id": F.format_string(f"{dataset_id}_%06d", "episode_index"), "dataset_id": F.lit(dataset_id), "is_first": F.col("step_index") == 0, "is_terminal": F.col("s.is_terminal"), "timestamp": F.col("step_index") * 0.1}
    made |= {"action": F.when(~F.col("is_last"), F.col("s.action")), "reward": F.col("s.reward"), "discount": F.col("s.discount"), "observation": F.col("s.observation")}
    return conform(each.withColumns(made), STEPS)


def first_task_text(steps: DataFrame) -> Column:
    """For an aggregation by episode: its own text, else the first step's language."""
    own = F.min_by("task_text", "step_index") if "task_text" in steps.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(own, F.lit("")), F.min_by(F.col("observation")["observation.language"]["str"], F.col("step_index")))


#: Public collections: name, robot, cameras.
_KNOWN = """
berkeley_autolab_ur5|UR5|cam_high cam_low
bridge|WidowX|image_0 image_1 image_2 image_3 image_4 image_5
taco_play|Franka|rgb_static rgb_gripper
jaco_play|Jaco|image
berkeley_cable_routing|Franka|image wrist_image
roboturk|Sawyer|front_rgb
nyu_door_opening_surprising_effectiveness|Hello Robot Stretch|image
viola|Franka|agentview_rgb eye_in_hand_rgb
berkeley_fanuc_manipulation|Fanuc LR Mate|image
language_table|xArm + Custom Gripper|rgb
droid|Franka|exterior_image_1_left exterior_image_2_left wrist_image_left
aloha_dagger_dataset|ViperX (Bimanual)|cam_high cam_low cam_left_wrist cam_right_wrist
"""
KNOWN: dict[str, tuple[str, list[str]]] = {n: (robot, cameras.split()) for n, robot, cameras in (x.split("|") for x in _KNOWN.split("\n") if x)}
PREFERRED = ("front", "cam_high", "image", "rgb", "agentview_rgb", "exterior_image_1_left")


def registry(spark: SparkSession) -> DataFrame:
    """name, robot, cameras of the known collections: a small table to join with."""
    return spark.createDataFrame([(n, r, c) for n, (r, c) in KNOWN.items()], "name STRING, robot STRING, cameras ARRAY<STRING>")


def recommended_camera(cameras: Column) -> Column:
    """The first preferred one, else the first."""
    preferred = F.array(*[F.lit(p) for p in PREFERRED])
    return F.coalesce(F.get(F.filter(preferred, lambda p: F.array_contains(cameras, p)), F.lit(0)), F.get(cameras, F.lit(0)))
