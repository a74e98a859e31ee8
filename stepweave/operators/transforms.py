"""Transforms of steps: functions from DataFrame to DataFrame, to be chained by df.transform.

All but three are projections of one row. Bounds of an episode and the repair of timestamps look at one episode at a time,
which is all that is shuffled; resampling moves each step once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stepweave.functions import actions as A
from stepweave.functions.keys import IMAGES, is_image
from stepweave.functions.text import normalize_text
from stepweave.sources.schema import VALUE

Transform = Callable[[DataFrame], DataFrame]
FALLBACK_CAMERAS = ("front", "cam_high", "image", "rgb", "agentview_rgb", "image_0", "exterior_image_1_left")


def chain(*transforms: Transform) -> Transform:
    """One after the other; none is the identity."""
    return lambda df: reduce(lambda d, t: d.transform(t), transforms, df)


def normalize_actions(bounds: tuple[float, float] | None = None, clip: bool = True, scope: str = "episode") -> Transform:
    """Actions to [-1, 1], from the given bounds or each dimension's own in the episode (or, scope='dataset', in all).

    A dimension that hardly varies keeps its values, clipped.
    """
    if scope not in ("episode", "dataset"):
        raise ValueError("scope is episode or dataset")

    def fixed(df: DataFrame) -> DataFrame:
        return df.withColumn("action", A.as_float32(A.to_unit(F.col("action"), *bounds, clipped=clip)))

    def own(df: DataFrame) -> DataFrame:
        keys = ["episode_id"] if scope == "episode" else []
        each = df.where("action is not null").select(*keys, F.posexplode("action").alias("d", "x")).groupBy(*keys, "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        flat = F.col("hi") - F.col("lo") < A.TINY
        lows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", F.when(flat, -1.0).otherwise(F.col("lo")).alias("lo"), F.when(flat, 1.0).otherwise(F.col("hi")).alias("hi")))).alias("_b"))
        joined = df.join(lows, keys, "left") if keys else df.crossJoin(F.broadcast(lows))  # without keys it is one row
        unit = A.to_unit(F.col("action"), F.transform("_b", lambda b: b["lo"]), F.transform("_b", lambda b: b["hi"]), clip)
        return joined.withColumn("action", A.as_float32(unit)).select(*df.columns)

    return own if bounds is None else fixed


def pad_actions(target_dim: int = 7, pad_value: float = 0.0) -> Transform:
    return lambda df: df.withColumn("action", A.as_float32(A.pad(F.col("action"), target_dim, pad_value)))


def map_action_space(source: str = "custom", target: str = "ee_delta_7", gripper_index: int = -1) -> Transform:
    """source is only for the reader: what an action has decides."""
    return lambda df: df.withColumn("action", A.as_float32(A.map_space(F.col("action"), target, gripper_index)))


def camera_names(observation: Column) -> Column:
    return F.transform(F.filter(F.map_keys(observation), is_image), lambda k: F.element_at(F.split(k, r"\."), -1))


def pick_camera(cameras: Column, name: str | None = None, fallback: tuple[str, ...] = FALLBACK_CAMERAS) -> Column:
    if name:
        return F.lit(name)
    order = F.array(*[F.lit(x) for x in fallback])
    return F.coalesce(F.get(F.filter(order, lambda x: F.array_contains(cameras, x)), F.lit(0)), F.array_min(cameras))


def select_camera(name: str | None = None, fallback: tuple[str, ...] = FALLBACK_CAMERAS, cameras: list[str] | None = None, target_key: str = IMAGES + "canonical") -> Transform:
    """A copy of one camera's images under target_key.

    The camera is the one named, else the first of fallback that there is (in the spec's cameras, or in the first step),
    else the first by name; without any, nothing changes.
    """

    def run(df: DataFrame) -> DataFrame:
        if name or cameras:
            chosen = pick_camera(F.array(*[F.lit(c) for c in cameras or ()]).cast("array<string>"), name, fallback)
        else:
            first = F.when(F.col("step_index") == 0, pick_camera(camera_names(F.col("observation")), None, fallback))
            chosen = F.max(first).over(W.partitionBy("episode_id"))
        source = F.concat(F.lit(IMAGES), F.col("_camera"))
        has = F.col("_camera").isNotNull() & F.map_contains_key("observation", F.coalesce(source, F.lit("")))
        others = F.map_filter("observation", lambda k, _: k != target_key)
        copy = F.map_concat(others, F.map_from_arrays(F.array(F.lit(target_key)), F.array(F.try_element_at("observation", source))))
        return df.withColumn("_camera", chosen).withColumn("observation", F.when(has, copy).otherwise(F.col("observation"))).drop("_camera")

    return run


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resized by taking the nearest lower row and column."""
    h, w = image.shape[:2]
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width]


def _triangles(n: int, size: int) -> np.ndarray:
    """What each of size places takes of n ones: by distance between centres, over as many as fall together if they become fewer."""
    scale = n / size
    far = np.abs((np.arange(n)[None, :] + 0.5) - (np.arange(size)[:, None] + 0.5) * scale) / max(scale, 1.0)
    weights = np.maximum(1 - far, 0)
    return weights / weights.sum(axis=1, keepdims=True)


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resized by linear interpolation in both directions; integers are rounded."""
    h, w = image.shape[:2]
    out = np.einsum("ih,hwc->iwc", _triangles(h, height), image.astype(np.float64))
    out = np.einsum("jw,iwc->ijc", _triangles(w, width), out)
    return np.rint(out).astype(image.dtype) if image.dtype.kind in "iu" else out.astype(image.dtype)


_RESIZE = {"nearest": nearest, "bilinear": bilinear}


def _resizer(size: tuple[int, int] | None, how: str, hwc: bool, chw_out: bool, dtype: str | None, shapes: bool, names: list[str]):
    """Looks at the images' entries only; all else goes through as it came."""
    resize = _RESIZE[how]

    def alike(data: list[bytes], kind: str, shape: tuple[int, ...]) -> np.ndarray:
        """Images of one type and shape, one after the other: (image, height, width, channel)."""
        x = np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), *shape)
        if hwc and shape[0] in (1, 3, 4) and shape[0] < shape[1]:
            x = x.transpose(0, 2, 3, 1)
        if size:  # as one image of many channels
            n, h, w, c = x.shape
            x = resize(np.ascontiguousarray(x.transpose(1, 2, 0, 3)).reshape(h, w, n * c), *size).reshape(*size, n, c).transpose(2, 0, 1, 3)
        if chw_out:
            x = x.transpose(0, 3, 1, 2)
        return np.ascontiguousarray(x.astype(dtype) if dtype else x)

    def every(data: list[bytes], kinds: list[str], shapes: list[list[int]]) -> list[np.ndarray]:
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(kinds, map(tuple, shapes), strict=True)):
            groups.setdefault(key, []).append(k)
        out: list[Any] = [None] * len(data)
        for (kind, shape), places in groups.items():
            step = max(1, (8 << 20) // max(1, len(data[places[0]])))  # some MB at a time
            for a in range(0, len(places), step):
                part = places[a : a + step]
                for k, x in zip(part, alike([data[k] for k in part], kind, shape), strict=True):
                    out[k] = x
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(b.schema.get_field_index("observation"))
            keys, items = m.keys, m.items
            data, shape, kind = items.field("bin"), items.field("shape"), items.field("dtype")
            ok = pc.and_(pc.and_(pc.match_substring(keys, "image"), data.is_valid()), pc.equal(pc.fill_null(pc.list_value_length(shape), 0), 3))
            ok = pc.fill_null(ok, False)
            places = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
            made = every(*[x.take(pa.array(places)).to_pylist() for x in (data, kind, shape)])
            dims = shape.to_pylist()
            was = {}
            for p, x in zip(places.tolist(), made, strict=True):
                was[p], dims[p] = dims[p], list(x.shape)
            new = {"dtype": pc.replace_with_mask(kind, ok, pa.array([x.dtype.name for x in made], kind.type)), "shape": pa.array(dims, shape.type), "bin": pc.replace_with_mask(data, ok, pa.array([x.tobytes() for x in made], data.type))}
            fields = [items.type.field(k) for k in range(items.type.num_fields)]
            struct = pa.StructArray.from_arrays([new.get(f.name, items.field(f.name)) for f in fields], fields=fields, mask=items.is_null())
            observation = pa.MapArray.from_arrays(m.offsets, keys, struct, type=m.type, mask=m.is_null() if m.null_count else None)
            columns = [observation if n == "observation" else b.column(b.schema.get_field_index(n)) for n in names]
            if shapes:
                bounds, of = m.offsets.to_pylist(), keys.to_pylist()
                columns.append(pa.array([[(of[p], was[p]) for p in range(i, j) if p in was] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.map_(pa.string(), pa.list_(pa.int32()))))
            yield pa.record_batch(columns, names=[*names, *["image_shapes"] * shapes])

    return run


def _resized(df: DataFrame, size: tuple[int, int] | None, how: str, hwc: bool, chw_out: bool, dtype: str | None, shapes: bool) -> DataFrame:
    df = df.drop("image_shapes") if shapes else df
    schema = T.StructType([*df.schema.fields, *[T.StructField("image_shapes", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))] * shapes])
    return df.mapInArrow(_resizer(size, how, hwc, chw_out, dtype, shapes, df.columns), schema)


def resize_images(size: tuple[int, int] = (256, 256), interpolation: str = "nearest") -> Transform:
    """Images of three dimensions to (height, width); interpolation: nearest or bilinear."""
    if interpolation not in _RESIZE:
        raise ValueError(f"interpolation is one of {', '.join(_RESIZE)}")
    return lambda df: _resized(df, size, interpolation, False, False, None, False)


def standardize_images(size: tuple[int, int] | None = (256, 256), channels_first: bool = False, dtype: str = "uint8", interpolation: str = "nearest", record_shapes: bool = False) -> Transform:
    """Images with channels last, resized, then with channels first if wanted, in one element type.

    record_shapes: a column image_shapes has the shapes as they were.
    """
    if interpolation not in _RESIZE:
        raise ValueError(f"interpolation is one of {', '.join(_RESIZE)}")
    return lambda df: _resized(df, size, interpolation, True, channels_first, dtype, record_shapes)


def task_texts(steps: DataFrame, default: str = "", allow_empty: bool = False, metadata: tuple[str, ...] = ("task", "instruction", "task_text", "language_instruction")) -> DataFrame:
    """episode_id, episode_index, task_text of each episode.

    The episode's own text, else the first step's language, else the first of the metadata columns that says something.
    """
    some = lambda c: F.nullif(normalize_text(c), F.lit(""))
    first = lambda c: F.min_by(c, F.col("step_index"))
    own = ["task_text"] if "task_text" in steps.columns else []
    sources = [F.col(c) for c in own] + [F.col("observation")["observation.language"]["str"]] + [F.col(c).cast("string") for c in metadata if c in steps.columns and c not in own]
    names = [f"_t{i}" for i in range(len(sources))]
    each = steps.groupBy("episode_id").agg(F.min("episode_index").alias("episode_index"), *[first(s).alias(n) for s, n in zip(sources, names, strict=True)])
    text = F.coalesce(*[some(F.col(n)) for n in names], F.lit(default))
    if not allow_empty:
        text = F.when(text == "", F.raise_error(F.concat(F.lit("no task text in episode "), F.col("episode_id")))).otherwise(text)
    return each.select("episode_id", "episode_index", text.alias("task_text"))


def task_catalog(texts: DataFrame) -> DataFrame:
    """task_id, task_text: ids dense from 0, in the order in which texts come first. A window over the distinct texts only."""
    firsts = texts.groupBy("task_text").agg(F.min("episode_index").alias("first"))
    return firsts.select((F.row_number().over(W.orderBy("first", "task_text")) - 1).cast("int").alias("task_id"), "task_text")


def with_task_ids(texts: DataFrame) -> DataFrame:
    return texts.join(task_catalog(texts), "task_text").select("episode_id", "episode_index", "task_id", "task_text")


def _repaired(dt: float) -> Callable[[Column], Column]:
    """Of lists of known times the repaired ones."""

    def one(times: np.ndarray | None) -> list[float] | None:
        if times is None:
            return None
        out: list[float] = []
        for t in times.tolist():
            out.append(t if not out or t > out[-1] else out[-1] + dt)
        return out

    @F.pandas_udf("array<double>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(one, na_action="ignore")

    return run


#: Steps up to which an episode's repair stays in the JVM; its cost there is quadratic in them.
FOLD_STEPS = 1000


def repair_timestamps(rate_hz: float = 10.0, fold_steps: int = FOLD_STEPS) -> Transform:
    """Missing ones are made of the rate; one that isn't above the repaired one before it becomes that and 1 / rate."""
    dt = 1.0 / rate_hz

    def run(df: DataFrame) -> DataFrame:
        # NaN is as good as missing
        known = F.coalesce(F.nanvl(F.col("timestamp"), F.lit(None).cast("double")), F.col("step_index") * F.lit(dt))
        lists = df.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("step_index", known.alias("t")))).alias("s"))
        empty = F.array().cast("array<double>")

        def step(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            return F.when(F.size(acc) == 0, F.array(x["t"])).otherwise(F.concat(acc, F.array(F.when(x["t"] > last, x["t"]).otherwise(last + F.lit(dt)))))

        # long episodes' times go through Python, of all others it sees a null
        long = _repaired(dt)(F.when(F.size("s") > fold_steps, F.col("s.t")))
        both = lists.withColumn("l", long).withColumn("r", F.when(F.size("s") <= fold_steps, F.aggregate("s", empty, step)).otherwise(F.col("l")))
        fixed = both.select("episode_id", F.explode(F.arrays_zip("s", "r")).alias("z")).select("episode_id", F.col("z.s.step_index").alias("step_index"), F.col("z.r").alias("_t"))
        return df.join(fixed, ["episode_id", "step_index"]).withColumn("timestamp", F.col("_t")).select(*df.columns)

    return run


def resample(rate_hz: float = 10.0, parity: bool = False) -> Transform:
    """Steps at first + j / rate, before the last time; each is the step nearest to it, the earlier one of two.

    Flags are made anew, the last step is terminal if the episode's was. Episodes that last no time stay as they are.
    parity: a time of 0 counts as step_index / 10. Each step finds the targets for which it is the nearest by its
    neighbours' times, so that nothing is joined.
    """
    dt = 1.0 / rate_hz

    def run(df: DataFrame) -> DataFrame:
        every, order = W.partitionBy("episode_id"), W.partitionBy("episode_id").orderBy("step_index")
        t = F.when(F.col("timestamp").isNull() | ((F.col("timestamp") == 0) & F.lit(parity)), F.col("step_index") * 0.1).otherwise(F.col("timestamp"))
        x = df.withColumn("_t", t).withColumns({
            "_a": F.first("_t").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "_z": F.last("_t").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "_end": F.last("is_terminal").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        })
        still = x.where(F.col("_z") <= F.col("_a")).select(*df.columns)
        moving = x.where(F.col("_z") > F.col("_a")).withColumn("_n", F.ceil((F.col("_z") - F.col("_a")) / F.lit(dt)).cast("int"))
        # by time, then place: the nearest step of a target is one of the two around it
        by_time = W.partitionBy("episode_id").orderBy("_t", "step_index")
        moving = moving.withColumns({"_before": F.lag("_t").over(by_time), "_after": F.lead("_t").over(by_time)})
        at = lambda j: F.col("_a") + j * ((F.col("_a") + F.lit(dt)) - F.col("_a"))
        # targets that may be nearest to this step, one more at either side for rounding; the exact choice follows
        low = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(((F.col("_before") + F.col("_t")) / 2 - F.col("_a")) / F.lit(dt)).cast("int") - 1))
        high = F.when(F.col("_after").isNull(), F.col("_n") - 1).otherwise(F.least(F.col("_n") - 1, F.ceil(((F.col("_after") + F.col("_t")) / 2 - F.col("_a")) / F.lit(dt)).cast("int") + 1))
        some = moving.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_j", F.explode(F.sequence("_low", "_high")))
        best = W.partitionBy("episode_id", "_j").orderBy(F.abs(F.col("_t") - at(F.col("_j"))), "step_index")
        some = some.withColumn("_k", F.row_number().over(best)).where("_k = 1")
        last = F.col("_j") == F.col("_n") - 1
        new = {"step_index": F.col("_j"), "timestamp": at(F.col("_j")), "is_first": F.col("_j") == 0, "is_last": last, "is_terminal": last & F.col("_end")}
        return some.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]).union(still)

    return run


def history(k: int, column: str = "action") -> Transform:
    """column_history: the values of the k steps before and of this one, in order."""
    w = W.partitionBy("episode_id").orderBy("step_index").rowsBetween(-k, 0)
    return lambda df: df.withColumn(f"{column}_history", F.collect_list(column).over(w))


def to_policy(image_key: str = "image", state_key: str = "state", camera: str = "canonical") -> Transform:
    """Observation columns under the names that a policy takes."""

    def run(df: DataFrame) -> DataFrame:
        return df.withColumns({image_key: F.col("observation")[IMAGES + camera], state_key: F.col("observation")["observation.state"]["num"]})

    return run


def normalize_features(stats: DataFrame, feature: str = "action", undo: bool = False) -> Transform:
    """Standardised by the statistics (feature, dim, mean, std), or back."""
    own = stats.where(F.col("feature") == feature).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))  # one row
    f = A.destandardize if undo else A.standardize

    def run(df: DataFrame) -> DataFrame:
        value = f(F.col(feature), F.transform("_s", lambda s: s["mean"]), F.transform("_s", lambda s: s["std"]))
        return df.crossJoin(F.broadcast(own)).withColumn(feature, value).drop("_s")

    return run


def episode_series(steps: DataFrame) -> DataFrame:
    """Per episode: actions (without the last step's), states, in order."""
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("step_index", v.alias("v")))), lambda s: s["v"])
    acts = F.when(~F.col("is_last"), F.col("action"))
    return steps.groupBy("episode_id").agg(F.filter(ordered(acts), lambda v: v.isNotNull()).alias("actions"), ordered(F.col("observation")["observation.state"]["num"]).alias("states"))


def empty_observation() -> Column:
    return F.create_map().cast(f"map<string,{VALUE}>")
