"""Validators: each is a plan from steps (and episodes, spec) to a table of findings.

A finding is (severity, code, message, location, field, value, episode_id, step_index); ord numbers the rules in the order
in which they are checked, so that 'the first finding' means something in a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stepweave.functions.actions import ACTION_TYPES, TINY
from stepweave.functions.keys import is_image
from stepweave.sources.schema import DatasetSpec

ERROR, WARN, INFO = "ERROR", "WARN", "INFO"
COLUMNS = ["severity", "code", "message", "location", "field", "value", "episode_id", "step_index", "ord"]
ORDER = {"rlds_invariants": 100, "episode_length": 200, "timestamps": 300, "action_sanity": 400, "schema": 500, "image_integrity": 600, "image_alignment": 700}
GROUPS = ({"float32", "float64"}, {"int8", "int16", "int32", "int64"}, {"uint8", "uint16", "uint32", "uint64"})


def _finding(when: Column, severity: str | Column, code: str, rule: int, message: str, step: Column | None = None, field: Column | None = None, value: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    at = (step if step is not None else F.lit(None)).cast("int")
    return F.when(when, F.struct(
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"),
        F.concat(F.lit("step "), at.cast("string")).alias("location"), text(field).alias("field"), text(value).alias("value"), at.alias("step_index"), F.lit(ORDER.get(code, 900) + rule).alias("ord"),
    ))


def _emit(df: DataFrame, *rules: Column) -> DataFrame:
    """A row for each rule that fires."""
    each = df.select("episode_id", F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return each.select(*[("episode_id" if c == "episode_id" else f"f.{c}") for c in COLUMNS])


def _rlds_rules() -> list[Column]:
    code, i = "rlds_invariants", F.col("step_index")
    first, last = i == 0, i == F.col("n") - 1
    inner = ~first & ~last
    return [
        _finding(first & ~F.col("is_first"), ERROR, code, 1, "the first step isn't marked as first", i),
        _finding(last & ~F.col("is_last"), ERROR, code, 2, "the last step isn't marked as last", i),
        _finding(last & F.col("acts"), WARN, code, 3, "the last step has an action", i),
        _finding(inner & F.col("is_first"), ERROR, code, 4, "a step inside is marked as first", i),
        _finding(inner & F.col("is_last"), ERROR, code, 5, "a step inside is marked as last", i),
        _finding(F.col("is_terminal") & ~F.col("is_last"), WARN, code, 6, "a terminal step isn't the last", i),
    ]


def _length_rules(n: Column, min_length: int, max_length: int) -> list[Column]:
    code = "episode_length"
    return [_finding(n < min_length, ERROR, code, 1, "too short", value=n), _finding(n > max_length, WARN, code, 2, "very long", value=n)]


def _time_rules(max_gap_factor: float, rate_hz: float) -> list[Column]:
    code, t, b, i = "timestamps", F.col("timestamp"), F.col("before"), F.col("step_index")
    return [_finding(t < b, ERROR, code, 1, "time goes back", i, value=t), _finding(t - b > (1.0 / rate_hz) * max_gap_factor, WARN, code, 2, "a large gap", i, value=t - b)]


def rlds(steps: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Flags and places; episodes (episode_id) of which there is no step are found if given."""
    return in_order(steps, {"rlds_invariants"}, episodes)


def length(steps: DataFrame, min_length: int = 1, max_length: int = 100_000, episodes: DataFrame | None = None) -> DataFrame:
    n = steps.groupBy("episode_id").agg(F.count("*").alias("n"))
    if episodes is not None:
        n = episodes.select("episode_id").join(n, "episode_id", "left").select("episode_id", F.coalesce("n", F.lit(0)).alias("n"))
    return _emit(n, *_length_rules(F.col("n"), min_length, max_length))


def timestamps(steps: DataFrame, max_gap_factor: float = 2.0, rate_hz: float = 10.0) -> DataFrame:
    return in_order(steps, {"timestamps"}, rate_hz=rate_hz, max_gap_factor=max_gap_factor)


def action_sanity(steps: DataFrame, bounds: tuple[float, float] = (-10.0, 10.0), sigma: float = 5.0) -> DataFrame:
    """The first step beyond the bounds, NaN or infinity anywhere, the first outlier by its episode's mean and deviation."""
    code = "action_sanity"
    acts = steps.where("action is not null").select("episode_id", "step_index", "action")
    outside = F.exists("action", lambda x: ~F.isnan(x) & ((x < bounds[0]) | (x > bounds[1])))
    endless = F.exists("action", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    each = acts.select("episode_id", F.posexplode("action").alias("d", "x")).groupBy("episode_id", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = each.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("d", "m", F.when(F.col("s") < TINY, 1.0).otherwise(F.col("s")).alias("s")))).alias("ms"))
    z = F.zip_with("action", "ms", lambda x, m: F.abs((x - m["m"]) / m["s"]))
    outlier = F.exists(z, lambda v: ~F.isnan(v) & (v > sigma))
    i = F.col("step_index")
    per = acts.join(moments, "episode_id").groupBy("episode_id").agg(F.min(F.when(outside, i)).alias("outside"), F.max(endless).alias("endless"), F.min(F.when(outlier, i)).alias("outlier"))
    return _emit(
        per,
        _finding(F.col("outside").isNotNull(), WARN, code, 1, "an action is out of bounds", F.col("outside")),
        _finding(F.col("endless"), ERROR, code, 2, "an action is NaN or infinite"),
        _finding(F.col("outlier").isNotNull(), WARN, code, 3, "an action is an outlier", F.col("outlier")),
    )


def compatible(actual: Column, expected: Column) -> Column:
    same = [actual.isin(*g) & expected.isin(*g) for g in GROUPS]
    return reduce(lambda a, b: a | b, same, actual == expected)


def schema(steps: DataFrame, spec: DataFrame, strict: bool = False, action_dtype: str = "float32") -> DataFrame:
    """The first step's observations against the spec (feature, dtype, shape), and every action's width.

    The spec has a row for each feature and is broadcast.
    """
    code, i = "schema", F.col("step_index")
    wanted = F.broadcast(spec.where("feature <> 'action'").select("feature", F.col("dtype").alias("want_dtype"), F.col("shape").alias("want_shape")))
    first = steps.where("step_index = 0").select("episode_id", "observation").crossJoin(wanted).withColumn("v", F.try_element_at("observation", F.col("feature")))
    key, there = F.col("feature"), F.map_contains_key("observation", F.col("feature"))
    is_array = F.col("v.dtype") != "string"
    observed = _emit(
        first,
        _finding(~there, ERROR, code, 1, "a required observation is missing", field=key),
        _finding(there & is_array & ~compatible(F.col("v.dtype"), F.col("want_dtype")), WARN, code, 2, "another element type", field=key, value=F.col("v.dtype")),
        _finding(there & is_array & (F.col("v.shape") != F.col("want_shape")), ERROR if strict else WARN, code, 3, "another shape", field=key, value=F.to_json("v.shape")),
    )
    action = F.broadcast(spec.where("feature = 'action'").select(F.get("shape", F.lit(0)).alias("dim"), F.col("dtype").alias("want")).limit(1))
    per = steps.where("action is not null").crossJoin(action).groupBy("episode_id").agg(
        F.min(F.when(F.size("action") != F.col("dim"), i)).alias("shape"), F.min(F.when(~compatible(F.lit(action_dtype), F.col("want")), i)).alias("dtype"))
    by_shape = F.col("shape").isNotNull() & (F.col("dtype").isNull() | (F.col("shape") <= F.col("dtype")))
    acted = _emit(
        per,
        _finding(by_shape, ERROR, code, 4, "an action has another shape", F.col("shape"), F.lit("action")),
        _finding(~by_shape & F.col("dtype").isNotNull(), WARN, code, 5, "an action has another element type", F.col("dtype"), F.lit("action")),
    )
    return observed.unionByName(acted)


def _images(steps: DataFrame) -> DataFrame:
    # where() reaches the scan's map only by its keys, so what a map holds else isn't carried on
    return steps.select("episode_id", "step_index", F.explode(F.map_filter("observation", lambda k, _: is_image(k))).alias("key", "v"))


def image_integrity(steps: DataFrame, dtype: str = "uint8") -> DataFrame:
    code, i, key = "image_integrity", F.col("step_index"), F.col("key")
    array = F.col("v.shape").isNotNull() & (F.col("v.dtype") != "string")
    rank = F.size("v.shape")
    number = F.coalesce(F.exists("v.num", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
    return _emit(
        _images(steps),
        _finding(~F.coalesce(array, F.lit(False)), ERROR, code, 1, "an image isn't an array", i, key),
        _finding(array & (F.col("v.dtype") != dtype), WARN, code, 2, "an image has another element type", i, key, F.col("v.dtype")),
        _finding(array & ~rank.isin(2, 3), ERROR, code, 3, "an image has a wrong number of dimensions", i, key, rank),
        _finding(array & rank.isin(2, 3) & F.exists("v.shape", lambda d: d == 0), ERROR, code, 4, "an image is empty", i, key),
        _finding(array & F.col("v.dtype").startswith("float") & number, ERROR, code, 5, "an image has NaN or infinity", i, key),
    )


def image_alignment(steps: DataFrame) -> DataFrame:
    """Each step's images against the first step's."""
    code, i = "image_alignment", F.col("step_index")
    shapes = F.map_from_entries(F.transform(F.map_entries(F.map_filter("observation", lambda k, _: is_image(k))), lambda e: F.struct(e["key"], e["value"]["shape"])))
    df = steps.select("episode_id", "step_index", shapes.alias("own"))
    df = df.withColumn("ref", F.max(F.when(i == 0, F.struct(F.lit(1).alias("x"), F.map_entries("own").alias("e")))).over(W.partitionBy("episode_id"))["e"])
    df = df.where(F.size("ref") > 0).withColumn("ref", F.map_from_entries("ref"))
    mine, refs = F.map_keys("own"), F.map_keys("ref")
    each = df.select("episode_id", "step_index", "own", "ref", F.explode(F.array_union(mine, refs)).alias("key"))
    key, has, had = F.col("key"), F.map_contains_key("own", F.col("key")), F.map_contains_key("ref", F.col("key"))
    other = F.try_element_at("own", key) != F.try_element_at("ref", key)
    return _emit(
        each,
        _finding(had & ~has, ERROR, code, 1, "an image is missing", i, key),
        _finding(has & ~had, WARN, code, 2, "an image is new", i, key),
        _finding(has & had & other, ERROR, code, 3, "an image has another shape than at first", i, key),
    )


def structure(steps: DataFrame) -> DataFrame:
    """Per episode: n_first, n_last, and whether they are one each, where they should be, with the same keys in every step."""
    df = steps.withColumn("_k", F.array_sort(F.map_keys("observation")))
    agg = df.groupBy("episode_id").agg(
        F.count_if("is_first").alias("n_first"), F.count_if("is_last").alias("n_last"), F.min(F.when(F.col("is_first"), F.col("step_index"))).alias("first_at"),
        (F.max(F.when(F.col("is_last"), F.col("step_index"))) - F.count("*") + 1).alias("last_at"), F.count_distinct("_k").alias("key_sets"))
    fine = (F.col("n_first") == 1) & (F.col("n_last") == 1) & (F.col("first_at") == 0) & (F.col("last_at") == 0) & (F.col("key_sets") == 1)
    return agg.select("episode_id", "n_first", "n_last", "key_sets", F.coalesce(fine, F.lit(False)).alias("consistent"))


def action_metadata(specs: DataFrame) -> DataFrame:
    """dataset_id, problem of specs (dataset_id, action_space_type, dim)."""
    dims = specs.sparkSession.createDataFrame(list(ACTION_TYPES.items()), "action_space_type string, fixed int")
    df = specs.join(F.broadcast(dims), "action_space_type", "left")
    wrong = F.array_compact(F.array(F.when(F.col("fixed").isNotNull() & (F.col("fixed") != F.col("dim")), F.lit("width differs from the type's")), F.when(F.col("dim") <= 0, F.lit("no dimensions"))))
    return df.select("dataset_id", F.explode(wrong).alias("problem"))


#: The documented rules: code and message. The first letter is the severity: E, W or I.
CODES = {
    "E001": "is_first isn't just at the first step", "E002": "is_last isn't just at the last step", "E003": "no steps", "E004": "steps have different keys", "E005": "a field's element type changes", "E006": "a field's shape changes",
    "W001": "is_terminal is missing", "W002": "the last step has an action", "W003": "the last step has a reward", "W004": "too short", "W005": "very long", "W006": "the episode is cut off", "W007": "no task text", "W008": "the task text is bytes",
    "W101": "NaN in an observation", "W102": "infinity in an observation", "W103": "NaN in an action", "W104": "infinity in an action", "W105": "an action is out of bounds", "W106": "an action is extreme",
    "W201": "time goes back", "W202": "a large gap", "I201": "times are missing", "I202": "the rate varies",
    "W301": "an image has another element type", "W302": "an image has a wrong number of channels", "W303": "an image has NaN or infinity", "I301": "an image is nearly blank", "I302": "an image has another size than declared",
    "W401": "a camera lacks frames", "W402": "a declared camera is missing", "I401": "one camera of several",
    "W501": "no dataset_id", "W502": "no robot_id", "W503": "no action space type", "W504": "no control rate",
}
_SEVERITY = {"E": ERROR, "W": WARN, "I": INFO}


@F.pandas_udf(T.DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    """Bits a byte."""

    def one(x: bytes | None) -> float | None:
        if not x:
            return None
        p = np.bincount(np.frombuffer(x, np.uint8), minlength=256) / len(x)
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    return data.map(one)


def _coded(df: DataFrame, *rules: tuple[str, Column, Column | None, Column | None]) -> DataFrame:
    """A row for each rule (code, condition, step, field) that fires."""
    none = F.lit(None)
    made = [F.when(when, F.struct(F.lit(code).alias("code"), (none if at is None else at).cast("int").alias("step_index"), (none if field is None else field).cast("string").alias("field"))) for code, when, at, field in rules]
    return df.select("episode_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("episode_id", "f.code", "f.step_index", "f.field")


def coded(steps: DataFrame, spec: DatasetSpec | None = None, episodes: DataFrame | None = None, min_length: int = 5, max_length: int = 10_000, bounds: tuple[float, float] = (-10.0, 10.0), sigma: float = 5.0, low_entropy: float = 1.0) -> DataFrame:
    """Findings of the documented rule pack: severity, code, message, episode_id, step_index (the first such step), field.

    One row for each episode, rule and field. What the spec declares (rate, cameras, shapes) is checked if it is given.
    Rules about the data set itself (W501, W503, W504) have no episode. Actions are extreme by the data set's mean and
    deviation.
    """
    hz = (spec.control_rate_hz if spec else None) or 10.0
    i, none = F.col("step_index"), F.lit(None)
    every, order = W.partitionBy("episode_id"), W.partitionBy("episode_id").orderBy("step_index")
    text = F.col("observation")["observation.language"]
    robot = F.col("robot_id") if "robot_id" in steps.columns else none.cast("string")
    own = F.col("task_text") if "task_text" in steps.columns else none.cast("string")
    some = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    odd = lambda f: F.exists("action", f)
    nan, endless = (lambda x: F.isnan(x)), (lambda x: F.abs(x) == F.lit(float("inf")))
    dims = steps.where("action is not null").select(F.posexplode("action").alias("d", "x")).where(~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = dims.agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("ms"))  # one row
    at = steps.crossJoin(F.broadcast(moments)).withColumns({"_n": F.count("*").over(every), "_b": F.lag("timestamp").over(order)})
    gap = F.col("timestamp") - F.col("_b")
    extreme = F.exists(F.zip_with("action", "ms", lambda x, m: (F.abs(x - m["m"]) > sigma * m["s"]) & (m["s"] > TINY)), lambda v: F.coalesce(v, F.lit(False)))
    last = F.col("is_last")
    flags = {
        "W001": F.col("is_terminal").isNull(), "W002": last & F.col("action").isNotNull(), "W003": last & F.col("reward").isNotNull(), "W006": last & ~F.col("is_terminal"), "W008": text["bin"].isNotNull() & text["str"].isNull(), "W103": odd(nan), "W104": odd(endless),
        "W105": odd(lambda x: ~F.isnan(x) & ((x < bounds[0]) | (x > bounds[1]))), "W106": extreme, "W201": gap < 0, "W202": gap > 2.0 / hz, "I201": F.col("timestamp").isNull(), "W502": ~some(robot),
    }
    several = lambda c: F.min(c) != F.max(c)  # noqa: E731  distinct values, without a row more for each distinct count
    wrong = lambda flag, place: (F.count_if(flag) != 1) | (F.count_if(flag & (i == place)) != 1)
    per = at.groupBy("episode_id").agg(
        F.count("*").alias("n"), wrong(F.col("is_first"), F.lit(0)).alias("E001"), wrong(F.col("is_last"), F.col("_n") - 1).alias("E002"), several(F.array_sort(F.map_keys("observation"))).alias("E004"),
        (F.max(gap - 0.0) - F.avg(gap) > 0.1 * F.avg(gap)).alias("fast"), (F.avg(gap) - F.min(gap) > 0.1 * F.avg(gap)).alias("slow"), F.max(some(own) | some(text["str"]) | text["bin"].isNotNull()).alias("told"),
        *[F.min(F.when(c, i)).alias(k) for k, c in flags.items()])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = [_coded(
        per,
        ("E001", yes("E001"), none, none), ("E002", yes("E002"), none, none), ("E004", yes("E004"), none, none), ("W004", F.col("n") < min_length, none, none), ("W005", F.col("n") > max_length, none, none), ("W007", ~yes("told"), none, none),
        ("I202", yes("fast") | yes("slow"), none, none), *[(k, F.col(k).isNotNull(), F.col(k), none) for k in flags],
    )]
    if episodes is not None:
        empty = episodes.select("episode_id").join(steps.select("episode_id").distinct(), "episode_id", "left_anti")
        parts.append(_coded(empty, ("E003", F.lit(True), none, none)))
    # fields: one row a step and key, without what they hold but for numbers
    fields = at.select("episode_id", "step_index", "_n", F.explode("observation").alias("key", "v"))
    image, bad = is_image(F.col("key")), lambda f: F.coalesce(F.exists("v.num", f), F.lit(False))
    size, declared = F.col("v.shape"), {k: list(f.shape) for k, f in (spec.image_features() if spec else {}).items() if f.shape}
    want = F.try_element_at(F.create_map(*[x for k, s in declared.items() for x in (F.lit(k), F.array(*map(F.lit, s)))]), F.col("key")) if declared else none.cast("array<int>")
    marks = {
        "W101": ~image & bad(nan), "W102": ~image & bad(endless), "W301": image & ~F.col("v.dtype").isin("uint8", "float32"), "W302": image & (F.size(size) == 3) & ~F.element_at(size, -1).isin(1, 3, 4), "W303": image & (bad(nan) | bad(endless)),
        "I301": image & F.col("v.bin").isNotNull() & (entropy(F.when(image, F.col("v.bin"))) < low_entropy), "I302": image & (size != want),
    }
    by = fields.groupBy("episode_id", "key").agg(
        F.count("*").alias("n"), F.max("_n").alias("_n"), several(F.col("v.dtype")).alias("E005"), several(F.col("v.shape")).alias("E006"), *[F.min(F.when(c, i)).alias(k) for k, c in marks.items()])
    key = F.col("key")
    parts.append(_coded(by, ("E005", F.col("E005"), none, key), ("E006", F.col("E006"), none, key), ("W401", is_image(key) & (F.col("n") != F.col("_n")), none, key), *[(k, F.col(k).isNotNull(), F.col(k), key) for k in marks]))
    if spec is not None and spec.cameras:
        names = F.array(*[F.lit("observation.images." + c) for c in spec.cameras])
        seen = at.groupBy("episode_id").agg(F.array_distinct(F.flatten(F.collect_set(F.filter(F.map_keys("observation"), is_image)))).alias("there"))
        lacking = seen.select("episode_id", F.explode(F.array_except(names, "there")).alias("key"))
        parts.append(_coded(lacking, ("W402", F.lit(True), none, key)))
        if len(spec.cameras) > 1:
            parts.append(_coded(seen, ("I401", F.size("there") == 1, none, none)))
    if spec is not None:
        about = {"W501": not spec.dataset_id, "W503": not spec.action_space_type or spec.action_space_type == "custom", "W504": not spec.control_rate_hz}
        rows = [(None, c, None, None) for c, found in about.items() if found]
        parts.append(steps.sparkSession.createDataFrame(rows, "episode_id string, code string, step_index int, field string"))
    found = reduce(DataFrame.unionByName, parts)
    pick = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("code"))
    return found.select(pick({c: _SEVERITY[c[0]] for c in CODES}).alias("severity"), "code", pick(CODES).alias("message"), "episode_id", "step_index", "field")


VALIDATORS: dict[str, Callable[..., DataFrame]] = {"rlds_invariants": rlds, "episode_length": length, "timestamps": timestamps, "action_sanity": action_sanity, "schema": schema, "image_integrity": image_integrity, "image_alignment": image_alignment}


def in_order(steps: DataFrame, names: set[str], episodes: DataFrame | None = None, rate_hz: float = 10.0, min_length: int = 1, max_length: int = 100_000, max_gap_factor: float = 2.0) -> DataFrame:
    """What rlds, length and timestamps find, of those that names has, in one pass: one shuffle and one sort of the steps."""
    every = W.partitionBy("episode_id")
    df = steps.select("episode_id", "step_index", "is_first", "is_last", "is_terminal", "timestamp", F.col("action").isNotNull().alias("acts"))
    df = df.withColumns({"n": F.count("*").over(every), "k": F.row_number().over(every.orderBy("step_index")), "before": F.lag("timestamp").over(every.orderBy("step_index"))})
    rules = []
    if "rlds_invariants" in names:
        rules += _rlds_rules()
    if "episode_length" in names:
        rules += _length_rules(F.when(F.col("k") == 1, F.col("n")), min_length, max_length)
    if "timestamps" in names:
        rules += _time_rules(max_gap_factor, rate_hz)
    found = _emit(df, *rules)
    if episodes is not None and names & {"rlds_invariants", "episode_length"}:
        empty = episodes.select("episode_id").join(steps.select("episode_id").distinct(), "episode_id", "left_anti")
        none = [_finding(F.lit(True), ERROR, "rlds_invariants", 0, "no steps")] * ("rlds_invariants" in names) + _length_rules(F.lit(0), min_length, max_length) * ("episode_length" in names)
        found = found.unionByName(_emit(empty, *none))
    return found


def validate(steps: DataFrame, episodes: DataFrame | None = None, spec: DataFrame | None = None, names: list[str] | None = None, rate_hz: float | None = None) -> DataFrame:
    """All findings of the validators named (by default all; schema only with a spec). rate_hz: the steps' rate, 10 if unknown."""
    names, parts = names or list(VALIDATORS), []
    together = {"rlds_invariants", "episode_length", "timestamps"}.intersection(names)
    if together:
        parts.append(in_order(steps, together, episodes, rate_hz or 10.0))
    for n in names:
        if n in together:
            continue
        if n == "schema":
            if spec is not None:
                parts.append(schema(steps, spec))
        else:
            parts.append(VALIDATORS[n](steps))
    return reduce(DataFrame.unionByName, parts)


def rank(severity: Column) -> Column:
    return F.when(severity == ERROR, 2).when(severity == WARN, 1).otherwise(0)


def triage(episodes: DataFrame, findings: DataFrame, mode: str = "collect") -> DataFrame:
    """episode_id, verdict (error, invalid or valid), flagged.

    mode: quarantine flags errors and warnings, collect errors only, fail_fast raises at the first error.
    """
    if mode not in ("collect", "quarantine", "fail_fast"):
        raise ValueError("mode is collect, quarantine or fail_fast")
    if mode == "fail_fast":
        fail_on(findings)
    worst = findings.groupBy("episode_id").agg(F.max(rank(F.col("severity"))).alias("worst"))
    df = episodes.select("episode_id").join(worst, "episode_id", "left")
    level = F.coalesce("worst", F.lit(0))
    verdict = F.when(level == 2, "error").when(level == 1, "invalid").otherwise("valid")
    return df.select("episode_id", verdict.alias("verdict"), (level >= (1 if mode == "quarantine" else 2)).alias("flagged"))


class ValidationFailed(ValueError):
    pass


def fail_on(findings: DataFrame, warnings: bool = False) -> None:
    """Raises at the first finding, in the order of episodes and rules."""
    bad = findings.where(F.col("severity").isin(*([ERROR, WARN] if warnings else [ERROR]))).orderBy("episode_id", "ord", "step_index").first()
    if bad is not None:
        raise ValidationFailed(f"{bad.severity} {bad.code} in {bad.episode_id}: {bad.message}")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("n"))


def summary(findings: DataFrame, first_decides: bool = False) -> DataFrame:
    """severity, code, n. first_decides: all of a code's findings count as of the severity of its first one."""
    if not first_decides:
        return findings.groupBy("severity", "code").agg(F.count("*").alias("n"))
    key = F.struct("episode_id", "ord", F.coalesce("step_index", F.lit(-1)), F.coalesce("field", F.lit("")))
    return findings.groupBy("code").agg(F.min_by("severity", key).alias("severity"), F.count("*").alias("n")).select("severity", "code", "n")


def override(findings: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Findings with other severities for some codes."""
    if not severities:
        return findings
    to = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    return findings.withColumn("severity", F.coalesce(F.try_element_at(to, F.col("code")), F.col("severity")))


def report(episodes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: episodes by verdict, findings by severity."""
    levels = {"valid": 0, "invalid": 1, "error": 2}
    kinds = {f"{s.lower()}_findings": F.count_if(F.col("severity") == s) for s in (ERROR, WARN, INFO)}
    per = findings.groupBy("episode_id").agg(F.max(rank(F.col("severity"))).alias("_worst"), *[c.alias(k) for k, c in kinds.items()])
    known = episodes.groupBy("episode_id").agg(F.count("*").alias("_n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    level = F.coalesce("_worst", F.lit(0))
    # findings are made once; those of unknown episodes count as findings
    return known.join(per, "episode_id", "full").agg(total(F.col("_n")).alias("episodes"), *[total(F.when(level == k, F.col("_n"))).alias(f"{v}_episodes") for v, k in levels.items()], *[total(F.col(k)).alias(k) for k in kinds])
