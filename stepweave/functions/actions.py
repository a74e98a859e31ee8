"""Expressions over action vectors (arrays of doubles); null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of the named action spaces; a space that isn't there has DEFAULT_DIM.
DIMS = {"ee_delta_7": 7, "ee_abs_7": 7, "joint_7": 7, "joint_6": 6, "joint_7_gripper": 8}
DEFAULT_DIM = 7
#: All action types, and the width that a type fixes.
ACTION_TYPES: dict[str, int | None] = dict.fromkeys(("ee_delta_7", "ee_abs_7", "ee_velocity_7"), 7) | dict.fromkeys(("joint_delta", "joint_abs", "joint_velocity", "custom"))
TINY = 1e-8


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """NaN stays NaN, which least and greatest alone would not do."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def as_float32(action: Column) -> Column:
    return F.transform(action, lambda x: x.cast("float").cast("double"))


def pad(action: Column, dim: int = 7, value: float = 0.0) -> Column:
    """Filled up with value, or cut, to dim."""
    return F.slice(F.concat(action, F.array_repeat(F.lit(float(value)), dim)), 1, dim)


def map_space(action: Column, target: str = "ee_delta_7", gripper_index: int = -1) -> Column:
    """As many dimensions as fit, zeros after them; into ee_delta_7 a longer action's gripper goes to the last place."""
    dim = DIMS.get(target, DEFAULT_DIM)
    mapped = pad(action, dim)
    if target != "ee_delta_7":
        return mapped
    at = gripper_index + 1 if gripper_index >= 0 else gripper_index
    return F.when(F.size(action) > dim, F.concat(F.slice(action, 1, 6), F.array(F.element_at(action, at)))).otherwise(mapped)


def to_unit(action: Column, low: Column | float, high: Column | float, clipped: bool = True) -> Column:
    """From [low, high] to [-1, 1]; low and high are numbers or arrays of the action's width."""
    if isinstance(low, Column):
        bounds = F.arrays_zip(action.alias("x"), low.alias("lo"), high.alias("hi"))
        scaled = F.transform(bounds, lambda z: F.lit(2.0) * (z["x"] - z["lo"]) / (z["hi"] - z["lo"]) - 1.0)
    else:
        scaled = F.transform(action, lambda x: F.lit(2.0) * (x - F.lit(float(low))) / F.lit(float(high) - float(low)) - 1.0)
    return F.transform(scaled, lambda x: clip(x, -1.0, 1.0)) if clipped else scaled


def standardize(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a tiny std counts as 1."""
    z = F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s"))
    return F.transform(z, lambda v: (v["x"] - v["m"]) / F.when(v["s"] > TINY, v["s"]).otherwise(1.0))


def destandardize(z: Column, mean: Column, std: Column) -> Column:
    v = F.arrays_zip(z.alias("z"), mean.alias("m"), std.alias("s"))
    return F.transform(v, lambda x: x["z"] * x["s"] + x["m"])


def to_env(action: Column, dim: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Clipped, then zero-padded or cut to what an environment takes."""
    return pad(F.transform(action, lambda x: clip(x, low, high)), dim)
