"""Splits, seeds and orders that depend on ids alone, never on partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIOS: tuple[float, float, float] = (0.8, 0.1, 0.1)


def _share(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(float(0xFFFFFFFF))


def _split(share: Column, ratios: tuple[float, float, float]) -> Column:
    train, val, _ = ratios
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")


def share_md5(episode_id: Column, seed: int = 42) -> Column:
    return _share(F.md5(F.concat(F.lit(f"{seed}:"), episode_id).cast("binary")))


def share_sha256(episode_id: Column, seed: int = 42) -> Column:
    return _share(F.sha2(F.concat(F.lit(f"{seed}:"), episode_id).cast("binary"), 256))


def split_md5(episode_id: Column, seed: int = 42, ratios: tuple[float, float, float] = RATIOS) -> Column:
    """train, val or test."""
    return _split(share_md5(episode_id, seed), ratios)


def split_sha256(episode_id: Column, seed: int = 42, ratios: tuple[float, float, float] = RATIOS) -> Column:
    """As split_md5 by another hash; the two disagree on about a third of the ids."""
    return _split(share_sha256(episode_id, seed), ratios)


def derive_seed(seed: int, *parts: object) -> int:
    """A seed of 32 bits for a named part of the work."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, (seed, *parts))).encode()).digest()[:4], "big")


def derived_seed(seed: int, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed: int = 42, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(low) + share_sha256(key.cast("string"), seed) * (high - low)


def integers(key: Column, low: int, high: int, seed: int = 42) -> Column:
    """low <= x < high"""
    return F.lit(low) + F.pmod(derived_seed(seed, key), F.lit(high - low))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in an order that the seed and key decide."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256), key)


def choice(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return shuffled(df, key, seed).limit(n)


def mixture(df: DataFrame, weights: Mapping[str, float], dataset: str = "dataset_id", key: str = "episode_id", seed: int = 42) -> DataFrame:
    """A subset in which the datasets' shares of what there is are as their weights; the dataset of the largest weight stays whole."""
    if not weights or min(weights.values()) < 0 or max(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    most = max(weights.values())
    keep = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / most))])
    share = F.try_element_at(keep, F.col(dataset))
    return df.where(share_sha256(F.concat_ws(":", F.col(dataset), F.col(key)), seed) < share)
