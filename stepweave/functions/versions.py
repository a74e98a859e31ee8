"""Schema versions, and names of element types."""

from __future__ import annotations

import re
from typing import NamedTuple

CURRENT = "1.0.0"
class Version(NamedTuple):
    major: int
    minor: int
    patch: int


def parse(version: str) -> Version:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version.strip())
    if not m:
        raise ValueError(f"not a version: {version!r}")
    return Version(*map(int, m.groups()))


def compare(a: str, b: str) -> int:
    return (parse(a) > parse(b)) - (parse(a) < parse(b))


def can_read(dataset: str, reader: str = CURRENT) -> bool:
    """Equal majors, and the dataset's minor isn't newer."""
    d, r = parse(dataset), parse(reader)
    return d.major == r.major and d.minor <= r.minor


def check(dataset: str, reader: str = CURRENT) -> None:
    if not can_read(dataset, reader):
        raise ValueError(f"a reader of version {reader} can't read version {dataset}")


def normalize_dtype(dtype: object) -> str:
    """The name of an element type; a name is itself."""
    return dtype if isinstance(dtype, str) else getattr(dtype, "name", None) or str(dtype)
