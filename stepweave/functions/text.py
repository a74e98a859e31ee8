"""Task texts in one form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded(s: pd.Series) -> pd.Series:
    """Bytes as UTF-8, U+FFFD for what isn't."""
    return s.map(lambda x: bytes(x).decode("utf-8", "replace"), na_action="ignore")


def collapsed(text: Column) -> Column:
    """White space (of all scripts) as single spaces, none at the ends; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def normalize_text(text: Column) -> Column:
    return collapsed(_nfkc(text))
