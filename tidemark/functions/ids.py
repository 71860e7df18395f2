"""Deterministic ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = "\x1f"


@F.pandas_udf(StringType())
def blake2b_udf(payload: pd.Series) -> pd.Series:
    """Hex BLAKE2b of 16 bytes, first 12 digits; no built-in function has this hash."""
    return payload.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest()[:12])


def typed_id(kind: str, *parts: Column) -> Column:
    """``<kind>-<hash>`` of the trimmed parts; kinds in use: org, src, item, rev, ntc, att, cnt."""
    return F.concat(F.lit(kind + "-"), blake2b_udf(F.concat_ws(SEPARATOR, *(F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts))))


def short_sha1(n: int, *parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, n)
