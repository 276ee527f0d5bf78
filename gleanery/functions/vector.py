"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """The equal-width bin of x in [lo, hi]: the number of inner edges at or below it, so the last bin is closed."""
    step = (hi - lo) / n
    return sum(((x >= lo + step * i).cast("int") for i in range(2, n)), (x >= lo + step).cast("int")) if n > 1 else F.lit(0)


_BUCKETS: dict[str, int] = {}


def token_bucket(token: str, dims: int) -> int:
    b = _BUCKETS.get(token)
    if b is None:
        if len(_BUCKETS) > 1_000_000:
            _BUCKETS.clear()
        b = _BUCKETS[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
    return b % dims


def _encode(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> np.ndarray:
        words = re.findall("[a-z0-9]+", (t or "").lower())
        v = np.bincount([token_bucket(w, 64) for w in words], minlength=64).astype(float) if words else np.zeros(64)
        return v / np.sqrt(v @ v) if words else v

    return text.map(one)


def hashed_embedding(text: Column) -> Column:
    """A deterministic encoder: counts of lexical tokens by the head of their MD5 in 64 buckets, as a unit vector. Stands in for a model; any text -> array<double> can take its place."""
    return F.pandas_udf(_encode, "array<double>")(text)
