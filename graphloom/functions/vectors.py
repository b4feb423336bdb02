"""Vector functions: cosine, normalising, and an embedder that needs no model."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def hashed_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """Character 3-grams hashed to ``dim`` signed counts, of length 1 (zero for an empty text)."""
    data = f" {(text or '').lower()} ".encode()
    out = np.zeros(dim)
    if text:
        for i in range(len(data) - 2):
            h = zlib.crc32(data[i : i + 3])
            out[h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """The default embedder of a column of texts."""
    return texts.map(hashed_vector)
