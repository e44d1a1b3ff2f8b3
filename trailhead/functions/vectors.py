"""Vector functions: similarities as folds, hash embeddings as Arrow functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.transform(F.slice(v, F.lit(1), n), lambda x: x.cast("double"))
    return cut(a), cut(b)


def dot(a: Column, b: Column) -> Column:
    x, y = _both(a, b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is zero."""
    x, y = _both(a, b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def l2_score(a: Column, b: Column) -> Column:
    """One minus the Euclidean distance."""
    x, y = _both(a, b)
    return 1 - F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


METRICS = {"cosine": cosine, "l2": l2_score, "ip": dot}


def tokens_estimate(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def overlap_score(text: Column, query: str) -> Column:
    """Bytes of the text, and 100 more where it holds the query in any case."""
    base = F.octet_length(text).cast("double")
    return base + F.when(F.lower(text).contains(query.lower()) & F.lit(query != ""), 100.0).otherwise(0.0)


def rune_embedding(text: str, dim: int = 8) -> list[float]:
    """Code points, modulo 31, added up by their byte place modulo the dimension, in float32."""
    out, at = np.zeros(dim, np.float32), 0
    for c in text:
        out[at % dim] += np.float32(ord(c) % 31) / np.float32(31)
        at += len(c.encode())
    return out.tolist()


def digest_embedding(text: str, dim: int = 32) -> list[float]:
    """Successive SHA-256 blocks as signed fractions, scaled to length one."""
    block, words = hashlib.sha256(text.encode()).digest(), []
    while len(words) < dim:
        words += np.frombuffer(block, ">i4").tolist()
        block = hashlib.sha256(block).digest()
    v = (np.array(words[:dim], np.float64) / 2**31).astype(np.float32)
    norm = np.sqrt(np.sum(v.astype(np.float64) ** 2))
    return (v * np.float32(1 / norm)).tolist() if norm else v.tolist()


def embed(text: Column, kind: str = "digest", dim: int | None = None) -> Column:
    """An array<float> column of one of the two hash embeddings; null text is empty."""
    fn, size = {"digest": (digest_embedding, dim or 32), "rune": (rune_embedding, dim or 8)}[kind]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: fn(x or "", size))

    return run(text)
