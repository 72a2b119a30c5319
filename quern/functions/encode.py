"""A deterministic text encoder by signed hashing of character n-grams, for tests and for runs without a model."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def encode_text(text: str, dim: int = 64, sizes: tuple[int, ...] = (3, 4)) -> np.ndarray:
    """Unit vector of the signed counts of a text's n-grams; a text without any is all zero."""
    padded, v = f" {' '.join(text.lower().split())} ", np.zeros(dim)
    for n in sizes:
        for i in range(len(padded) - n + 1):
            h = int.from_bytes(blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
            v[(h >> 1) % dim] += 1 if h & 1 else -1
    length = np.linalg.norm(v)
    return (v / length if length else v).astype(np.float32)


def encode(text: Column, dim: int = 64) -> Column:
    """Vectors of texts; null gives null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else encode_text(t, dim) for t in texts])

    return run(text)


def projected(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], norms: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, residual: bool = True, smooth: bool = True) -> np.ndarray:
    """Rows of ``x`` through a small perceptron, then to length one.

    ``layers``: (weights, offset) each; a first and a last one, between them layers with an optional normalisation (scale, shift)
    and, with ``residual``, their input added. ``smooth``: x times the normal distribution's share below x, else max(x, 0).
    """

    def active(z: np.ndarray) -> np.ndarray:
        return z * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) if smooth else np.maximum(z, 0)

    (w, b), *middle, (v, c) = layers
    h = active(x @ w.T + b)
    for i, (m, o) in enumerate(middle, 1):
        z = h @ m.T + o
        if norms and i in norms:
            scale, shift = norms[i]
            z = (z - z.mean(axis=1, keepdims=True)) / np.sqrt(z.var(axis=1, keepdims=True) + 1e-5) * scale + shift
        h = h + active(z) if residual else active(z)
    out = h @ v.T + c
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def project(vec: Column, layers: list, **options) -> Column:
    """``projected`` of a column of vectors, in Arrow batches; null stays null."""

    @F.pandas_udf("array<double>")
    def run(vecs: pd.Series) -> pd.Series:
        known = vecs[vecs.notna()]
        rows = iter(projected(np.array(known.tolist(), dtype=float), layers, **options).tolist() if len(known) else [])
        return pd.Series([next(rows) if there else None for there in vecs.notna()])

    return run(vec)
