"""Array and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """``a`` with length one; a vector shorter than ``eps`` is divided by ``eps``."""
    return let(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Exponentials of the scores less their maximum, divided by their sum; empty and null arrays stay as they are."""
    powers = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) / temperature)))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(p: Column) -> Column:
    """Zero-based place of the first greatest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p: Column) -> Column:
    """Greatest value less the mean of the others; with one value, that value."""
    top = F.array_max(p)
    return F.when(F.size(p) > 1, top - (total(p) - top) / (F.size(p) - 1)).otherwise(top)


def margin(p: Column) -> Column:
    """Greatest value less the second one; with one value, that value."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, s[0] - s[1]).otherwise(s[0])


def masked(p: Column, keep: Column) -> Column:
    """Probabilities with masked places at zero, the rest sharing the whole; null if nothing is kept."""
    kept = F.zip_with(p, keep, lambda x, k: F.when(k, x).otherwise(F.lit(0.0)))
    return let(kept, lambda z: let(total(z), lambda t: F.when(t > 0, F.transform(z, lambda x: x / t))))


def pair_features(a: Column, b: Column) -> Column:
    """Products and absolute differences of two vectors, one after the other."""
    x = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
    y = F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double")))
    return F.concat(x, y)
