"""Cluster bootstrap, sign tests and exact binomial bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..runtime import write_out


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``n``: the place of each row in the order of the columns, from zero; the columns must tell rows apart.

    Rows are sorted in ranges and numbered within each; only the ranges' sizes, one row a task, are summed in one place.
    """
    rows = write_out(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    rows = rows.select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(2**33 - 1).alias("_i")).drop("_m")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").agg(F.count("*").alias("k")).select("_p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "_p").withColumn("n", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def places(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from one, in ``order``) and ``rows`` of its group ``by``; a group of any size is spread over the ranges."""
    rows = numbered(df, *by, *order)
    ends = rows.groupBy(*by).agg(F.min("n").alias("_first"), F.count("*").alias("rows"))
    return rows.join(ends, by).withColumn("place", F.col("n") - F.col("_first") + 1).drop("n", "_first")


def bootstrap_weights(clusters: DataFrame, draws: int) -> DataFrame:
    """(b, cluster, w): how often each cluster is drawn in ``draws`` resamples with replacement.

    Draw j of resample b is cluster ``hash(b, j) mod m`` in the order of the names: deterministic, made in parallel and
    without a driver-side generator. ``clusters``: (cluster), distinct.
    """
    numbered_ = numbered(clusters.select("cluster"), "cluster").withColumnRenamed("n", "i")
    m = clusters.agg(F.count("*").alias("m"))
    spark = clusters.sparkSession
    drawn = spark.range(draws).withColumnRenamed("id", "b").crossJoin(F.broadcast(m)).select("b", "m", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("j"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b"), F.col("j"))), 1, 12), 16, 10).cast("long")
    picks = drawn.select("b", F.pmod(hashed, F.col("m")).alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))
    return picks.join(numbered_, "i").select("b", "cluster", "w")


def mean_ci(df: DataFrame, cluster: str, value: Column, draws: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Mean of ``value`` with cluster bootstrap bounds (n, point, lower, upper, n_valid); resamples use sums per cluster."""
    return ratio_ci(df, cluster, value, F.when(value.isNotNull(), 1).otherwise(0), draws, alpha)


def ratio_ci(df: DataFrame, cluster: str, above: Column, below: Column, draws: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Pooled ratio of two sums with cluster bootstrap bounds (n, point, lower, upper, n_valid); ``n`` is the sum below."""
    sums = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(above).alias("s"), F.sum(below).alias("n"))
    sums = write_out(sums, "sums")
    w = bootstrap_weights(sums.select("cluster"), draws)
    per = w.join(sums, "cluster").groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("v"))
    bounds = per.agg(F.percentile("v", F.lit(alpha)).alias("lower"), F.percentile("v", F.lit(1 - alpha)).alias("upper"), F.count("v").alias("n_valid"))
    point = sums.agg(F.sum("n").alias("n"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("point"))
    return point.crossJoin(F.broadcast(bounds))


def sign_test(df: DataFrame, cluster: str, better: Column, min_items: int = 10, fraction: float = 0.8, min_clusters: int = 4) -> DataFrame:
    """Do enough clusters of ``min_items`` rows gain? (clusters, wins, needed, passed); ``better`` is a row's gain."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(better).alias("d")).where(F.col("n") >= min_items)
    need = F.ceil(F.col("clusters") * fraction)
    one = per.agg(F.count("*").alias("clusters"), F.count_if(F.col("d") > 0).alias("wins"))
    return one.select("clusters", "wins", need.alias("needed"), ((F.col("clusters") >= min_clusters) & (F.col("wins") >= need)).alias("passed"))


def _terms(p: float, k: int, n: int) -> float:
    """Chance of at most ``k`` hits in ``n`` trials of chance ``p`` above k / n, over the chance of just ``k``.

    Downwards from ``k`` each term is a smaller share of the one above it: some sqrt(n) terms add to a double, whatever ``k``.
    """
    total, last, i = 1.0, 1.0, k
    while i > 0 and last > 1e-18 * total:
        j = np.arange(i, max(i - 1024, 0), -1, dtype=float)
        terms = last * np.cumprod(j / (n - j + 1) * ((1 - p) / p))
        total, last, i = total + float(terms.sum()), float(terms[-1]), i - len(j)
    return total


def upper_bound(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound of a chance after ``k`` hits in ``n`` trials: the root of the binomial tail's logarithm.

    It is concave, so that Newton's steps close in from above; one that leaves the bounds known so far is a bisection.
    """
    if n <= 0 or k >= n:
        return 1.0
    if k <= 0:
        return 1 - alpha ** (1 / n)
    ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - math.log(alpha)
    low, high, p = k / n, 1.0, (k + 1) / (n + 1)
    for _ in range(200):
        total = _terms(p, k, n)
        over = ways + k * math.log(p) + (n - k) * math.log1p(-p) + math.log(total)
        low, high = (p, high) if over > 0 else (low, p)
        step = over * total * (1 - p) / (n - k)
        if abs(step) <= 1e-11 * p:
            return p + step
        p = p + step if low < p + step < high else (low + high) / 2
    return p


def binomial_upper(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """``upper_bound`` of two columns. Apply it to distinct pairs: they are few, rows are many."""

    @F.pandas_udf(DoubleType())
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_bound(int(a), int(b), alpha) for a, b in zip(k, n)], dtype=float)

    return bound(k, n)
