"""Deduplication and selection: one row per key under a total order, counters of what was dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key under ``order``, which must end in a unique column.

    The row limit of one is pushed below the exchange, so that a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of every key, numbered from one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key, if the key isn't in ``existing``."""
    return first_per_key(new, keys, order).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def collapse_report(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """Per key: rows collapsed into the first one, and how many of them carry another label."""
    first = F.min_by(label, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("first_label")
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), first)
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("k"))
    joined = counts.join(per, list(keys))
    other = F.sum(F.when(~F.col(label).eqNullSafe(F.col("first_label")), F.col("k")).otherwise(0))
    return joined.groupBy(*keys).agg((F.first("n") - 1).alias("collapsed"), other.alias("conflicting"))


def digest(df: DataFrame, columns: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """An order-free content digest: rows are hashed, hashes are summed in 256 places of four hex digits.

    Equal multisets of rows have equal digests; it combines on the map side and never gathers the rows.
    """
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"_s{i}") for i in range(8)]
    summed = df.select(*per, row.alias("_h")).groupBy(*per).agg(F.count("*").alias("n_rows"), *parts)
    joined = F.concat_ws(",", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(8)])
    return summed.select(*per, "n_rows", F.sha2(joined, 256).alias("digest"))
