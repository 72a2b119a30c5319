"""Problem 3: one surviving row for each group of records, chosen field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_code(value: Column) -> Column:
    """One spelling for the ways a term is written: ``ENVO:1``, ``envo_1``, ``ENVO: 1``, ``<https://x/ENVO_1>``.

    Null and blank are the empty code. What is no prefix with a number is compared in lower case without blanks.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s<>]+", ""))
    tail = F.regexp_replace(plain, r"^https?://.*[/#]", "")
    prefix, number = F.regexp_extract(tail, r"^([a-z]+)[:_-]?0*([0-9]+)$", 1), F.regexp_extract(tail, r"^([a-z]+)[:_-]?0*([0-9]+)$", 2)
    return F.when(number != "", F.concat_ws(":", prefix, number)).otherwise(tail)


def survivors(df: DataFrame, group: list[str], key: str, priority: list[Column], fields: list[str]) -> DataFrame:
    """One row per group of two or more different keys: ``key`` of the best row and, per field, ``<field>_from``, ``<field>``.

    ``priority``: columns, smaller is better, none null; the smallest key decides what they leave open. A field comes
    from the best row in which it isn't null or blank; ``<field>_from`` is the key of that row, null where there is none.
    Rows without a key take no part; repeated rows count once. An empty table gives no rows.

    Method: one aggregation with the extreme composite struct (missing, priorities, key, value) per field. It combines on
    the map side, so that a group with a third of all rows arrives as one row per task.
    """
    rows = df.where(F.col(key).isNotNull())
    order = [p.alias(f"p{i}") for i, p in enumerate(priority)]
    first = F.min(F.struct(*order, F.col(key).alias("key"))).alias("_first")
    best = [
        F.min(
            F.struct(
                (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").alias("missing"), *order, F.col(key).alias("key"), F.col(f).alias("value")
            )
        ).alias(f"_{f}")
        for f in fields
    ]
    one = rows.groupBy(*group).agg(first, *best, F.max(key).alias("_max"), F.min(key).alias("_min")).where(F.col("_max") != F.col("_min"))
    out = [F.when(~F.col(f"_{f}.missing"), F.col(f"_{f}.{part}")).alias(name) for f in fields for part, name in (("key", f"{f}_from"), ("value", f))]
    return one.select(*group, F.col("_first.key").alias(key), *out)
