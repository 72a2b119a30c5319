"""Problem 1: the N best rows of every group, under one fixed order, whatever the group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, write_out

#: Groups of more than THIN x n rows have rows that a threshold can drop.
THIN = 8
HUGE = 1e300


def _cell(score: Column) -> Column:
    """Fixed cell of a score, the same in every group: 64 cells for each factor e of the distance from zero (about 1.6 %).

    It never decreases as the score grows, which is all that safety needs.
    """
    clipped = F.greatest(F.least(score, F.lit(HUGE)), F.lit(-HUGE))
    return F.floor(F.signum(clipped) * F.log1p(F.abs(clipped) * 1000) * 64).cast("int")


def _thresholds(df: DataFrame, group: str, key: str, score: str, n: int) -> DataFrame:
    """(group, cell) of the groups with more than THIN x n rows: at least ``n`` different keys lie in ``cell`` or above.

    Each histogram cell keeps, instead of a count that repeated rows would inflate, bit masks over a hash of the
    tie key: the number of set bits never exceeds the number of different keys.
    """
    words = max(1, -(-n // 16))
    heavy = write_out(df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > THIN * n).select(group), "heavy")
    slot = F.pmod(F.xxhash64(key), F.lit(64 * words))
    masks = [
        F.bit_or(F.when(F.floor(slot / 64) == w, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {64 * words}) % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}")
        for w in range(words)
    ]
    cells = df.join(bounded_broadcast(heavy), group).groupBy(group, _cell(F.col(score)).alias("_cell")).agg(*masks)
    # As many rows a group as there are cells: the cumulated masks from the highest cell downwards.
    down = Window.partitionBy(group).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    seen = sum((F.bit_count(F.bit_or(f"_m{w}").over(down)) for w in range(words)), F.lit(0))
    return cells.withColumn("_seen", seen).where(F.col("_seen") >= n).groupBy(group).agg(F.max("_cell").alias("_from"))


def top_n(df: DataFrame, group: str, key: str, score: str, n: int, tie: str) -> DataFrame:
    """The ``n`` best keys of every group as (group, key, score, tie, place).

    Order: higher score, then smaller ``tie`` (null last), then smaller key. Rows without group, key or score (null or
    NaN) take no part; an infinite score does. Rows that repeat a key count once, in their best version. Groups with
    fewer than ``n`` keys come out whole; an empty table gives no rows; other columns are ignored.

    Method: a per-group score histogram over fixed cells gives every group of more than ``THIN`` x ``n`` rows a threshold
    that leaves at least ``n`` keys; rows below it are dropped where they are read (the thresholds are broadcast up to a
    counted bound, beyond it they are joined). The rest is ranked exactly: repeated keys meet by (group, key), which no hot group
    can skew, and Spark's window group limit keeps ``n`` rows a task before the rows of a group meet.
    """
    rows = df.select(group, key, score, tie).where(
        F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    )
    rows = rows.withColumn(score, F.col(score) + F.lit(0.0))  # -0.0 and 0.0 tie
    limits = write_out(_thresholds(rows, group, key, score, n), "limits")
    kept = (
        rows.join(bounded_broadcast(limits), group, "left")
        .where(F.col("_from").isNull() | (_cell(F.col(score)) >= F.col("_from")))
        .select(group, key, score, tie)
    )
    best = kept.groupBy(group, key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie).cast("long")).alias("t"))).alias("_best"))
    best = best.select(group, key, F.col("_best.s").alias(score), (-F.col("_best.t")).cast(df.schema[tie].dataType).alias(tie))
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc_nulls_last(tie), F.asc(key))
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
