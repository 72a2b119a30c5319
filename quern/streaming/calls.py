"""Streams of call events: windowed counts with late data, failures in a row. An extension: batch plans need none of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import select
from ..runtime import shared_dir


def window_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events and mean value per window and type; works on batches and streams, where ``late`` bounds the state."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("at", late) if events.isStreaming else stamped
    return stamped.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def longest_runs(events: DataFrame, kind: str) -> DataFrame:
    """Longest run of consecutive events of ``kind`` for each user, by time and id, with state kept per user.

    On a stream the state is (current, longest); a batch is one group of rows per user, read in order.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, best = state.get if state.exists else (0, 0)
        for f in sorted(frames, key=lambda f: f["ts"].min()):
            for hit in f.sort_values(["ts", "event_id"])["event_type"] == kind:
                now = now + 1 if hit else 0
                best = max(best, now)
        state.update((now, best))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [best]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, longest long", "now long, best long", "update", "NoTimeout")


def drain(stream: DataFrame, label: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there, into a table below the shared folder, and read it back.

    Of a complete result the last batch counts, of an updated one the last row of each of ``keys`` (by default the first column).
    """
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        batches: list[int] = []

        def keep(df: DataFrame, batch: int) -> None:
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/out/{batch:06d}")
            batches.append(batch)

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode != "append" and not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    kept = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(*[f"{path}/out/{b:06d}" for b in sorted(set(batches))])
    if mode == "complete":
        return kept.where(F.col("_batch") == max(batches)).drop("_batch")
    return select.first_per_key(kept, keys or stream.columns[:1], [F.desc("_batch")]).drop("_batch")
