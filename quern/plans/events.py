"""Call logs: counts by window, latencies, sessions; the same plans as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import read
from ..streaming import calls
from .registry import query


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    got = calls.window_counts(read(spark, d, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by a stream over the file, complete at its end."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    got = calls.drain(calls.window_counts(stream), "windows", "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (json_extract_string(props, '$.k')::int > 50) AS high FROM events GROUP BY event_type""")
def call_latencies(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("high"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, g, count(*) AS n FROM o WHERE event_type = 'error' GROUP BY ALL) SELECT u.user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY u.user_id""")
def longest_error_run(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of errors of every user, by the difference of two numberings."""
    rows, bad = read(spark, d, "events"), F.col("event_type") == "error"
    a, b = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "bad").orderBy("ts", "event_id")
    runs = rows.withColumn("bad", bad).withColumn("g", F.row_number().over(a) - F.row_number().over(b))
    counts = runs.groupBy("user_id", "bad", "g").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("longest"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::bigint AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp") - F.lag(F.col("ts").cast("timestamp")).over(w)
    rows = read(spark, d, "events").withColumn("fresh", F.when(gap < F.expr("interval 6 hours"), 0).otherwise(1))
    return rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
