"""Snapshots and exports: sorted Parquet with a manifest written last, verified when read; JSON runs; recorded calls."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select

RUNS = "model string, card string, avus array<struct<curie:string,column:string,aspect:string,value:string,ols_label:string,resolves:boolean,obsolete:boolean,canonical:boolean>>"
HIT = "array<struct<label:string,curie:string,iri:string,description:string,isRoot:boolean,hasChildren:boolean,synonyms:array<string>>>"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Write (table, order) pairs below ``path``, range-sorted, then a manifest with row counts and content digests.

    Without its manifest an export isn't one, so a job that dies leaves nothing that could be read by mistake.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    manifest = {}
    for name, (df, order) in tables.items():
        df.orderBy(*order).write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        one = select.digest(back, df.columns).first()
        manifest[name] = {"rows": one["n_rows"] if one else 0, "digest": one["digest"] if one else "", "schema": df.schema.json()}
    rows = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export; a missing manifest, another row count or another content is an error."""
    from pyspark.sql.types import StructType

    p, fs = _path(spark, f"{path}/manifest/_SUCCESS")
    if not fs.exists(p):
        raise FileNotFoundError(f"no finished export at {path}")
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    out = {}
    for name, told in manifest.items():
        schema = StructType.fromJson(json.loads(told["schema"]))
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        one = select.digest(df, df.columns).first()
        if (one["n_rows"] if one else 0, one["digest"] if one else "") != (told["rows"], told["digest"]):
            raise ValueError(f"table {name} of {path} isn't what its manifest says")
        out[name] = df
    return out


def import_missing(existing: DataFrame, incoming: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of runs that aren't there yet; a run that exists is refused as a whole."""
    return incoming.join(existing.select(run).distinct(), run, "left_anti")


def read_runs(spark: SparkSession, path: str, without: list[str] | None = None) -> DataFrame:
    """Proposals of recorded model runs (JSON array files), one row each, valid ones only."""
    runs = spark.read.schema(RUNS).json(path, multiLine=True)
    if without:
        runs = runs.where(~F.col("model").isin(without))
    rows = runs.select("model", "card", F.posexplode("avus").alias("pos", "a")).select("model", "card", "pos", "a.*")
    return rows.where("resolves and not coalesce(obsolete, false) and canonical and curie <> ''")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Recorded search calls: (key, method, args, hits). A key is the hash of the method merged with the arguments."""
    rows = spark.read.schema(f"args map<string,string>, method string, response {HIT}").json(path, multiLine=True)
    return rows.select(call_key("method", "args").alias("key"), "method", "args", F.col("response").alias("hits"))


def call_key(method: str, args: str) -> F.Column:
    """sha256 of the compact JSON of a call, keys sorted; argument values as text."""
    pairs = F.array_sort(F.map_entries(F.map_concat(F.col(args), F.create_map(F.lit("method"), F.col(method)))))
    quoted = lambda x: F.to_json(F.array(x))
    inner = F.transform(pairs, lambda e: F.concat(F.regexp_replace(quoted(e["key"]), r"^\[|\]$", ""), F.lit(":"), F.regexp_replace(quoted(e["value"]), r"^\[|\]$", "")))
    return F.sha2(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")), 256)


def replay(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """Hits of the asked calls (key, ...) from the recordings; what isn't recorded comes out with null hits."""
    return asked.join(recorded.select("key", "hits"), "key", "left")


def read_corpus(spark: SparkSession, paths: str, statuses: list[str], refuse: str | None = None) -> DataFrame:
    """Accepted items of teacher files (JSON documents): (file, model, product, column, curie, aspect, value, status).

    Items come from two lists, accepted by the model and by people; other statuses are left out. A file of a model whose
    name begins with ``refuse`` is an error.
    """
    item = "array<struct<product:string,column:string,curie:string,aspect:string,value:string,status:string>>"
    files = spark.read.schema(f"model string, accepted {item}, human_accepted {item}").json(paths, multiLine=True).withColumn("file", F.input_file_name())
    if refuse is not None:
        bad = F.startswith(F.col("model"), F.lit(refuse))
        files = files.withColumn("model", F.when(bad, F.raise_error(F.concat(F.lit("refused model: "), F.col("model")))).otherwise(F.col("model")))
    none = F.array().cast(item)
    rows = files.select("file", "model", F.posexplode(F.concat(F.coalesce("accepted", none), F.coalesce("human_accepted", none))).alias("pos", "i"))
    return rows.select("file", "model", "pos", "i.*").where(F.col("status").isin(statuses))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested result documents (JSON) under a fixed schema; a document that doesn't fit it is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_dimension(spark: SparkSession, path: str, sha256: str, schema: str, domain: dict[str, list[str]]) -> DataFrame:
    """A small dimension table from a JSON document whose bytes have the pinned hash and whose columns stay in their domains."""
    one = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.col("content").cast("string").alias("text")).collect()
    if len(one) != 1 or one[0]["h"] != sha256:
        raise ValueError("the dimension table isn't the pinned one")
    rows = spark.createDataFrame([(one[0]["text"],)], "text string").select(F.inline(F.from_json("text", f"array<struct<{schema}>>", {"mode": "FAILFAST"})))
    for column, known in domain.items():
        if not rows.where(~F.coalesce(F.col(column).isin(known), F.lit(False))).isEmpty():
            raise ValueError(f"column {column} has values outside its domain")
    return rows


def write_half_precision(df: DataFrame, key: str, vec: str, path: str, gate: float = 0.9999) -> float:
    """Write unit vectors in half precision as (sha1 of the key, bytes), sorted; returns the least cosine to the originals.

    The archive is read back before it counts: below ``gate`` it is deleted and an error is raised.
    """
    spark = df.sparkSession
    pack = F.pandas_udf(lambda s: s.map(_half), "binary")
    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.sha1(key).alias("sha1"), F.col(vec).alias("vec")).dropDuplicates(["sha1"])
    rows.select("sha1", pack("vec").alias("f16")).orderBy("sha1").write.mode("overwrite").parquet(path)
    cosine = F.pandas_udf(_cosines, "double")
    back = rows.join(spark.read.parquet(path), "sha1", "left").agg(F.min(F.coalesce(cosine("vec", "f16"), F.lit(-1.0)))).first()[0]
    if back is not None and back < gate:
        p, fs = _path(spark, path)
        fs.delete(p, True)
        raise ValueError(f"half precision loses too much: {back}")
    return 1.0 if back is None else back


def _half(v) -> bytes:
    x = np.asarray(v, dtype=float)
    return (x / max(float(np.linalg.norm(x)), 1e-12)).astype("<f2").tobytes()


def _cosines(vec: pd.Series, f16: pd.Series) -> pd.Series:
    out = []
    for v, b in zip(vec, f16):
        x, y = np.asarray(v, dtype=float), np.frombuffer(b or b"", dtype="<f2").astype(float)
        out.append(float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)) if len(x) == len(y) else -1.0)
    return pd.Series(out)


def commit_run(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """All rows of a run or none: each table is staged, parents first, and one rename makes the run visible.

    A run that exists is refused. Readers see what lies below ``path/run=<id>`` only.
    """
    spark = next(iter(tables.values())).sparkSession
    target, fs = _path(spark, f"{path}/run={run}")
    if fs.exists(target):
        raise FileExistsError(f"run {run} is there")
    stage, _ = _path(spark, f"{path}/_stage-{run}")
    fs.delete(stage, True)
    for name, df in tables.items():
        df.write.parquet(f"{path}/_stage-{run}/{name}")
    if not fs.rename(stage, target):
        raise OSError(f"run {run} couldn't be committed")
