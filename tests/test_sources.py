"""Sources and sinks: teacher files, pinned dimensions, half precision, runs committed as a whole, streams in several batches."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import encode
from quern.sources import cards, tables
from quern.streaming import calls


def test_corpus_files(spark, tmp_path):
    item = {"product": "DP1", "column": "a", "curie": "X:1", "aspect": "unit", "value": "v", "status": "ok"}
    (tmp_path / "b.json").write_text(json.dumps({"model": "m1", "accepted": [item, item | {"status": "no"}], "human_accepted": [item | {"curie": "X:2"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"model": "m2", "accepted": None}))
    got = tables.read_corpus(spark, f"{tmp_path}/*.json", ["ok"]).collect()
    assert sorted((r["model"], r["pos"], r["curie"]) for r in got) == [("m1", 0, "X:1"), ("m1", 2, "X:2")]
    assert tables.read_corpus(spark, f"{tmp_path}/*.json", ["ok"], refuse="other").count() == 2
    with pytest.raises(Exception, match="refused model"):
        tables.read_corpus(spark, f"{tmp_path}/*.json", ["ok"], refuse="m1").collect()


def test_cards_by_product(spark, tmp_path):
    for n in ("DP1.00001.001.x", "DP1.00001.001.y", "own"):
        (tmp_path / f"{n}.md").write_text("# text")
    assert {r["product"]: r["cards"] for r in cards.cards_by_product(spark, str(tmp_path)).collect()} == {"DP1.00001.001": ["DP1.00001.001.x", "DP1.00001.001.y"], "own": ["own"]}


def test_dimension_is_pinned_and_in_its_domain(spark, tmp_path):
    text = json.dumps([{"k": "a", "v": 1}, {"k": "b", "v": 2}])
    (tmp_path / "d.json").write_text(text)
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert tables.read_dimension(spark, f"{tmp_path}/d.json", sha, "k:string,v:int", {"k": ["a", "b"]}).count() == 2
    with pytest.raises(ValueError, match="pinned"):
        tables.read_dimension(spark, f"{tmp_path}/d.json", "0" * 64, "k:string,v:int", {})
    with pytest.raises(ValueError, match="domain"):
        tables.read_dimension(spark, f"{tmp_path}/d.json", sha, "k:string,v:int", {"k": ["a"]})


def test_results_must_fit_their_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"task": "t", "cells": [{"n": 3}]}')
    assert tables.read_results(spark, f"{tmp_path}/r.json", "task string, cells array<struct<n:int>>").first()["cells"][0]["n"] == 3
    with pytest.raises(Exception, match="(?i)malformed|parse|cannot"):
        tables.read_results(spark, f"{tmp_path}/r.json", "task int, cells array<struct<n:int>>").collect()


def test_half_precision_archive(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"t{i}", [float(x) for x in r.normal(size=32)]) for i in range(40)] + [("t0", [1.0] * 32), (None, [1.0])], "k string, v array<float>")
    assert 0.9999 < tables.write_half_precision(rows.where("k <> 't0' or v[0] <> 1.0"), "k", "v", f"{tmp_path}/a") <= 1.0 + 1e-9
    back = spark.read.parquet(f"{tmp_path}/a")
    assert back.count() == 40 and {len(x["f16"]) for x in back.collect()} == {64}
    with pytest.raises(ValueError, match="loses"):
        tables.write_half_precision(rows, "k", "v", f"{tmp_path}/b", gate=1.1)
    assert not (tmp_path / "b").exists()


def test_runs_are_committed_once_and_whole(spark, tmp_path):
    df = spark.range(3)
    tables.commit_run({"parents": df, "children": df}, str(tmp_path), "r1")
    assert spark.read.parquet(f"{tmp_path}/run=r1/children").count() == 3
    with pytest.raises(FileExistsError):
        tables.commit_run({"parents": df}, str(tmp_path), "r1")
    bad = df.withColumn("x", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="lost"):
        tables.commit_run({"parents": df, "children": bad}, str(tmp_path), "r2")
    assert not (tmp_path / "run=r2").exists()


def test_streams_of_several_batches_count_once(spark, tmp_path):
    rows = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"
    for i in range(2):
        day = spark.sql(f"select id + {i * 10} as event_id, id % 2 as user_id, 'error' as event_type, 1.0D as value, timestamp_ntz'2024-01-01 0{i}:00:00' as ts from range(10)")
        day.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = calls.drain(calls.window_counts(stream), "w", "complete").collect()
    assert [(r["n"], r["total"]) for r in got] == [(20, 20.0)]
    runs = calls.drain(calls.longest_runs(stream, "error"), "r", "update").collect()
    assert sorted((r["user_id"], r["longest"]) for r in runs) == [(0, 10), (1, 10)]


def test_projection(spark):
    r = np.random.default_rng(2)
    layers = [(r.normal(size=(6, 4)), r.normal(size=6)), (r.normal(size=(6, 6)), r.normal(size=6)), (r.normal(size=(3, 6)), r.normal(size=3))]
    x = r.normal(size=(5, 4))
    df = spark.createDataFrame([([float(v) for v in row],) for row in x] + [(None,)], "v array<double>")
    got = [r_[0] for r_ in df.select(encode.project(F.col("v"), layers, norms={1: (np.ones(6), np.zeros(6))})).collect()]
    want = encode.projected(x, layers, norms={1: (np.ones(6), np.zeros(6))})
    assert got[-1] is None and np.allclose(np.array(got[:-1]), want) and np.allclose(np.linalg.norm(want, axis=1), 1)
    flat = encode.projected(x, [layers[0], layers[2]], residual=False, smooth=False)
    hidden = np.maximum(x @ layers[0][0].T + layers[0][1], 0) @ layers[2][0].T + layers[2][1]
    assert np.allclose(flat, hidden / np.linalg.norm(hidden, axis=1, keepdims=True))
