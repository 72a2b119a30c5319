"""Decisions with many options: every option counts, in groups of any size."""

import duckdb
import numpy as np
import pytest

from quern.operators import fits
from quern.plans import ORACLES, QUERIES

SIZES = {"one": 1, "two": 2, "tied": 70, "wide": 1300, "hot": 2600}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("wide")), np.random.default_rng(3)
    rows = []
    for k, n in SIZES.items():
        s = r.normal(size=n).round(1) * 2
        rows += [(k, i * 2, f"o{i}", i, None if i % 11 == 5 else float(s[i]), None, None, None, bool(i % 3 == 1)) for i in range(n)]
    rows.append(rows[-1])
    spark.createDataFrame(rows, "decision_id string, option_index int, option_key string, rank int, s_c double, p_fit double, prob double, raw_prob double, masked boolean").write.parquet(f"{d}/decision_options.parquet")
    spark.createDataFrame([(k, "t2" if k == "hot" else "t1", 0 if k == "one" else 1) for k in SIZES], "decision_id string, task_id string, answer_index int").write.parquet(f"{d}/decisions.parquet")
    return d


@pytest.mark.parametrize("name", ["softmax_array", "mask_renormalise", "argmax_confidence_margin", "explode_options", "log_odds_to_anchor"])
def test_wide_decisions_are_kept(spark, tables, name):
    assert "HAVING" not in ORACLES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW decision_options AS SELECT * FROM '{tables}/decision_options.parquet/*.parquet'")
    want = con.sql(ORACLES[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, tables).collect()]
    assert {g[0] for g in got} == set(SIZES) and len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: x[:2]), sorted(want, key=lambda x: x[:2]), strict=True):
        assert g[0] == w[0] and list(g[1:]) == pytest.approx(list(w[1:]), abs=1.1e-5)


def test_temperature_reads_wide_decisions(spark, tables):
    got = {r["task_id"]: (r["n"], r["temperature"]) for r in QUERIES["temperature_per_task"](spark, tables).collect()}
    rows = spark.read.parquet(f"{tables}/decision_options.parquet").where("s_c is not null").dropDuplicates(["decision_id", "option_index"]).orderBy("option_index").collect()
    for task, keys in (("t1", ["one", "two", "tied", "wide"]), ("t2", ["hot"])):
        lists = [np.array([r["s_c"] for r in rows if r["decision_id"] == k]) for k in keys]
        z = np.array([np.r_[x, np.full(2600 - len(x), -1e6)] for x in lists])
        label = np.array([0 if k == "one" else 1 for k in keys])
        assert got[task] == (len(keys), pytest.approx(fits.temperature(z, label, np.ones(len(keys))), abs=2e-6))


def test_temperature_by_group_equals_the_dense_fit(spark):
    r = np.random.default_rng(4)
    z, label = r.normal(size=(200, 5)), r.integers(0, 5, 200)
    label[:120] = z[:120].argmax(axis=1)
    rows = [("g", k, float(x - z[k].max()), bool(i == label[k])) for k in range(200) for i, x in enumerate(z[k])]
    df = spark.createDataFrame(rows, "g string, k int, x double, c boolean")
    [(g, n, t)] = fits.temperature_by_group(df, "g", "k", "x", "c")
    assert (g, n) == ("g", 200) and t == pytest.approx(fits.temperature(z, label, np.ones(200)), rel=1e-8)
