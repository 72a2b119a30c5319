"""Operators against brute force in plain Python, and the queries' contract."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import fits, lookup, metrics, resample, select
from quern.sources import cards

CARD = """# Dataset: DP1.00001.001 / tab_one
Product: DP1.00001.001 — Soil heat. Heat of soil; daily
Source: station net
Sites: ABCD (North Moor, Lumia, domain D05 glacial zone; wet heath) and EFGH (Fen, Doria, domain D11 coast; reed marsh)
Rows: 120; months covered: 2019-01 to 2020-12
unknown line
- tempC | Soil heat | real | degC | numeric, n=3
- note | - | string | - | 2 distinct; top: SRER (9), HARV (6)
"""


def test_card_record(spark):
    df = spark.createDataFrame([(1, CARD), (2, "no header"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["parsed"] for r in cards.parse(df, "text").collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    c = got[1]
    assert (c["product_code"], c["table_name"], c["title"], c["description"], c["source"]) == ("DP1.00001.001", "tab_one", "Soil heat", "Heat of soil; daily", "station net")
    assert [(s["code"], s["domain"], s["habitat"]) for s in c["sites"]] == [("ABCD", "D05", "wet heath"), ("EFGH", "D11", "reed marsh")]
    assert (c["n_rows"], c["months_from"], c["months_to"]) == (120, "2019-01", "2020-12")
    assert [(x["name"], x["unit"]) for x in c["columns"]] == [("tempC", "degC"), ("note", "")]


def test_read_cards_refuses_files_without_header(spark, tmp_path):
    (tmp_path / "a.md").write_text(CARD)
    assert cards.read_cards(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.md").write_text("secret text")
    with pytest.raises(Exception, match="not a dataset card") as e:
        cards.read_cards(spark, str(tmp_path)).collect()
    assert "secret text" not in str(e.value)


@pytest.mark.parametrize(("unit", "term"), [("decimalDegree", "UO:0000185"), ("meanMetersPerSecond", "UO:0000094"), ("micrometer", None), ("micromolesPerSquareMeterPerSecond", None), ("celsiusSquared", None), ("nominalDay", "UO:0000033"), ("", None), (None, None), ("airCelsiusValue", "UO:0000027")])
def test_unit_terms(spark, unit, term):
    assert spark.createDataFrame([(unit,)], "u string").select(text.unit_term(F.col("u"))).first()[0] == term


def test_text_functions(spark):
    row = spark.createDataFrame([("taxonID", "top: A, B (3)", "top: SRER (9416), HARV (6068)", "x://user:pw@host/db")], "a string, b string, c string, d string")
    got = row.select(text.split_camel(F.col("a")), text.top_profile_value(F.col("b")), text.top_profile_value(F.col("c")), text.redact(F.col("d")), text.curie_prefix(F.lit("ncbitaxon:1")), text.attribute_key(F.lit("--"))).first()
    assert tuple(got) == ("taxon id", "A", "SRER", "x://***@host/db", "NCBITaxon", None)


def brute_loo(items, k):
    out = {}
    for item, grp, key, _ in items:
        train = sorted((g, i, y, q) for i, g, q, y in items if g != grp)
        table, prior = collections.Counter(), collections.Counter()
        for _, _, y, q in train:
            prior[y] += 1
            if q == key:
                table[y] += 1
        majority = prior.most_common(1)[0][0] if prior else 0
        pred = table.most_common(1)[0][0] if table else majority
        n = sum(table.values())
        probs = [(table[c] + 1) / (n + k) for c in range(k)] if table else [prior[c] / sum(prior.values()) for c in range(k)] if prior else [1 / k] * k
        top = table.most_common(2)
        out[item] = (pred, majority, tuple(round(p, 9) for p in probs), not table, len(table) > 1, len(top) > 1 and top[0][1] == top[1][1])
    return out


@pytest.mark.parametrize("groups", [1, 2, 9])
def test_leave_one_group_out(spark, groups):
    r = random.Random(groups)
    items = [(f"i{i:03d}", f"g{min(r.randrange(groups), r.randrange(groups))}", r.choice("abcd") if r.random() < 0.9 else f"k{i}", r.randrange(3)) for i in range(120)]
    df = spark.createDataFrame([*items, ("x", None, "a", 0), ("y", "g0", None, 1)], "item string, grp string, key string, label int")
    got = {x["item"]: (x["pred"], x["majority"], tuple(round(p, 9) for p in x["probs"]), x["novel"], x["conflicting"], x["tied"]) for x in lookup.leave_one_group_out(df, 3).collect()}
    assert got == brute_loo(items, 3)


def test_held_out_labels_leave_predictions_unchanged(spark):
    items = [("1", "a", "k", 0), ("2", "a", "k", 0), ("3", "b", "k", 1), ("4", "c", "k", 1)]
    turned = [(i, g, k, 1 - y if g == "a" else y) for i, g, k, y in items]
    run = lambda rows: {x["item"]: (x["pred"], tuple(x["probs"])) for x in lookup.leave_one_group_out(spark.createDataFrame(rows, "item string, grp string, key string, label int"), 2).where("grp = 'a'").collect()}
    assert run(items) == run(turned)


def scored(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([0.2, 1 / 3, 0.5, 2 / 3, 0.75, 0.9]), r.random() < 0.6) for i in range(n)]


def brute_curves(rows):
    by = collections.defaultdict(list)
    for _, c, y in rows:
        by[c].append(y)
    mean = {c: sum(v) / len(v) for c, v in by.items()}
    up = sorted(rows, key=lambda x: (x[1], x[0]))
    n, ece = len(rows), 0.0
    for part in np.array_split(np.arange(n), min(15, n)):
        ece += abs(sum(up[i][1] for i in part) - sum(mean[up[i][1]] for i in part)) / n
    down = sorted(rows, key=lambda x: (-x[1], x[0]))
    risk = 1 - np.cumsum([mean[c] for _, c, _ in down]) / np.arange(1, n + 1)
    return ece, risk


@pytest.mark.parametrize("n", [1, 7, 15, 157, 240])
def test_tie_invariant_curves(spark, n):
    rows = scored(n, n)
    df = spark.createDataFrame(rows, "id int, conf double, ok boolean")
    ece, risk = brute_curves(rows)
    assert metrics.ece(df, [], "conf", "ok").first()[0] == pytest.approx(ece, abs=1e-9)
    curve = metrics.risk_curve(df, [], "conf", "ok").orderBy("place").collect()
    assert [c["risk"] for c in curve] == pytest.approx(list(risk), abs=1e-9)
    area = metrics.curve_summary(metrics.risk_curve(df, [], "conf", "ok"), []).first()["aurc"]
    assert area == pytest.approx(sum((a + b) / 2 / n for a, b in zip(risk, risk[1:])), abs=1e-9)


def test_curves_do_not_depend_on_row_order(spark):
    rows = scored(200, 1)
    turned = [(i, c, y) for i, (_, c, y) in enumerate(reversed(rows))]
    run = lambda x: metrics.ece(spark.createDataFrame(x, "id int, conf double, ok boolean"), [], "conf", "ok").first()[0]
    assert run(rows) == pytest.approx(run(turned), abs=1e-12)


def test_auroc_by_group(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([0.1, 0.2, 0.5, r.random()]), r.random() < 0.4) for _ in range(150)] + [("only", 0.5, True), ("a", None, True), ("a", float("nan"), False)]
    got = {x["g"]: x["auroc"] for x in metrics.auroc(spark.createDataFrame(rows, "g string, s double, y boolean"), ["g"], "s", "y").collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in rows if h == g and y is w and s is not None and s == s] for w in (True, False))
        assert got[g] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    assert got["only"] is None


def test_scores_and_f1(spark):
    rows = [([0.7, 0.2, 0.1], 0, 0), ([0.1, 0.1, 0.8], 1, 2), ([0.4, 0.4, 0.2], 0, 0), ([0.0, 1.0, 0.0], 2, 1)]
    df = spark.createDataFrame(rows, "p array<double>, y int, pred int")
    got = metrics.scores(df, [], "p", "y").first()
    assert got["acc"] == 0.5 and got["nll"] == pytest.approx(-np.mean([math.log(0.7), math.log(0.1), math.log(0.4), math.log(1e-12)]))
    assert got["brier"] == pytest.approx(np.mean([0.14, 1.46, 0.56, 2.0]))
    assert metrics.macro_f1(df, [], "pred", "y").first()[0] == pytest.approx(1 / 3)


def test_binomial_bounds():
    assert resample.upper_bound(0, 30) == pytest.approx(1 - 0.05 ** (1 / 30))
    for k, n in [(1, 30), (5, 60), (29, 30), (40, 400)]:
        u = resample.upper_bound(k, n)
        assert sum(math.comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, abs=1e-9)
    assert resample.upper_bound(3, 3) == 1.0


def test_binomial_bounds_of_many_hits():
    # A sum over all hits at each step took minutes for these.
    began = time.process_time()
    for k in range(100_000, 100_100):
        u = resample.upper_bound(k, 300_000)
        assert k / 300_000 < u < 0.34
    assert time.process_time() - began < 20
    logs = [math.lgamma(300_001) - math.lgamma(i + 1) - math.lgamma(300_001 - i) + i * math.log(u) + (300_000 - i) * math.log1p(-u) for i in range(k + 1)]
    assert math.fsum(map(math.exp, logs)) == pytest.approx(0.05, abs=1e-9)
    for k, n in [(1, 1_000_000), (999_998, 1_000_000), (1, 2)]:
        u = resample.upper_bound(k, n)
        assert math.fsum(math.comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(2)) == pytest.approx(0.05, abs=1e-9) if k == 1 else u < 1


def test_bootstrap_and_sign(spark):
    rows = [(f"c{i % 6}", float(i % 7 == 0), 1 if i % 6 else -1) for i in range(120)]
    df = spark.createDataFrame(rows, "c string, v double, d int")
    got = resample.mean_ci(df, "c", F.col("v"), 300).first()
    assert got["n"] == 120 and got["lower"] <= got["point"] <= got["upper"] and got["n_valid"] == 300
    one = resample.sign_test(df, "c", F.col("d")).first()
    assert tuple(one) == (6, 5, 5, True)


def test_platt_recovers_its_curve():
    r = np.random.default_rng(0)
    s = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(1.5 * s - 0.5)))).astype(float)
    a, b = fits.platt(s, y, np.ones(4000))
    assert a == pytest.approx(1.5, abs=0.15) and b == pytest.approx(-0.5, abs=0.12)


def test_temperature_is_a_minimum():
    r = np.random.default_rng(1)
    z = r.normal(size=(500, 4)) * 3
    y = np.array([r.choice(4, p=np.exp(v / 2) / np.exp(v / 2).sum()) for v in z])
    loss = lambda t: -np.mean((z / t)[np.arange(500), y] - np.log(np.exp(z / t).sum(axis=1)))
    t = fits.temperature(z, y, np.ones(500))
    assert loss(t) <= min(loss(t * 1.01), loss(t / 1.01)) + 1e-12


@pytest.mark.parametrize(("fitter", "value"), [("ridge", 1.0), ("discriminant", 0.5)])
def test_probes_separate_classes(fitter, value):
    r = np.random.default_rng(2)
    y = r.integers(3, size=300)
    x = r.normal(size=(300, 5)) + 3 * np.eye(5)[y]
    model = getattr(fits, fitter)(x, y, np.ones(300), 3, value)
    assert ((np.column_stack([x, np.ones(300)]) @ model).argmax(axis=1) == y).mean() > 0.95


def test_selection(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 5, "z"), (None, 2, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in select.first_per_key(df, ["k"], [F.asc("o"), F.asc("v")]).collect()} == {("a", "y"), ("b", "z"), (None, "q")}
    old = spark.createDataFrame([("b", 0, "")], df.schema)
    assert {r["k"] for r in select.insert_ignore(old, df.where("k is not null"), ["k"], [F.asc("o")]).collect()} == {"a"}
    a, b = select.digest(df, ["k", "o", "v"]).first(), select.digest(df.orderBy(F.desc("v")), ["v", "k", "o"]).first()
    assert a == b and a != select.digest(df.limit(4), ["k", "o", "v"]).first()


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [True, False, True]), ([2.0], [False])], "s array<double>, keep array<boolean>")
    got = df.select(vectors.softmax(F.col("s")).alias("p"), "keep").select("p", vectors.argmax(F.col("p")).alias("a"), vectors.margin(F.col("p")).alias("m"), vectors.masked(F.col("p"), F.col("keep")).alias("z")).collect()
    e = np.exp([1, 3, 3]) / np.exp([1, 3, 3]).sum()
    assert got[0]["p"] == pytest.approx(list(e)) and got[0]["a"] == 1 and got[0]["m"] == 0
    assert got[0]["z"] == pytest.approx([e[0] / (e[0] + e[2]), 0, e[2] / (e[0] + e[2])]) and got[1]["z"] is None


def test_streams_equal_batches(spark, tmp_path):
    from quern.streaming import calls

    rows = [(i, f"2024-01-{1 + i % 9:02d} 0{i % 10}:00:00", i % 4, "error" if i % 3 else "ok", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(calls.drain(calls.window_counts(stream), "w", "complete")) == key(calls.window_counts(df))
    runs = {r["user_id"]: r["longest"] for r in calls.drain(calls.longest_runs(stream, "error"), "r", "update").collect()}
    for u, longest in runs.items():
        best = now = 0
        for r in df.where(F.col("user_id") == u).orderBy("ts", "event_id").collect():
            now = now + 1 if r["event_type"] == "error" else 0
            best = max(best, now)
        assert longest == best


def test_contract(spark):
    import __spark_entry__ as entry

    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 80
    assert entry.entry(spark).limit(1).count() == 1
