"""Exports, pivots, request expansion, context scores and resampled curves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, vectors
from ..operators import metrics, resample, select
from ..runtime import read, shared_dir, write_out
from ..sources import tables
from .evaluation import ITEMS, PRED, items, predictions
from .registry import query
from .store import DEC, OPT, decisions, options


@query(f"WITH d AS ({DEC}) SELECT decision_id, run_id, seq, task_id, outcome FROM d")
def export_import_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Decisions written as a sorted export with a manifest, verified and read back."""
    import uuid

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    rows = decisions(spark, d).select("decision_id", "run_id", "seq", "task_id", "outcome")
    tables.write_export({"decisions": (rows, ["run_id", "seq", "decision_id"])}, path)
    return tables.read_export(spark, path)["decisions"]


@query(f"WITH d AS ({DEC}) SELECT run_id, count(*) AS n FROM d WHERE run_id NOT IN (SELECT run_id FROM d WHERE ts < TIMESTAMP '2024-02-01') GROUP BY run_id")
def import_refuses_known_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = decisions(spark, d)
    known = rows.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))
    return tables.import_missing(known, rows).groupBy("run_id").agg(F.count("*").alias("n"))


@query("""PIVOT (SELECT DISTINCT label_id, task_id, label_source FROM labels) ON label_source IN ('curator', 'gold', 'teacher') USING count(label_id) GROUP BY task_id""")
def pivot_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").select("label_id", "task_id", "label_source").distinct()
    got = rows.groupBy("task_id").pivot("label_source", ["curator", "gold", "teacher"]).agg(F.count("label_id"))
    return got.na.fill(0)


@query(f"""WITH {ITEMS}, q AS (SELECT task, split_part(item, '|', 1) AS target, item FROM items),
r AS (SELECT task, target, 'context' AS role, target AS text FROM q GROUP BY ALL UNION ALL SELECT task, target, 'anchor', '__none__' FROM q GROUP BY ALL UNION ALL SELECT task, target, 'candidate', item FROM q)
SELECT task, role, count(*) AS n, count(DISTINCT text) AS texts FROM r GROUP BY ALL""")
def request_expansion(spark: SparkSession, d: str) -> DataFrame:
    """One context and one anchor per target, one candidate per item; rows and different texts by role."""
    rows = items(spark, d).select("task", F.split_part("item", F.lit("|"), F.lit(1)).alias("target"), "item")
    once = rows.select("task", "target").distinct()
    pair = once.select("task", F.explode(F.array(F.struct(F.lit("context").alias("role"), F.col("target").alias("text")), F.struct(F.lit("anchor").alias("role"), F.lit("__none__").alias("text")))).alias("r"))
    every = pair.select("task", "r.role", "r.text").union(rows.select("task", F.lit("candidate"), "item"))
    return every.groupBy("task", "role").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@query(f"""WITH {ITEMS}, t AS (SELECT task, split_part(item, '|', 1) AS target, length(key) AS cost FROM items), p AS (SELECT task, target, 10 + sum(cost) AS tokens FROM t GROUP BY ALL)
SELECT task, count(*) AS targets, round(avg(tokens), 6) AS tokens FROM p GROUP BY task""")
def tokens_per_target(spark: SparkSession, d: str) -> DataFrame:
    """Mean cost of a target: its context and anchor once, its candidates summed."""
    rows = items(spark, d).select("task", F.split_part("item", F.lit("|"), F.lit(1)).alias("target"), F.length("key").alias("cost"))
    per = rows.groupBy("task", "target").agg((F.lit(10) + F.sum("cost")).alias("tokens"))
    return per.groupBy("task").agg(F.count("*").alias("targets"), F.round(F.avg("tokens"), 6).alias("tokens"))


@query(f"""WITH {ITEMS}, i AS (SELECT * FROM items WHERE task = 'term.fits'), f AS (SELECT DISTINCT card AS held FROM i), c AS (SELECT held, label, count(*) AS n, min(card || item) AS first FROM i JOIN f ON card <> held GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY n DESC, label) AS place FROM c) SELECT held AS card, label, n, place FROM r WHERE place <= 2""")
def label_ranks_without_own_card(spark: SparkSession, d: str) -> DataFrame:
    """The two most frequent labels over all other cards, by subtraction."""
    own = items(spark, d, ["term.fits"]).groupBy("card", "label").agg(F.count("*").alias("n"))
    total = own.groupBy("label").agg(F.sum("n").alias("all"))
    pairs = own.select("card").distinct().crossJoin(F.broadcast(total)).join(own, ["card", "label"], "left")
    rest = pairs.withColumn("n", F.col("all") - F.coalesce("n", F.lit(0))).where("n > 0").select("card", "label", "n")
    return select.top_per_key(rest, ["card"], [F.desc("n"), F.asc("label")], 2)


@query(f"""WITH {ITEMS} SELECT task, card, count(*) FILTER (label = 0) AS positives, count(*) FILTER (label <> 0) AS negatives, count(*) FILTER (label = 0) >= 2 AND count(*) FILTER (label <> 0) >= 2 AS counts FROM items GROUP BY ALL""")
def cards_that_count(spark: SparkSession, d: str) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 0), F.count_if(F.col("label") != 0)
    return items(spark, d).groupBy("task", "card").agg(pos.alias("positives"), neg.alias("negatives"), ((pos >= 2) & (neg >= 2)).alias("counts"))


@query("""SELECT label_source, weight, CASE WHEN abs(weight - c) < 1e-6 THEN c ELSE round(weight, 6) END AS snapped, count(*) AS n FROM (SELECT DISTINCT label_id, label_source, weight FROM labels) JOIN
(VALUES ('curator', 1.0::double), ('curator_implicit', 0.7), ('consensus_all', 0.8), ('consensus_majority', 0.6), ('consensus_negative', 0.5), ('teacher', 0.5), ('teacher_implicit', 0.3), ('gold', 1.0), ('agent_pick', 0.0)) w(label_source, c) USING (label_source) GROUP BY ALL""")
def snapped_weights(spark: SparkSession, d: str) -> DataFrame:
    """Recorded weights moved to their source's constant where they differ by rounding only."""
    # The weight of a label by its source.
    known = {"curator": 1.0, "curator_implicit": 0.7, "consensus_all": 0.8, "consensus_majority": 0.6, "consensus_negative": 0.5, "teacher": 0.5, "teacher_implicit": 0.3, "gold": 1.0, "agent_pick": 0.0}
    table = spark.createDataFrame(list(known.items()), "label_source string, c double")
    rows = read(spark, d, "labels").select("label_id", "label_source", "weight").distinct().join(F.broadcast(table), "label_source")
    snapped = F.when(F.abs(F.col("weight") - F.col("c")) < 1e-6, F.col("c")).otherwise(F.round("weight", 6))
    return rows.groupBy("label_source", "weight", snapped.alias("snapped")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, vec_id % 40 AS card, list_transform(embedding, lambda x: x::double) AS v FROM embeddings)
SELECT a.vec_id, count(*) AS contexts, round(avg(list_dot_product(a.v, b.v)), 4) AS score FROM e a JOIN e b USING (card) GROUP BY a.vec_id""")
def context_scores_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of a vector under all contexts of its card: the sum of the contexts stands for them, no pair is formed."""
    rows = read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("card"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sums = rows.select("card", F.posexplode("v").alias("place", "x")).groupBy("card", "place").agg(F.sum("x").alias("s"), F.count("*").alias("contexts"))
    listed = sums.groupBy("card").agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("l"), F.max("contexts").alias("contexts")).select("card", "contexts", F.col("l.s").alias("s"))
    return rows.join(listed, "card").select("vec_id", "contexts", F.round(vectors.dot(F.col("v"), F.col("s")) / F.col("contexts"), 4).alias("score"))


@query(f"""{PRED}, w0 AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM scored GROUP BY grp), m AS (SELECT count(*) AS m FROM w0),
dr AS (SELECT b, ('0x' || substr(md5(b::varchar || ':' || j::varchar), 1, 12))::bigint % m AS i FROM m, range(20) x(b), range((SELECT m FROM m)) y(j)), w AS (SELECT b, grp, count(*) AS w FROM dr JOIN w0 USING (i) GROUP BY ALL),
s AS (SELECT b, py, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS p, sum(CASE WHEN label <> 0 THEN w ELSE 0 END) AS n FROM scored JOIN w USING (grp) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b ORDER BY py ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT b, round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 6) AS auroc FROM c GROUP BY b""")
def weighted_auroc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """AUROC of each cluster resample from weighted sums per distinct score."""
    rows = predictions(spark, d).groupBy(F.col("grp").alias("cluster"), "p_yes", "label").agg(F.count("*").alias("k"))
    w = resample.bootstrap_weights(rows.select("cluster").distinct(), 20)
    weighted = rows.join(w, "cluster").withColumn("m", F.col("k") * F.col("w"))
    ties = metrics.tie_groups(weighted, ["b"], "p_yes", False, p=F.when(F.col("label") == 0, F.col("m")).otherwise(0), n=F.when(F.col("label") != 0, F.col("m")).otherwise(0))
    wins = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return ties.groupBy("b").agg(F.round(wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 6).alias("auroc"))


@query(f"""WITH o AS ({OPT}), p AS (SELECT decision_id, p_fit FROM o WHERE option_index = 0 AND p_fit IS NOT NULL AND NOT isnan(p_fit)),
c AS (SELECT decision_id, option_index, o.p_fit, row_number() OVER (PARTITION BY decision_id ORDER BY o.p_fit DESC, option_index) AS r FROM o JOIN p USING (decision_id) WHERE option_index BETWEEN 1 AND 10 AND NOT coalesce(masked, FALSE) AND o.p_fit IS NOT NULL AND NOT isnan(o.p_fit))
SELECT decision_id, option_index, round(c.p_fit, 9) AS p_fit FROM c JOIN p USING (decision_id) WHERE r = 1 AND c.p_fit >= p.p_fit + 0.1 - 1e-12""")
def best_child_above_parent(spark: SparkSession, d: str) -> DataFrame:
    """The best of the first ten further options, where it is clearly better than the first one."""
    rows = options(spark, d).where("p_fit is not null and not isnan(p_fit)")
    parent = rows.where("option_index = 0").select("decision_id", F.col("p_fit").alias("parent"))
    child = rows.where("option_index between 1 and 10 and not coalesce(masked, false)")
    best = select.first_per_key(child.select("decision_id", "option_index", "p_fit"), ["decision_id"], [F.desc("p_fit"), F.asc("option_index")])
    return best.join(parent, "decision_id").where(F.col("p_fit") >= F.col("parent") + 0.1 - 1e-12).select("decision_id", "option_index", F.round("p_fit", 9).alias("p_fit"))


@query(f"""WITH {ITEMS}, r AS (SELECT task, card, item, row_number() OVER (PARTITION BY task, card ORDER BY md5('3' || item), item) AS p, count(*) OVER (PARTITION BY task, card) AS n FROM items)
SELECT a.task, a.card, a.item, b.item AS given FROM r a JOIN r b ON a.task = b.task AND a.card = b.card AND b.p = a.p % a.n + 1 WHERE a.n > 1""")
def derangement_within_card(spark: SparkSession, d: str) -> DataFrame:
    """Every item gets another item of its card: a rotation of a hashed order has no fixed point."""
    rows = items(spark, d).select("task", "card", "item", F.md5(F.concat(F.lit("3"), F.col("item"))).alias("h"))
    rows = write_out(resample.places(rows, ["task", "card"], ["h", "item"]).where("rows > 1"), "places")
    asked = rows.select("task", "card", "item", (F.col("place") % F.col("rows") + 1).alias("place"))
    return asked.join(rows.select("task", "card", "place", F.col("item").alias("given")), ["task", "card", "place"]).select("task", "card", "item", "given")


@query(None)
def hashed_encoder(spark: SparkSession, d: str) -> DataFrame:
    """Length and first value of the hashed n-gram vector of every text."""
    rows = read(spark, d, "texts").select("text_sha256", "text").dropDuplicates(["text_sha256"])
    return rows.select("text_sha256", encode.encode(F.col("text")).alias("v")).select("text_sha256", F.round(vectors.norm(F.col("v")), 4).alias("len"), F.round(F.col("v")[0], 4).alias("first"))


@query(None)
def power_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Share of simulated experiments in which a true AUROC shows as better than chance, on a grid; seeds by grid and run."""
    import numpy as np
    from statistics import NormalDist

    grid = [0.55 + 0.05 * i for i in range(7)]
    runs = spark.range(len(grid) * 100, numPartitions=8).select((F.col("id") / 100).cast("int").alias("g"), (F.col("id") % 100).cast("int").alias("j"))

    def simulate(batches):
        for b in batches:
            hits = []
            for g, j in zip(b["g"], b["j"]):
                r = np.random.default_rng([7, int(g), int(j)])
                shift = 2**0.5 * NormalDist().inv_cdf(grid[g])
                pos, neg = r.normal(shift, 1, 60), r.normal(0, 1, 60)
                a = (pos[:, None] > neg[None, :]).mean()
                hits.append(a - 1.645 * (121 / (12 * 3600)) ** 0.5 > 0.5)
            yield pd.DataFrame({"g": b["g"], "hit": hits})

    got = runs.mapInPandas(simulate, "g int, hit boolean")
    return got.groupBy("g").agg(F.avg(F.col("hit").cast("double")).alias("power"))


@query("""SELECT method, count(*) AS n FROM (SELECT DISTINCT card, column_name, q, method FROM (SELECT c.card, c.name AS column_name, unnest([lower(c.name), lower(coalesce(c.unit, ''))]) AS q, 'search' AS method FROM column_info c) WHERE q <> '') GROUP BY method""")
def call_closure(spark: SparkSession, d: str) -> DataFrame:
    """All different search calls that the columns can need."""
    rows = read(spark, d, "column_info").select("card", "name", F.explode(F.array(F.lower("name"), F.lower(F.coalesce("unit", F.lit(""))))).alias("q"))
    return rows.where("q <> ''").distinct().groupBy(F.lit("search").alias("method")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT lower(unit) AS q FROM column_info WHERE unit <> ''), have AS (SELECT DISTINCT lower(label) AS q FROM canonical_items) SELECT q FROM w WHERE q NOT IN (SELECT q FROM have)""")
def missing_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Asked texts without a recorded answer."""
    asked = read(spark, d, "column_info").where("unit <> ''").select(F.lower("unit").alias("q")).distinct()
    have = read(spark, d, "canonical_items").select(F.lower("label").alias("q"))
    return asked.join(have, "q", "left_anti")
