"""Arrays and vectors: distributions of options, scores of vectors, group scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import bounded_broadcast, read, write_out
from .registry import query
from .store import OPT, options

#: Option indexes of one block: what is ordered or joined by block has no more rows of a decision at a time.
BLOCK = 1024

_SETS = f"""o AS ({OPT}), a AS (SELECT decision_id, list(s_c ORDER BY option_index) AS s, list(NOT coalesce(masked, FALSE) ORDER BY option_index) AS keep FROM o
WHERE s_c IS NOT NULL AND NOT isnan(s_c) GROUP BY decision_id),
p AS (SELECT decision_id, s, keep, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM a), q AS (SELECT decision_id, keep, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p)"""


def option_scores(spark: SparkSession, d: str) -> DataFrame:
    """(decision_id, block, place, s, keep, m, n): the scored options in long form, with their place in the decision's order,
    the decision's greatest score and its number of options.

    Sums by block combine before the exchange; decisions meet their options block by block, so a hot one is spread.
    """
    rows = options(spark, d).where("s_c is not null and not isnan(s_c)")
    rows = rows.select("decision_id", F.floor(F.col("option_index") / BLOCK).alias("block"), "option_index", F.col("s_c").alias("s"), (~F.coalesce("masked", F.lit(False))).alias("keep"))
    whole = Window.partitionBy("decision_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("decision_id", "block").agg(F.max("s").alias("top"), F.count("*").alias("k"))
    blocks = blocks.select("decision_id", "block", F.max("top").over(whole).alias("m"), F.sum("k").over(whole).alias("n"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("decision_id", "block").orderBy("option_index"))
    return rows.join(blocks, ["decision_id", "block"]).select("decision_id", "block", (F.col("start") + inside - 1).alias("place"), "s", "keep", "m", "n")


def option_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """(decision_id, place, s, keep, m, n, p, anchor): the scored options with their probabilities and that of the first one."""
    rows = write_out(option_scores(spark, d).withColumn("e", F.exp(F.col("s") - F.col("m"))), "scores")
    whole = Window.partitionBy("decision_id")
    blocks = rows.groupBy("decision_id", "block").agg(F.sum("e").alias("z"), F.max(F.when(F.col("place") == 0, F.col("e"))).alias("first"))
    blocks = blocks.select("decision_id", "block", F.sum("z").over(whole).alias("z"), F.max("first").over(whole).alias("first"))
    p = (F.col("e") / F.col("z")).alias("p")
    return rows.join(blocks, ["decision_id", "block"]).select("decision_id", "place", "s", "keep", "m", "n", p, (F.col("first") / F.col("z")).alias("anchor"))


@query(f"WITH {_SETS} SELECT decision_id, round(list_max(p), 6) AS top, round(list_min(p), 6) AS low, round(list_sum(list_transform(p, lambda v: v * v)), 6) AS squares FROM q")
def softmax_array(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return option_probabilities(spark, d).groupBy("decision_id").agg(F.round(F.max(p), 6).alias("top"), F.round(F.min(p), 6).alias("low"), F.round(F.sum(p * p), 6).alias("squares"))


@query(f"""WITH {_SETS}, k AS (SELECT decision_id, list_transform(p, lambda v, i: CASE WHEN keep[i] THEN v ELSE 0 END) AS z, p FROM q)
SELECT decision_id, round(1 - list_sum(z), 6) AS masked_mass, CASE WHEN list_sum(z) > 0 THEN round(list_max(z) / list_sum(z), 6) END AS top FROM k""")
def mask_renormalise(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("keep"), F.col("p")).otherwise(F.lit(0.0))
    rows = option_probabilities(spark, d).groupBy("decision_id").agg(F.sum(kept).alias("mass"), F.max(kept).alias("top"))
    return rows.select("decision_id", F.round(1 - F.col("mass"), 6).alias("masked_mass"), F.when(F.col("mass") > 0, F.round(F.col("top") / F.col("mass"), 6)).alias("top"))


@query(f"""WITH {_SETS} SELECT decision_id, (list_position(p, list_max(p)) - 1)::int AS best, round(CASE WHEN len(p) > 1 THEN list_max(p) - (list_sum(p) - list_max(p)) / (len(p) - 1) ELSE list_max(p) END, 6) AS confidence,
round(CASE WHEN len(p) > 1 THEN list_reverse_sort(p)[1] - list_reverse_sort(p)[2] ELSE p[1] END, 6) AS margin FROM q""")
def argmax_confidence_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = option_probabilities(spark, d).groupBy("decision_id").agg(
        F.max(F.struct("p", (-F.col("place")).alias("first"))).alias("b"),
        F.sum("p").alias("mass"),
        F.max("n").alias("n"),
        F.count_if(F.col("s") == F.col("m")).alias("ties"),
        F.max(F.when(F.col("s") < F.col("m"), F.col("p"))).alias("next"),
    )
    top, several = F.col("b.p"), F.col("n") > 1
    confidence = F.when(several, top - (F.col("mass") - top) / (F.col("n") - 1)).otherwise(top)
    margin = F.when(F.col("ties") > 1, F.lit(0.0)).when(several, top - F.col("next")).otherwise(top)
    return rows.select("decision_id", (-F.col("b.first")).cast("int").alias("best"), F.round(confidence, 6).alias("confidence"), F.round(margin, 6).alias("margin"))


@query(f"WITH {_SETS} SELECT decision_id, generate_subscripts(p, 1) - 1 AS place, round(unnest(p), 6) AS prob FROM q")
def explode_options(spark: SparkSession, d: str) -> DataFrame:
    return option_probabilities(spark, d).select("decision_id", F.col("place").cast("long").alias("place"), F.round("p", 6).alias("prob"))


@query(f"WITH {_SETS}, l AS (SELECT decision_id, list_transform(p, lambda v: ln(greatest(v, 1e-12))) AS l FROM q) SELECT decision_id, round(list_sum(list_transform(l, lambda v: v - l[1])), 5) AS total FROM l")
def log_odds_to_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Log probability of every option less that of the first one, summed."""
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))
    return option_probabilities(spark, d).groupBy("decision_id").agg(F.round(F.sum(log("p") - log("anchor")), 5).alias("total"))


_EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v, label FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM e)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@query(f"WITH {_EMB} SELECT vec_id, round(len, 5) AS len, round(list_sum(list_transform(v, lambda x: x / greatest(len, 1e-12))), 4) AS total FROM n")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    return rows.select("vec_id", F.round(vectors.norm(F.col("v")), 5).alias("len"), F.round(vectors.total(vectors.unit(F.col("v"))), 4).alias("total"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """(label, place, c): mean vector of each label in long form; sums combine before the exchange."""
    long = embeddings(spark, d).select("label", F.posexplode("v").alias("place", "x"))
    return long.groupBy("label", "place").agg(F.avg("x").alias("c"))


_CENT = f"{_EMB}, l AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), c AS (SELECT label, i, avg(x) AS c FROM l GROUP BY ALL), cv AS (SELECT label, list(c ORDER BY i) AS c FROM c GROUP BY label)"


@query(f"WITH {_CENT} SELECT label, round(sqrt(list_dot_product(c, c)), 5) AS len FROM cv")
def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids(spark, d).groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("c") * F.col("c"))), 5).alias("len"))


@query(f"""WITH {_CENT}, a AS (SELECT list(m ORDER BY i) AS a FROM (SELECT i, avg(x) AS m FROM l GROUP BY i)), s AS (SELECT vec_id, cv.label AS candidate, list_dot_product(v, c) - list_dot_product(v, a) AS s FROM e, cv, a)
SELECT vec_id, candidate, round(s, 4) AS s_c FROM s""")
def pairwise_s_c(spark: SparkSession, d: str) -> DataFrame:
    """Score of every vector against every class centroid, less its score against the mean vector."""
    cents = write_out(centroids(spark, d), "centroids")
    listed = cents.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "c"))).alias("c")).select(F.col("label").alias("candidate"), F.col("c.c").alias("c"))
    long = embeddings(spark, d).select(F.posexplode("v").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("m"))
    anchor = long.agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("m")).select(F.col("m.m").alias("anchor"))
    # Classes are few and the anchor is one row: both are broadcast, the vectors stay where they are.
    scored = embeddings(spark, d).crossJoin(bounded_broadcast(write_out(listed.crossJoin(F.broadcast(anchor)), "classes")))
    s = vectors.dot(F.col("v"), F.col("c")) - vectors.dot(F.col("v"), F.col("anchor"))
    return scored.select("vec_id", "candidate", F.round(s, 4).alias("s_c"))


@query(f"WITH {_EMB}, u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(list_transform(v, lambda x: x / len)) AS x FROM n), s AS (SELECT label, i, sum(x) AS s FROM u GROUP BY ALL), k AS (SELECT label, count(*) AS k FROM e GROUP BY label) SELECT label, round((sum(s * s) - any_value(k)) / (any_value(k) * (any_value(k) - 1)), 6) AS cosine FROM s JOIN k USING (label) GROUP BY label")
def mean_pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine between the different vectors of a label, from the length of their sum: no pair is formed."""
    rows = embeddings(spark, d).withColumn("u", vectors.unit(F.col("v")))
    sums = rows.select("label", F.posexplode("u").alias("place", "x")).groupBy("label", "place").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("k").alias("k")).where("k > 1")
    return per.select("label", F.round((F.col("q") - F.col("k")) / (F.col("k") * (F.col("k") - 1)), 6).alias("cosine"))


@query(f"""WITH {_CENT} SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: x * c[i])), 4) AS products, round(list_sum(list_transform(v, lambda x, i: abs(x - c[i]))), 4) AS gaps FROM e JOIN cv USING (label)""")
def feature_pair_spec(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the pair features of a vector and its label's centroid."""
    listed = centroids(spark, d).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "c"))).alias("c")).select("label", F.col("c.c").alias("c"))
    pairs = embeddings(spark, d).join(bounded_broadcast(write_out(listed, "centroids")), "label").withColumn("f", vectors.pair_features(F.col("v"), F.col("c")))
    half = F.size("c")
    return pairs.select("vec_id", F.round(vectors.total(F.slice("f", F.lit(1), half)), 4).alias("products"), F.round(vectors.total(F.slice("f", half + 1, half)), 4).alias("gaps"))


@query(f"WITH {_EMB} SELECT label, count(*) AS n, round(avg(len), 5) AS len FROM n GROUP BY label")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.norm(F.col("v"))), 5).alias("len"))


@query("SELECT lock_sha, count(*) AS n, round(min(fp16_cos), 9) AS worst FROM vectors GROUP BY lock_sha")
def half_precision_gate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "vectors").groupBy("lock_sha").agg(F.count("*").alias("n"), F.round(F.min("fp16_cos"), 9).alias("worst"))
