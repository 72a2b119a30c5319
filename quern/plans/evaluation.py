"""Labels to items, leave-one-group-out lookups, and the metrics of their predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup, metrics, resample, select
from ..runtime import read, write_out
from .registry import ORACLES, query

#: Binary tasks of the labels table; their labels are Yes (0) and No (1).
BINARY = ["term.fits", "column.ontology_fits", "column.annotate"]
MIN_WEIGHT = 0.5
IDENTITY = ["label_source", "created_at", "label_id"]


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels, redelivered rows once."""
    return read(spark, d, "labels").dropDuplicates(["label_id"])


def exclusion() -> F.Column:
    """Why a row is no item; null for items."""
    return (
        F.when(~F.coalesce("fold_eligible", F.lit(False)), "not_fold_eligible")
        .when(F.trim(F.coalesce("card", F.lit(""))) == "", "no_card")
        .when(~F.coalesce(F.col("weight") >= MIN_WEIGHT, F.lit(False)), "below_weight")
    )


def items(spark: SparkSession, d: str, tasks: list[str] = BINARY, group: str = "card") -> DataFrame:
    """(task, item, grp, key, label, card, product): the heaviest label of each target and option, ties to the earliest."""
    rows = labels(spark, d).where(F.col("task_id").isin(tasks) & exclusion().isNull())
    rows = rows.withColumn("option", F.coalesce("option_key", F.lit("")))
    best = select.first_per_key(rows, ["task_id", "target_sha256", "option"], [F.desc("weight"), F.asc("label_source"), F.asc_nulls_last("created_at"), F.asc("label_id")])
    key = F.concat_ws("|", F.coalesce(F.get_json_object("state_json", "$.aspect"), F.lit("")), F.upper(F.regexp_extract("option", r"([A-Za-z]+)[:_]\s*[0-9]+>?\s*$", 1)))
    product = text.product_of(F.col("card"))
    return best.select(
        F.col("task_id").alias("task"), F.concat_ws("|", "target_sha256", "option").alias("item"), (product if group == "product" else F.col("card")).alias("grp"),
        key.alias("key"), F.col("label_index").alias("label"), "card", product.alias("product"),
    )


ITEMS = f"""
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY label_id) AS copy FROM labels) WHERE copy = 1),
el AS (SELECT *, coalesce(option_key, '') AS opt FROM base WHERE task_id IN ('term.fits', 'column.ontology_fits', 'column.annotate')
  AND coalesce(fold_eligible, FALSE) AND trim(coalesce(card, '')) <> '' AND weight >= {MIN_WEIGHT}),
sel AS (SELECT *, row_number() OVER (PARTITION BY task_id, target_sha256, opt ORDER BY weight DESC, label_source, created_at NULLS LAST, label_id) AS rn FROM el),
items AS (SELECT task_id AS task, target_sha256 || '|' || opt AS item, card, label_index AS label,
  CASE WHEN regexp_matches(card, '^DP[0-9][.][0-9]{{5}}[.][0-9]{{3}}') THEN regexp_extract(card, '^(DP[0-9][.][0-9]{{5}}[.][0-9]{{3}})', 1) ELSE card END AS product,
  coalesce(json_extract_string(state_json, '$.aspect'), '') || '|' || upper(regexp_extract(opt, '([A-Za-z]+)[:_]\\s*[0-9]+>?\\s*$', 1)) AS key
  FROM sel WHERE rn = 1)"""


def loo_sql(group: str, task: str = "term.fits") -> str:
    return f"""
WITH {ITEMS},
it AS (SELECT *, {group} AS grp FROM items WHERE task = '{task}'),
folds AS (SELECT DISTINCT grp AS fold FROM it),
train AS (SELECT fold, key, label, count(*) AS c, min(struct_pack(g := grp, i := item)) AS f FROM it JOIN folds ON grp <> fold GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY fold, key ORDER BY c DESC, f) AS r, count(*) OVER (PARTITION BY fold, key) AS labels_,
  sum(c) OVER (PARTITION BY fold, key) AS n, lead(c) OVER (PARTITION BY fold, key ORDER BY c DESC, f) AS nxt FROM train),
pr AS (SELECT fold, label, count(*) AS c, min(struct_pack(g := grp, i := item)) AS f FROM it JOIN folds ON grp <> fold GROUP BY ALL),
prr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY c DESC, f) AS r FROM pr),
prior AS (SELECT fold, max(CASE WHEN r = 1 THEN label END) AS majority, coalesce(sum(CASE WHEN label = 0 THEN c END), 0) / sum(c) AS p0 FROM prr GROUP BY fold),
top AS (SELECT fold, key, label AS pred0, n, labels_, coalesce(nxt = c, FALSE) AS tied FROM kr WHERE r = 1),
zero AS (SELECT fold, key, c AS c0 FROM train WHERE label = 0),
pred AS (SELECT it.*, coalesce(pred0, majority, 0) AS pred, coalesce(majority, 0) AS majority,
  CASE WHEN n IS NOT NULL THEN (coalesce(c0, 0) + 1.0) / (n + 2.0) WHEN p0 IS NOT NULL THEN p0 ELSE 0.5 END AS p_yes,
  n IS NULL AS novel, coalesce(labels_, 0) > 1 AS conflicting, coalesce(tied, FALSE) AS tied
  FROM it LEFT JOIN top ON top.fold = grp AND top.key = it.key LEFT JOIN zero ON zero.fold = grp AND zero.key = it.key LEFT JOIN prior ON prior.fold = grp)"""


def predictions(spark: SparkSession, d: str, group: str = "card", task: str = "term.fits") -> DataFrame:
    """Leave-one-group-out predictions of a binary task with ``p_yes``, confidence and correctness."""
    # Every metric reads the predictions several times, so they are made once.
    out = write_out(lookup.leave_one_group_out(items(spark, d, [task], group), 2), "predictions")
    p = F.col("probs")
    # Ten places, so that both engines see the same ties.
    yes = F.round(p[0], 10)
    return out.withColumn("p_yes", yes).withColumn("conf", F.greatest(yes, F.round(1 - yes, 10))).withColumn("correct", F.when(yes >= F.round(1 - yes, 10), 0).otherwise(1) == F.col("label"))


PRED = f"""{loo_sql('card')},
scored AS (SELECT *, round(p_yes, 10) AS py, greatest(round(p_yes, 10), round(1 - round(p_yes, 10), 10)) AS conf,
  (CASE WHEN round(p_yes, 10) >= round(1 - round(p_yes, 10), 10) THEN 0 ELSE 1 END) = label AS correct FROM pred)"""


@query(f"{loo_sql('card')} SELECT item, grp, pred, majority, novel, conflicting, tied FROM pred")
def loco_lookup_predict(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("item", "grp", "pred", "majority", "novel", "conflicting", "tied")


@query(f"{loo_sql('card')} SELECT item, round(p_yes, 6) AS p_yes FROM pred")
def loco_lookup_prob(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("item", F.round("p_yes", 6).alias("p_yes"))


@query(f"{loo_sql('card')} SELECT count(*) AS n, round(avg((pred = label)::int), 6) AS acc, round(avg((majority = label)::int), 6) AS majority_acc FROM pred WHERE novel")
def loco_novel_keys(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c: F.round(F.avg((F.col(c) == F.col("label")).cast("double")), 6)
    return predictions(spark, d).where("novel").agg(F.count("*").alias("n"), hit("pred").alias("acc"), hit("majority").alias("majority_acc"))


@query(f"{loo_sql('product')} SELECT grp AS product, count(*) AS n, sum((pred = label)::int)::bigint AS hits, sum(novel::int)::bigint AS novel FROM pred GROUP BY ALL")
def lopo_lookup(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, "product").groupBy(F.col("grp").alias("product")).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hits"), F.count_if("novel").alias("novel"))


@query(f"""{loo_sql('card', 'column.ontology_fits')} SELECT item, grp, pred, round(p_yes, 6) AS p_yes, novel FROM pred""")
def loco_lookup_ontology(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, task="column.ontology_fits").select("item", "grp", "pred", F.round("p_yes", 6).alias("p_yes"), "novel")


@query(f"""WITH {ITEMS}, it AS (SELECT * FROM items WHERE task = 'term.fits'),
g AS (SELECT card AS grp, sum((label = 0)::int) AS i0, sum((label = 1)::int) AS i1 FROM it GROUP BY card),
t AS (SELECT *, least(sum(i0) OVER () - i0, sum(i1) OVER () - i1) AS mt, least(i0, i1) AS mh FROM g)
SELECT grp, mt::bigint AS min_train, mh::bigint AS min_heldout, CASE WHEN mt < 30 THEN 'train_below_guard' WHEN mh < 5 THEN 'heldout_below_guard' END AS skipped FROM t""")
def fold_guard_reasons(spark: SparkSession, d: str) -> DataFrame:
    return lookup.fold_guards(items(spark, d, ["term.fits"]), 2)


@query(f"WITH {ITEMS} SELECT task, item, card, label, key FROM items")
def argmax_per_key_tie_earliest(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("task", "item", "card", "label", "key")


@query(f"""WITH {ITEMS} SELECT task, label, count(*) AS n FROM items GROUP BY ALL""")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("task", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, c AS (SELECT task, label, count(*) AS n FROM items GROUP BY ALL)
SELECT task, (sum(n) - max(n))::bigint AS nonmodal FROM c GROUP BY task""")
def class_counts_nonmodal(spark: SparkSession, d: str) -> DataFrame:
    counts = items(spark, d).groupBy("task", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("task").agg((F.sum("n") - F.max("n")).alias("nonmodal"))


@query(f"""WITH base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY label_id) AS copy FROM labels) WHERE copy = 1)
SELECT task_id, CASE WHEN NOT coalesce(fold_eligible, FALSE) THEN 'not_fold_eligible' WHEN trim(coalesce(card, '')) = '' THEN 'no_card'
  WHEN NOT coalesce(weight >= {MIN_WEIGHT}, FALSE) THEN 'below_weight' END AS reason, count(*) AS n FROM base GROUP BY ALL""")
def fold_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).groupBy("task_id", exclusion().alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{PRED} SELECT count(*) AS n, round(avg(correct::int), 6) AS acc, round(avg(2 * power(py - (label = 0)::int, 2)), 6) AS brier,
round(-avg(ln(greatest(CASE WHEN label = 0 THEN py ELSE round(1 - py, 10) END, 1e-12))), 6) AS nll FROM scored""")
def pooled_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("pair", F.array("p_yes", F.round(1 - F.col("p_yes"), 10)))
    got = metrics.scores(rows, [], "pair", "label")
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("acc", "brier", "nll")])


@query(f"""{PRED}, f AS (SELECT c, sum(CASE WHEN l = p AND l = c THEN 2 * n ELSE 0 END) AS tp2, sum(CASE WHEN l <> p AND c IN (l, p) THEN n ELSE 0 END) AS miss
  FROM (SELECT label AS l, pred AS p, count(*) AS n FROM scored GROUP BY ALL), (SELECT unnest([0, 1]) AS c) WHERE c IN (l, p) GROUP BY c)
SELECT round(avg(tp2 / (tp2 + miss)), 6) AS macro_f1 FROM f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(predictions(spark, d), [], "pred", "label").select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""{PRED}, tied_ AS (SELECT conf, avg(correct::int) OVER (PARTITION BY conf) AS ca, item FROM scored),
b AS (SELECT conf, ca, ntile(15) OVER (ORDER BY conf, item) AS bin FROM tied_)
SELECT round(sum(abs(sc - sa)) / (SELECT count(*) FROM b), 6) AS ece FROM (SELECT bin, sum(conf) AS sc, sum(ca) AS sa FROM b GROUP BY bin)""")
def ece_equal_mass(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(predictions(spark, d), [], "conf", "correct").select(F.round("ece", 6).alias("ece"))


CURVE = f"""{PRED}, t AS (SELECT conf, item, avg(correct::int) OVER (PARTITION BY conf) AS ca, count(*) OVER () AS n FROM scored),
c AS (SELECT row_number() OVER w AS place, n, 1 - avg(ca) OVER (w ROWS UNBOUNDED PRECEDING) AS risk FROM t WINDOW w AS (ORDER BY conf DESC, item)),
curve AS (SELECT place, n, place / n AS coverage, risk, lag(risk) OVER (ORDER BY place) AS prev FROM c)"""


@query(f"{CURVE} SELECT place, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def coverage_risk_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.risk_curve(predictions(spark, d), [], "conf", "correct")
    return curve.select("place", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(f"""{CURVE} SELECT round(sum(coalesce((risk + prev) / 2 / n, 0)), 6) AS aurc,
coalesce(max(CASE WHEN round(risk, 9) <= 0.2 THEN round(coverage, 6) END), 0) AS coverage_20, coalesce(max(CASE WHEN round(risk, 9) <= 0.3 THEN round(coverage, 6) END), 0) AS coverage_30 FROM curve""")
def aurc_and_coverage(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.risk_curve(predictions(spark, d), [], "conf", "correct").withColumn("risk", F.round("risk", 12))
    curve = curve.withColumn("risk", F.when(F.abs(F.col("risk") - F.round("risk", 9)) < 1e-9, F.round("risk", 9)).otherwise(F.col("risk")))
    return metrics.curve_summary(curve, [], (0.2, 0.3)).select(*[F.round(c, 6).alias(c) for c in ("aurc", "coverage_20", "coverage_30")])


AUROC = f"""{PRED}, r AS (SELECT label, rank() OVER (ORDER BY py) + (count(*) OVER (PARTITION BY py) - 1) / 2.0 AS mid FROM scored)
SELECT round((sum(CASE WHEN label = 0 THEN mid END) - sum((label = 0)::int) * (sum((label = 0)::int) + 1) / 2.0) / (sum((label = 0)::int) * sum((label <> 0)::int)), 6) AS auroc FROM r"""


@query(AUROC)
def auroc_midrank(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("positive", F.col("label") == 0)
    return metrics.auroc(rows, [], "p_yes", "positive").select(F.round("auroc", 6).alias("auroc"))


@query(f"""{PRED}, p AS (SELECT grp, a.py AS x, b.py AS y FROM scored a JOIN scored b USING (grp) WHERE a.label = 0 AND b.label = 1)
SELECT grp, round(avg(CASE WHEN x > y THEN 1 WHEN x = y THEN 0.5 ELSE 0 END), 6) AS auroc FROM p GROUP BY grp""")
def auroc_per_card(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the pair kernel within each card, without forming pairs."""
    rows = predictions(spark, d).withColumn("positive", F.col("label") == 0)
    return metrics.auroc(rows, ["grp"], "p_yes", "positive").where("auroc is not null").select("grp", F.round("auroc", 6).alias("auroc"))


@query(f"""{PRED} SELECT ceil(conf * 10)::int AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(correct::int), 6) AS acc FROM scored WHERE ceil(conf * 10) BETWEEN 1 AND 10 GROUP BY ALL""")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.reliability(predictions(spark, d), [], "conf", "correct")
    return got.select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query(f"""{PRED} SELECT 0 AS class, round(avg(py) - avg((label = 0)::int), 6) AS gap FROM scored UNION ALL SELECT 1, round(avg(1 - py) - avg((label = 1)::int), 6) FROM scored""")
def calibration_in_the_large(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).select("label", F.posexplode(F.array("p_yes", 1 - F.col("p_yes"))).alias("class", "p"))
    return rows.groupBy("class").agg(F.round(F.avg("p") - F.avg((F.col("label") == F.col("class")).cast("double")), 6).alias("gap"))


@query(f"""{PRED}, o AS (SELECT item, pred FROM ({loo_sql('product')} SELECT item, pred FROM pred))
SELECT count(*) AS n, round(avg((scored.pred <> o.pred)::int), 6) AS flips FROM scored JOIN o USING (item)""")
def flip_rate(spark: SparkSession, d: str) -> DataFrame:
    a, b = (predictions(spark, d, g).select("item", F.col("pred").alias(g)) for g in ("card", "product"))
    return a.join(b, "item").agg(F.count("*").alias("n"), F.round(F.avg((F.col("card") != F.col("product")).cast("double")), 6).alias("flips"))


BOOT = """w0 AS (SELECT grp AS cluster, row_number() OVER (ORDER BY grp) - 1 AS i, sum(correct::int) AS s, count(*) AS n FROM scored GROUP BY grp),
m AS (SELECT count(*) AS m FROM w0),
dr AS (SELECT b, ('0x' || substr(md5(b::varchar || ':' || j::varchar), 1, 12))::bigint % m AS i FROM m, range(200) x(b), range((SELECT m FROM m)) y(j)),
pb AS (SELECT b, sum(s) / sum(n) AS v FROM dr JOIN w0 USING (i) GROUP BY b)"""


@query(f"""{PRED}, {BOOT} SELECT (SELECT count(*) FROM scored) AS n, round((SELECT avg(correct::int) FROM scored), 6) AS point,
round(quantile_cont(v, 0.05), 6) AS lower, round(quantile_cont(v, 0.95), 6) AS upper, count(v) AS n_valid FROM pb""")
def bootstrap_accuracy_ci(spark: SparkSession, d: str) -> DataFrame:
    got = resample.mean_ci(predictions(spark, d), "grp", F.col("correct").cast("int"), draws=200)
    return got.select("n", F.round("point", 6).alias("point"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n_valid")


GAIN = "(correct::int - (majority = label)::int)"


@query(f"""{PRED}, {BOOT.replace('sum(correct::int)', f'sum{GAIN}')} SELECT (SELECT count(*) FROM scored) AS n, round((SELECT avg{GAIN} FROM scored), 6) AS point,
round(quantile_cont(v, 0.05), 6) AS lower, round(quantile_cont(v, 0.95), 6) AS upper, count(v) AS n_valid FROM pb""")
def paired_bootstrap_gain(spark: SparkSession, d: str) -> DataFrame:
    """Gain of the lookup over the majority on the same resamples."""
    gain = F.col("correct").cast("int") - (F.col("majority") == F.col("label")).cast("int")
    got = resample.mean_ci(predictions(spark, d), "grp", gain, draws=200)
    return got.select("n", F.round("point", 6).alias("point"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n_valid")


@query(f"""{PRED}, g AS (SELECT grp, sum{GAIN} AS gain FROM scored GROUP BY grp HAVING count(*) >= 10), o AS (SELECT count(*) AS clusters, count(*) FILTER (gain > 0) AS wins FROM g)
SELECT clusters, wins, ceil(clusters * 0.8)::bigint AS needed, clusters >= 4 AND wins >= ceil(clusters * 0.8) AS passed FROM o""")
def sign_test_gain(spark: SparkSession, d: str) -> DataFrame:
    gain = F.col("correct").cast("int") - (F.col("majority") == F.col("label")).cast("int")
    return resample.sign_test(predictions(spark, d), "grp", gain)


@query(f"""{PRED}, g AS (SELECT grp, count(*) AS n, sum{GAIN} AS gain FROM scored GROUP BY grp HAVING count(*) >= 10)
SELECT count(*) AS clusters, count(*) FILTER (50 * gain > -n) AS wins FROM g""")
def sign_margin_report(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose loss stays within a margin of one in fifty, in whole numbers."""
    gain = F.col("correct").cast("int") - (F.col("majority") == F.col("label")).cast("int")
    per = predictions(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.sum(gain).alias("gain")).where("n >= 10")
    return per.agg(F.count("*").alias("clusters"), F.count_if(50 * F.col("gain") > -F.col("n")).alias("wins"))


@query(f"""{PRED}, {BOOT.replace('sum(correct::int)', f'sum{GAIN}')}, g AS (SELECT grp, sum{GAIN} AS gain FROM scored GROUP BY grp HAVING count(*) >= 10),
o AS (SELECT count(*) AS clusters, count(*) FILTER (gain > 0) AS wins FROM g), l AS (SELECT quantile_cont(v, 0.05) AS lower FROM pb)
SELECT round(lower, 6) > 0 AS bound_positive, clusters >= 4 AND wins >= ceil(clusters * 0.8) AS signs, round(lower, 6) > -0.02 AS non_inferior,
CASE WHEN NOT (clusters >= 4 AND wins >= ceil(clusters * 0.8)) THEN 'sign_test_failed' WHEN round(lower, 6) <= 0 THEN 'bound_not_positive' ELSE 'passed' END AS reason FROM o, l""")
def bound_and_signs(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap bound and sign test together, with the first reason to refuse; and whether the loss stays within 0.02."""
    gain = F.col("correct").cast("int") - (F.col("majority") == F.col("label")).cast("int")
    rows = predictions(spark, d)
    lower = resample.mean_ci(rows, "grp", gain, draws=200).select(F.round("lower", 6).alias("lower"))
    both = resample.sign_test(rows, "grp", gain).crossJoin(F.broadcast(lower))
    reason = F.when(~F.col("passed"), "sign_test_failed").when(F.col("lower") <= 0, "bound_not_positive").otherwise("passed")
    return both.select((F.col("lower") > 0).alias("bound_positive"), F.col("passed").alias("signs"), (F.col("lower") > -0.02).alias("non_inferior"), reason.alias("reason"))


def _upper(rows: str) -> str:
    """SQL tables ``b`` and ``u`` (e, n, upper): the bound of each distinct pair of ``rows`` by bisection of the binomial tail."""
    tail = "list_sum(list_transform(range(0, e::bigint + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))))"
    return f"""b AS (SELECT DISTINCT e::double AS e, n::double AS n, (e / n)::double AS lo, 1.0::double AS hi, 0 AS i FROM {rows} WHERE e > 0 AND e < n
  UNION ALL SELECT e, n, CASE WHEN t > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {tail} AS t FROM b WHERE i < 60)),
u AS (SELECT e, n, (lo + hi) / 2 AS upper FROM b WHERE i = 60 UNION ALL SELECT DISTINCT e::double, n::double, CASE WHEN e = 0 THEN 1 - power(0.05, 1.0 / n) ELSE 1.0 END FROM {rows} WHERE e = 0 OR e >= n)"""


@query(f"""{PRED.replace('WITH', 'WITH RECURSIVE', 1)}, per AS (SELECT grp, sum((NOT correct)::int) AS e, count(*) AS n FROM scored GROUP BY grp), {_upper('per')}
SELECT grp, per.e::bigint AS errors, per.n, round(upper, 9) AS upper FROM per JOIN u ON u.e = per.e AND u.n = per.n""")
def binomial_upper_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Errors and rows of each card with the exact upper bound of the error rate; the bound is made per distinct pair."""
    per = predictions(spark, d).groupBy("grp").agg(F.count_if(~F.col("correct")).alias("errors"), F.count("*").alias("n"))
    pairs = per.select("errors", "n").distinct()
    return per.join(pairs.withColumn("upper", F.round(resample.binomial_upper(F.col("errors"), F.col("n")), 9)), ["errors", "n"])


@query(f"""{PRED} SELECT grp, count(*) AS n, round(1 - power(0.05, 1.0 / count(*)), 6) AS upper FROM scored GROUP BY grp HAVING sum((NOT correct)::int) = 0""")
def binomial_upper_no_errors(spark: SparkSession, d: str) -> DataFrame:
    per = predictions(spark, d).groupBy("grp").agg(F.count_if(~F.col("correct")).alias("errors"), F.count("*").alias("n")).where("errors = 0")
    return per.select("grp", "n", F.round(1 - F.pow(F.lit(0.05), 1 / F.col("n")), 6).alias("upper"))


@query(f"""{PRED.replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT conf, count(*) AS n, sum((NOT correct)::int) AS e FROM scored GROUP BY conf), c AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) AS n, sum(e) OVER (ORDER BY conf DESC) AS e FROM t),
ends AS (SELECT * FROM c WHERE n >= 30), {_upper('ends')}, r(risk) AS (VALUES (0.05::double), (0.1), (0.2), (0.3), (0.4)), m AS (SELECT risk, min(conf) AS threshold FROM ends JOIN u ON u.e = ends.e AND u.n = ends.n, r WHERE upper <= risk GROUP BY risk)
SELECT risk, threshold FROM r LEFT JOIN m USING (risk)""")
def threshold_within_risk(spark: SparkSession, d: str) -> DataFrame:
    """The smallest confidence at which at least 30 rows lie above with an error bound within the risk."""
    ties = metrics.tie_groups(predictions(spark, d), [], "conf", True, n=F.lit(1), e=(~F.col("correct")).cast("int"))
    ends = ties.select("conf", (F.col("n") + F.col("n_before")).alias("n"), (F.col("e") + F.col("e_before")).alias("e")).where("n >= 30")
    pairs = ends.select("e", "n").distinct()
    bound = ends.join(pairs.withColumn("upper", resample.binomial_upper(F.col("e"), F.col("n"))), ["e", "n"])
    risks = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.3,), (0.4,)], "risk double")
    met = bound.crossJoin(F.broadcast(risks)).where("upper <= risk").groupBy("risk").agg(F.min("conf").alias("threshold"))
    return risks.join(met, "risk", "left")


@query(f"""WITH {ITEMS} SELECT task, card, item, dense_rank() OVER (PARTITION BY task, card ORDER BY split_part(item, '|', 1)) AS slot FROM items""")
def slot_dense_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("task", "card", "item", F.split_part("item", F.lit("|"), F.lit(1)).alias("target"))
    slots = resample.places(rows.select("task", "card", "target").distinct(), ["task", "card"], ["target"])
    return rows.join(slots, ["task", "card", "target"]).select("task", "card", "item", F.col("place").alias("slot"))


@query(f"""WITH {ITEMS}, h AS (SELECT DISTINCT task, split_part(item, '|', 1) AS target, md5('0:' || split_part(item, '|', 1)) AS h FROM items),
r AS (SELECT task, target, row_number() OVER (PARTITION BY task ORDER BY h, target) AS place FROM h) SELECT task, target, place FROM r WHERE place <= 25""")
def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 25 targets of each task in the order of a salted hash."""
    targets = items(spark, d).select("task", F.split_part("item", F.lit("|"), F.lit(1)).alias("target")).distinct()
    order = [F.md5(F.concat(F.lit("0:"), F.col("target"))), F.col("target")]
    return select.top_per_key(targets, ["task"], order, 25)


def _by_task(name: str) -> str:
    """The SQL of a query over the binary task ``term.fits``, for each binary task."""
    return " UNION ALL ".join(f"SELECT '{t}' AS task, x.* FROM ({ORACLES[name]}) x".replace("task = 'term.fits'", f"task = '{t}'") for t in BINARY)


def all_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of every binary task, with ``task``."""
    out = None
    for t in BINARY:
        part = predictions(spark, d, task=t).withColumn("task", F.lit(t))
        out = part if out is None else out.union(part)
    return out


@query(_by_task("pooled_scores"))
def pooled_scores_by_task(spark: SparkSession, d: str) -> DataFrame:
    rows = all_predictions(spark, d).withColumn("pair", F.array("p_yes", F.round(1 - F.col("p_yes"), 10)))
    return metrics.scores(rows, ["task"], "pair", "label").select("task", "n", *[F.round(c, 6).alias(c) for c in ("acc", "brier", "nll")])


@query(_by_task("macro_f1"))
def macro_f1_by_task(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(all_predictions(spark, d), ["task"], "pred", "label").select("task", F.round("macro_f1", 6).alias("macro_f1"))


@query(_by_task("ece_equal_mass"))
def ece_by_task(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(all_predictions(spark, d), ["task"], "conf", "correct").select("task", F.round("ece", 6).alias("ece"))


@query(_by_task("auroc_midrank"))
def auroc_by_task(spark: SparkSession, d: str) -> DataFrame:
    rows = all_predictions(spark, d).withColumn("positive", F.col("label") == 0)
    return metrics.auroc(rows, ["task"], "p_yes", "positive").select("task", F.round("auroc", 6).alias("auroc"))


@query(_by_task("aurc_and_coverage"))
def aurc_by_task(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.risk_curve(all_predictions(spark, d), ["task"], "conf", "correct").withColumn("risk", F.round("risk", 12))
    curve = curve.withColumn("risk", F.when(F.abs(F.col("risk") - F.round("risk", 9)) < 1e-9, F.round("risk", 9)).otherwise(F.col("risk")))
    return metrics.curve_summary(curve, ["task"], (0.2, 0.3)).select("task", *[F.round(c, 6).alias(c) for c in ("aurc", "coverage_20", "coverage_30")])


_CHOICE = "('term.fits', 'column.ontology_fits', 'column.annotate')"


@query(f"{loo_sql('card', 'column.aspect').replace(_CHOICE, repr(('column.aspect', 'avu.value_kind')))} SELECT item, grp, pred, majority, novel, conflicting, tied FROM pred")
def loco_lookup_aspect(spark: SparkSession, d: str) -> DataFrame:
    """The lookup of a choice task with eight labels."""
    rows = lookup.leave_one_group_out(items(spark, d, ["column.aspect"]), 8)
    return rows.select("item", "grp", "pred", "majority", "novel", "conflicting", "tied")
