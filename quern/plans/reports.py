"""Reports, lookups in tiers, feedback rows, bounds of curves, states and further rules over the run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, resample, select
from ..runtime import read, write_out
from .evaluation import ITEMS, PRED, _by_task, _upper, all_predictions, items, labels, loo_sql, predictions
from .registry import query
from .rules import _BASE, ASPECTS, number
from .store import DEC, OPT, decisions, options

DRAWS = 40


@query(f"""{PRED}, o AS (SELECT item, round(p_yes, 10) AS py2 FROM ({loo_sql('product')} SELECT item, p_yes FROM pred)), w0 AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM scored GROUP BY grp), m AS (SELECT count(*) AS m FROM w0),
dr AS (SELECT b, ('0x' || substr(md5(b::varchar || ':' || j::varchar), 1, 12))::bigint % m AS i FROM m, range({DRAWS}) x(b), range((SELECT m FROM m)) y(j)), w AS (SELECT b, grp, count(*) AS w FROM dr JOIN w0 USING (i) GROUP BY ALL),
k AS (SELECT grp, 'card' AS scoring, py AS s, label FROM scored UNION ALL SELECT grp, 'product', py2, label FROM scored JOIN o USING (item)),
s AS (SELECT b, scoring, s, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS p, sum(CASE WHEN label <> 0 THEN w ELSE 0 END) AS n FROM k JOIN w USING (grp) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b, scoring ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT b, scoring, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auroc FROM c GROUP BY ALL), v AS (SELECT b, avg(auroc) AS v FROM a GROUP BY b)
SELECT round(quantile_cont(v, 0.05), 6) AS lower, round(quantile_cont(v, 0.95), 6) AS upper, count(v) AS n_valid FROM v""")
def mean_auroc_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Cluster bootstrap bounds of the mean AUROC of two scorings, each draw from weighted sums per distinct score."""
    own = predictions(spark, d).select("item", F.col("grp").alias("cluster"), "label", F.col("p_yes").alias("card"))
    both = own.join(predictions(spark, d, "product").select("item", F.col("p_yes").alias("product")), "item")
    rows = both.unpivot(["cluster", "label"], ["card", "product"], "scoring", "s").groupBy("cluster", "scoring", "s", "label").agg(F.count("*").alias("k"))
    w = resample.bootstrap_weights(own.select("cluster").distinct(), DRAWS)
    m = F.col("k") * F.col("w")
    weighted = rows.join(w, "cluster")
    ties = metrics.tie_groups(weighted, ["b", "scoring"], "s", False, p=F.when(F.col("label") == 0, m).otherwise(0), n=F.when(F.col("label") != 0, m).otherwise(0))
    wins = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    per = ties.groupBy("b", "scoring").agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc")).groupBy("b").agg(F.avg("auroc").alias("v"))
    return per.agg(F.round(F.percentile("v", F.lit(0.05)), 6).alias("lower"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("upper"), F.count("v").alias("n_valid"))


@query(f"""WITH d AS ({DEC}), m AS (SELECT decision_id, max(prob) AS top FROM ({OPT}) WHERE prob IS NOT NULL AND NOT isnan(prob) GROUP BY decision_id)
SELECT decision_id, shape, round(CASE WHEN shape = 'rank_fit' THEN CASE WHEN isnan(p_fit) THEN NULL ELSE p_fit END ELSE top END, 6) AS stat FROM d LEFT JOIN m USING (decision_id)""")
def confidence_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """The number that thresholds look at: the answer's fit where options are ranked by fit, else the greatest probability."""
    top = options(spark, d).where(number("prob").isNotNull()).groupBy("decision_id").agg(F.max("prob").alias("top"))
    rows = decisions(spark, d).join(top, "decision_id", "left")
    return rows.select("decision_id", "shape", F.round(F.when(F.col("shape") == "rank_fit", number("p_fit")).otherwise(F.col("top")), 6).alias("stat"))


@query(f"""WITH {_BASE}, h AS (SELECT DISTINCT card, lower(trim(label)) AS hint FROM base WHERE trim(coalesce(card, '')) <> '') SELECT card, count(*) AS said, count(*) FILTER (hint IN ({', '.join(repr(a) for a in ASPECTS)})) AS known,
coalesce(string_agg(hint, ',' ORDER BY hint) FILTER (hint IN ({', '.join(repr(a) for a in ASPECTS)})), '') AS hints FROM h GROUP BY card""")
def hints_in_domain(spark: SparkSession, d: str) -> DataFrame:
    """What was said of each card, in lower case and once; of it the known aspects."""
    rows = labels(spark, d).where("trim(coalesce(card, '')) <> ''").select("card", F.lower(F.trim("label")).alias("hint")).distinct()
    known = F.col("hint").isin(ASPECTS)
    return rows.groupBy("card").agg(F.count("*").alias("said"), F.count_if(known).alias("known"), F.array_join(F.sort_array(F.collect_list(F.when(known, F.col("hint")))), ",").alias("hints"))


@query(f"""WITH d AS ({DEC}), m AS (SELECT task_id, framing_id, scope, column_name, level, min(task_key) AS text FROM d GROUP BY ALL)
SELECT d.decision_id, m.text FROM d JOIN m ON m.task_id = d.task_id AND m.framing_id = d.framing_id AND m.scope = d.scope AND m.column_name IS NOT DISTINCT FROM d.column_name AND m.level = d.level""")
def manifest_text(spark: SparkSession, d: str) -> DataFrame:
    """A manifest read by five keys, of which one may be null."""
    keys = ["task_id", "framing_id", "scope", "column_name", "level"]
    rows = decisions(spark, d)
    manifest = rows.groupBy(*keys).agg(F.min("task_key").alias("text"))
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    return rows.alias("a").join(manifest.alias("b"), on).select("a.decision_id", "b.text")


@query("""WITH t AS (SELECT DISTINCT text_sha256, length(text) AS n FROM texts), v AS (SELECT DISTINCT text_sha256 FROM vectors WHERE len(vec32) = 64), w AS (SELECT DISTINCT text_sha256 FROM vectors)
SELECT CASE WHEN v.text_sha256 IS NOT NULL THEN 'store' WHEN w.text_sha256 IS NOT NULL THEN 'again' ELSE 'compute' END AS tier, count(*) AS texts, sum(n)::bigint AS chars FROM t LEFT JOIN v USING (text_sha256) LEFT JOIN w USING (text_sha256) GROUP BY 1""")
def lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Where the vector of each text comes from: stored, stored but unusable, or still to be computed."""
    texts = read(spark, d, "texts").select("text_sha256", F.length("text").alias("n")).distinct()
    stored = read(spark, d, "vectors").groupBy("text_sha256").agg(F.bool_or(F.coalesce(F.size("vec32") == 64, F.lit(False))).alias("good"))
    tier = F.when(F.col("good"), "store").when(F.col("good").isNotNull(), "again").otherwise("compute")
    return texts.join(stored, "text_sha256", "left").groupBy(tier.alias("tier")).agg(F.count("*").alias("texts"), F.sum("n").cast("long").alias("chars"))


@query(f"""WITH {ITEMS}, s AS (SELECT task, card FROM items GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT label) = 2) SELECT items.task, count(*) AS n, count(DISTINCT items.card) AS folds, count(DISTINCT key) AS keys FROM items JOIN s USING (task, card) GROUP BY items.task""")
def folds_with_both_labels(spark: SparkSession, d: str) -> DataFrame:
    """Items of the folds that have both labels."""
    rows = write_out(items(spark, d), "items")
    some = rows.groupBy("task", "card").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).where("n >= 2 and k = 2").select("task", "card")
    return rows.join(some, ["task", "card"]).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("card").alias("folds"), F.count_distinct("key").alias("keys"))


@query("""WITH c AS (SELECT DISTINCT card, col_pos, coalesce(name, '') AS n, left(coalesce(description, ''), 300) AS t, coalesce(unit, '') AS u, left(coalesce(profile, ''), 300) AS p FROM column_info WHERE card IS NOT NULL)
SELECT card, col_pos, sha256('{"card":' || to_json(card) || ',"column":{"description":' || to_json(t) || ',"name":' || to_json(n) || ',"profile":' || to_json(p) || ',"unit":' || to_json(u) || '}}') AS sha FROM c""")
def built_states(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the nested states of columns, long texts cut, keys in order."""
    get = lambda c: F.coalesce(F.col(c), F.lit(""))
    inner = F.struct(F.left(get("description"), F.lit(300)).alias("description"), get("name").alias("name"), F.left(get("profile"), F.lit(300)).alias("profile"), get("unit").alias("unit"))
    rows = read(spark, d, "column_info").where("card is not null")
    return rows.select("card", "col_pos", F.sha2(F.to_json(F.struct("card", inner.alias("column"))), 256).alias("sha")).distinct()


@query(f"""WITH d AS ({DEC}), f AS (SELECT task_id, framing_id, avg(-ln(greatest(p_fit, 1e-12))) AS nll, avg(latency_ms) AS cost, count(*) AS n FROM d WHERE p_fit IS NOT NULL AND NOT isnan(p_fit) GROUP BY ALL),
b AS (SELECT *, min(nll) OVER (PARTITION BY task_id) AS best FROM f), e AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY cost NULLS LAST, framing_id) AS r FROM b WHERE nll <= best + 0.05) SELECT task_id, framing_id, n, round(nll, 6) AS nll, round(nll, 9) > round(best, 9) AS cheaper FROM e WHERE r = 1""")
def framing_by_loss_and_cost(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest framing of each task among those whose loss is within 0.05 of the best, and whether another one has less loss."""
    per = decisions(spark, d).where(number("p_fit").isNotNull()).groupBy("task_id", "framing_id").agg(F.avg(-F.ln(F.greatest("p_fit", F.lit(1e-12)))).alias("nll"), F.avg("latency_ms").alias("cost"), F.count("*").alias("n"))
    per = write_out(per, "framings")
    best = per.groupBy("task_id").agg(F.min("nll").alias("best"))
    near = per.join(best, "task_id").where(F.col("nll") <= F.col("best") + 0.05)
    one = select.first_per_key(near, ["task_id"], [F.asc_nulls_last("cost"), F.asc("framing_id")])
    return one.select("task_id", "framing_id", "n", F.round("nll", 6).alias("nll"), (F.round("nll", 9) > F.round("best", 9)).alias("cheaper"))


@query(f"""WITH d AS ({DEC}), o AS ({OPT}), a AS (SELECT d.decision_id, answer_index, o.rank AS chosen FROM d JOIN o ON o.decision_id = d.decision_id AND option_index = answer_index WHERE outcome = 'human' AND answer_index >= 0)
SELECT o.decision_id, option_index, CASE WHEN option_index = answer_index THEN 'Yes' ELSE 'No' END AS label, CASE WHEN option_index = answer_index THEN 1.0 ELSE 0.7 END::double AS weight FROM o JOIN a USING (decision_id) WHERE option_index = answer_index OR (NOT coalesce(masked, FALSE) AND o.rank < chosen)""")
def feedback_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label rows from people's choices: Yes for the chosen option, No for those that the search had put before it."""
    rows = options(spark, d).select("decision_id", "option_index", "rank", "masked")
    asked = decisions(spark, d).where("outcome = 'human' and answer_index >= 0").select("decision_id", "answer_index")
    chosen = asked.join(rows.select("decision_id", F.col("option_index").alias("answer_index"), F.col("rank").alias("chosen")), ["decision_id", "answer_index"])
    # A decision's side is one row; AQE splits the options of a hot one.
    both = rows.join(chosen, "decision_id")
    yes = F.col("option_index") == F.col("answer_index")
    told = both.where(yes | (~F.coalesce("masked", F.lit(False)) & F.coalesce(F.col("rank") < F.col("chosen"), F.lit(False))))
    return told.select("decision_id", "option_index", F.when(yes, "Yes").otherwise("No").alias("label"), F.when(yes, 1.0).otherwise(0.7).alias("weight"))


@query(f"""WITH {_BASE}, t AS (SELECT CASE WHEN regexp_matches(card, '^DP[0-9][.][0-9]{{5}}[.][0-9]{{3}}') THEN regexp_extract(card, '^(DP[0-9][.][0-9]{{5}}[.][0-9]{{3}})', 1) ELSE card END AS product, CASE label_source WHEN 'teacher' THEN 0.5 ELSE 0.3 END AS w FROM base WHERE label_source LIKE 'teacher%' AND trim(coalesce(card, '')) <> '')
SELECT p.product, (SELECT count(*) FROM t) - count(*) AS n, round((SELECT sum(w) FROM t) - sum(p.w), 6)::double AS weight FROM t p GROUP BY p.product""")
def teacher_rows_per_fold(spark: SparkSession, d: str) -> DataFrame:
    """Teacher rows, weighted by source, that may train the fold of each product: all but its own, by subtraction."""
    rows = labels(spark, d).where("label_source like 'teacher%' and trim(coalesce(card, '')) <> ''")
    own = write_out(rows.groupBy(text.product_of(F.col("card")).alias("product")).agg(F.count("*").alias("k"), F.sum(F.when(F.col("label_source") == "teacher", 0.5).otherwise(0.3)).alias("w")), "own")
    total = own.agg(F.sum("k").alias("all_k"), F.sum("w").alias("all_w"))
    return own.crossJoin(F.broadcast(total)).select("product", (F.col("all_k") - F.col("k")).alias("n"), F.round(F.col("all_w") - F.col("w"), 6).alias("weight"))


@query(f"""WITH d AS ({DEC}), a AS (SELECT latency_ms, row_number() OVER (PARTITION BY group_id ORDER BY seq, decision_id) = 1 AS first FROM d WHERE group_id IS NOT NULL AND latency_ms IS NOT NULL AND NOT isnan(latency_ms))
SELECT first, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM a GROUP BY first""")
def latency_of_first_asks(spark: SparkSession, d: str) -> DataFrame:
    """Latencies of the first and of the further questions of a group; only the first one's place is needed, no ranking."""
    rows = decisions(spark, d).where(F.col("group_id").isNotNull() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")).select("group_id", "seq", "decision_id", "latency_ms")
    first = rows.groupBy("group_id").agg(F.min(F.struct("seq", "decision_id")).alias("f")).select("group_id", F.col("f.decision_id").alias("one"))
    asks = rows.join(first, "group_id").select((F.col("decision_id") == F.col("one")).alias("first"), "latency_ms")
    return asks.groupBy("first").agg(F.count("*").alias("n"), F.round(F.percentile("latency_ms", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95"))


@query(f"""{PRED.replace('WITH', 'WITH RECURSIVE', 1)}, per AS (SELECT count(*) AS n, sum((NOT correct)::int) AS e, count(DISTINCT grp) AS cards FROM scored), {_upper('per')}
SELECT per.n, per.e::bigint AS errors, cards, round(upper, 9) AS upper, per.n >= 50 AND cards >= 3 AS enough FROM per JOIN u ON u.e = per.e AND u.n = per.n""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Errors, cards and the exact upper bound of the error rate."""
    return _audit(predictions(spark, d), [])


@query(_by_task("audit_report"))
def audit_report_by_task(spark: SparkSession, d: str) -> DataFrame:
    return _audit(all_predictions(spark, d), ["task"])


def _audit(rows: DataFrame, by: list[str]) -> DataFrame:
    per = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("errors"), F.count_distinct("grp").alias("cards"))
    return per.select(*by, "n", "errors", "cards", F.round(resample.binomial_upper(F.col("errors"), F.col("n")), 9).alias("upper"), ((F.col("n") >= 50) & (F.col("cards") >= 3)).alias("enough"))


@query(f"""WITH d AS ({DEC}), o AS ({OPT}), k AS (SELECT decision_id, count(*) AS n, count(*) FILTER (NOT coalesce(masked, FALSE)) AS open, sum(CASE WHEN isnan(prob) THEN NULL ELSE prob END) AS total FROM o GROUP BY decision_id), j AS (SELECT d.*, k.n, k.open, k.total FROM d LEFT JOIN k USING (decision_id))
SELECT 'k_differs' AS rule, count(*) FILTER (n <> k) AS n FROM j UNION ALL SELECT 'no_options', count(*) FILTER (n IS NULL) FROM j UNION ALL SELECT 'answer_but_all_masked', count(*) FILTER (open = 0 AND answer_index >= 0) FROM j UNION ALL SELECT 'prob_above_one', count(*) FILTER (total > 1.001) FROM j
UNION ALL SELECT 'unknown_parent', (SELECT count(*) FROM d WHERE parent_decision_id IS NOT NULL AND parent_decision_id NOT IN (SELECT decision_id FROM d)) UNION ALL SELECT 'site_without_code', count(*) FILTER (scope = 'site' AND coalesce(site_code, '') = '') FROM j UNION ALL SELECT 'column_without_name', count(*) FILTER (scope = 'column' AND coalesce(column_name, '') = '') FROM j""")
def cross_table_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules between decisions, their options and their parents."""
    per = options(spark, d).groupBy("decision_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("masked", F.lit(False))).alias("open"), F.sum(number("prob")).alias("total"))
    rows = decisions(spark, d)
    known = rows.select(F.col("decision_id").alias("parent_decision_id"), F.lit(True).alias("there"))
    j = rows.join(per, "decision_id", "left").join(known, "parent_decision_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "k_differs": F.col("n") != F.col("k"), "no_options": F.col("n").isNull(), "answer_but_all_masked": (F.col("open") == 0) & (F.col("answer_index") >= 0), "prob_above_one": F.col("total") > 1.001,
        "unknown_parent": F.col("parent_decision_id").isNotNull() & F.col("there").isNull(), "site_without_code": (F.col("scope") == "site") & blank("site_code"), "column_without_name": (F.col("scope") == "column") & blank("column_name"),
    }
    return j.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "n")
