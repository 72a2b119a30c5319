"""Run tables: decisions, their options, texts and vectors; joins, selections, reports, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, select
from ..runtime import bounded_broadcast, read, write_out
from .registry import query

DEC = "SELECT DISTINCT * FROM decisions"
# The best version of an option: redelivered rows may have lost their numbers.
OPT = """SELECT * EXCLUDE (v) FROM (SELECT *, row_number() OVER (PARTITION BY decision_id, option_index
  ORDER BY rank IS NULL, s_c IS NULL OR isnan(s_c), p_fit IS NULL OR isnan(p_fit), prob IS NULL OR isnan(prob), raw_prob IS NULL OR isnan(raw_prob)) AS v FROM decision_options) WHERE v = 1"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "decisions").dropDuplicates(["decision_id"])


def options(spark: SparkSession, d: str) -> DataFrame:
    """One version of every option, the one with the most numbers."""
    gone = lambda c: F.col(c).isNull() | F.isnan(c)
    order = [F.col("rank").isNull(), gone("s_c"), gone("p_fit"), gone("prob"), gone("raw_prob")]
    return select.first_per_key(read(spark, d, "decision_options"), ["decision_id", "option_index"], order)


def links(spark: SparkSession, d: str) -> DataFrame:
    """Proposals kept as links: one for each decision that was written or proposed, on the path of its run and column."""
    kept = decisions(spark, d).where(F.col("outcome").isin("auto", "proposed"))
    path = F.concat_ws("/", F.col("run_id"), F.coalesce("column_name", "site_code", F.lit("")))
    return kept.select(F.concat(F.lit("l-"), F.col("decision_id")).alias("link_id"), "decision_id", "run_id", path.alias("path"), F.when(F.col("outcome") == "auto", "recorded").otherwise("pending").alias("write_status"), F.col("answer").alias("curie"))


LINKS = f"""d AS ({DEC}), links AS (SELECT 'l-' || decision_id AS link_id, decision_id, run_id, run_id || '/' || coalesce(column_name, site_code, '') AS path,
CASE WHEN outcome = 'auto' THEN 'recorded' ELSE 'pending' END AS write_status, answer AS curie FROM d WHERE outcome IN ('auto', 'proposed'))"""


@query("SELECT decision_id, task_id, method, confidence FROM decisions WHERE task_id = 'term.fits' AND confidence >= 0.8 AND level = 'probe'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "decisions").where((F.col("task_id") == "term.fits") & (F.col("confidence") >= 0.8) & (F.col("level") == "probe"))
    return rows.select("decision_id", "task_id", "method", "confidence")


@query("SELECT label_id, card, json_extract_string(state_json, '$.column.name') AS column_name, json_extract_string(state_json, '$.column.unit') AS unit, json_extract_string(state_json, '$.aspect') AS aspect FROM labels")
def json_state_extract(spark: SparkSession, d: str) -> DataFrame:
    """Typed fields of a JSON column under an explicit schema; what doesn't parse is null."""
    state = F.from_json("state_json", "aspect string, column struct<name:string,unit:string>")
    return read(spark, d, "labels").select("label_id", "card", state).select("label_id", "card", F.col("from_json(state_json).column.name").alias("column_name"), F.col("from_json(state_json).column.unit").alias("unit"), F.col("from_json(state_json).aspect").alias("aspect"))


@query("""SELECT label_id, task_id, weight FROM labels WHERE task_id = 'term.fits' AND weight >= 0.5
AND card NOT IN (SELECT card FROM cards WHERE card LIKE 'DP5%') AND label_source IN ('curator', 'gold', 'consensus_all') AND card IS NOT NULL""")
def in_notin_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").where((F.col("task_id") == "term.fits") & (F.col("weight") >= 0.5) & F.col("label_source").isin("curator", "gold", "consensus_all") & F.col("card").isNotNull())
    out = read(spark, d, "cards").where("card like 'DP5%'").select("card")
    return rows.join(out, "card", "left_anti").select("label_id", "task_id", "weight")


@query("""WITH r AS (SELECT run_id, min(ts) AS started_at, count(DISTINCT decision_id) AS n FROM decisions GROUP BY run_id)
SELECT run_id, started_at, n FROM r WHERE started_at >= TIMESTAMP '2024-02-01' AND n >= 2 ORDER BY started_at DESC, run_id LIMIT 20""")
def optional_filter_order_limit(spark: SparkSession, d: str) -> DataFrame:
    """The 20 latest runs under optional filters; the sort is a top-k, not a total order."""
    runs = read(spark, d, "decisions").groupBy("run_id").agg(F.min("ts").alias("started_at"), F.count_distinct("decision_id").alias("n"))
    wanted = {"since": F.col("started_at") >= F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), "least": F.col("n") >= 2}
    for test in wanted.values():
        runs = runs.where(test)
    return runs.orderBy(F.desc("started_at"), "run_id").limit(20)


@query("SELECT c.card, col_pos, name FROM column_info c WHERE c.card IN (SELECT card FROM cards WHERE n_rows > 50000)")
def semi_join_param_list(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "cards").where("n_rows > 50000").select("card")
    return read(spark, d, "column_info").join(ids, "card", "left_semi").select("card", "col_pos", "name")


@query("SELECT count(*) AS n, count(DISTINCT task_id) AS tasks FROM labels")
def row_and_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"))


@query("SELECT DISTINCT task_id, method FROM decisions")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "decisions").select("task_id", "method").distinct()


@query(f"WITH {LINKS} SELECT link_id, path, write_status, task_id, level, round(confidence, 9) AS confidence FROM links LEFT JOIN d USING (decision_id) WHERE path LIKE '%a%'")
def left_join_decisions_for_path(spark: SparkSession, d: str) -> DataFrame:
    rows = links(spark, d).where(F.col("path").contains("a"))
    facts = decisions(spark, d).select("decision_id", "task_id", "level", "confidence")
    return rows.join(facts, "decision_id", "left").select("link_id", "path", "write_status", "task_id", "level", F.round("confidence", 9).alias("confidence"))


@query(f"WITH d AS ({DEC}), o AS ({OPT}) SELECT o.decision_id, option_index, option_key, rank AS search_rank FROM o WHERE decision_id IN (SELECT decision_id FROM d WHERE run_id <= '4')")
def options_for_runs(spark: SparkSession, d: str) -> DataFrame:
    """Options of the runs below an id: only the run's decisions are needed, so the join is a semi-join."""
    wanted = decisions(spark, d).where("run_id <= '4'").select("decision_id")
    return options(spark, d).join(wanted, "decision_id", "left_semi").select("decision_id", "option_index", "option_key", F.col("rank").alias("search_rank"))


@query("""SELECT t.text_sha256, t.truncated, v.text_sha256 IS NOT NULL AS has_vector FROM (SELECT DISTINCT text_sha256, truncated FROM texts) t
LEFT JOIN (SELECT DISTINCT text_sha256 FROM vectors WHERE vec32 IS NOT NULL) v USING (text_sha256) WHERE t.truncated OR v.text_sha256 IS NOT NULL""")
def known_texts(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "vectors").where("vec32 is not null").select("text_sha256", F.lit(True).alias("v")).distinct()
    rows = read(spark, d, "texts").select("text_sha256", "truncated").distinct().join(have, "text_sha256", "left")
    return rows.where("truncated or v").select("text_sha256", "truncated", F.coalesce("v", F.lit(False)).alias("has_vector"))


@query("""SELECT text_sha256, length(any_value(text)) AS n_text, max(fp16_cos) AS fp16_cos FROM vectors JOIN texts USING (text_sha256) GROUP BY text_sha256""")
def vectors_with_texts(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "vectors").select("text_sha256", "fp16_cos").join(read(spark, d, "texts").select("text_sha256", F.length("text").alias("n_text")), "text_sha256")
    return joined.groupBy("text_sha256").agg(F.first("n_text").alias("n_text"), F.max("fp16_cos").alias("fp16_cos"))


@query("SELECT DISTINCT text_sha256 FROM texts WHERE text_sha256 NOT IN (SELECT text_sha256 FROM vectors WHERE vec32 IS NOT NULL AND len(vec32) = 64)")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "vectors").where("vec32 is not null and size(vec32) = 64").select("text_sha256")
    return read(spark, d, "texts").select("text_sha256").distinct().join(have, "text_sha256", "left_anti")


@query("""WITH v AS (SELECT text_sha256, min(lock_sha) AS lock_sha FROM vectors GROUP BY 1), r AS (SELECT text_sha256, min(first_seen) AS pos FROM texts GROUP BY 1)
SELECT r.text_sha256, pos, lock_sha, v.text_sha256 IS NULL AS missing FROM r LEFT JOIN v USING (text_sha256)""")
def gather_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A gather by key: the request's place travels as a column, what has no vector is marked."""
    have = read(spark, d, "vectors").groupBy("text_sha256").agg(F.min("lock_sha").alias("lock_sha"), F.lit(True).alias("v"))
    asked = read(spark, d, "texts").groupBy("text_sha256").agg(F.min("first_seen").alias("pos"))
    return asked.join(have, "text_sha256", "left").select("text_sha256", "pos", "lock_sha", F.col("v").isNull().alias("missing"))


_SIDES = """l AS (SELECT DISTINCT target_sha256 AS t, coalesce(option_key, '') AS o, label_source AS s FROM labels WHERE target_sha256 IS NOT NULL),
a AS (SELECT DISTINCT t, o FROM l WHERE s = 'consensus_majority'), b AS (SELECT DISTINCT t, o FROM l WHERE s LIKE 'curator%')"""


@query(f"WITH {_SIDES} SELECT count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) AS matched, count(*) FILTER (b.t IS NULL) AS only_left, count(*) FILTER (a.t IS NULL) AS only_right FROM a FULL JOIN b ON a.t = b.t AND a.o = b.o")
def full_outer_join_report(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").where("target_sha256 is not null").select(F.col("target_sha256").alias("t"), F.coalesce("option_key", F.lit("")).alias("o"), "label_source")
    a = rows.where("label_source = 'consensus_majority'").select("t", "o").distinct().withColumn("a", F.lit(True))
    b = rows.where("label_source like 'curator%'").select("t", "o").distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["t", "o"], "full")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query(f"WITH {_SIDES} SELECT DISTINCT x.label_id FROM labels x WHERE x.label_source = 'teacher' AND EXISTS (SELECT 1 FROM labels y WHERE y.label_source <> 'teacher' AND y.target_sha256 = x.target_sha256 AND coalesce(y.option_key, '') = coalesce(x.option_key, '') AND y.label = x.label)")
def semi_join_surviving(spark: SparkSession, d: str) -> DataFrame:
    """Teacher labels that another source confirms: same target, option and label."""
    rows = read(spark, d, "labels").withColumn("o", F.coalesce("option_key", F.lit("")))
    others = rows.where("label_source <> 'teacher'").select("target_sha256", "o", "label").distinct()
    return rows.where("label_source = 'teacher'").join(others, ["target_sha256", "o", "label"], "left_semi").select("label_id").distinct()


@query(f"WITH d AS ({DEC}) SELECT a.decision_id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.parent_decision_id = a.decision_id)")
def self_anti_join_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that no later decision names as its parent."""
    rows = decisions(spark, d)
    parents = rows.where("parent_decision_id is not null").select(F.col("parent_decision_id").alias("decision_id"))
    return rows.join(parents, "decision_id", "left_anti").select("decision_id")


@query(f"""WITH d AS ({DEC}), o AS ({OPT}), j AS (SELECT d.group_id, o.decision_id, option_index, option_key, rank,
  row_number() OVER (PARTITION BY d.group_id ORDER BY (o.p_fit IS NULL OR isnan(o.p_fit)), CASE WHEN isnan(o.p_fit) THEN NULL ELSE o.p_fit END DESC, rank NULLS LAST, option_index, o.decision_id) AS place
  FROM d JOIN o USING (decision_id) WHERE d.group_id IS NOT NULL AND NOT coalesce(masked, FALSE))
SELECT group_id, place, decision_id, option_index, option_key FROM j WHERE place <= 3""")
def explain_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three best options of each group over all its decisions, without masked ones."""
    rows = decisions(spark, d).where("group_id is not null").select("decision_id", "group_id")
    fit = F.when(~F.isnan("p_fit"), F.col("p_fit"))
    joined = options(spark, d).where(~F.coalesce("masked", F.lit(False))).join(rows, "decision_id")
    order = [fit.isNull(), fit.desc(), F.asc_nulls_last("rank"), F.asc("option_index"), F.asc("decision_id")]
    return select.top_per_key(joined, ["group_id"], order, 3).select("group_id", "place", "decision_id", "option_index", "option_key")


@query(f"""WITH d AS ({DEC}) SELECT run_id, count(*) AS decisions, count(DISTINCT group_id) AS groups_, count(*) FILTER (outcome = 'auto') AS auto, count(*) FILTER (outcome = 'proposed') AS proposed,
min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY run_id""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return decisions(spark, d).groupBy("run_id").agg(F.count("*").alias("decisions"), F.count_distinct("group_id").alias("groups_"), is_("auto"), is_("proposed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH d AS ({DEC}) SELECT run_id, round(date_diff('microsecond', min(ts), TIMESTAMP '2026-01-01') / 86400e6, 6) AS age_days FROM d GROUP BY run_id""")
def run_age_days(spark: SparkSession, d: str) -> DataFrame:
    now = F.unix_micros(F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return decisions(spark, d).groupBy("run_id").agg(F.round((now - F.unix_micros(F.min("ts").cast("timestamp"))) / 86400e6, 6).alias("age_days"))


@query("""SELECT coalesce(task_id, '') AS task, label_source, label, grouping(label_source) AS no_source, grouping(label) AS no_label, count(*) AS n
FROM labels GROUP BY GROUPING SETS ((task_id), (task_id, label_source), (task_id, label))""")
def marginals_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Three marginals in one pass."""
    rows = read(spark, d, "labels").select("task_id", "label_source", "label")
    sets = rows.groupingSets([["task_id"], ["task_id", "label_source"], ["task_id", "label"]], "task_id", "label_source", "label")
    return sets.agg(F.coalesce("task_id", F.lit("")).alias("task"), F.grouping("label_source").cast("long").alias("no_source"), F.grouping("label").cast("long").alias("no_label"), F.count("*").alias("n")).select("task", "label_source", "label", "no_source", "no_label", "n")


@query("SELECT task_id, label_source, label, weight, fold_eligible, count(*) AS n FROM labels GROUP BY ALL")
def group_by_all_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").groupBy("task_id", "label_source", "label", "weight", "fold_eligible").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (truncated) AS cut, coalesce(sum(tokens), 0)::bigint AS tokens, max(tokens) AS most, round(quantile_cont(tokens, 0.5), 6) AS p50, round(quantile_cont(tokens, 0.95), 6) AS p95 FROM texts""")
def filtered_aggs_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("tokens", F.lit(p)), 6)
    return read(spark, d, "texts").agg(F.count("*").alias("n"), F.count_if("truncated").alias("cut"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("most"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query(f"""WITH d AS ({DEC}) SELECT task_id, count(latency_ms) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM d WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY task_id""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = decisions(spark, d).where("latency_ms is not null and not isnan(latency_ms)")
    q = lambda p: F.round(F.percentile("latency_ms", F.lit(p)), 6)
    return rows.groupBy("task_id").agg(F.count("latency_ms").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"))


_L = "base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY label_id) AS copy FROM labels) WHERE copy = 1)"
_KEY = "task_key, target_sha256, coalesce(option_key, ''), label_source"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").dropDuplicates(["label_id"]).withColumn("option_key", F.coalesce("option_key", F.lit("")))


KEY = ["task_key", "target_sha256", "option_key", "label_source"]


@query(f"""WITH {_L}, old AS (SELECT * FROM base WHERE created_at < TIMESTAMP '2025-01-01'), new AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at NULLS LAST, label_id) AS n FROM base WHERE created_at >= TIMESTAMP '2025-01-01' OR created_at IS NULL)
SELECT label_id FROM new WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.task_key = new.task_key AND old.target_sha256 = new.target_sha256 AND coalesce(old.option_key, '') = coalesce(new.option_key, '') AND old.label_source = new.label_source)""")
def first_wins_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Late labels appended to the early ones: the first of each natural key, if the key is new."""
    rows, cut = _labels(spark, d), F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    old, new = rows.where(F.col("created_at") < cut), rows.where((F.col("created_at") >= cut) | F.col("created_at").isNull())
    return select.insert_ignore(old, new, KEY, [F.asc_nulls_last("created_at"), F.asc("label_id")]).select("label_id")


@query(f"""WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY weight DESC NULLS LAST, created_at DESC NULLS LAST, label_id) AS n FROM base) SELECT label_id, weight FROM r WHERE n = 1""")
def upsert_highest_weight_latest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last("weight"), F.desc_nulls_last("created_at"), F.asc("label_id")]
    return select.first_per_key(_labels(spark, d), KEY, order).select("label_id", "weight")


@query(f"""WITH {_L}, r AS (SELECT *, coalesce(option_key, '') AS opt, first_value(label) OVER (PARTITION BY task_key, target_sha256, coalesce(option_key, '') ORDER BY created_at NULLS LAST, label_id) AS fl FROM base)
SELECT task_key, target_sha256, opt AS option_key, (count(*) - 1)::bigint AS collapsed, count(*) FILTER (label IS DISTINCT FROM fl) AS conflicting FROM r GROUP BY ALL""")
def collapse_conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("created_at").isNull(), F.col("created_at"), F.col("label_id")]
    return select.collapse_report(_labels(spark, d), KEY[:3], order, "label")


@query(f"""WITH {_L}, v AS (SELECT target_sha256, coalesce(option_key, '') AS opt, count(DISTINCT label_source) AS voters, count(DISTINCT label_source) FILTER (label = 'Yes') AS yes FROM base WHERE label IN ('Yes', 'No') GROUP BY ALL)
SELECT target_sha256, opt AS option_key, voters, yes, CASE WHEN yes = voters THEN 'all' WHEN 2 * yes > voters THEN 'majority' ELSE 'negative' END AS consensus FROM v""")
def consensus_votes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources per target and option that say yes, against all that voted."""
    rows = _labels(spark, d).where(F.col("label").isin("Yes", "No"))
    per = rows.groupBy("target_sha256", "option_key", "label_source").agg(F.bool_or(F.col("label") == "Yes").alias("y"))
    votes = per.groupBy("target_sha256", "option_key").agg(F.count("*").alias("voters"), F.count_if("y").alias("yes"))
    return votes.withColumn("consensus", F.when(F.col("yes") == F.col("voters"), "all").when(2 * F.col("yes") > F.col("voters"), "majority").otherwise("negative"))


@query(f"""WITH {_L}, c AS (SELECT target_sha256, label, count(*) AS n, min(struct_pack(a := created_at IS NULL, b := coalesce(created_at, TIMESTAMP '1970-01-01'), c := label_id)) AS f FROM base GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target_sha256 ORDER BY n DESC, f) AS p FROM c) SELECT target_sha256, label, n FROM r WHERE p = 1""")
def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of each target, ties to the one seen first."""
    seen = F.struct(F.col("created_at").isNull().alias("a"), F.coalesce("created_at", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))).alias("b"), F.col("label_id").alias("c"))
    counts = _labels(spark, d).groupBy("target_sha256", "label").agg(F.count("*").alias("n"), F.min(seen).alias("f"))
    return select.first_per_key(counts, ["target_sha256"], [F.desc("n"), F.asc("f")]).select("target_sha256", "label", "n")


@query(f"""WITH d AS ({DEC}), gone AS (SELECT decision_id FROM d WHERE run_id <= '8') SELECT (SELECT count(*) FROM d WHERE decision_id NOT IN (SELECT decision_id FROM gone)) AS decisions,
(SELECT count(*) FROM ({OPT}) o WHERE decision_id NOT IN (SELECT decision_id FROM gone)) AS options""")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays of decisions and options when runs are deleted, children by their parents' ids."""
    rows = decisions(spark, d)
    gone = rows.where("run_id <= '8'").select("decision_id")
    left = rows.join(gone, "decision_id", "left_anti").agg(F.count("*").alias("decisions"))
    kept = options(spark, d).join(gone, "decision_id", "left_anti").agg(F.count("*").alias("options"))
    return left.crossJoin(F.broadcast(kept))


@query(f"""WITH {LINKS}, upd AS (SELECT link_id, 'written' AS new_status FROM links WHERE curie LIKE 'ENVO%') SELECT link_id, coalesce(new_status, write_status) AS write_status FROM links LEFT JOIN upd USING (link_id)""")
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    """An update by key list: the new value where there is one, the old one elsewhere."""
    rows = links(spark, d)
    new = rows.where("curie like 'ENVO%'").select("link_id", F.lit("written").alias("new_status"))
    return rows.join(new, "link_id", "left").select("link_id", F.coalesce("new_status", "write_status").alias("write_status"))


@query(f"""WITH r AS (SELECT task_id, sha256('{{"label":' || to_json(coalesce(label, '')) || ',"label_id":' || to_json(label_id) || ',"target_sha256":' || to_json(coalesce(target_sha256, '')) || '}}') AS h FROM labels),
s AS (SELECT task_id, count(*) AS n_rows, {', '.join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::varchar AS s{i}" for i in range(8))} FROM r GROUP BY task_id)
SELECT task_id, n_rows, sha256(concat_ws(',', n_rows::varchar, {', '.join(f's{i}' for i in range(8))})) AS digest FROM s""")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return select.digest(read(spark, d, "labels"), ["label_id", "label", "target_sha256"], ["task_id"])


@query(f"""WITH d AS ({DEC}), o AS ({OPT}) SELECT 'decision_without_run' AS rule, count(*) AS n FROM d WHERE run_id IS NULL
UNION ALL SELECT 'p_fit_outside', count(*) FROM o WHERE NOT isnan(p_fit) AND (p_fit < 0 OR p_fit > 1)
UNION ALL SELECT 'answer_beyond_options', count(*) FROM d WHERE answer_index >= k
UNION ALL SELECT 'masked_with_prob', count(*) FROM o WHERE masked AND prob > 0 AND NOT isnan(prob)""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows against the tables' rules, one aggregate per table."""
    a = decisions(spark, d).agg(F.count_if(F.col("run_id").isNull()).alias("decision_without_run"), F.count_if(F.col("answer_index") >= F.col("k")).alias("answer_beyond_options"))
    number = ~F.isnan("p_fit") & ((F.col("p_fit") < 0) | (F.col("p_fit") > 1))
    b = options(spark, d).agg(F.count_if(number).alias("p_fit_outside"), F.count_if(F.col("masked") & (F.col("prob") > 0) & ~F.isnan("prob")).alias("masked_with_prob"))
    names = ["decision_without_run", "answer_beyond_options", "p_fit_outside", "masked_with_prob"]
    return a.crossJoin(F.broadcast(b)).unpivot([], names, "rule", "n")


@query("""SELECT task_id, count(*) AS n, count(DISTINCT card) AS cards, count(DISTINCT target_sha256) AS targets FROM labels GROUP BY task_id HAVING count(DISTINCT card) >= 3""")
def report_by_task(spark: SparkSession, d: str) -> DataFrame:
    got = read(spark, d, "labels").groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("card").alias("cards"), F.count_distinct("target_sha256").alias("targets"))
    return got.where("cards >= 3")


@query(f"""WITH {_L}, s AS (SELECT task_id, quantile_cont(weight, 0.9) AS q FROM base WHERE weight IS NOT NULL GROUP BY task_id)
SELECT label_id, CASE WHEN weight >= q THEN 'top' ELSE 'rest' END AS stratum FROM base JOIN s USING (task_id) WHERE weight IS NOT NULL""")
def quantile_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).where("weight is not null")
    cut = write_out(rows.groupBy("task_id").agg(F.percentile("weight", F.lit(0.9)).alias("q")), "cuts")
    return rows.join(bounded_broadcast(cut), "task_id").select("label_id", F.when(F.col("weight") >= F.col("q"), "top").otherwise("rest").alias("stratum"))


@query(f"""WITH {_L}, r AS (SELECT task_id, card, label_id, md5('7' || label_id) AS h FROM base WHERE trim(card) <> ''),
s AS (SELECT *, row_number() OVER (PARTITION BY task_id, card ORDER BY h, label_id) AS in_card FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY in_card, h, label_id) AS place FROM s)
SELECT task_id, label_id, card FROM t WHERE place <= 20""")
def stratified_spanning_draw(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 20 labels a task that span its cards before a card gives a second one."""
    rows = _labels(spark, d).where("trim(card) <> ''").select("task_id", "card", "label_id", F.md5(F.concat(F.lit("7"), F.col("label_id"))).alias("h"))
    # A card gives at most 20, so the second numbering meets few rows.
    some = select.top_per_key(rows, ["task_id", "card"], [F.asc("h"), F.asc("label_id")], 20, "in_card")
    return select.top_per_key(some, ["task_id"], [F.asc("in_card"), F.asc("h"), F.asc("label_id")], 20).select("task_id", "label_id", "card")


@query(f"""WITH {_L} SELECT count(*) FILTER (d = 0) AS equal_sets, count(*) AS tasks FROM (SELECT task_id, count(*) FILTER (a <> b) AS d FROM (SELECT task_id, target_sha256, max((label_source LIKE 'consensus%')::int) AS a, max((label_source NOT LIKE 'consensus%')::int) AS b FROM base GROUP BY ALL) GROUP BY task_id)""")
def set_equality_of_targets(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose targets are the same set in the consensus and in the other labels."""
    side = F.col("label_source").like("consensus%")
    per = _labels(spark, d).groupBy("task_id", "target_sha256").agg(F.bool_or(side).alias("a"), F.bool_or(~side).alias("b"))
    tasks = per.groupBy("task_id").agg(F.count_if(F.col("a") != F.col("b")).alias("d"))
    return tasks.agg(F.count_if(F.col("d") == 0).alias("equal_sets"), F.count("*").alias("tasks"))


@query(f"""WITH d AS ({DEC}), w AS (SELECT decision_id, group_id, ts, s_c, row_number() OVER (PARTITION BY group_id ORDER BY s_c DESC, decision_id) AS p FROM d WHERE group_id IS NOT NULL AND s_c IS NOT NULL AND NOT isnan(s_c))
SELECT group_id, max(CASE WHEN p = 1 THEN decision_id END) AS winner, round(max(CASE WHEN p = 1 THEN s_c END) - coalesce(max(CASE WHEN p = 2 THEN s_c END), 0), 9) AS margin FROM w GROUP BY group_id""")
def group_margin(spark: SparkSession, d: str) -> DataFrame:
    """The winner of each group and its lead over the runner-up (its own score if it is alone)."""
    rows = decisions(spark, d).where("group_id is not null and s_c is not null and not isnan(s_c)")
    two = select.top_per_key(rows, ["group_id"], [F.desc("s_c"), F.asc("decision_id")], 2)
    first, second = F.max(F.when(F.col("place") == 1, F.col("s_c"))), F.max(F.when(F.col("place") == 2, F.col("s_c")))
    return two.groupBy("group_id").agg(F.max(F.when(F.col("place") == 1, F.col("decision_id"))).alias("winner"), F.round(first - F.coalesce(second, F.lit(0.0)), 9).alias("margin"))


@query(f"""WITH {LINKS}, t AS (SELECT curie, path, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, -1) AS s, link_id, run_id FROM links JOIN (SELECT decision_id, confidence FROM d) USING (decision_id)),
b AS (SELECT run_id, curie, path, min(link_id) AS pos, max(s) AS s FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, pos) AS place FROM b)
SELECT run_id, curie, path, round(s, 9) AS score, place FROM r WHERE place <= 25""")
def dedup_and_cap(spark: SparkSession, d: str) -> DataFrame:
    """One proposal per term and path with its best score, then the 25 best of each run."""
    score = F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(-1.0))
    scored = links(spark, d).join(decisions(spark, d).select("decision_id", score.alias("s")), "decision_id")
    one = scored.groupBy("run_id", "curie", "path").agg(F.min("link_id").alias("pos"), F.max("s").alias("s"))
    return select.top_per_key(one, ["run_id"], [F.desc("s"), F.asc("pos")], 25).select("run_id", "curie", "path", F.round("s", 9).alias("score"), "place")


@query(f"WITH o AS ({OPT}) SELECT decision_id, option_index, row_number() OVER (PARTITION BY decision_id ORDER BY s_c DESC, option_index) AS place FROM o WHERE NOT coalesce(masked, FALSE) AND s_c IS NOT NULL AND NOT isnan(s_c)")
def score_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place of every option in its decision, from sums before its score and its block of indexes: no task holds a decision."""
    rows = options(spark, d).where("not coalesce(masked, false) and s_c is not null and not isnan(s_c)")
    rows = rows.select("decision_id", "option_index", (F.col("s_c") + 0.0).alias("s_c"), F.floor(F.col("option_index") / 1024).alias("block"))
    ties = metrics.tie_groups(rows, ["decision_id"], "s_c", True, n=F.lit(1)).select("decision_id", "s_c", "n_before")
    tie = Window.partitionBy("decision_id", "s_c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("decision_id", "s_c", "block").agg(F.count("*").alias("k"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("k").over(tie), F.lit(0))).join(ties, ["decision_id", "s_c"])
    inside = F.row_number().over(Window.partitionBy("decision_id", "s_c", "block").orderBy("option_index"))
    return rows.join(blocks, ["decision_id", "s_c", "block"]).select("decision_id", "option_index", (F.col("n_before") + F.col("before") + inside).alias("place"))


@query(f"WITH o AS ({OPT}) SELECT upper(split_part(option_key, ':', 1)) AS prefix, count(*) AS n, count(DISTINCT option_key) AS keys FROM o WHERE contains(option_key, ':') GROUP BY ALL")
def options_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = options(spark, d).where(F.contains("option_key", F.lit(":")))
    return rows.groupBy(F.upper(F.split_part("option_key", F.lit(":"), F.lit(1))).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("option_key").alias("keys"))
