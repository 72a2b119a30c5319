"""Reasons, gates, preference lists and texts of decisions and columns; distributions from single fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import metrics, resample, select
from ..runtime import read, write_out
from .arrays import _EMB, embeddings
from .cards import REGISTRY
from .evaluation import ITEMS, PRED, items, labels, loo_sql, predictions
from .registry import query
from .store import DEC, OPT, decisions, options

#: The aspects of a column, in order.
ASPECTS = ["environment", "taxon", "measurement", "unit", "method", "data_type", "location", "other"]
_BASE = "base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY label_id) AS copy FROM labels) WHERE copy = 1)"


def number(c: str) -> Column:
    """The column, null where it is no finite number."""
    v = F.col(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, null if none does."""
    out = None
    for when, reason in cases:
        out = F.when(when, reason) if out is None else out.when(when, reason)
    return out


def all_reasons(*cases: tuple[Column, str]) -> Column:
    """The reasons of all cases that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(when, reason) for when, reason in cases]))


@query(f"""WITH d AS ({DEC}), o AS ({OPT}), m AS (SELECT decision_id, bool_and(coalesce(masked, FALSE)) AS closed FROM o GROUP BY decision_id)
SELECT decision_id, CASE WHEN reason = 'truncated' THEN 'truncated' WHEN closed THEN 'mask_empty' WHEN answer_index < 0 THEN coalesce(reason, 'no_answer')
WHEN confidence IS NULL OR isnan(confidence) THEN 'no_distribution' WHEN answer_index = anchor_index THEN 'anchor_won' END AS why FROM d LEFT JOIN m USING (decision_id)""")
def first_abstain_reason(spark: SparkSession, d: str) -> DataFrame:
    """Why a decision can't be proposed: the most specific reason first."""
    closed = options(spark, d).groupBy("decision_id").agg(F.bool_and(F.coalesce("masked", F.lit(False))).alias("closed"))
    why = first_reason(
        (F.col("reason") == "truncated", F.lit("truncated")), (F.col("closed"), F.lit("mask_empty")), (F.col("answer_index") < 0, F.coalesce("reason", F.lit("no_answer"))),
        (number("confidence").isNull(), F.lit("no_distribution")), (F.col("answer_index") == F.col("anchor_index"), F.lit("anchor_won")),
    )
    return decisions(spark, d).join(closed, "decision_id", "left").select("decision_id", why.alias("why"))


@query(f"""WITH d AS ({DEC}), g AS (SELECT decision_id, list_filter([CASE WHEN level = 'zero_shot' THEN 'zero_shot' END, CASE WHEN calibration = 'uncalibrated' THEN 'uncalibrated' END, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0.5 THEN 'low_confidence' END,
CASE WHEN margin IS NULL OR isnan(margin) OR margin < 0.1 THEN 'low_margin' END, CASE WHEN reason IS NOT NULL THEN 'has_reason' END, CASE WHEN answer_index < 0 THEN 'no_answer' END, CASE WHEN answer_index = anchor_index THEN 'anchor' END], lambda x: x IS NOT NULL) AS g FROM d)
SELECT decision_id, len(g) AS n, array_to_string(g, ',') AS gates FROM g""")
def failing_gates(spark: SparkSession, d: str) -> DataFrame:
    """All gates that a decision fails, in order."""
    gates = all_reasons(
        (F.col("level") == "zero_shot", F.lit("zero_shot")), (F.col("calibration") == "uncalibrated", F.lit("uncalibrated")), (F.coalesce(number("confidence") < 0.5, F.lit(True)), F.lit("low_confidence")),
        (F.coalesce(number("margin") < 0.1, F.lit(True)), F.lit("low_margin")), (F.col("reason").isNotNull(), F.lit("has_reason")), (F.col("answer_index") < 0, F.lit("no_answer")), (F.col("answer_index") == F.col("anchor_index"), F.lit("anchor")),
    )
    return decisions(spark, d).select("decision_id", gates.alias("g")).select("decision_id", F.size("g").cast("long").alias("n"), F.array_join("g", ",").alias("gates"))


@query(f"""WITH d AS ({DEC}), o AS ({OPT}) SELECT d.decision_id, CASE WHEN answer_index < 0 THEN 'no_answer' WHEN answer_index = anchor_index THEN 'anchor_won' WHEN rank IS NULL THEN 'no_rank' WHEN rank <= 3 THEN 'proposed' ELSE 'below_top' END AS verdict
FROM d LEFT JOIN o ON o.decision_id = d.decision_id AND option_index = answer_index""")
def answer_within_top_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Is the answer among the first three of the search? One option meets one decision: no hot key."""
    rank = options(spark, d).select("decision_id", F.col("option_index").alias("answer_index"), "rank")
    rows = decisions(spark, d).select("decision_id", "answer_index", "anchor_index").join(rank, ["decision_id", "answer_index"], "left")
    verdict = F.when(F.col("answer_index") < 0, "no_answer").when(F.col("answer_index") == F.col("anchor_index"), "anchor_won").when(F.col("rank").isNull(), "no_rank").when(F.col("rank") <= 3, "proposed").otherwise("below_top")
    return rows.select("decision_id", verdict.alias("verdict"))


@query(f"""WITH d AS ({DEC}), r(level, place) AS (VALUES ('zero_shot', 0), ('calibrated', 1), ('probe', 2)) SELECT task_id, count(*) FILTER (place >= 1) AS meets, count(*) AS n FROM d LEFT JOIN r USING (level) GROUP BY task_id""")
def level_at_least(spark: SparkSession, d: str) -> DataFrame:
    """Decisions at the level ``calibrated`` or above; an unknown level is below all."""
    place = F.create_map(*[F.lit(x) for x in ("zero_shot", 0, "calibrated", 1, "probe", 2)])
    return decisions(spark, d).groupBy("task_id").agg(F.count_if(F.try_element_at(place, F.col("level")) >= 1).alias("meets"), F.count("*").alias("n"))


@query(f"""WITH {_BASE}, b AS (SELECT DISTINCT card FROM base WHERE bench_card AND trim(card) <> ''), s AS (SELECT DISTINCT card FROM base WHERE label_source LIKE 'consensus%')
SELECT label_id, trim(coalesce(card, '')) = '' OR card IN (SELECT card FROM b) AS held, coalesce(card IN (SELECT card FROM s WHERE card IS NOT NULL), FALSE) AS judged FROM base""")
def held_out_or_blank(spark: SparkSession, d: str) -> DataFrame:
    """Is a label's card one of the held-out cards, where blank counts as held out; has it consensus rows?"""
    rows = labels(spark, d)
    flags = rows.where("trim(coalesce(card, '')) <> ''").groupBy("card").agg(F.bool_or(F.coalesce("bench_card", F.lit(False))).alias("bench"))
    silver = rows.where("card is not null").groupBy("card").agg(F.bool_or(F.col("label_source").like("consensus%")).alias("silver"))
    both = rows.select("label_id", "card").join(flags, "card", "left").join(silver, "card", "left")
    return both.select("label_id", F.coalesce("bench", F.lit(True)).alias("held"), F.coalesce("silver", F.lit(False)).alias("judged"))


_ORDER = f"""{_BASE}, c AS (SELECT label AS aspect, count(*) AS n FROM base WHERE task_id = 'column.aspect' AND label IN ({', '.join(f"'{a}'" for a in ASPECTS)}) GROUP BY label)"""


def prior_order(spark: SparkSession, d: str) -> DataFrame:
    """(order): the aspects by their number of labels, most frequent first; one row."""
    counts = labels(spark, d).where((F.col("task_id") == "column.aspect") & F.col("label").isin(ASPECTS)).groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))), lambda x: x["label"]).alias("order"))


def fallback_aspects(order: Column, has_unit: Column, numeric: Column, cap: int = 2) -> Column:
    """The first ``cap`` aspects of a column without lookup: with a unit or numbers first measurement and unit, then the prior order;
    never taxon or other, a unit only where there is one."""
    head = F.array(F.lit("measurement"), F.lit("unit"))
    listed = F.when(has_unit | numeric, F.array_distinct(F.concat(head, order))).otherwise(order)
    return F.slice(F.filter(listed, lambda a: ~a.isin("taxon", "other") & ((a != "unit") | has_unit)), 1, cap)


_NUM = f"coalesce(regexp_replace(lower(dtype), '[\\s_]', '', 'g') IN ({', '.join(repr(t) for t in text.NUMERIC_TYPES)}), FALSE)"


@query(f"""WITH {_ORDER}, o AS (SELECT coalesce(list(aspect ORDER BY n DESC, aspect), []) AS ord FROM c), x AS (SELECT DISTINCT card, col_pos, dtype, unit FROM column_info),
l AS (SELECT card, col_pos, trim(coalesce(unit, '')) <> '' AS u, CASE WHEN trim(coalesce(unit, '')) <> '' OR {_NUM} THEN list_concat(['measurement', 'unit'], list_filter(ord, lambda a: a NOT IN ('measurement', 'unit'))) ELSE ord END AS l FROM x, o)
SELECT card, col_pos, array_to_string(list_filter(l, lambda a: a NOT IN ('taxon', 'other') AND (a <> 'unit' OR u))[1:2], ',') AS aspects FROM l""")
def fallback_preferences(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "column_info").select("card", "col_pos", "dtype", "unit").distinct().crossJoin(F.broadcast(prior_order(spark, d)))
    got = fallback_aspects(F.col("order"), F.trim(F.coalesce("unit", F.lit(""))) != "", text.is_numeric_type(F.col("dtype")))
    return rows.select("card", "col_pos", F.array_join(got, ",").alias("aspects"))


@query(f"""WITH d AS ({DEC}), o AS ({OPT}), r AS (SELECT decision_id, option_key, row_number() OVER (PARTITION BY decision_id ORDER BY prob DESC, option_index) AS p FROM o WHERE prob IS NOT NULL AND NOT isnan(prob)),
t AS (SELECT decision_id, option_key, p FROM r JOIN d USING (decision_id) WHERE answer_index >= 0 AND p <= CASE WHEN outcome IN ('auto', 'proposed') THEN 1 ELSE 2 END)
SELECT decision_id, string_agg(option_key, ',' ORDER BY p) AS keys FROM t WHERE option_key <> 'other' AND option_key <> '__none__' GROUP BY decision_id""")
def chosen_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    """The most probable option of a proposed decision, the two most probable ones of any other, without the empty ones."""
    two = select.top_per_key(options(spark, d).where(number("prob").isNotNull()).select("decision_id", "option_key", "option_index", "prob"), ["decision_id"], [F.desc("prob"), F.asc("option_index")], 2)
    rows = two.join(decisions(spark, d).where("answer_index >= 0").select("decision_id", "outcome"), "decision_id")
    some = rows.where(F.col("place") <= F.when(F.col("outcome").isin("auto", "proposed"), 1).otherwise(2)).where("option_key not in ('other', '__none__')")
    return some.groupBy("decision_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "option_key"))), lambda x: x["option_key"]), ",").alias("keys"))


@query(f"""WITH d AS ({DEC}), o AS (SELECT * FROM ({OPT}) WHERE p_fit IS NOT NULL AND NOT isnan(p_fit)), a AS (SELECT d.decision_id, o.p_fit AS anchor FROM d JOIN o ON o.decision_id = d.decision_id AND option_index = anchor_index),
c AS (SELECT o.decision_id, option_index, row_number() OVER (PARTITION BY o.decision_id ORDER BY o.p_fit DESC, option_index) AS place FROM o JOIN a USING (decision_id) JOIN d USING (decision_id)
WHERE NOT coalesce(masked, FALSE) AND option_index <> answer_index AND o.p_fit > anchor AND o.p_fit >= 0.3) SELECT decision_id, option_index, place FROM c WHERE place <= 3""")
def runner_ups(spark: SparkSession, d: str) -> DataFrame:
    """The next three options above the anchor and above a threshold."""
    rows = options(spark, d).where(number("p_fit").isNotNull()).select("decision_id", "option_index", "p_fit", "masked")
    asked = decisions(spark, d).select("decision_id", "answer_index", F.col("anchor_index").alias("option_index"))
    anchors = asked.join(rows.select("decision_id", "option_index", F.col("p_fit").alias("anchor")), ["decision_id", "option_index"]).select("decision_id", "answer_index", "anchor")
    # The threshold is applied before the join; AQE splits a hot decision, whose other side is one row.
    above = rows.where("not coalesce(masked, false) and p_fit >= 0.3").join(anchors, "decision_id").where("option_index <> answer_index and p_fit > anchor")
    return select.top_per_key(above, ["decision_id"], [F.desc("p_fit"), F.asc("option_index")], 3).select("decision_id", "option_index", "place")


@query(f"""WITH d AS ({DEC}), k AS (SELECT DISTINCT group_id FROM d WHERE outcome IN ('auto', 'proposed') AND group_id IS NOT NULL AND confidence >= 0.5 AND NOT isnan(confidence))
SELECT run_id, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) FILTER (group_id NOT IN (SELECT group_id FROM k)) AS rejected FROM d WHERE group_id IS NOT NULL GROUP BY run_id""")
def groups_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Groups of each run none of whose proposals stays."""
    keep = F.col("outcome").isin("auto", "proposed") & F.coalesce(number("confidence") >= 0.5, F.lit(False))
    rows = decisions(spark, d).where("group_id is not null")
    kept = rows.groupBy("group_id").agg(F.bool_or(keep).alias("kept"))
    pairs = rows.select("run_id", "group_id").distinct().join(kept, "group_id")
    return pairs.groupBy("run_id").agg(F.count("*").alias("groups"), F.count_if(~F.col("kept")).alias("rejected"))


@query(f"""WITH d AS ({DEC}), s AS (SELECT task_id, level, count(*) AS n, avg(-ln(greatest(p_fit, 1e-12))) AS nll FROM d WHERE p_fit IS NOT NULL AND NOT isnan(p_fit) GROUP BY ALL HAVING count(*) >= 5)
SELECT task_id, level, n, round(nll, 6) AS nll FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(nll, 9), level) AS p FROM s) WHERE p = 1""")
def best_level_by_loss(spark: SparkSession, d: str) -> DataFrame:
    """The level with the least loss of each task among those with five decisions or more, ties by name."""
    rows = decisions(spark, d).where(number("p_fit").isNotNull())
    per = rows.groupBy("task_id", "level").agg(F.count("*").alias("n"), F.avg(-F.ln(F.greatest("p_fit", F.lit(1e-12)))).alias("nll")).where("n >= 5")
    return select.first_per_key(per.withColumn("r", F.round("nll", 9)), ["task_id"], [F.asc("r"), F.asc("level")]).select("task_id", "level", "n", F.round("nll", 6).alias("nll"))


@query(f"""WITH {_BASE}, t AS (SELECT task_id, card, label_id, row_number() OVER (PARTITION BY task_id ORDER BY md5('11' || label_id), label_id) AS place FROM base WHERE trim(card) <> ''),
s AS (SELECT * FROM t WHERE place <= 40), g AS (SELECT task_id FROM s GROUP BY task_id HAVING count(DISTINCT card) >= 3) SELECT task_id, label_id FROM s WHERE task_id IN (SELECT task_id FROM g)""")
def sample_with_enough_cards(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 40 labels a task by hash, refused if they come from fewer than three cards."""
    rows = labels(spark, d).where("trim(card) <> ''").select("task_id", "card", "label_id", F.md5(F.concat(F.lit("11"), F.col("label_id"))).alias("h"))
    some = write_out(select.top_per_key(rows, ["task_id"], [F.asc("h"), F.asc("label_id")], 40), "sample")
    wide = some.groupBy("task_id").agg(F.count_distinct("card").alias("cards")).where("cards >= 3").select("task_id")
    return some.join(wide, "task_id").select("task_id", "label_id")


@query(f"""WITH {ITEMS}, less AS (SELECT DISTINCT task_id AS task, target_sha256 || '|' || opt AS item FROM el WHERE label_source NOT LIKE 'teacher%')
SELECT task, count(*) AS n, count(*) FILTER (less.item IS NOT NULL) AS kept, count(DISTINCT CASE WHEN less.item IS NOT NULL THEN card END) AS folds FROM items LEFT JOIN less USING (task, item) GROUP BY task""")
def subset_without_source(spark: SparkSession, d: str) -> DataFrame:
    """Items and folds that stay when the labels of a source are left out, as a subset of the whole set."""
    every = items(spark, d)
    from .evaluation import BINARY, exclusion

    rest = labels(spark, d).where(F.col("task_id").isin(BINARY) & exclusion().isNull() & ~F.col("label_source").like("teacher%"))
    rest = rest.select(F.col("task_id").alias("task"), F.concat_ws("|", "target_sha256", F.coalesce("option_key", F.lit(""))).alias("item")).distinct().withColumn("kept", F.lit(True))
    both = every.join(rest, ["task", "item"], "left")
    return both.groupBy("task").agg(F.count("*").alias("n"), F.count("kept").alias("kept"), F.count_distinct(F.when(F.col("kept"), F.col("card"))).alias("folds"))


@query("""SELECT item_id, CASE WHEN trim(coalesce(description, '')) = '' THEN label ELSE label || ': ' || left(description, 300) END || CASE WHEN len(synonyms) > 0 THEN ' (' || array_to_string(synonyms[1:5], '; ') || ')' ELSE '' END AS text FROM canonical_items""")
def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of a candidate: label, description cut to 300 characters, the first five synonyms."""
    head = F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.col("label")).otherwise(F.concat("label", F.lit(": "), F.left("description", F.lit(300))))
    names = F.when(F.size("synonyms") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("synonyms", 1, 5), "; "), F.lit(")"))).otherwise(F.lit(""))
    return read(spark, d, "canonical_items").select("item_id", F.concat(head, names).alias("text"))


@query("""SELECT DISTINCT card, col_pos, 'Column ' || coalesce(name, '') || ' (' || coalesce(nullif(trim(unit), ''), dtype, '?') || ') of ' || card || CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE ': ' || left(description, 300) END AS context FROM column_info""")
def context_templates(spark: SparkSession, d: str) -> DataFrame:
    """A template filled with a column's fields; the unit falls back to the type."""
    unit = F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.col("dtype"), F.lit("?"))
    tail = F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit(": "), F.left("description", F.lit(300))))
    return read(spark, d, "column_info").select("card", "col_pos", F.concat(F.lit("Column "), F.coalesce("name", F.lit("")), F.lit(" ("), unit, F.lit(") of "), F.col("card"), tail).alias("context")).distinct()


_STATE = "aspect string, card struct<dataset:string,months:string,sites:array<string>>, column struct<description:string,dtype:string,name:string,profile:string,unit:string>"


@query("""WITH s AS (SELECT DISTINCT state_sha256, state_json AS j FROM labels WHERE json_valid(state_json) AND trim(state_sha256) <> '')
SELECT state_sha256, 'aspect: ' || coalesce(json_extract_string(j, '$.aspect'), '') || chr(10) || 'card:' || chr(10) || '  dataset: ' || coalesce(json_extract_string(j, '$.card.dataset'), '') || chr(10) || '  sites: ' || coalesce(array_to_string(json_extract_string(j, '$.card.sites[*]'), ', '), '')
|| chr(10) || 'column:' || chr(10) || '  name: ' || coalesce(json_extract_string(j, '$.column.name'), '') || chr(10) || '  unit: ' || coalesce(json_extract_string(j, '$.column.unit'), '') || chr(10) || '  profile: ' || left(coalesce(json_extract_string(j, '$.column.profile'), ''), 300) AS text FROM s""")
def state_texts(spark: SparkSession, d: str) -> DataFrame:
    """A nested state as indented text, its profile cut to 300 characters."""
    rows = read(spark, d, "labels").where("trim(state_sha256) <> ''").select("state_sha256", "state_json").distinct()
    rows = rows.select("state_sha256", F.from_json("state_json", _STATE).alias("s")).where("s is not null")
    get = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(""))
    lines = [
        F.concat(F.lit("aspect: "), get("aspect")), F.lit("card:"), F.concat(F.lit("  dataset: "), get("card.dataset")), F.concat(F.lit("  sites: "), F.coalesce(F.array_join("s.card.sites", ", "), F.lit(""))),
        F.lit("column:"), F.concat(F.lit("  name: "), get("column.name")), F.concat(F.lit("  unit: "), get("column.unit")), F.concat(F.lit("  profile: "), F.left(get("column.profile"), F.lit(300))),
    ]
    return rows.select("state_sha256", F.array_join(F.array(*lines), "\n").alias("text"))


@query(f"""WITH d AS ({DEC}) SELECT decision_id, CASE WHEN scope = 'site' THEN 'site' WHEN scope = 'dataset' THEN 'label' END AS pre_rule,
CASE WHEN scope = 'site' AND site_code IS NOT NULL AND site_code <> '' THEN site_code WHEN scope = 'column' AND column_name IS NOT NULL AND column_name <> '' THEN column_name ELSE answer END AS value FROM d""")
def value_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which value a proposal writes: by rule of its scope the site's code or the term, else the column's name; the term where that is missing."""
    pre = F.when(F.col("scope") == "site", "site").when(F.col("scope") == "dataset", "label")
    value = F.when((F.col("scope") == "site") & (F.col("site_code") != ""), F.col("site_code")).when((F.col("scope") == "column") & (F.col("column_name") != ""), F.col("column_name")).otherwise(F.col("answer"))
    return decisions(spark, d).select("decision_id", pre.alias("pre_rule"), value.alias("value"))


@query(r"""WITH x AS (SELECT DISTINCT card, col_pos, name, unit, nullif(trim(regexp_replace(trim(string_split(regexp_extract(profile, '(?s)top:(.*)$', 1), ',')[1]), ' \([^(]*$', '')), '') AS v FROM column_info),
s AS (SELECT DISTINCT u.code FROM (SELECT unnest(sites) AS u FROM cards)) SELECT card, col_pos, CASE WHEN v IS NULL THEN NULL WHEN lower(v) = lower(trim(unit)) THEN 'label' WHEN v IN (SELECT code FROM s) THEN 'site' WHEN v = name THEN 'column' ELSE 'top' END AS kind FROM x""")
def value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What a column's most frequent value is: the unit's label, a site's code, the column's name or a value of its own."""
    rows = read(spark, d, "column_info").select("card", "col_pos", "name", "unit", text.top_profile_value(F.col("profile")).alias("v")).distinct()
    codes = read(spark, d, "cards").select(F.inline("sites")).select(F.col("code").alias("v")).distinct().withColumn("site", F.lit(True))
    both = rows.join(codes, "v", "left")
    kind = F.when(F.col("v").isNull(), None).when(F.lower("v") == F.lower(F.trim("unit")), "label").when(F.col("site"), "site").when(F.col("v") == F.col("name"), "column").otherwise("top")
    return both.select("card", "col_pos", kind.alias("kind"))


@query(f"""WITH {_EMB}, l AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT i, avg(x) AS m FROM l GROUP BY i), z AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM m) ORDER BY i) AS z FROM m),
a AS (SELECT list_transform(v, lambda x: x) AS a FROM e ORDER BY vec_id LIMIT 1) SELECT vec_id, round((list_dot_product(v, z) - list_dot_product(a, z)) / 0.07, 4) AS score FROM e, z, a""")
def mean_context_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every vector at the mean context of length one, less that of the anchor (the first vector), over a temperature."""
    rows = embeddings(spark, d)
    mean = rows.select(F.posexplode("v").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("m")).agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("l"))
    anchor = rows.agg(F.min_by("v", "vec_id").alias("anchor"))
    one = mean.select(vectors.unit(F.col("l.m")).alias("z")).crossJoin(F.broadcast(anchor))
    scored = rows.crossJoin(F.broadcast(one))
    return scored.select("vec_id", F.round((vectors.dot(F.col("v"), F.col("z")) - vectors.dot(F.col("anchor"), F.col("z"))) / 0.07, 4).alias("score"))


def half_precision(x: Column) -> Column:
    """A number rounded to 16-bit floating point (10 bits behind the point, half to even), as a double."""
    size = F.greatest(F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-30)))), F.lit(-14))
    step = F.pow(F.lit(2.0), size - 10)
    return F.rint(x / step) * step


_OK = "len(vec32) = 64 AND len(list_filter(vec32, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec32, lambda x: x <> 0)) > 0"


@query(f"""WITH v AS (SELECT DISTINCT text_sha256, coalesce(lock_sha, '') AS lock, vec32::DOUBLE[] AS v FROM vectors WHERE {_OK}), u AS (SELECT lock, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v),
h AS (SELECT lock, u, list_transform(u, lambda x: round_even(x / power(2.0, greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10), 0) * power(2.0, greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10)) AS h FROM u)
SELECT lock, count(*) AS n, round(min(list_dot_product(u, h) / sqrt(list_dot_product(h, h))), 8) AS worst, min(list_dot_product(u, h) / sqrt(list_dot_product(h, h))) >= 0.9999 AS passed FROM h GROUP BY lock""")
def half_precision_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Least cosine between unit vectors and their half-precision copies, and whether it passes the gate of 0.9999."""
    bad = F.exists("vec32", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = read(spark, d, "vectors").where((F.size("vec32") == 64) & ~bad & F.exists("vec32", lambda x: x != 0)).select("text_sha256", F.coalesce("lock_sha", F.lit("")).alias("lock"), F.transform("vec32", lambda x: x.cast("double")).alias("v")).distinct()
    u = rows.select("lock", vectors.unit(F.col("v")).alias("u")).withColumn("h", F.transform("u", half_precision))
    cos = vectors.dot(F.col("u"), F.col("h")) / vectors.norm(F.col("h"))
    return u.groupBy("lock").agg(F.count("*").alias("n"), F.round(F.min(cos), 8).alias("worst"), (F.min(cos) >= 0.9999).alias("passed"))


@query(f"""WITH d AS ({DEC}), o AS (SELECT decision_id, option_index, p_fit FROM ({OPT}) WHERE p_fit IS NOT NULL AND NOT isnan(p_fit)), l AS (SELECT o.decision_id, option_index = anchor_index AS a, CASE WHEN option_index = anchor_index THEN 0.0 ELSE ln(least(greatest(o.p_fit, 1e-6), 1 - 1e-6) / (1 - least(greatest(o.p_fit, 1e-6), 1 - 1e-6))) END AS z FROM o JOIN d USING (decision_id) WHERE anchor_index IS NOT NULL),
m AS (SELECT decision_id, max(z) AS m FROM l GROUP BY decision_id) SELECT decision_id, round(1 / sum(exp(z - m)), 6) AS top, round(sum(CASE WHEN a THEN exp(z - m) ELSE 0 END) / sum(exp(z - m)), 6) AS anchor FROM l JOIN m USING (decision_id) GROUP BY decision_id""")
def anchored_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over the logits of single fits, clipped, with the anchor at zero: the greatest and the anchor's probability.

    A logit is at most ln(1e6), so that the sum needs no maximum first; sums combine before the exchange.
    """
    rows = options(spark, d).where(number("p_fit").isNotNull()).select("decision_id", "option_index", "p_fit")
    q = F.least(F.greatest("p_fit", F.lit(1e-6)), F.lit(1 - 1e-6))
    asked = decisions(spark, d).where("anchor_index is not null").select("decision_id", "anchor_index")
    e = F.when(F.col("option_index") == F.col("anchor_index"), 1.0).otherwise(q / (1 - q))
    own = rows.join(asked, "decision_id").select("decision_id", e.alias("e"), (F.col("option_index") == F.col("anchor_index")).alias("a"))
    return own.groupBy("decision_id").agg(F.round(F.max("e") / F.sum("e"), 6).alias("top"), F.round(F.coalesce(F.sum(F.when(F.col("a"), F.col("e"))), F.lit(0.0)) / F.sum("e"), 6).alias("anchor"))


@query(f"""WITH d AS ({DEC}), c(level, a, b) AS (VALUES ('zero_shot', 1.0, 0.0), ('calibrated', 1.5, -0.25), ('probe', 0.5, 0.125)) SELECT decision_id, round(1 / (1 + exp(-(a * s_c + b))), 6) AS p FROM d JOIN c USING (level) WHERE s_c IS NOT NULL AND NOT isnan(s_c)""")
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """A calibrator (slope, offset) per level applied to scores, without overflow."""
    table = spark.createDataFrame([("zero_shot", 1.0, 0.0), ("calibrated", 1.5, -0.25), ("probe", 0.5, 0.125)], "level string, a double, b double")
    rows = decisions(spark, d).where(number("s_c").isNotNull()).join(F.broadcast(table), "level")
    return rows.select("decision_id", F.round(vectors.sigmoid(F.col("a") * F.col("s_c") + F.col("b")), 6).alias("p"))


@query(f"""WITH d AS ({DEC}) SELECT task_id, {', '.join(f"count(CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN 1 END) AS n_{c}, round(sum(CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END), 4) AS sum_{c}" for c in ('confidence', 's_c', 'p_fit', 'margin'))} FROM d GROUP BY task_id""")
def finite_or_null(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that aren't finite become null before they are counted and summed."""
    names = ["confidence", "s_c", "p_fit", "margin"]
    rows = decisions(spark, d).select("task_id", *[number(c).alias(c) for c in names])
    return rows.groupBy("task_id").agg(*[x for c in names for x in (F.count(c).alias(f"n_{c}"), F.round(F.sum(c), 4).alias(f"sum_{c}"))])


def first_object(reply: Column) -> Column:
    """The first JSON object of a model's reply: thoughts and code fences are left out, what follows the object is ignored by the parser."""
    plain = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.substring(plain, F.locate("{", plain), F.length(plain))


@query("""WITH s AS (SELECT DISTINCT label_id, state_json AS j FROM labels WHERE json_valid(state_json)) SELECT label_id, json_extract_string(j, '$.aspect') AS aspect, json_extract_string(j, '$.column.name') AS name FROM s""")
def objects_in_replies(spark: SparkSession, d: str) -> DataFrame:
    """Objects read back from replies that wrap them in thoughts, fences and chatter."""
    rows = read(spark, d, "labels").where("state_json is not null").select("label_id", "state_json").distinct()
    reply = F.concat(F.lit('<think>maybe {"aspect": "none"}</think>Here it is:\n```json\n'), F.col("state_json"), F.lit('\n```\nDone {"aspect": "later"}.'))
    got = rows.select("label_id", F.from_json(first_object(reply), _STATE).alias("s"))
    return got.select("label_id", F.col("s.aspect").alias("aspect"), F.col("s.column.name").alias("name"))


_YES = f"""{_BASE}, y AS (SELECT DISTINCT card, option_key AS k, label_source LIKE 'consensus%' AS truth FROM base WHERE label = 'Yes' AND trim(coalesce(card, '')) <> '' AND trim(coalesce(option_key, '')) <> ''),
o AS (SELECT card, k, bool_or(truth) AS t, bool_or(NOT truth) AS p FROM y GROUP BY ALL), f AS (SELECT card, count(*) FILTER (t) AS truth, count(*) FILTER (p) AS proposed, count(*) FILTER (t AND p) AS shared FROM o GROUP BY card)"""


def overlap_per_card(spark: SparkSession, d: str) -> DataFrame:
    """(card, truth, proposed, shared): sizes of the sets of terms and of their intersection; terms meet by (card, term)."""
    rows = labels(spark, d).where("label = 'Yes' and trim(coalesce(card, '')) <> '' and trim(coalesce(option_key, '')) <> ''")
    side = F.col("label_source").like("consensus%")
    per = rows.groupBy("card", "option_key").agg(F.bool_or(side).alias("t"), F.bool_or(~side).alias("p"))
    return per.groupBy("card").agg(F.count_if("t").alias("truth"), F.count_if("p").alias("proposed"), F.count_if(F.col("t") & F.col("p")).alias("shared"))


@query(f"WITH {_YES} SELECT * FROM f")
def set_overlap_per_card(spark: SparkSession, d: str) -> DataFrame:
    return overlap_per_card(spark, d)


@query(f"""WITH {_YES}, w0 AS (SELECT card AS cluster, row_number() OVER (ORDER BY card) - 1 AS i, shared AS s, truth AS n FROM f), m AS (SELECT count(*) AS m FROM w0),
dr AS (SELECT b, ('0x' || substr(md5(b::varchar || ':' || j::varchar), 1, 12))::bigint % m AS i FROM m, range(200) x(b), range((SELECT m FROM m)) y(j)), pb AS (SELECT b, sum(s) / nullif(sum(n), 0) AS v FROM dr JOIN w0 USING (i) GROUP BY b)
SELECT (SELECT sum(truth)::bigint FROM f) AS n, round((SELECT sum(shared) / sum(truth) FROM f), 6) AS point, round(quantile_cont(v, 0.05), 6) AS lower, round(quantile_cont(v, 0.95), 6) AS upper, count(v) AS n_valid FROM pb""")
def pooled_ratio_ci(spark: SparkSession, d: str) -> DataFrame:
    """Found share of the true terms, pooled over cards, with cluster bootstrap bounds."""
    got = resample.ratio_ci(overlap_per_card(spark, d), "card", F.col("shared"), F.col("truth"), draws=200)
    return got.select("n", F.round("point", 6).alias("point"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n_valid")


@query(f"""{PRED}, b AS (SELECT conf, correct::int AS ca, ntile(15) OVER (ORDER BY conf, item) AS bin FROM scored) SELECT round(sum(abs(sc - sa)) / (SELECT count(*) FROM b), 6) AS ece FROM (SELECT bin, sum(conf) AS sc, sum(ca) AS sa FROM b GROUP BY bin)""")
def ece_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error with ties in the order of the items, as the order-dependent variant has it."""
    return metrics.ece_ordered(predictions(spark, d), "conf", "item", "correct").select(F.round("ece", 6).alias("ece"))


@query(f"""{PRED}, o AS (SELECT item, round(p_yes, 10) AS py2 FROM ({loo_sql('product')} SELECT item, p_yes FROM pred)), t AS (SELECT label, py, py2 FROM scored JOIN o USING (item)),
k AS (SELECT ((a.py > b.py)::int + 0.5 * (a.py = b.py)::int + (a.py2 > b.py2)::int + 0.5 * (a.py2 = b.py2)::int) / 2 AS h FROM t a, t b WHERE a.label = 0 AND b.label <> 0) SELECT round(avg(h), 6) AS auroc FROM k""")
def kernel_auroc_of_scorings(spark: SparkSession, d: str) -> DataFrame:
    """The pair kernel averaged over two scorings of the same items: by linearity the mean of their AUROCs, so no pair is formed."""
    parts = [predictions(spark, d, g).select("item", F.lit(g).alias("scoring"), "p_yes", (F.col("label") == 0).alias("positive")) for g in ("card", "product")]
    got = metrics.auroc(parts[0].union(parts[1]), ["scoring"], "p_yes", "positive")
    return got.agg(F.round(F.avg("auroc"), 6).alias("auroc"))


@query(rf"""WITH {_BASE}, t AS (SELECT label_id, product_code, json_extract_string(state_json, '$.column.name') AS name, option_key FROM base WHERE label_source LIKE 'teacher%'),
p AS (SELECT DISTINCT card, product_code FROM cards WHERE trim(coalesce(product_code, '')) <> ''), c AS (SELECT DISTINCT card, name FROM column_info),
m AS (SELECT label_id, count(DISTINCT p.card) AS cards, count(DISTINCT c.card) AS hits, any_value(name_) AS name_, any_value(k) AS k FROM (SELECT label_id, product_code, name AS name_, option_key AS k FROM t) t LEFT JOIN p USING (product_code) LEFT JOIN c ON c.card = p.card AND c.name = name_ GROUP BY label_id)
SELECT CASE WHEN cards = 0 THEN 'no_card' WHEN trim(coalesce(name_, '')) = '' THEN 'no_name' WHEN hits = 0 THEN 'no_column' WHEN trim(coalesce(k, '')) = '' THEN 'no_term' ELSE 'kept' END AS reason, count(*) AS n, sum(hits)::bigint AS rows_ FROM m GROUP BY 1""")
def teacher_rows_by_reason(spark: SparkSession, d: str) -> DataFrame:
    """Teacher rows joined with the cards of their product, then with the columns of the same name: what is kept, and why the rest is not.

    Cards with a column are counted per (product, name) first, so that a row meets one count instead of each card.
    """
    rows = labels(spark, d).where(F.col("label_source").like("teacher%")).select("label_id", "product_code", F.get_json_object("state_json", "$.column.name").alias("name"), "option_key")
    cards = read(spark, d, "cards").where("trim(coalesce(product_code, '')) <> ''").select("card", "product_code").distinct()
    columns = read(spark, d, "column_info").select("card", "name").distinct()
    known = cards.groupBy("product_code").agg(F.count("*").alias("cards"))
    hits = cards.join(columns, "card").groupBy("product_code", "name").agg(F.count("*").alias("hits"))
    got = rows.join(known, "product_code", "left").join(hits, ["product_code", "name"], "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(F.col("cards").isNull(), "no_card").when(blank("name"), "no_name").when(F.col("hits").isNull(), "no_column").when(blank("option_key"), "no_term").otherwise("kept")
    return got.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.coalesce("hits", F.lit(0))).alias("rows_"))


@query(f"""WITH d AS ({DEC}), i AS (SELECT lower(label) AS l, min(item_id) AS item_id FROM canonical_items GROUP BY 1), t AS (SELECT DISTINCT decision_id, option_index, lower(split_part(option_text, ':', 1)) AS l FROM ({OPT}) WHERE option_text IS NOT NULL)
SELECT item_id IS NOT NULL AS resolved, count(*) AS n, count(DISTINCT item_id) AS terms FROM t LEFT JOIN i USING (l) GROUP BY 1""")
def resolved_terms(spark: SparkSession, d: str) -> DataFrame:
    """Option texts looked up in the list of terms, null where there is none; texts meet the list once each."""
    keys = options(spark, d).where("option_text is not null").groupBy(F.lower(F.split_part("option_text", F.lit(":"), F.lit(1))).alias("l")).agg(F.count("*").alias("n"))
    list_ = read(spark, d, "canonical_items").groupBy(F.lower("label").alias("l")).agg(F.min("item_id").alias("item_id"))
    got = keys.join(list_, "l", "left")
    return got.groupBy(F.col("item_id").isNotNull().alias("resolved")).agg(F.sum("n").alias("n"), F.count_distinct("item_id").alias("terms"))


@query(f"""WITH d AS ({DEC}), g AS (SELECT group_id, max(seq) AS last FROM d WHERE group_id IS NOT NULL GROUP BY group_id) SELECT decision_id, CASE WHEN seq = last AND outcome NOT IN ('abstain') THEN 'settled' ELSE outcome END AS outcome, CASE WHEN seq = last AND outcome NOT IN ('abstain') THEN 'last of its group' ELSE reason END AS reason FROM d LEFT JOIN g USING (group_id)""")
def settle_groups(spark: SparkSession, d: str) -> DataFrame:
    """An update of listed columns: the last decision of each group is settled unless it abstains; all other rows keep their values."""
    rows = decisions(spark, d)
    last = rows.where("group_id is not null").groupBy("group_id").agg(F.max("seq").alias("last"))
    hit = (F.col("seq") == F.col("last")) & ~F.col("outcome").isin("abstain")
    both = rows.join(last, "group_id", "left")
    return both.select("decision_id", F.when(hit, "settled").otherwise(F.col("outcome")).alias("outcome"), F.when(hit, "last of its group").otherwise(F.col("reason")).alias("reason"))
