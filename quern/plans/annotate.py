"""The annotation of cards as one dataflow: columns, aspects, ontologies, candidates, ranking, values, links, numbered decisions.

Each step is a query of its own; ``annotate`` runs them all. The recorded options of earlier decisions are the search index,
labels of other cards are the lookup, gold labels the second opinion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import select
from ..runtime import read, write_out
from .cards import _REG, registry
from .evaluation import labels
from .registry import query
from .rules import _ORDER, ASPECTS, fallback_aspects, prior_order

#: Terms that a search returns for a word, children compared with a term, options kept with a decision.
HITS, CHILDREN, KEPT = 25, 10, 3
#: Share of common words (twice the common ones by the words of both) from which the best term is proposed.
THRESHOLD = 0.4


def words(c: Column) -> Column:
    """Different words of three letters or more, camel case split, in lower case."""
    return F.array_distinct(F.regexp_extract_all(text.split_camel(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), 0))


def _words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({x}, ''), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z]{{3,}}'))"


def _key(x: str) -> str:
    return rf"regexp_extract(lower(regexp_replace(regexp_replace(coalesce({x}, ''), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '([a-z]{{3,}})[^a-z]*$', 1)"


def key(c: Column) -> Column:
    """The last word of a name, by which columns are looked up."""
    return F.regexp_extract(text.split_camel(F.coalesce(c, F.lit(""))), r"([a-z]{3,})[^a-z]*$", 1)


_NUMERIC = f"coalesce(regexp_replace(lower(dtype), '[\\s_]', '', 'g') IN ({', '.join(repr(t) for t in text.NUMERIC_TYPES)}), FALSE)"
_IDENT = """((lower(coalesce(name, '')) IN ('uid', 'remarks', 'publicationdate', 'release')) OR (regexp_matches(lower(coalesce(name, '')), '(id|uid|code|identifiedby|recordedby|measuredby)$') AND lower(name) <> 'taxonid')
OR coalesce(lower(dtype) IN ('datetime', 'date'), FALSE) OR starts_with(lower(coalesce(profile, '')), 'all blank') OR contains(lower(coalesce(profile, '')), 'not profiled'))"""
_ASP = ", ".join(f"'{a}'" for a in ASPECTS)

COLUMNS = f"""{_ORDER}, cols AS (SELECT DISTINCT card, col_pos, name, dtype, unit, profile FROM column_info WHERE card IS NOT NULL AND NOT {_IDENT}),
al AS (SELECT card, json_extract_string(state_json, '$.column.name') AS name, {_key("json_extract_string(state_json, '$.column.name')")} AS k, label AS aspect, label_source FROM base WHERE task_id = 'column.aspect' AND label IN ({_ASP}) AND trim(coalesce(card, '')) <> ''),
al1 AS (SELECT k, aspect, card, count(*) AS n FROM al WHERE k <> '' GROUP BY ALL), al2 AS (SELECT k, aspect, sum(n) AS n FROM al1 GROUP BY ALL),
hint AS (SELECT card, name, min(aspect) AS hint FROM al WHERE label_source = 'curator' GROUP BY ALL),
lk AS (SELECT card, col_pos, aspect, row_number() OVER (PARTITION BY card, col_pos, ck ORDER BY m DESC, aspect) AS r FROM (SELECT c.card, c.col_pos, c.name AS ck, al2.aspect, al2.n - coalesce(al1.n, 0) AS m FROM cols c JOIN al2 ON al2.k = {_key('c.name')} LEFT JOIN al1 ON al1.k = al2.k AND al1.aspect = al2.aspect AND al1.card = c.card) WHERE m > 0),
lk2 AS (SELECT card, col_pos, list(aspect ORDER BY r) AS looked FROM lk WHERE r <= 2 GROUP BY ALL),
ord AS (SELECT coalesce(list(aspect ORDER BY n DESC, aspect), []) AS ord FROM c),
asp0 AS (SELECT c.*, hint, list_filter(list_concat(CASE WHEN hint IS NULL THEN [] ELSE [hint] END, list_filter(coalesce(looked, []), lambda a: a IS DISTINCT FROM hint)), lambda a: a <> 'other') AS found, ord FROM cols c LEFT JOIN hint USING (card, name) LEFT JOIN lk2 USING (card, col_pos), ord),
asp1 AS (SELECT card, col_pos, name, unit, hint, CASE WHEN len(found) > 0 THEN found ELSE list_filter(CASE WHEN trim(coalesce(unit, '')) <> '' OR {_NUMERIC} THEN list_concat(['measurement', 'unit'], list_filter(ord, lambda a: a NOT IN ('measurement', 'unit'))) ELSE ord END, lambda a: a NOT IN ('taxon', 'other') AND (a <> 'unit' OR trim(coalesce(unit, '')) <> ''))[1:2] END AS l, len(found) = 0 AS fell FROM asp0),
asp AS (SELECT card, col_pos, name, unit, unnest(l) AS aspect, generate_subscripts(l, 1) AS place, CASE WHEN fell THEN 'fallback' WHEN l[generate_subscripts(l, 1)] = hint THEN 'hint' ELSE 'lookup' END AS source FROM asp1)"""


def columns_aspects(spark: SparkSession, d: str) -> DataFrame:
    """(card, col_pos, name, unit, aspect, place, source): the aspects of every column that isn't an identifier.

    A curator's hint and the two aspects that columns with the same last word have most often on other cards, by subtraction
    of the own card; the fallback order where both say nothing.
    """
    cols = read(spark, d, "column_info").where(F.col("card").isNotNull() & ~text.is_identifier(F.col("name"), F.col("dtype"), F.col("profile"))).select("card", "col_pos", "name", "dtype", "unit", "profile").distinct()
    rows = labels(spark, d).where((F.col("task_id") == "column.aspect") & F.col("label").isin(ASPECTS) & (F.trim(F.coalesce("card", F.lit(""))) != ""))
    name = F.get_json_object("state_json", "$.column.name")
    rows = rows.select("card", name.alias("name"), key(name).alias("k"), F.col("label").alias("aspect"), "label_source")
    own = write_out(rows.where("k <> ''").groupBy("k", "aspect", "card").agg(F.count("*").alias("own")), "aspects")
    total = own.groupBy("k", "aspect").agg(F.sum("own").alias("n"))
    hints = rows.where("label_source = 'curator'").groupBy("card", "name").agg(F.min("aspect").alias("hint"))
    asked = cols.select("card", "col_pos", "name", key(F.col("name")).alias("k"))
    left = asked.join(total, "k").join(own, ["k", "aspect", "card"], "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0))).where("m > 0")
    two = select.top_per_key(left, ["card", "col_pos", "name"], [F.desc("m"), F.asc("aspect")], 2, "r")
    looked = two.groupBy("card", "col_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "aspect"))), lambda x: x["aspect"]).alias("looked"))
    both = cols.join(hints, ["card", "name"], "left").join(looked, ["card", "col_pos"], "left").crossJoin(F.broadcast(prior_order(spark, d)))
    none = F.array().cast("array<string>")
    found = F.filter(F.array_distinct(F.concat(F.when(F.col("hint").isNull(), none).otherwise(F.array("hint")), F.coalesce("looked", none))), lambda a: a != "other")
    rest = fallback_aspects(F.col("order"), F.trim(F.coalesce("unit", F.lit(""))) != "", text.is_numeric_type(F.col("dtype")))
    fell = F.size(found) == 0
    listed = both.select("card", "col_pos", "name", "unit", "hint", fell.alias("fell"), F.posexplode(F.when(fell, rest).otherwise(found)).alias("p", "aspect"))
    source = F.when(F.col("fell"), "fallback").when(F.col("aspect") == F.col("hint"), "hint").otherwise("lookup")
    return listed.select("card", "col_pos", "name", "unit", "aspect", (F.col("p") + 1).alias("place"), source.alias("source"))


@query(f"WITH {COLUMNS} SELECT card, col_pos, aspect, place, source FROM asp")
def annotate_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns_aspects(spark, d).select("card", "col_pos", "aspect", "place", "source")


PICKS = f"""{COLUMNS}, reg(ontology, aspects) AS (VALUES {_REG}), pri AS (SELECT lower(regexp_extract(option_key, '([A-Za-z]+)[:_]\\s*[0-9]+>?\\s*$', 1)) AS ontology, count(*) AS n FROM base WHERE label = 'Yes' GROUP BY 1),
ont AS (SELECT a.card, a.col_pos, a.name, a.unit, a.aspect, a.place, reg.ontology, row_number() OVER (PARTITION BY a.card, a.col_pos, a.name, a.aspect ORDER BY coalesce(pri.n, 0) DESC, reg.ontology) AS r FROM asp a JOIN reg ON list_contains(aspects, aspect) LEFT JOIN pri USING (ontology)),
pick AS (SELECT card, col_pos, name, ontology, min(struct_pack(p := place, a := aspect)).a AS aspect FROM (SELECT card, col_pos, name, ontology, aspect, place FROM ont WHERE r <= 2 UNION ALL SELECT card, col_pos, name, 'uo', 'unit', 99 FROM asp WHERE aspect = 'measurement' AND trim(coalesce(unit, '')) <> '') GROUP BY ALL)"""


def ontology_picks(spark: SparkSession, d: str) -> DataFrame:
    """(card, col_pos, name, ontology, aspect): the two ontologies of each aspect that accepted labels name most, the unit ontology
    appended for measured columns with a unit; an ontology once a column, with its first aspect."""
    asp = write_out(columns_aspects(spark, d), "aspects")
    used = labels(spark, d).where("label = 'Yes'").groupBy(F.lower(F.regexp_extract("option_key", r"([A-Za-z]+)[:_]\s*[0-9]+>?\s*$", 1)).alias("ontology")).agg(F.count("*").alias("n"))
    allowed = asp.join(F.broadcast(registry(spark)), F.expr("array_contains(aspects, aspect)")).join(used, "ontology", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    two = select.top_per_key(allowed, ["card", "col_pos", "name", "aspect"], [F.desc("n"), F.asc("ontology")], 2, "r").select("card", "col_pos", "name", "ontology", "aspect", "place")
    units = asp.where("aspect = 'measurement' and trim(coalesce(unit, '')) <> ''").select("card", "col_pos", "name", F.lit("uo"), F.lit("unit"), F.lit(99))
    return two.union(units).groupBy("card", "col_pos", "name", "ontology").agg(F.min(F.struct("place", "aspect")).alias("b")).select("card", "col_pos", "name", "ontology", F.col("b.aspect").alias("aspect"))


@query(f"WITH {PICKS} SELECT card, col_pos, ontology, aspect FROM pick")
def annotate_ontologies(spark: SparkSession, d: str) -> DataFrame:
    return ontology_picks(spark, d).select("card", "col_pos", "ontology", "aspect")


GROUPS = f"""{PICKS}, term AS (SELECT option_key AS curie, lower(split_part(option_key, ':', 1)) AS ontology, min(option_text) AS txt FROM decision_options WHERE regexp_matches(option_key, '^[A-Za-z]+:[0-9]+$') AND option_text IS NOT NULL AND NOT starts_with(lower(option_text), 'obsolete') GROUP BY option_key),
tw AS (SELECT curie, ontology, txt, w, len(ws) AS size, {_key('txt')} AS last FROM (SELECT *, unnest(ws) AS w FROM (SELECT *, {_words('txt')} AS ws FROM term))),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ontology, w ORDER BY size, curie) AS r FROM tw) WHERE r <= {HITS}),
grp AS (SELECT 'c|' || card || '|' || col_pos || '|' || coalesce(name, '') || '|' || ontology AS grp, 'column' AS scope, card, name AS target, ontology, {_words('name')} AS ws FROM pick
UNION ALL SELECT DISTINCT 's|' || card || '|' || s.code, 'site', card, s.code, 'envo', {_words('s.habitat')} FROM (SELECT card, unnest(sites) AS s FROM cards) WHERE s.code IS NOT NULL AND card IS NOT NULL
UNION ALL SELECT DISTINCT 'd|' || card, 'dataset', card, card, 'envo', {_words('title')} FROM (SELECT card, min(title) AS title FROM cards WHERE card IS NOT NULL GROUP BY card)),
cand AS (SELECT grp, curie, txt, last, 2 * count(*) / (any_value(size) + any_value(asked)) AS score FROM (SELECT grp, ontology, unnest(ws) AS w, len(ws) AS asked FROM grp) g JOIN idx USING (ontology, w) GROUP BY ALL)"""


def term_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, candidates, terms): questions per column and ontology, per site and per dataset, with the terms a search finds for their words.

    A search returns ``HITS`` terms for a word of an ontology, so that a common word brings no more.
    """
    picks = ontology_picks(spark, d)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by_column = picks.select(F.concat_ws("|", F.lit("c"), "card", part("col_pos"), part("name"), "ontology").alias("grp"), F.lit("column").alias("scope"), "card", F.col("name").alias("target"), "ontology", words(F.col("name")).alias("ws"))
    cards = read(spark, d, "cards").where("card is not null")
    sites = cards.select("card", F.inline("sites")).where("code is not null").select(F.concat_ws("|", F.lit("s"), "card", "code"), F.lit("site"), "card", "code", F.lit("envo"), words(F.col("habitat"))).distinct()
    sets = cards.groupBy("card").agg(F.min("title").alias("title")).select(F.concat_ws("|", F.lit("d"), "card"), F.lit("dataset"), "card", F.col("card"), F.lit("envo"), words(F.col("title")))
    groups = write_out(by_column.union(sites).union(sets), "groups")
    options = read(spark, d, "decision_options").where(F.col("option_key").rlike("^[A-Za-z]+:[0-9]+$") & F.col("option_text").isNotNull() & ~F.startswith(F.lower("option_text"), F.lit("obsolete")))
    terms = options.groupBy(F.col("option_key").alias("curie")).agg(F.min("option_text").alias("txt")).withColumn("ontology", F.lower(F.split_part("curie", F.lit(":"), F.lit(1)))).withColumn("ws", words(F.col("txt")))
    terms = write_out(terms.where("size(ws) > 0").select("curie", "ontology", "txt", "ws", F.size("ws").alias("size"), key(F.col("txt")).alias("last")), "terms")
    index = select.top_per_key(terms.withColumn("w", F.explode("ws")), ["ontology", "w"], [F.asc("size"), F.asc("curie")], HITS, "r")
    asked = groups.select("grp", "ontology", F.size("ws").alias("asked"), F.explode("ws").alias("w"))
    found = asked.join(index.select("ontology", "w", "curie", "txt", "size", "last"), ["ontology", "w"])
    candidates = write_out(found.groupBy("grp", "curie", "txt", "last").agg((2 * F.count("*") / (F.max("size") + F.max("asked"))).alias("score")), "candidates")
    return groups, candidates, terms


@query(f"WITH {GROUPS} SELECT grp, curie, round(score, 6) AS score FROM cand")
def annotate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return term_groups(spark, d)[1].select("grp", "curie", F.round("score", 6).alias("score"))


RANKED = f"""{GROUPS}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, curie) AS place FROM cand),
win AS (SELECT g.grp, g.scope, g.card, g.target, g.ontology, g.ws, a.curie, a.txt, a.last, a.score, b.curie AS runner, CASE WHEN a.curie IS NULL THEN 'abstain' WHEN a.score >= {THRESHOLD} THEN 'proposed' ELSE 'abstain' END AS outcome, CASE WHEN a.curie IS NULL THEN 'no_candidates' WHEN a.score < {THRESHOLD} THEN 'below_threshold' END AS reason
FROM grp g LEFT JOIN rk a ON a.grp = g.grp AND a.place = 1 LEFT JOIN rk b ON b.grp = g.grp AND b.place = 2)"""


def ranked_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(winners, places, terms): the winner and runner-up of each group, its outcome; groups without candidates abstain."""
    groups, candidates, terms = term_groups(spark, d)
    places = write_out(select.top_per_key(candidates, ["grp"], [F.desc(F.round("score", 9)), F.asc("curie")], KEPT), "places")
    side = lambda p: places.where(F.col("place") == p)
    both = groups.join(side(1).drop("place"), "grp", "left").join(side(2).select("grp", F.col("curie").alias("runner")), "grp", "left")
    outcome = F.when(F.col("score") >= THRESHOLD, "proposed").otherwise("abstain")
    reason = F.when(F.col("curie").isNull(), "no_candidates").when(F.col("score") < THRESHOLD, "below_threshold")
    return both.withColumn("outcome", outcome).withColumn("reason", reason), places, terms


@query(f"WITH {RANKED} SELECT grp, curie, runner, outcome, reason FROM win")
def annotate_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranked_groups(spark, d)[0].select("grp", "curie", "runner", "outcome", "reason")


DEEPER = f"""{RANKED}, kids AS (SELECT * FROM (SELECT curie AS kid, txt AS kid_txt, ontology, last, ws AS kid_ws, row_number() OVER (PARTITION BY ontology, last ORDER BY len(ws) DESC, curie) AS r FROM (SELECT *, {_key('txt')} AS last FROM (SELECT *, {_words('txt')} AS ws FROM term) WHERE len(ws) > 0)) WHERE r <= {CHILDREN}),
ch AS (SELECT w.grp, kid, kid_txt, len(list_intersect(kid_ws, w.ws)) AS k, row_number() OVER (PARTITION BY w.grp ORDER BY len(list_intersect(kid_ws, w.ws)) DESC, kid) AS r FROM win w JOIN kids ON kids.ontology = w.ontology AND kids.last = w.last AND kid <> w.curie WHERE w.outcome = 'proposed'),
deep AS (SELECT w.*, coalesce(CASE WHEN ch.k >= len(list_intersect({_words('w.txt')}, w.ws)) + 1 THEN kid END, w.curie) AS final, CASE WHEN ch.k >= len(list_intersect({_words('w.txt')}, w.ws)) + 1 THEN kid_txt ELSE w.txt END AS final_txt, coalesce(ch.k >= len(list_intersect({_words('w.txt')}, w.ws)) + 1, FALSE) AS deeper FROM win w LEFT JOIN ch ON ch.grp = w.grp AND ch.r = 1)"""


def specific_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(winners, places) after each proposed term was compared with up to ``CHILDREN`` terms of its kind: one that shares a word more
    with the question takes its place."""
    winners, places, terms = ranked_groups(spark, d)
    winners = write_out(winners, "winners")
    kids = select.top_per_key(terms, ["ontology", "last"], [F.desc("size"), F.asc("curie")], CHILDREN, "r").select("ontology", "last", F.col("curie").alias("kid"), F.col("txt").alias("kid_txt"), F.col("ws").alias("kid_ws"))
    asked = winners.where("outcome = 'proposed'").select("grp", "ontology", "last", "curie", "ws")
    scored = asked.join(kids, ["ontology", "last"]).where("kid <> curie").select("grp", "kid", "kid_txt", F.size(F.array_intersect("kid_ws", "ws")).alias("k"))
    best = select.first_per_key(scored, ["grp"], [F.desc("k"), F.asc("kid")])
    more = F.coalesce(F.col("k") >= F.size(F.array_intersect(words(F.col("txt")), F.col("ws"))) + 1, F.lit(False))
    both = winners.join(best, "grp", "left")
    return both.withColumn("deeper", more).withColumn("final", F.when(more, F.col("kid")).otherwise(F.col("curie"))).withColumn("final_txt", F.when(more, F.col("kid_txt")).otherwise(F.col("txt"))), places


@query(f"WITH {DEEPER} SELECT grp, final, deeper FROM deep WHERE outcome = 'proposed'")
def annotate_specificity(spark: SparkSession, d: str) -> DataFrame:
    return specific_terms(spark, d)[0].where("outcome = 'proposed'").select("grp", "final", "deeper")


LINKED = f"""{DEEPER}, op AS (SELECT card, json_extract_string(state_json, '$.column.name') AS target, min(option_key) AS opinion FROM base WHERE label_source = 'gold' AND label = 'Yes' AND trim(coalesce(option_key, '')) <> '' AND trim(coalesce(card, '')) <> '' GROUP BY ALL),
fin AS (SELECT deep.* EXCLUDE (outcome, reason), CASE WHEN outcome = 'proposed' AND opinion <> final THEN 'escalated' ELSE outcome END AS outcome, CASE WHEN outcome = 'proposed' AND opinion <> final THEN 'second_opinion' ELSE reason END AS reason FROM deep LEFT JOIN op ON scope = 'column' AND op.card = deep.card AND op.target = deep.target),
lnk AS (SELECT grp, card || '/' || coalesce(target, '') AS path, final AS curie, trim(regexp_replace(lower(final_txt), '[^a-z0-9]+', '_', 'g'), '_') AS attribute, CASE scope WHEN 'dataset' THEN final_txt ELSE coalesce(nullif(target, ''), final_txt) END AS value FROM fin WHERE outcome = 'proposed')"""


def final_decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, places): a gold label that names another term escalates the proposal."""
    deep, places = specific_terms(spark, d)
    gold = labels(spark, d).where("label_source = 'gold' and label = 'Yes' and trim(coalesce(option_key, '')) <> '' and trim(coalesce(card, '')) <> ''")
    gold = gold.groupBy("card", F.get_json_object("state_json", "$.column.name").alias("target")).agg(F.min("option_key").alias("opinion")).withColumn("scope", F.lit("column"))
    both = deep.join(gold, ["scope", "card", "target"], "left")
    other = F.coalesce((F.col("outcome") == "proposed") & (F.col("opinion") != F.col("final")), F.lit(False))
    return both.withColumn("reason", F.when(other, "second_opinion").otherwise(F.col("reason"))).withColumn("outcome", F.when(other, "escalated").otherwise(F.col("outcome"))), places


@query(f"WITH {LINKED} SELECT * FROM lnk")
def annotate_links(spark: SparkSession, d: str) -> DataFrame:
    """Kept proposals as links: attribute from the term's text, value by the rule of the scope."""
    rows = final_decisions(spark, d)[0].where("outcome = 'proposed'")
    value = F.when(F.col("scope") == "dataset", F.col("final_txt")).otherwise(F.coalesce(F.nullif("target", F.lit("")), F.col("final_txt")))
    attribute = F.trim(F.regexp_replace(F.lower("final_txt"), "[^a-z0-9]+", "_"), F.lit("_"))
    return rows.select("grp", F.concat(F.col("card"), F.lit("/"), F.coalesce("target", F.lit(""))).alias("path"), F.col("final").alias("curie"), attribute.alias("attribute"), value.alias("value"))


@query(f"""WITH {LINKED}, num AS (SELECT grp, outcome, row_number() OVER (PARTITION BY card ORDER BY CASE scope WHEN 'column' THEN 0 WHEN 'site' THEN 1 ELSE 2 END, grp) - 1 AS seq FROM fin)
SELECT num.grp, seq, outcome, place - 1 AS option_index, rk.curie AS option_key, round(score, 6) AS score FROM num LEFT JOIN rk ON rk.grp = num.grp AND place <= {KEPT}""")
def annotate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """All decisions numbered within their card by step, with their first options in rows."""
    rows, places = final_decisions(spark, d)
    step = F.when(F.col("scope") == "column", 0).when(F.col("scope") == "site", 1).otherwise(2)
    # A card's questions are its columns, sites and itself: a bounded window.
    seq = F.row_number().over(Window.partitionBy("card").orderBy(step, "grp")) - 1
    numbered = rows.select("grp", "outcome", seq.alias("seq"))
    kept = places.select("grp", (F.col("place") - 1).alias("option_index"), F.col("curie").alias("option_key"), F.round("score", 6).alias("score"))
    return numbered.join(kept, "grp", "left").select("grp", "seq", "outcome", "option_index", "option_key", "score")
