"""Cards and their columns: parsing, text functions, search texts, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import select
from ..runtime import read
from ..sources import cards
from .registry import query


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, text, list_filter(ls, lambda x: regexp_matches(x, '^#\s*Dataset:\s*(\S+)\s*/\s*(\S+)\s*$'))[-1] AS hd, list_filter(ls, lambda x: regexp_matches(x, '^Rows:\s*(\d+);\s*months covered:\s*(\S+)\s+to\s+(\S+)'))[-1] AS rw,
len(list_filter(ls, lambda x: regexp_matches(x, '^-\s*([^|]+)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$'))) AS n_columns FROM l)
SELECT doc_id, regexp_extract(hd, '^#\s*Dataset:\s*(\S+)\s*/\s*(\S+)\s*$', 1) AS product_code, regexp_extract(hd, '^#\s*Dataset:\s*(\S+)\s*/\s*(\S+)\s*$', 2) AS table_name, coalesce(try_cast(regexp_extract(rw, '^Rows:\s*(\d+);', 1) AS bigint), 0) AS n_rows,
coalesce(regexp_extract(rw, 'months covered:\s*(\S+)\s+to\s+(\S+)', 1), '') AS months_from, coalesce(regexp_extract(rw, 'months covered:\s*(\S+)\s+to\s+(\S+)', 2), '') AS months_to, n_columns, sha256(text) AS sha256 FROM h WHERE hd IS NOT NULL""")
def parse_cards(spark: SparkSession, d: str) -> DataFrame:
    """Records of all documents that begin as a card."""
    rows = cards.parse(read(spark, d, "documents").select("doc_id", "text"), "text").where("parsed is not null")
    return rows.select("doc_id", "parsed.product_code", "parsed.table_name", "parsed.n_rows", "parsed.months_from", "parsed.months_to", F.size("parsed.columns").alias("n_columns"), "parsed.sha256")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '(^|\n)\s*#\s*Dataset:\s*\S+\s*/\s*\S+[ \t]*(\n|$)')),
c AS (SELECT doc_id, regexp_extract(trim(line), '^-\s*([^|]+)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$', ['a', 'b', 'c', 'd', 'e']) AS p FROM l WHERE regexp_matches(trim(line), '^-\s*[^|]+\|[^|]*\|[^|]*\|[^|]*\|'))
SELECT doc_id, trim(p.a) AS name, trim(p.c) AS dtype, CASE WHEN trim(p.d) = '-' THEN '' ELSE trim(p.d) END AS unit, trim(p.e) AS profile FROM c""")
def card_columns_from_text(spark: SparkSession, d: str) -> DataFrame:
    """The columns that cards list, one row each."""
    rows = cards.parse(read(spark, d, "documents").select("doc_id", "text"), "text").where("parsed is not null")
    return rows.select("doc_id", F.inline("parsed.columns")).select("doc_id", "name", "dtype", "unit", "profile")


@query(r"""SELECT doc_id, regexp_extract(text, '(?:^|\n)\s*Rows:\s*(\d+);\s*months covered:\s*(\S+)\s+to\s+(\S+)', 1)::bigint AS n_rows, regexp_extract(text, '(?:^|\n)\s*Rows:\s*(\d+);\s*months covered:\s*(\S+)\s+to\s+(\S+)', 2) AS months_from
FROM documents WHERE regexp_matches(text, '(^|\n)\s*Rows:\s*\d+;\s*months covered:\s*\S+\s+to\s+\S+') AND regexp_matches(text, '(^|\n)\s*#\s*Dataset:\s*\S+\s*/\s*\S+[ \t]*(\n|$)')""")
def card_rows_line(spark: SparkSession, d: str) -> DataFrame:
    rows = cards.parse(read(spark, d, "documents").select("doc_id", "text"), "text").where("parsed.months_from <> ''")
    return rows.select("doc_id", "parsed.n_rows", "parsed.months_from")


@query("SELECT card, s.code AS code, s.domain AS domain, s.habitat AS habitat FROM (SELECT card, unnest(sites) AS s FROM cards)")
def explode_sites(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cards").select("card", F.inline("sites")).select("card", "code", "domain", "habitat")


@query(r"""SELECT DISTINCT unit, trim(lower(regexp_replace(regexp_replace(regexp_replace(trim(unit), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS normal FROM column_info""")
def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").select("unit").distinct().withColumn("normal", text.normalize_unit(F.col("unit")))


_UNITS = ", ".join(f"('{k}', '{v}')" for k, v in text.UNITS.items())


@query(rf"""WITH u AS (SELECT DISTINCT unit, trim(lower(regexp_replace(regexp_replace(regexp_replace(trim(unit), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS k FROM column_info),
t(name, curie) AS (VALUES {_UNITS}), s AS (SELECT k, name, curie, row_number() OVER (PARTITION BY k ORDER BY length(name) DESC) AS r FROM u JOIN t ON ends_with(k, ' ' || name))
SELECT DISTINCT u.unit, CASE WHEN e.curie IS NOT NULL THEN e.curie WHEN s.name IS NOT NULL THEN CASE WHEN NOT regexp_matches(left(u.k, length(u.k) - length(s.name) - 1), '(^| )(per|square|squared|cubic|cubed)( |$)') THEN s.curie END
WHEN contains(u.k, 'celsius') AND NOT regexp_matches(u.k, '(^| )(per|square|squared|cubic|cubed)( |$)') THEN 'UO:0000027' END AS term FROM u LEFT JOIN t e ON e.name = u.k LEFT JOIN s ON s.k = u.k AND s.r = 1""")
def longest_suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").select("unit").distinct().withColumn("term", text.unit_term(F.col("unit")))


@query(r"""SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS words FROM column_info""")
def split_camel(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").select("name").distinct().withColumn("words", text.split_camel(F.col("name")))


@query(r"""SELECT card, col_pos, name, (lower(coalesce(name, '')) IN ('uid', 'remarks', 'publicationdate', 'release')) OR (regexp_matches(lower(coalesce(name, '')), '(id|uid|code|identifiedby|recordedby|measuredby)$') AND lower(name) <> 'taxonid')
OR coalesce(lower(dtype) IN ('datetime', 'date'), FALSE) OR starts_with(lower(coalesce(profile, '')), 'all blank') OR contains(lower(coalesce(profile, '')), 'not profiled') AS identifier FROM column_info""")
def identifier_columns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").select("card", "col_pos", "name", text.is_identifier(F.col("name"), F.col("dtype"), F.col("profile")).alias("identifier"))


@query(f"""SELECT dtype, coalesce(regexp_replace(lower(dtype), '[\\s_]', '', 'g') IN ({', '.join(f"'{t}'" for t in text.NUMERIC_TYPES)}), FALSE) AS is_number, count(*) AS n FROM column_info GROUP BY ALL""")
def numeric_types(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").groupBy("dtype", text.is_numeric_type(F.col("dtype")).alias("is_number")).agg(F.count("*").alias("n"))


@query(r"""SELECT card, col_pos, TRY_CAST(nullif(regexp_extract(profile, '\bmin=(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS low, TRY_CAST(nullif(regexp_extract(profile, '\bmax=(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS high FROM column_info""")
def profile_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("profile")
    return read(spark, d, "column_info").select("card", "col_pos", text.profile_number(p, "min").alias("low"), text.profile_number(p, "max").alias("high"))


@query(r"""SELECT card, col_pos, nullif(trim(regexp_replace(trim(string_split(regexp_extract(profile, '(?s)top:(.*)$', 1), ',')[1]), ' \([^(]*$', '')), '') AS top FROM column_info""")
def top_profile_value(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "column_info").select("card", "col_pos", text.top_profile_value(F.col("profile")).alias("top"))


@query("SELECT card, CASE WHEN regexp_matches(card, '^DP[0-9][.][0-9]{5}[.][0-9]{3}') THEN regexp_extract(card, '^(DP[0-9][.][0-9]{5}[.][0-9]{3})', 1) ELSE card END AS product FROM cards")
def product_of_card(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cards").select("card", text.product_of(F.col("card")).alias("product"))


@query("""SELECT item_id, nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), '') AS key, 'http://purl.obolibrary.org/obo/' || replace('T:' || item_id, ':', '_') AS iri FROM canonical_items""")
def attribute_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "canonical_items").select("item_id", text.attribute_key(F.col("label")).alias("key"), text.iri_for(F.concat(F.lit("T:"), F.col("item_id"))).alias("iri"))


@query("""SELECT label_id, sha256('{"card":' || to_json(card) || ',"label":' || to_json(label) || ',"target":' || to_json(target_sha256) || '}') AS sha FROM labels WHERE card IS NOT NULL AND label IS NOT NULL AND target_sha256 IS NOT NULL""")
def canonical_json_sha256(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").where("card is not null and label is not null and target_sha256 is not null")
    return rows.select("label_id", text.canonical_sha(card=F.col("card"), label=F.col("label"), target=F.col("target_sha256")).alias("sha"))


@query("""SELECT text_sha256, ceil(length(text) / 2.0)::bigint AS estimate, ceil(length(text) / 2.0) > 120 - 16 AS guarded FROM texts""")
def token_guard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "texts").select("text_sha256", text.chars_estimate(F.col("text")).alias("estimate"), text.token_guard(F.col("text"), 120).alias("guarded"))


@query("SELECT sum((sha256(text) = text_sha256)::int)::bigint AS good, count(*) AS n FROM texts")
def verify_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "texts").agg(F.count_if(F.sha2("text", 256) == F.col("text_sha256")).alias("good"), F.count("*").alias("n"))


# Habitat words with the searches they ask for, in order.
HABITATS = [
    ("thicket", ["shrubland biome"]),
    ("grassland", ["grassland biome", "desert grassland"]),
    ("woodland", ["temperate broadleaf forest biome", "mixed forest biome"]),
    ("marsh", ["wetland biome"]),
    ("peatbog", ["wetland biome"]),
    ("tundra", ["tundra biome"]),
]
_HAB = ", ".join(f"({i}, '{k}', '{q}', {j})" for i, (k, qs) in enumerate(HABITATS) for j, q in enumerate(qs))


@query(f"""WITH s AS (SELECT DISTINCT s.code AS code, lower(s.habitat) AS h FROM (SELECT unnest(sites) AS s FROM cards)), t(i, k, q, j) AS (VALUES {_HAB}),
m AS (SELECT code, h, q, min(i * 10 + j) AS o FROM s JOIN t ON contains(h, k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY code, h ORDER BY o) AS n FROM m)
SELECT code, h AS habitat, q AS query, n AS place FROM r WHERE n <= 3 UNION ALL SELECT code, h, h || ' biome', 1 FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(h, k))""")
def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    """Up to three search texts of each site by the words of its habitat, a default where no word fits."""
    rows = read(spark, d, "cards").select(F.inline("sites")).select("code", F.lower("habitat").alias("habitat")).distinct()
    parts = [F.when(F.contains("habitat", F.lit(k)), F.array(*[F.lit(q) for q in qs])).otherwise(F.array().cast("array<string>")) for k, qs in HABITATS]
    asked = F.slice(F.array_distinct(F.concat(*parts)), 1, 3)
    some = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.concat("habitat", F.lit(" biome"))))
    return rows.select("code", "habitat", F.posexplode(some).alias("p", "query")).select("code", "habitat", "query", (F.col("p") + 1).alias("place"))


@query(r"""WITH q AS (SELECT card, col_pos, replace(lower(regexp_replace(regexp_replace(coalesce(name, ''), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' ') AS a,
trim(regexp_split_to_array(coalesce(description, ''), '[;.(]')[1]) AS b, unit FROM column_info)
SELECT card, col_pos, list_filter([nullif(trim(a), ''), CASE WHEN lower(b) <> trim(a) THEN nullif(left(b, 80), '') END, nullif(unit, '')], lambda x: x IS NOT NULL)[1:3].array_to_string('|') AS searches FROM q""")
def column_search_texts(spark: SparkSession, d: str) -> DataFrame:
    got = text.column_queries(F.col("name"), F.col("description"), F.col("unit"))
    return read(spark, d, "column_info").select("card", "col_pos", F.array_join(got, "|").alias("searches"))


# Which ontologies serve which aspect.
REGISTRY = {
    "envo": ["environment", "location", "measurement"],
    "ncbitaxon": ["taxon"],
    "pato": ["measurement"],
    "uo": ["unit"],
    "obi": ["method", "measurement", "data_type"],
    "iao": ["data_type", "method"],
    "pco": ["taxon", "measurement"],
    "bco": ["method"],
    "gaz": ["location", "environment"],
    "ro": ["other"],
    "taxrank": ["taxon", "data_type"],
    "genepio": ["method", "data_type"],
}
_REG = ", ".join(f"('{k}', {v})" for k, v in REGISTRY.items())


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in REGISTRY.items()], "ontology string, aspects array<string>")


@query(f"""WITH r(ontology, aspects) AS (VALUES {_REG}), a AS (SELECT DISTINCT card, json_extract_string(state_json, '$.column.name') AS column_name, json_extract_string(state_json, '$.aspect') AS aspect FROM labels WHERE trim(coalesce(card, '')) <> '')
SELECT card, column_name, aspect, ontology FROM a JOIN r ON aspect = 'other' OR list_contains(aspects, aspect)""")
def theta_join_mask_dim(spark: SparkSession, d: str) -> DataFrame:
    """Columns and aspects with the ontologies that may serve them; the registry is a constant of twelve rows."""
    state = F.from_json("state_json", "aspect string, column struct<name:string>")
    rows = read(spark, d, "labels").where("trim(coalesce(card, '')) <> ''").select("card", state.alias("s")).select("card", F.col("s.column.name").alias("column_name"), F.col("s.aspect").alias("aspect")).distinct()
    return rows.join(F.broadcast(registry(spark)), (F.col("aspect") == "other") | F.array_contains("aspects", F.col("aspect"))).select("card", "column_name", "aspect", "ontology")


@query("""WITH h AS (SELECT decision_id, option_key, option_text, rank, option_index, upper(split_part(option_key, ':', 1)) AS prefix FROM (SELECT * EXCLUDE (v) FROM (SELECT *, row_number() OVER (PARTITION BY decision_id, option_index ORDER BY rank IS NULL) AS v FROM decision_options) WHERE v = 1)
WHERE contains(option_key, ':') AND NOT starts_with(option_key, 'typed:') AND NOT starts_with(lower(option_text), 'obsolete')),
f AS (SELECT *, row_number() OVER (PARTITION BY decision_id, option_key ORDER BY rank NULLS LAST, option_index) AS n FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY rank NULLS LAST, option_key) AS place FROM f WHERE n = 1)
SELECT decision_id, option_key, prefix, place FROM k WHERE place <= 12""")
def candidates_merged_and_capped(spark: SparkSession, d: str) -> DataFrame:
    """Search hits of a decision: unusable ones out, one per term by rank, the first twelve."""
    rows = select.first_per_key(read(spark, d, "decision_options"), ["decision_id", "option_index"], [F.col("rank").isNull()])
    hits = rows.where(F.contains("option_key", F.lit(":")) & ~F.startswith("option_key", F.lit("typed:")) & ~F.startswith(F.lower("option_text"), F.lit("obsolete")))
    one = select.first_per_key(hits, ["decision_id", "option_key"], [F.asc_nulls_last("rank"), F.asc("option_index")])
    top = select.top_per_key(one, ["decision_id"], [F.asc_nulls_last("rank"), F.asc("option_key")], 12)
    return top.select("decision_id", "option_key", F.upper(F.split_part("option_key", F.lit(":"), F.lit(1))).alias("prefix"), "place")
