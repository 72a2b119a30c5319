"""DuckDB SQL for those pN_ queries that SQL can state over whole tables."""

_TOP = """
SELECT decision_id, option_index, s_c, search_rank, place FROM (
  SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY s_c DESC, search_rank ASC NULLS LAST, option_index) AS place FROM (
    SELECT decision_id, option_index, s_c + 0.0 AS s_c, rank AS search_rank,
      row_number() OVER (PARTITION BY decision_id, option_index ORDER BY s_c DESC, rank ASC NULLS LAST) AS version
    FROM decision_options
    WHERE NOT coalesce(masked, FALSE) AND s_c IS NOT NULL AND NOT isnan(s_c) AND decision_id IS NOT NULL AND option_index IS NOT NULL)
  WHERE version = 1)
WHERE place <= 5"""

_CODE = "nullif(array_to_string(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), '.'), '')"

_TERM = """CASE WHEN regexp_matches(tail, '^[a-z]+[:_-]?0*[0-9]+$')
  THEN regexp_extract(tail, '^([a-z]+)', 1) || ':' || regexp_extract(tail, '0*([0-9]+)$', 1) ELSE tail END"""

_P3 = f"""
WITH a AS (
  SELECT DISTINCT l.*, coalesce(trust, -2147483647) AS trust,
    regexp_replace(regexp_replace(lower(coalesce(option_key, '')), '[\\s<>]+', '', 'g'), '^https?://.*[/#]', '') AS tail
  FROM labels l LEFT JOIN source_trust USING (label_source) WHERE label_id IS NOT NULL),
b AS (SELECT *, {_TERM} AS term FROM a),
g AS (SELECT task_key, target_sha256, term FROM b GROUP BY ALL HAVING count(DISTINCT label_id) > 1),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY task_key, target_sha256, term
    ORDER BY trust DESC, weight DESC NULLS LAST, created_at DESC NULLS LAST, label_id) AS n
  FROM b JOIN g USING (task_key, target_sha256, term))
SELECT min_by(label_id, n) AS label_id,
  coalesce(min_by(label_id, n) FILTER (trim(coalesce(card, '')) <> ''), '') AS card_from,
  coalesce(min_by(label_id, n) FILTER (trim(coalesce(leak_group, '')) <> ''), '') AS leak_from
FROM r GROUP BY task_key, target_sha256, term"""

_P2 = f"""
WITH RECURSIVE rows_ AS (
  SELECT DISTINCT CASE WHEN trim(coalesce(card, '')) <> '' THEN 'c|' || card END AS c, 'k|' || {_CODE.format('product_code')} AS p, 'k|' || {_CODE.format('leak_group')} AS l
  FROM labels WHERE fold_eligible),
edges AS (
  SELECT c AS u, p AS v FROM rows_ UNION SELECT c, l FROM rows_ UNION SELECT p, l FROM rows_
  UNION SELECT p, c FROM rows_ UNION SELECT l, c FROM rows_ UNION SELECT l, p FROM rows_),
reach AS (
  SELECT u AS a, v AS b FROM edges WHERE u LIKE 'c|%' AND v IS NOT NULL
  UNION SELECT a, v FROM reach JOIN edges ON b = u WHERE v IS NOT NULL)
SELECT substr(min(b), 3) AS group_card, substr(a, 3) AS card FROM reach WHERE b LIKE 'c|%' GROUP BY a HAVING min(b) < a"""

_P5 = """
WITH v AS (SELECT text_sha256 AS k, min(vec32)::DOUBLE[] AS v FROM vectors
  WHERE len(vec32) = 64 AND text_sha256 IS NOT NULL AND len(list_filter(vec32, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec32, lambda x: x <> 0)) > 0 GROUP BY 1),
r AS (SELECT a.k, b.k AS o, row_number() OVER (PARTITION BY a.k ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.k) AS n FROM v a JOIN v b ON a.k <> b.k)
SELECT DISTINCT least(k, o) AS sha_a, greatest(k, o) AS sha_b FROM r WHERE n <= 5"""

_P6 = """
WITH r AS (SELECT DISTINCT label_id, bench_card, list_filter(regexp_split_to_array(lower(json_extract_string(state_json, '$.column.description')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w
  FROM labels WHERE label_id IS NOT NULL AND bench_card IS NOT NULL),
t AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS words FROM r WHERE len(w) > 0),
g AS (SELECT label_id, bench_card, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, n - 3)) AS i FROM t WHERE n >= 5)),
k AS (SELECT gram FROM g GROUP BY gram HAVING bool_or(bench_card) AND bool_or(NOT bench_card)),
p AS (SELECT label_id, i, i - lag(i) OVER (PARTITION BY label_id ORDER BY i) AS step FROM (SELECT DISTINCT label_id, i FROM g JOIN k USING (gram) WHERE bench_card)),
c AS (SELECT label_id, sum(least(5, coalesce(step, 5))) AS covered FROM p GROUP BY label_id)
SELECT t.label_id, t.n AS words, CASE WHEN words IN (SELECT words FROM t WHERE NOT bench_card) THEN t.n ELSE coalesce(covered, 0) END::int AS covered
FROM t LEFT JOIN c USING (label_id) WHERE t.bench_card"""

_FIELDS = ["label", "label_source", "weight", "option_key", "state_sha256", "card", "product_code", "leak_group", "origin", "actor", "created_at"]
_P3_ALL = (
    _P3[: _P3.index("SELECT min_by(label_id, n) AS label_id")]
    + "SELECT task_key, target_sha256, term, min_by(label_id, n) AS label_id, "
    + ", ".join(f"min_by({f}, n) FILTER (trim(coalesce({f}::varchar, '')) <> '') AS {f}" for f in _FIELDS)
    + " FROM r GROUP BY task_key, target_sha256, term"
)

ORACLES = {
    "p1_found": f"SELECT decision_id, option_index FROM ({_TOP})",
    "p1_top_options": _TOP,
    "p2_found": _P2,
    # Properties that any right result has.
    "p2_leaks": "SELECT count(DISTINCT label_id) AS labels, 0::bigint AS split_cards, 0::bigint AS split_codes FROM labels WHERE fold_eligible",
    "p7_valid": "SELECT limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0::bigint AS overfull, 0::bigint AS cut FROM pack_limits",
    "p8_valid": "SELECT count(DISTINCT regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g')) AS sources, 0::bigint AS off_target, 0::bigint AS too_often FROM mix_targets WHERE target_share > 0",
    "p3_found": _P3,
    "p3_survivors": _P3_ALL,
    "p5_found": _P5,
    "p6_coverage": _P6,
}
