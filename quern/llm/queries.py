"""The pN_ queries: each applies an operator of this subpackage to its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import read
from . import canonical, mixing, neighbours, overlap, packing, residue, splits, survivor, tokens, topn

TOP = 5
#: Rows of a table of targets at most; one with more is refused, not cut.
TARGETS = 100_000


def _listed(rows: DataFrame) -> list[tuple]:
    got = rows.take(TARGETS + 1)
    if len(got) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    return [tuple(r) for r in got]


def _p1(spark: SparkSession, d: str) -> DataFrame:
    options = read(spark, d, "decision_options").where(~F.coalesce("masked", F.lit(False)))
    return topn.top_n(options, "decision_id", "option_index", "s_c", TOP, "rank")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("decision_id", "option_index")


def p1_top_options(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("decision_id", "option_index", "s_c", F.col("rank").alias("search_rank"), "place")


def _p2_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "labels").where("fold_eligible").select("label_id", "card", "product_code", "leak_group")
    return rows, splits.code_edges(rows, "card", ["product_code", "leak_group"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, edges = _p2_edges(spark, d)
    found = splits.components(edges).where("node like 'c|%' and root like 'c|%' and node <> root")
    return found.select(F.expr("substring(root, 3)").alias("group_card"), F.expr("substring(node, 3)").alias("card"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """One row per fold-eligible label_id with its split; redelivered rows count once."""
    rows, edges = _p2_edges(spark, d)
    rows = rows.dropDuplicates(["label_id"])
    name = F.when(F.trim(F.coalesce("card", F.lit(""))) != "", F.concat(F.lit("c|"), F.col("card")))
    own = rows.select(
        "label_id",
        F.coalesce(name, *[F.concat(F.lit("k|"), splits.plain_code(F.col(c))) for c in ("product_code", "leak_group")], F.concat(F.lit("r|"), F.col("label_id"))).alias("node"),
    )
    roots = splits.components(edges)
    grouped = splits.write_out(own.join(roots, "node", "left").select("label_id", F.coalesce("root", "node").alias("root")), "grouped")
    targets = _listed(read(spark, d, "split_targets").select("split_name", "share").orderBy("split_name"))
    dealt = splits.assign_splits(grouped.groupBy("root").agg(F.count("*").alias("n")), targets)
    return grouped.join(dealt, "root").select("label_id", "split")


def p2_split_shares(spark: SparkSession, d: str) -> DataFrame:
    got = p2_splits(spark, d).groupBy("split").agg(F.count("*").alias("labels"))
    total = got.agg(F.sum("labels").alias("total"))
    want = read(spark, d, "split_targets").withColumnRenamed("split_name", "split")
    return want.join(got, "split", "left").crossJoin(F.broadcast(total)).select("split", "share", F.coalesce("labels", F.lit(0)).alias("labels"), F.round(F.coalesce("labels", F.lit(0)) / F.col("total"), 6).alias("reached"))


def p2_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Cards and codes that stand in more than one split (none should), and the number of labels dealt."""
    rows, _ = _p2_edges(spark, d)
    dealt = splits.write_out(rows.dropDuplicates(["label_id"]).where("label_id is not null").join(p2_splits(spark, d), "label_id"), "dealt")
    name = F.when(F.trim(F.coalesce("card", F.lit(""))) != "", F.col("card"))
    codes = F.explode(F.array_compact(F.array(*[splits.plain_code(F.col(c)) for c in ("product_code", "leak_group")])))
    several = lambda k: dealt.select(k.alias("k"), "split").where("k is not null").groupBy("k").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    cards, coded = several(name).withColumnRenamed("n", "split_cards"), several(codes).withColumnRenamed("n", "split_codes")
    return dealt.agg(F.count("*").alias("labels")).crossJoin(F.broadcast(cards)).crossJoin(F.broadcast(coded))


def _p3(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    trust = read(spark, d, "source_trust").groupBy("label_source").agg(F.max("trust").alias("trust"))
    rows = read(spark, d, "labels").withColumn("term", survivor.term_code(F.col("option_key"))).join(F.broadcast(trust), "label_source", "left")
    priority = [
        -F.coalesce("trust", F.lit(-(2**31) + 1)),
        F.col("weight").isNull() | F.isnan("weight"),
        -F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)),
        F.col("created_at").isNull(),
        -F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)),
    ]
    return survivor.survivors(rows, ["task_key", "target_sha256", "term"], "label_id", priority, fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = _p3(spark, d, ["card", "leak_group"])
    return got.select("label_id", F.coalesce("card_from", F.lit("")).alias("card_from"), F.coalesce("leak_group_from", F.lit("")).alias("leak_from"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    fields = ["label", "label_source", "weight", "option_key", "state_sha256", "card", "product_code", "leak_group", "origin", "actor", "created_at"]
    return _p3(spark, d, fields).select("task_key", "target_sha256", "term", "label_id", *fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.most_similar(read(spark, d, "vectors"), "text_sha256", "vec32", 64, TOP)
    return near.select(F.least("key", "other").alias("sha_a"), F.greatest("key", "other").alias("sha_b")).distinct()


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other vectors of every embedding whose vec_id is divisible by 50, by greedy graph search."""
    rows = read(spark, d, "embeddings").where(neighbours.usable(F.col("embedding"), 64)).groupBy(F.col("vec_id").alias("id")).agg(F.min("embedding").alias("vec"))
    nodes = neighbours.write_out(rows, "nodes")
    graph = neighbours.nn_descent(nodes, 64)
    asked = nodes.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = neighbours.greedy_search(graph, nodes, asked, TOP + 1).where("q <> v")
    place = F.row_number().over(Window.partitionBy("q").orderBy("place"))
    return found.select(F.col("q").alias("vec_id"), F.col("v").alias("other_id"), F.round("sim", 6).alias("sim"), place.alias("place")).where(f"place <= {TOP}")


P6 = ("label_id", "bench_card", ["state_sha256", "target_sha256"])


def _description() -> Column:
    return F.get_json_object("state_json", "$.column.description")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(read(spark, d, "labels"), *P6, _description())
    return pairs.select(F.least("eval_key", "train_key").alias("label_a"), F.greatest("eval_key", "train_key").alias("label_b"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels of either split that have a partner in the other one, per split and label_source."""
    counts = overlap.link_counts(read(spark, d, "labels"), *P6, _description())
    sources = read(spark, d, "labels").where("label_id is not null").groupBy("label_id").agg(F.min("label_source").alias("label_source"))
    sides = counts.select(F.col("key").alias("label_id"), "links", F.when(F.col("ev"), "evaluation").otherwise("training").alias("split"))
    return sides.join(sources, "label_id").groupBy("split", "label_source").agg(F.count("*").alias("labels"), F.sum("links").alias("links"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of the description of every evaluation label, and those in spans of five words or more that training has, too."""
    records, texts = overlap.classes(read(spark, d, "labels"), *P6, _description())
    told = records.where("ev").join(overlap.coverage(texts), "tid")
    return told.select(F.col("key").alias("label_id"), F.col("n").alias("words"), "covered")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    columns = (
        read(spark, d, "column_info").where("card is not null and col_pos is not null").groupBy("card", "col_pos")
        .agg(F.max("name").alias("first"), F.max("description").alias("second"))
        .select(F.lit("column_info").alias("src_table"), F.col("card").alias("parent_key"), F.col("col_pos").alias("pos"), F.lit("column").alias("kind"), "first", "second")
    )
    typed = (
        read(spark, d, "decision_options").where("option_key like 'typed:%' and decision_id is not null and option_index is not null").groupBy("decision_id", "option_index")
        .agg(F.max("option_text").alias("first"))
        .select(F.lit("decision_options").alias("src_table"), F.col("decision_id").alias("parent_key"), F.col("option_index").alias("pos"), F.lit("term").alias("kind"), "first", F.lit(None).cast("string").alias("second"))
    )
    keys = canonical.write_out(columns.union(typed), "keys")
    items = read(spark, d, "canonical_items").select("item_id", F.col("item_kind").alias("kind"), "label", "synonyms")
    meant = canonical.canonical(keys.select("kind", "first", "second"), items)
    on = [keys["kind"] == meant["kind"], keys["first"].eqNullSafe(meant["first"]), keys["second"].eqNullSafe(meant["second"])]
    return keys.join(meant, on).select("src_table", "parent_key", "pos", keys["first"], keys["second"], "item_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("src_table", "parent_key", "pos", "item_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, with the number of keys that carry them."""
    return _p4(spark, d).where("item_id = 0").groupBy("src_table", "first", "second").agg(F.count("*").alias("keys"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue per source and kind."""
    docs = read(spark, d, "documents")
    found = residue.residue(docs, "doc_id", "text").select("doc_id", F.explode("kinds").alias("kind"))
    return docs.select("doc_id", "source").distinct().join(found, "doc_id").groupBy("source", "kind").agg(F.count_distinct("doc_id").alias("docs"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without documents that hold residue."""
    docs = read(spark, d, "documents")
    return docs.join(residue.residue(docs, "doc_id", "text").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "lang", F.length("text").alias("n_text"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), tokens.count_tokens(F.col("text")).alias("n"))
    return packing.pack(docs, read(spark, d, "pack_limits"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("limit_id", "container_id", F.col("key").cast("long").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and used share of the room, per limit."""
    got = _p7(spark, d).groupBy("limit_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n").alias("tokens"))
    return got.join(F.broadcast(read(spark, d, "pack_limits")), "limit_id").withColumn("fill", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: documents packed, containers with more tokens than they hold and documents cut though they fit (none should be)."""
    got = packing.write_out(_p7(spark, d).join(F.broadcast(read(spark, d, "pack_limits")), "limit_id"), "packed")
    over = got.groupBy("limit_id", "container_id", "capacity_tokens").agg(F.sum("n").alias("n")).groupBy("limit_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    per = got.groupBy("limit_id", "key", "capacity_tokens").agg(F.sum("n").alias("n"), F.count("*").alias("pieces"))
    cut = per.groupBy("limit_id").agg(F.count("*").alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("cut"))
    return cut.join(over, "limit_id").select("limit_id", "docs", "overfull", "cut")


def _p8(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple]]:
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")
    targets = _listed(read(spark, d, "mix_targets").select(name(F.col("source")).alias("source"), "target_share", "max_repeats").orderBy("source"))
    docs = read(spark, d, "documents").where("doc_id is not null and text <> ''").select("doc_id", name(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("source").isin([t[0] for t in targets])).select("doc_id", "source", F.sha2("text", 256).alias("key"), tokens.count_tokens(F.col("text")).alias("n"))
    # A text counts once, wherever it is repeated: with its smallest doc_id and that row's source.
    texts = docs.groupBy("key").agg(F.min(F.struct("doc_id", "source", "n")).alias("r")).select("key", F.col("r.doc_id").alias("id"), "r.source", "r.n")
    return mixing.mix(texts, targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = _p8(spark, d)
    return chosen.select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "repeats")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source, with what it has and gives."""
    _, report = _p8(spark, d)
    total = sum(r[4] for r in report) or 1
    rows = [(s, float(share), int(n), float(want), int(used), round(used / total, 6), int(most)) for s, share, n, want, used, _, most in report]
    return spark.createDataFrame(rows, "source string, target_share double, available_tokens long, wanted_tokens double, used_tokens long, reached_share double, max_repeats int")


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Listed sources, those with text that miss their part by more than 2 %, and texts used too often (none should be)."""
    chosen, report = _p8(spark, d)
    most = spark.createDataFrame([(r[0], int(r[6])) for r in report], "source string, most int")
    often = chosen.join(F.broadcast(most), "source").agg(F.count_if(F.col("repeats") > F.col("most")).alias("too_often"))
    off = sum(1 for _, _, have, want, used, _, _ in report if have and abs(used - want) > 0.02 * want + 1)
    return often.select(F.lit(len(report)).cast("long").alias("sources"), F.lit(off).cast("long").alias("off_target"), "too_often")


QUERIES = {f.__name__: f for f in (p1_found, p1_top_options, p2_found, p2_splits, p2_split_shares, p2_leaks, p3_found, p3_survivors, p4_found, p4_unmatched, p5_found, p5_search, p6_found, p6_counts, p6_coverage, p7_containers, p7_fill, p7_valid, p8_mix, p8_shares, p8_valid, p9_found, p9_kinds, p9_clean)}
