"""Problem 2: splits that keep connected records together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Written, bounded_broadcast, write_out

#: Edges of one partition of the first level, partitions merged into one on the next, and edges that one task unites at most.
PART_EDGES, FAN_IN, TASK_EDGES = 50_000, 8, 1_000_000


def plain_code(value: Column) -> Column:
    """One spelling of a code: lower case, runs of letters and digits joined by dots, no leading zeros; blank is null."""
    low = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    low = F.regexp_replace(F.trim(low), r"(?<![\p{L}\p{N}])0+(?=[0-9])", "")
    code = F.regexp_replace(low, " ", ".")
    return F.when(code != "", code)


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local forest of the edges of one partition: every node with the smallest node of its local component."""
    up: dict[str, str] = {}
    part = 0

    def root(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        part = int(b["part"].iloc[0]) if len(b) else part
        for u, v in zip(b["u"], b["v"]):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, c = root(u), root(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    names = list(up)
    for i in range(0, len(names), 100_000):
        these = names[i : i + 100_000]
        yield pd.DataFrame({"part": part, "node": these, "root": [root(x) for x in these]})


def _level(edges: DataFrame, parts: int, count: int) -> DataFrame:
    """(part, node, root): the local forests of ``edges`` (u, v) in ``parts`` partitions.

    Edges of a node keep together; those of a node with more than a partition's share are dealt over several.
    """
    share = max(1, count // (2 * parts))
    hot = edges.groupBy("u").agg(F.count("*").alias("deg")).where(F.col("deg") > share)
    # At most count / share = 2 x parts nodes are hot.
    dealt = edges.join(F.broadcast(hot), "u", "left")
    salt = F.pmod(F.xxhash64("v"), F.coalesce(F.ceil(F.col("deg") / share), F.lit(1)))
    dealt = dealt.select("u", "v", F.pmod(F.xxhash64(F.col("u"), salt), F.lit(parts)).cast("int").alias("part"))
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(_by_part, "part int, node string, root string")


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_unite`` for each part of a task; rows come sorted by part."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for p, rows in b.groupby("part", sort=True):
            if held and held[0]["part"].iloc[0] != p:
                yield from _unite(iter(held))
                held = []
            held.append(rows)
    if held:
        yield from _unite(iter(held))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours of every node are hung on its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    hung = both.join(low, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph too large for one task, by large-star and small-star steps until nothing changes."""
    now = Written(edges, "stars")
    while True:
        then = Written(_star(_star(now.df, True), False), "stars")
        same = then.df.count() == now.df.count() and then.df.exceptAll(now.df).isEmpty()
        now.drop()
        now = then
        if same:
            hung = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return hung.union(hung.select(F.col("root").alias("node"), "root").distinct())


def components(edges: DataFrame, task_edges: int = TASK_EDGES, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (u, v: string); root is the smallest node of the connected set.

    Distributed union-find: each partition of about ``part_edges`` edges builds its local forest. Forests of ``FAN_IN``
    partitions are merged on the next level, where only nodes that several partitions know travel, each with its local
    roots; so a level holds what the one below couldn't settle. The top level is one task, if it has at most
    ``task_edges`` edges; a larger one is closed by star steps, in which no task holds more than its hash share. Then roots are
    handed down level by level. Null ends and loops are left out.
    """
    now = Written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    count = now.df.count()
    parts, levels = max(1, math.ceil(count / part_edges)), []
    top = None
    while True:
        if parts == 1 and count > task_edges:
            top = write_out(_stars(now.df), "top")
            break
        local = Written(_level(now.df, parts, count), "local")
        now.drop()
        levels.append(local.df.groupBy("node").agg(F.min("root").alias("root")))
        if parts == 1:
            break
        known = local.df.groupBy("node").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("node")
        now = Written(local.df.join(known, "node").where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")
        count = now.df.count()
        parts = math.ceil(parts / FAN_IN)
    roots = top if top is not None else levels.pop()
    while levels:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("final"))
        # A root with a third of all nodes meets a side of one row for each key, which AQE splits.
        roots = levels.pop().join(bounded_broadcast(above), "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return write_out(roots, "roots")


def code_edges(df: DataFrame, card: str, codes: list[str]) -> DataFrame:
    """Edges of the bipartite graph of cards (``c|name``) and codes (``k|code``); a row without card connects its codes."""
    name = F.when(F.trim(F.coalesce(F.col(card), F.lit(""))) != "", F.concat(F.lit("c|"), F.col(card)))
    ends = F.array_compact(F.array(name, *[F.concat(F.lit("k|"), plain_code(F.col(c))) for c in codes]))
    rows = df.select(ends.alias("e")).where(F.size("e") > 0).distinct()
    # A row's first end to each end: a node without partner stays as a loop and costs nothing.
    return rows.select(F.col("e")[0].alias("u"), F.explode("e").alias("v"))


def greedy_runs(runs: list[tuple[int, int, int]], targets: list[tuple[str, float]]) -> list[tuple[int, int, int, int, str]]:
    """Largest first, each group to the split furthest below its target.

    ``runs``: (size, bucket, number of groups of that size). Returns (size, bucket, from, to, split): places from..to-1
    of the run. Equal groups are dealt in blocks while that is the same as one by one up to a rounding of one group.
    """
    total = sum(z * n for z, _, n in runs)
    have = {s: 0 for s, _ in targets}
    want = {s: w * total for s, w in targets}
    out = []
    for size, bucket, n in sorted(runs, key=lambda r: (-r[0], r[1])):
        at, give = 0, dict.fromkeys(have, 0)
        if n > 2_000 and size:
            # Level the gaps: the splits furthest below their target share the block so that the gaps become equal.
            gaps = sorted(((want[s] - have[s]) / size, s) for s in have)[::-1]
            left, level = n - len(gaps), None
            for k in range(1, len(gaps) + 1):
                level = (sum(g for g, _ in gaps[:k]) - left) / k
                if k == len(gaps) or level >= gaps[k][0]:
                    break
            for g, s in gaps:
                give[s] = max(0, math.floor(g - level))
            while sum(give.values()) > n:
                give[max(give, key=lambda s: (give[s], s))] -= 1
        for s in give:
            have[s] += give[s] * size
        for _ in range(n - sum(give.values())):
            s = max(have, key=lambda s: (want[s] - have[s], want[s], s))
            give[s] += 1
            have[s] += size
        for s, k in give.items():
            if k:
                out.append((size, bucket, at, at + k, s))
                at += k
    return out


def assign_splits(sizes: DataFrame, targets: list[tuple[str, float]], buckets: int = 256) -> DataFrame:
    """(root, n, split) for groups (root, n): greedy largest-first on the histogram of group sizes.

    Only the histogram goes to the driver. It has at most sqrt(2 x rows) sizes, since the sizes add up to the rows;
    sizes below ``buckets`` are kept in that many hash buckets, so that numbering equal groups is never one task's work.
    """
    from pyspark.sql import Window

    spark = sizes.sparkSession
    sized = sizes.withColumn("b", F.when(F.col("n") < buckets, F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int")).otherwise(F.lit(0)))
    runs = [(r["n"], r["b"], r["k"]) for r in sized.groupBy("n", "b").agg(F.count("*").alias("k")).collect()]
    dealt = spark.createDataFrame(greedy_runs(runs, targets), "n long, b int, lo long, hi long, split string")
    place = F.row_number().over(Window.partitionBy("n", "b").orderBy("root")) - 1
    return (
        sized.withColumn("place", place)
        .join(dealt, ["n", "b"])
        .where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        .select("root", "n", "split")
    )
