"""Problem 5: the most similar vectors of every vector, by NN-descent; greedy graph search for single queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..runtime import Written, write_out

#: Vectors that one leaf of a projection tree compares with each other, and that one task splits into leaves.
LEAF, TASK_ROWS = 160, 20_000
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def usable(vec: Column, dim: int) -> Column:
    """True for vectors with ``dim`` finite numbers that aren't all zero; false for null."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length in double precision, from the bytes of 32-bit numbers."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@F.pandas_udf(BinaryType())
def packed(vecs: pd.Series) -> pd.Series:
    """The bytes of a vector's 32-bit numbers: they travel as one value, an array as one value for each number."""
    return pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in vecs])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``key``, with the places where groups begin (and the end)."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*rest, b])
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] else 0
        if cut:
            starts = np.flatnonzero(np.r_[True, k[1:cut] != k[: cut - 1]])
            yield t.slice(0, cut), np.r_[starts, cut]
        rest = t.slice(cut).combine_chunks().to_batches()
    if rest:
        t = pa.Table.from_batches(rest)
        yield t, np.array([0, t.num_rows])


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners in each row of a similarity matrix, -2 marking what doesn't count."""
    if s.shape[1] > k:
        cols = np.argpartition(-s, k - 1, axis=1)[:, :k]
    else:
        cols = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    vals = np.take_along_axis(s, cols, 1)
    r, c = np.nonzero(vals > -2)
    return ids[r], ids[cols[r, c]], vals[r, c]


def _forest_task(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, "cell"):
            rng = np.random.default_rng(seed)
            ids, x = t.column("id").to_numpy(), _matrix(t.column("vec"))
            for a, b in zip(starts[:-1], starts[1:]):
                todo = [np.arange(a, b)]
                while todo:
                    part = todo.pop()
                    if len(part) > LEAF:
                        p, q = rng.integers(len(part), size=2)
                        way = x[part] @ ((x[part[p]] - x[part[q]]) if p != q else rng.normal(size=x.shape[1]))
                        order = np.argsort(way, kind="stable")
                        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
                        continue
                    s = x[part] @ x[part].T
                    np.fill_diagonal(s, -2)
                    yield pa.record_batch(list(_best(ids[part], s, k)), schema=EDGE)

    return run


def _join_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, "hub"):
            ids, x = t.column("id").to_numpy(), _matrix(t.column("vec"))
            fresh, bound = t.column("fresh").to_numpy(), t.column("bound").to_numpy()
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                s, f = x[a:b] @ x[a:b].T, fresh[a:b]
                np.fill_diagonal(s, -2)
                s[~(f[:, None] | f[None, :]) | (s <= bound[a:b, None])] = -2
                out.append(_best(ids[a:b], s, k))
            if out:
                yield pa.record_batch([np.concatenate(c) for c in zip(*out)], schema=EDGE)

    return run


def _cells(nodes: DataFrame, n: int, dim: int, seed: int) -> DataFrame:
    """``cell``: sign bits of random projections, with full cells dealt to several tasks."""
    bits = max(0, math.ceil(math.log2(max(1, n / (TASK_ROWS / 4)))))
    if not bits:
        return nodes.withColumn("cell", F.lit(0).cast("long"))
    planes = np.random.default_rng(seed).normal(size=(bits, dim))

    @F.pandas_udf(LongType())
    def side(vecs: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(vecs), dtype="<f4").reshape(len(vecs), -1).astype(np.float64)
        return pd.Series(((x @ planes.T > 0) * 2 ** np.arange(bits)).sum(axis=1))

    rows = nodes.withColumn("cell", side("vec"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / TASK_ROWS).cast("long").alias("deal"))
    # At most 2**bits < 8 n / TASK_ROWS cells; beyond a million of them the join shuffles.
    sizes = F.broadcast(sizes) if bits <= 20 else sizes
    return rows.join(sizes, "cell").withColumn("cell", F.col("cell") * 1_000_000 + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("deal"))).drop("deal")


def _top(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def nn_descent(nodes: DataFrame, dim: int, k: int = 12, trees: int = 5, rounds: int = 8, stop: float = 0.002, seed: int = 7) -> DataFrame:
    """(u, v, sim): a graph of the ``k`` most similar other nodes of every node of ``nodes`` (id: long, vec: array<float>).

    Random projection trees give the first graph. Each round joins, at every node, its neighbours and reverse
    neighbours with each other, as far as one of the two is new there, and keeps better pairs; reverse lists enter with
    their ``k`` best. It ends when fewer than ``stop`` of all edges changed. Every node is indexed; recall is
    approximate (the tests hold it to 0.9 at least against brute force). Vectors travel as the bytes of 32-bit numbers.
    """
    kept = Written(nodes.select("id", packed("vec").alias("vec")), "packed")
    nodes, n = kept.df, kept.df.count()
    first = None
    for t in range(trees):
        cells = _cells(nodes, n, dim, seed + t).repartition("cell").sortWithinPartitions("cell")
        e = cells.select("cell", "id", "vec").mapInArrow(_forest_task(k, seed + t), "u long, v long, sim double")
        first = e if first is None else first.union(e)
    graph = Written(_top(first.groupBy("u", "v").agg(F.max("sim").alias("sim")), k).withColumn("fresh", F.lit(True)), "graph")
    for _ in range(rounds):
        g = graph.df
        back = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
        reverse = g.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k)
        members = (
            g.select(F.col("u").alias("hub"), F.col("v").alias("id"), "fresh")
            .union(reverse.select(F.col("v").alias("hub"), F.col("u").alias("id"), "fresh"))
            .union(g.groupBy("u").agg(F.max("fresh").alias("fresh")).select(F.col("u").alias("hub"), F.col("u").alias("id"), "fresh"))
            .groupBy("hub", "id")
            .agg(F.max("fresh").alias("fresh"))
        )
        # Where nothing is new, nothing is joined: such hubs send no vectors.
        new = g.where("fresh")
        lively = new.select(F.col("u").alias("hub")).union(new.select(F.col("v").alias("hub"))).distinct()
        members = members.join(lively, "hub", "left_semi")
        bounds = g.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-1.5)).alias("bound")).withColumnRenamed("u", "id")
        work = members.join(nodes.join(bounds, "id", "left").select("id", "vec", F.coalesce("bound", F.lit(-1.5)).alias("bound")), "id")
        found = work.select("hub", "id", "fresh", "bound", "vec").repartition("hub").sortWithinPartitions("hub").mapInArrow(_join_task(k), "u long, v long, sim double")
        both = found.withColumn("fresh", F.lit(True)).union(g.select("u", "v", "sim", F.lit(False).alias("fresh")))
        # A known edge keeps its first similarity, so that rounding never makes it new.
        merged = both.groupBy("u", "v").agg(F.max_by("sim", F.struct(~F.col("fresh"), F.col("sim"))).alias("sim"), F.min("fresh").alias("fresh"))
        now = Written(_top(merged, k), "graph")
        changed = now.df.where("fresh").count()
        graph.drop()
        graph = now
        if changed <= stop * n * k:
            break
    kept.drop()
    return graph.df.select("u", "v", "sim")


def classes(df: DataFrame, key: str, vec: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (id, vec) and their keys (key, id).

    A key counts once, with the smallest of its vectors. Equal vectors are one node, so that a vector shared by a third
    of all keys is no hot spot: a node's number is a hash of its vector and the keys carry it without a join.
    """
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vec), dim)).groupBy(F.col(key).alias("key")).agg(F.min(vec).alias("vec"))
    # -0.0 and 0.0 are equal numbers.
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))
    rows = write_out(rows.withColumn("id", F.xxhash64(plain)), "vectors")
    return write_out(rows.groupBy("id").agg(F.min("vec").alias("vec")), "nodes"), rows.select("key", "id")


def most_similar(df: DataFrame, key: str, vec: str, dim: int, k: int = 5) -> DataFrame:
    """(key, other, sim, place): the ``k`` most similar other keys of every usable key, ties by the smaller key.

    Null, short, zero and not finite vectors take no part; repeated rows count once; fewer than ``k`` other keys give
    fewer rows; an empty table gives none.
    """
    nodes, keys = classes(df, key, vec, dim)
    graph = nn_descent(nodes, dim, k=max(12, 2 * k + 2))
    # Only the first k + 1 keys of a vector can rank among others; all its keys get neighbours below.
    first = Window.partitionBy("id").orderBy("key")
    small = write_out(keys.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r"), "small")
    near = graph.select("u", "v", "sim").union(nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(2.0).alias("sim")))
    offers = near.join(small.select(F.col("id").alias("v"), F.col("key").alias("other")), "v").select("u", "other", "sim")
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "other")
    best = offers.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = best.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("_r", "other", F.least("sim", F.lit(1.0)).alias("sim")))).alias("near")).withColumnRenamed("u", "id")
    # A node with many keys meets one list; AQE splits its side.
    chosen = F.slice(F.filter("near", lambda x: x["other"] != F.col("key")), 1, k)
    return keys.join(lists, "id").select("key", F.posexplode(chosen).alias("place", "n")).select("key", F.col("n.other").alias("other"), F.col("n.sim").alias("sim"), (F.col("place") + 1).alias("place"))


def greedy_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, beam: int = 32, entries: int = 256, rounds: int = 30) -> DataFrame:
    """(q, v, sim): the ``k`` best nodes found for each of ``queries`` (q, qvec) by walking ``graph``.

    Each query starts from ``entries`` fixed nodes (a bounded sample: the smallest hashes of the id), keeps its ``beam``
    best nodes and expands the neighbours of those not yet expanded, until none is left or ``rounds`` are over.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    cosine = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) / (norm(F.col("qvec")) * norm(F.col("vec")))
    starts = nodes.orderBy(F.xxhash64("id")).limit(entries)
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    cut = lambda d: d.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= beam).drop("_r")
    sims = queries.crossJoin(F.broadcast(starts)).select("q", F.col("id").alias("v"), cosine.alias("sim"))
    state = Written(cut(sims).withColumn("open", F.lit(True)), "beam")
    reach = graph.select(F.col("u").alias("v"), F.col("v").alias("w"))
    for _ in range(rounds):
        if state.df.where("open").isEmpty():
            break
        new = state.df.where("open").join(reach, "v").select("q", F.col("w").alias("v")).distinct().join(state.df.select("q", "v"), ["q", "v"], "left_anti")
        scored = new.join(nodes.select(F.col("id").alias("v"), "vec"), "v").join(queries, "q").select("q", "v", cosine.alias("sim"), F.lit(True).alias("open"))
        now = Written(cut(state.df.select("q", "v", "sim", F.lit(False).alias("open")).union(scored)), "beam")
        state.drop()
        state = now
    return state.df.select("q", "v", "sim").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
