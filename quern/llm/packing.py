"""Problem 7: items of varying length filled into containers of fixed capacity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Written, bounded_broadcast, write_out

#: Items that one task packs, and the fill from which a container isn't opened again.
SHARD, CLOSED = 20_000, 0.98
#: Weights of what is left of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.1, 0.1)

_ROW = "limit_id int, cap int, key string, piece int, start int, n int"


class Bins:
    """Open containers of one shard, found by their residual tokens."""

    def __init__(self, tokens: int, docs: int, attention: float):
        self.cap = (tokens, docs, attention)
        self.left: list[list[float]] = []
        self.by: dict[int, list[int]] = {}
        self.mask = 0

    def _norm(self, left: list[float], n: int) -> float:
        rest = (left[0] - n, left[1] - 1, left[2] - n * n)
        return sum(w * (r / c) ** 2 for w, r, c in zip(WEIGHTS, rest, self.cap))

    def put(self, n: int) -> int:
        """The container for an item of ``n`` tokens: of all that fit under every constraint, the one with the least
        weighted norm of what would be left, the oldest of equal ones; a new one if none fits.

        Containers are visited from the tightest upwards; what the room in tokens alone adds to the norm ends the search."""
        best, above, at, area = None, self.mask >> n, n, n * n
        while above:
            step = (above & -above).bit_length() - 1
            at, above = at + step, above >> step
            if best is not None and WEIGHTS[0] * ((at - n) / self.cap[0]) ** 2 > best[0]:
                break
            for b in self.by[at]:
                left = self.left[b]
                if left[1] >= 1 and left[2] >= area:
                    score = self._norm(left, n)
                    if best is None or (score, b) < best:
                        best = (score, b)
            at, above = at + 1, above >> 1
        if best is None:
            b = len(self.left)
            self.left.append([float(c) for c in self.cap])
        else:
            b = best[1]
            old = int(self.left[b][0])
            self.by[old].remove(b)
            if not self.by[old]:
                del self.by[old]
                self.mask &= ~(1 << old)
        left = self.left[b]
        left[0] -= n
        left[1] -= 1
        left[2] -= n * n
        # A container without room for a document is not looked at again.
        if left[1] >= 1:
            self.by.setdefault(int(left[0]), []).append(b)
            self.mask |= 1 << int(left[0])
        return b


def _pack(level: int, docs: int, attention: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, now, rows = None, None, []

        def done() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["limit_id", "cap", "key", "piece", "start", "n", "shard", "bin"])
            full = [b for b, left in enumerate(bins.left) if left[0] <= (1 - CLOSED) * bins.cap[0] or left[1] < 1]
            out["closed"] = out["bin"].isin(full)
            out["container_id"] = out["limit_id"].astype(str) + f"-{level}-" + out["shard"].astype(str) + "-" + out["bin"].astype(str)
            return out[["limit_id", "cap", "key", "piece", "start", "n", "closed", "container_id"]]

        for b in batches:
            for limit, shard, cap, key, piece, start, n in b[["limit_id", "shard", "cap", "key", "piece", "start", "n"]].itertuples(index=False):
                if (limit, shard) != now:
                    if rows:
                        yield done()
                    bins, now, rows = Bins(cap, docs, attention * cap * cap), (limit, shard), []
                rows.append((limit, cap, key, piece, start, n, shard, bins.put(n)))
        if rows:
            yield done()

    return run


def pack(items: DataFrame, limits: DataFrame, max_docs: int = 64, attention: float = 1.0, shard: int = SHARD) -> DataFrame:
    """(limit_id, container_id, key, piece, start, n): every item of ``items`` (key: string, n: int) in a container.

    ``limits``: (limit_id, capacity_tokens). A container holds at most its tokens, ``max_docs`` items and an attention
    cost (sum of squared lengths) of ``attention`` x capacity². An item longer than the capacity is cut into pieces of
    full containers and a rest; no other item is cut. Items without tokens are packed as well; items without key or a
    size take no part, an item that is repeated counts once. Limits without positive capacity hold nothing.

    Method: vector best-fit, longest first, in shards of ``shard`` items by hash of the key; the items of containers
    that stay open are pooled and packed again in fewer shards, until one is left, so that each level of a limit wastes
    a few containers at most and no task holds more than its shard.
    """
    fixed = bounded_broadcast(limits.where("limit_id is not null and capacity_tokens > 0").select("limit_id", F.col("capacity_tokens").alias("cap")))
    one = items.where("key is not null and n is not null and n >= 0").groupBy("key").agg(F.max("n").alias("n"))
    all_ = one.crossJoin(fixed)
    count = F.when(F.col("n") > F.col("cap"), F.ceil(F.col("n") / F.col("cap"))).otherwise(1).cast("int")
    pieces = all_.select("limit_id", "cap", "key", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * F.col("cap")).withColumn("n", F.least("cap", F.col("total") - F.col("start")))
    pieces = Written(pieces.select("limit_id", "cap", "key", "piece", "start", "n"), "pieces")
    whole = (F.col("n") == F.col("cap"))
    full = pieces.df.where(whole).select("limit_id", F.concat_ws("-", "limit_id", F.lit("full"), "key", "piece").alias("container_id"), "key", "piece", "start", "n")
    out, rest, level = [full], pieces.df.where(~whole), 0
    left = rest.groupBy("limit_id").count().agg(F.max("count")).first()[0] or 0
    while left:
        shards = math.ceil(left / shard)
        sharded = rest.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(level)), F.lit(shards)).cast("int"))
        sharded = sharded.repartition("limit_id", "shard").sortWithinPartitions("limit_id", "shard", F.desc("n"), "key", "piece")
        packed = write_out(sharded.mapInPandas(_pack(level, max_docs, attention), _ROW + ", closed boolean, container_id string"), "packed")
        again = packed.where("not closed").select("limit_id", "cap", "key", "piece", "start", "n")
        more = 0 if shards == 1 else again.groupBy("limit_id").count().agg(F.max("count")).first()[0] or 0
        last = shards == 1 or more > 0.8 * left
        out.append((packed if last else packed.where("closed")).select("limit_id", "container_id", "key", "piece", "start", "n"))
        if last:
            break
        rest, left, level = again, more, level + 1
    result = out[0]
    for o in out[1:]:
        result = result.union(o)
    return result
