"""Problem 8: records of several sources mixed to target shares of the total size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import write_out

#: Bits of the hash that one histogram level tells apart.
BITS = 10
#: Share of a source's part by which one text may exceed it.
NEAR = 0.01


def _top(h, level: int):
    """Bucket of a 64-bit hash at a level of the nested histograms."""
    return F.shiftrightunsigned(F.shiftleft(h, level * BITS), 64 - BITS)


def mix(texts: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[DataFrame, list[tuple]]:
    """Choose from ``texts`` (key, id, source, n), each text once, so that each source has its share of the tokens.

    ``targets``: (source, share, most repeats). Returns the chosen (key, id, source, n, repeats) and a report with a row
    per target: (source, share, available, wanted, used, full passes, most repeats). ``total``: tokens of the mix; the
    default is the largest mix in which every source that has text reaches its share. A source that can't give its part
    of a larger mix gives all it may; one without text gives nothing and lowers the sum.

    Method: a source gives whole passes over its texts and a part of one. The part is what lies below a threshold of the
    text's hash: tokens are summed by source and hash bucket, the bucket that crosses the budget is found and only it is
    split by the next bits, until it holds one text; a text too large for what is left is passed over. Nothing is sorted; only histograms of 2**BITS buckets a target go
    to the driver. Repeated sources in ``targets`` count once, by their first row; null ones not at all.
    """
    spark = texts.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for s, share, most in targets:
        if s is not None and share is not None and share > 0 and s not in wanted:
            wanted[s] = (share, most if most is not None and most > 0 else 0)
    listed = spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string")
    own = write_out(texts.where("n > 0").join(F.broadcast(listed), "source").withColumn("h", F.xxhash64("key")), "texts")
    have = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    can = [have[s] * most / share for s, (share, most) in wanted.items() if have.get(s)]
    size = float(total) if total is not None else min(can, default=0.0)
    passes, parts = {}, {}
    for s, (share, most) in wanted.items():
        want, n = share * size, have.get(s, 0)
        passes[s] = min(most, math.floor(want / n + 1e-12)) if n else 0
        part = want - passes[s] * n
        if n and passes[s] < most and part > 0.5:
            parts[s] = part
    # Per source: the hash prefix reached so far and what is still to be given out of the bucket below it.
    prefix, below = dict.fromkeys(parts, 0), dict(parts)
    picked: dict[str, list[tuple[int, int, int, int]]] = {s: [] for s in parts}
    open_, level, used = set(parts), 0, {s: passes[s] * have.get(s, 0) for s in wanted}
    while open_ and level < 6:
        edge = spark.createDataFrame([(s, prefix[s]) for s in sorted(open_)], "source string, prefix long")
        rows = own.join(F.broadcast(edge), "source")
        rows = rows.where(F.shiftrightunsigned("h", 64 - level * BITS) == F.col("prefix")) if level else rows
        hist: dict[str, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("source", _top(F.col("h"), level).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
            hist.setdefault(r["source"], []).append((r["b"], r["n"], r["k"]))
        for s in sorted(open_):
            low = 0
            for b, n, k in sorted(hist.get(s, [])):
                if n <= below[s]:
                    below[s] -= n
                    used[s] += n
                    continue
                picked[s].append((level, prefix[s], low, b))
                low = b + 1
                if k > 1:
                    prefix[s] = prefix[s] << BITS | b
                    break
                # One text crosses the budget: taken if that comes near enough, else passed over for smaller ones.
                if n - below[s] < min(below[s], NEAR * parts[s]):
                    picked[s].append((level, prefix[s], b, b + 1))
                    used[s] += n
                    below[s] = 0
                if below[s] < 1:
                    open_.discard(s)
                    break
            else:
                picked[s].append((level, prefix[s], low, 1 << BITS))
                open_.discard(s)
        level += 1
    cuts = [(s, *r) for s, rows in picked.items() for r in rows if r[2] < r[3]]
    plan = spark.createDataFrame([(s, passes[s], [tuple(c[1:]) for c in cuts if c[0] == s]) for s in wanted] or [("", 0, [])], "source string, passes int, cuts array<struct<level:int,prefix:long,low:long,high:long>>")
    # Within a cut: the bits before its level equal the prefix, the bits of its level lie in its range.
    bucket = f"shiftrightunsigned(shiftleft(h, cast(c.level * {BITS} as int)), {64 - BITS})"
    inside = F.expr(f"exists(cuts, c -> (c.level = 0 or shiftrightunsigned(h, cast(64 - c.level * {BITS} as int)) = c.prefix) and {bucket} >= c.low and {bucket} < c.high)")
    chosen = own.join(F.broadcast(plan), "source").withColumn("repeats", F.col("passes") + F.when(inside, 1).otherwise(0)).where("repeats > 0")
    report = [(s, share, have.get(s, 0), share * size, used[s], passes[s], most) for s, (share, most) in wanted.items()]
    return chosen.select("key", "id", "source", "n", "repeats"), report
