"""Tie-invariant metrics of predictions, from sums per distinct score.

A row's score enters only through its tie group, so every curve is computed over distinct scores: rows are first summed
per (task, score), and running sums are taken in score cells with the sums of the cells before them. No window ever holds
a whole task, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_out

#: Cells over the scores of a task: their sums are few enough for one window and a broadcast.
CELLS = 4096


def _with(df: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the sums of its group: one row is broadcast, one row for each group is joined as its size demands."""
    return df.join(sums, by) if by else df.crossJoin(F.broadcast(sums))


def tie_groups(df: DataFrame, by: list[str], score: str, descending: bool = True, **sums) -> DataFrame:
    """Distinct scores with their sums and, as ``<name>_before``, the sums of all better (or, ascending, smaller) ones."""
    ties = write_out(df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, score).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "ties")
    span = ties.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (CELLS - 1))).otherwise(0)
    celled = _with(ties, span, by).withColumn("_cell", cell.cast("int")).drop("_lo", "_hi")
    turn = F.desc if descending else F.asc
    ahead = Window.partitionBy(*by).orderBy(turn("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*by, "_cell").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = cells.select(*by, "_cell", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_cell").orderBy(turn(score)).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(f"{n}_before") for n in sums]
    # Without groups there are CELLS offsets at most; with groups they grow with the data.
    return celled.join(offsets if by else F.broadcast(offsets), [*by, "_cell"]).select(*by, score, *sums, *before)


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Chance that a positive row scores above a negative one, ties half; null where a class is missing."""
    pos, neg = F.col(positive).cast("int"), 1 - F.col(positive).cast("int")
    ties = tie_groups(df, by, score, False, p=pos, n=neg)
    wins = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return ties.groupBy(*by).agg((wins / F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0))).alias("auroc"))


def ece(df: DataFrame, by: list[str], conf: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-mass bins of the rows by confidence; correctness is averaged within ties.

    With fewer rows than bins every row is its own bin. Bins are cut inside a tie group where the row counts say so.
    """
    ties = tie_groups(df, by, conf, False, n=F.lit(1), c=F.col(correct).cast("int"))
    totals = ties.groupBy(*by).agg(F.sum("n").alias("_n"))
    t = _with(ties, totals, by)
    # The first _n % bins bins hold one row more.
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    b = F.explode(F.sequence(F.lit(0), F.least(F.lit(bins), F.col("_n")).cast("int") - 1)).alias("b")
    spread = t.select("*", small.alias("_s"), more.alias("_m"), b)
    low = F.col("b") * F.col("_s") + F.least("b", "_m")
    high = low + F.col("_s") + F.when(F.col("b") < F.col("_m"), 1).otherwise(0)
    part = F.least(high, F.col("n_before") + F.col("n")) - F.greatest(low, F.col("n_before"))
    cut = spread.withColumn("_k", part).where("_k > 0")
    per = cut.groupBy(*by, "b", "_n").agg(F.sum("_k").alias("k"), F.sum(F.col("_k") * F.col(conf)).alias("conf"), F.sum(F.col("_k") * F.col("c") / F.col("n")).alias("acc"))
    return per.groupBy(*by).agg(F.sum(F.abs(F.col("conf") - F.col("acc")) / F.col("_n")).alias("ece"))


def ece_ordered(df: DataFrame, conf: str, order: str, correct: str, bins: int = 15) -> DataFrame:
    """The same without averaging: rows of equal confidence stand in the order of a unique hexadecimal string column.

    Places within a tie come from the sizes of cells of the string's first three characters, so no task holds a tie group.
    """
    rows = df.select(F.col(conf).alias("conf"), F.col(order).alias("o"), F.col(correct).cast("int").alias("c"), F.substring(order, 1, 3).alias("cell"))
    ties = tie_groups(rows, [], "conf", False, n=F.lit(1)).select("conf", "n_before")
    tie = Window.partitionBy("conf").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("conf", "cell").agg(F.count("*").alias("k")).select("conf", "cell", F.coalesce(F.sum("k").over(tie), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conf", "cell").orderBy("o")) - 1 + F.col("before") + F.col("n_before")
    total = rows.agg(F.count("*").alias("n"))
    at = rows.join(cells, ["conf", "cell"]).join(ties, "conf").crossJoin(F.broadcast(total)).select("conf", "c", "n", place.alias("place"))
    # The first n % bins bins hold one row more.
    small, more = F.floor(F.col("n") / bins), F.col("n") % bins
    b = F.when(F.col("place") < more * (small + 1), F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    per = at.groupBy(b.alias("b"), "n").agg(F.sum("conf").alias("conf"), F.sum("c").alias("acc"))
    return per.agg(F.sum(F.abs(F.col("conf") - F.col("acc")) / F.col("n")).alias("ece"))


def risk_curve(df: DataFrame, by: list[str], conf: str, correct: str) -> DataFrame:
    """Rows by falling confidence: (place, coverage, risk of the rows so far), correctness averaged within ties."""
    ties = tie_groups(df, by, conf, True, n=F.lit(1), c=F.col(correct).cast("int"))
    totals = ties.groupBy(*by).agg(F.sum("n").alias("_n"))
    t = _with(ties, totals, by)
    # Long tie groups are unrolled in blocks, each by a task of its own.
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10_000).cast("int"))).alias("_b")
    blocks = t.select("*", block).repartition(*by, conf, "_b") if by else t.select("*", block).repartition(conf, "_b")
    j = F.explode(F.sequence(F.col("_b") * 10_000 + 1, F.least(F.col("n"), (F.col("_b") + 1) * 10_000))).alias("j")
    rows = blocks.select("*", j)
    place = F.col("n_before") + F.col("j")
    risk = lambda k: 1 - (F.col("c_before") + k * F.col("c") / F.col("n")) / (F.col("n_before") + k)
    before = F.when(place > 1, F.when(F.col("j") > 1, risk(F.col("j") - 1)).otherwise(1 - F.col("c_before") / F.col("n_before")))
    return rows.select(*by, place.alias("place"), (place / F.col("_n")).alias("coverage"), risk(F.col("j")).alias("risk"), before.alias("risk_before"), F.col("_n").alias("rows"))


def curve_summary(curve: DataFrame, by: list[str], risks: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """Area under the risk curve (trapezoids from the first row) and the largest coverage within each risk."""
    area = F.sum(F.coalesce((F.col("risk") + F.col("risk_before")) / 2 / F.col("rows"), F.lit(0.0))).alias("aurc")
    within = [F.coalesce(F.max(F.when(F.col("risk") <= r, F.col("coverage"))), F.lit(0.0)).alias(f"coverage_{round(r * 100)}") for r in risks]
    return curve.groupBy(*by).agg(area, *within)


def reliability(df: DataFrame, by: list[str], conf: str, correct: str, bins: int = 10) -> DataFrame:
    """Non-empty equal-width bins (low, high] of the confidence with mean confidence and correctness; zero is in none."""
    b = F.ceil(F.col(conf) * bins).cast("int")
    rows = df.withColumn("bin", b).where(F.col("bin").between(1, bins))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))


def scores(df: DataFrame, by: list[str], probs: str, label: str) -> DataFrame:
    """Rows, accuracy, Brier score and negative log likelihood of probability arrays."""
    p = F.col(probs)
    own = F.element_at(p, F.col(label) + 1)
    hit = (F.array_position(p, F.array_max(p)) - 1 == F.col(label)).cast("double")
    square = F.aggregate(F.transform(p, lambda v, i: F.pow(v - (i == F.col(label)).cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(square).alias("brier"), (-F.avg(F.ln(F.greatest(own, F.lit(1e-12))))).alias("nll"))


def macro_f1(df: DataFrame, by: list[str], pred: str, label: str) -> DataFrame:
    """Mean F1 over the classes that occur as label or prediction."""
    counts = df.groupBy(*by, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count("*").alias("n"))
    sides = counts.select(*by, F.col("_l").alias("c"), "_l", "_p", "n").union(counts.where("_l <> _p").select(*by, F.col("_p").alias("c"), "_l", "_p", "n"))
    per = sides.groupBy(*by, "c").agg(F.sum(F.when(F.col("_l") == F.col("_p"), 2 * F.col("n")).otherwise(0)).alias("hit2"), F.sum(F.when(F.col("_l") != F.col("_p"), F.col("n")).otherwise(0)).alias("miss"))
    return per.groupBy(*by).agg(F.avg(F.col("hit2") / (F.col("hit2") + F.col("miss"))).alias("macro_f1"))
