"""Leave-one-group-out lookup tables, by subtraction instead of one pass per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_out


def _ranked(counts: Column) -> Column:
    """Label counts, most frequent first, ties by the first group and item in which the label was seen."""
    return F.sort_array(F.collect_list(F.when(F.col("c") > 0, F.struct((-F.col("c")).alias("minus"), counts.alias("first"), F.col("label")))))


def leave_one_group_out(items: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Predictions for ``items`` (item, grp, key, label: 0..k-1), each made from the items of all other groups.

    Adds: ``pred`` (most frequent label of the key, else the majority), ``majority``, ``probs`` (Laplace with ``alpha``,
    the prior for unseen keys, uniform without any other item), ``novel`` (key unseen), ``conflicting`` (more than one
    label), ``tied`` (the two most frequent labels equal). Ties go to the label seen first by group, then item.

    A group's counts are subtracted from the totals; for ties the first sighting and the first one in another group are
    kept. So nothing is counted once per fold, and hot keys and groups meet as partial sums. Rows without group, key or
    label take no part.
    """
    rows = items.where("grp is not null and key is not null and label is not null").select("item", "grp", "key", "label")
    own = write_out(rows.groupBy("key", "label", "grp").agg(F.count("*").alias("n"), F.min("item").alias("item")), "counts")

    def minus_own(own: DataFrame, keys: list[str]) -> DataFrame:
        """For every group and key: (label, count, first sighting) over the other groups."""
        firsts = own.groupBy(*keys, "label").agg(F.sum("n").alias("all"), F.min(F.struct("grp", "item")).alias("f1"))
        others = own.join(firsts.select(*keys, "label", F.col("f1.grp").alias("g1")), [*keys, "label"]).where("grp <> g1")
        second = others.groupBy(*keys, "label").agg(F.min(F.struct("grp", "item")).alias("f2"))
        total = firsts.join(second, [*keys, "label"], "left")
        asked = own.select(*keys, "grp").distinct()
        mine = own.select(*keys, "label", "grp", F.col("n").alias("mine"))
        pairs = asked.join(total, keys) if keys else asked.crossJoin(F.broadcast(total))
        joined = pairs.join(mine, [*keys, "label", "grp"], "left")
        first = F.when(F.col("f1.grp") == F.col("grp"), F.col("f2")).otherwise(F.col("f1"))
        return joined.select(*keys, "grp", "label", (F.col("all") - F.coalesce("mine", F.lit(0))).alias("c"), first.alias("first"))

    by_key = minus_own(own, ["key"]).groupBy("key", "grp").agg(_ranked(F.col("first")).alias("r"))
    prior_own = own.groupBy("label", "grp").agg(F.sum("n").alias("n"), F.min("item").alias("item"))
    # At most k labels a group: the totals are k rows.
    prior = minus_own(prior_own, []).groupBy("grp").agg(_ranked(F.col("first")).alias("p"))
    joined = rows.join(by_key, ["key", "grp"]).join(prior, "grp")
    seen = F.size("r") > 0
    majority = F.coalesce(F.try_element_at("p", F.lit(1))["label"], F.lit(0))
    count = lambda a, label: F.aggregate(F.filter(a, lambda x: x["label"] == label), F.lit(0).cast("long"), lambda s, x: s - x["minus"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s - x["minus"])
    labels = F.array(*[F.lit(i) for i in range(k)])
    smooth = F.transform(labels, lambda c: (count(F.col("r"), c) + alpha) / (total(F.col("r")) + alpha * k))
    plain = F.transform(labels, lambda c: count(F.col("p"), c) / total(F.col("p")))
    flat = F.transform(labels, lambda c: F.lit(1.0 / k))
    return joined.select(
        "item",
        "grp",
        "key",
        "label",
        F.when(seen, F.try_element_at("r", F.lit(1))["label"]).otherwise(majority).alias("pred"),
        majority.alias("majority"),
        F.when(seen, smooth).when(F.size("p") > 0, plain).otherwise(flat).alias("probs"),
        (~seen).alias("novel"),
        (F.size("r") > 1).alias("conflicting"),
        F.coalesce(F.try_element_at("r", F.lit(1))["minus"] == F.try_element_at("r", F.lit(2))["minus"], F.lit(False)).alias("tied"),
    )


def fold_guards(items: DataFrame, k: int, min_train: int = 30, min_heldout: int = 5) -> DataFrame:
    """Per group: class counts inside and outside, and the first guard that the fold fails (null if none)."""
    own = items.groupBy("grp").agg(*[F.count_if(F.col("label") == c).alias(f"in_{c}") for c in range(k)])
    total = own.agg(*[F.sum(f"in_{c}").alias(f"all_{c}") for c in range(k)])
    both = own.crossJoin(F.broadcast(total))
    train = F.least(*[F.col(f"all_{c}") - F.col(f"in_{c}") for c in range(k)])
    held = F.least(*[F.col(f"in_{c}") for c in range(k)])
    reason = F.when(train < min_train, "train_below_guard").when(held < min_heldout, "heldout_below_guard")
    return both.select("grp", train.alias("min_train"), held.alias("min_heldout"), reason.alias("skipped"))
