"""Calibrators and linear probes, fitted group by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fits, probe
from ..runtime import bounded_broadcast, read, write_out
from .arrays import option_scores
from .evaluation import predictions
from .registry import query
from .store import decisions


#: Rows of the sample that a logistic fit reads.
SAMPLE = 20_000


@query(None)
def platt_per_task(spark: SparkSession, d: str) -> DataFrame:
    """A Platt curve per task: was the decision written, by its score."""
    rows = decisions(spark, d).where("s_c is not null and not isnan(s_c)").withColumn("y", (F.col("outcome") == "auto").cast("int")).withColumn("w", F.lit(1.0))
    got = fits.platt_by_group(rows, "task_id", "s_c", "y", "w")
    return got.select(F.col("grp").alias("task_id"), "n", F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset"))


@query(None)
def platt_per_fold(spark: SparkSession, d: str) -> DataFrame:
    """A Platt curve for each held-out card from the predictions of all other cards.

    Sums over distinct scores are subtracted for the card, so no row is copied to every fold.
    """
    rows = predictions(spark, d).select("grp", F.col("p_yes").alias("s"), (F.col("label") == 0).cast("double").alias("y"))
    own = rows.groupBy("grp", "s", "y").agg(F.count("*").alias("n"))
    # Distinct scores of a lookup are few (two counts each); their number is checked before they meet every fold.
    total = bounded_broadcast(write_out(own.groupBy("s", "y").agg(F.sum("n").alias("all")), "scores"))
    pairs = own.select("grp").distinct().crossJoin(total).join(own, ["grp", "s", "y"], "left").withColumn("w", (F.col("all") - F.coalesce("n", F.lit(0))).cast("double")).where("w > 0")
    got = fits.platt_by_group(pairs, "grp", "s", "y", "w")
    return got.select("grp", F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset"))


@query(None)
def temperature_per_task(spark: SparkSession, d: str) -> DataFrame:
    """The temperature of the option scores of each task, fitted to the chosen options of all its decisions.

    Scores stay in long form; the steps of the fits of all tasks are taken together, each from sums per task.
    """
    asked = decisions(spark, d).where("answer_index >= 0").select("decision_id", "task_id", "answer_index")
    rows = option_scores(spark, d).join(asked, "decision_id").where("answer_index < n")
    scored = write_out(rows.select("task_id", "decision_id", (F.col("s") - F.col("m")).alias("x"), (F.col("place") == F.col("answer_index")).alias("chosen")), "offered")
    got = fits.temperature_by_group(scored, "task_id", "decision_id", "x", "chosen")
    return spark.createDataFrame([(t, n, round(v, 6)) for t, n, v in got], "task_id string, n long, temperature double")


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(fold, x, y) of all embeddings, folds by vec_id modulo 8, and the number of classes."""
    rows = read(spark, d, "embeddings").where("vec_id is not null and embedding is not null and label is not null")
    rows = rows.select((F.col("vec_id") % 8).cast("int").alias("fold"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("int").alias("y"))
    return rows, (rows.agg(F.max("y")).first()[0] or 0) + 1


def _probe(spark: SparkSession, d: str, fitter: str, grid: list[float]) -> DataFrame:
    """Held-out hits of a probe on the embeddings for each fold and grid value; all rows are fitted and scored."""
    got = probe.cross_validate(*_embedded(spark, d), fitter, grid)
    return spark.createDataFrame([(f, i, v, n, h) for f, i, v, n, h, _ in got], "fold int, arm int, value double, n long, hits long")


@query(None)
def ridge_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d, "ridge", [0.1, 1.0, 10.0])


@query(None)
def discriminant_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d, "discriminant", [0.1, 0.5, 0.9])


@query(None)
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """Nested cross-validation of the shrinkage discriminant: value, temperature, hits and loss of each outer fold."""
    got = probe.nested(*_embedded(spark, d), "discriminant", [0.1, 0.5, 0.9])
    return spark.createDataFrame([(f, v, t, n, h, round(loss / n, 6)) for f, v, t, n, h, loss in got], "fold int, value double, temperature double, n long, hits long, loss double")


@query(None)
def logistic_per_fold(spark: SparkSession, d: str) -> DataFrame:
    """Multinomial ridge logistic regression on the embeddings: held-out hits of each fold.

    A fit reads a bounded sample, at most about ``SAMPLE`` rows by hash; the held-out rows are all scored.
    """
    rows, k = _embedded(spark, d)
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("x", "y"), F.lit(max(1, n))) < SAMPLE).select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("out"), "fold", "x", "y").where("out <> fold")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy()
        w, done = fits.logistic(x, y, np.ones(len(y)), k, 0.01)
        return pd.DataFrame({"out": pdf["out"][:1].to_numpy(), "w": [w.ravel().tolist()], "converged": [done]})

    models = {r["out"]: (np.reshape(r["w"], (-1, k)), r["converged"]) for r in sample.groupBy("out").applyInPandas(fit, "out int, w array<double>, converged boolean").collect()}
    got = probe.score(rows, {str(f): (f, w) for f, (w, _) in models.items()})
    return spark.createDataFrame([(f, models[f][1], *got[str(f), 1.0][:2]) for f in sorted(models) if (str(f), 1.0) in got], "fold int, converged boolean, n long, hits long")
