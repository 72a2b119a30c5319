"""Small dense fits, one group per task: Platt, temperature, ridge and shrinkage discriminant, all weighted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Rows a group may bring to one fit. Larger groups are summed over distinct rows before they come here.
FIT_ROWS = 200_000


def platt(scores: np.ndarray, positive: np.ndarray, weights: np.ndarray, ridge: float = 1e-6, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps on the weighted likelihood with a small ridge."""
    x = np.column_stack([scores, np.ones(len(scores))])
    beta = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weights @ (np.logaddexp(0, z) - positive * z) + ridge * b @ b / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (weights * (p - positive)) + ridge * beta
        if np.abs(gradient).max() < 1e-9:
            break
        hessian = x.T @ (x * (weights * p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(beta)
        while loss(beta - size * step) > now - 1e-4 * size * gradient @ step and size > 1e-8:
            size /= 2
        beta = beta - size * step
    return float(beta[0]), float(beta[1])


def temperature(logits: np.ndarray, label: np.ndarray, weights: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature with the least weighted log loss: bisection of its slope in the inverse temperature."""
    own = logits[np.arange(len(label)), label]

    def slope(inverse: float) -> float:
        z = logits * inverse
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return float(weights @ ((p * logits).sum(axis=1) - own))

    a, b = 1 / high, 1 / low
    if slope(a) >= 0:
        return high
    if slope(b) <= 0:
        return low
    for _ in range(80):
        mid = (a * b) ** 0.5
        a, b = (mid, b) if slope(mid) < 0 else (a, mid)
    return 1 / (a * b) ** 0.5


def temperature_by_group(rows: DataFrame, group: str, key: str, x: str, chosen: str, low: float = 0.05, high: float = 20.0) -> list[tuple]:
    """(group, n, temperature) by ``temperature`` of rows in long form: one per item of each ``key``, of which one is ``chosen``.

    ``x`` is a score less the greatest one of its key. The slope in the inverse temperature grows with it: Newton steps that
    leave the bracket give way to bisection. A pass sends sums per key; groups are few and go to the driver.
    """
    spark = rows.sparkSession

    def slopes(at: dict) -> dict:
        points = spark.createDataFrame([(g, b) for g, b in at.items()], rows.select(group).schema.add("b", "double"))
        e = F.exp(F.col(x) * F.col("b"))
        on = rows[group].eqNullSafe(points[group])
        per = rows.join(F.broadcast(points), on).select(rows[group], key, x, chosen, e.alias("e")).groupBy(group, key).agg(
            F.sum("e").alias("z"), F.sum(F.col("e") * F.col(x)).alias("u"), F.sum(F.col("e") * F.col(x) * F.col(x)).alias("v"), F.sum(F.when(F.col(chosen), F.col(x))).alias("own")
        )
        mean = F.col("u") / F.col("z")
        got = per.groupBy(group).agg(F.count("*").alias("n"), F.sum(mean - F.col("own")).alias("g"), F.sum(F.col("v") / F.col("z") - mean * mean).alias("h"))
        return {r[0]: tuple(r)[1:] for r in got.collect()}

    groups = [r[0] for r in rows.select(group).distinct().collect()]
    first = slopes(dict.fromkeys(groups, 1 / high)) if groups else {}
    last = slopes(dict.fromkeys(groups, 1 / low)) if groups else {}
    done = {g: high if first[g][1] >= 0 else low for g in groups if first[g][1] >= 0 or last[g][1] <= 0}
    ends = {g: (1 / high, 1 / low) for g in groups if g not in done}
    at = {g: min(max(1.0, a), b) for g, (a, b) in ends.items()}
    for _ in range(80):
        if not at:
            break
        now, then = slopes(at), {}
        for g, (_, slope, curve) in now.items():
            a, b = ends[g] = (at[g], ends[g][1]) if slope < 0 else (ends[g][0], at[g])
            step = at[g] - slope / curve if curve > 0 else 0.0
            then[g] = step if a < step < b else (a * b) ** 0.5
            if abs(then[g] - at[g]) <= 1e-11 * at[g] or b - a <= 1e-11 * a or slope == 0:
                done[g] = 1 / (at[g] if slope == 0 else then.pop(g))
                then.pop(g, None)
        at = then
    return [(g, first[g][0], done.get(g) or 1 / at[g]) for g in groups]


def ridge(x: np.ndarray, y: np.ndarray, weights: np.ndarray, k: int, lam: float) -> np.ndarray:
    """Weights (features + offset, classes) of a weighted ridge on class indicators, standardised inside."""
    total = weights.sum()
    mean = weights @ x / total
    scale = np.maximum(np.sqrt(weights @ (x - mean) ** 2 / total), 1e-8)
    z = (x - mean) / scale
    target = np.eye(k)[y]
    base = weights @ target / total
    coef = np.linalg.solve(z.T @ (z * weights[:, None]) + lam * np.eye(x.shape[1]), z.T @ ((target - base) * weights[:, None]))
    coef = coef / scale[:, None]
    return np.vstack([coef, base - mean @ coef])


def discriminant(x: np.ndarray, y: np.ndarray, weights: np.ndarray, k: int, gamma: float) -> np.ndarray:
    """Weights (features + offset, classes) of a linear discriminant with the covariance shrunk to its mean variance."""
    total, d = weights.sum(), x.shape[1]
    mass = np.array([weights[y == c].sum() for c in range(k)])
    means = np.array([weights[y == c] @ x[y == c] / max(mass[c], 1e-12) for c in range(k)])
    rest = x - means[y]
    cov = rest.T @ (rest * weights[:, None]) / total
    cov = (1 - gamma) * cov + gamma * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
    coef = np.linalg.solve(cov, means.T)
    offset = np.log(np.maximum(mass, 1e-12) / total) - 0.5 * np.einsum("cd,dc->c", means, coef)
    return np.vstack([coef, offset])


def thin_svd(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(z, basis, mean, scale): standardised features in the space that their rows span, ``z = (x - mean) / scale @ basis``."""
    total = weights.sum()
    mean = weights @ x / total
    scale = np.maximum(np.sqrt(weights @ (x - mean) ** 2 / total), 1e-8)
    u, s, vt = np.linalg.svd((x - mean) / scale, full_matrices=False)
    rank = int((s > 1e-10 * max(s.max(initial=0.0), 1e-300)).sum())
    return u[:, :rank] * s[:rank], vt[:rank].T, mean, scale


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, k: int, lam: float, steps: int = 100) -> tuple[np.ndarray, bool]:
    """((features + offset, classes), converged) of a weighted multinomial logistic regression with a ridge on the features.

    Damped Newton steps on the mean loss in the row space; offsets carry no ridge, the last one is fixed at zero.
    """
    z, basis, mean, scale = thin_svd(x, weights)
    z, w, hot = np.column_stack([z, np.ones(len(z))]), weights / weights.sum(), np.eye(k)[y]
    r = z.shape[1]
    ridge_ = np.full((r, k), lam)
    ridge_[-1] = 0.0
    free = np.ones((r, k), dtype=bool)
    free[-1, -1] = False
    free = free.ravel()
    beta = np.zeros((r, k))

    def loss(b: np.ndarray) -> float:
        u = z @ b
        top = u.max(axis=1)
        return float(w @ (top + np.log(np.exp(u - top[:, None]).sum(axis=1)) - u[np.arange(len(y)), y]) + 0.5 * (ridge_ * b * b).sum())

    def slope(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = z @ b
        p = np.exp(u - u.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return (z.T @ (w[:, None] * (p - hot)) + ridge_ * b).ravel()[free], p

    for _ in range(steps):
        g, p = slope(beta)
        if np.abs(g).max() < 1e-9:
            break
        h = np.zeros((r, k, r, k))
        for a in range(k):
            for b in range(a, k):
                h[:, a, :, b] = h[:, b, :, a] = z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
        h = h.reshape(r * k, r * k) + np.diag(ridge_.ravel())
        step = np.zeros(r * k)
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-12 * np.eye(int(free.sum())), g)
        size, now = 1.0, loss(beta)
        while loss(beta - size * step.reshape(r, k)) > now - 1e-4 * size * (g @ step[free]) + 1e-15 and size > 1e-8:
            size /= 2
        beta = beta - size * step.reshape(r, k)
    coef = (basis @ beta[:-1]) / scale[:, None]
    return np.vstack([coef, beta[-1] - mean @ coef]), bool(np.abs(slope(beta)[0]).max() < 1e-7)


def calibrator(shape: str, scores: np.ndarray, label: np.ndarray, weights: np.ndarray) -> dict:
    """The calibrator of a task's shape: a Platt curve for single scores (``fit``), a temperature for score rows (``choice``)."""
    if shape == "fit":
        slope, offset = platt(scores, (label == 0).astype(float), weights)
        return {"kind": "platt", "slope": slope, "offset": offset}
    if shape == "choice":
        return {"kind": "temperature", "temperature": temperature(scores, label, weights)}
    raise ValueError(f"unknown shape {shape!r}")


def calibrate(model: dict, scores: Column) -> Column:
    """The calibrated probability of a score, or of each score of an array."""
    if model["kind"] == "platt":
        return vectors.sigmoid(scores * model["slope"] + model["offset"])
    return vectors.softmax(scores, model["temperature"])


def platt_by_group(df: DataFrame, group: str, score: str, positive: str, weight: str) -> DataFrame:
    """(group, n, slope, offset) of a Platt curve for each group.

    The likelihood depends on distinct (score, label) pairs only, so weights are summed per pair before a group meets.
    """
    pairs = df.groupBy(F.col(group).alias("grp"), F.col(score).alias("s"), F.col(positive).cast("double").alias("y")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["y"].nunique() < 2:
            return pd.DataFrame({"grp": pdf["grp"][:1], "n": [int(pdf["n"].sum())], "slope": [None], "offset": [None]})
        pdf = pdf.sort_values(["s", "y"])
        a, b = platt(pdf["s"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"grp": pdf["grp"][:1].to_numpy(), "n": [int(pdf["n"].sum())], "slope": [a], "offset": [b]})

    return pairs.groupBy("grp").applyInPandas(fit, "grp string, n long, slope double, offset double")
