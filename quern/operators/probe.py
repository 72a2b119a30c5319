"""Linear probes over folds from sums: one pass gives the moments of every fold, all fits are made of their differences.

A fit without some folds is the total less their moments, so no row is copied to a fold, an inner fold or a grid value.
What goes to the driver is folds x classes x features² numbers; rows are read again only to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Moments = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Temperatures tried for the held-out scores, in order.
TEMPERATURES = [float(t) for t in np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))]


def moments(rows: DataFrame, classes: int) -> dict[int, Moments]:
    """{fold: (count, sum, sum of outer products) per class} of ``rows`` (fold: int, x: array<double>, y: 0..classes-1)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for (f, y), g in b.groupby(["fold", "y"]):
                x = np.array(g["x"].tolist(), dtype=float)
                n, s, q = held.get((f, y), (0, 0.0, 0.0))
                held[f, y] = [n + len(x), s + x.sum(axis=0), q + x.T @ x]
        if held:
            yield pd.DataFrame([(f, y, n, s.tolist(), q.ravel().tolist()) for (f, y), (n, s, q) in held.items()], columns=["fold", "y", "n", "s", "q"])

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.sum(np.array(pdf[c].tolist()), axis=0).tolist()
        return pd.DataFrame({"fold": pdf["fold"][:1], "y": pdf["y"][:1], "n": [int(pdf["n"].sum())], "s": [add("s")], "q": [add("q")]})

    schema = "fold int, y int, n long, s array<double>, q array<double>"
    out: dict[int, Moments] = {}
    # One row per task and class of a fold meets here.
    for r in rows.mapInPandas(part, schema).groupBy("fold", "y").applyInPandas(both, schema).collect():
        d = len(r["s"])
        n, s, q = out.setdefault(r["fold"], (np.zeros(classes), np.zeros((classes, d)), np.zeros((classes, d, d))))
        n[r["y"]], s[r["y"]], q[r["y"]] = r["n"], r["s"], np.reshape(r["q"], (d, d))
    return out


def without(folds: dict[int, Moments], *left_out: int) -> Moments:
    """The sums over all other folds."""
    rest = [m for f, m in folds.items() if f not in left_out]
    return tuple(np.sum([m[i] for m in rest], axis=0) for i in range(3))


def ridge(m: Moments, lam: float) -> np.ndarray:
    """As ``fits.ridge`` with equal weights, from moments: (features + offset, classes)."""
    n, s, q = m
    total, mean = n.sum(), s.sum(axis=0) / n.sum()
    spread = q.sum(axis=0) - total * np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(spread), 0) / total), 1e-8)
    base = n / total
    coef = np.linalg.solve(spread / np.outer(scale, scale) + lam * np.eye(len(mean)), ((s - n[:, None] * mean) / scale).T) / scale[:, None]
    return np.vstack([coef, base - mean @ coef])


def discriminant(m: Moments, gamma: float) -> np.ndarray:
    """As ``fits.discriminant`` with equal weights, from moments: (features + offset, classes)."""
    n, s, q = m
    total, d = n.sum(), s.shape[1]
    means = s / np.maximum(n, 1e-12)[:, None]
    cov = (q.sum(axis=0) - (means.T * n) @ means) / total
    cov = (1 - gamma) * cov + gamma * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
    coef = np.linalg.solve(cov, means.T)
    return np.vstack([coef, np.log(np.maximum(n, 1e-12) / total) - 0.5 * np.einsum("cd,dc->c", means, coef)])


FITTERS = {"ridge": ridge, "discriminant": discriminant}


def score(rows: DataFrame, models: dict[str, tuple[int, np.ndarray]], temperatures: dict[str, list[float]] | None = None) -> dict[tuple[str, float], tuple[int, int, float]]:
    """{(model, temperature): (rows, hits, loss)}: each model over the rows of its fold; loss is the sum of -ln p of the softmax."""
    by_fold: dict[int, list[tuple[str, np.ndarray, list[float]]]] = {}
    for name, (fold, w) in models.items():
        by_fold.setdefault(fold, []).append((name, w, (temperatures or {}).get(name, [1.0])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fold, g in b.groupby("fold"):
                x, y = np.array(g["x"].tolist(), dtype=float), g["y"].to_numpy()
                x = np.column_stack([x, np.ones(len(x))])
                for name, w, temps in by_fold.get(fold, []):
                    z = x @ w
                    hits = int((z.argmax(axis=1) == y).sum())
                    for t in temps:
                        u = z / t
                        top = u.max(axis=1, keepdims=True)
                        log_p = u[np.arange(len(y)), y] - top[:, 0] - np.log(np.exp(u - top).sum(axis=1))
                        out.append((name, t, len(y), hits, float(-np.maximum(log_p, np.log(1e-12)).sum())))
            yield pd.DataFrame(out, columns=["model", "t", "n", "hits", "loss"])

    got = rows.mapInPandas(run, "model string, t double, n long, hits long, loss double").groupBy("model", "t").agg(F.sum("n"), F.sum("hits"), F.sum("loss"))
    return {(r[0], r[1]): (r[2], r[3], r[4]) for r in got.collect()}


def cross_validate(rows: DataFrame, classes: int, fitter: str, grid: list[float]) -> list[tuple]:
    """(fold, arm, value, n, hits, loss): every fold scored by the fits to all others, for each grid value."""
    folds = moments(rows, classes)
    if len(folds) < 2:
        return []
    models = {f"{f}|{i}": (f, FITTERS[fitter](without(folds, f), v)) for f in folds for i, v in enumerate(grid)}
    got = score(rows, models)
    return [(f, i, v, *got[f"{f}|{i}", 1.0]) for f in sorted(folds) for i, v in enumerate(grid)]


def nested(rows: DataFrame, classes: int, fitter: str, grid: list[float]) -> list[tuple]:
    """(fold, value, temperature, n, hits, loss): nested cross-validation.

    For each outer fold: every grid value is scored on each other fold by a fit that has seen neither of the two; the value with
    the least pooled loss wins, ties to the first. The temperature is the one with the least loss of the winner's
    held-out scores. Then the winner is fitted to all other folds and scores the outer fold, whose labels nothing before has seen.
    """
    folds = moments(rows, classes)
    if len(folds) < 3:
        return []
    fit = FITTERS[fitter]
    # A fit without two folds serves both of them.
    pairs = {(f, g, i): fit(without(folds, f, g), v) for f in folds for g in folds if f < g for i, v in enumerate(grid)}
    inner = {f"{f}|{g}|{i}": (g, pairs[min(f, g), max(f, g), i]) for f in folds for g in folds if f != g for i in range(len(grid))}
    got = score(rows, inner)
    best = {f: min(range(len(grid)), key=lambda i: (round(sum(got[f"{f}|{g}|{i}", 1.0][2] for g in folds if g != f), 9), i)) for f in folds}
    chosen = {n: m for n, m in inner.items() if int(n.split("|")[2]) == best[int(n.split("|")[0])]}
    held = score(rows, chosen, dict.fromkeys(chosen, TEMPERATURES))
    warm = {f: min(TEMPERATURES, key=lambda t: (round(sum(held[f"{f}|{g}|{best[f]}", t][2] for g in folds if g != f), 9), t)) for f in folds}
    outer = {str(f): (f, fit(without(folds, f), grid[best[f]])) for f in folds}
    last = score(rows, outer, {str(f): [warm[f]] for f in folds})
    return [(f, grid[best[f]], warm[f], *last[str(f), warm[f]]) for f in sorted(folds)]
