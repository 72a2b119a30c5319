"""Probes from sums, nested cross-validation, logistic fits and calibrators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import fits, probe


def data(seed=3, n=400, d=5, k=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, k, n)
    x = r.normal(size=(n, d)) + np.eye(k, d)[y] * 1.5
    return x, y, np.arange(n) % 4


def frame(spark, x, y, fold):
    return spark.createDataFrame([(int(f), [float(v) for v in row], int(c)) for f, row, c in zip(fold, x, y)], "fold int, x array<double>, y int")


@pytest.mark.parametrize(("fitter", "value"), [("ridge", 0.1), ("ridge", 10.0), ("discriminant", 0.1), ("discriminant", 0.9)])
def test_fits_from_moments_equal_fits_of_rows(spark, fitter, value):
    x, y, fold = data()
    got = probe.moments(frame(spark, x, y, fold), 3)
    keep = fold != 2
    want = getattr(fits, fitter)(x[keep], y[keep], np.ones(keep.sum()), 3, value)
    assert np.allclose(probe.FITTERS[fitter](probe.without(got, 2), value), want, atol=1e-8)


def test_held_out_scores(spark):
    x, y, fold = data()
    for f, _, v, n, hits, loss in probe.cross_validate(frame(spark, x, y, fold), 3, "discriminant", [0.1, 0.5]):
        w = fits.discriminant(x[fold != f], y[fold != f], np.ones((fold != f).sum()), 3, v)
        z = np.column_stack([x, np.ones(len(x))])[fold == f] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        own = y[fold == f]
        assert (n, hits) == (len(own), (z.argmax(axis=1) == own).sum()) and loss == pytest.approx(-np.log(p[np.arange(len(own)), own]).sum())


def test_an_outer_fold_never_chooses_for_itself(spark):
    # Other labels in an outer fold change its score only, neither its grid value nor its temperature.
    x, y, fold = data()
    grid = [0.01, 0.3, 0.9]
    before = {r[0]: r for r in probe.nested(frame(spark, x, y, fold), 3, "discriminant", grid)}
    other = y.copy()
    other[fold == 1] = np.random.default_rng(9).integers(0, 3, (fold == 1).sum())
    after = {r[0]: r for r in probe.nested(frame(spark, x, other, fold), 3, "discriminant", grid)}
    assert before[1][:4] == after[1][:4] and before[1][4] > after[1][4]
    assert set(before) == {0, 1, 2, 3} and all(r[1] in grid for r in before.values())


def test_nested_choice_equals_brute_force(spark):
    x, y, fold = data(5, 200)
    grid = [0.01, 0.3, 0.9]
    one = np.column_stack([x, np.ones(len(x))])
    for f, value, *_ in probe.nested(frame(spark, x, y, fold), 3, "discriminant", grid):
        losses = []
        for v in grid:
            total = 0.0
            for g in set(fold) - {f}:
                keep = (fold != f) & (fold != g)
                z = one[fold == g] @ fits.discriminant(x[keep], y[keep], np.ones(keep.sum()), 3, v)
                total -= (z[np.arange(len(z)), y[fold == g]] - np.log(np.exp(z).sum(axis=1))).sum()
            losses.append(round(total, 9))
        assert value == grid[losses.index(min(losses))]


def test_too_few_folds(spark):
    x, y, fold = data(n=40)
    rows = frame(spark, x, y, fold * 0)
    assert probe.cross_validate(rows, 3, "ridge", [1.0]) == [] and probe.nested(rows.limit(0), 3, "ridge", [1.0]) == []


@pytest.mark.parametrize("k", [2, 3])
def test_logistic_is_at_its_optimum(k):
    x, y, _ = data(1, 120, 6, k)
    x = np.column_stack([x, x[:, 0] + x[:, 1]])  # a feature too many: rows span less than the features
    w = np.random.default_rng(2).random(len(y)) + 0.1
    coef, done = fits.logistic(x, y, w, k, 0.05)
    assert done
    z, basis, mean, scale = fits.thin_svd(x, w)
    assert z.shape[1] == 6 and np.allclose((x - mean) / scale @ basis, z)
    p = np.exp(np.column_stack([x, np.ones(len(x))]) @ coef)
    p /= p.sum(axis=1, keepdims=True)
    beta = ((coef[:-1] * scale[:, None]).T @ basis).T
    slope = z.T @ ((w / w.sum())[:, None] * (p - np.eye(k)[y])) + 0.05 * beta
    assert np.abs(slope).max() < 1e-7 and abs(((w / w.sum())[:, None] * (p - np.eye(k)[y])).sum(axis=0)).max() < 1e-7


def test_calibrators(spark):
    r = np.random.default_rng(4)
    s = r.normal(size=500)
    label = (r.random(500) > 1 / (1 + np.exp(-2 * s))).astype(int)
    model = fits.calibrator("fit", s, label, np.ones(500))
    rows = spark.createDataFrame([(1.0, [0.0, 1.0]), (-800.0, [5.0, 5.0])], "s double, a array<double>")
    got = [x[0] for x in rows.select(fits.calibrate(model, F.col("s"))).collect()]
    assert got[0] == pytest.approx(1 / (1 + np.exp(-model["slope"] - model["offset"]))) and got[1] == pytest.approx(0.0)
    choice = fits.calibrator("choice", r.normal(size=(50, 2)), r.integers(0, 2, 50), np.ones(50))
    assert all(sum(x[0]) == pytest.approx(1.0) for x in rows.select(fits.calibrate(choice, F.col("a"))).collect())
    with pytest.raises(ValueError, match="shape"):
        fits.calibrator("other", s, label, np.ones(500))
