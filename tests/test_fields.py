"""Jacobian statistics against determinants by differences written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fields


def plain_det(u, spacing):
    shape = u.shape[1:]
    out = np.zeros(shape)
    for at in np.ndindex(*shape):
        m = np.eye(3)
        for j in range(3):
            lo, hi = max(at[j] - 1, 0), min(at[j] + 1, shape[j] - 1)
            if hi > lo:
                a, b = (tuple(x if k == j else at[k] for k in range(3)) for x in (lo, hi))
                for i in range(3):
                    m[i, j] += (u[(i, *b)] - u[(i, *a)]) / ((hi - lo) * spacing[j])
        out[at] = m[0, 0] * (m[1, 1] * m[2, 2] - m[1, 2] * m[2, 1]) - m[0, 1] * (m[1, 0] * m[2, 2] - m[1, 2] * m[2, 0]) + m[0, 2] * (m[1, 0] * m[2, 1] - m[1, 1] * m[2, 0])
    return out


def test_determinants():
    rng = np.random.default_rng(1)
    for shape, spacing in (((4, 5, 3), (1.0, 2.0, 0.5)), ((1, 4, 2), (1.0, 1.0, 3.0))):
        u = rng.normal(0, 0.6, (3, *shape))
        assert np.allclose(fields.determinants(u, spacing), plain_det(u, spacing))
    grid = np.stack(np.meshgrid(*(np.arange(n, dtype=float) for n in (5, 4, 6)), indexing="ij"))
    a = np.array([[1.1, 0.2, 0], [0, 0.9, 0.1], [0.3, 0, 1.2]])
    affine = np.tensordot(a - np.eye(3), grid, 1)  # a constant affine field has its determinant everywhere
    assert np.allclose(fields.determinants(affine, (1, 1, 1)), np.linalg.det(a))


def test_statistics_and_verdict(spark):
    grid = np.stack(np.meshgrid(*(np.arange(4.0),) * 3, indexing="ij"))
    flip = grid * np.array([-2.0, 0, 0])[:, None, None, None]
    some = np.random.default_rng(2).normal(0, 0.1, (3, 4, 4, 4))
    cases = {"still": grid * 0, "flip": flip, "some": some, "grown": grid * 2.0, "flat": grid * -0.6, "grown little": grid * 0.1}
    rows = [(n, [4, 4, 4], [float(x) for x in u.ravel()], 1) for n, u in cases.items()] + [("short", [4, 4, 4], [0.0] * 64, 1), ("none", [4, 4, 4], None, 1)]
    df = spark.createDataFrame(rows, "name string, shape array<int>, u array<double>, det_mean int")
    got = {r.name: r for r in fields.field_statistics(df, ["name"], F.col("shape"), F.col("u")).withColumn("reason", fields.implausible()).collect()}
    assert got.keys() == cases.keys()
    det = plain_det(some, (1, 1, 1)).ravel()
    want = [det.mean(), det.std(), np.log(det).mean(), np.log(det).std(), 0.0, det.min(), det.max()]
    assert [got["some"][s] for s in fields.STATISTICS] == pytest.approx(want)
    assert got["still"].det_mean == 1 and got["still"].reason is None and got["grown little"].reason is None and got["some"].reason is None
    assert got["flip"].negative_fraction == 1 and got["flip"].log_det_mean is None and got["flip"].reason == "Folding"
    assert got["grown"].reason == "Large mean deformation" and got["flat"].reason == "Large mean deformation"
    stats = spark.createDataFrame([(0.0, 0.05, 5.0, 0.0), (0.0, 0.5, 11.0, 0.0), (0.02, -1.0, 2.0, 0.0), (0.01, 0.1, 10.0, 0.5)], "negative_fraction double, det_min double, det_max double, log_det_mean double").withColumn("det_mean", F.lit(1.0))
    assert [r.reason for r in stats.withColumn("reason", fields.implausible()).collect()] == ["Extreme local contraction", "Extreme local expansion", "Folding", None]
    assert fields.field_statistics(df.limit(0), ["name"], F.col("shape"), F.col("u")).count() == 0


def test_affine(spark):
    m = [1.1, 0.2, 0.0, 0.0, 0.9, 0.1, 0.3, 0.0, 1.2]
    df = spark.createDataFrame([(1, [*m, 5.0, 6.0, 7.0]), (2, [-1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (3, [1.0] * 6), (4, None)], "k int, m array<double>")
    got = {r.k: r for r in fields.affine_statistics(df, "m").withColumn("reason", fields.implausible()).collect()}
    det = np.linalg.det(np.reshape(m, (3, 3)))
    assert got[1].det_mean == pytest.approx(det) and got[1].log_det_mean == pytest.approx(np.log(det)) and got[1].det_std == 0 and got[1].reason is None
    assert got[2].negative_fraction == 1 and got[2].log_det_mean == 0 and got[2].reason == "Folding"
    assert got[3].reason == got[4].reason == "No determinant"
