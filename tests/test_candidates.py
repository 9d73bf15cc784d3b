"""Candidate metrics against loops over cells, and the choice between rows by aggregates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import longitudinal as L


def plain_shrunk(mask, times):
    for _ in range(times):
        out = np.zeros(mask.shape, bool)
        for at in np.ndindex(*mask.shape):
            near = [tuple(a + s * (k == j) for k, a in enumerate(at)) for j in range(3) for s in (-1, 1)]
            out[at] = mask[at] and all(all(0 <= x < n for x, n in zip(q, mask.shape, strict=True)) and mask[q] for q in near)
        mask = out
    return mask


def test_metrics_by_definition():
    rng = np.random.default_rng(5)
    v = np.zeros((16, 15, 17))
    v[1:15, 1:14, 1:16] = rng.normal(100, 20, (14, 13, 15))
    v[7, 7, 7] = -5
    depths = C.Depths()
    lap = np.zeros(v.shape)
    for at in np.ndindex(*v.shape):
        for j in range(3):
            for s in (-1, 1):
                q = tuple(min(max(a + s * (k == j), 0), n - 1) for k, (a, n) in enumerate(zip(at, v.shape, strict=True)))
                lap[at] += v[q] - v[at]
    assert np.allclose(C.laplacian(v), lap)
    mask = np.zeros(v.shape, bool)
    mask[2:14, 2:13, 2:15] = True
    own = v[v > 0]
    a, mid, b = np.percentile(own, [25, 50, 75])
    middle, low, high = own[(own >= a) & (own <= b)], own[own < mid], own[own >= mid]
    for given in (None, mask):
        region = v > 0 if given is None else given
        core = plain_shrunk(region, 5)
        cv = lambda x: x.std() / (x.mean() + 1e-8)
        want = dict(zip(C.METRICS, C.metrics_of(v, given, depths), strict=True))
        assert want["snr_foreground"] == pytest.approx(middle.mean() / (middle.std() + 1e-8) * math.sqrt(2 / (4 - math.pi)))
        assert want["cnr_high_low"] == pytest.approx((high.mean() - low.mean()) / math.sqrt(low.var() + high.var()))
        assert want["laplacian_sharpness"] == pytest.approx(lap[region].var())
        assert want["brain_coverage_fraction"] == (None if given is None else pytest.approx(mask.mean()))
        assert (want["ghosting_score"] is None) == (not core.any())
        if core.any():
            assert want["ghosting_score"] == pytest.approx(1 - cv(v[region & ~core]) / (cv(v[core]) + 1e-8))
    assert C.metrics_of(np.zeros((3, 3, 3)), None, depths) == (None,) * 6
    assert C.metrics_of(np.ones((4, 4, 4)), None, depths)[0] is None  # too few cells


def test_volumes_with_and_without_masks(spark):
    rows = [(1, [2, 2, 2], [1.0, 2, 3, 4, 5, 6, 7, 8], [True] * 4 + [False] * 4), (2, [2, 2, 2], [1.0] * 8, None), (3, [2, 2, 2], [1.0] * 8, [True]), (4, [2, 2, 2], None, [True] * 8), (5, None, [1.0], None)]
    df = spark.createDataFrame([(k, s, v and [float(x) for x in v], m) for k, s, v, m in rows], "k int, s array<int>, v array<double>, m array<boolean>")
    got = {r.k: r.brain_coverage_fraction for r in C.candidate_metrics(df, ["k"], F.col("s"), F.col("v"), F.col("m")).collect()}
    assert got == {1: 0.5, 2: None, 3: None}


def test_choice_by_aggregates(spark):
    rng = random.Random(7)
    nan = float("nan")
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0.1, 0.5, 0.5, 0.9, None, nan]) if i % 3 else rng.choice([0.1, 0.2, None])) for i in range(60)] + [("c", 100, None), ("c", 99, None), ("d", 101, 0.3), ("d", 102, 0.4)]
    df = spark.createDataFrame(rows, "g string, i int, s double").repartition(4)
    size = lambda r: (r[2] is None, r[2] is None or not math.isnan(r[2]), -(r[2] or 0))  # noqa: E731  largest first, NaN before, null last
    for least in (None, 0.45):
        want = {}
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            top = min(own, key=lambda r: (*size(r), r[1]))
            fine = least is None or (top[2] is not None and (math.isnan(top[2]) or top[2] >= least))
            want[g] = top[1] if fine else min(r[1] for r in own)
        assert {r.g: r.i for r in L.best_of(df, ["g"], "s", "i", least).collect()} == want
    worst = {g: min((r for r in rows if r[0] == g), key=lambda r: (*size(r), r[1]))[1] for g in {r[0] for r in rows}}
    got = L.worst_of(df, ["g"], F.col("s"), ["i"])
    assert {r.g: r.i for r in got.collect()} == worst and got.columns == df.columns
    some = {r.g: (r.s, r.i) for r in L.first_supplied(df, ["g"], "i", ["s", "i"]).collect()}
    assert some["c"] == (None, 99) and some["d"] == (0.3, 101)
