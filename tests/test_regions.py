"""Components, holes and foreground against a plain flood fill."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regions as R


def flood(mask, touching):
    """Components by walking from cell to cell, in row-major order of their first cells."""
    seen, out = set(), []
    steps = [tuple(s - 1 for s in x) for x in np.ndindex(3, 3, 3)]
    steps = [s for s in steps if 0 < sum(map(abs, s)) <= touching]
    for start in np.ndindex(*mask.shape):
        if not mask[start] or start in seen:
            continue
        seen.add(start)
        own, todo = [], [start]
        while todo:
            at = todo.pop()
            own.append(at)
            for s in steps:
                to = tuple(a + b for a, b in zip(at, s, strict=True))
                if all(0 <= x < n for x, n in zip(to, mask.shape, strict=True)) and mask[to] and to not in seen:
                    seen.add(to)
                    todo.append(to)
        out.append(own)
    return out


def plain_filled(mask):
    out = mask.copy()
    for own in flood(~mask, 1):
        if all(all(0 < x < n - 1 for x, n in zip(at, mask.shape, strict=True)) for at in own):
            for at in own:
                out[at] = True
    return out


def plain_foreground(v, how):
    a, b = np.percentile(v, [how.low, how.high])
    x = np.clip((v - a) / (b - a), 0, 1)
    if how.sigma:
        reach = int(4 * how.sigma + 0.5)
        w = [math.exp(-0.5 * (k / how.sigma) ** 2) for k in range(-reach, reach + 1)]
        for axis in range(3):
            y = np.zeros(x.shape)
            n = x.shape[axis]
            for at in np.ndindex(*x.shape):
                for k, g in zip(range(-reach, reach + 1), w, strict=True):
                    i = (at[axis] + k) % (2 * n)  # mirrored, the border twice
                    i = 2 * n - 1 - i if i >= n else i
                    y[at] += g / sum(w) * x[tuple(i if a == axis else c for a, c in enumerate(at))]
            x = y
    lo, hi = x.min(), x.max()
    edges = [lo + (hi - lo) * k / 256 for k in range(257)]
    best, cut = -1, None
    for k in range(255):
        low, high = x[x < edges[k + 1]], x[x >= edges[k + 1]]
        centre = lambda s: (np.minimum(np.floor((s - lo) / (hi - lo) * 256), 255) + 0.5).mean()
        if len(low) and len(high):
            between = len(low) * len(high) * (centre(low) - centre(high)) ** 2
            if between > best * (1 + 1e-12):
                best, cut = between, (edges[k] + edges[k + 1]) / 2
    parts = sorted(flood(x > cut, how.touching), key=lambda c: -len(c))
    kept = [parts[0]]
    if len(parts[0]) >= how.least:
        kept += [c for c in parts[1: how.keep] if len(c) >= how.least * how.relaxed]
    mask = np.zeros(v.shape, bool)
    for c in kept:
        for at in c:
            mask[at] = True
    return plain_filled(mask), len(parts)


def test_components_against_flood_fill():
    rng = np.random.default_rng(1)
    for shape, share in (((5, 6, 7), 0.3), ((5, 6, 7), 0.5), ((1, 9, 4), 0.5), ((4, 4, 4), 0.0), ((3, 3, 3), 1.0), ((9, 8, 7), 0.15)):
        mask = rng.random(shape) < share
        for touching in (R.FACES, R.EDGES, R.CORNERS):
            want = flood(mask, touching)
            first = [int(np.ravel_multi_index(min(c), shape)) for c in want]
            of = R.components(mask, touching)
            assert all({int(of[at]) for at in c} == {f} for c, f in zip(want, first, strict=True)) and (of[~mask] == -1).all()
            got = [(int(f), int(n)) for f, n in zip(*R.ranked(of), strict=True)]
            assert got == sorted(((f, len(c)) for f, c in zip(first, want, strict=True)), key=lambda x: (-x[1], x[0]))
        assert (R.filled(mask) == plain_filled(mask)).all()
    snake = np.zeros((1, 61, 60), bool)  # one long winding component
    snake[0, ::2] = True
    snake[0, 1::4, -1] = snake[0, 3::4, 0] = True
    assert len(R.ranked(R.components(snake))[0]) == 1
    v = rng.random((5, 5, 5)) < 0.4
    for times in (1, 2):
        near = np.array([[[any(v[q] for q in np.ndindex(5, 5, 5) if abs(q[0] - i) + abs(q[1] - j) + abs(q[2] - k) <= times) for k in range(5)] for j in range(5)] for i in range(5)])
        assert (R.grown(v, times) == near).all()
    assert R.shrunk(np.ones((3, 3, 3), bool), 1).sum() == 1 and R.shrunk(v, 0) is v


def test_foreground_against_a_plain_one():
    rng = np.random.default_rng(2)
    grid = np.stack(np.meshgrid(*(np.arange(n) for n in (12, 11, 13)), indexing="ij"))
    for seed, how in enumerate((R.Foreground(least=30), R.Foreground(sigma=0.0, least=30, keep=3), R.Foreground(sigma=0.6, least=10_000, keep=2, touching=R.FACES))):
        v = rng.random((12, 11, 13)) * 20
        v[((grid - np.array([5, 5, 5])[:, None, None, None]) ** 2).sum(0) < 14] += 100
        v[5, 5, 5] = 0  # a hole
        v[9:11, 8:10, 9:12] += 90  # a second, smaller one
        mask, cut, n, holes = R.foreground(v, how)
        want, parts = plain_foreground(v, how)
        assert (mask == want).all() and n == parts, seed
    flat = R.foreground(np.full((3, 3, 3), 7.0))
    assert flat[0].all() and flat[1] is None
    assert R.n_kept(np.array([900, 500]), R.Foreground(keep=2)) == 1 and R.n_kept(np.array([1000, 100, 99]), R.Foreground(keep=3)) == 2 and R.n_kept(np.array([]), R.Foreground()) == 0


def test_volumes_in_rows(spark):
    rng = random.Random(3)
    cells = [rng.random() < 0.4 for _ in range(60)]
    rows = [(1, [3, 4, 5], cells, "x"), (2, [3, 4, 5], cells[:59], "x"), (3, None, cells, "x"), (4, [3, 4, 5], None, "x"), (5, [2, 2, 2], [False] * 8, "x"), (6, [1, 1, 2], [True, None], "x"), (None, [2, 2, 2], [True] * 8, "x"), (7, [0, 2, 2], [], "x")]
    df = spark.createDataFrame(rows, "k int, shape array<int>, m array<boolean>, mask string")
    got = sorted((tuple(r) for r in R.ranked_components(df, ["k"], F.col("shape"), F.col("m")).collect()), key=str)
    want = sorted(((len(c), int(np.ravel_multi_index(min(c), (3, 4, 5)))) for c in flood(np.array(cells).reshape(3, 4, 5), 1)), key=lambda x: (-x[0], x[1]))
    assert got == sorted([*((1, i, f, n) for i, (n, f) in enumerate(want, 1)), (None, 1, 0, 8)], key=str)
    assert R.ranked_components(df.limit(0), ["k"], F.col("shape"), F.col("m")).count() == 0
    v = spark.createDataFrame([(1, [2, 2, 3], [float(x) for x in range(12)]), (2, [2, 2, 3], [1.0] * 12)], "k int, shape array<int>, v array<double>")
    found = R.foregrounds(v, ["k"], F.col("shape"), F.col("v"), R.Foreground(sigma=0.0, least=1))
    got = {r.k: r for r in found.collect()}
    assert got[1].mask == [x > 5 for x in range(12)] and got[1].foreground_cells == 6 and got[1].foreground_fraction == pytest.approx(0.5)
    assert all(got[2].mask) and got[2].threshold is None
    assert R.zeroed(v.join(found, "k"), "v", "mask", -1.0).where("k = 1").first().v == [float(x) if x > 5 else -1.0 for x in range(12)]


def test_equal_variances_that_rounding_sets_apart():
    cut = R.otsu_cut(np.array([0, 6, 5, 11]) / 11, 12)  # one cell below or one above: the variances are the same
    assert cut == 0.5 / 12
