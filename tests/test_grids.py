"""Coarser grids, shapes and back, all orientations, NIfTI files."""

import gzip
import struct
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grids as G
from tidemark.sources import nifti


def test_coarse_grid_keeps_its_budget():
    rng = np.random.default_rng(1)
    for _ in range(300):
        shape, spacing = rng.integers(1, 400, 3).tolist(), rng.uniform(0.2, 9, 3).tolist()
        most = int(rng.choice([1, 7, 1000, 250_000]))
        cells, apart = G.coarse_grid(shape, spacing, 2.0, most)
        assert np.prod(cells) <= most and min(cells) >= 1
        free = [int(s / 2.0 * n) for s, n in zip(spacing, shape, strict=True)]
        if min(free) >= 1 and np.prod(free) <= most:
            assert cells == free and apart == [2.0] * 3
    assert G.coarse_grid((240, 240, 155), (1, 1, 1))[0] == [62, 62, 39] or np.prod(G.coarse_grid((240, 240, 155), (1, 1, 1))[0]) <= 250_000


def plain_sample(v, cells, step, nearest):
    out = np.zeros(cells)
    for at in np.ndindex(*cells):
        p = [i * s for i, s in zip(at, step, strict=True)]
        if any(x >= n - 0.5 for x, n in zip(p, v.shape, strict=True)):
            continue
        if nearest:
            out[at] = v[tuple(int(x + 0.5) for x in p)]
            continue
        for corner in product((0, 1), repeat=3):
            w, q = 1.0, []
            for x, c, n in zip(p, corner, v.shape, strict=True):
                x = min(x, n - 1)
                w *= (x - int(x)) if c else 1 - (x - int(x))
                q.append(min(int(x) + c, n - 1))
            out[at] += w * v[tuple(q)]
    return out


def test_sampled_and_downsampled(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(5, 4, 6))
    for cells, step in (([3, 2, 4], [1.7, 2.0, 1.4]), ([5, 4, 6], [1.0] * 3), ([12, 4, 6], [0.4, 1.0, 1.0])):
        assert np.allclose(G.sampled(v, cells, step), plain_sample(v, cells, step, False))
        assert (G.sampled(v > 0, cells, step, True) == plain_sample(v > 0, cells, step, True).astype(bool)).all()
    row = lambda k, s, m: (k, [5, 4, 6], [float(x) for x in v.ravel()], s, m)
    df = spark.createDataFrame([row(1, [1.0, 1.0, 2.0], [bool(x) for x in (v > 0).ravel()]), row(2, [1.0, 1.0, 2.0], None), row(3, None, None), row(4, [1.0, 0.0, 2.0], None), (5, [0, 4, 6], [], [1.0] * 3, None)], "k int, shape array<int>, v array<double>, apart array<double>, m array<boolean>")
    got = {r.k: r for r in G.downsampled(df, ["k"], F.col("shape"), F.col("v"), F.col("apart"), F.col("m"), 1.5, 40).collect()}
    cells, apart = G.coarse_grid((5, 4, 6), (1, 1, 2), 1.5, 40)
    assert got.keys() == {1, 2} and got[1].shape == cells and got[1].factor == pytest.approx(apart[0]) and len(got[1].data) <= 40
    step = [apart[0], apart[1], apart[2] / 2]
    assert got[1].data == pytest.approx(plain_sample(v, cells, step, False).ravel()) and got[2].mask is None and got[1].mask == [bool(x) for x in plain_sample(v > 0, cells, step, True).ravel()]


def test_shapes_and_back(spark):
    rng = np.random.default_rng(3)
    for old in ((3, 4, 5), (7, 4, 2), (6, 5, 9), (1, 1, 1)):
        v = rng.normal(size=old)
        df = spark.createDataFrame([(1, list(old), [float(x) for x in v.ravel()])], "k int, shape array<int>, v array<double>")
        target = (6, 5, 4)
        out = G.fitted(df, ["k"], F.col("shape"), F.col("v"), target)
        row = out.first()
        want = np.zeros(target)
        kept = np.zeros(old, bool)
        for at in np.ndindex(*old):
            to = tuple(a - m for a, m in zip(at, row.moved, strict=True))
            if all(0 <= x < n for x, n in zip(to, target, strict=True)):
                want[to] = v[at]
                kept[at] = True
        assert np.array_equal(np.reshape(row.data, target), want) and tuple(row.fitted_from) == old
        back = G.restored(out, ["k"], target).first()
        assert np.array_equal(np.reshape(back.data, old), np.where(kept, v, 0))
    affine = [1.5, 0.1, 0.0, -90.0, 0.0, -2.0, 0.3, 17.0, 0.25, 0.0, 3.0, 8.0, 0.0, 0.0, 0.0, 1.0]
    got = spark.range(1).select(G.moved_affine(F.array(*map(F.lit, affine)), F.array(F.lit(2), F.lit(-1), F.lit(3))).alias("a")).select("a", G.moved_affine(F.col("a"), F.array(F.lit(2), F.lit(-1), F.lit(3)), True).alias("b")).first()
    m = np.reshape(affine, (4, 4))
    assert np.allclose(np.reshape(got.a, (4, 4))[:3, 3], m[:3, 3] + m[:3, :3] @ [2, -1, 3]) and got.b == pytest.approx(affine)


def all_orientations():
    for order in permutations(range(3)):
        for signs in product((1, -1), repeat=3):
            m = np.eye(4)
            m[:3, :3] = 0
            for axis, world in enumerate(order):
                m[world, axis] = signs[axis] * (1.0, 2.0, 0.5)[world]
            yield m


def test_all_orientations_return_to_the_first():
    rng = np.random.default_rng(4)
    v, base = rng.normal(size=(3, 4, 5)), np.diag([1.0, 2.0, 0.5, 1.0])
    base[:3, 3] = (-7, 3, 11)
    seen = set()
    for m in all_orientations():
        name = G.orientation(m)
        seen.add(name)
        there, affine = G.oriented(v, base, name)
        assert G.orientation(affine) == name
        at = tuple(n - 1 for n in there.shape)  # a cell's value and place in the world stay
        place = affine @ [*at, 1]
        first = np.rint(np.linalg.inv(base) @ place)[:3].astype(int)
        assert there[at] == v[tuple(first)]
        back, again = G.oriented(there, affine)
        assert np.array_equal(back, v) and np.allclose(again, base)
    assert len(seen) == 48
    tilted = np.eye(4)
    tilted[:3, :3] = [[0.2, -0.9, 0.1], [0.95, 0.2, 0.0], [0.1, 0.1, -1.1]]
    assert G.orientation(tilted) == "ALI"


def test_nifti_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(3, 4, 5)) * 50)
    base = np.diag([1.0, 2.0, 0.5, 1.0])
    base[:3, 3] = (-7, 3, 11)
    for i, (name, kind, order) in enumerate((("RAS", "f8", "<"), ("LPS", "i2", ">"), ("SAR", "f4", "<"), ("PIL", "i1", ">"), ("IRA", "i4", "<"))):
        there, affine = G.oriented(v, base, name)
        (tmp_path / f"{i}.nii{'.gz' if i % 2 else ''}").write_bytes(nifti.write(there, affine, kind, order, bool(i % 2)))
    (tmp_path / "scaled.nii").write_bytes(nifti.write(v, base, "i2", "<", False, 0.5, 3.0))
    (tmp_path / "bad.nii").write_bytes(b"nothing")
    (tmp_path / "empty.nii.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "notes.txt").write_bytes(b"no volume")
    got = {r.path.rsplit("/", 1)[1]: r for r in nifti.read_nifti(spark, str(tmp_path)).collect()}
    assert got.keys() == {"0.nii", "1.nii.gz", "2.nii", "3.nii.gz", "4.nii", "scaled.nii", "bad.nii", "empty.nii.gz"} and got["bad.nii"].error and got["empty.nii.gz"].error
    for i, name in enumerate(("RAS", "LPS", "SAR", "PIL", "IRA")):
        r = got[f"{i}.nii{'.gz' if i % 2 else ''}"]
        assert r.error is None and r.stored == name and r.shape == [3, 4, 5] and r.data == v.ravel().tolist() and np.allclose(np.reshape(r.affine, (4, 4)), base) and r.spacing == pytest.approx([1, 2, 0.5])
    assert got["scaled.nii"].data == (v * 0.5 + 3).ravel().tolist()
    head = bytearray(nifti.write(v, base))  # rotation and offset in place of rows: half a turn about the third axis
    struct.pack_into("<hh", head, nifti.QFORM, 1, 0)
    struct.pack_into("<6f", head, nifti.QUATERNION, 0, 0, 1, 5, 6, 7)
    affine = nifti.parse(bytes(head))[1]
    assert np.allclose(affine, [[-1, 0, 0, 5], [0, -2, 0, 6], [0, 0, 0.5, 7], [0, 0, 0, 1]])
    struct.pack_into("<hh", head, nifti.QFORM, 0, 0)
    assert np.allclose(nifti.parse(bytes(head))[1], [[1, 0, 0, -1], [0, 2, 0, -3], [0, 0, 0.5, -1], [0, 0, 0, 1]])
