"""Labels, propagated masks and results under their names against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import masks as M


def test_label_dice(spark):
    rng = random.Random(10)
    rows = [(i, [rng.choice([0, 0, 1, 2]) for _ in range(30)], [rng.choice([0, 1, 1, 3]) for _ in range(30)]) for i in range(8)]
    rows += [(20, [0, 0], [0, 0]), (21, [0, 0], [1, 0]), (22, [1, 0], [1]), (23, None, [1]), (24, [], [])]
    got = {r.k: r for r in M.label_dice(spark.createDataFrame(rows, "k int, a array<int>, b array<int>"), ["k"], "a", "b", (1, 2, 3)).collect()}
    for k, a, b in rows[:8]:
        assert got[k].dice_total == pytest.approx(2 * sum(x > 0 and y > 0 for x, y in zip(a, b, strict=True)) / (sum(x > 0 for x in a) + sum(y > 0 for y in b)))
        for n in (1, 2, 3):
            assert got[k][f"dice_{n}"] == pytest.approx(2 * sum(x == y == n for x, y in zip(a, b, strict=True)) / (a.count(n) + b.count(n)))
    assert [got[k][1:] for k in (20, 21, 22, 23, 24)] == [(None,) * 4, (0.0,) * 4, (None,) * 4, (None,) * 4, (None,) * 4]


def test_propagated_masks(spark):
    on, off = [True, True, False, False], [False, True, False, True]
    independent = spark.createDataFrame([("S-7-01", "t1", on), ("S-2-7-01", "t1", off), ("S-02", "t1", None), ("01", "t1", off), ("S-03", "t2", [False] * 4)], "study string, modality string, mask array<boolean>")
    rows = [("7-01_t1", on, off), ("01_t1", on, on), ("02_t1", on, on), ("no key", on, on), ("01_t2", on, on), ("03_t2", None, on), ("03_t2", on, [False] * 4), ("a_b_t1", on, on), ("01_t1", on, None), (None, on, on)]
    got = M.compare_propagated(spark.createDataFrame(rows, "key string, reference array<boolean>, mask array<boolean>"), independent, 0.5).collect()
    seen = sorted(((r.key, r.timestamp, r.modality, r.status, r.study, r.dice, r.reference_dice, r.volume_propagated) for r in got), key=str)
    assert seen == sorted([
        ("7-01_t1", "7-01", "t1", M.COMPARED, "S-2-7-01", 1.0, 0.5, 1.0), ("01_t1", "01", "t1", M.COMPARED, "S-2-7-01", 0.5, 1.0, 1.0), ("02_t1", "02", "t1", M.NOT_FOUND, None, None, None, None),
        ("no key", None, None, M.BAD_KEY, None, None, None, None), ("01_t2", "01", "t2", M.NOT_FOUND, None, None, None, None), ("03_t2", "03", "t2", M.NO_MASK, None, None, None, None),
        ("03_t2", "03", "t2", M.COMPARED, "S-03", 0.0, 0.0, 0.0), ("a_b_t1", "a_b", "t1", M.NOT_FOUND, None, None, None, None), ("01_t1", "01", "t1", M.NO_MASK, None, None, None, None), (None, None, None, M.BAD_KEY, None, None, None, None)], key=str)


def test_sizes_and_names(spark):
    items = spark.createDataFrame([("a", [3, 9, 2]), ("a", [4, 4, 4]), ("a", None), ("b", []), ("c", [1, 1, 1])], "s string, shape array<int>")
    assert sorted(map(tuple, M.largest_extent(items, ["s"], "shape").collect())) == [("a", 2, 9), ("c", 1, 1)]
    row = M.volume_summary(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (9.0,)], "v double"), "v").first()
    assert tuple(row) == (4, 4.0, pytest.approx(3.0822070014844885), 1.0, 9.0, 1.75, 3.0, 5.25)
    assert M.volume_summary(spark.createDataFrame([(None,)], "v double"), "v").count() == 0
    names = spark.createDataFrame([("B-1", "p1", "s/1", [2, 2, 2]), ("B-2", "p2", "s/2", None), ("B-3", "p3", "s/3", [4, 4, 4]), ("B-4", "p4", "s/4", None), (None, "p5", "s/5", None)], "name string, patient string, study_path string, original_shape array<int>")
    outputs = spark.createDataFrame([("B-1", "z"), ("B-1", "y"), ("B-2", "x"), ("B-3", "w"), ("B-9", "v"), ("B-4", None)], "name string, file string")
    got = {r.patient: r for r in M.remapped(names, outputs, "name", "file", (4, 4, 4), F.concat("study_path", F.lit("/seg"))).collect()}
    assert [(got[p].output, got[p].destination, got[p].shape_corrected, got[p].success, got[p].error) for p in ("p1", "p2", "p3", "p4", "p5")] == [
        ("y", "s/1/seg", True, True, None), ("x", "s/2/seg", False, True, None), ("w", "s/3/seg", False, True, None), (None, None, False, False, "No output found for B-4"), (None, None, False, False, "No output found for none")]
