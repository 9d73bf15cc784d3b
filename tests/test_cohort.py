"""Cohort tables on rows written by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort as C


def test_clinical_getters(spark):
    df = spark.createDataFrame([(" 12.5", "1", {"a": 1, "b": 2}), ("x", "0", {}), (None, "2.5", None), ("3", None, {"c": 1})], "v string, g string, c map<string,int>")
    got = df.select(C.first_volume(F.col("v")).alias("v"), C.growth_status(F.col("g")).alias("g"), C.n_controls(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(12.5, True, 2), (None, False, 0), (None, None, 0), (3.0, None, 1)]
    names = spark.createDataFrame([("a_T1CE.nrrd",), ("T1.nii",), ("t2_flair",), ("FLAIR",), ("dwi",), (None,)], "n string")
    assert [r.m for r in names.select(C.inferred_modality(F.col("n")).alias("m")).collect()] == ["t1c", "t1n", "t2", "flair", None, None]


def test_required_sequences(spark):
    held = {"s1": ["t1c", "t1c-axial", "t2-coronal", "t2-axial", "other"], "s2": ["t1c-sagital", "t2"], "s3": ["t1c-unknown", None], "s4": ["t2-axial"] * 2}
    df = spark.createDataFrame([(s, n) for s, ns in held.items() for n in ns], "s string, n string")
    got = sorted(map(tuple, C.required_sequences(df, ["s"], "n", ["t1c", "t2"], ["none", "axial", "coronal", "sagital"]).collect()))
    assert got == [("s1", "t1c", "t1c", False), ("s1", "t2", "t2-axial", True), ("s2", "t1c", "t1c-sagital", True), ("s2", "t2", "t2", False), ("s4", "t2", "t2-axial", True)]
    found = C.discovered_studies(df.unionByName(spark.createDataFrame([("_temp_x", "t2")], "s string, n string")), ["s"], "n", ["t2", "t1c"])
    assert sorted(map(tuple, found.collect())) == [("s1", ["t1c"], False), ("s2", ["t2"], False), ("s3", [], False), ("s4", [], False)]


def test_populations(spark):
    rows = [(25, True, "a"), (29, False, "b"), (30, True, None), (90, True, "a"), (91, None, "a"), (24, True, "b"), (None, True, "a")]
    df = spark.createDataFrame(rows, "age int, kept boolean, k string")
    members = {"all": F.lit(True), "included": F.col("kept")}
    got = {r.population: r for r in C.population_statistics(df, members, "age").collect()}
    for name, own in (("all", [r[0] for r in rows if r[0]]), ("included", [r[0] for r in rows if r[0] and r[1]])):
        assert tuple(got[name])[1:] == (len(own), min(own), max(own), pytest.approx(np.mean(own)), pytest.approx(np.std(own, ddof=1)), pytest.approx(np.median(own)), *(pytest.approx(np.percentile(own, p)) for p in (25, 75)))
    hist = {(r.population, r.low): r.n for r in C.population_histogram(df, members, "age", range(25, 95, 5)).collect()}
    counts, edges = np.histogram([r[0] for r in rows if r[0]], bins=range(25, 95, 5))
    assert [hist["all", float(e)] for e in edges[:-1]] == counts.tolist() and sum(n for (p, _), n in hist.items() if p == "included") == 3
    places = {(r.population, r.place): (r.value, r.n) for r in C.population_counts(df, members, F.col("k")).collect()}
    assert places["all", 1] == ("a", 4) and places["all", 2] == ("b", 2) and places["included", 3] == ("unknown", 1)


def test_what_studies_hold(spark):
    df = spark.createDataFrame([("a", 0, "t1"), ("a", 0, "t1"), ("a", 1, "t2"), ("b", 0, "t1"), ("c", 0, None)], "e string, v int, i string")
    assert sorted(map(tuple, C.count_distribution(df, "e", "v").collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, C.item_availability(df, ["e", "v"], "i").collect())) == [("t1", 2, 0.5), ("t2", 1, 0.25)]
    assert C.projected(df, ["v", "none", "e"], {"v": "w"}).columns == ["w", "e"]
