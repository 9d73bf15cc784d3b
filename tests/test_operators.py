"""Operators on rows written by hand."""

import gzip
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import checks as K
from tidemark.operators import curation as C
from tidemark.operators import images as I
from tidemark.operators import longitudinal as L
from tidemark.operators import records as R
from tidemark.operators import statistics as S


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def values(spark, numbers):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(numbers)], "g int, i int, v double")


def flagged(df):
    return sorted(r.i for r in df.where("outlier").collect())


def test_outliers(spark):
    assert flagged(S.mad_outliers(values(spark, [1, 2, 2, 3, 3, 3, 2, 2, 100]), ["g"], "v")) == [8]
    assert flagged(S.mad_outliers(values(spark, [5] * 5), ["g"], "v")) == []
    assert flagged(S.iqr_outliers(values(spark, [10, 11, 12, 13, 14, 15, 16, 100, 200]), ["g"], "v")) == [7, 8]
    assert flagged(S.zscore_outliers(values(spark, [0] * 20 + [50]), ["g"], "v")) == [20]
    assert flagged(S.mad_outliers(values(spark, [1, 2, 2, 3, 3, 3, 2, 2, 100]), ["g"], "v", least_rows=10)) == []


def test_nmi_ncc(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(1000) * 255, rng.random(1000) * 255
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ys in (("self", a), ("random", b), ("negated", -a)) for x, y in zip(a, ys, strict=True)], "g string, x double, y double")
    nmi = {r.g: r.nmi for r in S.nmi(df, ["g"], "x", "y", 64).collect()}
    assert nmi["self"] > 0.99 and nmi["random"] < 0.6
    ncc = {r.g: r.ncc for r in S.ncc(df, ["g"], "x", "y").collect()}
    assert ncc["self"] > 0.999 and abs(ncc["random"]) < 0.1 and ncc["negated"] < -0.999


def test_snr_and_histograms(spark):
    assert S.snr(values(spark, [0, 0, 0, 0]), ["g"], "v").first().snr == float("inf")
    hist = S.histogram(values(spark, [0, 1, 2, 3, 4]), ["g"], "v", 4)
    assert sorted((r.bin, r.n) for r in hist.collect()) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    ref = S.reference_histogram(S.histogram(values(spark, [0, 4]).unionByName(values(spark, [0, 4]).withColumn("g", F.lit(2))), ["g"], "v", 4, 0, 4), ["g"], 4)
    assert {r.distance for r in S.wasserstein(S.histogram(values(spark, [0, 4]), ["g"], "v", 4, 0, 4), ["g"], ref, 4, 1.0).collect()} == {0.0}
    two = S.histogram(values(spark, [1] * 10 + [9] * 10), ["g"], "v", 10, 0, 10)
    assert 1 <= S.otsu(two, ["g"], 10).first().threshold_bin < 9


def test_identifiers(spark):
    r = one(spark, *(X.normalize_id(F.lit(x)) for x in (" p007", "P", "000", "12")))
    assert [*r] == ["P7", "P0", "P0", "P12"]
    r = one(spark, X.tolerant_id(F.lit("P010"), F.lit(None)), X.tolerant_id(F.lit("abc"), F.lit(None)), X.tolerant_id(F.lit("N-1"), F.lit("P3")))
    assert [*r] == ["P10", "Pabc", "P3"]
    synonyms = {"t1c-axial": ["T1ce-ax"], "t2f": ["FLAIR"], "t2w": ["T2"], "t1c": ["T1"]}
    r = one(spark, *(X.first_synonym(F.lit(x), synonyms) for x in ("sT2_FLAIR", "my-t1CE-AX", "T1x", "other")))
    assert [*r] == ["t2f", "t1c-axial", "t1c", "other"]
    assert one(spark, X.resolve_category(F.lit("t1c-axial-2"), ["t1c", "t1c-axial"], {}))[0] == "t1c-axial"


def test_parsing(spark):
    r = one(spark, *(X.lenient_int(F.lit(x)) for x in ("1, 5", "-2.9", "x", None)))
    assert [*r] == [1, -2, None, None]
    r = one(spark, X.first_number(F.lit("SNR 3.5 below 8"), ["ratio ([0-9.]+)", "SNR ([0-9.]+)"]), X.suffix_number(F.lit("M-0001-002")), X.suffix_number(F.lit("1")), X.priority_pick("a > b > c", F.array(F.lit("c"), F.lit("b"))), X.exclusion_reason(F.lit("seg.nrrd"), ["*.txt", "s*.nrrd"]), X.normalize_text(F.lit("  A  b\t C ")))
    assert [*r] == [3.5, 2, -1, "b", "Matched exclusion pattern: s*.nrrd", "a b c"]
    r = one(spark, X.safe_round(F.lit(float("nan"))), X.safe_round(F.lit(2.345)), X.significance_stars(F.lit(0.01)), X.effect_size(F.lit(-0.6)), X.laterality(F.lit(120)), X.duration(F.lit(3725.0)), X.unit_interval(F.lit(15.0), 10, 20))
    assert r[0] is None and r[2:] == ("*", "medium", "midline", "1h 2m", 0.5)
    assert one(spark, X.shape_issues(F.array(F.lit(240), F.lit(238), F.lit(157)), (240, 240, 155), 1))[0] == ["238 != 240", "157 != 155"]
    assert one(spark, X.spacing_strategy(F.array(F.lit(0.9), F.lit(1.1), F.lit(3.0), F.lit(7.0)), F.array(*[F.lit(1.0)] * 4)))[0] == ["interpolate", "interpolate", "learned", "interpolate_then_learned"]
    r = one(spark, X.relative_thickness(F.array(F.lit(5.0), F.lit(1.0), F.lit(2.0))), X.is_zero_or_none(F.lit("0.0")), X.is_zero_or_none(F.lit("0")), X.step_base(F.lit("3_longitudinal_registration_x"), ["registration", "longitudinal_registration"]))
    assert [*r] == [5.0, False, True, "longitudinal_registration"]


def items(spark):
    rows = [("P1", "0", m) for m in "abc"] + [("P1", "1", "a")] + [("P2", v, m) for v in "01" for m in "abc"] + [("P2", "10", "a"), ("P3", "0", "b")]
    return spark.createDataFrame(rows, "entity string, visit string, item string")


def test_cascade_and_funnel(spark):
    visits = C.completeness(items(spark), "entity", "visit", "item", ["a", "b", "c"], 0)
    judged = C.cascade(visits, "entity", "visit", F.col("complete"), 2)
    assert {(r.entity, r.visit): r.fate for r in judged.collect()} == {("P1", "0"): "entity_rejected", ("P1", "1"): "entity_rejected", ("P2", "0"): "kept", ("P2", "1"): "kept", ("P2", "10"): "visit_rejected", ("P3", "0"): "entity_rejected"}
    rejected = C.ledger(judged.where("fate <> 'kept'"), F.col("fate"), "t", 1, "entity", "visit", "visit")
    kept = judged.where("fate = 'kept'").select("entity", "visit", F.col("visit").alias("item"))
    assert kept.count() + rejected.count() == visits.count()
    f = C.funnel(kept, rejected, (1,)).first()
    assert (f.entities_removed, f.visits_removed, f.entities_left, f.visits_left) == (3, 4, 1, 2)
    assert C.funnel(kept, rejected, (1,), exact=True).first().entities_removed == 2


def test_renumber(spark):
    rows = [(k, v) for k in (5, 10, 2) for v in range(k % 4 + 1)]
    got = C.renumber(spark.createDataFrame(rows, "e int, v int"), "e", "v", "M").collect()
    assert len({(r.new_entity, r.new_visit) for r in got}) == len(rows)
    assert {r.e: r.new_entity for r in got} == {2: "M-0001", 5: "M-0002", 10: "M-0003"}
    assert sorted(r.new_visit for r in got if r.e == 2) == ["M-0001-000", "M-0001-001", "M-0001-002"]
    gaps = C.close_gaps(spark.createDataFrame([(1, "M-0001"), (2, "M-0003"), (3, "M-0004")], "k int, old string"), "k", "old", "M")
    assert sorted((r.old, r.new) for r in gaps.collect()) == [("M-0003", "M-0002"), ("M-0004", "M-0003")]
    big = spark.range(5000).repartition(7)
    assert {(r.id, r.number) for r in C.dense_rank_by_range(big, F.col("id")).collect()} == {(i, i + 1) for i in range(5000)}


def test_exclusions_and_records(spark):
    visits = spark.createDataFrame([("A", "0"), ("A", "1"), ("B", "0"), ("C", "0"), ("C", "1"), ("C", "2")], "e string, v string")
    out = C.exclude(visits, spark.createDataFrame([("A", "1"), ("C", "0"), ("Z", "0")], "e string, v string"), "e", "v", 2)
    assert {(r.e, r.v): r.fate for r in out.collect()} == {("A", "0"): "cascade", ("A", "1"): "excluded", ("B", "0"): "kept", ("C", "0"): "excluded", ("C", "1"): "kept", ("C", "2"): "kept"}
    table = spark.createDataFrame([(0, "ID", "First", "", "c1"), (1, "", "vol", "date", "vol"), (2, "7", "3.5", "", "0"), (3, "", "1", "", "")], "n int, a string, b string, c string, d string")
    got = R.two_header_records(table, "n", ["a", "b", "c", "d"], "ID").collect()
    assert [(r.id, r.record) for r in got] == [("7", {"First/vol": "3.5", "c1/vol": "0"})]
    text = "1DIAGNOSTIC, 1, -0.5\n1DIAGNOSTIC, 2, inf\n"
    assert [(x.iteration, x.value) for x in one(spark, R.log_iterations(F.lit(text), r"1DIAGNOSTIC, (\d+), (\S+)"))[0]] == [(1, -0.5), (2, float("inf"))]
    m = {r.item: (r.present, r.missing) for r in C.missing_items(items(spark).withColumn("k", F.concat("entity", "visit")), items(spark).withColumn("k", F.concat("entity", "visit")), "k", "item", ["a", "z"]).collect()}
    assert m == {"a": (5, 1), "z": (0, 6), "overall": (5, 7)}


def test_header_checks(spark):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    flat = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 12.0]]
    rows = [("ok", 3, "lps", [200, 200, 150], eye), ("scout", 3, "lps", [200, 200, 3], eye), ("thick", 3, "lps", [200, 200, 20], flat), ("none", 3, None, [200, 200, 150], None), ("2d", 2, "lps", [5, 5], eye), ("singular", 3, "lps", [200, 200, 150], [eye[0], eye[0], eye[2]])]
    df = spark.createDataFrame(rows, "name string, dimension int, space string, sizes array<int>, directions array<array<double>>")
    found = K.run_checks(df, ["name"], K.header_checks(F.col("dimension"), F.col("space"), F.col("directions"), F.col("sizes")))
    failed = {}
    for r in found.where("not passed").collect():
        failed.setdefault(r.name, set()).add(r.check_name)
    assert "ok" not in failed and "nrrd_header" in failed["none"] and {"nrrd_header", "scout_localizer"} <= failed["2d"] and "affine" in failed["singular"]
    assert "scout_localizer" in failed["scout"] and {"scout_localizer", "voxel_spacing"} <= failed["thick"]
    up = {r.name: (r.status, r.reasons) for r in K.roll_up(found, ["name"]).collect()}
    assert up["ok"] == ("passed", "unknown") and up["singular"][0] == "blocked"


def test_overlap(spark):
    a, b = F.array(F.lit(True), F.lit(True), F.lit(False)), F.array(F.lit(True), F.lit(False), F.lit(False))
    none = F.array(F.lit(False), F.lit(False), F.lit(False))
    o = L.overlap(a, b, F.lit(None).cast("double"))
    r = one(spark, o["dice"], o["jaccard"], L.overlap(none, none, F.lit(None).cast("double"))["dice"], L.overlap(none, none, F.lit(0.0))["dice"], L.overlap(a, none, F.lit(None).cast("double"))["dice"])
    assert r[0] == pytest.approx(2 / 3) and r[1] == 0.5 and r[2] is None and r[3] == 0.0 and r[4] == 0.0


def test_stencils():
    v = np.zeros((5, 5, 5))
    v[2:, :, :] = 1
    g = I.sobel(v)
    assert g[1, 2, 2] == 16 and g[0, 2, 2] == 0
    assert I.erode(np.ones((3, 3, 3), bool)).sum() == 1
    m = np.zeros((6, 6, 6), bool)
    m[0, 0, :2] = m[3:5, 3:5, 3:5] = True
    assert I.largest_component(m).sum() == 8 and I.largest_component(np.zeros((2, 2), bool)).sum() == 0
    snake = np.zeros((7, 7), bool)
    snake[::2] = True
    snake[1, 6] = snake[3, 0] = snake[5, 6] = True
    assert I.largest_component(snake).sum() == snake.sum()
    assert I.pad_crop(np.ones((238, 240, 157)), (240, 240, 155)).shape == (240, 240, 155)
    assert I.corner_snr(np.zeros((4, 4, 4)), 2) == float("inf") and I.corner_snr(np.zeros((4, 4, 4))) == 0.0  # too small for cubes: no foreground


def test_nrrd_and_ledger(spark, tmp_path):
    from tidemark.sources.nrrd import read_nrrd
    from tidemark.sources.tables import append_ledger, by_extension, catalog, id_map_json, read_id_map, read_ledger

    data = np.arange(24, dtype="<i2")
    head = "NRRD0004\n# made up\ntype: short\ndimension: 3\nspace: left-posterior-superior\nsizes: 2 3 4\nspace directions: (1,0,0) (0,2,0) (0,0,3)\nendian: little\nencoding: {}\n\n"
    (tmp_path / "n/P1/0").mkdir(parents=True)
    (tmp_path / "n/P1/0/t1.nrrd").write_bytes(head.format("raw").encode() + data.tobytes())
    (tmp_path / "n/P1/0/t2.nrrd").write_bytes(head.format("gzip").encode() + gzip.compress(data.tobytes()))
    (tmp_path / "n/P1/0/bad.nrrd").write_bytes(b"no image")
    (tmp_path / "n/P1/0/t1.nii.gz").write_bytes(b"x")
    rows = {r.path.rpartition("/")[2]: r for r in read_nrrd(spark, str(tmp_path / "n")).collect()}
    assert rows["t1.nrrd"].data == rows["t2.nrrd"].data == [float(x) for x in data] and rows["t1.nrrd"].directions[1] == [0.0, 2.0, 0.0]
    assert rows["bad.nrrd"].error.startswith("ValueError") and rows["bad.nrrd"].data is None
    files = catalog(spark, str(tmp_path / "n"))
    best = {r.stem: r.path for r in by_extension(files, ["part_2", "part_1", "stem"]).collect()}
    assert best["t1"].endswith("t1.nrrd") and {r.part_2 for r in files.collect()} == {"P1"}
    old = spark.createDataFrame([("s", "f", "P1", "0", 'said "no", twice', "t")], "source_path string, filename string, patient_id string, study_name string, rejection_reason string, source_type string")
    append_ledger(old.coalesce(1), str(tmp_path / "ledger"))
    r = read_ledger(spark, str(tmp_path / "ledger")).first()
    assert r.stage == 0 and r.rejection_reason == 'said "no", twice'
    (tmp_path / "ids.json").write_text(json.dumps({"P1": {"new_id": "M-0001", "studies": {"0": "M-0001-000"}}}))
    ids = read_id_map(spark, str(tmp_path / "ids.json"))
    assert [tuple(r) for r in ids.collect()] == [("P1", "M-0001", "0", "M-0001-000")]
    assert json.loads(id_map_json(ids).first().value) == {"P1": {"new_id": "M-0001", "studies": {"0": "M-0001-000"}}}
    more = ids.unionByName(spark.createDataFrame([("P2", "M-0002", "0", "M-0002-000"), ("P2", "M-0002", "4", "M-0002-001")], ids.schema))
    id_map_json(more).write.text(str(tmp_path / "maps"))
    assert sorted(map(tuple, read_id_map(spark, str(tmp_path / "maps"), lines=True).collect())) == sorted(map(tuple, more.collect()))


def test_runner_report_and_stream(spark, tmp_path):
    from tidemark.plans.report import html_report, latex_table
    from tidemark.plans.runner import Registry, Runner, grouped
    from tidemark.streaming.accumulate import accumulate, sessions, windowed

    calls = []
    reg = Registry()
    reg.register("double", lambda df: (calls.append("double"), df.withColumn("v", F.col("v") * 2))[1])
    reg.register("registration", lambda df: df.withColumn("v", F.col("v") + 1))
    seen = []
    runner = Runner(reg, str(tmp_path / "steps"), [lambda name, df: seen.append((name, df.count()))])
    start = spark.createDataFrame([(1,), (2,)], "v int")
    steps = ["double_a", "registration"]
    assert sorted(r.v for r in runner.run(start, steps).collect()) == [3, 5]
    assert sorted(r.v for r in runner.run(start, steps).collect()) == [3, 5] and calls == ["double"] and len(seen) == 2
    assert grouped(["bias", "registration", "cubic_padding", "longitudinal_registration"]) == [("modality", ["bias"]), ("study", ["registration", "cubic_padding"]), ("patient", ["longitudinal_registration"])]
    assert "<td>1</td>" in html_report("t", {"s": start}) and "1 \\\\" in latex_table(start, "c")
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "a") for i in range(0, 50, 5)], "v int, t string, k string").withColumn("t", F.to_timestamp("t"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    sums = []
    accumulate(stream, str(tmp_path / "acc"), str(tmp_path / "cp"), lambda df: sums.append(df.agg(F.sum("v")).first()[0])).awaitTermination()
    assert sums == [225]
    for n, df, mode in (("w", windowed(stream, "t", ["k"], "v", "20 minutes"), "complete"), ("s", sessions(stream, "t", "k", "10 minutes"), "complete")):
        q = df.writeStream.format("memory").queryName(n).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 10 and spark.table("w").count() == 3 and spark.table("s").first().n == 10


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_have_no_gaps_in_large_tables(spark, adaptive):
    """Ranges are dealt once: rows in are rows out and numbers are 1 to n, however the ranges fall."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for n, parts, size in ((400_000, 16, "64m"), (2_000_000, 16, "1m"), (500_000, 7, "100k")):
            for k, v in zip(old, (adaptive, parts, size), strict=True):
                spark.conf.set(k, v)
            ranked = C.dense_rank_by_range(spark.range(n).select(((F.col("id") * 7919) % n).alias("id")).repartition(9), F.col("id"))
            got = ranked.agg(F.count("*").alias("n"), F.count_distinct("number").alias("d"), F.min("number").alias("a"), F.max("number").alias("b"), F.count_if(F.col("number") != F.col("id") + 1).alias("wrong")).first()
            assert tuple(got) == (n, n, 1, n, 0)
            keys = spark.range(n // 8).select((F.col("id") * 3).alias("e"), (F.col("id") % 5).alias("v"))
            assert C.renumber(keys.unionByName(keys.withColumn("v", F.col("v") + 7)), "e", "v", "M").select("new_entity").distinct().count() == n // 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_quantiles_of_large_groups(spark):
    from tidemark.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    groups = {"even": rng.random(5000) * 100, "skewed": np.exp(rng.normal(size=4000) * 8), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(700, 3.5), "few": np.array([1.0, 2.0]), None: rng.normal(size=900), "huge": np.array([-1.7e308, 1.7e308] * 60 + [0.0] * 60)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.953, "f": 1.0}
    for most, bins in ((100_000, 1024), (50, 8), (3, 16)):
        got = {r.g: r for r in quantiles(df, ["g"], "v", shares, most, bins).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            want = np.percentile(vs, [100 * p for p in shares.values()]) if g != "huge" else [got[g][n] for n in shares]
            assert [got[g][n] for n in shares] == pytest.approx(list(want), rel=1e-9, abs=1e-12), (g, most)
    # NaN after all, infinities at the ends, in small and large groups; values next to each other and of every size
    odd = {"nan": [1.0, 2.0, 3.0] * 200 + [float("nan")] * 40, "ends": [float("-inf")] * 70 + list(range(500)) + [float("inf")] * 90, "all": [float("inf")] * 300, "mixed": [float("nan")] * 100 + [float("-inf")] * 100, "next": [5e-324, 1e-323] * 300, "sizes": [10.0 ** k for k in range(-300, 300, 3)]}
    far = spark.createDataFrame([(g, float(v)) for g, vs in odd.items() for v in vs], "g string, v double").repartition(3)
    for most, bins in ((100_000, 1024), (100, 64)):
        got = {r.g: r for r in quantiles(far, ["g"], "v", shares, most, bins).collect()}
        for g, vs in odd.items():
            ordered = sorted(map(float, vs), key=lambda x: (math.isnan(x), x))
            for n, p in shares.items():
                at = p * (len(ordered) - 1)
                lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
                want = lo if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
                assert got[g][n] == pytest.approx(want, rel=1e-9, abs=0, nan_ok=True), (g, n, most)
    whole = quantiles(df, [], "v", {"m": 0.5}, 100, 8).first()
    assert whole.m == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_quantiles_round_once(spark):
    """As a fused multiply-add does, so that a quantile between equal values doesn't leave them out of the range that it ends."""
    from fractions import Fraction

    from tidemark.operators.quantiles import quantiles

    rng = np.random.default_rng(3)
    groups = {f"g{k}": np.round(rng.exponential(20.0, int(rng.integers(150, 700))), 2) for k in range(40)} | {"dense": np.round(rng.random(4000) * 0.2, 2)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    shares = {"a": 0.01, "b": 0.25, "c": 0.99}
    for most in (100_000, 50):
        got = {r.g: r for r in quantiles(df, ["g"], "v", shares, most, 16).collect()}
        for g, vs in groups.items():
            ordered = sorted(map(float, vs))
            for n, p in shares.items():
                at = p * (len(ordered) - 1)
                lo, hi, part = ordered[math.floor(at)], ordered[math.ceil(at)], at - math.floor(at)
                want = lo if part == 0 else float(Fraction(lo) * Fraction(1.0 - part) + Fraction(hi * part))
                assert got[g][n] == want, (g, n, most)


def test_rules_rolled_up_at_once_are_the_same(spark):
    df = spark.createDataFrame([(i % 7, i, float(i % 13) if i % 5 else None) for i in range(90)], "e int, i int, v double")
    rules = [K.Check("high", F.col("v") > 9, "block"), K.Check("a_low", F.col("v") < 2, "block"), K.Check("odd", F.col("v") % 2 == 1, "warn"), K.Check("off", F.lit(True), "block", enabled=False)]
    long = K.run_checks(df, ["e", "i"], rules)
    for keys in (["e"], ["e", "i"]):
        assert sorted(map(tuple, K.roll_up_rules(df, keys, rules).collect())) == sorted(map(tuple, K.roll_up(long, keys).collect()))
    names = ["high", "a_low", "odd", "off"]
    assert sorted(map(tuple, K.severity_rules(df, "e", rules, names).collect())) == sorted(map(tuple, K.severity_matrix(long, "e", names).collect()))


def test_normalised_arrays_with_mask_and_clip(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(3, 4, 60)], [bool(b) for b in rng.random(60) < 0.6]) for i in range(5)] + [(9, [2.0] * 4, [True] * 4), (10, [], []), (11, [-1.0, -2.0], [False, False])]
    df = spark.createDataFrame(rows, "i int, v array<double>, m array<boolean>")
    for mask in (None, "m"):
        z = {r.i: r.z for r in L.zscore_values(df, "v", "z", mask, (-1.5, 2.0)).collect()}
        p = {r.i: r.p for r in L.minmax_values(df, "v", "p", mask, 0.05, 0.9).collect()}
        for i, v, m in rows:
            v = np.array(v)
            inside = np.array(m, bool) if mask else v > 0
            want_z, want_p = np.zeros(len(v)), np.zeros(len(v))
            if inside.any():
                own = v[inside]
                want_z[inside] = np.clip((own - own.mean()) / max(own.std(), 1e-8), -1.5, 2.0)
                a, b = np.percentile(own, [5, 90])
                want_p[inside] = (own - a) / (1e-8 if a == b else b - a)
            assert z[i] == pytest.approx(list(want_z)) and p[i] == pytest.approx(list(want_p))


def test_normalised_arrays_cost_what_their_length_does(spark):
    """Nothing that is computed of a whole array is computed anew for its cells."""
    def seconds(n):
        df = spark.createDataFrame([(i, [float((j * 7919) % 1013) - 100 for j in range(n)]) for i in range(8)], "i int, v array<double>").coalesce(1).cache()
        df.count()
        out = []
        for f in (L.zscore_values, L.minmax_values):
            times = []
            for _ in range(3):
                began = time.perf_counter()
                L.array_cells(f(df, "v", "z"), ["i"], "z").agg(F.sum("z")).collect()
                times.append(time.perf_counter() - began)
            out.append(min(times))
        return out

    few, many = seconds(64), seconds(16_384)
    assert all(m < 256 * max(f, 0.02) for f, m in zip(few, many, strict=True))


def plain_sobel(v):
    """By the definition: a difference along one axis, 1-2-1 sums along the others, borders repeated."""
    total = np.zeros(v.shape)
    p = np.pad(v, 1, mode="edge")
    for axis in range(3):
        for at in np.ndindex(*v.shape):
            s = 0.0
            for off in np.ndindex(3, 3, 3):
                w = 1
                for a in range(3):
                    w *= (-1, 0, 1)[off[a]] if a == axis else (1, 2, 1)[off[a]]
                s += w * p[tuple(at[a] + off[a] for a in range(3))]
            total[at] += s * s
    return np.sqrt(total)


def test_image_measures_by_definition():
    rng = np.random.default_rng(3)
    v = rng.normal(5, 2, (6, 5, 7))
    g = plain_sobel(v)
    assert np.allclose(I.sobel(v), g)
    n, edges = np.zeros(256), np.linspace(g[g > 0].min(), g[g > 0].max(), 257)
    for x in g[g > 0].ravel():
        n[min(np.searchsorted(edges, x, "right") - 1, 255)] += 1
    p = n[n > 0] / n.sum()
    assert I.gradient_entropy(v) == pytest.approx(-(p * np.log2(p)).sum()) and I.gradient_entropy(np.ones((3, 3, 3))) == 0.0
    mask = np.zeros(v.shape, bool)
    mask[1:5, 1:5, 1:6] = True
    inner = np.zeros(v.shape, bool)
    inner[2:4, 2:4, 2:5] = True
    assert I.boundary_ratio(v, mask) == pytest.approx(g[mask & ~inner].mean() / g[inner].mean())
    assert I.boundary_ratio(v, np.zeros(v.shape, bool)) == 0.0 and I.boundary_ratio(np.ones(v.shape), mask) == 0.0
    big = rng.normal(100, 5, (24, 22, 26))
    cells = np.concatenate([big[a][:, b][:, :, c].ravel() for a in (slice(10), slice(-10, None)) for b in (slice(10), slice(-10, None)) for c in (slice(10), slice(-10, None))])
    above = big[big > np.percentile(big, 10)]
    assert I.corner_snr(big) == pytest.approx(np.percentile(above, 75) / (cells.std() / np.sqrt(2 - np.pi / 2)))
    assert I.corner_ratio(big) is None  # tissue in the corners
    dark = big.copy()
    for a in (slice(10), slice(-10, None)):
        for b in (slice(10), slice(-10, None)):
            for c in (slice(10), slice(-10, None)):
                dark[a, b, c] = -3.0
    assert I.corner_ratio(dark) == pytest.approx(3.0 / dark[dark > np.percentile(dark, 10)].mean())
    cut = np.percentile(v[v > 0], 10)
    assert I.corner_snr(v) == pytest.approx(v[v > cut].mean() / v[v <= cut].std())  # no room for cubes


def test_image_checks(spark):
    rng = np.random.default_rng(4)
    v = np.abs(rng.normal(0, 1, 64)) * 50
    rows = [("plain", v), ("zeros", np.zeros(64)), ("broken", np.where(np.arange(64) == 5, np.nan, v)), ("spike", np.where(np.arange(64) == 5, 1e5, v)), ("short", v[:10])]
    df = spark.createDataFrame([(n, [float(x) for x in a]) for n, a in rows], "name string, data array<double>")
    found = I.measure(df, ["name"], F.array(F.lit(4), F.lit(4), F.lit(4)), "data", I.CHECKED, cube=1)
    checks = K.run_checks(found, ["name"], I.image_checks(F.lit(0.1), F.lit(2.0), I.motion_threshold(F.lit(0.5), F.lit(1.0))))
    failed = {}
    for r in checks.where("not passed").collect():
        failed.setdefault(r.name, {})[r.check_name] = r.action
    assert failed["zeros"] == {"contrast_detection": "warn"} and failed["broken"]["intensity_outliers"] == "block" and failed["spike"]["intensity_outliers"] == "warn"
    assert "intensity_outliers" not in failed.get("plain", {}) and "short" not in failed
    assert [*one(spark, *(I.motion_threshold(F.lit(3.0), F.lit(a)) for a in (1.0, 3.0, 10.0, 100.0)))] == pytest.approx([3.0, 3.0, 3.0 / 2.05, 1.2])


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "x"), (3, None)], "i int, k string")
    known = spark.createDataFrame([("a", "one", None)], "name string, label string, none string")
    assert sorted((r.i, r.label) for r in C.with_lookup(rows, "k", known.withColumn("name", F.upper("name")), "name", {"label": "?"}).collect()) == [(1, "one"), (2, "?"), (3, "?")]
    got = {r.i: (r.label, r.rejected) for r in C.known_or_rejected(rows, "k", known, "name", "label", "No such").collect()}
    assert got == {1: ("one", None), 2: (None, "No such: x"), 3: (None, "No such: none")}
    assert [*one(spark, *(X.name_number(F.lit(x), {"First": 0, "Control 1": 1}) for x in (" first", "CONTROL 1", "else")))] == [0, 1, None]
    now = spark.createDataFrame([("a", "0", "t1")], "e string, v string, i string")
    gone = spark.createDataFrame([("a", "1", "t1"), ("b", "0", "t2"), ("a", "0", "t1")], "e string, v string, i string")
    assert sorted(map(tuple, C.before_filter(now, gone, "e", "v", "i").collect())) == [("a", "0", "t1"), ("a", "1", "t1"), ("b", "0", "t2")]
    issues = spark.createDataFrame([("a", "0"), ("a", "1"), ("a", "1"), ("b", "0")], "e string, v string")
    assert [tuple(r) for r in C.issues_of_others(issues, now, "e", "v").collect()] == [("a", 2)]
    post = spark.createDataFrame([(1, 5.0, 8.0), (2, 9.5, 0.0), (3, 1.0, 1.0)], "k int, snr double, size double")
    base = spark.createDataFrame([(1, 10.0, 8.5), (2, 10.0, 0.0)], "k int, snr double, size double")
    got = {r.k: r for r in L.against_baseline(post, base, ["k"], {"snr": "level", "size": "other"}).collect()}
    assert got.keys() == {1, 2} and got[1].snr_degraded and not got[2].snr_degraded and not got[1].size_changed and got[2].size_ratio is None and got[1].snr_delta == -5.0
