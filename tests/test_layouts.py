"""Layout scans against a plain walk; the census of expected cells."""

from tidemark.sources import layouts as Y
from tidemark.sources.tables import LEDGER_SCHEMA, catalog

LAYOUTS = (
    Y.Layout("baseline_RM", "baseline/RM/{modality}/{patient}/{file}", study="0", named="baseline"),
    Y.Layout("baseline_TC", "baseline/TC/{patient}/{file}", study="0", named="baseline"),
    Y.Layout("controls", "controls/{patient}/{study}/{file}"),
    Y.Layout("extension", "extension_1/{patient}/{study}/{file}"),
)
STUDIES = {"primera": 0, "segunda": 1, "control1": 1, "Control2": 2}
FILES = {
    "source/baseline/RM/FLAIR/P01/FLAIR_P1.nrrd": ("baseline_RM", "P1", "baseline", "0", "FLAIR", None),
    "source/baseline/RM/T1/p2/seg.nrrd": ("baseline_RM", "P2", "baseline", "0", "T1", "Matched exclusion pattern: *seg*"),
    "source/baseline/TC/P3/TC_P3.nrrd": ("baseline_TC", "P3", "baseline", "0", None, None),
    "source/baseline/TC/P3/notes.txt": None,
    "source/controls/P40/CONTROL1/T1_P40_01.nrrd": ("controls", "P40", "control1", "1", None, None),
    "source/controls/P40/control2/T1_P40_02.nrrd": ("controls", "P40", "control2", "2", None, None),
    "source/controls/P40/Control9/a_seg.nrrd": ("controls", "P40", "Control9", None, None, "Unknown study directory name 'Control9'"),
    "source/controls/P40/loose.nrrd": (None, None, None, None, None, "No known layout"),
    "extension_1/85/primera/FLAIR.nrrd": ("extension", "P85", "primera", "0", None, None),
    "extension_1/085/segunda/T1 ce.nrrd": ("extension", "P85", "segunda", "1", None, None),
    "extension_1/000/segunda/T2.nii.gz": None,
}


def test_scan_layouts(spark, tmp_path):
    rows = [(p, 1) for p in FILES] + [(None, 1), ("extension_1/85/primera/FLAIR.nrrd", 2)]
    df = spark.createDataFrame(rows, "path string, layout int")
    scanned = Y.scan_layouts(df.select("path"), LAYOUTS, STUDIES, ["*seg*"])
    got = sorted((tuple(r) for r in scanned.collect()), key=str)
    want = []
    for p in [*FILES, "extension_1/85/primera/FLAIR.nrrd"]:
        if FILES[p]:
            name = p.rsplit("/", 1)[1]
            want.append((p, name, name.removesuffix(".nrrd"), *FILES[p]))
    assert got == sorted(want, key=str)
    assert Y.kept(scanned).count() + Y.rejected(scanned).count() == len(want) and Y.rejected(scanned).count() == 3
    assert [f.name for f in Y.rejected(scanned).schema] == [x.split()[0] for x in LEDGER_SCHEMA.split(", ")]
    both = Y.scan_layouts(df.select("path"), LAYOUTS, STUDIES, endings=Y.FORMATS["auto"])
    assert [r.sequence for r in both.where("filename = 'T2.nii.gz'").collect()] == ["T2"] and both.where("patient_id = 'P0'").count() == 1
    assert sorted((r.patient_id, r.study_name, r.sequences, r.n) for r in Y.dataset_structure(scanned).where("patient_id = 'P85'").collect()) == [("P85", "primera", ["FLAIR", "FLAIR"], 2), ("P85", "segunda", ["T1 ce"], 1)]
    assert Y.scan_layouts(df.select("path").limit(0), LAYOUTS, STUDIES).count() == 0
    for p in FILES:  # the same from files that are there
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    found = Y.scan_layouts(catalog(spark, str(tmp_path)), LAYOUTS, STUDIES, ["*seg*"])
    assert sorted(r.filename for r in Y.kept(found).collect()) == sorted(p.rsplit("/", 1)[1] for p, w in FILES.items() if w and w[-1] is None)


def test_census(spark):
    studies = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0)], "e string, v int")
    files = spark.createDataFrame([("a", 0, "t1", [2, 3]), ("a", 0, "t1", [1, 9]), ("a", 0, "t2", None), ("b", 0, "t1", [1, 9]), ("b", 0, "other", [5]), ("z", 0, "t1", [1])], "e string, v int, item string, size array<int>")
    census = Y.shape_census(studies, files, ("t1", "t2"), ["e", "v"], "item", "size")
    assert sorted(map(tuple, census.collect())) == [("a", 0, "t1", "OK", [1, 9]), ("a", 0, "t2", "BROKEN", None), ("a", 1, "t1", "MISSING", None), ("a", 1, "t2", "MISSING", None), ("b", 0, "t1", "OK", [1, 9]), ("b", 0, "t2", "MISSING", None)]
    assert sorted((tuple(r) for r in Y.census_summary(census, "item").collect()), key=str) == [("t1", "MISSING", None, 1), ("t1", "OK", "1x9", 2), ("t2", "BROKEN", None, 1), ("t2", "MISSING", None, 2)]
