"""The command line's steps, one after the other, on a small cohort."""

import json

import pytest

from tidemark.__main__ import main
from tidemark.sources.tables import read_id_map, read_ledger


def test_steps(spark, tmp_path, capsys):
    held = {"P1": {"first": ["t1", "t2"], "second": ["t1", "t2"]}, "P02": {"first": ["t1", "t2"], "second": ["t1"]}, "P7": {"first": ["t1", "t2"], "second": ["t1", "t2"], "other": ["t1"]}}
    for p, studies in held.items():
        for s, names in studies.items():
            for n in [*names, "seg"]:
                at = tmp_path / "raw" / p / s / f"{n}.nrrd"
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(b"x")
    (tmp_path / "config.json").write_text(json.dumps({"layouts": [{"source": "controls", "pattern": "raw/{patient}/{study}/{file}"}], "studies": {"first": 0, "second": 1}, "exclusions": ["seg*"]}))
    out = str(tmp_path / "out")
    scan = ["reorganize", str(tmp_path / "raw"), "--config", str(tmp_path / "config.json"), "--out", out]
    assert main([*scan, "--dry-run"], spark) == {"items": 11, "rejected": 8} and not (tmp_path / "out").exists()
    assert main(scan, spark) == {"items": 11, "rejected": 8}
    assert {r.rejection_reason for r in read_ledger(spark, f"{out}/rejected").collect()} == {"Matched exclusion pattern: seg*", "Unknown study directory name 'other'"}
    kept = str(tmp_path / "filtered")
    assert main(["filter", f"{out}/items", "--require", "t1", "t2", "--out", kept], spark) == {"kept": 4, "rejected": 2}
    assert {(r.patient_id, r.stage) for r in read_ledger(spark, f"{kept}/rejected").collect()} == {("P2", 2)}
    new = str(tmp_path / "curated")
    assert main(["curate", f"{kept}/kept", "--name", "M", "--out", new], spark) == {"ids": 4, "id_mapping": 2}
    assert sorted((r.old_entity, r.new_entity, r.old_visit, r.new_visit) for r in read_id_map(spark, f"{new}/id_mapping", lines=True).collect()) == [("P1", "M-0001", "0", "M-0001-000"), ("P1", "M-0001", "1", "M-0001-001"), ("P7", "M-0002", "0", "M-0002-000"), ("P7", "M-0002", "1", "M-0002-001")]
    values = str(tmp_path / "values")
    spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 90]] + [("b", 1.0)], "g string, v double").write.parquet(values)
    assert main(["analyze", values, "--by", "g", "--value", "v", "--out", str(tmp_path / "stats")], spark) == {"summary": 2, "outliers": 1}
    with pytest.raises(SystemExit):
        main(["query", "nothing", "tables", "--out", "x"], spark)
    capsys.readouterr()
