"""Metadata as JSON and as a flat table, each giving the other's rows back."""

import json
import random

from pyspark.sql import functions as F

from tidemark.sources import metadata as M


def test_root_maps_in_parts(spark, tmp_path):
    rng = random.Random(9)
    texts = ["plain", 'quote " and } { brace', "line\nend\n  },\n  {", "back\\slash", "é語", ""]
    data = {}
    for i in range(300):
        data[f"P{i}"] = rng.choice([
            {}, [], None, 5, "a } text", {"age": 3}, {"age": None, "note": rng.choice(texts), "deep": {"x": {"y": [1, {"z": rng.choice(texts)}]}}, "_curation": {"included": False, "exclusion_reason": rng.choice(texts), "assigned_id": "M-1"}},
            {"deep": {}}, {"list": [{"a": 1}, {}]}])
    data['odd "key" }'] = {"a": {"b": {}}}
    (tmp_path / "a.json").write_text(json.dumps(data, indent=2, ensure_ascii=False))
    (tmp_path / "one.json").write_text(json.dumps(data))
    (tmp_path / "empty.json").write_text("{}")
    (tmp_path / "bad.json").write_text("nothing here")
    load = lambda v: None if v is None else v
    for name in ("a.json", "one.json"):
        rows = M.read_root_map(spark, str(tmp_path / name))
        got = {r.key: r.value for r in rows.collect()}
        assert got.keys() == data.keys()
        for k, v in data.items():
            want = v if isinstance(v, str) else None if v is None else v
            assert load(got[k]) == want if isinstance(v, str) or v is None else json.loads(got[k]) == want
    assert spark.read.option("lineSep", M.ENTRY_END).text(str(tmp_path / "a.json")).count() > 100  # in many rows
    assert M.read_root_map(spark, str(tmp_path / "empty.json")).count() == 0 and M.read_root_map(spark, str(tmp_path / "bad.json")).count() == 0
    other = spark.createDataFrame([('{"_curation": {"keep": false, "No": "M-2"}}',)], "value string")
    assert tuple(M.with_curation(other, renamed={"included": "keep", "assigned_id": "No"}).first())[1:] == (False, None, "M-2")
    cur = {r.key: r for r in M.with_curation(M.read_root_map(spark, str(tmp_path / "a.json"))).collect()}
    for k, v in data.items():
        own = v.get("_curation", {}) if isinstance(v, dict) else {}
        assert (cur[k].included, cur[k].exclusion_reason, cur[k].assigned_id) == (own.get("included", True), own.get("exclusion_reason"), own.get("assigned_id"))


def test_table_and_lines_give_the_same_back(spark, tmp_path):
    rows = [("P1", 61, 0, 'scan "A", 3T', True, None, "M-1"), ("P2", None, 1, None, False, "few, studies\nat all", None), ("P03", 40, None, "b", True, None, "M-2")]
    df = spark.createDataFrame(rows, "patient_id string, age int, sex int, scanner string, included boolean, exclusion_reason string, assigned_id string")
    M.write_enriched_csv(df, str(tmp_path / "csv"))
    casts = {"age": "int", "sex": "int", "scanner": "string"}
    assert sorted(map(tuple, M.read_enriched_csv(spark, str(tmp_path / "csv"), casts).collect()), key=str) == sorted(rows, key=str)
    M.metadata_lines(df, "patient_id", list(casts)).write.text(str(tmp_path / "json"))
    back = M.with_curation(M.read_root_map(spark, str(tmp_path / "json"), lines=True))
    back = back.select(F.col("key").alias("patient_id"), F.from_json("value", "age int, sex int, scanner string").alias("v"), *M.DEFAULTS).select("patient_id", "v.*", *M.DEFAULTS)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "other.csv").write_text("original_id,age,New_ID,included\n7,61.0,M-9,\nP8,x,,0\n,5,,True\n9,,,False\n")
    got = M.read_enriched_csv(spark, str(tmp_path / "other.csv"), casts, renamed={"assigned_id": "New_ID"})
    assert sorted(map(tuple, got.collect())) == [("P7", 61, None, None, True, None, "M-9"), ("P8", None, None, None, False, None, None), ("P9", None, None, None, False, None, None)]
