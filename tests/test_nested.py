"""Nested documents of checks and back."""

import json
import random

from tidemark.operators import nested as N

FIELDS = ("passed", "action", "message", "details")


def test_round_trip(spark):
    rng = random.Random(8)
    rows = {}
    for _ in range(400):
        level = rng.choice(N.LEVELS)
        key = (rng.choice([1, 2, 3]), None if level == "patient" else rng.choice(["0", "1"]), rng.choice(["t1", "t2"]) if level == "file" else None, level, rng.choice(["a", "b", "c"]))
        passed = rng.random() < 0.8
        rows[key] = (passed, "warn" if passed else rng.choice(["warn", "block"]), "" if passed else "it's \"bad\"\n", {"x": 1.5} if rng.random() < 0.5 else {})
    rows[(4, None, None, "patient", "a")] = (True, "warn", "", {})
    schema = "e int, v string, i string, level string, check_name string, passed boolean, action string, message string, details map<string,double>"
    extra = [(1, None, None, "other", "a", True, "warn", "", {}), (None, "0", "t1", "file", "a", False, "block", "", {}), (1, "0", "t1", "file", None, False, "block", "", {})]
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()] + extra, schema).repartition(4)
    texts = N.nested_json(N.nested(df, "e", "v", "i"), "e")
    documents = N.from_nested_json(texts, "e")
    got = {(r.e, r.v, r.i, r.level, r.check_name): (r.passed, r.action, r.message, r.details) for r in N.flattened(documents, "e", "v", "i").collect()}
    assert got == rows
    blocked = lambda ks: any(not rows[k][0] and rows[k][1] == "block" for k in ks)
    for r in texts.collect():
        doc = json.loads(r.value)
        own = [k for k in rows if k[0] == r.e]
        assert doc["status"] == ("blocked" if blocked(own) else "passed")
        assert doc["studies"].keys() == {k[1] for k in own if k[1]} and doc["patient_level_checks"].keys() == {k[4] for k in own if k[3] == "patient"}
        for v, study in doc["studies"].items():
            assert study["status"] == ("blocked" if blocked([k for k in own if k[1] == v]) else "passed") and study["study_level_checks"].keys() == {k[4] for k in own if k[1] == v and k[3] == "study"}
            assert {(i, c) for i, f in study["files"].items() for c in f["checks"]} == {(k[2], k[4]) for k in own if k[1] == v and k[3] == "file"}
    summary = {r.check_name: (r.total, r.n_passed, r.n_failed) for r in N.checks_summary(documents, "e").collect()}
    for c in "abc":
        own = [v[0] for k, v in rows.items() if k[3] == "file" and k[4] == c]
        assert summary[c] == (len(own), sum(own), len(own) - sum(own))
    assert summary[None][0] == 4 and summary[None][1] + summary[None][2] == 4


def test_repeats_missing_names_and_broken_texts(spark):
    schema = "e string, v int, i string, level string, check_name string, passed boolean, action string, message string, details map<string,double>"
    rows = [("a", 0, "t1", "file", "x", True, "warn", "", {"m": 9.0}), ("a", 0, "t1", "file", "x", False, "block", "one", {"m": 1.0}), ("a", 0, "t1", "file", "x", False, "warn", "two", {"m": 2.0}), ("a", None, None, "file", "y", True, "warn", "", None)]
    out = N.nested(spark.createDataFrame(rows, schema), "e", "v", "i")
    got = sorted((r.visit, r.item, r.check_name, r.passed, r.message, r.metric_value, r.threshold) for r in N.with_metric(N.flattened(out, "e"), {"x": ("m", "limit 3")}).select("visit", "item", "check_name", "passed", "message", "metric_value", "threshold").fillna("-").collect())
    assert got == [("0", "t1", "x", False, "two", "2.0", "limit 3"), ("none", "none", "y", True, "", "-", "-")]
    assert out.first().document.status == "blocked"  # any of the repeats counts
    broken = spark.createDataFrame([("a", "no json"), ("b", None), ("c", "{}"), ("d", '{"studies":{"0":{"files":{"t1":{"checks":{"x":{}}}}}}}')], "e string, value string")
    assert [tuple(r)[:7] for r in N.flattened(N.from_nested_json(broken, "e"), "e").collect()] == [("d", "0", "t1", "file", "x", True, "warn")]
    assert N.nested(spark.createDataFrame([], schema), "e", "v", "i").count() == 0


def test_rules_nested_straight_from_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.checks import Check, run_checks

    def rules(c=F.col):
        return [Check("x", c("x") > 3, "block", F.format_string("x %d", c("x")), {"x": c("x")}), Check("y", c("y") > 2, "warn", "y", {"y": c("y")}), Check("off", c("x") > 0, "block", enabled=False)]

    rng = random.Random(4)
    some = lambda *v: rng.choice([*v, None])
    rows = [(some(1, 2, 3, 4), some(1, 2), some("a", "b"), some(0, 2, 4, 5), some(1.0, 3.5), "wide" * 50) for _ in range(120)] + [(9, 1, "a", 0, 0.0, "")]
    df = spark.createDataFrame(rows, "e int, v int, i string, x int, y double, more string").repartition(3)
    straight = N.nested_rules(df, "e", "v", "i", ["x", "y"], rules)
    long = N.nested(run_checks(df, ["e", "v", "i"], rules()), "e", "v", "i")
    loaded = lambda d: {r.e: json.loads(r.value) for r in N.nested_json(d, "e").collect()}
    assert loaded(straight) == loaded(long) and {d["status"] for d in loaded(straight).values()} == {"blocked", "passed"}
    plan = straight._jdf.queryExecution().optimizedPlan().toString()
    assert "more" not in plan.split("RepartitionByExpression")[0] and "Generate" not in plan


def test_summary_makes_documents_once(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.checks import Check

    df = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "a", 1), (1, 2, "b", 1), (2, 3, "a", 1)], "e int, v int, i string, x int")
    texts = N.nested_rules_json(df, "e", "v", "i", ["x"], lambda c=F.col: [Check("x", c("x") > 3, "block", "x", {"x": c("x")}), Check("y", c("x") < 0)])
    out = N.checks_summary(N.from_nested_json(texts, "e", kind=N.SUMMARY), "e")
    assert sorted(tuple(r) for r in out.fillna("-").collect()) == [("-", 2, 1, 1), ("x", 3, 2, 1), ("y", 3, 3, 0)]
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(out).count("from_json(") == plan(out).count("RepartitionByExpression") == 1
    assert plan(N.flattened(N.from_nested_json(texts, "e"), "e").where("not passed")).count("from_json(") == 1


def test_summary_of_odd_documents(spark):
    check = '{"passed":false,"action":"block","message":"","details":{"x":1.0}}'
    texts = [
        "{}", None, '{"status":"blocked","studies":{"0":{"status":"passed"},"1":{"files":{"a":{},"b":{"checks":{"x":%s,"y":{}}}}}}}' % check, '{"status":"passed","studies":{}}',
        '{"status":"passed","studies":{"0":{"files":{}},"1":{"files":{"a":{"checks":{"x":{"passed":true}}},"b":{"checks":{"x":{}}}}}},"patient_level_checks":{"z":%s}}' % check]
    df = spark.createDataFrame(list(enumerate(texts)), "e int, value string")
    summary = lambda d: sorted(tuple(r) for r in N.checks_summary(d, "e").fillna("-").collect())
    for kind in (N.DOCUMENT, N.SUMMARY):
        assert summary(N.from_nested_json(df, "e", kind=kind)) == [("-", 4, 2, 1), ("x", 3, 2, 1), ("y", 1, 1, 0)]
        assert summary(N.from_nested_json(df.where("false"), "e", kind=kind)) == [("-", 0, 0, 0)]
    assert N.flattened(N.from_nested_json(df, "e"), "e").where("level = 'file'").count() == 4


def test_texts_straight_from_rows_quote_names(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.checks import Check, run_checks

    def rules(c=F.col):
        return [Check('q"1', c("x") > 3, F.when(c("x") > 5, "block").otherwise("warn"), F.concat(F.lit('"\\\n'), c("x").cast("string")), {'d"': c("x"), "e": c("y")}), Check("é", c("y") > 2, "block", "y")]

    names = ['a"b', "\\", "line\nbreak", "é\t", "", "[]", None]
    rng = random.Random(6)
    rows = [(rng.choice(["p", 'q"']), rng.choice(names), rng.choice(names), rng.choice([1, 4, 9, None]), rng.choice([1.5, float("nan"), None])) for _ in range(90)]
    df = spark.createDataFrame(rows, "e string, v string, i string, x int, y double").repartition(3)
    loaded = lambda d: {r.e: json.loads(r.value) for r in d.collect()}
    assert loaded(N.nested_rules_json(df, "e", "v", "i", ["x", "y"], rules)) == loaded(N.nested_json(N.nested(run_checks(df, ["e", "v", "i"], rules()), "e", "v", "i"), "e"))
