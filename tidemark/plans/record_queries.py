"""Queries over nested and exported records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import masks as M
from tidemark.operators import nested as N
from tidemark.plans.queries import CHECKS, _line_rules, _rules, big, q4, query, rounded
from tidemark.sources import metadata
from tidemark.sources.staging import new_path
from tidemark.sources.tables import table


def _documents(spark, d, kind=N.DOCUMENT):
    """The checks of lines as nested documents of customers, written as JSON and read again; kind: the parts that are read."""
    texts = N.nested_rules_json(_rules(spark, d)[0], "o_custkey", "o_orderkey", "l_linenumber", ["l_quantity", "l_discount", "l_extendedprice", "l_tax"], _line_rules)
    return N.from_nested_json(texts, "o_custkey", kind=kind)


@query(f"""WITH {CHECKS}, d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey, l_linenumber, check_name ORDER BY passed, action DESC, message DESC) AS r FROM ck)
SELECT o_custkey, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'file' AS level, check_name, action, message FROM d WHERE r = 1 AND NOT passed""")
def nested_failures(spark, d):
    """What fails, out of the documents."""
    rows = N.flattened(_documents(spark, d), "o_custkey").where("not passed")
    return rows.select("o_custkey", F.col("visit").cast("long").alias("o_orderkey"), F.col("item").cast("long").alias("l_linenumber"), "level", "check_name", "action", "message")


@query(f"""WITH {CHECKS}, d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey, l_linenumber, check_name ORDER BY passed, action DESC, message DESC) AS r FROM ck),
e AS (SELECT o_custkey, bool_or(NOT passed AND action = 'block') AS blocked FROM ck GROUP BY 1)
SELECT check_name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_failed FROM d WHERE r = 1 GROUP BY 1
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), CAST(count(*) FILTER (NOT blocked) AS BIGINT), CAST(count(*) FILTER (blocked) AS BIGINT) FROM e""")
def nested_summary(spark, d):
    return N.checks_summary(_documents(spark, d, N.SUMMARY), "o_custkey")


@query(f"""WITH k AS (SELECT o_custkey, o_orderkey, l_linenumber, unnest([{{'check_name': 'quantity', 'v': CAST(l_quantity AS DOUBLE), 'f': l_quantity > 48}}, {{'check_name': 'discount', 'v': CAST(l_discount AS DOUBLE), 'f': l_discount > 0.08}},
 {{'check_name': 'price', 'v': CAST(l_extendedprice AS DOUBLE), 'f': l_extendedprice < 2000}}], recursive := true) FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey, l_linenumber, check_name ORDER BY CAST(v AS VARCHAR) DESC) AS r FROM k WHERE f)
SELECT check_name, {q4('avg(v)')} AS mean_value, CAST(count(*) AS BIGINT) AS n FROM d WHERE r = 1 GROUP BY 1""")
def nested_metrics(spark, d):
    """The metric of each failed check, out of the documents' details."""
    metrics = {"quantity": ("quantity", "48"), "discount": ("discount", "0.08"), "price": ("price", "2000")}
    rows = N.with_metric(N.flattened(_documents(spark, d), "o_custkey").where("not passed"), metrics)
    return big(rounded(rows.groupBy("check_name").agg(F.avg(F.col("metric_value").cast("double")).alias("mean_value"), F.count("*").alias("n")), "mean_value"))


#: Customers as entities of a cohort: an age, a sex and a scanner that some lack, and what curation says of them.
PATIENTS = """pt AS (SELECT 'P' || c_custkey AS patient_id, CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey + 20 AS BIGINT) END AS age, CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey % 2 AS BIGINT) END AS sex,
 CASE WHEN c_acctbal < 5000 THEN c_mktsegment || ', "3T"' END AS scanner, c_acctbal > 0 AS included, CASE WHEN c_acctbal <= 0 THEN 'balance, ' || c_mktsegment END AS exclusion_reason, CASE WHEN c_acctbal > 0 THEN 'M-' || c_custkey END AS assigned_id FROM customer)"""
FIELDS = {"age": "bigint", "sex": "bigint", "scanner": "string"}


def _patients(spark, d):
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        F.concat(F.lit("P"), "c_custkey").alias("patient_id"), F.when(nation % 5 != 0, (nation + 20).cast("long")).alias("age"), F.when(nation % 3 != 0, (nation % 2).cast("long")).alias("sex"),
        F.when(balance < 5000, F.concat("c_mktsegment", F.lit(', "3T"'))).alias("scanner"), (balance > 0).alias("included"), F.when(balance <= 0, F.concat(F.lit("balance, "), "c_mktsegment")).alias("exclusion_reason"),
        F.when(balance > 0, F.concat(F.lit("M-"), "c_custkey")).alias("assigned_id"))


@query(f"WITH {PATIENTS} SELECT * FROM pt")
def metadata_csv(spark, d):
    """Metadata written as a flat table and read again."""
    path = new_path(spark, "metadata-csv")
    metadata.write_enriched_csv(_patients(spark, d), path)
    return metadata.read_enriched_csv(spark, path, FIELDS)


@query(f"WITH {PATIENTS} SELECT * FROM pt")
def metadata_json(spark, d):
    """Metadata written as lines of JSON maps and read again."""
    path = new_path(spark, "metadata-json")
    metadata.metadata_lines(_patients(spark, d), "patient_id", list(FIELDS)).write.text(path)
    back = metadata.with_curation(metadata.read_root_map(spark, path, lines=True))
    own = F.from_json("value", ", ".join(f"{c} {k}" for c, k in FIELDS.items()))
    return back.select(F.col("key").alias("patient_id"), own.alias("v"), *metadata.DEFAULTS).select("patient_id", "v.*", *metadata.DEFAULTS)


# masks and results


LABELS = """lb AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > 0.25 THEN 3 WHEN CAST(v AS DOUBLE) > 0.15 THEN 2 WHEN CAST(v AS DOUBLE) > 0.05 THEN 1 ELSE 0 END) AS a,
 list_transform(embedding, lambda v: CASE WHEN vec_id % 9 = 0 THEN 0 WHEN CAST(v AS DOUBLE) > 0.28 THEN 3 WHEN CAST(v AS DOUBLE) > 0.13 THEN 2 WHEN CAST(v AS DOUBLE) > 0.02 THEN 1 ELSE 0 END) AS b FROM embeddings),
lp AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM lb)"""


@query(f"""WITH {LABELS} SELECT vec_id, {q4("CASE WHEN count(*) FILTER (x > 0) + count(*) FILTER (y > 0) = 0 THEN NULL ELSE 2.0 * count(*) FILTER (x > 0 AND y > 0) / (count(*) FILTER (x > 0) + count(*) FILTER (y > 0)) END")} AS dice_total,
 {', '.join(f'{q4(f"CASE WHEN count(*) FILTER (x > 0) + count(*) FILTER (y > 0) = 0 THEN NULL WHEN count(*) FILTER (x > 0) * count(*) FILTER (y > 0) = 0 THEN 0 ELSE 2.0 * count(*) FILTER (x = {n} AND y = {n}) / nullif(count(*) FILTER (x = {n}) + count(*) FILTER (y = {n}), 0) END")} AS dice_{n}' for n in (1, 2, 3))} FROM lp GROUP BY 1""")
def label_dice(spark, d):
    """Embeddings cut at two sets of thresholds, as two segmentations with three labels."""
    cut = lambda a, b, c: lambda v: F.when(v > c, 3).when(v > b, 2).when(v > a, 1).otherwise(0)
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(e, cut(0.05, 0.15, 0.25)).alias("a"), F.when(F.col("vec_id") % 9 == 0, F.transform(e, lambda v: F.lit(0))).otherwise(F.transform(e, cut(0.02, 0.13, 0.28))).alias("b"))
    return rounded(M.label_dice(rows, ["vec_id"], "a", "b", (1, 2, 3)), "dice_total", "dice_1", "dice_2", "dice_3")


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT CASE WHEN vec_id % 11 = 0 THEN 'loose' ELSE 't' || vec_id || '_m' || label END AS key, vec_id % 11 = 0 AS loose, vec_id, label, vec_id % 7 <> 0 AS has_reference, e FROM e),
i AS (SELECT vec_id, 'S-' || vec_id % 3 || '-t' || vec_id AS study, 'm' || label AS modality, e FROM e WHERE vec_id % 5 <> 0),
c AS (SELECT p.*, i.study, CASE WHEN loose THEN 'unexpected key' WHEN NOT has_reference THEN 'missing mask' WHEN i.vec_id IS NULL THEN 'no independent mask' ELSE 'compared' END AS status,
 len(list_filter(i.e, lambda v: v > 0.05)) AS n, len(list_filter(p.e, lambda v: v > 0.1)) AS k, len(list_filter(p.e, lambda v: v > 0)) AS r FROM p LEFT JOIN i ON i.vec_id = p.vec_id AND NOT loose)
SELECT key, CASE WHEN NOT loose THEN 't' || vec_id END AS timestamp, CASE WHEN NOT loose THEN 'm' || label END AS modality, status, CASE WHEN status = 'compared' THEN study END AS study,
 {', '.join(f"{q4(f'CASE WHEN status = {chr(39)}compared{chr(39)} THEN {e} END')} AS {x}" for x, e in (('volume_independent', 'n * 0.5'), ('volume_propagated', 'k * 0.5'), ('reference_dice', 'CASE WHEN r + k = 0 THEN 0 ELSE 2.0 * k / (r + k) END'), ('dice', 'CASE WHEN n + k = 0 THEN 0 ELSE 2.0 * k / (n + k) END'), ('jaccard', 'CASE WHEN n + k = 0 THEN 0 ELSE 1.0 * k / n END'), ('volume_difference_pct', '100.0 * abs(k - n) / nullif(n, 0)')))},
 {', '.join(f"CAST(CASE WHEN status = 'compared' THEN {e} END AS BIGINT) AS {x}" for x, e in (('overlap_voxels', 'k'), ('a_only_voxels', 'n - k'), ('b_only_voxels', '0')))} FROM c""")
def propagated_masks(spark, d):
    """Three masks of each embedding by falling thresholds, two of them found by the names of times and modalities."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    above = lambda t: F.transform("e", lambda v: v > t)
    key = F.when(F.col("vec_id") % 11 == 0, "loose").otherwise(F.concat(F.lit("t"), "vec_id", F.lit("_m"), "label"))
    propagated = e.select(key.alias("key"), F.when(F.col("vec_id") % 7 != 0, above(0.0)).alias("reference"), above(0.1).alias("mask"))
    independent = e.where("vec_id % 5 <> 0").select(F.concat(F.lit("S-"), F.col("vec_id") % 3, F.lit("-t"), "vec_id").alias("study"), F.concat(F.lit("m"), "label").alias("modality"), above(0.05).alias("mask"))
    return big(rounded(M.compare_propagated(propagated, independent, 0.5), "volume_independent", "volume_propagated", "reference_dice", "dice", "jaccard", "volume_difference_pct"))


@query(f"""SELECT CAST(count(o_totalprice) AS BIGINT) AS n, {', '.join(f'{q4(e)} AS {n}' for n, e in (('mean', 'avg(o_totalprice)'), ('std', 'stddev_pop(o_totalprice)'), ('min', 'min(o_totalprice)'), ('max', 'max(o_totalprice)'), ('q25', 'quantile_cont(o_totalprice, 0.25)'), ('median', 'median(o_totalprice)'), ('q75', 'quantile_cont(o_totalprice, 0.75)')))} FROM orders""")
def volume_summary(spark, d):
    return rounded(M.volume_summary(table(spark, d, "orders"), "o_totalprice"), "mean", "std", "min", "max", "q25", "median", "q75")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_items, CAST(max(greatest(CAST(l_quantity AS INT), l_linenumber * 9, l_partkey % 60)) AS BIGINT) AS max_dimension FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def largest_extent(spark, d):
    """The longest axis of each order's lines; returned ones have no shape."""
    axes = F.array(F.col("l_quantity").cast("long"), (F.col("l_linenumber") * 9).cast("long"), F.col("l_partkey") % 60)
    return big(M.largest_extent(table(spark, d, "lineitem").withColumn("shape", F.when(F.col("l_returnflag") != "R", axes)), ["l_orderkey"], "shape"))


@query("""WITH n AS (SELECT 'B-' || p_partkey AS name, p_partkey, p_brand || '/' || p_partkey AS study_path, CASE WHEN p_size % 3 <> 0 THEN list_value(240, 240, CASE WHEN p_size % 3 = 1 THEN 155 ELSE p_size END) END AS shape FROM part),
o AS (SELECT 'B-' || l_partkey AS name, min('out/' || l_orderkey) AS output FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT name, p_partkey, output, CASE WHEN output IS NOT NULL THEN study_path || '/seg' END AS destination, output IS NOT NULL AND coalesce(shape <> [240, 240, 155], false) AS shape_corrected, output IS NOT NULL AS success, CASE WHEN output IS NULL THEN 'No output found for ' || name END AS error FROM n LEFT JOIN o USING (name)""")
def remapped_outputs(spark, d):
    """Results made under working names, parts standing for studies and orders for outputs, under their own names again."""
    depth = F.when(F.col("p_size") % 3 == 1, 155).otherwise(F.col("p_size"))
    names = table(spark, d, "part").select(F.concat(F.lit("B-"), "p_partkey").alias("name"), "p_partkey", F.concat_ws("/", "p_brand", "p_partkey").alias("study_path"), F.when(F.col("p_size") % 3 != 0, F.array(F.lit(240), F.lit(240), depth.cast("int"))).alias("original_shape"))
    outputs = table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("B-"), "l_partkey").alias("name"), F.concat(F.lit("out/"), "l_orderkey").alias("file"))
    return M.remapped(names, outputs, "name", "file", (240, 240, 155), F.concat("study_path", F.lit("/seg"))).drop("study_path", "original_shape")
