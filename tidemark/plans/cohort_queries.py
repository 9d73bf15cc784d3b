"""Queries of cohort tables: orders stand for entities, their lines for studies and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cohort as C
from tidemark.plans.queries import big, q4, query, rounded
from tidemark.sources.tables import table

@query(f"""SELECT event_id, {q4("CASE WHEN event_id % 4 <> 0 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END")} AS volume, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 <> 0 END AS growing,
 CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END AS BIGINT) AS controls, CASE WHEN event_type LIKE '%r%' THEN CASE WHEN event_id % 2 = 0 THEN 't1c' ELSE 't1n' END WHEN event_type LIKE '%c%' THEN 't2' WHEN event_id % 2 = 0 THEN 'flair' END AS modality FROM events""")
def clinical_getters(spark, d):
    """What is derived of records: volume, growth, number of controls, modality by name."""
    key, kind = F.col("event_id"), F.col("event_type")
    volume = F.when(key % 4 != 0, F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0))).otherwise("none")
    growth = F.when(key % 3 != 0, (key % 2).cast("string")).otherwise("?")
    controls = F.when(key % 5 != 0, F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= key % 4))
    name = F.when(kind.contains("r"), F.concat(F.lit("T1"), F.when(key % 2 == 0, "ce").otherwise("_P1"))).when(kind.contains("c"), F.lit("t2_FLAIR")).otherwise(F.when(key % 2 == 0, "Flair").otherwise("dwi"))
    return rounded(table(spark, d, "events").select("event_id", C.first_volume(volume).alias("volume"), C.growth_status(growth).alias("growing"), C.n_controls(controls).alias("controls"), C.inferred_modality(name).alias("modality")), "volume")


SEQUENCES = """sq AS (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 't1c' WHEN 'N' THEN 't1n' ELSE 't2w' END || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '-axial' WHEN 2 THEN '-coronal' ELSE '-other' END AS name FROM lineitem)"""


def _sequences(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "t1c").when(F.col("l_returnflag") == "N", "t1n").otherwise("t2w")
    turn = F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 4 == 1, "-axial").when(F.col("l_linenumber") % 4 == 2, "-coronal").otherwise("-other")
    return table(spark, d, "lineitem").select("l_orderkey", F.concat(kind, turn).alias("name"))


@query(f"""WITH {SEQUENCES}, r AS (SELECT * FROM (VALUES ('t1c'), ('t1n'), ('t2w')) r(required)),
c AS (SELECT l_orderkey, required, name, CASE name WHEN required THEN 0 WHEN required || '-coronal' THEN 1 WHEN required || '-axial' THEN 2 END AS p FROM sq, r)
SELECT l_orderkey, required, arg_min(name, p) AS source, arg_min(name, p) <> required AS renamed FROM c WHERE p IS NOT NULL GROUP BY 1, 2""")
def required_sequences(spark, d):
    return C.required_sequences(_sequences(spark, d), ["l_orderkey"], "name", ["t1c", "t1n", "t2w"], ["none", "coronal", "axial"])


@query(f"""WITH {SEQUENCES}, a AS (SELECT DISTINCT l_orderkey FROM sq), k AS (SELECT l_orderkey, list_sort(list(name) FILTER (name IN ('t1c', 't1n', 't2w'))) AS got FROM sq GROUP BY 1)
SELECT l_orderkey, coalesce(array_to_string(got, ','), '') AS available, coalesce(len(got), 0) = 3 AS is_complete FROM k""")
def discovered_studies(spark, d):
    return C.discovered_studies(_sequences(spark, d), ["l_orderkey"], "name", ["t1c", "t1n", "t2w"]).withColumn("available", F.array_join("available", ","))


POPULATIONS = """pp AS (SELECT 'all' AS population, * FROM customer UNION ALL SELECT 'included', * FROM customer WHERE c_acctbal > 2000)"""


def _members():
    return {"all": F.lit(True), "included": F.col("c_acctbal") > 2000}


@query(f"""WITH {POPULATIONS} SELECT population, CAST(count(*) AS BIGINT) AS n, {', '.join(f'{q4(e)} AS {n}' for n, e in (('min', 'min(c_acctbal)'), ('max', 'max(c_acctbal)'), ('mean', 'avg(c_acctbal)'), ('std', 'stddev_samp(c_acctbal)'), ('median', 'median(c_acctbal)'), ('q1', 'quantile_cont(c_acctbal, 0.25)'), ('q3', 'quantile_cont(c_acctbal, 0.75)')))} FROM pp GROUP BY 1""")
def population_statistics(spark, d):
    return rounded(C.population_statistics(table(spark, d, "customer"), _members(), "c_acctbal"), "min", "max", "mean", "std", "median", "q1", "q3")


@query(f"""WITH {POPULATIONS}, b AS (SELECT i, CAST(i * 500.0 AS DOUBLE) AS low, CAST((i + 1) * 500.0 AS DOUBLE) AS high FROM range(20) r(i)), c AS (SELECT population, least(floor(c_acctbal / 500), 19) AS i, count(*) AS n FROM pp WHERE c_acctbal BETWEEN 0 AND 10000 GROUP BY 1, 2)
SELECT p.population, low, high, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT population FROM pp) p, b LEFT JOIN c ON c.population = p.population AND c.i = b.i""".replace("p, b LEFT JOIN", "p CROSS JOIN b LEFT JOIN"))
def population_histogram(spark, d):
    return C.population_histogram(table(spark, d, "customer"), _members(), "c_acctbal", [500.0 * k for k in range(21)])


@query(f"""WITH {POPULATIONS}, c AS (SELECT population, CASE WHEN c_nationkey % 6 = 0 THEN 'unknown' ELSE c_mktsegment END AS value, count(*) AS n FROM pp GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY population ORDER BY n DESC, value) AS BIGINT) AS place FROM c""")
def population_counts(spark, d):
    return big(C.population_counts(table(spark, d, "customer"), _members(), F.when(F.col("c_nationkey") % 6 != 0, F.col("c_mktsegment"))))


@query("""SELECT CAST(n AS BIGINT) AS n_visits, CAST(count(*) AS BIGINT) AS n_entities FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) GROUP BY n""")
def count_distribution(spark, d):
    return C.count_distribution(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query(f"""WITH {SEQUENCES} SELECT name, CAST(count(*) AS BIGINT) AS n_visits, {q4('count(*) / (SELECT count(DISTINCT l_orderkey) FROM sq)')} AS share FROM sq GROUP BY 1""")
def item_availability(spark, d):
    return rounded(C.item_availability(_sequences(spark, d), ["l_orderkey"], "name"), "share")


@query("""SELECT p_partkey AS study, p_brand AS modality, p_size / 10.0 AS spacing_x, CAST(p_size AS BIGINT) AS dim_x FROM part""")
def spacing_projection(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("study"), F.col("p_brand").alias("sequence"), (F.col("p_size") / 10.0).alias("spacing_x"), F.col("p_size").alias("width"), "p_name")
    return big(C.projected(rows, ["study", "sequence", "spacing_x", "spacing_y", "width", "height"], {"sequence": "modality", "width": "dim_x", "height": "dim_y"}))
