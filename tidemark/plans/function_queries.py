"""Queries of the column functions, each over a whole table, and of small joins of curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import checks as K
from tidemark.operators import curation as C
from tidemark.operators import records
from tidemark.operators import statistics as S
from tidemark.plans.queries import CHECKS, LEDGER, _checks, _ids, _ledger, big, q4, query, rounded
from tidemark.sources.tables import table


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'K' || p_partkey WHEN p_size % 2 = 0 THEN 'P' || p_partkey ELSE 'P' || p_partkey || 'x' END AS tolerant,
 CAST(CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 0 WHEN 'widget' THEN 1 WHEN 'gear' THEN 2 END AS BIGINT) AS number, CASE p_type WHEN 'STANDARD' THEN 'STANDARD' WHEN 'SMALL' THEN 'SMALL' WHEN 'ECONOMY' THEN 'cheap' WHEN 'MEDIUM' THEN 'MEDIU' END AS resolved,
 lower(p_type) || ' ' || lower(p_brand) AS normalized, CAST(CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_partkey END AS BIGINT) AS suffix,
 CASE WHEN contains(p_name, 'small gizmo') THEN 'small gizmo' WHEN contains(p_name, 'gizmo') THEN 'gizmo' WHEN contains(p_name, 'small') THEN 'small' ELSE p_name END AS step FROM part""")
def name_functions(spark, d):
    """Identifiers, names and categories of parts."""
    key, size, kind = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_type")
    raw = F.concat(F.when(size % 2 == 0, F.lit("p000")).otherwise(F.lit(" ")), key, F.when(size % 2 == 0, "").otherwise("x"))
    last = F.get(F.split("p_name", " "), 1)
    return big(table(spark, d, "part").select(
        "p_partkey", X.tolerant_id(raw, F.when(size > 40, F.concat(F.lit("K"), key))).alias("tolerant"), X.name_number(F.concat(F.lit(" "), last), {"ring": 0, "Widget": 1, "GEAR": 2}).alias("number"),
        X.resolve_category(kind, ["STANDARD", "SMALL", "M", "MEDIU"], {"ECONOMY": "cheap"}).alias("resolved"), X.normalize_text(F.concat(F.lit("  "), kind, F.lit("  \t "), "p_brand", F.lit("\n"))).alias("normalized"),
        X.suffix_number(F.concat_ws("-", F.lit("M"), F.when(size % 4 != 0, "p_brand").otherwise(F.lit(None)), key)).alias("suffix"), X.step_base(F.col("p_name"), ["small", "gizmo", "small gizmo"]).alias("step")))


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS stars,
 CASE WHEN abs(0.3 - l_tax * 10) < 0.2 THEN 'negligible' WHEN abs(0.3 - l_tax * 10) < 0.5 THEN 'small' WHEN abs(0.3 - l_tax * 10) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
 round_even(l_quantity / 8, 2) AS rounded, l_linenumber = 1 AS nothing, CASE WHEN l_quantity * 5 < 115 THEN 'left' WHEN l_quantity * 5 > 125 THEN 'right' ELSE 'midline' END AS side,
 CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %ds', CAST(s AS BIGINT) // 60, CAST(s AS BIGINT) % 60) ELSE printf('%dh %dm', CAST(s AS BIGINT) // 3600, CAST(s AS BIGINT) % 3600 // 60) END AS took,
 array_to_string(list_filter([CASE WHEN abs(l_quantity - 20) > 5 THEN printf('%d != 20', CAST(l_quantity AS INT)) END, CASE WHEN abs(l_linenumber * 10 - 20) > 5 THEN printf('%d != 20', l_linenumber * 10) END], lambda x: x IS NOT NULL), ';') AS issues,
 {q4('greatest(l_quantity, l_linenumber, 3) / least(l_quantity, l_linenumber, 3)')} AS thickness FROM (SELECT *, l_linenumber * l_quantity * 64 + 0.5 AS s FROM lineitem)""")
def value_functions(spark, d):
    """Numbers of lines said in words."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    return big(rounded(table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", X.significance_stars(F.col("l_discount")).alias("stars"), X.effect_size(0.3 - F.col("l_tax") * 10).alias("effect"), X.safe_round(q / 8).alias("rounded"), X.is_zero_or_none(n - 1).alias("nothing"),
        X.laterality(q * 5).alias("side"), X.duration(n * q * 64 + 0.5).alias("took"), F.array_join(X.shape_issues(F.array(q.cast("int"), (n * 10).cast("int")), [20, 20], 5), ";").alias("issues"), X.relative_thickness(F.array(q, n.cast("double"), F.lit(3.0))).alias("thickness")), "thickness"))


@query(f"WITH {LEDGER} SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS visit, CAST(o_orderkey AS VARCHAR) AS item FROM f")
def before_filter(spark, d):
    """What was there before visits were rejected: the kept ones and the ledger's."""
    kept, gone = _ledger(spark, d)
    return C.before_filter(kept.withColumn("item", F.col("item").cast("string")), gone, "entity", "visit", "item")


@query(f"""WITH {CHECKS}, {LEDGER} SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM ck WHERE NOT passed AND NOT EXISTS (SELECT 1 FROM f WHERE fate = 'kept' AND f.o_custkey = ck.o_custkey AND f.o_orderkey = ck.o_orderkey) GROUP BY 1 HAVING count(*) >= 2""")
def issues_of_removed(spark, d):
    """Customers with two failed checks or more on orders that aren't left."""
    left = _ledger(spark, d)[0].select(F.col("entity").cast("long").alias("o_custkey"), F.col("visit").cast("long").alias("o_orderkey"))
    return C.issues_of_others(_checks(spark, d).where("not passed"), left, "o_custkey", "o_orderkey")


@query(f"""WITH {CHECKS} SELECT o_custkey, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, check_name, action, message FROM ck WHERE NOT passed""")
def issue_rows(spark, d):
    """Failures as rows of text."""
    return big(K.issue_rows(_checks(spark, d)).select("o_custkey", "o_orderkey", "l_linenumber", "check_name", "action", "message"))


@query("""SELECT o_orderkey, CAST(i AS BIGINT) AS iteration, CASE WHEN i = 3 AND o_orderkey % 4 = 0 THEN 'Infinity'::DOUBLE ELSE CAST(floor(o_totalprice) / i AS DOUBLE) END AS value FROM orders, range(1, CAST(o_orderkey % 4 + 2 AS INT)) r(i) WHERE i <> 3 OR o_orderkey % 4 = 3 OR o_orderkey % 4 = 2""")
def log_iterations(spark, d):
    """Steps of a log with a value each, one of them infinite, out of a text an order."""
    key, cost = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    steps = F.sequence(F.lit(1), (key % 4 + 1).cast("int"))
    text = F.array_join(F.transform(steps, lambda i: F.concat(F.lit("1DIAGNOSTIC, "), i.cast("string"), F.lit(", "), F.when((i == 3) & (key % 4 == 0), "inf").otherwise((cost / i).cast("string")), F.lit(", done\n"))), "noise\n")
    found = table(spark, d, "orders").select("o_orderkey", F.explode(records.log_iterations(text, r"DIAGNOSTIC,\s+(\d+),\s+(inf|[-+0-9.eE]+),")).alias("s"))
    return big(found.select("o_orderkey", "s.iteration", "s.value"))


@query(f"""WITH p AS (SELECT *, p_size / 10.0 AS s FROM part) SELECT p_partkey, {q4('s * 1.0')} AS orientation_det, abs(abs(s) - 1) < 0.01 AS orientation_valid, {q4('s')} AS spacing_x, 1.0::DOUBLE AS spacing_y, 2.5::DOUBLE AS spacing_z, {q4('greatest(s, 2.5) - least(s, 1.0)')} AS spacing_max_diff, {q4('s * s * 2.5')} AS affine_det FROM p""")
def geometry_metrics(spark, d):
    """Geometry of headers made of part sizes."""
    s, one, no = F.col("p_size") / 10.0, F.lit(1.0), F.lit(0.0)
    g = K.geometry_metrics(F.array(F.array(one, no, no), F.array(no, s, no), F.array(no, no, one)), F.array(s, one, F.lit(2.5)))
    return rounded(table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*"), "orientation_det", "spacing_x", "spacing_max_diff", "affine_det")


@query(f"""WITH v AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice - 20000 AS y FROM lineitem WHERE l_extendedprice > 20000),
n AS (SELECT l_suppkey, count(*) AS n FROM v GROUP BY 1), a AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY 1),
c AS (SELECT l_suppkey, coalesce(least(floor((x - x0) / nullif(x1 - x0, 0) * 8), 7), 0) AS i, coalesce(least(floor((y - y0) / nullif(y1 - y0, 0) * 8), 7), 0) AS j, count(*) AS n FROM v JOIN s USING (l_suppkey) GROUP BY ALL),
p AS (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS p, sum(n) OVER (PARTITION BY l_suppkey, i) / sum(n) OVER (PARTITION BY l_suppkey) AS px, sum(n) OVER (PARTITION BY l_suppkey, j) / sum(n) OVER (PARTITION BY l_suppkey) AS py FROM c),
m AS (SELECT l_suppkey, 2 * sum(p * ln(p / (px * py))) / nullif(-sum(p * ln(px)) - sum(p * ln(py)), 0) AS nmi FROM p GROUP BY 1),
k AS (SELECT l_suppkey, (avg(x * y) - avg(x) * avg(y)) / ((stddev_pop(x) + 1e-8) * (stddev_pop(y) + 1e-8)) AS ncc FROM v GROUP BY 1)
SELECT a.l_suppkey, CAST(coalesce(n.n, 0) AS BIGINT) AS n, {q4('CASE WHEN n.n >= 20 AND a.l_suppkey % 2 = 1 THEN coalesce(nmi, 0) END')} AS nmi, {q4('CASE WHEN n.n >= 20 AND a.l_suppkey % 2 = 0 THEN ncc END')} AS ncc
FROM a LEFT JOIN n USING (l_suppkey) LEFT JOIN m ON m.l_suppkey = a.l_suppkey LEFT JOIN k ON k.l_suppkey = a.l_suppkey""")
def similarity(spark, d):
    """Suppliers of even number by correlation, the others by mutual information; few pairs give neither."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") - 20000).alias("y"))
    return rounded(S.similarity(rows, ["l_suppkey"], "x", "y", F.col("l_suppkey") % 2 == 0, 8, 20), "nmi", "ncc")


@query(f"""WITH {LEDGER} SELECT item, entity, visit FROM led""")
def ledger_backtrace(spark, d):
    """The whole ledger under new ids, traced back to the old ones."""
    ids = _ids(spark, d)
    gone = _ledger(spark, d)[1].select("item", F.col("entity").cast("long").alias("o_custkey"), F.col("visit").cast("long").alias("o_orderkey"))
    renamed = gone.join(ids, ["o_custkey", "o_orderkey"]).select("item", F.col("new_entity").alias("entity"), F.col("new_visit").alias("visit"))
    return C.trace_back(renamed, ids, "o_custkey", "o_orderkey").select("item", "entity", "visit")


@query(f"""WITH {LEDGER}, k AS (SELECT DISTINCT o_custkey FROM f WHERE fate = 'kept'), n AS (SELECT o_custkey, printf('C-%06d', o_custkey) AS old FROM k), m AS (SELECT *, printf('C-%04d', row_number() OVER (ORDER BY old)) AS new FROM n)
SELECT o_custkey, old, new FROM m WHERE old <> new""")
def cascade_gap_close(spark, d):
    """New numbers for the customers that the cascade leaves, without the gaps of those that went."""
    left = _ledger(spark, d)[0].select(F.col("entity").cast("long").alias("o_custkey")).distinct()
    return C.close_gaps(left.withColumn("old", F.format_string("C-%06d", "o_custkey")), "o_custkey", "old", "C")
