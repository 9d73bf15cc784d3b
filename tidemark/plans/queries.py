"""Queries that bind the operators to the tables of a folder, each with SQL that says the same.

Entities are customers, visits their orders, items the orders' lines; measurements are prices and event values; masks are the
signs of embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import checks as K
from tidemark.operators import curation as C
from tidemark.operators import images, records
from tidemark.operators import longitudinal as L
from tidemark.operators import statistics as S
from tidemark.sources.staging import staged
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGS = ("A", "N", "R")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r4(c: Column | str) -> Column:
    """To four digits, ties up, the same in either engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10000.0 + 0.5).cast("double") / 10000.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r4(n) for n in names})


def big(df: DataFrame) -> DataFrame:
    """Integers of every width as 64 bits."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def q4(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * 10000.0 + 0.5) / 10000.0)"


def visits(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, o_orderkey, complete, missing): orders that have lines."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return C.completeness(lines, "o_custkey", "o_orderkey", "l_returnflag", FLAGS)


VISITS = """v AS (SELECT o_custkey, o_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A','N','R')) AS got,
    count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A','N','R')) = 3 AS complete,
    array_to_string(list_sort(list_filter(['A','N','R'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x))), ',') AS missing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT v.*, CASE WHEN count(*) FILTER (complete) OVER (PARTITION BY o_custkey) < 2 THEN 'entity_rejected' WHEN NOT complete THEN 'visit_rejected' ELSE 'kept' END AS fate FROM v)"""


@query(f"WITH {VISITS} SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_good FROM f WHERE fate = 'kept' GROUP BY o_custkey")
def completeness_filter(spark, d):
    kept = C.cascade(visits(spark, d), "o_custkey", "o_orderkey", F.col("complete"), 2).where("fate = 'kept'")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n_good"))


def _judged(spark, d) -> DataFrame:
    """Visits with their fate, from one written table of visits, so lines and orders are joined once."""
    return C.cascade(staged(visits(spark, d), "visits"), "o_custkey", "o_orderkey", F.col("complete"), 2)


def _rejected(judged: DataFrame) -> DataFrame:
    alone = F.col("fate") == "visit_rejected"
    return C.ledger(judged.where("fate <> 'kept'"), F.when(alone, F.concat(F.lit("missing "), "missing")).otherwise("too few visits"), F.when(alone, "filtering_visit").otherwise("filtering_entity"), F.when(alone, 1).otherwise(2), "o_custkey", "o_orderkey", "o_orderkey")


def _ledger(spark, d) -> tuple[DataFrame, DataFrame]:
    judged = staged(_judged(spark, d), "judged")
    kept = judged.where("fate = 'kept'").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderkey").cast("string").alias("visit"), F.col("o_orderkey").alias("item"))
    return kept, _rejected(judged)


LEDGER = f"""{VISITS}, led AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS visit, CAST(o_orderkey AS VARCHAR) AS item,
  CASE WHEN fate = 'visit_rejected' THEN 'missing ' || missing ELSE 'too few visits' END AS reason,
  CASE WHEN fate = 'visit_rejected' THEN 'filtering_visit' ELSE 'filtering_entity' END AS source_type, CAST(CASE WHEN fate = 'visit_rejected' THEN 1 ELSE 2 END AS BIGINT) AS stage FROM f WHERE fate <> 'kept')"""


@query(f"WITH {LEDGER} SELECT * FROM led")
def rejection_ledger(spark, d):
    return big(_rejected(_judged(spark, d)))


@query(f"WITH {LEDGER} SELECT stage, trim(r) AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT stage, unnest(string_split(reason, ',')) AS r FROM led) GROUP BY ALL")
def rejection_summary(spark, d):
    return big(C.reasons(_rejected(_judged(spark, d))))


FUNNEL = """g AS (SELECT stage, count(DISTINCT {who}) AS er, count(DISTINCT visit) AS vr, count(*) AS ir FROM {src} GROUP BY stage),
k AS (SELECT count(DISTINCT o_custkey) AS e, count(*) AS v FROM f WHERE fate = 'kept')
SELECT stage, CAST(er AS BIGINT) AS entities_removed, CAST(vr AS BIGINT) AS visits_removed, CAST(ir AS BIGINT) AS items_removed,
 CAST(e + coalesce(sum(er) OVER w, 0) AS BIGINT) AS entities_left, CAST(v + coalesce(sum(vr) OVER w, 0) AS BIGINT) AS visits_left, CAST(v + coalesce(sum(ir) OVER w, 0) AS BIGINT) AS items_left
FROM g, k WINDOW w AS (ORDER BY stage DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"WITH {LEDGER}, {FUNNEL.format(who='entity', src='led')}")
def attrition_funnel(spark, d):
    return big(C.funnel(*_ledger(spark, d), (1, 2)))


@query(f"""WITH {LEDGER}, led2 AS (SELECT led.*, CASE WHEN stage = max(stage) OVER (PARTITION BY entity) THEN entity END AS who FROM led
  WHERE entity NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM f WHERE fate = 'kept')), {FUNNEL.format(who='who', src='led2')}""")
def attrition_funnel_exact(spark, d):
    return big(C.funnel(*_ledger(spark, d), (1, 2), exact=True))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^.*[?].*$') THEN 'Matched exclusion pattern: *[?]*' WHEN regexp_matches(url, '^.*#.*$') THEN 'Matched exclusion pattern: *#*' END AS reason FROM pages""")
def exclude_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", X.exclusion_reason(F.col("url"), ["*[?]*", "*#*"]).alias("reason"))


@query("""SELECT p_partkey, 'P' || coalesce(nullif(ltrim(regexp_replace(trim(CAST(p_partkey AS VARCHAR)), '^[pP]', ''), '0'), ''), '0') AS id,
 'B' || coalesce(nullif(ltrim(regexp_replace(trim(p_brand), '^[bB]', ''), '0'), ''), '0') AS brand FROM part""")
def normalize_id(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_id(F.col("p_partkey").cast("string")).alias("id"), X.normalize_id(F.col("p_brand"), "B").alias("brand"))


SYNONYMS = {"metal": ["steel", "tin", "copper", "brass", "nickel"], "economy": ["ECONOMY"], "size": ["small", "medium", "large"], "vowel": ["a", "e"]}


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{s.lower()}') THEN '{n}'" for n, g in SYNONYMS.items() for s in g) + " ELSE p_type END AS standard FROM part")
def standardize_category(spark, d):
    return table(spark, d, "part").select("p_partkey", X.first_synonym(F.col("p_type"), SYNONYMS).alias("standard"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS n_rejected, min(struct_pack(p := l_partkey, s := l_suppkey, q := l_quantity, e := l_extendedprice)).p AS first_part FROM lineitem GROUP BY ALL""")
def dedup_first_wins(spark, d):
    kept = C.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    return big(kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("n_rejected"), F.max(F.when(F.col("keep"), F.col("l_partkey"))).alias("first_part")))


NUMBERS = """ids AS (SELECT o_custkey, o_orderkey, printf('C-%04d', dense_rank() OVER (ORDER BY o_custkey)) AS new_entity,
 printf('C-%04d-%03d', dense_rank() OVER (ORDER BY o_custkey), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS new_visit FROM orders)"""


def _ids(spark, d):
    return C.renumber(table(spark, d, "orders"), "o_custkey", "o_orderkey", "C")


@query(f"WITH {NUMBERS} SELECT * FROM ids")
def renumber_entities(spark, d):
    return _ids(spark, d)


@query("""WITH n AS (SELECT c_custkey, printf('C-%04d', c_custkey) AS old FROM customer WHERE c_nationkey % 3 <> 0), m AS (SELECT *, printf('C-%04d', row_number() OVER (ORDER BY old)) AS new FROM n)
SELECT c_custkey, old, new FROM m WHERE old <> new""")
def renumber_gap_close(spark, d):
    left = table(spark, d, "customer").where("c_nationkey % 3 <> 0").select("c_custkey", F.format_string("C-%04d", "c_custkey").alias("old"))
    return C.close_gaps(left, "c_custkey", "old", "C")


@query(f"""WITH {NUMBERS} SELECT o.o_orderkey, new_entity, new_visit, {q4('o_totalprice')} AS price FROM orders o JOIN ids USING (o_custkey, o_orderkey)""")
def id_map_apply(spark, d):
    return C.apply_ids(table(spark, d, "orders"), _ids(spark, d), "o_custkey", "o_orderkey").select("o_orderkey", "new_entity", "new_visit", r4("o_totalprice").alias("price"))


@query(f"""WITH {NUMBERS}, rej AS (SELECT new_entity AS entity, CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE new_visit END AS visit, o_orderkey FROM ids WHERE o_orderkey % 7 = 0)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN entity ELSE (SELECT CAST(o_custkey AS VARCHAR) FROM ids WHERE ids.new_visit = rej.visit) END AS entity,
 CASE WHEN o_orderkey % 5 = 0 THEN visit ELSE CAST(o_orderkey AS VARCHAR) END AS visit FROM rej""")
def id_backtrace(spark, d):
    ids = _ids(spark, d)
    rejected = ids.where("o_orderkey % 7 = 0").select("o_orderkey", F.col("new_entity").alias("entity"), F.when(F.col("o_orderkey") % 5 == 0, "gone").otherwise(F.col("new_visit")).alias("visit"))
    return C.trace_back(rejected, ids.withColumnsRenamed({"o_custkey": "c", "o_orderkey": "o"}), "c", "o").select("o_orderkey", "entity", "visit")


STATS = "min mean max std range non_zero_mean non_zero_std non_zero_fraction p1 p5 p25 p50 p75 p95 p99".split()


@query(f"""SELECT l_returnflag, {', '.join(f'{q4(x)} AS "{n}"' for n, x in {'min': 'min(v)', 'max': 'max(v)', 'mean': 'avg(v)', 'std': 'stddev_pop(v)', 'range': 'max(v) - min(v)', 'non_zero_mean': 'avg(v) FILTER (v > 0)', 'non_zero_std': 'stddev_pop(v) FILTER (v > 0)', 'non_zero_fraction': 'avg(CAST(v <> 0 AS INT))', **{f'p{p}': f'quantile_cont(v, {p / 100})' for p in (1, 5, 25, 50, 75, 95, 99)}}.items())}
FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY l_returnflag""")
def intensity_stats(spark, d):
    return rounded(S.intensity(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), *STATS)


def events(spark, d):
    return table(spark, d, "events")


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), m AS (SELECT event_type, avg(value) FILTER (value >= q3) AS high, avg(value) FILTER (value <= q1) AS low FROM events JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, {q4('high')} AS high, {q4('low')} AS low, {q4('(high - low) / nullif(high + low, 0)')} AS contrast FROM m""")
def contrast_ratio(spark, d):
    return rounded(S.contrast_ratio(events(spark, d), ["event_type"], "value"), "high", "low", "contrast")


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS p5 FROM events GROUP BY 1), m AS (SELECT event_type, avg(value) FILTER (value > 0) AS signal, stddev_pop(value) FILTER (value <= p5) AS lo, stddev_pop(value) AS a FROM events JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, {q4('signal')} AS signal, {q4('CASE WHEN lo > 0 THEN lo ELSE a END')} AS noise, {q4('signal / CASE WHEN lo > 0 THEN lo ELSE a END')} AS snr FROM m""")
def snr_estimate(spark, d):
    return rounded(S.snr(events(spark, d), ["event_type"], "value"), "signal", "noise", "snr")


@query(f"""WITH e AS (SELECT event_type, value FROM events WHERE value > 0), q AS (SELECT event_type, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.75) AS p75 FROM e GROUP BY 1),
m AS (SELECT event_type, avg(value) FILTER (value >= p75) AS signal, stddev_pop(value) FILTER (value <= p5) AS noise FROM e JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, {q4('signal')} AS signal, {q4('noise')} AS noise, {q4('CASE WHEN noise > 0 THEN signal / noise ELSE 0 END')} AS snr FROM m""")
def background_snr(spark, d):
    return rounded(S.background_snr(events(spark, d), ["event_type"], "value"), "signal", "noise", "snr")


@query(f"""WITH e AS (SELECT event_type, value FROM events WHERE value > 0), q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM e GROUP BY 1),
m AS (SELECT event_type, avg(value) FILTER (value >= a AND value < b) AS m1, avg(value) FILTER (value >= b AND value <= c) AS m2, var_pop(value) FILTER (value >= a AND value < b) AS v1, var_pop(value) FILTER (value >= b AND value <= c) AS v2 FROM e JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, {q4('m1')} AS m1, {q4('m2')} AS m2, {q4('abs(m1 - m2) / nullif(sqrt(v1 + v2), 0)')} AS cnr FROM m""")
def cnr_bands(spark, d):
    return rounded(S.cnr_bands(events(spark, d), ["event_type"], "value"), "m1", "m2", "cnr")


@query(f"""WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT a.l_linestatus, a.l_returnflag AS l_returnflag_a, b.l_returnflag AS l_returnflag_b, {q4('abs(a.m - b.m) / nullif(sqrt(a.v + b.v), 0)')} AS cnr FROM m a JOIN m b ON a.l_linestatus = b.l_linestatus AND a.l_returnflag < b.l_returnflag""")
def cnr_pairs(spark, d):
    return rounded(S.cnr_pairs(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_extendedprice"), "cnr")


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, {q4('q1 - 1.5 * (q3 - q1)')} AS lower, {q4('q3 + 1.5 * (q3 - q1)')} AS upper FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outliers_iqr(spark, d):
    return rounded(S.iqr_outliers(events(spark, d), ["event_type"], "value").where("outlier").select("event_id", "lower", "upper"), "lower", "upper")


@query(f"""WITH q AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, {q4('(value - m) / s')} AS z FROM events JOIN q USING (event_type) WHERE s > 0 AND abs((value - m) / s) > 3""")
def outliers_zscore(spark, d):
    return rounded(S.zscore_outliers(events(spark, d), ["event_type"], "value").where("outlier").select("event_id", "z"), "z")


MAD = """md AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), mm AS (SELECT event_type, any_value(med) AS med, median(abs(value - med)) AS mad, count(value) AS n FROM events JOIN md USING (event_type) GROUP BY 1)"""


@query(f"""WITH {MAD} SELECT event_id, {q4('0.6745 * (value - med) / mad')} AS modified_z FROM events JOIN mm USING (event_type) WHERE mad > 0 AND n >= 10 AND abs(0.6745 * (value - med) / mad) > 3.5""")
def outliers_mad(spark, d):
    return rounded(S.mad_outliers(events(spark, d), ["event_type"], "value", least_rows=10).where("outlier").select("event_id", "modified_z"), "modified_z")


@query(f"""WITH {MAD} SELECT event_type, CAST(count(*) AS BIGINT) AS n_cases, CAST(count(*) FILTER (mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5) AS BIGINT) AS n_outliers,
 {q4('avg(CASE WHEN mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5 THEN 1.0 ELSE 0.0 END)')} AS outlier_fraction, {q4('any_value(med)')} AS median, {q4('any_value(mad)')} AS mad FROM events JOIN mm USING (event_type) GROUP BY event_type""")
def group_summary_mad(spark, d):
    return rounded(S.group_summary(events(spark, d), ["event_type"], "value"), "outlier_fraction", "median", "mad")


@query("""WITH m AS (SELECT median(c_acctbal) AS a, median(c_nationkey) AS b FROM customer), k AS (SELECT median(abs(c_acctbal - a)) AS ma, median(abs(c_nationkey - b)) AS mb FROM customer, m)
SELECT c_custkey, coalesce(ma > 0 AND abs(0.6745 * (c_acctbal - a) / nullif(ma, 0)) > 3.5, false) AS c_acctbal_outlier, coalesce(mb > 0 AND abs(0.6745 * (c_nationkey - b) / nullif(mb, 0)) > 3.5, false) AS nation_outlier FROM customer, m, k""")
def outlier_sweep(spark, d):
    return S.outlier_sweep(table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")), "c_custkey", ["c_acctbal", "nation"])


@query(f"""WITH n AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders), h AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS p FROM lineitem WHERE l_returnflag IN ('A','N','R') GROUP BY 1), e AS (SELECT l_returnflag, p AS present, n - p AS missing FROM h, n),
u AS (SELECT * FROM e UNION ALL SELECT 'overall', sum(present), sum(missing) FROM e) SELECT l_returnflag, CAST(present AS BIGINT) AS present, CAST(missing AS BIGINT) AS missing, {q4('missing / nullif(present + missing, 0)')} AS missing_rate FROM u""")
def missing_category_report(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(C.missing_items(orders, table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", FLAGS), "missing_rate")


@query(f"""WITH u AS (SELECT 'l_quantity' AS axis, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT axis, {', '.join(f'{q4(f)} AS "{n}"' for n, f in (('mean', 'avg(v)'), ('std', 'stddev_pop(v)'), ('min', 'min(v)'), ('max', 'max(v)'), ('median', 'median(v)')))} FROM u GROUP BY axis""")
def spacing_stats_unpivot(spark, d):
    return rounded(S.unpivot_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "mean", "std", "min", "max", "median")


ORDER = ("o_orderdate", "o_orderkey")
GROWTH = """gr AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS timepoint, count(o_totalprice) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def _growth(spark, d):
    return L.growth(table(spark, d, "orders"), "o_custkey", ORDER, "o_totalprice")


@query(f"""WITH {GROWTH} SELECT o_custkey, o_orderkey, {q4('o_totalprice - previous')} AS growth_absolute, {q4('(o_totalprice - previous) / nullif(previous, 0)')} AS growth_relative FROM gr WHERE previous IS NOT NULL""")
def growth_rates(spark, d):
    return rounded(_growth(spark, d).where("previous is not null").select("o_custkey", "o_orderkey", "growth_absolute", "growth_relative"), "growth_absolute", "growth_relative")


@query(f"""WITH {GROWTH} SELECT CASE WHEN o_totalprice >= previous THEN 'increase' ELSE 'decrease' END AS direction, CAST(count(*) AS BIGINT) AS n, {q4('avg((o_totalprice - previous) / nullif(previous, 0))')} AS mean_growth FROM gr WHERE previous <> 0 GROUP BY 1""")
def growth_directions(spark, d):
    return rounded(L.split_growth(_growth(spark, d), "growth_relative"), "mean_growth")


@query(f"""WITH {GROWTH} SELECT o_custkey, CAST(timepoint AS BIGINT) AS timepoint, {q4('o_totalprice')} AS o_totalprice FROM gr WHERE n >= 2""")
def progression_min2(spark, d):
    return big(rounded(L.progression(table(spark, d, "orders"), "o_custkey", ORDER, "o_totalprice"), "o_totalprice"))


@query(f"""WITH {GROWTH} SELECT CAST(timepoint AS BIGINT) AS timepoint, {q4('avg(o_totalprice)')} AS mean, {q4('stddev_pop(o_totalprice)')} AS std, CAST(count(*) AS BIGINT) AS n FROM gr WHERE n >= 2 GROUP BY timepoint""")
def trajectory(spark, d):
    return big(rounded(L.trajectory(L.progression(table(spark, d, "orders"), "o_custkey", ORDER, "o_totalprice"), "timepoint", "o_totalprice"), "mean", "std"))


@query("""SELECT o_custkey, o_orderkey, before FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before > o_orderkey""")
def temporal_order_check(spark, d):
    return L.order_violations(table(spark, d, "orders"), "o_custkey", "o_orderkey", ORDER).select("o_custkey", "o_orderkey", "before")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders),
p AS (SELECT o_custkey, max(o_totalprice) FILTER (a = 1) AS x, max(o_totalprice) FILTER (b = 1) AS y FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT o_custkey, {q4('x')} AS baseline, {q4('y')} AS final, {q4('y - x')} AS delta, {q4('y / nullif(x, 0)')} AS ratio, y / nullif(x, 0) < 0.9 AS degraded FROM p""")
def pre_post_comparison(spark, d):
    return rounded(L.first_against_last(table(spark, d, "orders"), "o_custkey", ORDER, "o_totalprice"), "baseline", "final", "delta", "ratio")


# checks


def _line_rules(c=F.col):
    """The checks of a line; c gives its columns."""
    q, p, t = c("l_quantity"), c("l_discount"), c("l_extendedprice")
    return [
        K.Check("quantity", q > 48, "block", F.format_string("quantity %d above 48", q.cast("int")), {"quantity": q}),
        K.Check("discount", p > 0.08, "warn", "discount above 0.08", {"discount": p}),
        K.Check("price", t < 2000, "block", "price below 2000", {"price": t}),
        K.Check("tax", c("l_tax") > 1, "block", enabled=False),
    ]


def _rules(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows, _line_rules()


def _checks(spark, d):
    rows, rules = _rules(spark, d)
    return K.run_checks(rows, ["o_custkey", "o_orderkey", "l_linenumber"], rules)


CHECKS = """ck AS (SELECT o_custkey, o_orderkey, l_linenumber, u.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey, LATERAL (SELECT unnest([
 {'check_name': 'quantity', 'passed': l_quantity <= 48, 'action': CASE WHEN l_quantity > 48 THEN 'block' ELSE 'warn' END, 'message': CASE WHEN l_quantity > 48 THEN printf('quantity %d above 48', CAST(l_quantity AS INT)) ELSE '' END},
 {'check_name': 'discount', 'passed': l_discount <= 0.08, 'action': 'warn', 'message': CASE WHEN l_discount > 0.08 THEN 'discount above 0.08' ELSE '' END},
 {'check_name': 'price', 'passed': l_extendedprice >= 2000, 'action': CASE WHEN l_extendedprice < 2000 THEN 'block' ELSE 'warn' END, 'message': CASE WHEN l_extendedprice < 2000 THEN 'price below 2000' ELSE '' END},
 {'check_name': 'tax', 'passed': true, 'action': 'warn', 'message': 'Check disabled'}], recursive := true)) u),
st AS (SELECT o_custkey, o_orderkey, CASE WHEN bool_or(NOT passed AND action = 'block') THEN 'blocked' WHEN bool_or(NOT passed) THEN 'warned' ELSE 'passed' END AS status, count(*) FILTER (NOT passed) AS n_failed,
 coalesce(nullif(array_to_string(list_sort(list(DISTINCT check_name) FILTER (NOT passed AND action = 'block')), ','), ''), 'unknown') AS reasons FROM ck GROUP BY ALL)"""


@query(f"WITH {CHECKS} SELECT check_name, action, message, passed, CAST(count(*) AS BIGINT) AS n FROM ck GROUP BY ALL")
def checks_long(spark, d):
    return _checks(spark, d).groupBy("check_name", "action", "message", "passed").agg(F.count("*").alias("n"))


@query(f"WITH {CHECKS} SELECT o_custkey, o_orderkey, status, CAST(n_failed AS BIGINT) AS n_failed, reasons FROM st")
def checks_rollup(spark, d):
    rows, rules = _rules(spark, d)
    return K.roll_up_rules(rows, ["o_custkey", "o_orderkey"], rules)


@query(f"""WITH {CHECKS}, x AS (SELECT *, bool_or(status = 'blocked') OVER w AS hit, count(*) FILTER (status <> 'blocked') OVER w AS clean FROM st WINDOW w AS (PARTITION BY o_custkey))
SELECT o_custkey, o_orderkey, CASE WHEN NOT hit THEN 'kept' WHEN clean < 2 THEN 'entity_removed' WHEN status = 'blocked' THEN 'visit_removed' ELSE 'kept' END AS fate FROM x""")
def removal_decision(spark, d):
    return K.removal(checks_rollup(spark, d), "o_custkey", 2).select("o_custkey", "o_orderkey", "fate")


@query(f"""WITH {CHECKS} SELECT check_name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_failed, {q4('100.0 * count(*) FILTER (passed) / count(*)')} AS pass_rate FROM ck GROUP BY 1""")
def check_summary(spark, d):
    return rounded(K.check_summary(_checks(spark, d)), "pass_rate")


@query(f"WITH {CHECKS} SELECT check_name, CAST(count(*) AS BIGINT) AS n FROM ck WHERE NOT passed AND action = 'block' GROUP BY 1")
def issues_by_type(spark, d):
    return K.issues_by_type(_checks(spark, d))


@query(f"""WITH {CHECKS}, s AS (SELECT o_custkey, check_name, CASE WHEN passed THEN 0.0 WHEN action = 'block' THEN 1.0 ELSE 0.5 END AS w FROM ck)
SELECT o_custkey, {', '.join(f"CAST(max(w) FILTER (check_name = '{c}') AS DOUBLE) AS {c}" for c in ('quantity', 'discount', 'price'))} FROM s GROUP BY o_custkey""")
def severity_matrix(spark, d):
    rows, rules = _rules(spark, d)
    return K.severity_rules(rows, "o_custkey", rules, ["quantity", "discount", "price"])


@query(f"""WITH {CHECKS}, n AS (SELECT *, TRY_CAST(nullif(regexp_extract(message, 'quantity ([0-9]+)', 1), '') AS DOUBLE) AS v FROM ck WHERE NOT passed)
SELECT check_name, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY v DESC NULLS LAST, o_orderkey, l_linenumber) AS r FROM n) WHERE r = 1""")
def worst_case_per_check(spark, d):
    failed = _checks(spark, d).where("not passed")
    worst = L.worst_of(failed, ["check_name"], X.first_number(F.col("message"), ["quantity ([0-9]+)", "value ([0-9.]+)"]), ["o_orderkey", "l_linenumber"])
    return big(worst.select("check_name", "o_orderkey", "l_linenumber"))


@query("SELECT o_custkey, count(DISTINCT s) = 1 AS passed FROM (SELECT o_custkey, o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1")
def modality_consistency(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return K.same_set_check(rows, "o_custkey", "o_orderkey", "l_returnflag")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) FILTER (o_orderstatus NOT IN ('P')) <= 1 AS passed FROM orders GROUP BY 1")
def orientation_consistency(spark, d):
    return K.one_value_check(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ("P",))


HEAD_SQL = """WITH h AS (SELECT p_partkey, p_size * 8 AS a, p_size / 10.0 AS s, CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 3 END AS dim FROM part),
m AS (SELECT *, least(1.0, s, 1.2) AS lo, greatest(1.0, s, 1.2) AS hi, least(a, 155) AS n, least(a * 1.0, a * s, 155 * 1.2) AS e0, greatest(a * 1.0, a * s, 155 * 1.2) AS e1, abs(s * 1.2) AS det FROM h),
k AS (SELECT *, array_to_string(list_filter([CASE WHEN lo < 0.2 THEN 'spacing below minimum' END, CASE WHEN hi > 10.0 THEN 'spacing above maximum' END, CASE WHEN hi / lo > 20.0 THEN 'too anisotropic' END], lambda x: x IS NOT NULL), '; ') AS said FROM m),
c AS (SELECT p_partkey, unnest([{'c': 'nrrd_header', 'f': dim <> 3, 'a': 'block', 'm': 'Not a volume in a known space'}, {'c': 'scout_localizer', 'f': n < 10 OR hi > 10.0, 'a': 'block', 'm': 'Scout or localizer'}, {'c': 'voxel_spacing', 'f': said <> '', 'a': 'warn', 'm': said},
 {'c': 'affine', 'f': det < 1e-6 OR det > 1e6, 'a': 'block', 'm': 'Degenerate affine'}, {'c': 'fov_consistency', 'f': e1 / e0 > 5.0, 'a': 'block', 'm': 'Field of view ratio'}, {'c': 'fov_ratio', 'f': e1 / e0 > 3.0 AND e1 / e0 <= 5.0, 'a': 'warn', 'm': 'Field of view ratio'}, {'c': 'brain_coverage', 'f': e0 < 100.0, 'a': 'warn', 'm': 'Small extent'}], recursive := true) FROM k)
SELECT p_partkey, c AS check_name, NOT f AS passed, CASE WHEN f THEN a ELSE 'warn' END AS action, CASE WHEN f THEN m ELSE '' END AS message FROM c"""


@query(HEAD_SQL)
def header_checks(spark, d):
    """Header rules over headers made of part sizes."""
    p = F.col("p_partkey")
    heads = table(spark, d, "part").select("p_partkey", F.when(p % 97 == 0, 2).otherwise(3).alias("dimension"), F.when(p % 89 != 0, "left-posterior-superior").alias("space"), F.array(F.col("p_size") * 8, F.col("p_size") * 8, F.lit(155)).alias("sizes"), F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.col("p_size") / 10.0, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.2))).alias("directions"))
    rules = K.header_checks(F.col("dimension"), F.col("space"), F.col("directions"), F.col("sizes"))
    return K.run_checks(heads, ["p_partkey"], rules).select("p_partkey", "check_name", "passed", "action", "message")


# lookups, comparisons and summaries


@query("""SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 END AS number, CASE WHEN coalesce(lower(lang), '') NOT IN ('en', 'de', 'fr') THEN 'Unknown name: ' || coalesce(lang, 'none') END AS rejected FROM documents""")
def study_lookup(spark, d):
    names = spark.createDataFrame([("EN", 1), ("De", 2), ("fr", 3)], "name string, number int")
    return C.known_or_rejected(table(spark, d, "documents").select("doc_id", "lang"), "lang", names, "name", "number", "Unknown name").select("doc_id", "number", "rejected")


@query("""SELECT c_custkey, coalesce(n_name, 'unknown_site') AS site FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON c_nationkey = n_nationkey""")
def site_lookup(spark, d):
    known = table(spark, d, "nation").join(table(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("site"))
    return C.with_lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", known, "n_nationkey", {"site": "unknown_site"}).select("c_custkey", "site")


@query(f"""WITH {NUMBERS} SELECT DISTINCT new_entity, c_custkey AS original_id, {q4('c_acctbal')} AS c_acctbal FROM customer JOIN ids ON c_custkey = o_custkey""")
def clinical_by_new_id(spark, d):
    ids = _ids(spark, d).select(F.col("o_custkey").alias("old_entity"), "new_entity")
    return C.by_new_id(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", ids).select("new_entity", F.col("c_custkey").alias("original_id"), r4("c_acctbal").alias("c_acctbal"))


@query(f"""WITH p AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) FILTER (o_orderdate < DATE '1995-06-01') AS b, avg(o_totalprice) FILTER (o_orderdate >= DATE '1995-06-01') AS a FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderstatus, {q4('a - b')} AS price_delta, {q4('a / nullif(b, 0)')} AS price_ratio, abs(a / nullif(b, 0) - 1) > 0.1 AS price_changed FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def baseline_comparison(spark, d):
    orders = table(spark, d, "orders")
    mean = lambda rows: rows.groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"))
    out = L.against_baseline(mean(orders.where("o_orderdate >= DATE '1995-06-01'")), mean(orders.where("o_orderdate < DATE '1995-06-01'")), ["o_custkey", "o_orderstatus"], {"price": "size"})
    return rounded(out, "price_delta", "price_ratio")


@query(f"""WITH e AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey) SELECT CAST(count(*) AS BIGINT) AS total_entities, CAST(sum(n) AS BIGINT) AS total_visits, {q4('avg(n)')} AS mean_visits, {q4('stddev_pop(n)')} AS std_visits, CAST(min(n) AS BIGINT) AS min_visits, CAST(max(n) AS BIGINT) AS max_visits FROM e""")
def visits_per_entity(spark, d):
    return rounded(C.visits_per_entity(table(spark, d, "orders"), "o_custkey", "o_orderkey"), "mean_visits", "std_visits")


PER_PART = "pp AS (SELECT l_returnflag, l_partkey, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY ALL)"


@query(f"""WITH {PER_PART}, q AS (SELECT l_returnflag, quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS b FROM pp GROUP BY 1)
SELECT l_returnflag, {q4('avg(m)')} AS mean_across, {q4('stddev_pop(m)')} AS std_across, {q4('avg(s)')} AS mean_std, {q4('any_value(a - 1.5 * (b - a))')} AS lower, {q4('any_value(b + 1.5 * (b - a))')} AS upper, CAST(count(*) FILTER (m < a - 1.5 * (b - a) OR m > b + 1.5 * (b - a)) AS BIGINT) AS n_outliers FROM pp JOIN q USING (l_returnflag) GROUP BY 1""")
def category_summary(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    return rounded(S.category_summary(each, "l_returnflag", "m", "s"), "mean_across", "std_across", "mean_std", "lower", "upper")


POSITIVE = "e AS (SELECT event_type, value FROM events WHERE value > 0)"


@query(f"""WITH {POSITIVE}, q AS (SELECT event_type, quantile_cont(value, 0.75) AS f FROM e GROUP BY 1), p AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM e JOIN q USING (event_type) WHERE value >= f GROUP BY 1)
SELECT event_type, {q4('m')} AS roi_mean, {q4('s')} AS roi_std, CAST(n AS BIGINT) AS n_roi, {q4('CASE WHEN s > 0 THEN m / s * sqrt(2 / (4 - pi())) ELSE 0 END')} AS snr_foreground FROM p""")
def foreground_snr(spark, d):
    return rounded(S.foreground_snr(events(spark, d), ["event_type"], "value"), "roi_mean", "roi_std", "snr_foreground")


@query(f"""WITH {POSITIVE}, q AS (SELECT event_type, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM e GROUP BY 1),
p AS (SELECT event_type, avg(value) FILTER (value >= c) AS m, stddev_pop(value) FILTER (value <= p5) AS noise, stddev_pop(value) FILTER (value >= c) AS s, avg(value) FILTER (value >= a AND value < b) AS m1, avg(value) FILTER (value >= b AND value <= c) AS m2, var_pop(value) FILTER (value >= a AND value < b) AS v1, var_pop(value) FILTER (value >= b AND value <= c) AS v2 FROM e JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, {q4('CASE WHEN noise > 0 THEN m / noise ELSE 0 END')} AS snr_background, {q4('CASE WHEN s > 0 THEN m / s * sqrt(2 / (4 - pi())) ELSE 0 END')} AS snr_foreground, {q4('abs(m1 - m2) / nullif(sqrt(v1 + v2), 0)')} AS cnr_high_low FROM p""")
def signal_measures(spark, d):
    return rounded(S.signal_measures(events(spark, d), ["event_type"], "value"), "snr_background", "snr_foreground", "cnr_high_low")


@query(f"""WITH {POSITIVE} SELECT event_type, {q4('median(value)')} AS median, {q4('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr FROM e GROUP BY 1""")
def intensity_stability(spark, d):
    return rounded(S.stability(events(spark, d), ["event_type"], "value"), "median", "iqr")


@query(f"""WITH {POSITIVE}, q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM e GROUP BY 1), h AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 32), 31) AS bin, count(*) AS n FROM e JOIN q USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY ALL)
SELECT event_type, CAST(bin AS BIGINT) AS bin, CAST(n AS BIGINT) AS n, {q4('n / sum(n) OVER (PARTITION BY event_type)')} AS density FROM h""")
def stability_histogram(spark, d):
    return big(rounded(S.stability_histogram(events(spark, d), ["event_type"], "value", 32), "density"))


VOLUME_SQL = """WITH ce AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.99) AS p99, max(v) AS mx, avg(v) AS m, stddev_pop(v) AS s, max(n) AS u FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, v) AS n FROM ce) GROUP BY 1),
f AS (SELECT vec_id, stddev_pop(v) FILTER (corner) / sqrt(2 - pi() / 2) AS noise, quantile_cont(v, 0.75) FILTER (v > p10) AS signal, avg(abs(v)) FILTER (corner) AS ca, avg(v) FILTER (v > p10) AS fm FROM (SELECT *, pos IN (0, 3, 12, 15, 48, 51, 60, 63) AS corner FROM ce JOIN q USING (vec_id)) GROUP BY 1),
t AS (SELECT vec_id, avg(CAST(abs(v) > 0.05 * fm AS INT)) AS tissue FROM ce JOIN f USING (vec_id) WHERE pos IN (0, 3, 12, 15, 48, 51, 60, 63) GROUP BY 1)
SELECT vec_id, unnest([{'check_name': 'snr_filtering', 'passed': NOT (noise > 0 AND signal / noise < 1.2)}, {'check_name': 'contrast_detection', 'passed': NOT (m = 0 OR s / abs(m) < 2.0 OR u / 64 > 0.95)},
 {'check_name': 'intensity_outliers', 'passed': NOT (p99 > 0 AND mx / p99 > 1.2)}, {'check_name': 'ghosting_detection', 'passed': NOT (tissue <= 0.5 AND ca / fm > 0.15)}], recursive := true) FROM q JOIN f USING (vec_id) JOIN t USING (vec_id)"""


def _image_checks(spark, d):
    rows = table(spark, d, "embeddings")
    found = images.measure(rows, ["vec_id"], F.array(F.lit(4), F.lit(4), F.lit(4)), "embedding", images.CHECKED, cube=1)
    return K.run_checks(found, ["vec_id"], images.image_checks(F.lit(1.2), F.lit(1.2), images.motion_threshold(F.lit(3.0), F.lit(5.0)), least_spread=2.0))


@query(VOLUME_SQL)
def image_checks(spark, d):
    """Four of the five checks of embeddings as 4 x 4 x 4 volumes; the fifth needs a stencil."""
    return _image_checks(spark, d).where("check_name <> 'motion_artifact'").select("vec_id", "check_name", "passed")


@query()
def motion_check(spark, d):
    return _image_checks(spark, d).where("check_name = 'motion_artifact'").select("vec_id", "check_name", "passed", "action", "message")


# records


@query(f"""WITH j AS (SELECT d.doc_id, d.lang, CAST(n_chars AS DOUBLE) AS n_chars, quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CAST(count(*) AS BIGINT) AS n, {q4('avg(n_chars)')} AS mean, {q4('coalesce(stddev_samp(n_chars), 0)')} AS std, {q4('median(n_chars)')} AS median, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS n_unknown FROM j WHERE lang <> 'de'""")
def clinical_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(records.clinical_summary(rows, "n_chars", "quality", F.col("lang") != "de"), "mean", "std", "median")


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS value, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def category_counts(spark, d):
    return records.counted(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query("""SELECT CAST(least(floor((c_acctbal + 1000) / 11000 * 13), 12) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY 1""")
def age_histogram(spark, d):
    one = table(spark, d, "customer").withColumn("everyone", F.lit(1))
    return big(S.histogram(one, ["everyone"], "c_acctbal", 13, -1000, 10000).select("bin", "n"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT CAST(k % 10 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM e WHERE k IS NOT NULL GROUP BY 1""")
def json_details_explode(spark, d):
    rows = events(spark, d).select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "v")).where("name = 'k'")
    return rows.groupBy((X.lenient_int(F.col("v")).cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS DOUBLE) AS number, CASE WHEN contains(url, 'https') THEN 'secure' WHEN contains(url, 'http') THEN 'plain' ELSE 'other' END AS kind FROM pages""")
def regex_log_parse(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.first_number(u, ["([0-9]+)"]).alias("number"), X.classify(u, [("https", "secure"), ("http", "plain")]).alias("kind"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' WHEN bool_or(l_returnflag = 'R') THEN 'R' END AS reference FROM lineitem GROUP BY 1""")
def priority_pick(spark, d):
    have = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    return have.select("l_orderkey", X.priority_pick("N > R", F.col("have")).alias("reference"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(CAST(b.quality AS VARCHAR), a.lang) AS lang FROM documents a FULL JOIN (SELECT doc_id + 10 AS doc_id, quality FROM labels) b USING (doc_id)""")
def full_outer_upsert(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang")
    news = table(spark, d, "labels").select((F.col("doc_id") + 10).alias("doc_id"), F.col("quality").cast("string").alias("lang"))
    return C.upsert(base, news, "doc_id", ["lang"])


@query("""SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'matched' WHEN a.k IS NOT NULL THEN 'known_only' ELSE 'present_only' END AS state
FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 10 AS k FROM labels) b ON a.k = b.k""")
def phantom_entities(spark, d):
    return C.reconcile(table(spark, d, "documents"), table(spark, d, "labels").select((F.col("doc_id") + 10).alias("doc_id")), "doc_id")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_orderkey % 11 = 0 AS hit FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN hit THEN 'excluded' WHEN bool_or(hit) OVER w AND count(*) FILTER (NOT hit) OVER w < 5 THEN 'cascade' ELSE 'kept' END AS fate FROM h WINDOW w AS (PARTITION BY o_custkey)""")
def exclusion_cascade(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return C.exclude(orders, orders.where("o_orderkey % 11 = 0"), "o_custkey", "o_orderkey", 5)


@query("""SELECT user_id, CASE WHEN NOT bool_or(event_type = 'click') THEN 'click' WHEN NOT bool_or(event_type = 'purchase') THEN 'purchase' WHEN NOT bool_or(event_type = 'refund') THEN 'refund' END AS resume FROM events GROUP BY 1""")
def resume_steps(spark, d):
    done = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return done.select("user_id", C.next_step(F.col("done"), ["click", "purchase", "refund"]).alias("resume"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def checkpoint_latest(spark, d):
    return C.latest(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"""SELECT user_id, {', '.join(f"{q4(f'avg(value) FILTER (event_type = {chr(39)}{e}{chr(39)})')} AS {e}" for e in ('click', 'purchase'))} FROM events GROUP BY user_id""")
def pivot_wide_metrics(spark, d):
    return rounded(events(spark, d).groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.avg("value")), "click", "purchase")


# distributions

LO, HI, BINS = 0.0, 200.0, 40
HIST = f"""h AS (SELECT event_type, CAST(least(floor((value - {LO}) / ({HI} - {LO}) * {BINS}), {BINS - 1}) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN {LO} AND {HI} GROUP BY ALL),
hd AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS density FROM h),
gr AS (SELECT e.event_type, b.bin, coalesce(hd.density, 0) AS density FROM (SELECT DISTINCT event_type FROM hd) e CROSS JOIN (SELECT unnest(range({BINS})) AS bin) b LEFT JOIN hd ON hd.event_type = e.event_type AND hd.bin = b.bin),
rf AS (SELECT bin, avg(density) AS reference FROM gr GROUP BY bin)"""


def _hist(spark, d):
    return S.histogram(events(spark, d), ["event_type"], "value", BINS, LO, HI)


@query(f"WITH {HIST} SELECT event_type, CAST(bin AS BIGINT) AS bin, CAST(n AS BIGINT) AS n, {q4('density')} AS density FROM hd")
def histogram(spark, d):
    return big(rounded(_hist(spark, d), "density"))


@query(f"WITH {HIST} SELECT CAST(bin AS BIGINT) AS bin, {q4('reference')} AS reference FROM rf")
def reference_histogram(spark, d):
    return big(rounded(S.reference_histogram(_hist(spark, d), ["event_type"], BINS), "reference"))


@query(f"""WITH {HIST}, g AS (SELECT event_type, abs(sum(density - reference) OVER (PARTITION BY event_type ORDER BY bin)) AS gap FROM gr JOIN rf USING (bin)) SELECT event_type, {q4(f'sum(gap) * {(HI - LO) / BINS}')} AS distance FROM g GROUP BY 1""")
def wasserstein_to_reference(spark, d):
    hist = _hist(spark, d)
    return rounded(S.wasserstein(hist, ["event_type"], S.reference_histogram(hist, ["event_type"], BINS), BINS, (HI - LO) / BINS), "distance")


@query(f"WITH {HIST} SELECT event_type, {q4('-sum(density * log2(density))')} AS entropy FROM hd GROUP BY 1")
def entropy(spark, d):
    return rounded(S.entropy(_hist(spark, d), ["event_type"]), "entropy")


@query(f"""WITH {HIST}, cu AS (SELECT event_type, bin, sum(density) OVER u AS w, sum(density * bin) OVER u AS m, sum(density * bin) OVER (PARTITION BY event_type) AS t FROM gr WINDOW u AS (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING)),
bt AS (SELECT event_type, bin, (t * w - m) * (t * w - m) / (w * (1 - w)) AS b FROM cu WHERE w > 1e-12 AND w < 1 - 1e-12)
SELECT event_type, CAST(bin AS BIGINT) AS threshold_bin FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b DESC, bin) AS r FROM bt) WHERE r = 1""")
def otsu_threshold(spark, d):
    return big(S.otsu(_hist(spark, d), ["event_type"], BINS))


@query(f"""WITH s AS (SELECT l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, least(floor((l_quantity - x0) / (x1 - x0) * 16), 15) AS i, least(floor((l_extendedprice - y0) / (y1 - y0) * 16), 15) AS j, count(*) AS n FROM lineitem JOIN s USING (l_returnflag) GROUP BY ALL),
p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p, sum(n) OVER (PARTITION BY l_returnflag, i) / sum(n) OVER (PARTITION BY l_returnflag) AS px, sum(n) OVER (PARTITION BY l_returnflag, j) / sum(n) OVER (PARTITION BY l_returnflag) AS py FROM c)
SELECT l_returnflag, {q4('2 * sum(p * ln(p / (px * py))) / nullif(-sum(p * ln(px)) - sum(p * ln(py)), 0)')} AS nmi FROM p GROUP BY 1""")
def nmi(spark, d):
    return rounded(S.nmi(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 16), "nmi")


@query(f"""SELECT l_returnflag, {q4('(avg(l_quantity * l_extendedprice) - avg(l_quantity) * avg(l_extendedprice)) / ((stddev_pop(l_quantity) + 1e-8) * (stddev_pop(l_extendedprice) + 1e-8))')} AS ncc FROM lineitem GROUP BY 1""")
def ncc(spark, d):
    return rounded(S.ncc(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "ncc")


# masks


def _masks(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.transform("embedding", lambda x: x > 0).alias("mask"))


MASKS = """mk AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS mask FROM embeddings),
pr AS (SELECT *, lag(vec_id) OVER w AS previous, lag(mask) OVER w AS before, row_number() OVER w - 2 AS pair_index FROM mk WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
ov AS (SELECT *, list_sum(list_transform(list_zip(before, mask), lambda z: CAST(z[1] AND z[2] AS INT))) AS b, list_sum(list_transform(before, lambda z: CAST(z AS INT))) AS na, list_sum(list_transform(mask, lambda z: CAST(z AS INT))) AS nb FROM pr WHERE previous IS NOT NULL)"""


@query(f"""WITH {MASKS} SELECT CAST(label AS BIGINT) AS label, vec_id, previous, CAST(pair_index AS BIGINT) AS pair_index, {q4('2.0 * b / nullif(na + nb, 0)')} AS dice, {q4('b / nullif(na + nb - b, 0)')} AS jaccard, CAST(na AS BIGINT) AS a_voxels, CAST(nb AS BIGINT) AS b_voxels, CAST(b AS BIGINT) AS overlap_voxels FROM ov""")
def dice_pairs(spark, d):
    return big(rounded(L.consecutive_dice(_masks(spark, d), "label", "vec_id", "mask"), "dice", "jaccard"))


def _compared(spark, d):
    rows = _masks(spark, d).withColumn("other", F.transform("embedding", lambda x: x > 0.1))
    return L.compare_masks(rows, ["vec_id"], "mask", "other")


COMPARED = """cm AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS na, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > CAST(0.1 AS DOUBLE))) AS nb FROM embeddings),
cd AS (SELECT *, CASE WHEN na + nb = 0 THEN 0.0 ELSE 2.0 * nb / (na + nb) END AS dice FROM cm)"""


@query(f"""WITH {COMPARED} SELECT vec_id, {q4('dice')} AS dice, {q4('CASE WHEN na + nb = 0 THEN 0.0 ELSE nb / na END')} AS jaccard, {q4('100.0 * abs(nb - na) / nullif(na, 0)')} AS volume_difference_pct, CAST(nb AS BIGINT) AS overlap_voxels, CAST(na - nb AS BIGINT) AS a_only_voxels, CAST(0 AS BIGINT) AS b_only_voxels FROM cd""")
def mask_compare(spark, d):
    return big(rounded(_compared(spark, d), "dice", "jaccard", "volume_difference_pct"))


@query(f"""WITH {COMPARED} SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'{q4(f)} AS {n}' for n, f in (('mean_dice', 'avg(dice)'), ('std_dice', 'stddev_pop(dice)'), ('min_dice', 'min(dice)'), ('max_dice', 'max(dice)'), ('median_dice', 'median(dice)'), ('low_fraction', 'avg(CAST(dice < 0.85 AS INT))')))}, CAST(count(*) FILTER (dice < 0.85) AS BIGINT) AS n_low FROM cd""")
def mask_summary(spark, d):
    return rounded(L.mask_summary(_compared(spark, d)), "mean_dice", "std_dice", "min_dice", "max_dice", "median_dice", "low_fraction")


def _cells(spark, d):
    return L.cells(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding").withColumn("v", F.col("v").cast("double"))


CELLS = "ce AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"""WITH {CELLS}, m AS (SELECT label, count(DISTINCT vec_id) AS m FROM ce GROUP BY 1) SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, CAST(count(*) FILTER (v > 0) AS BIGINT) AS n_votes FROM ce JOIN m USING (label) GROUP BY label, pos, m HAVING count(*) FILTER (v > 0) >= least(30, m)""")
def consensus_vote(spark, d):
    return big(L.consensus(_cells(spark, d), ["label"], "pos", "vec_id", F.col("v") > 0, 30))


@query(f"WITH {CELLS} SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, CAST(count(*) FILTER (v > 0) AS BIGINT) AS n_inside, {q4('avg(v)')} AS mean_value FROM ce GROUP BY label, pos")
def heatmap_counts(spark, d):
    return big(rounded(L.heatmap(_cells(spark, d), ["label"], "pos", F.col("v") > 0, "v"), "mean_value"))


@query(f"""WITH {CELLS} SELECT CAST(label AS BIGINT) AS label, {', '.join(f'{q4(f"avg({e}) FILTER (v > 0)")} AS {n}' for n, e in (('cx', 'pos // 16'), ('cy', '(pos // 4) % 4'), ('cz', 'pos % 4')))}, CAST(count(*) FILTER (v > 0) AS BIGINT) AS n_inside FROM ce GROUP BY label""")
def centroid_by_label(spark, d):
    return big(rounded(L.centroid(_cells(spark, d), ["label"], "pos", F.col("v") > 0, (4, 4, 4)), "cx", "cy", "cz"))


@query(f"""WITH {CELLS}, l AS (SELECT vec_id, CASE WHEN v > 0.15 THEN 3 WHEN v > 0.05 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS k FROM ce)
SELECT vec_id, CAST(count(*) FILTER (k > 0) AS BIGINT) AS total_volume, {', '.join(f'CAST(count(*) FILTER (k = {i}) AS BIGINT) AS volume_{i}, {q4(f"coalesce(count(*) FILTER (k = {i}) / nullif(count(*) FILTER (k > 0), 0), 0)")} AS proportion_{i}' for i in (1, 2, 3))} FROM l GROUP BY vec_id""")
def label_volumes(spark, d):
    v = F.col("v")
    cells = _cells(spark, d).withColumn("k", F.when(v > 0.15, 3).when(v > 0.05, 2).when(v > 0, 1).otherwise(0))
    return rounded(L.volumes(cells, ["vec_id"], "k", (1, 2, 3)), "proportion_1", "proportion_2", "proportion_3")


@query(f"""WITH {CELLS}, s AS (SELECT vec_id, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM ce GROUP BY 1) SELECT vec_id, CAST(pos AS BIGINT) AS pos, {q4('(v - m) / s')} AS z FROM ce JOIN s USING (vec_id)""")
def zscore_normalize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return big(rounded(L.array_cells(L.zscore_values(rows, "e", "z", everywhere=True), ["vec_id"], "z"), "z"))


@query(f"""WITH {CELLS}, s AS (SELECT vec_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM ce WHERE v > 0 GROUP BY 1) SELECT vec_id, CAST(pos AS BIGINT) AS pos, {q4('CASE WHEN v > 0 THEN (v - a) / CASE WHEN a = b THEN 1e-8 ELSE b - a END ELSE 0 END')} AS v FROM ce JOIN s USING (vec_id)""")
def percentile_minmax(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return big(rounded(L.array_cells(L.minmax_values(rows, "e", "v"), ["vec_id"], "v"), "v"))


@query(f"""WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS dd, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT s_nationkey, s_suppkey, (0.5 * greatest(0, least(1, (q - 20) / 10)) + 0.3 * greatest(0, least(1, (dd - 0.04) / 0.02)) + 0.2 * greatest(0, least(1, ln(1 + n) / 5))) / (0.5 + 0.3 + 0.2) AS score FROM m JOIN supplier ON l_suppkey = s_suppkey)
SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey, {q4('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) AS r FROM s) WHERE r = 1""")
def composite_score_rank(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"), F.count("*").cast("double").alias("n"))
    rows = m.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    score = L.composite_score(rows, {"q": (0.5, X.unit_interval(F.col("q"), 20, 30)), "d": (0.3, X.unit_interval(F.col("dd"), 0.04, 0.06)), "n": (0.2, X.unit_interval(F.col("n"), None, None))})
    return big(rounded(L.best_of(rows.withColumn("score", score), ["s_nationkey"], "score", "s_suppkey").select("s_nationkey", "s_suppkey", "score"), "score"))


@query()
def image_measures(spark, d):
    """Stencil measures of embeddings as 4 x 4 x 4 volumes."""
    return images.measure(table(spark, d, "embeddings"), ["vec_id"], F.array(F.lit(4), F.lit(4), F.lit(4)), "embedding", images.MEASURES, cube=1)


@query("""SELECT p_partkey, CAST(p_size * 8 AS BIGINT) AS size, CAST(greatest(240 - p_size * 8, 0) // 2 AS BIGINT) AS pad_before, CAST(greatest(240 - p_size * 8, 0) - greatest(240 - p_size * 8, 0) // 2 AS BIGINT) AS pad_after, CAST(greatest(p_size * 8 - 240, 0) // 2 AS BIGINT) AS crop_before, CAST(greatest(p_size * 8 - 240, 0) - greatest(p_size * 8 - 240, 0) // 2 AS BIGINT) AS crop_after,
CASE WHEN p_size / 10.0 <= 1.0 THEN 'interpolate' WHEN p_size / 10.0 <= 1.2 THEN 'interpolate' WHEN p_size / 10.0 <= 5.0 THEN 'learned' ELSE 'interpolate_then_learned' END AS strategy FROM part""")
def shape_and_spacing(spark, d):
    size = F.col("p_size") * 8
    strategy = F.get(X.spacing_strategy(F.array(F.col("p_size") / 10.0), F.array(F.lit(1.0))), 0)
    return big(table(spark, d, "part").select("p_partkey", size.alias("size"), L.pad_or_crop(size, F.lit(240)).alias("w"), strategy.alias("strategy")).select("p_partkey", "size", *(F.col(f"w.{n}").cast("long").alias(n) for n in ("pad_before", "pad_after", "crop_before", "crop_after")), "strategy"))


# queries of their own modules, which use the helpers above

from tidemark.plans import cohort_queries, file_queries, function_queries, record_queries, volume_queries  # noqa: E402, F401
