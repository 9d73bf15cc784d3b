"""Queries over names and places of files: layouts, census, files found for what is wanted. Pages are the files, their addresses the paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.matching import find_files
from tidemark.plans.queries import big, query
from tidemark.sources import layouts as Y
from tidemark.sources.tables import table

LAYOUTS = (
    Y.Layout("mobile", "m.{patient}.example.{domain}/{study}/{file}"),
    Y.Layout("blog", "blog.{patient}.example.{domain}/{modality}/{file}", study="0", named="baseline"),
    Y.Layout("web", "www.{patient}.example.{domain}/{study}/{file}"),
)


def _scan(spark, d):
    return Y.scan_layouts(table(spark, d, "pages"), LAYOUTS, {"en": 0, "FR": 1, "de": 2}, ["*[?]*", "*#*"], endings=None, path="url")


SCAN = r"""p AS (SELECT url, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '/(m|blog|www)\.[^/]+\.example\.[^/]+/[^/]+/[^/]+$', 1) AS kind,
 regexp_extract(url, '/(m|blog|www)\.([^/]+)\.example\.[^/]+/[^/]+/[^/]+$', 2) AS who, regexp_extract(url, '/([^/]+)/[^/]+$', 1) AS dir FROM pages),
q AS (SELECT *, CASE WHEN kind = 'blog' THEN '0' WHEN kind <> '' THEN CASE lower(dir) WHEN 'en' THEN '0' WHEN 'fr' THEN '1' WHEN 'de' THEN '2' END END AS number FROM p),
sc AS (SELECT url AS path, name AS filename, left(name, length(name) - length(regexp_extract(url, '(\.nii\.gz|\.[^./]+)?$', 1))) AS sequence, CASE kind WHEN 'm' THEN 'mobile' WHEN 'www' THEN 'web' WHEN 'blog' THEN 'blog' END AS source_type,
 CASE WHEN kind <> '' THEN 'P' || coalesce(nullif(ltrim(regexp_replace(trim(who), '^[pP]', ''), '0'), ''), '0') END AS patient_id,
 CASE WHEN kind = 'blog' THEN 'baseline' WHEN kind <> '' THEN CASE WHEN number IS NULL THEN dir ELSE lower(dir) END END AS study_name, number AS study_number, CASE WHEN kind = 'blog' THEN dir END AS modality,
 CASE WHEN kind = '' THEN 'No known layout' WHEN number IS NULL THEN 'Unknown study directory name ''' || dir || '''' WHEN name LIKE '%?%' THEN 'Matched exclusion pattern: *[?]*' WHEN name LIKE '%#%' THEN 'Matched exclusion pattern: *#*' END AS rejection_reason FROM q)"""


@query(f"WITH {SCAN} SELECT * FROM sc")
def layout_scan(spark, d):
    """Every page by the first layout that its address fits, kept or with a reason."""
    return _scan(spark, d)


@query(f"""WITH {SCAN} SELECT path AS source_path, filename, patient_id, study_name, rejection_reason, source_type, CAST(0 AS BIGINT) AS stage FROM sc WHERE rejection_reason IS NOT NULL""")
def layout_rejects(spark, d):
    return big(Y.rejected(_scan(spark, d)))


@query(f"""WITH {SCAN} SELECT patient_id, study_name, array_to_string(list_sort(list(sequence)), ',') AS sequences, CAST(count(*) AS BIGINT) AS n FROM sc WHERE rejection_reason IS NULL GROUP BY 1, 2""")
def dataset_structure(spark, d):
    return big(Y.dataset_structure(_scan(spark, d)).withColumn("sequences", F.array_join("sequences", ",")))


CENSUS = """e AS (SELECT DISTINCT o_orderkey, unnest(['A', 'N', 'R', 'X']) AS item FROM orders),
h AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS item, min(CASE WHEN l_linenumber < 7 THEN [CAST(l_quantity AS INT), CAST(l_linenumber AS INT)] END) AS shape FROM lineitem GROUP BY 1, 2),
cs AS (SELECT o_orderkey, item, CASE WHEN h.item IS NULL THEN 'MISSING' WHEN shape IS NULL THEN 'BROKEN' ELSE 'OK' END AS status, array_to_string(shape, 'x') AS shape FROM e LEFT JOIN h USING (o_orderkey, item))"""


def _census(spark, d):
    """Orders as studies, return flags as their items; lines from the seventh on have no shape."""
    shape = F.when(F.col("l_linenumber") < 7, F.array(F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("item"), shape.alias("shape"))
    return Y.shape_census(table(spark, d, "orders"), files, ("A", "N", "R", "X"), ["o_orderkey"], "item", "shape")


@query(f"WITH {CENSUS} SELECT * FROM cs")
def shape_census(spark, d):
    return _census(spark, d).withColumn("shape", F.array_join("shape", "x"))


@query(f"WITH {CENSUS} SELECT item, status, shape, CAST(count(*) AS BIGINT) AS n FROM cs GROUP BY ALL")
def census_summary(spark, d):
    return big(Y.census_summary(_census(spark, d), "item"))


NAMES = {"th": ["th", "www.th", "blog.th"], "the": ["the", "thethe", "www.the", "m.THE", "blog.the"], "tion": ["tion", "blog.tion", "www.tionbl"], "exact": ["therin.example.net", "blog.tionsh.example.net", "ther"]}
#: Which category a document wants, by its number.
WANTED = ("th", "the", "tion", "exact", "none")


@query(f"""WITH n(c, place, name) AS (VALUES {', '.join(f"('{c}', {i}, '{x}')" for c, g in NAMES.items() for i, x in enumerate(g))}),
f AS (SELECT url AS path, regexp_extract(url, '//([^/]*)/', 1) AS stem, regexp_extract(url, '//[^/]*/([^/]*)/', 1) AS folder, string_split(url, '/') AS parts FROM pages),
m AS (SELECT path, folder, parts, c, 0 AS kind, place FROM f JOIN n ON stem = name UNION ALL
 SELECT path, folder, parts, n.c, 1, -length(n.name) FROM f JOIN n ON starts_with(lower(stem), lower(n.name))
 WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.c <> n.c AND length(o.name) > length(n.name) AND starts_with(lower(stem), lower(o.name)))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder, c ORDER BY kind, place, path) AS r FROM m) WHERE r = 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, c ORDER BY kind, place, path) AS r FROM (SELECT path, c, kind, place, unnest(list_distinct(parts)) AS part FROM m)) WHERE r = 1),
w AS (SELECT doc_id, lang, [{', '.join(f"'{c}'" for c in WANTED)}][CAST(doc_id % 5 AS INT) + 1] AS c, CAST(doc_id % 1000 AS VARCHAR) AS id FROM documents)
SELECT doc_id, coalesce(b1.path, b2.path, a.path) AS path, CAST(CASE WHEN b1.path IS NOT NULL THEN b1.kind WHEN b2.path IS NOT NULL THEN b2.kind ELSE a.kind END AS BIGINT) AS kind,
 CAST(CASE WHEN b1.path IS NOT NULL THEN 0 WHEN b2.path IS NOT NULL THEN 1 WHEN a.path IS NOT NULL THEN -1 END AS BIGINT) AS place
FROM w LEFT JOIN b b1 ON b1.folder = lang AND b1.c = w.c LEFT JOIN b b2 ON b2.folder = 'fr' AND b2.c = w.c LEFT JOIN a ON a.part = id AND a.c = w.c""")
def fuzzy_file_match(spark, d):
    """For each document a page of a wanted kind of host: in its language, else in French, else anywhere with its number in the address."""
    files = table(spark, d, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", "//([^/]*)/", 1).alias("stem"), F.regexp_extract("url", "//[^/]*/([^/]*)/", 1).alias("folder"), F.split("url", "/").alias("parts"))
    wanted = table(spark, d, "documents").select(
        "doc_id", F.array("lang", F.lit("fr")).alias("folders"), F.get(F.array(*map(F.lit, WANTED)), (F.col("doc_id") % 5).cast("int")).alias("category"), F.array((F.col("doc_id") % 1000).cast("string")).alias("ids"))
    return big(find_files(wanted, files, NAMES, "doc_id", "folders", "category", ids="ids", parts="parts"))
