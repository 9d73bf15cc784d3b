"""Queries over embeddings as volumes of 4 x 4 x 4 cells, each with SQL that says the same from the cells."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import candidates, fields
from tidemark.operators import grids as G
from tidemark.operators import longitudinal as L
from tidemark.operators import regions as R
from tidemark.functions.expressions import unit_interval
from tidemark.plans.queries import big, q4, query, rounded
from tidemark.sources import nifti
from tidemark.sources.tables import table


def shape():
    return F.array(F.lit(4), F.lit(4), F.lit(4))


def volumes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


#: Cells with their coordinates, and each two places of the grid with the axes along which they are neighbours.
GRID = """ce AS (SELECT vec_id, CAST(p AS INT) AS p, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p)),
nb AS (SELECT CAST(a.p AS INT) AS a, CAST(b.p AS INT) AS b, abs(a.p // 16 - b.p // 16) + abs(a.p // 4 % 4 - b.p // 4 % 4) + abs(a.p % 4 - b.p % 4) AS axes FROM range(64) a(p), range(64) b(p)
 WHERE greatest(abs(a.p // 16 - b.p // 16), abs(a.p // 4 % 4 - b.p // 4 % 4), abs(a.p % 4 - b.p % 4)) = 1)"""
#: Components of the cells of in_mask (vec_id, p), cells touching along `axes` at most: (vec_id, p, first).
REACH = """{name}_r AS (SELECT vec_id, p AS first, p FROM {mask} UNION SELECT r.vec_id, r.first, nb.b FROM {name}_r r JOIN nb ON nb.a = r.p AND nb.axes <= {axes} JOIN {mask} m ON m.vec_id = r.vec_id AND m.p = nb.b AND nb.b > r.first),
{name} AS (SELECT vec_id, p, min(first) AS first FROM {name}_r GROUP BY 1, 2)"""
RANKED = "{name}_k AS (SELECT vec_id, first, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, first) AS r FROM {name} GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {GRID}, m AS (SELECT vec_id, p FROM ce WHERE v > 0.05), {REACH.format(name='c', mask='m', axes=2)}, {RANKED.format(name='c')}
SELECT vec_id, CAST(r AS BIGINT) AS component_rank, CAST(first AS BIGINT) AS first_cell, CAST(n AS BIGINT) AS n_cells FROM c_k""")
def component_ranks(spark, d):
    """All components of what is above a threshold, touching by faces and edges, by rank."""
    return R.ranked_components(volumes(spark, d), ["vec_id"], shape(), F.transform("v", lambda x: x > 0.05), R.EDGES)


@query(f"""WITH RECURSIVE {GRID}, l AS (SELECT vec_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM ce GROUP BY 1),
s AS (SELECT vec_id, p, least(greatest((v - a) / (b - a), 0.0), 1.0) AS x FROM ce JOIN l USING (vec_id)),
i AS (SELECT vec_id, p, x, least(floor(x * 256), 255) AS bin FROM s),
o AS (SELECT vec_id, bin, count(*) AS n FROM i GROUP BY 1, 2),
u AS (SELECT vec_id, bin, sum(n) OVER y AS w, sum(n * bin) OVER y AS m, sum(n * bin) OVER (PARTITION BY vec_id) AS t FROM o WINDOW y AS (PARTITION BY vec_id ORDER BY bin)),
h AS (SELECT vec_id, bin, w * (64 - w) * (m / w - (t - m) / (64 - w)) * (m / w - (t - m) / (64 - w)) AS between FROM u WHERE w < 64),
cut AS (SELECT vec_id, (min(bin) + 0.5) / 256 AS cut FROM (SELECT *, max(between) OVER (PARTITION BY vec_id) AS top FROM h) WHERE between >= top * (1 - 1e-12) GROUP BY 1),
m AS (SELECT vec_id, p FROM s JOIN cut USING (vec_id) WHERE x > cut), {REACH.format(name='c', mask='m', axes=2)}, {RANKED.format(name='c')},
kept AS (SELECT c.vec_id, c.p FROM c JOIN c_k k ON k.vec_id = c.vec_id AND k.first = c.first JOIN c_k b ON b.vec_id = c.vec_id AND b.r = 1 WHERE k.r = 1 OR (k.r = 2 AND k.n >= 2 AND b.n >= 20)),
g AS (SELECT ce.vec_id, ce.p FROM ce LEFT JOIN kept k ON k.vec_id = ce.vec_id AND k.p = ce.p WHERE k.p IS NULL), {REACH.format(name='e', mask='g', axes=1)},
open AS (SELECT DISTINCT vec_id, first FROM e WHERE p // 16 IN (0, 3) OR p // 4 % 4 IN (0, 3) OR p % 4 IN (0, 3)),
hole AS (SELECT e.vec_id, count(*) AS n FROM e LEFT JOIN open o ON o.vec_id = e.vec_id AND o.first = e.first WHERE o.first IS NULL GROUP BY 1)
SELECT cut.vec_id, {q4('cut')} AS threshold, CAST((SELECT count(*) FROM c_k k WHERE k.vec_id = cut.vec_id) AS BIGINT) AS n_components, CAST(coalesce(hole.n, 0) AS BIGINT) AS hole_cells,
 CAST((SELECT count(*) FROM kept k WHERE k.vec_id = cut.vec_id) + coalesce(hole.n, 0) AS BIGINT) AS foreground_cells FROM cut LEFT JOIN hole USING (vec_id)""")
def otsu_foreground(spark, d):
    """The foreground of each volume: Otsu's threshold, its two largest components, holes filled."""
    how = R.Foreground(sigma=0.0, keep=2, least=20, relaxed=0.1)
    found = R.foregrounds(volumes(spark, d), ["vec_id"], shape(), F.col("v"), how)
    return rounded(found.select("vec_id", "threshold", "n_components", "hole_cells", "foreground_cells"), "threshold")


def _slope(axis: str, step: int) -> str:
    """The difference of w along an axis of the grid, one-sided at the border."""
    return f"CASE {axis} WHEN 0 THEN w[p + {step + 1}] - w[p + 1] WHEN 3 THEN w[p + 1] - w[p - {step - 1}] ELSE (w[p + {step + 1}] - w[p - {step - 1}]) / 2 END"


FIELD = f"""e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 5) AS e FROM embeddings),
f AS (SELECT vec_id, i, CASE i WHEN 1 THEN e WHEN 2 THEN list_reverse(e) ELSE e[33:64] || e[1:32] END AS w FROM e, range(1, 4) r(i)),
d AS (SELECT vec_id, i, p, {_slope('p // 16', 16)} AS x, {_slope('p // 4 % 4', 4)} AS y, {_slope('p % 4', 1)} AS z FROM f, range(64) r(p)),
j AS (SELECT a.vec_id, (a.x + 1) * ((b.y + 1) * (c.z + 1) - b.z * c.y) - a.y * (b.x * (c.z + 1) - b.z * c.x) + a.z * (b.x * c.y - (b.y + 1) * c.x) AS det
 FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.p = b.p AND a.i = 1 AND b.i = 2 JOIN d c ON a.vec_id = c.vec_id AND a.p = c.p AND c.i = 3),
s AS (SELECT vec_id, avg(det) AS det_mean, stddev_pop(det) AS det_std, avg(ln(det)) FILTER (det > 0) AS log_det_mean, stddev_pop(ln(det)) FILTER (det > 0) AS log_det_std, avg(CAST(det < 0 AS INT)) AS negative_fraction, min(det) AS det_min, max(det) AS det_max FROM j GROUP BY 1)"""


@query(f"""WITH {FIELD.replace("ln(det)", "ln(CASE WHEN det > 0 THEN det END)")} SELECT vec_id, {', '.join(f'{q4(c)} AS {c}' for c in fields.STATISTICS)},
 CASE WHEN negative_fraction > 0.01 THEN 'Folding' WHEN abs(log_det_mean) > 0.5 THEN 'Large mean deformation' WHEN det_min < 0.1 THEN 'Extreme local contraction' WHEN det_max > 10 THEN 'Extreme local expansion' END AS reason FROM s""")
def field_jacobian(spark, d):
    """Each embedding five times over, its reverse and its halves exchanged, as displacements along three axes."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 5).alias("e"))
    u = F.concat("e", F.reverse("e"), F.slice("e", 33, 32), F.slice("e", 1, 32))
    found = fields.field_statistics(e, ["vec_id"], shape(), u)
    return rounded(found.withColumn("reason", fields.implausible()), *fields.STATISTICS)


@query(f"""WITH m AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE) * 10) AS m FROM embeddings),
d AS (SELECT vec_id, m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7]) + m[3] * (m[4] * m[8] - m[5] * m[7]) AS det FROM m)
SELECT vec_id, {q4('det')} AS det_mean, {q4('CASE WHEN det > 0 THEN ln(det) ELSE 0 END')} AS log_det_mean, CASE WHEN det < 0 THEN 'Folding' WHEN det > 0 AND abs(ln(det)) > 0.5 THEN 'Large mean deformation' WHEN det < 0.1 THEN 'Extreme local contraction' END AS reason FROM d""".replace("det > 0 AND abs(ln(det)) > 0.5", "CASE WHEN det > 0 THEN abs(ln(det)) > 0.5 END"))
def affine_jacobian(spark, d):
    """The first nine numbers of each embedding, ten times over, as the rows of an affine map."""
    m = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 10).alias("m"))
    found = fields.affine_statistics(m, "m").withColumn("reason", fields.implausible())
    return rounded(found.select("vec_id", "det_mean", "log_det_mean", "reason"), "det_mean", "log_det_mean")


#: Each cell with its neighbours, those over the border taken from the border: differences, Sobel's gradient, and how many of the six are inside the grid and above zero, or in the region.
CANDIDATES = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, vec_id % 2 = 0 AS masked FROM embeddings),
c AS (SELECT vec_id, label, masked, e, CAST(p // 16 AS INT) AS x, CAST(p // 4 % 4 AS INT) AS y, CAST(p % 4 AS INT) AS z, e[p + 1] AS v, e[p + 1] > 0 AS a, CASE WHEN masked THEN e[p + 1] > -0.1 ELSE e[p + 1] > 0 END AS g, CASE WHEN masked THEN e[p + 1] > -0.1 END AS m, p FROM e, range(64) r(p)),
o AS (SELECT dx, dy, dz FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dz)),
n AS (SELECT vec_id, p, dx, dy, dz, e[greatest(0, least(3, x + dx)) * 16 + greatest(0, least(3, y + dy)) * 4 + greatest(0, least(3, z + dz)) + 1] AS w,
 x + dx BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND z + dz BETWEEN 0 AND 3 AS inside, masked FROM c, o),
k AS (SELECT vec_id, p, sum(dx * (2 - abs(dy)) * (2 - abs(dz)) * w) AS sx, sum(dy * (2 - abs(dx)) * (2 - abs(dz)) * w) AS sy, sum(dz * (2 - abs(dx)) * (2 - abs(dy)) * w) AS sz,
 sum(CASE abs(dx) + abs(dy) + abs(dz) WHEN 1 THEN w WHEN 0 THEN -6 * w ELSE 0 END) AS lap,
 count(*) FILTER (abs(dx) + abs(dy) + abs(dz) = 1 AND inside AND w > 0) = 6 AS a6, count(*) FILTER (abs(dx) + abs(dy) + abs(dz) = 1 AND inside AND w > CASE WHEN masked THEN -0.1 ELSE 0 END) = 6 AS g6 FROM n GROUP BY 1, 2),
q AS (SELECT vec_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM c WHERE a GROUP BY 1),
s AS (SELECT c.vec_id, any_value(label) AS label, CASE WHEN max(n) > 8 AND count(*) FILTER (a AND v BETWEEN q1 AND q3) > 2 THEN avg(v) FILTER (a AND v BETWEEN q1 AND q3) / (stddev_pop(v) FILTER (a AND v BETWEEN q1 AND q3) + 1e-8) * sqrt(2 / (4 - pi())) END AS snr_foreground,
 CASE WHEN max(n) > 8 AND count(*) FILTER (a AND v < q2) > 2 AND count(*) FILTER (a AND v >= q2) > 2 THEN abs(avg(v) FILTER (a AND v >= q2) - avg(v) FILTER (a AND v < q2)) / sqrt(var_pop(v) FILTER (a AND v < q2) + var_pop(v) FILTER (a AND v >= q2)) END AS cnr_high_low,
 coalesce(avg(sqrt(sx * sx + sy * sy + sz * sz)) FILTER (a AND NOT a6), 0) AS boundary_gradient_score, avg(CAST(m AS INT)) AS brain_coverage_fraction,
 CASE WHEN count(*) FILTER (g) >= 8 THEN var_pop(lap) FILTER (g) END AS laplacian_sharpness,
 1 - stddev_pop(v) FILTER (g AND NOT g6) / (avg(v) FILTER (g AND NOT g6) + 1e-8) / (stddev_pop(v) FILTER (g AND g6) / (avg(v) FILTER (g AND g6) + 1e-8) + 1e-8) AS ghosting_score
 FROM c JOIN k USING (vec_id, p) JOIN q USING (vec_id) GROUP BY 1)"""


def _candidates(spark, d):
    rows = volumes(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    mask = F.when(F.col("vec_id") % 2 == 0, F.transform("v", lambda x: x > -0.1))
    return candidates.candidate_metrics(rows, ["vec_id", "label"], shape(), F.col("v"), mask, candidates.Depths(cells=8, part=2, border=1, shell=1))


@query(f"WITH {CANDIDATES} SELECT vec_id, CAST(label AS BIGINT) AS label, {', '.join(f'{q4(m)} AS {m}' for m in candidates.METRICS)} FROM s")
def candidate_metrics(spark, d):
    """Each embedding as a candidate's volume; every second one with a mask beside it."""
    return big(rounded(_candidates(spark, d), *candidates.METRICS))


@query(f"WITH {CANDIDATES} SELECT CAST(label AS BIGINT) AS label, {', '.join(f'{q4(f"arg_min({m}, vec_id)")} AS {m}' for m in candidates.METRICS)} FROM s GROUP BY 1")
def first_supplied_metrics(spark, d):
    """Of each label's candidates the first that has the metric."""
    return big(rounded(L.first_supplied(_candidates(spark, d), ["label"], "vec_id", candidates.METRICS), *candidates.METRICS))


@query(f"""WITH {CANDIDATES}, w AS (SELECT vec_id, label, (coalesce(0.4 * least(1, greatest(0, snr_foreground / 6)), 0) + coalesce(0.4 * least(1, greatest(0, (cnr_high_low - 1) / 2)), 0) + coalesce(0.2 * brain_coverage_fraction, 0))
 / (CASE WHEN snr_foreground IS NULL THEN 0 ELSE 0.4 END + CASE WHEN cnr_high_low IS NULL THEN 0 ELSE 0.4 END + CASE WHEN brain_coverage_fraction IS NULL THEN 0 ELSE 0.2 END) AS score FROM s)
SELECT CAST(label AS BIGINT) AS label, vec_id, {q4('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS r FROM w) WHERE r = 1""")
def reference_candidate(spark, d):
    """The best candidate of each label by a weighted mean of the metrics that it has."""
    rows = _candidates(spark, d)
    score = L.composite_score(rows, {"snr": (0.4, unit_interval(F.col("snr_foreground"), 0, 6)), "cnr": (0.4, unit_interval(F.col("cnr_high_low"), 1, 3)), "cover": (0.2, F.col("brain_coverage_fraction"))})
    return big(rounded(L.best_of(rows.withColumn("score", score), ["label"], "score", "vec_id").select("label", "vec_id", "score"), "score"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT vec_id, x * 8 + y * 4 + z AS pos, e[CAST(x * 32 + y * 8 + z + 1 AS INT)] AS near, x, y, z, e FROM e, range(2) a(x), range(2) b(y), range(4) c(z))
SELECT vec_id, CAST(1.5 AS DOUBLE) AS factor, CAST(pos AS BIGINT) AS pos, {q4('((e[CAST(x * 16 + y * 4 + z + 1 AS INT)] + e[CAST(x * 32 + y * 4 + z + 1 AS INT)]) / 2 + (e[CAST(x * 16 + y * 8 + z + 1 AS INT)] + e[CAST(x * 32 + y * 8 + z + 1 AS INT)]) / 2) / 2')} AS v, near > 0 AS inside FROM c""")
def qc_downsample(spark, d):
    """Volumes of cells 1 x 1 x 1.5 apart on a grid 1.5 apart, with the cells above zero as a mask: two, two and four cells."""
    found = G.downsampled(volumes(spark, d), ["vec_id"], shape(), F.col("v"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.5)), F.transform("v", lambda x: x > 0), 1.5, 20)
    cells = found.select("vec_id", "factor", F.posexplode(F.arrays_zip("data", "mask")).alias("pos", "c"))
    return big(rounded(cells.select("vec_id", "factor", "pos", F.col("c.data").alias("v"), F.col("c.mask").alias("inside")), "v"))


FIT = """ce AS (SELECT vec_id, CAST(embedding[x * 16 + y * 4 + z + 1] AS DOUBLE) AS v, x, y, z FROM embeddings, range(4) a(x), range(4) b(y), range(4) c(z)),
gr AS (SELECT vec_id, x, y, z, x * 12 + y * 4 + z AS pos FROM embeddings, range(7) a(x), range(3) b(y), range(4) c(z)),
ft AS (SELECT gr.vec_id, gr.pos, gr.x, gr.y, gr.z, coalesce(v, 0) AS v FROM gr LEFT JOIN ce ON ce.vec_id = gr.vec_id AND ce.x = gr.x - 1 AND ce.y = gr.y AND ce.z = gr.z)"""


@query(f"WITH {FIT} SELECT vec_id, CAST(pos AS BIGINT) AS pos, {q4('v')} AS v, '4,4,4' AS fitted_from, '-1,0,0' AS moved FROM ft")
def shape_fit(spark, d):
    """Volumes at seven by three by four cells: padded, cropped, as they were."""
    found = G.fitted(volumes(spark, d), ["vec_id"], shape(), F.col("v"), (7, 3, 4))
    return big(rounded(found.select("vec_id", F.posexplode("data").alias("pos", "v"), F.array_join("fitted_from", ",").alias("fitted_from"), F.array_join("moved", ",").alias("moved")), "v"))


@query(f"WITH {FIT} SELECT ce.vec_id, CAST(x * 16 + y * 4 + z AS BIGINT) AS pos, {q4('CASE WHEN y < 3 THEN v ELSE 0 END')} AS v FROM ce")
def shape_restore(spark, d):
    """The same back again: what was cropped is 0, all else as before."""
    found = G.restored(G.fitted(volumes(spark, d), ["vec_id"], shape(), F.col("v"), (7, 3, 4)), ["vec_id"], (7, 3, 4))
    return big(rounded(found.select("vec_id", F.posexplode("data").alias("pos", "v")), "v"))


@query(f"""WITH {GRID} SELECT vec_id, CAST(p AS BIGINT) AS pos, {q4('v')} AS v FROM ce""")
def nifti_round_trip(spark, d):
    """Embeddings as files of all 48 orientations, read back to the first one."""
    ends = ["".join(e) for order in permutations(G.ENDS) for e in product(*order)]

    def write(batches):
        for batch in batches:
            ids, files = batch.column(0), []
            for i in range(batch.num_rows):
                v = batch.column(1)[i].values.to_numpy().reshape(4, 4, 4)
                turned, affine = G.oriented(v, np.diag([1.0, 2.0, 0.5, 1.0]), ends[ids[i].as_py() % 48])
                files.append(nifti.write(turned, affine, packed=i % 2 == 1))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    found = nifti.parsed(volumes(spark, d).mapInArrow(write, "path string, content binary"))
    return big(rounded(found.select(F.col("path").cast("long").alias("vec_id"), F.posexplode("data").alias("pos", "v")), "v"))


@query(f"""WITH {CANDIDATES} SELECT c.vec_id, {q4('count(*) FILTER (a) * 1.0 * 1.5 * 200 / 1000')} AS mask_volume_cc,
 {q4('coalesce(avg(sqrt(sx * sx + sy * sy + sz * sz)) FILTER (a AND NOT a6) / nullif(avg(sqrt(sx * sx + sy * sy + sz * sz)) FILTER (a AND a6), 0), 0)')} AS boundary_gradient_score FROM c JOIN k USING (vec_id, p) GROUP BY 1""")
def mask_plausibility(spark, d):
    """The cells above zero as a mask: its volume, and how much sharper its border is than its inside."""
    found = candidates.mask_plausibility(volumes(spark, d), ["vec_id"], shape(), F.col("v"), F.transform("v", lambda x: x > 0), F.array(F.lit(1.0), F.lit(1.5), F.lit(200.0)))
    return rounded(found, "mask_volume_cc", "boundary_gradient_score")
