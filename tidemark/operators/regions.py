"""Regions of volumes: connected components ranked by size, holes, and the foreground that Otsu's threshold and the components give.

A volume is a row's (shape, data) in row-major order; a batch of rows is worked on at a time and no volume leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Axes along which two cells of a component may differ at once: cells touch by faces, by edges too, or by corners too.
FACES, EDGES, CORNERS = 1, 2, 3
#: Relative difference up to which two variances are equal.
SAME = 1e-12


def touching_cells(mask: np.ndarray, touching: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of each two cells of the mask that touch, each pair once."""
    place = np.arange(mask.size).reshape(mask.shape)
    a, b = [], []
    for step in np.ndindex(*(3,) * mask.ndim):
        step = [s - 1 for s in step]
        if not 0 < sum(map(abs, step)) <= touching or next(s for s in step if s) < 0:
            continue
        here = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(step, mask.shape, strict=True))
        there = tuple(slice(max(0, s), n + min(0, s)) for s, n in zip(step, mask.shape, strict=True))
        both = mask[here] & mask[there]
        a.append(place[here][both])
        b.append(place[there][both])
    return np.concatenate(a), np.concatenate(b)


def components(mask: np.ndarray, touching: int = FACES) -> np.ndarray:
    """For each cell of the mask the flat place of its component's first cell; -1 outside.

    Roots of touching cells hook to the smaller one and paths are halved until nothing changes: rounds grow with the logarithm of the cells, not with a component's length."""
    root = np.arange(mask.size)
    a, b = touching_cells(mask, touching)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return np.where(mask, root.reshape(mask.shape), -1)


def ranked(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, cells) of each component, the largest first; of equal ones the one whose first cell is earlier."""
    first, n = np.unique(of[of >= 0], return_counts=True)
    order = np.lexsort((first, -n))
    return first[order], n[order]


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and all cells from which no way by faces outside of it leads to the border."""
    outside = components(~mask, FACES)
    border = np.ones(mask.shape, bool)
    border[tuple(slice(1, -1) for _ in range(mask.ndim))] = False
    return mask | ((outside >= 0) & ~np.isin(outside, outside[border & (outside >= 0)]))


def grown(mask: np.ndarray, times: int) -> np.ndarray:
    """Dilation by faces."""
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = mask.copy()
        for axis, n in enumerate(mask.shape):
            for shift in (0, 2):
                mask |= p[tuple(slice(shift, shift + n) if a == axis else slice(1, -1) for a in range(mask.ndim))]
    return mask


def shrunk(mask: np.ndarray, times: int) -> np.ndarray:
    """Erosion by faces; what is outside the volume counts as background."""
    for _ in range(times):
        mask = ~grown(np.pad(~mask, 1, constant_values=True), 1)[tuple(slice(1, -1) for _ in range(mask.ndim))]
    return mask


def smoothed(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means along each axis, cut at four deviations, borders mirrored."""
    reach = int(4 * sigma + 0.5)
    if reach == 0:
        return v
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in range(v.ndim):
        p = np.pad(v, [(reach, reach) if a == axis else (0, 0) for a in range(v.ndim)], mode="symmetric")
        v = sum(w * np.take(p, range(k, k + v.shape[axis]), axis=axis) for k, w in enumerate(weight))
    return v


def otsu_cut(v: np.ndarray, bins: int = 256) -> float:
    """The centre of the first bin after which the variance between the two sides is largest; 0.5 without finite values.

    Bins are numbered, so sums are whole; variances within SAME of the largest count as equal to it, as rounding sets equal ones apart."""
    v = v[np.isfinite(v)]
    if not v.size:
        return 0.5
    lo, hi = float(v.min()), float(v.max())
    if lo == hi:
        return lo
    at = np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1).astype(np.int64)
    n = np.bincount(at, minlength=bins)
    w, m = np.cumsum(n)[:-1], np.cumsum(n * np.arange(bins))[:-1]
    gap = m / w - (m[-1] + n[-1] * (bins - 1) - m) / (n.sum() - w)
    apart = w * (n.sum() - w) * gap * gap
    return lo + (int(np.argmax(apart >= apart.max() * (1 - SAME))) + 0.5) * (hi - lo) / bins


@dataclass(frozen=True)
class Foreground:
    """How a foreground is found. Of the components the `keep` largest stay, the first from `least` cells on, others from `relaxed` of that on; if none has so many, the largest."""

    low: float = 1.0
    high: float = 99.0
    sigma: float = 1.0
    touching: int = EDGES
    keep: int = 1
    least: int = 1000
    relaxed: float = 0.1
    grow: int = 0
    shrink: int = 0


def n_kept(sizes: np.ndarray, how: Foreground) -> int:
    """How many of the ranked components stay."""
    if not len(sizes) or sizes[0] < how.least:
        return min(1, len(sizes))
    return 1 + int((sizes[1: how.keep] >= how.least * how.relaxed).sum())


def foreground(v: np.ndarray, how: Foreground = Foreground()) -> tuple[np.ndarray, float | None, int, int]:
    """(mask, threshold, components, cells of holes): what is above Otsu's threshold of the volume scaled between two percentiles and smoothed, its largest components only, holes filled.

    Without a range between the percentiles everything is foreground and there is no threshold."""
    a, b = np.percentile(v, [how.low, how.high]) if v.size else (0.0, 0.0)
    if not b > a:
        return np.ones(v.shape, bool), None, 0, 0
    scaled = smoothed(np.clip((v.astype(float) - a) / (b - a), 0, 1), how.sigma)
    cut = otsu_cut(scaled)
    of = components(scaled > cut, how.touching)
    first, sizes = ranked(of)
    held = np.isin(of, first[: n_kept(sizes, how)]) & (of >= 0)
    whole = filled(held)
    return shrunk(grown(whole, how.grow), how.shrink), float(cut), len(first), int(whole.sum() - held.sum())


def each_volume(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, schema: str, rows_of: Callable[..., list[tuple]], beside: Sequence[Column] = (), given: Sequence[Column] = ()) -> DataFrame:
    """keys and the rows (in the columns of schema) that rows_of gives for each volume; none where the data are null, hold a null or don't fill the shape.

    beside: more arrays for rows_of, each as a volume of the same shape, or None where it is null or doesn't fill it. given: more values of the row for it, as they are."""
    own = volumes.select(*keys, shape.cast("array<int>").alias("__shape"), data.alias("__data"), *(c.alias(f"__beside{i}") for i, c in enumerate([*beside, *given])))
    arrays, more = 1 + len(beside), len(given)
    out_schema = ", ".join([*(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys), schema])
    names = [*keys, *(x.strip().split(" ")[0] for x in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_types(schema)
        for batch in batches:
            rows, source = [], []
            for i in range(batch.num_rows):
                sizes = batch.column(len(keys))[i].as_py()
                own, *others = (filling(batch.column(len(keys) + 1 + c)[i].values, sizes) for c in range(arrays))
                if own is not None:
                    new = rows_of(own, *others, *(batch.column(len(keys) + 1 + arrays + c)[i].as_py() for c in range(more)))
                    rows += new
                    source += [i] * len(new)
            keyed = batch.select(list(range(len(keys)))).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keyed.columns, *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], names)

    return own.mapInArrow(run, out_schema)


def filling(cells: pa.Array | None, sizes: list[int] | None) -> np.ndarray | None:
    """The cells as a volume; None where they are null, hold a null or don't fill the sizes."""
    if sizes is None or cells is None or int(np.prod(sizes)) != len(cells) or cells.null_count:
        return None
    return cells.to_numpy(zero_copy_only=False).reshape(sizes)


def arrow_types(schema: str) -> list[pa.DataType]:
    """Arrow's types of a schema of plain columns and arrays of them."""
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [x.strip().split(" ")[1] for x in schema.split(",")]
    return [pa.list_(plain[k[6:-1]]) if k.startswith("array<") else plain[k] for k in kinds]


def ranked_components(volumes: DataFrame, keys: Sequence[str], shape: Column, mask: Column, touching: int = FACES) -> DataFrame:
    """(keys, component_rank, first_cell, n_cells): a row for each connected component of each mask (array of booleans), ranked from 1 by size, ties by the first cell in row-major order.

    An empty mask has no component; null masks, masks with a null in them and masks that don't fill the shape give no rows."""
    rows = lambda m: [(r, int(f), int(n)) for r, (f, n) in enumerate(zip(*ranked(components(m.astype(bool), touching)), strict=True), 1)]
    return each_volume(volumes, keys, shape, mask, "component_rank long, first_cell long, n_cells long", rows)


def foregrounds(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, how: Foreground = Foreground()) -> DataFrame:
    """(keys, threshold, n_components, hole_cells, foreground_cells, foreground_fraction, mask) of each volume."""

    def rows(v: np.ndarray) -> list[tuple]:
        mask, cut, n, holes = foreground(v.astype(float), how)
        return [(cut, n, holes, int(mask.sum()), float(mask.mean()) if mask.size else None, mask.ravel().tolist())]

    return each_volume(volumes, keys, shape, data, "threshold double, n_components long, hole_cells long, foreground_cells long, foreground_fraction double, mask array<boolean>", rows)


def zeroed(rows: DataFrame, data: str, mask: str, fill: float = 0.0) -> DataFrame:
    """rows with the data outside the mask set to fill."""
    return rows.withColumn(data, F.zip_with(data, mask, lambda v, m: F.when(m, v).otherwise(F.lit(fill))))
