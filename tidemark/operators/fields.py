"""Local volume change of displacement fields and affine maps: determinants, their statistics and a verdict by bounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import each_volume

STATISTICS = ("det_mean", "det_std", "log_det_mean", "log_det_std", "negative_fraction", "det_min", "det_max")

#: Bounds of a plausible map. Share of folded cells, mean logarithm either way, least and largest determinant.
MOST_FOLDED, MOST_LOG, LEAST_DET, MOST_DET = 0.01, 0.5, 0.1, 10.0


def determinants(field: np.ndarray, spacing: Sequence[float]) -> np.ndarray:
    """The determinant of the Jacobian of x + u(x) at each cell, for a field (axis, ...) of displacements in the units of spacing.

    Differences are central, one-sided at the borders; along an axis of one cell nothing changes."""
    n = field.shape[0]
    jacobian = np.zeros((*field.shape[1:], n, n))
    for i in range(n):
        for j in range(n):
            if field.shape[1 + j] > 1:
                jacobian[..., i, j] = np.gradient(field[i], spacing[j], axis=j)
        jacobian[..., i, i] += 1
    return np.linalg.det(jacobian)


def summary(det: np.ndarray) -> tuple:
    """STATISTICS of the cells where anything changes (all, if none does): a determinant of exactly 0 or 1 is taken for background. Logarithms are of positive ones, null without any."""
    det = det.ravel()
    moved = det[(det != 0) & (det != 1)]
    det = moved if moved.size else det
    if not det.size:
        return (None,) * len(STATISTICS)
    log = np.log(det[det > 0])
    return (float(det.mean()), float(det.std()), *((float(log.mean()), float(log.std())) if log.size else (None, None)), float((det < 0).mean()), float(det.min()), float(det.max()))


def field_statistics(fields: DataFrame, keys: Sequence[str], shape: Column, displacement: Column, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, STATISTICS) of each displacement field: an array of all cells' displacements along the first axis, then along the next.

    shape is that of the grid. Null fields and those that don't fill it give no row; a field is worked on where it is."""
    whole = F.concat(F.array(F.size(shape)), shape)
    return each_volume(fields, keys, whole, displacement, ", ".join(f"{s} double" for s in STATISTICS), lambda u: [summary(determinants(u.astype(float), spacing))])


def affine_determinant(m: Column) -> Column:
    """The determinant of the 3 x 3 part of an affine map, an array of nine or more numbers whose first nine are its rows; null with fewer."""
    a = [F.get(m, i) for i in range(9)]
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def affine_statistics(rows: DataFrame, matrix: str) -> DataFrame:
    """rows with STATISTICS of an affine map, whose determinant is the same everywhere; the logarithm of one that isn't positive counts as 0."""
    det = affine_determinant(F.col(matrix).cast("array<double>"))
    log = F.when(det > 0, F.log(det)).when(det.isNotNull(), 0.0)
    none = F.when(det.isNotNull(), 0.0)
    return rows.withColumns(dict(zip(STATISTICS, (det, none, log, none, F.when(det < 0, 1.0).otherwise(none), det, det), strict=True)))


def implausible(most_log: float = MOST_LOG, most_folded: float = MOST_FOLDED, least: float = LEAST_DET, most: float = MOST_DET) -> Column:
    """Why a map with these STATISTICS is rejected, the first reason that holds; null if it is plausible."""
    return (
        F.when(F.col("det_mean").isNull(), "No determinant")
        .when(F.col("negative_fraction") > most_folded, "Folding")
        .when(F.abs("log_det_mean") > most_log, "Large mean deformation")
        .when(F.col("det_min") < least, "Extreme local contraction")
        .when(F.col("det_max") > most, "Extreme local expansion"))
