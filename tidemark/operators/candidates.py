"""What makes a volume a good reference: signal, contrast, sharp borders, coverage, sharpness and freedom from ghosts, and the choice between candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from .images import boundary_ratio, sobel
from .regions import each_volume, shrunk

METRICS = ("snr_foreground", "cnr_high_low", "boundary_gradient_score", "brain_coverage_fraction", "laplacian_sharpness", "ghosting_score")
SMALL = 1e-8


@dataclass(frozen=True)
class Depths:
    """The cells that a measure of a region needs more than, those of its parts, and how many layers of cells are a border and a shell."""

    cells: int = 100
    part: int = 10
    border: int = 2
    shell: int = 5


def laplacian(v: np.ndarray) -> np.ndarray:
    """Sum of the second differences along the axes, the border's cells repeated."""
    out = np.zeros(v.shape)
    for axis in range(v.ndim):
        p = np.pad(v, [(1, 1) if a == axis else (0, 0) for a in range(v.ndim)], mode="edge")
        out += np.take(p, range(v.shape[axis]), axis) - 2 * v + np.take(p, range(2, v.shape[axis] + 2), axis)
    return out


def variation(v: np.ndarray) -> float:
    return float(v.std() / (v.mean() + SMALL))


def metrics_of(v: np.ndarray, mask: np.ndarray | None, depths: Depths) -> tuple:
    """METRICS of a volume, null where there is too little of it. Without a mask (of the brain) what is above zero stands for it, but for the coverage."""
    above = v > 0
    if not above.any():
        return (None,) * len(METRICS)
    own, snr, cnr = v[above], None, None
    if own.size > depths.cells:
        a, mid, b = np.percentile(own, [25, 50, 75])
        middle, low, high = own[(own >= a) & (own <= b)], own[own < mid], own[own >= mid]
        if middle.size > depths.part:
            snr = float(middle.mean() / (middle.std() + SMALL) * math.sqrt(2 / (4 - math.pi)))
        pooled = math.sqrt(low.var() + high.var()) if min(low.size, high.size) > depths.part else 0.0
        if pooled > SMALL:
            cnr = float(abs(high.mean() - low.mean()) / pooled)
    border = above & ~shrunk(above, depths.border)
    region = above if mask is None else mask.astype(bool)
    curved = laplacian(v)[region]
    core = shrunk(region, depths.shell)
    shell = region & ~core
    ghost = 1 - variation(v[shell]) / (variation(v[core]) + SMALL) if core.any() and shell.any() else None
    return (snr, cnr, float(sobel(v)[border].mean()) if border.any() else 0.0, None if mask is None else float(region.mean()), float(curved.var()) if curved.size >= depths.cells else None, ghost)


def candidate_metrics(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, mask: Column | None = None, depths: Depths = Depths()) -> DataFrame:
    """(keys, METRICS) of each volume; mask: an array of booleans beside the data, for a row without one as if none were given. Null data and data that don't fill the shape give no row."""
    rows = lambda v, m=None: [metrics_of(v.astype(float), m, depths)]
    return each_volume(volumes, keys, shape, data, ", ".join(f"{m} double" for m in METRICS), rows, [] if mask is None else [mask])


def mask_plausibility(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, mask: Column, spacing: Column) -> DataFrame:
    """(keys, mask_volume_cc, boundary_gradient_score) of a mask (array of booleans) on a volume, cells being `spacing` (array, in mm) apart: the mean gradient on the mask's border over that inside, 0 where either is empty or the inside is flat.

    Rows without data, a mask or a spacing an axis give no row."""

    def rows(v: np.ndarray, m: np.ndarray | None, apart: list[float] | None) -> list[tuple]:
        if m is None or not apart or len(apart) != v.ndim or None in apart:
            return []
        return [(float(m.sum() * np.prod(apart) / 1000), boundary_ratio(v.astype(float), m.astype(bool)))]

    return each_volume(volumes, keys, shape, data, "mask_volume_cc double, boundary_gradient_score double", rows, [mask], [spacing])
