"""Volumes as arrays: stencils, components and geometry in numpy, a batch of rows at a time.

A volume is (shape array<int>, data array<float>) in row-major order; each row is worked on by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import Check


def sobel(v: np.ndarray) -> np.ndarray:
    """Gradient magnitude by the separable Sobel stencil with reflected borders."""
    total = np.zeros(v.shape)
    for axis in range(v.ndim):
        g = v.astype(float)
        for other in range(v.ndim):
            p = np.pad(g, [(1, 1) if a == other else (0, 0) for a in range(v.ndim)], mode="symmetric")
            at = lambda k: np.take(p, range(k, k + g.shape[other]), axis=other)  # noqa: B023, E731
            g = at(2) - at(0) if other == axis else at(0) + 2 * at(1) + at(2)
        total += g * g
    return np.sqrt(total)


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Erosion by faces; what is outside counts as background."""
    for _ in range(times):
        p = np.pad(mask, 1)
        inner = tuple(slice(1, -1) for _ in range(mask.ndim))
        out = p[inner].copy()
        for axis in range(mask.ndim):
            for shift in (0, 2):
                out &= p[tuple(slice(shift, shift + n) if a == axis else slice(1, -1) for a, n in enumerate(mask.shape))]
        mask = out
    return mask


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest set of cells that touch by faces; the first in row-major order of equal ones."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # each cell takes the smallest label around it, until none changes
        big = np.where(label > 0, label, mask.size + 2)
        new = big.copy()
        for axis in range(mask.ndim):
            a = [slice(None)] * mask.ndim
            b = [slice(None)] * mask.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            new[tuple(a)] = np.minimum(new[tuple(a)], big[tuple(b)])
            new[tuple(b)] = np.minimum(new[tuple(b)], big[tuple(a)])
        new = np.where(mask, new, 0)
        root = new.ravel()[np.maximum(new.ravel() - 1, 0)].reshape(mask.shape)  # and the label of that cell
        new = np.where(mask, np.minimum(new, np.where(root > 0, root, new)), 0)
        if (new == label).all():
            break
        label = new
    if not mask.any():
        return mask
    names, n = np.unique(label[label > 0], return_counts=True)
    return label == names[n.argmax()]


def gradient_entropy(v: np.ndarray, bins: int = 256) -> float:
    g = sobel(v)
    g = g[g > 0]
    if not len(g):
        return 0.0
    n = np.histogram(g, bins)[0]
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def corners(v: np.ndarray, cube: int) -> np.ndarray | None:
    """The cells of the cubes in all corners; none where an axis has no room for two."""
    if min(v.shape, default=0) < 2 * cube:
        return None
    return np.concatenate([v[tuple(slice(None, cube) if s else slice(-cube, None) for s in sides)].ravel() for sides in np.ndindex(*(2,) * v.ndim)])


def background_ratio(v: np.ndarray) -> float:
    """Mean above the tenth percentile of the positive values over the deviation of the rest; infinite without noise, 0 without either side."""
    cut = np.percentile(v[v > 0], 10) if (v > 0).any() else 0
    low, high = v[v <= cut], v[v > cut]
    if not len(low) or not len(high):
        return 0.0
    return float(high.mean() / low.std()) if low.std() > 0 else float("inf")


def corner_snr(v: np.ndarray, cube: int = 10) -> float:
    """The upper quartile of what is above the tenth percentile over the corners' deviation, corrected for magnitude noise; infinite without noise.

    Volumes without room for two cubes on an axis take background_ratio."""
    cells = corners(v, cube)
    if cells is None:
        return background_ratio(v)
    noise = cells.std() / np.sqrt(2 - np.pi / 2)
    above = v[v > np.percentile(v, 10)]
    signal = np.percentile(above, 75) if len(above) else 0.0
    return float(signal / noise) if noise > 0 else float("inf")


def corner_ratio(v: np.ndarray, cube: int = 10, tissue: float = 0.05) -> float | None:
    """Mean size of the corners over the mean above the tenth percentile; none for small volumes, without a foreground, or where
    over half of the corners hold tissue, that is over `tissue` of the foreground's mean."""
    cells = corners(v, cube)
    above = v[v > np.percentile(v, 10)] if v.size else v
    if cells is None or not len(above) or above.mean() == 0:
        return None
    size = np.abs(cells)
    return None if (size > tissue * above.mean()).mean() > 0.5 else float(size.mean() / above.mean())


def boundary_ratio(v: np.ndarray, mask: np.ndarray) -> float:
    """Mean gradient on the mask's boundary over that inside it; 0 where either is empty or the inside is flat."""
    edge = mask & ~erode(mask)
    inside = mask & ~edge
    g = sobel(v)
    return float(g[edge].mean() / g[inside].mean()) if edge.any() and inside.any() and g[inside].mean() > 0 else 0.0


def finite(f: Callable[[np.ndarray], float | None]) -> Callable[[np.ndarray], float | None]:
    """The measure of the values that are finite; none where there are none."""
    return lambda v: f(v[np.isfinite(v)]) if np.isfinite(v).any() else None


def above_p99(v: np.ndarray) -> float | None:
    """The largest value over the 99th percentile, if that is positive."""
    p = np.percentile(v, 99)
    return float(v.max() / p) if p > 0 else None


def pad_crop(v: np.ndarray, target: tuple[int, ...]) -> np.ndarray:
    """v at the target shape, padded with zeros or cropped about its centre."""
    for axis, n in enumerate(target):
        gap = n - v.shape[axis]
        if gap > 0:
            v = np.pad(v, [(gap // 2, gap - gap // 2) if a == axis else (0, 0) for a in range(v.ndim)])
        elif gap < 0:
            v = np.take(v, range(-gap // 2, -gap // 2 + n), axis=axis)
    return v


def measures(cube: int = 10) -> dict[str, Callable[[np.ndarray], float | None]]:
    return {
        "gradient_entropy": gradient_entropy, "corner_snr": lambda v: corner_snr(v, cube), "mean_gradient": lambda v: float(sobel(v).mean()),
        "largest_component": lambda v: float(largest_component(v > 0).sum()), "eroded_cells": lambda v: float(erode(v > 0).sum()),
        "boundary_ratio": lambda v: boundary_ratio(v, v > 0), "corner_ratio": lambda v: corner_ratio(v, cube),
        "mean": lambda v: float(v.mean()), "std": lambda v: float(v.std()), "uniform_fraction": lambda v: float(np.unique(v, return_counts=True)[1].max() / v.size),
        "n_nan": lambda v: float(np.isnan(v).sum()), "n_inf": lambda v: float(np.isinf(v).sum()), "above_p99": finite(above_p99),
    }


MEASURES = tuple(measures())
#: What image_checks needs.
CHECKED = ("corner_snr", "mean", "std", "uniform_fraction", "n_nan", "n_inf", "above_p99", "gradient_entropy", "mean_gradient", "corner_ratio")


def motion_threshold(least: Column, anisotropy: Column) -> Column:
    """The least gradient entropy, lowered for thick slices: from three times as thick on, by 0.15 a step, to 0.4 of it."""
    return least * F.when(anisotropy > 3, F.greatest(F.lit(0.4), 1 / (1 + 0.15 * (anisotropy - 3)))).otherwise(1.0)


def image_checks(least_snr: Column, most_above: Column, least_entropy: Column, least_spread: float = 0.1, most_uniform: float = 0.95, most_corner: float = 0.15, action: str = "warn") -> list[Check]:
    """Checks of a volume's measures (columns named as in CHECKED): signal to noise, contrast, intensity outliers (always blocking for values that aren't finite), motion, ghosting."""
    c = F.col
    spread, broken = F.try_divide(c("std"), F.abs("mean")), (c("n_nan") > 0) | (c("n_inf") > 0)
    return [
        Check("snr_filtering", c("corner_snr") < least_snr, action, "Low signal to noise", {"snr": c("corner_snr"), "threshold": least_snr}),
        Check("contrast_detection", (c("mean") == 0) | (spread < least_spread) | (c("uniform_fraction") > most_uniform), action, "Low contrast", {"std_ratio": spread, "uniform_fraction": c("uniform_fraction")}),
        Check("intensity_outliers", broken | (c("above_p99") > most_above), F.when(broken, "block").otherwise(action), F.when(broken, "Values that are not finite").otherwise("Extreme values"), {"nan_count": c("n_nan"), "inf_count": c("n_inf"), "above_p99": c("above_p99")}),
        Check("motion_artifact", (c("mean_gradient") > 0) & (c("gradient_entropy") < least_entropy), action, "Low gradient entropy", {"gradient_entropy": c("gradient_entropy"), "threshold": least_entropy}),
        Check("ghosting_detection", c("corner_ratio") > most_corner, action, "Signal in the corners", {"ratio": c("corner_ratio")}),
    ]


def measure(volumes: DataFrame, keys: list[str], shape: Column, data: str, names: Sequence[str], cube: int = 10) -> DataFrame:
    """(keys, a column a measure) of each volume; null where the data do not fill the shape."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in volumes.select(*keys).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = measures(cube)
        for df in frames:
            out = df[keys].copy()
            rows = []
            for s, d in zip(df["__shape"], df[data], strict=True):
                ok = d is not None and s is not None and int(np.prod(s)) == len(d)
                v = np.asarray(d, float).reshape(tuple(s)) if ok else None
                rows.append([of[n](v) if ok else None for n in names])
            out[list(names)] = pd.DataFrame(rows, index=out.index, columns=list(names), dtype=float)
            yield out

    return volumes.select(*keys, shape.alias("__shape"), F.col(data)).mapInPandas(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}")
