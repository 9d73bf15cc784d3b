"""Other grids for volumes: coarser ones within a budget of cells, other shapes with an exact way back, other orientations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import pad_crop
from .regions import each_volume

#: Distance of cells and number of cells of a volume for cheap checks.
TARGET, MOST_CELLS = 2.0, 250_000
#: World axes in order, by the letters of their positive and negative ends.
ENDS = (("R", "L"), ("A", "P"), ("S", "I"))


def coarse_grid(shape: Sequence[int], spacing: Sequence[float], target: float = TARGET, most: int = MOST_CELLS) -> tuple[list[int], list[float]]:
    """(cells, distance of cells) along each axis: cells `target` apart, as many as fit and one at least; further apart where that is over `most` cells, never more than these."""
    old, apart = np.array(shape, float), np.array(spacing, float)
    new = np.maximum((apart / target * old).astype(np.int64), 1)
    if np.prod(new) <= most:
        return new.tolist(), [float(target)] * len(new)
    new = np.maximum((new * (most / np.prod(new)) ** (1 / len(new))).astype(np.int64), 1)
    while np.prod(new) > most:  # an axis of one cell can't shrink, so the others give way
        widest = int(np.argmax(new))
        new[widest] = max(1, most // int(np.prod(np.delete(new, widest))))
    return new.tolist(), (apart * old / new).tolist()


def sampled(v: np.ndarray, cells: Sequence[int], step: Sequence[float], nearest: bool = False) -> np.ndarray:
    """v at `cells` places along each axis, `step` cells apart from the first on: between two cells by distance, or the nearest one; 0 beyond the last cell's half."""
    for axis, (n, apart) in enumerate(zip(cells, step, strict=True)):
        at = np.arange(n) * apart
        size = v.shape[axis]
        low = np.minimum(np.floor(at + (0.5 if nearest else 0)).astype(int), size - 1)
        out = np.take(v, low, axis)
        weight = [1] * v.ndim
        weight[axis] = n
        if not nearest:
            part = (np.minimum(at, size - 1) - low).reshape(weight)
            out = out * (1 - part) + np.take(v, np.minimum(low + 1, size - 1), axis) * part
        v = np.where((at < size - 0.5).reshape(weight), out, np.zeros((), out.dtype))
    return v


def downsampled(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, spacing: Column, mask: Column | None = None, target: float = TARGET, most: int = MOST_CELLS) -> DataFrame:
    """(keys, shape, factor, data, mask) of each volume on coarse_grid: data between cells by distance, the mask (array of booleans, or null) from the nearest; factor is the first axis's new distance over the old.

    spacing is an array of a positive number an axis; rows without one, and volumes without cells, give no row."""

    def rows(v: np.ndarray, *more) -> list[tuple]:
        *m, apart = more
        if not v.size or not apart or len(apart) != v.ndim or not all(a and a > 0 for a in apart):
            return []
        cells, new = coarse_grid(v.shape, apart, target, most)
        step = [b / a for a, b in zip(apart, new, strict=True)]
        held = sampled(m[0].astype(bool), cells, step, True).ravel().tolist() if m and m[0] is not None else None
        return [(cells, step[0], sampled(v.astype(float), cells, step).ravel().tolist(), held)]

    return each_volume(volumes, keys, shape, data, "shape array<long>, factor double, data array<double>, mask array<boolean>", rows, [] if mask is None else [mask], [spacing])


# shapes


def fitted(volumes: DataFrame, keys: Sequence[str], shape: Column, data: Column, target: Sequence[int]) -> DataFrame:
    """(keys, data, fitted_from, moved) of each volume at the target shape, padded with zeros or cropped about its centre, the odd cell after.

    What was done goes with the row: the old shape, and by how many cells along each axis the first cell moved (cropped less padded), so that restored and moved_affine undo it."""

    def rows(v: np.ndarray) -> list[tuple]:
        gaps = [new - old for new, old in zip(target, v.shape, strict=True)]
        return [(pad_crop(v, tuple(target)).astype(float).ravel().tolist(), list(v.shape), [-(g // 2) if g > 0 else -g // 2 for g in gaps])]

    return each_volume(volumes, keys, shape, data, "data array<double>, fitted_from array<long>, moved array<long>", rows)


def unfitted(v: np.ndarray, old: Sequence[int]) -> np.ndarray:
    """A fitted volume at its old shape: padding goes, what was cropped is 0."""
    for axis, n in enumerate(old):
        gap = v.shape[axis] - n
        if gap > 0:
            v = np.take(v, range(gap // 2, gap // 2 + n), axis=axis)
        elif gap < 0:
            v = np.pad(v, [(-gap // 2, -gap - -gap // 2) if a == axis else (0, 0) for a in range(v.ndim)])
    return v


def restored(rows: DataFrame, keys: Sequence[str], target: Sequence[int], data: str = "data", old: str = "fitted_from") -> DataFrame:
    """(keys, data) of fitted volumes at the shapes that they had. Cells that fitted kept have their values again; cropped ones are 0."""
    shape = F.array(*map(F.lit, target))
    return each_volume(rows, keys, shape, F.col(data), "data array<double>", lambda v, was: [(unfitted(v, was).ravel().tolist(),)] if was and len(was) == v.ndim else [], given=[F.col(old)])


def moved_affine(affine: Column, cells: Column, back: bool = False) -> Column:
    """An affine map (16 numbers, row by row) whose first cell is moved by so many cells along each axis; back: moved back, which gives the first map again."""
    at = lambda r, c: F.get(affine, 4 * r + c)
    shift = lambda r: sum((at(r, c) * F.get(cells, c) for c in range(1, 3)), at(r, 0) * F.get(cells, 0))
    origin = lambda r: at(r, 3) - shift(r) if back else at(r, 3) + shift(r)
    return F.array(*(origin(r) if c == 3 and r < 3 else at(r, c) for r in range(4) for c in range(4)))


# orientations


def closest_axes(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each world axis the volume's axis that is closest to it, each taken once, and the sign of its direction."""
    m = affine[:3, :3] / np.maximum(np.sqrt((affine[:3, :3] ** 2).sum(0)), 1e-12)
    order = max(permutations(range(3)), key=lambda p: sum(abs(m[w, a]) for w, a in enumerate(p)))
    return [(a, -1 if m[w, a] < 0 else 1) for w, a in enumerate(order)]


def orientation(affine: np.ndarray) -> str:
    """The letters of the ends to which the volume's axes run, such as RAS."""
    letters = [""] * 3
    for world, (axis, sign) in enumerate(closest_axes(affine)):
        letters[axis] = ENDS[world][sign < 0]
    return "".join(letters)


def oriented(v: np.ndarray, affine: np.ndarray, target: str = "RAS") -> tuple[np.ndarray, np.ndarray]:
    """(volume, affine) with axes that run to the target's ends: axes exchanged and turned round, no cell's value or place in the world changes."""
    axes = closest_axes(affine)
    turn = np.zeros((4, 4))
    turn[3, 3] = 1
    order = []
    for new, letter in enumerate(target):
        world = next(w for w, ends in enumerate(ENDS) if letter in ends)
        axis, sign = axes[world]
        wanted = 1 if letter == ENDS[world][0] else -1
        order.append((axis, sign != wanted))
        turn[axis, new] = -1 if sign != wanted else 1
        if sign != wanted:
            turn[axis, 3] = v.shape[axis] - 1
    out = np.transpose(v, [a for a, _ in order])
    return out[tuple(slice(None, None, -1 if back else 1) for _, back in order)], affine @ turn
