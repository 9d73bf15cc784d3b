"""Volumes in NIfTI-1 files (.nii, .nii.gz): the header is read as bytes, no library needed. Errors are rows, not exceptions."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.grids import orientation, oriented

#: The format's codes of number types that are read, and the places of its header's fields.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER, DIM, DATATYPE, PIXDIM, OFFSET, SLOPE, QFORM, SFORM, QUATERNION, SROW, MAGIC = 348, 40, 70, 76, 108, 112, 252, 254, 256, 280, 344
SCHEMA = "path string, error string, shape array<long>, spacing array<double>, affine array<double>, stored string, data array<double>"


def affine_of(order: str, head: bytes, shape: list[int], spacing: list[float]) -> np.ndarray:
    """The map from cells to the world: the given rows, else the rotation and offset, else the spacing about the centre."""
    qform, sform = struct.unpack_from(order + "hh", head, QFORM)
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.reshape(struct.unpack_from(order + "12f", head, SROW), (3, 4))
    elif qform > 0:
        b, c, d, *origin = struct.unpack_from(order + "6f", head, QUATERNION)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        side = struct.unpack_from(order + "f", head, PIXDIM)[0]
        out[:3, :3] = turn * np.array(spacing) * np.array([1, 1, -1 if side < 0 else 1])
        out[:3, 3] = origin
    else:
        out[:3, :3] = np.diag(spacing)
        out[:3, 3] = -np.array(spacing) * (np.array(shape) - 1) / 2
    return out


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(volume, affine, spacing) of a file's bytes; of further dimensions the first volume."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = next((o for o in "<>" if len(raw) >= HEADER and struct.unpack_from(o + "i", raw)[0] == HEADER), None)
    if order is None or raw[MAGIC: MAGIC + 3] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(order + "8h", raw, DIM)
    shape = [max(1, n) for n in (*dims[1: 1 + min(dims[0], 3)], 1, 1)][:3]
    spacing = [abs(x) or 1.0 for x in struct.unpack_from(order + "3f", raw, PIXDIM + 4)]
    code = struct.unpack_from(order + "h", raw, DATATYPE)[0]
    if code not in TYPES:
        raise ValueError(f"number type {code} isn't read")
    start, slope, shift = struct.unpack_from(order + "3f", raw, OFFSET)
    cells = np.frombuffer(raw, np.dtype(order + TYPES[code]), int(np.prod(shape)), int(start)).astype(float)
    if np.isfinite(slope) and slope != 0 and (slope, shift) != (1, 0):
        cells = cells * slope + shift
    return cells.reshape(shape, order="F"), affine_of(order, raw, shape, spacing), spacing


def write(v: np.ndarray, affine: np.ndarray, kind: str = "f8", order: str = "<", packed: bool = False, slope: float = 1.0, shift: float = 0.0) -> bytes:
    """A file's bytes: volume and affine as rows; slope and shift apply on reading."""
    head = bytearray(352)
    code = next(k for k, t in TYPES.items() if t == kind)
    struct.pack_into(order + "i", head, 0, HEADER)
    struct.pack_into(order + "8h", head, DIM, 3, *v.shape, 1, 1, 1, 1)
    struct.pack_into(order + "hh", head, DATATYPE, code, 8 * int(kind[1]))
    struct.pack_into(order + "4f", head, PIXDIM, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(0)))
    struct.pack_into(order + "3f", head, OFFSET, 352.0, slope, shift)
    struct.pack_into(order + "hh", head, QFORM, 0, 1)
    struct.pack_into(order + "12f", head, SROW, *affine[:3].ravel())
    head[MAGIC: MAGIC + 4] = b"n+1\0"
    out = bytes(head) + v.astype(order + kind).tobytes(order="F")
    return gzip.compress(out) if packed else out


def parsed(files: DataFrame, target: str = "RAS") -> DataFrame:
    """SCHEMA of files (path, content): each volume with axes turned to the target, cells in row-major order, and the orientation it was stored in; what can't be read is a row with its error."""
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    v, affine, spacing = parse(content or b"")
                    stored = orientation(affine)
                    v, affine = oriented(v, affine, target)
                    apart = np.sqrt((affine[:3, :3] ** 2).sum(0)).tolist()
                    row = (path, None, list(v.shape), apart, affine.ravel().tolist(), stored, v.ravel())
                except Exception as e:  # what can't be read is a row with its error
                    row = (path, f"{type(e).__name__}: {e}"[:200], None, None, None, None, None)
                kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_nifti(spark: SparkSession, path: str, target: str = "RAS") -> DataFrame:
    """SCHEMA of all NIfTI files below path; each file is read in the task that has it. Spark leaves files of no bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.nii(\.gz)?$"))
    return parsed(files, target)
