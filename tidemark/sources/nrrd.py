"""Volumes in NRRD files: a text header, then raw or gzipped numbers. Errors are rows, not exceptions."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NRRD names of number types that are read.
TYPES = {"int8": "i1", "signed char": "i1", "uint8": "u1", "unsigned char": "u1", "uchar": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "unsigned short": "u2", "int32": "i4", "int": "i4", "uint32": "u4", "float": "f4", "double": "f8"}
SCHEMA = "path string, error string, dimension int, sizes array<int>, space string, directions array<array<double>>, data array<float>"


def parse(content: bytes, with_data: bool = True) -> dict:
    """Header fields and the numbers, x fastest, of a NRRD file's bytes."""
    head, _, body = content.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not a NRRD file")
    fields = dict(re.split(r":=?\s*", x, maxsplit=1) for x in lines[1:] if ":" in x and not x.startswith("#"))
    sizes = [int(n) for n in fields["sizes"].split()]
    vectors = re.findall(r"\(([^)]*)\)|none", fields.get("space directions", ""))
    out = {"dimension": int(fields["dimension"]), "sizes": sizes, "space": fields.get("space"), "directions": [[float(x) for x in v.split(",")] for v in vectors if v] or None, "data": None}
    if with_data:
        kind = np.dtype(TYPES[fields["type"]]).newbyteorder(">" if fields.get("endian") == "big" else "<")
        raw = gzip.decompress(body) if fields.get("encoding", "raw") in ("gzip", "gz") else body
        out["data"] = np.frombuffer(raw, kind, int(np.prod(sizes))).astype(np.float32)
    return out


def read_nrrd(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for p, content in zip(df["path"], df["content"], strict=True):
                try:
                    rows.append({"path": p, "error": None} | parse(content, with_data))
                except Exception as e:  # what can't be read is a row with its error
                    rows.append({"path": p, "error": f"{type(e).__name__}: {e}"[:200]})
            names = ["path", "error", "dimension", "sizes", "space", "directions", "data"]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="Int32" if n == "dimension" else object) for n in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nrrd").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
