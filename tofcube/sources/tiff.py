"""Baseline TIFF stacks as a long cube: (file, tof_bin, y, x, value).

Files are read by Spark as binary rows and decoded where they lie; one frame is one row of work.
Uncompressed strips, one sample a pixel, of 8 to 64 bit integers and 16 to 64 bit floats.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.functions.scalars import glob_regex

#: TIFF field types: bytes and struct code. Fixed values.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 16: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}
SCHEMA = "file string, page int, y int, x int, value double"


def frames(raw: bytes) -> Iterator[np.ndarray]:
    """The pages of one file, as float64."""
    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    (at,) = struct.unpack_from(f"{end}I", raw, 4)
    while at:
        (n,) = struct.unpack_from(f"{end}H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{end}HHI", raw, at + 2 + 12 * k)
            size, code = TYPES.get(kind, (1, "B"))
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = struct.unpack_from(f"{end}I", raw, place)
            if kind in (1, 3, 4, 16):
                tags[tag] = struct.unpack_from(f"{end}{count}{code}", raw, place)
        width, height = tags[256][0], tags[257][0]
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed single-sample pages are read")
        dtype = np.dtype(f"{end}{KINDS[tags.get(339, (1,))[0]]}{tags.get(258, (8,))[0] // 8}")
        data = b"".join(raw[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
        yield np.frombuffer(data, dtype, width * height).reshape(height, width).astype(np.float64)
        (at,) = struct.unpack_from(f"{end}I", raw, at + 2 + 12 * n)


def _cells(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for page, f in enumerate(frames(raw)):
                    y, x = np.indices(f.shape, dtype=np.int32)
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name] * f.size), "page": pa.array(np.full(f.size, page, np.int32)), "y": pa.array(y.ravel()), "x": pa.array(x.ravel()), "value": pa.array(f.ravel())})

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _sizes(files: DataFrame) -> DataFrame:
    """path, pages, and the least and greatest height and width of a file's frames: from the files' directories, no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shapes = [f.shape for f in frames(raw)]
                hs, ws = [h for h, _ in shapes] or [0], [w for _, w in shapes] or [0]
                rows.append((name, len(shapes), min(hs), max(hs), min(ws), max(ws)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["path", "pages", "h0", "h1", "w0", "w1"])

    return files.select("path", "content").mapInArrow(run, "path string, pages int, h0 int, h1 int, w0 int, w1 int")


def _checked(files: DataFrame, what: str, single: bool | None) -> DataFrame:
    """The files, after one row about all of them was read: that there are frames, of one size, and one a file in a folder."""
    n, pages, most, h0, h1, w0, w1 = _sizes(files).agg(F.count("*"), F.sum("pages"), F.max("pages"), F.min("h0"), F.max("h1"), F.min("w0"), F.max("w1")).first()
    if not n:
        raise ValueError(f"no TIFF files in {what}")
    if not pages:
        raise ValueError(f"no frames in {what}")
    if single and most > 1:
        raise ValueError(f"a file of {most} frames in the folder {what}")
    if single is False and n > 1:
        raise ValueError(f"{what} is not one file")
    if (h0, w0) != (h1, w1):
        raise ValueError(f"frames of different sizes in {what}: {h0} to {h1} by {w0} to {w1}")
    return files


def load_tiff_stack(spark: SparkSession, path: str) -> DataFrame:
    """tof_bin, y, x, value of one multi-page file. No frames, or frames of different sizes, are an error."""
    files = _checked(spark.read.format("binaryFile").load(path), path, False)
    return _cells(files).select(F.col("page").alias("tof_bin"), "y", "x", "value")


def load_tiff_folder(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """tof_bin, y, x, value of a folder with one frame a file, numbered by path; pattern: * and ?, the
    whole name, in any case. No files, a file of several frames, or frames of different sizes are an error."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"(?i)\.tiff?$"))
    if pattern:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(glob_regex(pattern)))
    _checked(files, path, True)
    order = files.select(F.col("path").alias("o_file"), (F.row_number().over(W.orderBy("path")) - 1).cast("int").alias("no"))
    out = _cells(files).join(order, F.col("file") == F.col("o_file"))
    return out.select(F.col("no").alias("tof_bin"), "y", "x", "value")


def load_tiff(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A stack if the path names a TIFF file, else a folder."""
    return load_tiff_stack(spark, path) if path.lower().endswith((".tif", ".tiff")) else load_tiff_folder(spark, path, pattern)


def tiff_bytes(frame: np.ndarray) -> bytes:
    """A single-page little-endian float32 TIFF."""
    data = frame.astype("<f4").tobytes()
    h, w = frame.shape
    entries = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (339, 3, 3)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd
