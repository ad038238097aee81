"""Small helpers that the operators share: work tables, Arrow batches, and distributed Bloom filters."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D] of the contracts.
SPACE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own is made only where the session names none and everything runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tofcube.work.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("tofcube.work.dir", at)
    return at.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/tofcube-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_work_tables(spark: SparkSession) -> None:
    """Delete this application's work tables; results that were not written elsewhere can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tofcube-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, UPPER, LOWER)


def binaries(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


#: Rows of an Arrow batch: rows here are whole texts.
TEXT_ROWS = "1000"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set a number of its own: a batch of texts exists several times in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, TEXT_ROWS)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """mapInArrow, one batch in and one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(b)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class TwiceFilter:
    """The merged filter of hashes that were seen twice or more, as broadcast to the tasks.

    words: uint64 bit words, 2**bits_log2 bits in 2**parts_log2 equal parts. Of a hash, the top
    parts_log2 bits name its part, and the 32 bits below place it there."""

    def __init__(self, words: np.ndarray, bits_log2: int, parts_log2: int):
        self.words, self.bits_log2, self.parts_log2 = words, bits_log2, parts_log2

    def test(self, h: np.ndarray) -> np.ndarray:
        """Which of the uint64 hashes were perhaps seen twice. False is certain."""
        key = short(h, self.parts_log2)
        log2 = self.bits_log2 - self.parts_log2
        base = (key >> np.uint64(32)).astype(np.int64) << log2
        out = np.ones(len(h), bool)
        for p in _probes(key, log2):
            at = base + p
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def short(h: np.ndarray, parts_log2: int) -> np.ndarray:
    """The bits of a hash that filters know: its part, and 32 bits more."""
    return h >> np.uint64(32 - parts_log2)


def _probes(key: np.ndarray, log2: int) -> list[np.ndarray]:
    """Two bit positions within a part of 2**log2 bits."""
    mask = np.uint64((1 << log2) - 1)
    g = mix64(key)
    return [(g & mask).astype(np.int64), ((g >> np.uint64(32)) & mask).astype(np.int64)]


PACKED = "part int, hashes binary"


def route(h: np.ndarray, parts_log2: int) -> list[tuple[int, bytes]]:
    """Hashes of one batch, packed as 4 bytes each by part of the filter."""
    if not len(h):
        return []
    key = np.sort(short(h, parts_log2))
    part = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [(int(k), x.tobytes()) for k, x in zip(part[np.append(0, cuts)], np.split(low, cuts), strict=True)]


def packed(hashes: list[np.ndarray], parts_log2: int) -> pa.RecordBatch:
    rows = route(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), parts_log2)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["part", "hashes"])


def packed_hashes(df: DataFrame, hashes: Callable[[pa.RecordBatch], list[np.ndarray]], parts_log2: int) -> DataFrame:
    """PACKED rows of what `hashes` gives for each batch, a million hashes or so at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for h in hashes(b):
                held.append(h)
                n += len(h)
            if n >= 1 << 20:
                yield packed(held, parts_log2)
                held, n = [], 0
        yield packed(held, parts_log2)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, PACKED)


def parts_for(hashes: int) -> int:
    """log2 of the number of parts: some 65536 hashes each."""
    return int(min(16, max(4, math.ceil(math.log2(max(hashes, 1) / 65536)))))


def twice_filter(routed: DataFrame, expected: int, parts_log2: int, most_log2: int, heavy_at: int = 0) -> tuple[TwiceFilter, dict[int, int]]:
    """Build both Bloom filters from packed hashes (part int, hashes binary), part by part on the executors.

    Each task holds the once-seen filter of its parts alone, with 8 bits, a byte each, for each expected hash,
    and reads its hashes as a stream: those whose bits are all set, or that are twice in a row,
    are kept. Of these the twice-seen filter is made, part by part again; it alone leaves the
    executors. Its size follows the number of distinct repeats, not that of all hashes, and is
    at most 2**most_log2 / 8 bytes. A filter too small for the input passes more hashes, never
    fewer.

    heavy_at: also return the hashes (as short() gives them) counted at least so often, with
    their counts: a Misra-Gries summary of 65536 counters a task, so a count may be too low by a
    task's hashes / 65536, and by the first time a hash was seen. 0: none.
    """
    log2 = max(10, math.ceil(math.log2(max(expected, 1) * 8)) - parts_log2)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        repeats: dict[int, np.ndarray] = {}
        recent: dict[int, list[np.ndarray]] = {}
        counts: dict[int, int] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part not in once:
                    once[part], repeats[part], recent[part] = np.zeros(1 << log2, bool), np.zeros(0, np.uint32), []
                uniq, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                key = uniq.astype(np.uint64) | np.uint64(part << 32)
                p, q = _probes(key, log2)
                again = (once[part][p] & once[part][q]) | (n > 1)
                once[part][p] = True
                once[part][q] = True
                recent[part].append(uniq[again])
                if len(recent[part]) >= 64:  # a hash that comes in every row is held once
                    repeats[part], recent[part] = np.unique(np.concatenate((repeats[part], *recent[part]))), []
                if heavy_at:
                    for k, v in zip(key[again].tolist(), n[again].tolist(), strict=True):
                        counts[k] = counts.get(k, 0) + v
                    if len(counts) > 131072:
                        cut = sorted(counts.values())[-65536]
                        counts = {k: v - cut for k, v in counts.items() if v > cut}
        for part, held in repeats.items():
            keys = np.unique(np.concatenate((held, *recent[part])))
            heavy = {k: v for k, v in counts.items() if v + 1 >= heavy_at and k >> 32 == part} if heavy_at else {}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([list(heavy)], pa.list_(pa.int64())), pa.array([list(heavy.values())], pa.list_(pa.int64()))],
                names=["part", "n", "keys", "heavy", "counts"],
            )

    n = min(1 << parts_log2, max(1, int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    seen = work_table(routed.repartition(n, "part").mapInArrow(build, "part int, n bigint, keys binary, heavy array<bigint>, counts array<bigint>"), "twice-seen")
    bits_log2 = filter_bits(seen.agg(F.sum("n")).first()[0] or 0, max(most_log2, parts_log2 + 6), parts_log2 + 6)
    own = bits_log2 - parts_log2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = np.zeros(1 << own, bool)
                for p in _probes(np.frombuffer(raw, np.uint32).astype(np.uint64) | np.uint64(part << 32), own):
                    bits[p] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), *b.columns[2:]], names=["part", "bits", "heavy", "counts"])

    words = np.zeros(1 << (bits_log2 - 3), np.uint8)
    heavy: dict[int, int] = {}
    for row in seen.select("part", "keys", "heavy", "counts").mapInArrow(fill, "part int, bits binary, heavy array<bigint>, counts array<bigint>").collect():
        at = row["part"] << (own - 3)
        words[at : at + (1 << (own - 3))] = np.frombuffer(row["bits"], np.uint8)
        heavy |= dict(zip(row["heavy"], row["counts"], strict=True))
    return TwiceFilter(words.view(np.uint64), bits_log2, parts_log2), heavy


def filter_bits(n: int, most_log2: int, least_log2: int = 16) -> int:
    """log2 of the filter size for n hashes: at least 8 bits a hash, up to the bound."""
    return int(min(most_log2, max(least_log2, int(np.ceil(np.log2(max(n, 1) * 8))))))
