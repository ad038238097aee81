"""Line dedup with two Bloom filters.

Pass 1 hashes the keys of all lines and builds, part by part on the executors, a filter of the
hashes seen once and one of those seen twice; only the second, which grows with the distinct
repeats alone and is bounded, is broadcast.
Pass 2 tests every key against it, and only suspected repeats are shuffled, with their full
text, to be counted exactly and to find the document that keeps its lines. Where the confirmed
keys are measured to be few they are broadcast, and every text is rebuilt where it is read: no
text moves. Where they are many, texts without a suspected line still pass in place, and only
the others are joined with what they lose.

A key is the line stripped of ASCII white space with A-Z lower-cased. Hot keys are counted with
partial aggregation; the joins on keys and ids are sort-merge joins whose hot partitions
adaptive execution splits.

Defined cases: null or empty text is one empty line; each row is a document of its own, so
repeated rows count as several, and all rows with the keeping id keep their lines; a null id
keeps lines only if all holders have null ids; all lines of a key within one document stand or
fall together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Container, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import LOWER, SPACE, UPPER, binaries, map_batches, packed_hashes, parts_for, twice_filter, work_table

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

HASH = xxhash.xxh3_64_intdigest


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(_LOWER)


def line_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text that have min_chars code points."""
    if not text:
        return []
    keys = {x.strip(SPACE) for x in text.translate(_LOWER).split(b"\n")}
    return [k for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), max_filter_log2: int = 28, max_key_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, the columns named in carry, n_lines, n_dropped (each left out where a carried column has its name), and text without the dropped lines.

    Keys of at least min_chars code points found in at least min_docs documents lose their
    lines except in the document with the least (keep='first') or greatest ('last') id.
    max_filter_log2 bounds the broadcast filter to 2**max_filter_log2 / 8 bytes; a filter too
    small for the input lets more lines through to the exact count, and changes no result.
    max_key_bytes bounds the confirmed keys that may be broadcast; it changes no result either."""
    if min_docs < 2 or keep not in ("first", "last"):
        raise ValueError("min_docs of 2 or more and keep 'first' or 'last' are expected")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    chars = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = math.ceil(chars / 64)
    parts = parts_for(expected)

    def hashes(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.fromiter(map(HASH, keys), np.uint64, len(keys)) for t in binaries(b.column(0)) if (keys := line_keys(t, min_chars))]

    twice, _ = twice_filter(packed_hashes(src.select("text"), hashes, parts), expected, parts, max_filter_log2)
    shared = spark.sparkContext.broadcast(twice)

    def suspected(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
        """The keys of the texts that may be repeats, and the position of the text of each."""
        keys = [line_keys(t, min_chars) for t in texts]
        flat = [k for ks in keys for k in ks]
        hit = np.flatnonzero(shared.value.test(np.fromiter(map(HASH, flat), np.uint64, len(flat))))
        owner = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)))[hit]
        return [flat[k] for k in hit.tolist()], owner

    def suspects(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, owner = suspected(binaries(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(keys, pa.binary()).cast(pa.string())], names=["id", "key"])

    # Both tables are small beside the texts; written, they are joined with exchanges of their own, which can be split.
    found = work_table(map_batches(src, suspects, f"id {kind}, key string"), "line-suspects")
    pick = F.min("id") if keep == "first" else F.max("id")
    repeats = work_table(found.groupBy("key").agg(F.count("*").alias("n"), pick.alias("keeper")).where(F.col("n") >= min_docs).select(F.col("key").alias("r_key"), "keeper"), "line-repeats")

    row = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    whole = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    schema = f"row {whole.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, text string"

    def rebuilt(rows: pa.Array, texts: list[bytes | None], gone: Iterable[Container[bytes]]) -> pa.RecordBatch:
        n, dropped, out = [], [], []
        for t, lost in zip(texts, gone, strict=True):
            t = t or b""
            if lost:
                old = t.split(b"\n")
                new = [x for x in old if line_key(x) not in lost]
                n.append(len(old))
                dropped.append(len(old) - len(new))
                t = b"\n".join(new)
            else:
                n.append(t.count(b"\n") + 1)
                dropped.append(0)
            out.append(t)
        return pa.RecordBatch.from_arrays([rows, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "n_lines", "n_dropped", "text"])

    size = repeats.agg(F.sum(F.octet_length("r_key") + F.octet_length(F.coalesce(F.col("keeper").cast("string"), F.lit(""))))).first()[0] or 0
    if size <= max_key_bytes:
        keepers = spark.sparkContext.broadcast({k.encode(): v for k, v in repeats.select("r_key", F.col("keeper").cast("string")).collect()})

        def in_place(b: pa.RecordBatch) -> pa.RecordBatch:
            keeper, texts = keepers.value, binaries(b.column(2))
            gone = [{k for k in line_keys(t, min_chars) if keeper.get(k, i) != i} for t, i in zip(texts, b.column(1).to_pylist(), strict=True)]
            return rebuilt(b.column(0), texts, gone)

        out = map_batches(whole.select("row", F.col("row.id").cast("string").alias("name"), "text"), in_place, schema)
    else:
        lost = found.join(repeats, F.col("key") == F.col("r_key")).where(~F.col("id").eqNullSafe(F.col("keeper")))
        lost = lost.groupBy(F.col("id").alias("l_id")).agg(F.collect_set("key").alias("lost"))

        def clean(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = binaries(b.column(1))
            rest = np.setdiff1d(np.arange(len(texts)), suspected(texts)[1])
            return rebuilt(b.column(0).take(pa.array(rest)), [texts[k] for k in rest.tolist()], [()] * len(rest))

        def others(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.take(pa.array(np.unique(suspected(binaries(b.column(1)))[1])))

        def rebuild(b: pa.RecordBatch) -> pa.RecordBatch:
            return rebuilt(b.column(0), binaries(b.column(1)), ({x.encode() for x in gone or ()} for gone in b.column(2).to_pylist()))

        named = map_batches(whole, others, f"row {whole.schema['row'].dataType.simpleString()}, text string")
        joined = named.join(lost, F.col("row.id").eqNullSafe(F.col("l_id")), "left").select("row", "text", "lost")
        out = map_batches(whole, clean, schema).unionByName(map_batches(joined, rebuild, schema))
    counts = [c for c in ("n_lines", "n_dropped") if c.lower() not in {x.lower() for x in (id_col, text_col, *carry)}]
    return out.select(F.col("row.id").alias(id_col), *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)], *counts, F.col("text").alias(text_col))
