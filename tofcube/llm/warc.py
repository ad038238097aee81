"""WARC records and a Merkle fixity audit of replicas by ordered offset ranges.

An archive index has one row per record: its archive (a file), ordinal, offset range, SHA-256 and
record key. Replicas hold the same archives, and an archive's bytes are to be the same at the
same offsets. Its records are cut, in order, into ranges of about `range_rows`: a range ends
after a record whose key hashes to the cut, so ranges meet their own again behind a lost or added
record. A leaf is a range: its hash is that of its records' keys, hashes and offsets from its
start, in order; a node's hash is that of its leaves' or children's keys, hashes and absolute
offsets, in order. So nothing that is shifted, reordered, lost or changed leaves the root as it
is. Roots are compared first, and only children of nodes that differ are compared with their
own, down to ranges. A range that is the same but for its start is reported as it is; of the
others the records are read and told apart.

Archives are ranges of `archive_rows` records in the order of key and SHA-256, whatever the
layout of the input. Records' bytes are hashed where they are read and not shuffled.

Defined cases: a null url or page is written as an empty one; repeated rows are records of
their own, and of one key those of equal bytes are matched first; a record that one replica's
archive lacks is 'missing' or 'extra'; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.llm.common import work_table

INDEX = ["archive", "ordinal", "start", "stop", "sha256"]


def record_bytes(key: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC/1.0 resource record, as a string column."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive_index(records: DataFrame, key_col: str, bytes_col: str, archive_rows: int = 512, extra: tuple[str, ...] = ()) -> DataFrame:
    """The index of records (key, bytes): key, INDEX columns, record_key, and `extra` columns as they are. Records of an archive are ordered by key."""
    c = F.col(bytes_col)
    rows = records.select(F.col(key_col).alias("key"), F.octet_length(c).cast("bigint").alias("length"), F.sha2(c.cast("binary"), 256).alias("sha256"), F.monotonically_increasing_id().alias("row"), *extra)
    # equal records are told apart by the input position, so that many of them are split over partitions too
    order = ["key", "sha256", "row"]
    rows = work_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "warc-sorted")
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("c_part")).agg(F.count("*").alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(W.orderBy("c_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("at") - F.shiftleft(part, 33) + F.col("before")
    rows = rows.join(F.broadcast(counts.select("c_part", before.alias("before"))), part == F.col("c_part"))
    rows = rows.withColumn("archive", F.floor(place / archive_rows).cast("int")).withColumn("ordinal", F.pmod(place, F.lit(archive_rows)).cast("int"))
    stop = F.sum("length").over(W.partitionBy("archive").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(F.col("key").alias(key_col), "archive", "ordinal", (stop - F.col("length")).alias("start"), stop.alias("stop"), "sha256", F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("record_key"), *extra)


def without(index: DataFrame, gone: Column) -> DataFrame:
    """The index of the same archives after the loss of some records: what follows one moves up."""
    w = W.partitionBy("archive").orderBy("ordinal")
    stop = F.sum(F.col("stop") - F.col("start")).over(w)
    rows = index.where(~F.coalesce(gone, F.lit(False)))
    return rows.withColumns({"stop": stop, "start": stop - (F.col("stop") - F.col("start")), "ordinal": (F.row_number().over(w) - 1).cast("int")})


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ",").cast("binary"), 256)


def merkle_leaves(index: DataFrame, range_rows: int) -> DataFrame:
    """archive, end (the key of the range's last record, or null), again, ordinal, last, start, stop, hash: one row per range of an archive."""
    w = W.partitionBy("archive").orderBy("ordinal")
    cut = F.pmod(F.xxhash64("record_key"), F.lit(range_rows)) == 0
    before = F.coalesce(F.count_if(cut).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = index.select("archive", "ordinal", "start", "stop", "sha256", "record_key", before.alias("range"), cut.alias("cut"))
    held = F.array_sort(F.collect_list(F.struct("ordinal", "start", "stop", "sha256", "record_key")))
    at = F.col("rows")[0]["start"]
    text = F.transform("rows", lambda r: F.concat_ws(":", F.octet_length(r["record_key"]), r["record_key"], r["start"] - at, r["stop"] - at, r["sha256"]))
    leaves = rows.groupBy("archive", "range").agg(held.alias("rows"), F.max_by(F.when(F.col("cut"), F.col("record_key")), "ordinal").alias("end"))
    again = F.row_number().over(W.partitionBy("archive", "end").orderBy("range"))
    return leaves.select("archive", "end", again.alias("again"), F.col("rows")[0]["ordinal"].alias("ordinal"), F.element_at("rows", -1)["ordinal"].alias("last"), at.alias("start"), F.element_at("rows", -1)["stop"].alias("stop"), _hash(text).alias("hash"))


def merkle_archives(leaves: DataFrame) -> DataFrame:
    """node (the archive), hash of its ranges with their offsets, in order."""
    held = F.array_sort(F.collect_list(F.struct("ordinal", "start", "stop", "hash")))
    nodes = leaves.groupBy(F.col("archive").cast("bigint").alias("node")).agg(held.alias("kids"))
    return nodes.select("node", _hash(F.transform("kids", lambda k: F.concat_ws(":", k["start"], k["stop"], k["hash"]))).alias("hash"))


def merkle_level(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above: node, hash, from the same columns."""
    up = nodes.groupBy(F.floor(F.col("node") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids"))
    return up.select(F.col("up").alias("node"), _hash(F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["hash"]))).alias("hash"))


def merkle_levels(leaves: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Archives first, the root last: a row for each archive is written, what is above it follows from that."""
    levels = [work_table(merkle_archives(leaves), "merkle-archives")]
    for _ in range(height):
        levels.append(merkle_level(levels[-1], fanout))
    return levels


def tree_height(archives: int, fanout: int) -> int:
    height = 1
    while fanout**height < archives:
        height += 1
    return height


def damaged_archives(first: DataFrame, second: DataFrame, fanout: int) -> DataFrame:
    """node: the archives whose hashes differ, from leaves; found from the root down, below nodes that differ alone."""
    last = max(x.agg(F.max("archive")).first()[0] or 0 for x in (first, second))
    height = tree_height(last + 1, fanout)
    one, two = merkle_levels(first, fanout, height), merkle_levels(second, fanout, height)
    suspect: DataFrame | None = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if suspect is not None:
            parent = F.floor(F.col("node") / fanout) == F.col("s_node")
            a, b = a.join(suspect, parent, "left_semi"), b.join(suspect, parent, "left_semi")
        b = b.select(F.col("node").alias("b_node"), F.col("hash").alias("b_hash"))
        both = a.join(b, F.col("node") == F.col("b_node"), "full_outer").where(~F.col("hash").eqNullSafe(F.col("b_hash")))
        suspect = both.select(F.coalesce("node", "b_node").alias("s_node"))
    return work_table(suspect, "merkle-suspects")


FOUND = ["archive", "ordinal", "last", "start", "stop", "status"]


def audit(first: DataFrame, second: DataFrame, fanout: int = 64, range_rows: int = 64) -> DataFrame:
    """The damage: archive, ordinal and last (of the records), start, stop (of the first replica, else of the second), status.

    status: 'changed', 'missing' (the second lacks it), 'extra', 'shifted' (the same bytes at
    other offsets; a whole range at once where it is the same otherwise) or 'reordered' (among the
    records of its damaged ranges, at another place). Both are index tables."""
    one, two = (work_table(merkle_leaves(x, range_rows), "merkle-leaves") for x in (first, second))
    archives = damaged_archives(one, two, fanout)
    inside = F.col("archive") == F.col("s_node")
    names = ["archive", "end", "again", "ordinal", "last", "start", "stop", "hash"]
    a = one.join(archives, inside, "left_semi")
    b = two.join(archives, inside, "left_semi").select(*[F.col(c).alias(f"b_{c}") for c in names])
    same = (F.col("archive") == F.col("b_archive")) & F.col("end").eqNullSafe(F.col("b_end")) & (F.col("again") == F.col("b_again"))
    both = work_table(a.join(b, same, "full_outer").where(~(F.col("hash").eqNullSafe(F.col("b_hash")) & F.col("start").eqNullSafe(F.col("b_start")))), "merkle-ranges")
    shifted = both.where(F.col("hash") == F.col("b_hash")).select("archive", "ordinal", "last", "start", "stop", F.lit("shifted").alias("status"))
    both = both.where(~F.col("hash").eqNullSafe(F.col("b_hash")))

    def held(index: DataFrame, x: str) -> DataFrame:
        """The records of the damaged ranges, equal ones of an archive numbered."""
        ranges = both.where(F.col(f"{x}archive").isNotNull()).select(F.col(f"{x}archive").alias("r_archive"), F.col(f"{x}ordinal").alias("r_first"), F.col(f"{x}last").alias("r_last"))
        rows = index.select("archive", "ordinal", "start", "stop", "record_key", "sha256")
        # an archive has few ranges, so they meet its records by the archive
        rows = rows.join(ranges, (F.col("archive") == F.col("r_archive")) & F.col("ordinal").between(F.col("r_first"), F.col("r_last"))).drop("r_archive", "r_first", "r_last")
        return work_table(rows.withColumn("copy", F.row_number().over(W.partitionBy("archive", "record_key", "sha256").orderBy("ordinal"))), "merkle-records")

    x, y = held(first, ""), held(second, "b_")
    key = ["archive", "record_key", "sha256", "copy"]
    kept = x.join(y.select(*key, F.col("ordinal").alias("b_ordinal"), F.col("start").alias("b_start")), key)
    place = lambda c: F.row_number().over(W.partitionBy("archive").orderBy(c))
    status = F.when(F.col("i") != F.col("j"), "reordered").when(F.col("start") != F.col("b_start"), "shifted")
    moved = kept.withColumns({"i": place("ordinal"), "j": place("b_ordinal")}).withColumn("status", status).where("status IS NOT NULL")

    def left(these: DataFrame, those: DataFrame) -> DataFrame:
        rest = these.join(those.select(*key), key, "left_anti")
        return rest.withColumn("k", F.row_number().over(W.partitionBy("archive", "record_key").orderBy("ordinal")))

    b = left(y, x).select(*[F.col(c).alias(f"b_{c}") for c in ["archive", "ordinal", "start", "stop", "record_key", "k"]])
    lost = left(x, y).join(b, (F.col("archive") == F.col("b_archive")) & (F.col("record_key") == F.col("b_record_key")) & (F.col("k") == F.col("b_k")), "full_outer")
    status = F.when(F.col("b_k").isNull(), "missing").when(F.col("k").isNull(), "extra").otherwise("changed")
    # a record's place is that of one replica as a whole
    lost = lost.select(*[F.when(F.col("k").isNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in ("archive", "ordinal", "start", "stop")], status.alias("status"))
    one_row = lambda d: d.withColumn("last", F.col("ordinal")).select(FOUND)
    return shifted.select(FOUND).unionByName(one_row(moved)).unionByName(one_row(lost))


def write_warc(index: DataFrame, bytes_col: str, path: str) -> None:
    """Write each archive of an index that carries the records' bytes as one file under path/archive=N/.

    The text writer ends each row with a line feed, which is the last byte of a record."""
    body = index.repartition("archive").sortWithinPartitions("archive", "ordinal")
    body.select("archive", F.expr(f"substring(`{bytes_col}`, 1, length(`{bytes_col}`) - 1)").alias("value")).write.partitionBy("archive").text(path)


_KEY = re.compile(rb"(?i)^warc-record-id:\s*<urn:record:(.*)>\s*$", re.M)
_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse_warc(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset range and bytes of each record; what can't be read to its end is one last record."""
    at = 0
    while at < len(raw):
        m = _HEAD.match(raw, at)
        n = re.search(rb"(?i)^content-length:\s*(\d+)", m[1], re.M) if m else None
        stop = min(len(raw), m.end() + int(n[1]) + 4) if m and n else len(raw)
        yield at, stop, raw[at:stop]
        at = stop


def record_key(record: bytes) -> str:
    """The key in a record's head; empty if it can't be read."""
    m = _HEAD.match(record)
    k = _KEY.search(m[1]) if m else None
    return k[1].decode(errors="replace") if k else ""


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive (int), ordinal, start, stop, sha256, record_key and record (binary) of the files that write_warc wrote, each below 2 GB."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"archive=(\d+)", 1).cast("int").alias("archive"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for archive, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(parse_warc(raw))
                yield pa.RecordBatch.from_pydict({"archive": pa.array([archive] * len(rows), pa.int32()), "ordinal": pa.array(range(len(rows)), pa.int32()), "start": pa.array([r[0] for r in rows], pa.int64()), "stop": pa.array([r[1] for r in rows], pa.int64()), "sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows], "record_key": [record_key(r[2]) for r in rows], "record": [r[2] for r in rows]})

    return files.mapInArrow(run, "archive int, ordinal int, start bigint, stop bigint, sha256 string, record_key string, record binary")
