"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt by a hash of their id, size, source and cluster, and rows alike in all of
them by their number too, into groups of about `group_rows` rows; so a hot source or a large
cluster of copies is spread evenly, and the layout doesn't depend on how the input is split.
Each group is packed by one task from sizes and keys alone (no texts). Within a group, pieces
come in falling size, ties by id, source and cluster.
Open bins are ordered by residual and carry a bitmap of the sources and one of the duplicate
clusters they hold; the search starts at the least residual that fits and goes on to its
successors until a bin without a conflict is found, which is the tightest compatible one, or a
new bin is opened.

A document longer than a bin is cut into full pieces, each a bin of its own, and a remainder
that is packed with the others. Two pieces of one cluster never share a bin, nor do two of one
source if `source_limit` is set.

Defined cases: documents of size 0 or null get no piece but stay in the result with no bin; a
null source or cluster conflicts with nothing; repeated rows are packed each; an empty table
gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import map_batches, work_table

PIECES = "id {id}, piece int, start bigint, size bigint, bin string, bin_offset bigint"


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int, source_limit: bool = True) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces (start, size, bin number, offset in the bin)."""
    bits: tuple[dict, dict] = ({}, {})
    bit = lambda k, key: 0 if key is None else 1 << bits[k].setdefault(key, len(bits[k]))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    left: list[tuple[int, int]] = []
    bins = 0
    for d, size in enumerate(sizes):
        start = 0
        while size - start >= capacity:
            out[d].append((start, capacity, bins, 0))
            bins += 1
            start += capacity
        if size > start:
            left.append((size - start, d))
    left.sort(key=lambda x: (-x[0], x[1]))
    least = left[-1][0] if left else 0
    open_bins: list[tuple[int, int]] = []  # (residual, bin number), ascending
    held: dict[int, tuple[int, int]] = {}  # bin number to its bitmaps
    for size, d in left:
        s, c = bit(0, sources[d]) if source_limit else 0, bit(1, clusters[d])
        k = bisect_left(open_bins, (size, -1))
        while k < len(open_bins):
            residual, b = open_bins[k]
            has = held[b]
            if not (has[0] & s or has[1] & c):
                break
            k += 1
        else:
            residual, b, has = capacity, bins, (0, 0)
            bins += 1
        if k < len(open_bins):
            del open_bins[k]
        out[d].append((sizes[d] - size, size, b, capacity - residual))
        if residual - size >= least:
            insort(open_bins, (residual - size, b))
            held[b] = (has[0] | s, has[1] | c)
        else:
            held.pop(b, None)
    return out


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = 2048, group_rows: int = 4096, source_limit: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, piece (from 0), start and size (in units of `size`), bin, bin_offset.

    group_rows sets how the work is dealt; a group's rows are sizes and keys of a few dozen bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    keys = ["id", "size", "source", "cluster"]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    rows = work_table(rows.groupBy(keys).agg(F.count("*").alias("n")), "packing-rows")
    groups = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // group_rows))
    rows = rows.select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(*keys, "copy"), F.lit(groups)).cast("int"))

    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        ids, sizes = t.column("id").to_pylist(), t.column("size").to_pylist()
        name = f"g{t.column('grp')[0].as_py()}"
        cols: list[list] = [[], [], [], [], [], []]
        for i, pieces in zip(ids, best_fit(sizes, t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity, source_limit), strict=True):
            for k, (start, n, b, at) in enumerate(pieces or [(0, 0, None, None)]):
                for c, v in zip(cols, (i, k, start, n, None if b is None else f"{name}-{b}", at), strict=True):
                    c.append(v)
        types = [t.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["id", "piece", "start", "size", "bin", "bin_offset"])

    return rows.groupBy("grp").applyInArrow(f, PIECES.format(id=kind)).withColumnRenamed("id", id_col)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sequences(docs: DataFrame, layout: DataFrame, separator: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bin, n_words, ids and text of each training sequence, from a layout of word counts and ids that are unique."""
    pieces = layout.where("bin IS NOT NULL").select(F.col(id_col).alias("p_id"), "start", "size", "bin", "bin_offset")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pieces, F.col("id") == F.col("p_id")).select("id", "text", "start", "size", "bin", "bin_offset")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, start, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            at = [m.span() for m in _WORD.finditer(t)]
            out.append(t[at[start][0] : at[start + n - 1][1]])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), *(b.column(k) for k in (3, 4, 5))], names=["id", "text", "size", "bin", "bin_offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    part = map_batches(joined, cut, f"id {kind}, text string, size bigint, bin string, bin_offset bigint")
    held = F.array_sort(F.collect_list(F.struct("bin_offset", "id", "text")))  # a bin's capacity bounds it
    return part.groupBy("bin").agg(F.sum("size").alias("n_words"), held.alias("held")).select("bin", "n_words", F.col("held.id").alias("ids"), F.array_join("held.text", separator).alias("text"))
