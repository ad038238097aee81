"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the least -ln(u) / weight, where u in (0, 1) is hashed from
the record's key and the shard number; so one more shard takes records only into itself, and a
record moves only when its own shard is removed or loses weight. Everything is a DataFrame
expression on the executors.

Slots number the records of a shard from 0 without gaps. The records (keys and sizes, no texts)
are range-sorted by shard and key with their input position as the last resort, so that equal
keys or copies are split over partitions too, written once, and each slot is the number within
its partition plus an offset from the counts of the partitions before.

Defined cases: a null key hashes as the text 'null'; a null text has size 8 and CRC 0; rows
with equal keys share a shard and have slots of their own; an empty table gives an empty
result; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.llm.common import work_table


def _unit(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of 'key:shard'."""
    n = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (n + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) of a key given as a string column. Equal scores go to the lower number."""
    scores = [F.struct((-F.ln(_unit(key, F.lit(s))) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard with a weight is needed")
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown: Sequence[float] | None = None) -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard (the shard under the weights `grown`; null without).

    The text itself is read once and not shuffled."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(raw).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None)).cast("int").alias("grown"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["shard", "id", "crc", "row"]
    placed = work_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("at", 33)
    # One row for each partition and shard that meet: partitions + shards at most.
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("o_part"), F.col("shard").alias("o_shard"), (before - F.col("first")).alias("shift"))
    out = placed.join(offsets, (part == F.col("o_part")) & (F.col("shard") == F.col("o_shard")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("shift")).cast("bigint").alias("slot"), F.col("grown").alias("grown_shard"))
