"""As-of and bracket joins by one ordered scan.

Points and table rows become one relation, range-partitioned and sorted by (key, x): a key with
most of the rows is cut into many partitions. Within a partition the last table row is carried
forward and the next one backward by windows; between partitions the ends travel in one small row
per (partition, key), whose carried values fill what a partition could not know. A point meets
two rows of the table at most, whatever the table's size, and nothing is filtered after a join.

Points with a null key or x lie in no bracket; of table rows at one x the last written holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.work import written


def bracket(points: DataFrame, table: DataFrame, by: Sequence[str], x: str = "x", values: Sequence[str] | None = None) -> DataFrame:
    """The points with `before` (the table's last row at or below x) and `after` (its first above x), each a struct of x and values, or null."""
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    values = [c for c in table.columns if c not in by and c != x] if values is None else list(values)
    row = table.select(*named, F.col(x).cast("double").alias("_x"), F.struct(F.col(x).alias(x), *values).alias("_t")).where(F.col("_x").isNotNull())
    rows = points.select(*named, F.col(x).cast("double").alias("_x"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"))
    both = row.withColumn("_kind", F.lit(0)).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [*keys, "_x", "_kind", "_row"]
    # the row's number splits a value of x that very many points share
    placed = both.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()), "asof")
    own = W.partitionBy("_part", *keys)
    rising = own.orderBy("_x", "_kind", "_row").rowsBetween(W.unboundedPreceding, 0)
    falling = own.orderBy(F.desc("_x"), F.desc("_kind"), F.desc("_row")).rowsBetween(W.unboundedPreceding, 0)
    near = placed.withColumns({"_before": F.last("_t", True).over(rising), "_after": F.last("_t", True).over(falling)}).where("_kind = 1")
    at = F.when(F.col("_kind") == 0, F.struct("_x", "_row"))
    ends = placed.groupBy("_part", *keys).agg(F.min_by("_t", at).alias("_first"), F.max_by("_t", at).alias("_last"))
    over = W.partitionBy(*keys)
    earlier, later = over.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), over.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_e_part"), *[F.col(k).alias(f"_e{k}") for k in keys], F.last("_last", True).over(earlier).alias("_earlier"), F.last("_first", True).over(later).alias("_later"))
    same = F.col("_part") == F.col("_e_part")
    for k in keys:
        same &= F.col(k) == F.col(f"_e{k}")
    out = near.join(ends, same, "left")
    some = F.col("_x").isNotNull()
    return out.select("_p.*", F.when(some, F.coalesce("_before", "_earlier")).alias("before"), F.when(some, F.coalesce("_after", "_later")).alias("after"))


def asof(points: DataFrame, table: DataFrame, by: Sequence[str], x: str = "x", values: Sequence[str] | None = None) -> DataFrame:
    """The points with the values of the table's last row at or below x: a left join, nulls where there is none."""
    names = [c for c in table.columns if c not in by and c != x] if values is None else list(values)
    out = bracket(points, table, by, x, names)
    return out.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col("before")[c].alias(c) for c in names])


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, x: str, lo: str, hi: str, both_ends: bool = False) -> DataFrame:
    """Points with each interval (key, lo, hi, more columns) of their key that holds them.

    An interval is half open where another starts at its end, else closed; both_ends: closed in any
    case. Where the intervals of a key are apart from each other, a point can lie in the last that
    starts at or below it alone, which the ordered scan finds; one that ends exactly at the point
    is an equi-join. Keys with overlapping intervals meet their points by the key."""
    w = W.partitionBy(key).orderBy(lo, hi)
    top = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    iv = intervals.withColumns({"_open": F.coalesce(F.lead(lo).over(w) == F.col(hi), F.lit(False)), "_clash": F.coalesce(F.col(lo) < top, F.lit(False)) | F.coalesce(F.lead(lo).over(w) < F.col(hi), F.lit(False))})
    iv = iv.withColumn("_clash", F.max("_clash").over(W.partitionBy(key)))
    names = [c for c in intervals.columns if c != key]
    apart, mixed = iv.where("NOT _clash"), iv.where("_clash")
    p = F.col(f"`{x}`")
    pick = [F.col(f"`{c}`") for c in points.columns]
    # one row per start: of intervals apart from each other two share one only where the first is a point
    table = apart.groupBy(key, F.col(lo).alias(x)).agg(F.collect_list(F.struct("_open", *names)).alias("_iv"))
    found = bracket(points, table, [key], x, ["_iv"])
    each = found.select(*pick, F.explode(F.col("before._iv")).alias("_i"))
    held = (p < F.col("_i")[hi]) | ((p == F.col("_i")[hi]) & (~F.col("_i._open") if not both_ends else F.lit(True)))
    out = each.where(held).select(*pick, *[F.col("_i")[c].alias(c) for c in names])
    if both_ends:
        ends = apart.where("_open").select(F.col(key).alias("_end_key"), *[F.col(c).alias(f"_end_{c}") for c in names])
        more = points.join(ends, (F.col(key) == F.col("_end_key")) & (p == F.col(f"_end_{hi}")) & (F.col(f"_end_{lo}") < p))
        out = out.unionByName(more.select(*pick, *[F.col(f"_end_{c}").alias(c) for c in names]))
    crossed = mixed.select(F.col(key).alias("_m_key"), *[F.col(c).alias(f"_m_{c}") for c in names], F.col("_open").alias("_m_open"))
    top = F.col(f"_m_{hi}")
    inside = (p >= F.col(f"_m_{lo}")) & ((p < top) | ((p == top) & (F.lit(both_ends) | ~F.col("_m_open"))))
    rest = points.join(crossed, F.col(key) == F.col("_m_key")).where(inside)
    return out.unionByName(rest.select(*pick, *[F.col(f"_m_{c}").alias(c) for c in names]))

