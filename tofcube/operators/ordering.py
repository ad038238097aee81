"""Order over a whole table without one task: numbers, neighbours, and chains of kept values.

Rows are range-partitioned and sorted once and written; what a row needs from beyond its
partition is one value for each partition, found by a window over the partitions' few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.operators.asof import bracket
from tofcube.work import written


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with _part and _at, both rising in this order; equal rows are told apart by the input's order."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row")
    return written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")


def _by_part(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows with the columns of ends, one row for each partition of the order."""
    return rows.join(F.broadcast(ends.withColumnRenamed("_part", "_e_part")), F.col("_part") == F.col("_e_part"), "left").drop("_e_part")


def _earlier():
    """The partitions before this one."""
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "rank", first: int = 1) -> DataFrame:
    """rows with their number in this order, as row_number over the whole table gives it."""
    at = placed(rows, order)
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    ends = counts.select("_part", (F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)) - F.col("_least") + first).alias("_shift"))
    return _by_part(at, ends).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def with_previous(at: DataFrame, value: str) -> DataFrame:
    """Placed rows with `previous`: the value of the row before, across partitions."""
    last = at.groupBy("_part").agg(F.max_by(value, "_at").alias("_last"))
    ends = last.select("_part", F.last("_last").over(_earlier()).alias("_last"))
    own = F.lag(value).over(W.partitionBy("_part").orderBy("_at"))
    head = F.row_number().over(W.partitionBy("_part").orderBy("_at")) == 1
    return _by_part(at.withColumns({"_own": own, "_head": head}), ends).withColumn("previous", F.when(F.col("_head"), F.col("_last")).otherwise(F.col("_own"))).drop("_own", "_head", "_last")


def kept_values(values: DataFrame, rel: float = 1e-10, floor: float = 1e-30) -> DataFrame:
    """i, value: the values in order, without those at most rel * max(|k|, floor) above the last kept one k. Nulls are left out.

    A value further than that from the one before it is kept whatever was kept earlier (rel is
    below 1), and starts a run; runs don't depend on each other. Within a run of several, each
    value points to the first that it would let stay, and the chain from the run's start is
    followed by doubling the pointers, so a run of n values takes log2(n) rounds."""
    if not 0 <= rel < 1:
        raise ValueError("a relative distance from 0 to below 1 is needed")
    reach = lambda c: F.col(c) + F.greatest(F.abs(c), F.lit(floor)) * rel
    at = with_previous(placed(values.select("value").where("value IS NOT NULL"), [F.col("value")]), "value")
    at = at.withColumn("start", F.col("previous").isNull() | (F.col("value") > reach("previous")))
    starts = F.when(F.col("start"), F.col("_at"))
    ends = at.groupBy("_part").agg(F.max(starts).alias("_s")).select("_part", F.last("_s", True).over(_earlier()).alias("_s"))
    runs = F.last(starts, True).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    at = written(_by_part(at.withColumn("run", runs), ends).select("_at", "value", "start", F.coalesce("run", "_s").alias("run")), "runs")
    rest = at.where("NOT start").select(F.col("run").alias("m_run")).distinct()
    many = at.join(rest, F.col("run") == F.col("m_run"), "left_semi")
    points = many.select("run", F.col("_at").alias("at"), reach("value").alias("x"))
    jumps = bracket(points, many.select("run", F.col("value").alias("x"), F.col("_at").alias("at")), ["run"], "x", ["at"]).select("at", F.col("after.at").alias("to"))
    jumps = written(jumps.where("to IS NOT NULL"), "jumps")
    chain = many.where("start").select(F.col("_at").alias("at"))
    while not jumps.isEmpty():
        nxt = jumps.select(F.col("at").alias("n_at"), F.col("to").alias("n_to"))
        chain = written(chain.unionByName(chain.join(nxt, F.col("at") == F.col("n_at")).select(F.col("n_to").alias("at"))), "chain")
        jumps = written(jumps.join(nxt, F.col("to") == F.col("n_at")).select("at", F.col("n_to").alias("to")), "jumps")
    found = at.join(chain.where(F.col("at").isNotNull()), F.col("_at") == F.col("at"), "left_semi").where("NOT start").unionByName(at.where("start"))
    return numbered(found.select("value"), [F.col("value")], "i", 0).select(F.col("i").cast("int").alias("i"), "value")
