"""Long curves in blocks with halos: the same bits as in one piece, over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tofcube.operators import broaden as B


def curve(spark, seed, n=700, c=1):
    rnd = random.Random(seed)
    e, rows = 1.0, []
    for _ in range(n):
        e += rnd.choice([0.001, 0.01, 0.01, 0.01, 0.3])
        rows.append((c, e, 1.0 + rnd.random() * 50))
    return rows


def values(df):
    return {(r["c"], r["e"]): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize("rows", [5, 64])
def test_same_bits(spark, monkeypatch, rows):
    data = spark.createDataFrame(curve(spark, 1) + curve(spark, 2, 40, 2) + curve(spark, 3, 3, 3), "c int, e double, sigma double").repartition(3)
    as_value = data.withColumnRenamed("sigma", "value")
    made = {
        "doppler": lambda: B.doppler(data, 293.6, 178.0, ["c"]),
        "slope": lambda: B.doppler_with_derivative(data.withColumn("a", F.lit(20.0)), 2000.0, "a", ["c"]),
        "gauss": lambda: B.gaussian_resolution(as_value, 25.0, 0.5, 0.02, ["c"]),
        "tail": lambda: B.gaussian_resolution(as_value, 25.0, 0.5, 0.01, ["c"], 2.5),
    }
    whole = {k: values(f()) for k, f in made.items()}
    monkeypatch.setattr(B, "BLOCK_ROWS", rows)
    for k, f in made.items():
        got = values(f())
        assert len(got) == 743
        assert got == whole[k], k


def test_rows_go_where_they_are_needed_alone(spark):
    """A narrow window copies no more than the margin and partition ends beyond each block."""
    data = spark.range(10_000).select(F.lit(1).alias("c"), (1.0 + F.col("id")).alias("e"), F.lit(1.0).alias("sigma"))
    out = B.halo_blocks(data, ["c"], (F.col("e") - 2.0, F.col("e") + 2.0), rows=1000)
    assert out.where("_own").count() == 10_000 and out.where("_own").select("_block").distinct().count() == 10
    extra = out.where("NOT _own").groupBy("_block").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count("*").alias("n")).collect()
    assert len(extra) == 10 and all(r["n"] <= 2 * (2 + B.MARGIN) + 3 * 2 * B.MARGIN for r in extra)
    for r in extra:
        first, last = 1.0 + 1000 * r["_block"], 1000.0 * (r["_block"] + 1)
        assert r["_block"] == 0 or r["a"] <= first - 2 - B.MARGIN
        assert r["_block"] == 9 or r["b"] >= last + 2 + B.MARGIN
