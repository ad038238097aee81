"""Numbers, neighbours and kept values over many partitions, and the extended grid, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube.operators import axes, grids, models
from tofcube.operators.ordering import kept_values, numbered, placed, with_previous


@pytest.fixture(params=[1, 23])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_kept(values, rel, floor=1e-30):
    out = []
    for v in sorted(values):
        if not out or v > out[-1] + max(abs(out[-1]), floor) * rel:
            out.append(v)
    return out


def test_numbers_and_neighbours(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice([1, 1, 1, rnd.randrange(50)]), k) for k in range(400)]  # a value that most rows share
    df = spark.createDataFrame(rows, "v int, k int").repartition(6)
    got = {r["k"]: r["rank"] for r in numbered(df, [F.desc("v"), F.col("k")]).collect()}
    assert got == {k: n + 1 for n, (_, k) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    order = sorted(rows, key=lambda x: (x[1]))
    prev = {r["k"]: r["previous"] for r in with_previous(placed(df, [F.col("k")]), "v").collect()}
    assert prev == {k: (order[n - 1][0] if n else None) for n, (_, k) in enumerate(order)}
    assert numbered(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize("rel", [0.0, 1e-3, 0.05, 0.5])
def test_kept_values(spark, parts, rel):
    rnd = random.Random(3)
    values = [rnd.choice([1, -1]) * rnd.random() * 10 ** rnd.randrange(-3, 4) for _ in range(300)] + [0.0, 0.0, 1e-31, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double").repartition(5)
    got = sorted(tuple(r) for r in kept_values(df, rel).collect())
    assert got == list(enumerate(plain_kept(values, rel)))
    assert kept_values(df.limit(0), rel).count() == 0


def test_one_long_run(spark, parts):
    """Every value is near the next: one chain of thousands, in a few rounds of doubling."""
    values = [100.0 + k * 0.001 for k in range(4000)]
    got = [r["value"] for r in sorted(axes.dedup_sorted(spark.createDataFrame([(v,) for v in values], "value double"), 5e-5).collect())]
    assert got == plain_kept(values, 5e-5)


def test_rank_has_no_exchange_to_one_partition(spark):
    matrix = spark.range(9).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("energy"), F.lit(0.5).alias("sigma_n"))
    traces = spark.range(90).select((F.col("id") % 10).alias("iso"), (F.col("id") % 10).alias("ordinal"), F.floor(F.col("id") / 10).cast("int").alias("i"), (F.col("id") % 7 * 100.0).alias("sigma"))
    out = models.detectability(matrix, traces, 0.001, 1e4)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 11))
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert all("_part" in x for x in windows)


def width(x, dt=2.0, dl=0.05):
    return math.hypot(2 * dt * x**1.5 / (72.2982543928 * 25), 2 * dl * x / 25)


def test_extended_grid(spark):
    e = np.linspace(5.0, 8.0, 31)
    axis = spark.createDataFrame([(float(x),) for x in e], "value double")
    res = spark.createDataFrame([(6.67, 1e-3), (50.0, 1e-3), (6.67, 1e-3), (5.0, 1e-40), (7.5, 2.0)], "energy double, width double")
    rows = sorted(map(tuple, grids.extended_grid(axis, 25.0, 2.0, 0.05, resonances=res).collect()))
    grid, own = np.array([r[1] for r in rows]), {r[2]: r[1] for r in rows if r[2] is not None}
    assert [r[0] for r in rows] == list(range(len(rows))) and np.allclose([own[k] for k in range(31)], e, rtol=1e-9, atol=0)
    assert (np.diff(grid) > 0).all() and grid[0] <= 5 - 5 * width(5.0) and grid[-1] >= 8 + 5 * width(8.0)
    middle = 0.5 * (grid[1:] + grid[:-1])  # of a part, where the rule takes the whole gap's
    assert (np.diff(grid) <= [0.25 * width(x) * 1.05 for x in middle]).all()
    assert ((grid > 6.669) & (grid < 6.671)).sum() >= 10
    # ends: even steps in the root, the mean of the outermost five points'
    root = np.sqrt(e)
    for n, (step, at, sign) in enumerate([((root[4] - root[0]) / 4, root[0], -1), ((root[-1] - root[-5]) / 4, root[-1], 1)]):
        for k in (1, 2):
            assert np.abs(grid - (at + sign * step * k) ** 2).min() < 1e-9, n
    # around the narrow resonance: steps of 2 / 14 of its width, then 2, 4, ... of them further
    step = 2e-3 / 14
    for x in [6.669 + step * k for k in range(15)] + [6.671 + step * (2 ** (m + 1) - 2) for m in (1, 2, 3)] + [6.669 - step * (2 ** (m + 1) - 2) for m in (1, 2, 3)]:
        assert np.abs(grid - x).min() < 1e-8
    edge = grids.extended_grid(axis, 25.0, 2.0, 0.05, 1.5, between=False).collect()
    v = np.array(sorted(r["value"] for r in edge))
    assert ((v > 5) & (v < 8)).sum() == 29 and v[-1] > grid[-1] and sum(r["own"] is not None for r in edge) == 31
    assert [tuple(r) for r in grids.extended_grid(axis.limit(1), 25.0, 2.0, 0.05).collect()] == [(0, 5.0, 0)]


def test_gaps_and_edges_of_the_grid(spark):
    """A resonance at the grid's first point has nothing below it; a grid with enough points in its width gets none."""
    grid = spark.createDataFrame([(k, 10.0 + 0.1 * k) for k in range(50)], "i bigint, value double")
    points = lambda e, w: sorted(r["value"] for r in grids.resonance_points(grid, spark.createDataFrame([(e, w)], "energy double, width double")).collect())
    assert points(12.0, 1.0) == []
    low = points(10.0, 0.01)
    assert low[0] == pytest.approx(9.99) and all(x < 10.1 for x in low)
    assert points(12.05, 0.46) == [] and points(12.05, 0.44) != []  # ten points, and eight
    assert grids.gap_points(grid.select("value"), lambda x: F.lit(0.41)).count() == 0
    assert grids.gap_points(grid.select("value"), lambda x: F.lit(0.21)).count() == 49
