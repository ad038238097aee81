"""As-of, bracket and interval joins against plain searches, over many partitions and hot keys."""

import random
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tofcube.operators import models
from tofcube.operators.asof import asof, bracket, in_intervals


def data(seed, keys=4, n=300, m=40):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([*range(keys), 0, 0, 0, None])  # a hot key and null
    points = [(i, key(), rnd.choice([None, *[rnd.randrange(60) / 2 for _ in range(20)]])) for i in range(n)]
    table = {(k, rnd.randrange(60) / 2): rnd.randrange(1000) for k in [rnd.randrange(keys - 1) for _ in range(m)]}
    return points, [(k, x, v) for (k, x), v in table.items()]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_bracket(spark, parts):
    points, table = data(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        p = spark.createDataFrame(points, "id int, k int, x double").repartition(5).withColumn("row", F.lit(1))
        t = spark.createDataFrame(table, "k int, x double, v int")
        got = {r["id"]: (r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in bracket(p, t, ["k"]).collect()}
        last = {r["id"]: r["v"] for r in asof(p, t, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(points)
    for i, k, x in points:
        own = sorted((a, v) for b, a, v in table if b == k) if x is not None else []
        at = bisect_right([a for a, _ in own], x) if own else 0
        assert got[i] == (own[at - 1] if at else None, own[at] if at < len(own) else None)
        assert last[i] == (own[at - 1][1] if at else None)


def test_without_a_key_and_empty(spark):
    p, t = spark.createDataFrame([(1, 3.0), (2, 0.5)], "id int, x double"), spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, v string")
    assert {(r["id"], r["v"]) for r in asof(p, t, []).collect()} == {(1, "b"), (2, None)}
    assert {r["v"] for r in asof(p, t.limit(0), []).collect()} == {None}
    assert asof(p.limit(0), t, []).count() == 0


@pytest.mark.parametrize("both", [False, True])
def test_intervals(spark, both):
    rnd = random.Random(7)
    intervals = []
    for k in range(3):  # apart, some of them touching
        at = 0.0
        for n in range(6):
            at += rnd.choice([0, 0, 1])
            intervals.append((k, at, at + 2.0, 10 * k + n))
            at += 2.0
    intervals += [(3, 0.0, 10.0, 90), (3, 2.0, 4.0, 91), (3, 4.0, 6.0, 92), (3, 5.0, 12.0, 93)]  # overlapping
    points = [(i, rnd.randrange(5), rnd.randrange(-2, 60) / 2) for i in range(400)]
    got = in_intervals(spark.createDataFrame(points, "id int, k int, x double"), spark.createDataFrame(intervals, "k int, a double, b double, n int"), "k", "x", "a", "b", both)
    starts = {(k, a) for k, a, _, _ in intervals}
    follow = {}
    for k in range(4):
        own = sorted(x for x in intervals if x[0] == k)
        follow |= {x: x[2] == y[1] for x, y in zip(own, own[1:], strict=False)}
    want = Counter((i, k, x, a, b, n) for i, k, x in points for iv in intervals for k2, a, b, n in [iv] if k2 == k and a <= x and (x < b or x == b and (both or not follow.get(iv, False))))
    assert starts and Counter(map(tuple, got.collect())) == want


def test_plan_has_no_join_on_a_range(spark):
    """Each point meets one row of the ends of its partition; no condition compares x in a join."""
    x = spark.createDataFrame([(1, 2.0)], "k int, x double")
    table = spark.createDataFrame([(1, 0.0, 1.0, 2), (1, 4.0, 3.0, 2)], "k int, x double, y double, law int")
    out = models.interpolate(x, table, ["k"])
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "_part" in joins[0] and "<" not in joins[0].replace("<=>", "") and ">" not in joins[0].replace("<=>", "")
    assert out.collect()[0]["y"] == 2.0
