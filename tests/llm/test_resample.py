"""Importance resampling against a plain version, with orders above one, nulls, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tofcube.llm import resample

from .test_operators import EMPTY, corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, orders):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, r):
    bucket = lambda f: zlib.crc32(f.encode()) % r.buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, plain_features(x, r.orders)[1]))
    for _, x in target:
        t.update(map(bucket, plain_features(x, r.orders)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + r.buckets) / ((s[b] + 1) * (T + r.buckets)))) for b in range(r.buckets)]
    out = []
    for i, x in rows:
        words, f = plain_features(x, r.orders)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{r.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((x for x in out if x[1] >= r.min_words), key=lambda x: (-x[4], x[0] is not None, x[0]))
    for k, x in enumerate(fit):
        x.append(k + 1 if k < len(fit) * r.percent // 100 else None)
    return Counter(tuple(x) if len(x) == 6 else (*x, None) for x in out)


@pytest.mark.parametrize("orders,percent", [(1, 10), (3, 40)])
def test_resample(spark, orders, percent):
    rows = corpus(5)
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1])]
    target = [(1, "The quiet river, the QUIET river"), (2, None), (3, ""), (4, "mountain straße of the garden")]
    rules = resample.ResampleRules(orders=orders, buckets=97, min_words=12, percent=percent, seed=7)
    got = resample.resample(frame(spark, rows), frame(spark, target), rules)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(rows, target, rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    rows = [(1, "one two three"), (2, None)]
    rules = resample.ResampleRules(orders=2, buckets=11, min_words=0, percent=100)
    assert resample.resample(none, frame(spark, rows), rules).count() == 0
    assert Counter(map(tuple, resample.resample(frame(spark, rows), none, rules).collect())) == plain(rows, [], rules)


def test_more_like_the_target_is_drawn_more(spark):
    rows = [(i, ("river mountain garden " if i % 2 else "table window seven ") * 10) for i in range(400)]
    got = resample.resample(frame(spark, rows), frame(spark, [(0, "river mountain river garden " * 20)]), resample.ResampleRules(orders=2, percent=25))
    drawn = [r.doc_id % 2 for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(drawn) > 80


def test_no_texts_move_for_single_words(spark):
    """Words are counted where they are read: an exchange holds rows of documents or buckets, no words."""
    df = frame(spark, corpus(6))
    plan = resample.features(df.select(F.monotonically_increasing_id().alias("row"), "text"), ["row"], F.col("text"), resample.ResampleRules(orders=1))
    assert "Window" not in (p := plan._jdf.queryExecution().optimizedPlan().toString()) and "lead" not in p
    two = resample.features(df.select(F.monotonically_increasing_id().alias("row"), "text"), ["row"], F.col("text"), resample.ResampleRules(orders=2))
    text = two._jdf.queryExecution().executedPlan().toString()
    assert "lead(word" in text and text.count("Exchange hashpartitioning(row") == 1


def test_rules_are_checked():
    for bad in ({"orders": 0}, {"buckets": 0}, {"percent": 101}):
        with pytest.raises(ValueError):
            resample.ResampleRules(**bad)
