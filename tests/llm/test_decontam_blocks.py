"""remove_benchmark gives the same for any size of block."""

import random
from collections import Counter

from tests.llm.test_operators import WORDS, frame, plain_hits
from tofcube.llm import decontam


def run(spark, docs, items, block_bytes, **k):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return Counter((r["doc_id"], r["text"]) for r in decontam.remove_benchmark(frame(spark, docs), bench, block_bytes=block_bytes, **k).collect())


def test_coverage_is_judged_over_all_blocks(spark):
    a, b, rest = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 6), ("b", 6), ("c", 8)))
    docs = [(1, f"{a} {rest} {b}"), (2, f"{rest} {rest} {a} {b}"), (3, None), (4, "")]
    for size in (1 << 20, 10):
        assert {i for i, _ in run(spark, docs, [(1, a), (2, b)], size, window=6)} == {2, 3, 4}


def test_cut_ends_meet_in_a_window_of_an_earlier_block(spark):
    a, b = "a1 a2 a3 a4", "b1 b2 b3 b4"
    docs = [(1, f"w x y z u v a1 a2 {b} a3 a4 p q r s")]
    for size in (1 << 20, 4):
        assert [t.split() for _, t in run(spark, docs, [(1, a), (2, b)], size, window=4)] == [list("wxyzuvpqrs")]


def test_same_for_any_block(spark):
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choices(WORDS[:4], k=rnd.randint(2, 12)))) for k in range(2, 26)] + [(90, None), (91, "")]
    docs = [(i, " ".join(rnd.choices(WORDS[:6], k=rnd.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    whole = run(spark, docs, items, 1 << 20, window=5, max_coverage=0.4)
    assert 5 < sum(whole.values()) < len(docs)
    assert all(plain_hits(t, items, 5)[1] == 0 for _, t in whole)
    assert run(spark, docs, items, 60, window=5, max_coverage=0.4) == whole
