"""Null item ids, long items, runs of special strings, and the queries that have no SQL, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORDS, frame, plain_hits, warc_pages
from tofcube.llm import common, decontam, packing, queries, tokens, warc

SF = "/root/testdata/sf0.001"


def test_items_without_ids_and_long_items(spark):
    rnd = random.Random(2)
    items = [(None, "one two three four five six"), (None, "two three four"), (3, "five six seven"), (4, " ".join(rnd.choices(WORDS[:6], k=400)))]
    docs = [(1, "x one two three four five six seven"), (2, "none here"), (3, " ".join(rnd.choices(WORDS[:6], k=300)) + items[3][1][50:300])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(frame(spark, docs), bench, window=4).collect()}
    for i, t in docs:
        n, hit, found = plain_hits(t, items, 4)
        assert got[i] == (n, hit, [x for x in found if x != "None"])
    # pieces of a long item have its windows
    blocks = list(decontam.item_blocks(bench, "item_id", "text", 1 << 20, 4, most_words=30))
    windows = lambda ts: {tuple(w[i : i + 4]) for t in ts for w in [decontam.words_of(t)] for i in range(len(w) - 3)}
    assert len(blocks) > 10 and all(sum(len(t.split()) for t in ts) <= 30 for _, ts in blocks)
    assert windows([t for ns, ts in blocks for n, t in zip(ns, ts, strict=True) if n == "4"]) == windows([items[3][1].encode()])


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


def test_runs_of_special_strings_and_long_chunks(spark, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = [(1, "<|endoftext|>" * 2000), (2, "a<|endoftext|>" * 3 + "<|startoftext|>" + "b" * 5000), (3, "straße" * 3000), (4, "x1!" * 4000)]
    got = dict(map(tuple, tokens.token_counts(frame(spark, rows), vocabulary).select("doc_id", "n_tokens").collect()))
    assert got == {i: count(t) for i, t in rows}
    c = tokens.counter(vocabulary)
    for t in ("b" * 3000, "straße" * 40, "x1!'re" * 300, "internationalization's", "don't!?'' 12"):
        for budget in (0, 1, 2, 5, 17):
            head, n = c.truncate(t.encode(), budget)
            k = len(head.decode())
            assert t.startswith(head.decode()) and n == count(head.decode()) <= budget
            assert not any(count(t[:j]) <= budget for j in range(k + 1, min(len(t), k + 40) + 1) if t[j - 1].strip())


def test_token_query(spark, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r in rows for n in [len(tok.encode(r["text"] or "", add_special_tokens=False).ids)])
    got = queries.op8_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert Counter(map(tuple, got.collect())) == want


def test_sharding_query(spark):
    def shard(i, n):
        score = lambda s: -math.log((int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        return min(range(n), key=lambda s: (score(s), s))

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_sharding(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t), "key", shard(i, 24), shard(i, 25)) for i, t in docs.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op4_best_fit_packing(spark, SF).collect()
    # 200 documents are one group: the plain packing of all, ordered as stated
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    order = sorted(docs, key=lambda r: (r["doc_id"], r["source"], md5(r["text"])))
    plan = packing.best_fit([len((r["text"] or "").split()) for r in order], [r["source"] for r in order], [md5(r["text"]) for r in order], 2048)
    want = Counter((r["doc_id"], k, start, n, f"g0-{b}", at) for r, pieces in zip(order, plan, strict=True) for k, (start, n, b, at) in enumerate(pieces))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["size"], r["bin"], r["bin_offset"]) for r in got if r["bin"]) == want
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs}


def test_layout_does_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.where("doc_id < 5")
    docs = docs.unionByName(few).unionByName(few)
    packed = lambda d: Counter(map(tuple, packing.pack(d, packing.word_count(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), group_rows=40).collect()))
    assert packed(docs.repartition(7)) == packed(docs.coalesce(1).orderBy("text"))
    index = lambda d: Counter(map(tuple, warc.archive_index(d, "page_id", "bytes", archive_rows=64).collect()))
    pages = warc_pages(spark)
    assert index(pages.repartition(5)) == index(pages.coalesce(1).orderBy("html"))


def test_tree_hashes(spark):
    """Ranges, archives, a level and the root against hashlib."""
    index = common.work_table(warc.archive_index(warc_pages(spark, 40), "page_id", "bytes", archive_rows=8), "idx")
    cuts = {r["record_key"] for r in index.where(F.pmod(F.xxhash64("record_key"), F.lit(3)) == 0).collect()}
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    rows, ranges = sorted(index.collect(), key=lambda r: (r["archive"], r["ordinal"])), []
    for r in rows:
        if not ranges or ranges[-1][-1]["archive"] != r["archive"] or ranges[-1][-1]["record_key"] in cuts:
            ranges.append([])
        ranges[-1].append(r)
    leaf = lambda g: sha(f"{len(r['record_key'].encode())}:{r['record_key']}:{r['start'] - g[0]['start']}:{r['stop'] - g[0]['start']}:{r['sha256']}" for r in g)
    want = [(g[0]["archive"], g[0]["ordinal"], g[-1]["ordinal"], g[0]["start"], g[-1]["stop"], leaf(g)) for g in ranges]
    leaves = warc.merkle_leaves(index, 3)
    assert sorted(map(tuple, leaves.select("archive", "ordinal", "last", "start", "stop", "hash").collect())) == want and len(want) > 10
    level = {k: sha(f"{s}:{e}:{h}" for a, _, _, s, e, h in want if a == k) for k in {w[0] for w in want}}
    for table in warc.merkle_levels(leaves, 4, 2):
        assert dict(map(tuple, table.collect())) == level
        level = {k: sha(f"{n}:{h}" for n, h in sorted(level.items()) if n // 4 == k) for k in {n // 4 for n in level}}
    assert table.count() == 1
    raw = {r["page_id"]: r["bytes"] for r in warc_pages(spark, 40).collect() if r["page_id"] not in (5, None)}
    assert all(r["sha256"] == sha([raw[r["page_id"]]]) for r in rows if r["page_id"] in raw)


def test_ten_megabyte_text(spark, vocabulary):
    """One very long text for the operators whose work within a text isn't plain splitting."""
    from tofcube.llm import lines, near, quality, substrings

    rows = [(1, "q" * 10_000_000), (2, "word " * 2_000_000), (3, "q" * 200 + " other"), (4, "w line of twenty or more characters\n" * 250_000)]
    docs = frame(spark, rows, extra=False)
    cut = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substrings.dedup_substrings(docs).drop("kept").collect()}
    assert cut == {1: (0, 0), 2: (0, 0), 3: (200, 1), 4: (0, 0)}
    got = {r["doc_id"]: r["n_words"] for r in decontam.decontaminate(docs, spark.createDataFrame([(1, "word word word")], "item_id bigint, text string"), window=3).collect()}
    assert got == {1: 1, 2: 2_000_000, 3: 2, 4: 7 * 250_000}
    assert near.near_duplicates(docs).where("kept").count() == 4
    assert {r["doc_id"] for r in quality.quality_signals(docs).where("kept").collect()} == set()
    assert lines.dedup_lines(docs, min_docs=2).agg(F.sum("n_dropped")).first()[0] == 0
    assert dict(map(tuple, tokens.token_counts(docs.where("doc_id <> 1"), vocabulary).select("doc_id", "n_tokens").collect()))[2] == 2_000_000
