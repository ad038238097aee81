"""The pipeline's stages against plain versions of their decisions, on the smallest table."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_operators import plain_hits, plain_lines, plain_near
from tofcube.llm import quality
from tofcube.llm.common import work_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = work_table(docs, "docs")
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    tables = [docs]
    for _, stage in cp.STAGES:
        tables.append(work_table(stage(spark, tables[-1], SF), "t"))
    assert all(t.dtypes == docs.dtypes for t in tables[:-1])
    d0, d1, d2, d3, d4 = map(rows, tables[:-1])
    assert Counter(d1) == Counter((i, t) for i, t in d0 if quality.signals(t.encode(), quality.QualityRules())[-1])
    assert Counter(d2) == Counter((i, t) for i, _, _, t in plain_lines(d1, 3, "first"))
    kept = {i for i, _, _, k in plain_near(d2, 5, 80) if k}
    assert Counter(d3) == Counter((i, t) for i, t in d2 if i in kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = {i: plain_hits(t, items, 10) for i, t in d3}, dict(d4)
    assert {i for i, t in d3 if before[i][1] <= 0.5 * before[i][0]} == set(after)
    assert all(plain_hits(t, items, 10)[1] == 0 for t in after.values())
    assert all(after[i] == t for i, t in d3 if not before[i][1])
    packed = tables[-1].collect()
    size = Counter()
    for r in packed:
        size[r["doc_id"]] += r["size"]
    assert +size == +Counter({i: len(t.split()) for i, t in after.items()})
    filled = Counter()
    for r in packed:
        filled[r["bin"]] += r["size"]
    assert max(filled.values()) <= cp.CAPACITY


def test_run_and_stage_names(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    assert cp.ORACLE_SQL is None
