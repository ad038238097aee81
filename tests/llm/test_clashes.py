"""Columns of the input that are named as the operators' own, and rules of other lengths."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tofcube.llm import lines, near, quality

from .test_operators import corpus

NAMES = ["gone", "__gone", "gonefp", "GONE_", "n_lines", "n_dropped", "id", "fp", "component", "row", "key", "name", "text_", "kept"]


def test_near_duplicates_with_any_columns(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = df.withColumns({c: F.lit(3) for c in NAMES})
    got = near.drop_near_duplicates(wide)
    assert got.columns == wide.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in near.drop_near_duplicates(df).collect())


def test_lines_with_columns_named_as_the_counts(spark):
    df = spark.createDataFrame(corpus(4), "doc_id bigint, text string").withColumns({"n_lines": F.lit(1), "N_dropped": F.lit(2)})
    got = lines.dedup_lines(df, carry=("n_lines", "N_dropped"))
    assert got.columns == ["doc_id", "n_lines", "N_dropped", "text"] and {(r[1], r[2]) for r in got.collect()} == {(1, 2)}
    assert lines.dedup_lines(df, carry=("n_lines",)).columns == ["doc_id", "n_lines", "n_dropped", "text"]


def test_stages_keep_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(3) for c in NAMES})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        got = stage(spark, df, "/root/testdata/sf0.001")
        assert got.columns == df.columns and {r["n_lines"] for r in got.select("n_lines").collect()} <= {3}


def test_rules_of_other_lengths(spark):
    text = " ".join(f"w{k}" for k in range(60)) + " " + " ".join(["one two three four"] * 3)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    kept = lambda share: quality.quality_signals(df, quality.QualityRules(max_ngram_share=share)).first()["kept"]
    assert kept(((4, 0.9),)) and kept(((2, 1.0), (5, 1.0))) and not kept(((4, 0.01),)) and not kept(((2, 0.01), (7, 0.5)))
