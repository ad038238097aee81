"""The corpus pipeline: five stages, each over all documents that its predecessor kept.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; where a stage changes texts, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.llm import decontam, lines, near, packing, quality
from tofcube.llm.common import work_table

CAPACITY = 2048


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order and types, n_chars counted anew."""
    return out.select(*[(F.length("text") if c == "n_chars" else F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and length rules reject go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters found in 3 or more documents stay in the first of them alone."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return _as_documents(lines.dedup_lines(docs, min_chars=20, min_docs=3, keep="first", carry=carry), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near.drop_near_duplicates(docs, near.NearRules(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with benchmark items are cut; documents that are mostly such spans go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_documents(decontam.remove_benchmark(docs, benchmark, window=10, max_coverage=0.5), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of the training sequences: doc_id, piece, start and size in words, bin, bin_offset."""
    return packing.pack(docs, packing.word_count(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), capacity=CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
