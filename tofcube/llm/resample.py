"""Importance resampling towards a target distribution, by position tables of n-grams.

A text's words are exploded with their positions; for each order above one, window lead() over a
document's positions puts the following words beside each word. Every run of words is a feature,
hashed into a bucket. The buckets of both corpora are counted with map-side partials into a table
of `buckets` rows, which gives each bucket its gain: the floored thousandfold log ratio of the
smoothed shares. Features meet the gains by bucket, and a document's weight is the floored mean
of its gains. Gumbel noise from a hash of the document's id makes a draw without replacement:
the highest scores are taken.

The gains are broadcast: their number is the parameter `buckets`, at most MOST_BUCKETS, whatever
the data. Texts are exploded where they are read for order one; for higher orders each text moves
once, by its row number, so that its positions are sorted in one place. Ranks are numbers within
range partitions of (score, id) plus the counts of the partitions before, so a hot source, very
many equal scores or copies of a row are spread.

Defined cases: a null or empty text has no words, no features and weight 0; a null id hashes as
the text 'null' and comes first among ties; repeated rows are drawn each; an empty table gives an
empty result and an empty target only the smoothed counts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.llm.common import lower_ascii, work_table

MOST_BUCKETS = 1 << 20
#: A word: digits, letters and all that isn't ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleRules:
    """orders: the longest run of words that is a feature. percent: of the documents with min_words words or more, so many are drawn."""

    orders: int = 2
    buckets: int = 10000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024

    def __post_init__(self):
        if self.orders < 1 or not 1 <= self.buckets <= MOST_BUCKETS or not 0 <= self.percent <= 100:
            raise ValueError(f"orders from 1, buckets from 1 to {MOST_BUCKETS} and percent from 0 to 100 are needed")


def positions(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, pos, word: one row per word; one with nulls where there is none."""
    return docs.select(*keys, F.posexplode_outer(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))).alias("pos", "word"))


def features(rows: DataFrame, keys: list[str], text: Column, rules: ResampleRules) -> DataFrame:
    """keys, pos, bucket: one row per feature; one with a null bucket for a text without words. The first key numbers the rows."""
    bucket = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(rules.buckets)).cast("int")
    if rules.orders == 1:
        return positions(rows, keys, text).select(*keys, "pos", bucket(F.col("word")).alias("bucket"))
    words = positions(rows.repartition(keys[0]), keys, text)
    ahead = W.partitionBy(keys[0]).orderBy("pos")
    words = words.withColumns({f"word{k}": F.lead("word", k).over(ahead) for k in range(1, rules.orders)})
    runs, run = [F.struct(F.lit(1).alias("order"), bucket(F.col("word")).alias("bucket"))], F.col("word")
    for k in range(1, rules.orders):
        run = F.concat(run, F.lit(" "), F.col(f"word{k}"))  # null beyond the text's end
        runs.append(F.struct(F.lit(k + 1).alias("order"), bucket(run).alias("bucket")))
    return words.select(*keys, "pos", F.inline(F.array(*runs))).where("order = 1 OR bucket IS NOT NULL").drop("order")


def bucket_gains(docs: DataFrame, target: DataFrame, text: Column, target_text: Column, rules: ResampleRules) -> DataFrame:
    """bucket, gain: one row per bucket. Two totals reach the driver."""

    def counts(df: DataFrame, t: Column, name: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("row"), t.alias("t"))
        return features(rows, ["row"], F.col("t"), rules).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    every = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(docs, text, "s"), "bucket", "left").join(counts(target, target_text, "t"), "bucket", "left").fillna(0)
    both = work_table(both, "bucket-counts")
    raw, wanted = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    n = float(rules.buckets)
    share = ((F.col("t") + 1.0) * F.lit(raw + n)) / ((F.col("s") + 1.0) * F.lit(wanted + n))
    return both.select("bucket", F.floor(F.ln(share) * 1000.0).cast("bigint").alias("gain"))


def noise(id_col: Column, seed: int) -> Column:
    """The floored thousandfold Gumbel variable of an id: its uniform number is made of 32 bits of SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000.0).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:  # noqa: B008
    """id, n_words, n_features, weight and score of every document."""
    gains = bucket_gains(docs, target, F.col(text_col), F.col(target_text_col), rules)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = features(rows, ["row", "id"], F.col("t"), rules)
    found = found.join(F.broadcast(gains.withColumnRenamed("bucket", "g_bucket")), F.col("bucket") == F.col("g_bucket"), "left")
    n, total = F.count("bucket"), F.coalesce(F.sum("gain"), F.lit(0))
    sums = found.groupBy("row", "id").agg(n.alias("n_features"), total.alias("total"), (F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("bigint").alias("n_words"))
    # whole numbers throughout: the remainder is taken off before dividing
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("bigint")
    out = sums.select("id", "n_words", "n_features", mean.alias("weight"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), rules.seed)).alias("score"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank (from 1) in this order: sorted by ranges, written once, numbered within each partition and moved by the counts before it."""
    placed = work_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("c_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("c_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("c_part", before.alias("before"))  # a row for each shuffle partition, at most
    out = placed.join(F.broadcast(before), part == F.col("c_part"))
    return out.withColumn("rank", F.col("at") - F.shiftleft(part, 33) + F.col("before") + 1).drop("at", "c_part", "before")


def resample(docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:  # noqa: B008
    """id, n_words, n_features, weight, score, rank: every document; rank is null where it isn't drawn."""
    scored = weigh(docs, target, rules, id_col, text_col, target_text_col)
    scored = work_table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= rules.min_words
    draws = scored.where(fit).count() * rules.percent // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("row").asc()]
    drawn = ranked(scored.where(fit), order).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).drop("row")
