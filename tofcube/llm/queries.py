"""The registered queries of the operators, over their whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.llm import concat, decontam, dialogue, lines, near, packing, quality, resample, shards, substrings, tokens, urls, warc

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


# -- 1 -----------------------------------------------------------------------------


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3, keep="last")
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


OP1_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, list_extract(ls, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE r.key IS NOT NULL AND keeper <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""

# -- 2 -----------------------------------------------------------------------------

URL_RULES = (
    urls.UrlRule("allow", "org/"),
    urls.UrlRule("block", "example.org/es/"),
    urls.UrlRule("block", "example.org/en/1"),
    urls.UrlRule("allow", "com/fr/"),
    urls.UrlRule("block", "com/de/"),
)
#: The SQL has no loop and so a number of rounds; the tables have no links between hosts, where one is enough.
URL_ROUNDS, URL_DAMPING, URL_LEAST = 8, 0.85, 0.05


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, damping=URL_DAMPING, min_distrust=URL_LEAST)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _op2_sql() -> str:
    ranked = sorted(URL_RULES, key=lambda r: (-len(r.place), r.place))
    fits = {r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in ranked}
    rule = " ".join(f"WHEN {fits[r]} THEN '{r.place}'" for r in ranked)
    ruled = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in ranked)
    ctes = [
        rf"n AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UP}', '{LOW}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM n)",
        "h AS (SELECT host, count(*) AS pages, count(*) FILTER (WHERE ruled = 'allow') AS allowed, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host)",
        rf"""l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS link FROM n)""",
        rf"d AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LOW}') AS dst FROM l)",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM d WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "f AS MATERIALIZED (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS share FROM e)",
        "b AS MATERIALIZED (SELECT dst AS src, src AS dst, links / sum(links) OVER (PARTITION BY src) AS share FROM e)",
        "t0 AS (SELECT host, allowed / (SELECT sum(allowed) FROM h) AS rank FROM h WHERE allowed > 0)",
        "s0 AS (SELECT host, blocked / pages AS rank FROM h WHERE blocked > 0)",
    ]
    for x, edges in (("t", "f"), ("s", "b")):
        for k in range(1, URL_ROUNDS + 1):
            ctes.append(f"{x}{k} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT dst AS host, {URL_DAMPING} * share * rank AS rank FROM {edges} JOIN {x}{k - 1} ON src = host UNION ALL SELECT host, {1 - URL_DAMPING} * rank FROM {x}0) GROUP BY host)")
    k = URL_ROUNDS
    rest = 1 - URL_DAMPING
    ctes.append(f"bad AS (SELECT s.host FROM s{k} s LEFT JOIN t{k} t ON s.host = t.host WHERE s.rank >= {URL_LEAST * rest!r}::DOUBLE AND s.rank / {rest!r}::DOUBLE > coalesce(t.rank / {rest!r}::DOUBLE * (SELECT count(*) FROM t0), 0))")
    return f"WITH {', '.join(ctes)} SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON j.host = bad.host"


# -- 3 -----------------------------------------------------------------------------


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS3 = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS3} AS w FROM documents),
b AS (SELECT item_id, {_WORDS3} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
ks AS (SELECT DISTINCT k FROM bw),
hits AS MATERIALIZED (SELECT doc_id, i, bw.k, item_id
         FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)) x
         JOIN bw ON x.win = bw.win AND x.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

# -- 4 -----------------------------------------------------------------------------


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts as sizes, 2048 words a bin; no two documents of one source or with equal texts share a bin."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), capacity=2048)


# -- 5 -----------------------------------------------------------------------------


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.near_duplicates(table(spark, sf_dir, "documents"), near.NearRules(shingle=2, percent=80))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh FROM w, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
g AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT y, c FROM r JOIN g ON doc_id = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

# -- 6 -----------------------------------------------------------------------------


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"), substrings.SubstringRules(min_len=50))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM d, unnest(range(0, n - 49)) AS t(i)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w JOIN f ON w.win = f.win AND doc_id > first),
r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM s),
o AS (SELECT d.doc_id, sum(b - a) AS gone, count(*) AS runs,
             string_agg(CASE WHEN k = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(nxt, n) - b)), '' ORDER BY a) AS rest
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

# -- 7 -----------------------------------------------------------------------------


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24, grown=[1.0] * 25)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# -- 8 -----------------------------------------------------------------------------


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


# -- 9 -----------------------------------------------------------------------------


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_signals(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op9_sql() -> str:
    rules = quality.QualityRules()
    word = r"[^\x20\x09-\x0D]+"
    ctes = [
        rf"d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents)",
        "x AS MATERIALIZED (SELECT doc_id, p, length(w[p]) AS chars FROM d, unnest(range(1, len(w) + 1)) AS t(p))",
        rf"l AS (SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda y: length(y)))) AS line_chars FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE k > 1 AND regexp_matches(line, '{word}') GROUP BY doc_id)",
    ]
    for n in (3, *quality.NGRAMS):
        ctes += [
            f"g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {n - 1} + 1)) AS t(i)))",
            f"c{n} AS MATERIALIZED (SELECT doc_id, count(*) AS words, sum(chars) AS chars FROM x JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM g{n} WHERE c > 1) USING (doc_id, p) GROUP BY doc_id)",
        ]
    base = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"
    limits = " AND ".join([f"line_chars <= {rules.max_line_share} * word_chars", *(f"coalesce(c{n}.chars, 0) <= {s} * word_chars" for n, s in rules.max_ngram_share)])
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = m.doc_id" for n in (3, *quality.NGRAMS))
    return f"""WITH {", ".join(ctes)},
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(line_chars, 0) AS line_chars
      FROM d LEFT JOIN l USING (doc_id)),
r AS (SELECT m.*, coalesce(c3.words, 0)::BIGINT AS n_repeat_words, {limits} AS fine FROM m {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND fine AS kept FROM r"""


# -- 10 ----------------------------------------------------------------------------


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives against a second replica of them with planted damage: the page
    text of ids that leave 13 modulo 97 has its last character replaced, and records of ids that
    leave 5 modulo 211 are lost, so that what follows them in their archive moves up. One row per
    record of the first, with what the audit finds."""
    pages = table(spark, sf_dir, "pages")
    spoilt = F.when(F.col("page_id") % 97 == 13, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("\u0000"))).otherwise(F.col("html"))
    record = lambda html: warc.record_bytes(F.col("page_id"), F.col("url"), html)
    records = pages.select("page_id", record(F.col("html")).alias("bytes"), F.sha2(record(spoilt).cast("binary"), 256).alias("sha_b"))
    first = warc.work_table(warc.archive_index(records, "page_id", "bytes", extra=("sha_b",)), "warc-index")
    second = warc.without(first, F.col("page_id") % 211 == 5).withColumn("sha256", F.col("sha_b"))
    found = warc.audit(first, warc.work_table(second, "warc-index")).where("status <> 'extra'")
    found = found.select(F.col("archive").alias("f_archive"), F.explode(F.sequence("ordinal", "last")).alias("f_ordinal"), "status")
    out = first.join(found, (F.col("archive") == F.col("f_archive")) & (F.col("ordinal") == F.col("f_ordinal")), "left")
    return out.select("page_id", "archive", "ordinal", "start", "stop", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))


# -- 11 ----------------------------------------------------------------------------

RESAMPLE = resample.ResampleRules(orders=1, buckets=10000, min_words=20, percent=10, seed=2024)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), RESAMPLE)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str, tab: str = "crc_t") -> str:
    """The CRC-32 of a text in SQL, byte by byte; CRC_TABLE gives the column of its 256 entries."""
    h = f"hex(encode({text}))"
    each = f"list_transform(range(length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 8, {tab}[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_t)"

OP11_SQL = rf"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, {_WORDS3} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
y AS MATERIALIZED (SELECT unnest({_WORDS3}) AS word FROM benchmark),
k AS MATERIALIZED (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM x UNION ALL SELECT word FROM y)), crc),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT bucket, 1 AS s, 0 AS t FROM x JOIN k USING (word) UNION ALL SELECT bucket, 0, 1 FROM y JOIN k USING (word)) GROUP BY bucket)),
v AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM x JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
s AS MATERIALIZED (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || sha256('2024:' || doc_id::VARCHAR)[1:8])::BIGINT AS h FROM d LEFT JOIN v USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM s),
r AS (SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS rn, count(*) FILTER (WHERE n_features >= 20) OVER () AS fits FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND rn <= fits * 10 // 100 THEN rn END AS rank FROM r
"""

# -- 12 ----------------------------------------------------------------------------


def op12_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = concat.concatenate_and_cut(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), capacity=1024, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# -- 13 ----------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the contract states; nulls are one space, in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = dialogue.repair(damaged(rows)).withColumnRenamed("conv_id", "f_conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", sha256(F.lit(""))).alias("repaired_sha256"))


def _op13_sql() -> str:
    """Backwards over the rows, each state's cheapest edits to the end as text: the cost in eight digits, then the letters, so that the least text is the least cost and then the least in ASCII."""
    add = lambda v, cost, letter: f"(lpad((({v}[1:8])::BIGINT + {cost})::VARCHAR, 8, '0') || '{letter}' || {v}[9:])"
    initials, edit = "sua", []
    for q in range(4):
        keep = " ".join(f"WHEN initial = '{initials[k]}' THEN {add(f'v{dialogue.SAID[q][k]}', 'cut', 'K')}" for k in range(3) if dialogue.SAID[q][k] >= 0)
        edit.append(f"least({add(f'v{q}', 3, 'D')}, CASE WHEN NOT gone THEN {add(f'v{dialogue.NEXT[q]}', '2 + cut', 'R')} ELSE '9' END, CASE WHEN gone THEN '9' {keep} ELSE '9' END) AS e{q}")
    put = []
    for q in range(4):
        one = add(f"e{dialogue.NEXT[q]}", 2, "I")
        two = add(f"e{dialogue.NEXT[dialogue.NEXT[q]]}", 4, "II")
        put.append(f"least(e{q}, {one}, {two}) AS v{q}")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS d FROM conversations, crc),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, rtrim(text, {white}) AS bare FROM x),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup FROM n),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, k, blank, dup, left(role, 1) AS initial, blank OR dup AS gone, CASE WHEN NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM f),
p AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM r),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, sum(cut)::BIGINT AS truncated,
      count(*) FILTER (WHERE prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM p GROUP BY conv_id),
t AS (
  SELECT conv_id, n + 1 AS k, '00000000' AS v0, '00000004II' AS v1, '00000002I' AS v2, '00000000' AS v3 FROM s
  UNION ALL
  SELECT conv_id, k, {", ".join(put)} FROM (SELECT t.conv_id, r.k, {", ".join(edit)} FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.k - 1)
),
a AS MATERIALIZED (SELECT conv_id, v0[1:8]::BIGINT AS cost, v0[9:] AS audit FROM t WHERE k = 1),
l AS (SELECT conv_id, j, audit[j] AS letter FROM a, unnest(range(1, length(audit) + 1)) AS u(j)),
m AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS k, count(*) FILTER (WHERE letter <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
o AS (SELECT m.conv_id, j, letter, place, r.role, r.text, max(CASE WHEN place = 1 AND letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS headed
      FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.k = m.k AND letter <> 'I' WHERE letter <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS repaired FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_merkle_audit": op10_merkle_audit,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_concatenate_and_cut": op12_concatenate_and_cut,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_url_filter": _op2_sql(),
    "op3_decontamination": OP3_SQL,
    "op5_near_duplicates": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_quality_rules": _op9_sql(),
    "op11_importance_resampling": OP11_SQL,
    "op13_conversation_repair": _op13_sql(),
}
