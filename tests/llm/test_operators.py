"""The operators against plain versions on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tofcube.llm import common, decontam, lines, near, packing, quality, shards, substrings, tokens, urls, warc

WORDS = "the of and to ingreat shon löwe étoile über straße river mountain seven eleven quiet table window garden".split()


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    common_lines = [" ".join(rnd.choices(WORDS, k=8)) for _ in range(4)]
    out = []
    for i in range(n):
        rows = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 14))) for _ in range(rnd.randint(0, 6))]
        if i % 3 == 0:
            rows.insert(rnd.randint(0, len(rows)), rnd.choice(["", "  ", "\t"]) + rnd.choice(common_lines).upper())
        out.append((i, "\n".join(rows)))
    for i in range(n, n + 12):  # copies and near copies
        t = out[rnd.randrange(n)][1]
        out.append((i, t if i % 2 else t + " tail"))
    return out + [(n + 20, None), (n + 21, ""), (n + 22, " \n\t"), (n + 23, "x" * 5000), (n + 24, "ab " * 4000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # columns whose names the operators use themselves
    return df.withColumns({c: F.lit(7) for c in ("id", "key", "n", "n_words", "keys", "row", "spans", "rank", "bin", "size")}) if extra else df


EMPTY = "doc_id bigint, text string"
sha = lambda b: hashlib.sha256(b).hexdigest()


# -- line dedup -----------------------------------------------------------------------


def plain_lines(rows, min_docs, keep):
    holders = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for key in {lines.line_key(x) for x in (t or "").encode().split(b"\n")}:
            if len(key.decode()) >= 20:
                holders[key].append(i)
    keeper = {k: (min if keep == "first" else max)([x for x in v if x is not None], default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        old = (t or "").encode().split(b"\n")
        new = [x for x in old if keeper.get(lines.line_key(x), i) == i]
        out.append((i, len(old), len(old) - len(new), b"\n".join(new).decode()))
    return Counter(out)


@pytest.mark.parametrize("min_docs,keep", [(2, "first"), (3, "last")])
def test_line_dedup(spark, min_docs, keep):
    rows = corpus(1)
    rows += [rows[3], rows[3], (None, rows[0][1])]
    for most in (1 << 20, 0):  # confirmed keys broadcast, and joined
        got = lines.dedup_lines(frame(spark, rows), min_docs=min_docs, keep=keep, max_key_bytes=most)
        assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == plain_lines(rows, min_docs, keep)


def test_line_dedup_small_filter_and_carry(spark):
    rows = corpus(2)
    got = lines.dedup_lines(frame(spark, rows), min_docs=3, keep="last", carry=("key", "row"), max_filter_log2=16)
    assert got.columns == ["doc_id", "key", "row", "n_lines", "n_dropped", "text"]
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == plain_lines(rows, 3, "last")
    assert lines.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_twice_filter_never_misses(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    h = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    twice = np.concatenate((h[:1000], h[:1000], h))
    rows = [(p, v) for part in np.array_split(rnd.permutation(twice), 7) for p, v in common.route(part, 6)]
    f, heavy = common.twice_filter(spark.createDataFrame(rows, common.PACKED), 7000, 6, 18, heavy_at=3)
    assert f.test(h[:1000]).all()
    assert f.test(h[1000:]).mean() < 0.1
    assert set(heavy) >= set(common.short(h[:1000], 6).tolist()) and set(heavy.values()) <= {2, 3}


# -- url rules -------------------------------------------------------------------------


def test_url_rules_and_links(spark):
    rules = [urls.UrlRule("allow", "org/"), urls.UrlRule("block", "example.org/en/1"), urls.UrlRule("block", "bad.com/")]
    link = lambda h: f'<a class="x" href="https://{h}/x">l</a> <a href="/own">o</a>'
    pages = [
        (1, "http://Good.ORG/a?x", link("friend.net")),
        (2, "https://example.org/en/12#t", None),
        (3, "http://bad.com/", ""),
        (4, "http://spam.net/p", link("bad.com") + link("bad.com")),
        (5, "http://friend.net/q", link("bad.com")),
        (6, "http://far.net/", link("spam.net")),
        (7, None, "x"),
        (8, "mailto:x", "<a href=//bad.com/y>"),
        (9, "http://lonely.net", None),
        (9, "http://lonely.net", None),
        (10, "http://notbad.com.au/", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rank", F.lit(1)).withColumn("src", F.lit("x"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(df, rules).collect()}
    assert got[1] == ("good.org", "/a", "org/", "allow", False)
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block", False)
    assert got[3][3] == "block" and got[3][2] == "bad.com/"
    assert got[4] == ("spam.net", "/p", None, "block", True)
    assert got[6][3] == "block"  # two steps away
    assert got[7] == ("", "", None, "allow", True) and got[8][:2] == ("", "")
    assert got[9] == ("lonely.net", "", None, "allow", True)
    assert got[10][3] == "allow"
    assert urls.judge_urls(df, rules).count() == len(pages)
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert urls.judge_urls(df, []).where("verdict = 'block'").count() == 0


def test_pagerank_matches_plain(spark):
    rnd = random.Random(3)
    edges = {(f"h{rnd.randrange(12)}", f"h{rnd.randrange(12)}") for _ in range(40)}
    edges = [(a, b, rnd.randint(1, 4)) for a, b in edges if a != b]
    seeds = [("h1", 0.5), ("h2", 0.5)]
    got = {r["host"]: r["rank"] for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, links bigint"), spark.createDataFrame(seeds, "host string, seed double"), 5, 0.85).collect()}
    total = Counter()
    for a, _, n in edges:
        total[a] += n
    rank = dict(seeds)
    for _ in range(5):
        new = {h: 0.15 * s for h, s in seeds}
        for a, b, n in edges:
            if a in rank:
                new[b] = new.get(b, 0) + 0.85 * n / total[a] * rank[a]
        rank = new
    assert got.keys() == rank.keys() and all(math.isclose(got[h], rank[h]) for h in rank)


# -- decontamination -------------------------------------------------------------------


def plain_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for k, t in items:
        iw = words(t)
        n = min(window, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choices(WORDS[:9], k=rnd.randint(1, 20)))) for k in range(12)] + [(90, None), (91, ""), (92, "river Mountain"), (93, "river mountain")]
    docs = [(i, " ".join(rnd.choices(WORDS[:9], k=40)) + ", " + rnd.choice(items)[1].upper() if i % 2 and (x := rnd.choice(items)[1]) and rnd.choice(items)[1] else " ".join(rnd.choices(WORDS, k=30))) for i in range(1)]
    for i in range(1, 50):
        t = " ".join(rnd.choices(WORDS[:9], k=rnd.randint(0, 40)))
        docs.append((i, t + ", " + (rnd.choice(items)[1] or "").upper() + "! " + t[:20] if i % 2 else t))
    docs += [(60, None), (61, ""), (61, ""), (62, "river... mountain")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.decontaminate(frame(spark, docs), bench, window=5, block_bytes=block_bytes).collect()
    want = Counter((i, n, h, tuple(f)) for i, t in docs for n, h, f in [plain_hits(t, items, 5)])
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    cut = decontam.remove_benchmark(frame(spark, docs), bench, window=5, max_coverage=0.9, block_bytes=block_bytes)
    assert cut.columns == frame(spark, docs).columns
    kept = cut.select("doc_id", "text").collect()
    assert all(plain_hits(r["text"], items, 5)[1] == 0 for r in kept)
    assert {i for i, t in docs if plain_hits(t, items, 5)[1] == 0} <= {r["doc_id"] for r in kept}
    assert decontam.decontaminate(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(spark.createDataFrame([], EMPTY), bench).count() == 0


# -- packing ---------------------------------------------------------------------------


def test_best_fit_is_tightest_compatible():
    rnd = random.Random(6)
    sizes = [rnd.choice([0, 1, 3, 7, 20, 50, 99, 100, 101, 250]) for _ in range(400)]
    sources, clusters = [rnd.choice([None, "a", "b", "c", "d", "e", "f"]) for _ in sizes], [rnd.choice([None, *range(30)]) for _ in sizes]
    got = packing.best_fit(sizes, sources, clusters, 100)
    # plain: try all bins, take the least residual, then the earliest
    bins = []
    want = [[] for _ in sizes]
    order = []
    for d, n in enumerate(sizes):
        at = 0
        while n - at >= 100:
            want[d].append((at, 100, len(bins), 0))
            bins.append([0, {"x"}, {"x"}])
            at += 100
        if n > at:
            order.append((-(n - at), d))
    for n, d in sorted(order):
        n = -n
        fits = [(r[0], k) for k, r in enumerate(bins) if r[0] >= n and sources[d] not in r[1] and clusters[d] not in r[2]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), set()])
        want[d].append((sizes[d] - n, n, k, 100 - bins[k][0]))
        bins[k][0] -= n
        bins[k][1] |= {sources[d]} - {None}
        bins[k][2] |= {clusters[d]} - {None}
    assert got == want


def test_packing(spark):
    rows = corpus(7) + [(None, "one two"), (3, "again again"), (3, "again again")]
    docs = frame(spark, rows).withColumn("source", (F.col("doc_id") % 3).cast("string"))
    got = packing.pack(docs, packing.word_count(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), capacity=64, group_rows=30).collect()
    words = Counter()
    for i, t in rows:
        words[i] += len((t or "").split())
    seen, by_bin = Counter(), defaultdict(list)
    for r in got:
        seen[r["doc_id"]] += r["size"]
        if r["bin"]:
            by_bin[r["bin"]].append(r)
    assert +seen == +words and {r["doc_id"] for r in got} == {i for i, _ in rows}
    for held in by_bin.values():
        held.sort(key=lambda r: r["bin_offset"])
        assert sum(r["size"] for r in held) <= 64
        assert all(a["bin_offset"] + a["size"] == b["bin_offset"] for a, b in zip(held, held[1:], strict=False))
        known = [r["doc_id"] % 3 for r in held if r["doc_id"] is not None]
        assert len(known) == len(set(known))
    unique = frame(spark, corpus(7)).withColumn("source", F.lit(None).cast("string"))
    plan = common.work_table(packing.pack(unique, packing.word_count(F.col("text")), F.col("source"), F.lit(None), capacity=64), "plan")
    out = packing.sequences(unique, plan).collect()
    assert sorted(w for r in out for w in r["text"].split()) == sorted(w for _, t in corpus(7) for w in (t or "").split())
    assert all(len(r["text"].split()) == r["n_words"] <= 64 for r in out)
    assert packing.pack(unique.limit(0), F.lit(1), F.lit("a"), F.lit("b")).count() == 0


# -- near duplicates --------------------------------------------------------------------


def plain_near(rows, k, percent):
    sets, comp = [], {}
    for _, t in rows:
        w = ("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if t else "").encode().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            comp[root(a)] = min(comp.get(root(a), i), i)
    return Counter((i, len(sets[a]), None if i is None else comp[root(a)], i is None or comp[root(a)] == i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k,tile", [(2, 512), (5, 512), (2, 7)])
def test_near_duplicates(spark, k, tile):
    rnd = random.Random(8)
    rows = corpus(8, 30)
    base = rnd.choices([f"w{j}" for j in range(300)], k=200)
    for i in range(200, 240):  # copies with growing edits, chains among them
        w = list(base)
        for _ in range(rnd.randint(0, 24)):
            w[rnd.randrange(200)] = f"z{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    for i in range(300, 312):  # a chain
        rows.append((i, " ".join(f"c{j}" for j in range(4 * (i - 300), 4 * (i - 300) + 60))))
    rows += [rows[0], (None, rows[1][1]), (None, "x y z"), (400, "solo"), (401, "SOLO"), (402, "solo solo")]
    got = near.near_duplicates(frame(spark, rows), near.NearRules(shingle=k, block=tile, strays=tile))
    assert Counter(map(tuple, got.collect())) == plain_near(rows, k, 80)
    assert near.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    left = near.drop_near_duplicates(frame(spark, rows), near.NearRules(shingle=k))
    assert left.columns == frame(spark, rows).columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for (i, _, _, kept), n in plain_near(rows, k, 80).items() if kept for _ in range(n))


def test_near_duplicates_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(40)) for x in "ab")
    rows = [(5, a), (1, b), (5, b), (7, a + " tail"), (9, "other words here")]
    got = near.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter([(5, 36, 5), (1, 36, 1), (5, 36, 1), (7, 37, 5), (9, 1, 9)])
    left = near.drop_near_duplicates(frame(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, left)) == Counter([(5, a), (1, b), (9, "other words here")])


def test_posterior_bounds():
    rules = near.NearRules()
    n = rules.bands * rules.values
    # against numeric integration of the posterior density s**m (1-s)**(n-m)
    for size in (16, 64, n):
        m = near.least_matches(size, rules)
        for q, over in ((m - 1, False), (m, True)):
            xs = [(j + 0.5) / 20000 for j in range(20000)]
            dens = [math.exp(q * math.log(x) + (size - q) * math.log(1 - x)) for x in xs]
            assert (sum(d for x, d in zip(xs, dens, strict=True) if x >= 0.8) / sum(dens) >= rules.miss) == over


# -- substrings ---------------------------------------------------------------------------


def plain_substrings(rows, need):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        key = substrings.LAST if i is None else i
        for j in range(len(b) - need + 1):
            w = b[j : j + need]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        key = substrings.LAST if i is None else i
        gone = bytearray(len(b))
        for j in range(len(b) - need + 1):
            if first[b[j : j + need]] < key:
                gone[j : j + need] = b"\1" * need
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize("heavy,slice_bytes", [(2000, 1 << 20), (3, 97)])
def test_substrings(spark, heavy, slice_bytes):
    rnd = random.Random(9)
    passage = "".join(rnd.choices("abcdefgh éß", k=120))
    rows = [(i, "".join(rnd.choices("abé ", k=rnd.randint(0, 200))) + (passage[rnd.randint(0, 30) : rnd.randint(60, 120)] if i % 2 else "") + "".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 60)))) for i in range(60)]
    rows += [(70, rows[1][1]), (71, rows[1][1]), (5, rows[5][1]), (72, None), (73, ""), (74, "q" * 300), (75, "q" * 120), (None, passage), (None, passage), (76, rows[9][1] + rows[9][1]), (5, passage + "other")]
    rows += [(80, "q" * 2000), (81, "xyz" * 900 + "q" * 700 + "tail of " * 200), (82, "ab" + "q" * 900 + "yzx" * 400), (83, "q" * 430 + "!" + "q" * 430 + " of tail" * 90)]
    rules = substrings.SubstringRules(min_len=50, heavy=heavy, slice_bytes=slice_bytes, group_bytes=2000)
    got = substrings.dedup_substrings(frame(spark, rows), rules)
    have = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in got.collect())
    assert have == plain_substrings(rows, 50)
    assert substrings.dedup_substrings(spark.createDataFrame([], EMPTY)).count() == 0


def test_periods_stand_for_all_windows():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(40):
        b = b"".join(rnd.choice([b"q", b"ab", b"xyz", b"r"]) * rnd.choice([1, 30, 400]) for _ in range(6))
        if len(b) < 12:
            continue
        n = len(b) - 12 + 1
        seen = [set() for _ in range(n)]
        for at, k, stands in substrings.periods(np.frombuffer(b, np.uint8), 12, 5):
            for j in range(stands):
                seen[at + j].add(b[at + j % k : at + j % k + 12])
        assert seen == [{b[j : j + 12]} for j in range(n)]
    runs = substrings.window_runs(np.full(100_000, 113, np.uint8), np.array([100_000]), substrings.SubstringRules())
    assert len(runs[0]) == 1


def test_previous_factors_match_plain():
    import numpy as np

    rnd = random.Random(10)
    texts = ["".join(rnd.choices("ab", k=rnd.randint(10, 60))).encode() for _ in range(30)]
    buf = b"".join(texts) + bytes(16)
    starts, doc, at = [], [], 0
    for d, t in enumerate(texts):
        for j in range(len(t) - 12 + 1):
            starts.append(at + j)
            doc.append(d)
        at += len(t)
    got = substrings.previous_factors(buf, np.array(starts, np.int64), np.array(doc, np.int64), 12)
    for s, d, g in zip(starts, doc, got.tolist(), strict=True):
        assert (g >= 12) == any(buf[x : x + 12] == buf[s : s + 12] for x, e in zip(starts, doc, strict=True) if e < d)


# -- shards -----------------------------------------------------------------------------


def test_shards(spark):
    rows = corpus(11) + [(None, "x"), (3, "again"), (3, "again")]
    got = shards.assign_shards(frame(spark, rows), [1.0] * 24, grown=[1.0] * 25).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want

    def unit(i, s):
        return (int(hashlib.md5(f"{'null' if i is None else i}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    assert all(r["shard"] == min(range(24), key=lambda s: (-math.log(unit(r["doc_id"], s)), s)) for r in got)
    assert shards.assign_shards(spark.createDataFrame([], EMPTY), [1.0, 2.0]).count() == 0


def test_shard_weights(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = Counter(r["shard"] for r in shards.assign_shards(keys, [1.0, 2.0, 0.0, 1.0]).collect())
    assert n[2] == 0 and abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


# -- token counts ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("word_bpe_49k.json"))


def test_token_counts(spark, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    rnd = random.Random(12)
    odd = ["".join(rnd.choices("abcst'vrell ABCÉß́ 　0123!?#$-—日🙂İΣ\n\t", k=rnd.randint(0, 50))) for _ in range(400)]
    rows = corpus(12) + [(1000 + k, t) for k, t in enumerate(odd)] + [(5, "a<|endoftext|>b <|startoftext|><|ENDoftext|>")]
    got = Counter(map(tuple, tokens.token_counts(frame(spark, rows), vocabulary).collect()))
    assert got == Counter((i, len((t or "").encode()), count(t)) for i, t in rows)
    for r in tokens.token_prefixes(frame(spark, rows[:40]), vocabulary).collect():
        b = (dict(rows[:40])[r["doc_id"]] or "").encode()
        assert all(count(b[:e].decode()) == n for e, n in zip(r["byte_ends"], r["tokens"], strict=True))
    for r in tokens.truncate_to_budget(frame(spark, rows[:30]), vocabulary, 9).collect():
        t = dict(rows[:30])[r["doc_id"]]
        assert t.startswith(r["text"]) and count(r["text"]) == r["n_tokens"] <= 9
        assert not any(count(t[:k]) <= 9 for k in range(len(r["text"]) + 1, min(len(t), len(r["text"]) + 30) + 1) if t[k - 1].strip())
    assert tokens.token_counts(spark.createDataFrame([], EMPTY), vocabulary).count() == 0


def test_piece_prefixes(vocabulary):
    c = tokens.PrefixCounter(vocabulary)
    for w in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "tionshthrelyes"):
        assert c.piece_prefix_counts(w) == [len(c.tokenizer.encode(w[:k], add_special_tokens=False).ids) for k in range(1, len(w) + 1)]


# -- quality rules --------------------------------------------------------------------------


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        dup += x in seen and bool(re.search(r"[^\x20\x09-\x0D]", x))
        seen.add(x)
    base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    cover = {}
    for n in quality.NGRAMS:
        g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        cover[n] = sum(len(w[j]) for j in {j for i in range(len(w) - n + 1) if g[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), base, cover


def test_quality(spark):
    rnd = random.Random(13)
    rows = corpus(13) + [(900 + k, "\n".join(" ".join(rnd.choices(WORDS, k=9)) for _ in range(9)) * (1 + k % 2) + " #$|é") for k in range(20)]
    rows += [(950, "\n".join(["one two three four five six seven eight nine ten eleven twelve"] * 9)), (3, "a b"), (3, "a b")]
    rules = quality.QualityRules()
    got = quality.quality_signals(frame(spark, rows)).collect()
    have = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["dup5_chars"], r["dup8_chars"], r["dup10_chars"]) for r in got)
    assert have == Counter((i, *q[:6], *q[6].values()) for i, t in rows for q in [plain_quality(t)])
    want = {i for i, t in rows for q in [plain_quality(t)] if not q[5] and all(q[6][n] <= s * q[1] for n, s in rules.max_ngram_share)}
    assert {r["doc_id"] for r in got if r["kept"]} <= want
    kept = quality.quality_filter(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality.quality_signals(spark.createDataFrame([], EMPTY)).count() == 0


# -- WARC --------------------------------------------------------------------------------------


def warc_pages(spark, n=300):
    rows = [(i, f"http://h{i % 7}.net/{i}", f"<p>é{'x' * (i % 50)}</p>" if i % 11 else None) for i in range(n)] + [(5, None, "again"), (5, None, "again"), (None, "u", "v")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("node", F.lit(1)).select("*", warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))


def test_merkle_audit(spark):
    pages = warc_pages(spark)
    index = common.work_table(warc.archive_index(pages, "page_id", "bytes", archive_rows=64), "idx")
    assert warc.audit(index, index).count() == 0
    other = index.where("page_id IS NULL OR page_id NOT IN (17, 40)").withColumn("sha256", F.when(F.col("page_id").isin(3, 99), F.lit("0")).otherwise(F.col("sha256")))
    found = warc.audit(index, other, fanout=4).join(index, ["archive", "ordinal"]).select("page_id", "status").collect()
    assert sorted(map(tuple, found)) == [(3, "changed"), (17, "missing"), (40, "missing"), (99, "changed")]
    assert {r["status"] for r in warc.audit(other, index, fanout=2, range_rows=5).collect()} == {"changed", "extra"}
    for rows in index.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "start", "stop")).alias("r")).collect():
        r = sorted(rows["r"])
        assert [x["ordinal"] for x in r] == list(range(len(r))) and r[0]["start"] == 0
        assert all(a["stop"] == b["start"] for a, b in zip(r, r[1:], strict=False))
    assert warc.audit(index.limit(0), index.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = warc_pages(spark)
    index = common.work_table(warc.archive_index(pages, "page_id", "bytes", archive_rows=64, extra=("bytes",)), "idx")
    warc.write_warc(index, "bytes", str(tmp_path / "w"))
    back = common.work_table(warc.read_warc(spark, str(tmp_path / "w")), "back")
    cols = ["archive", "ordinal", "start", "stop", "sha256"]
    assert Counter(map(tuple, back.select(cols).collect())) == Counter(map(tuple, index.select(cols).collect()))
    assert warc.audit(index, back).count() == 0
