"""MinHash near-dedup with sequential Bayesian verification.

1. One pass gives each text its shingle-set size, a digest of the set, a MinHash signature and
   band keys. Texts with equal sets form a class, and classes alone go on.
2. Classes that share a band key are candidates. A bucket never emits its pairs: all its members
   are compared with its least id, the pivot, which links most of a group of copies. Where a
   bucket then still holds several components, the members outside its largest one are strays
   of that component. Both a component's texts and its strays are dealt into blocks, and each
   block of texts meets each block of strays in a task of its own, which returns new links
   alone: exact, and no task holds more than two blocks, however large a bucket is.
3. A candidate pair's signatures are compared batch by batch; after m matches in n values the
   pair is dropped if the posterior probability (uniform prior) that its similarity reaches the
   threshold is under `miss`. Survivors are verified on their full sets.
4. Components of the verified links are found by label propagation with pointer jumping.

With 32 bands of 4 values a pair at similarity 0.8 shares no band with probability 5e-8.
Everything between the steps is a table in the shared folder; nothing but counts, and the ids
of texts to be verified where they are few, reaches the driver or is broadcast.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; rows with equal texts are one
component; a row with a null id is linked with nothing, its component is null and it is kept;
rows that share an id but not a text are judged, and dropped, each by its text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import binaries, map_batches, mix64, work_table


@dataclass(frozen=True)
class NearRules:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    values: int = 4
    batch: int = 16
    miss: float = 1e-7
    #: Texts, and strays, that one task compares.
    block: int = 512
    strays: int = 256

    @property
    def least(self) -> int:
        """Smaller sets can't be linked with a different set."""
        return math.ceil(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 60


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASH = _WordHash()
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            out = mix64(out * _M + h[j : n - width + 1 + j])
    return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    """Fixed odd numbers, one for each value of a signature."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _M) | np.uint64(1)


def minhash(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            np.minimum(out, np.multiply.outer(factors, s[at : at + 2048]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    rows = sig.reshape(rules.bands, rules.values)
    with np.errstate(over="ignore"):
        out = np.arange(rules.bands, dtype=np.uint64)
        for j in range(rules.values):
            out = mix64(out * _M + rows[:, j])
    return out


@lru_cache(256)
def least_matches(n: int, rules: NearRules) -> int:
    """The fewest matches among n values with which a pair goes on: P(s >= t | m, n) = P(Bin(n + 1, t) <= m)."""
    t, total = rules.percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= rules.miss:
            return m
    return n


def may_link(a: np.ndarray, b: np.ndarray, rules: NearRules) -> np.ndarray:
    """Which pairs of rows of two signature matrices survive all batches."""
    at = np.arange(len(a))
    out = np.zeros(len(a), bool)
    out[surviving(a, b, at, at, rules)] = True
    return out


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, rules: NearRules) -> np.ndarray:
    """Positions k for which row i[k] of a and row j[k] of b may link: batch by batch, only pairs that are still likely go on."""
    n = rules.bands * rules.values
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for at in range(0, n, rules.batch):
        if not len(alive):
            break
        stop = min(n, at + rules.batch)
        matches[alive] += (a[i[alive], at:stop] == b[j[alive], at:stop]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(stop, rules)]
    return alive


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _sketches(docs: DataFrame, rules: NearRules) -> DataFrame:
    """Of docs (id, fp, text): id, fp, n, digest, and sig and keys of sets that can be linked with another set."""
    factors = multipliers(rules.bands * rules.values)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, sig, keys = [], [], [], []
        for t in binaries(b.column(2)):
            s = shingle_set(t, rules.shingle)
            n.append(len(s))
            digest.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            if len(s) >= rules.least:
                m = minhash(s, factors)
                sig.append((mix64(m) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                keys.append(band_keys(m, rules).view(np.int64))
            else:
                sig.append(None)
                keys.append(None)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "n", "digest", "sig", "keys"])

    return map_batches(docs, f, f"id {docs.schema['id'].dataType.simpleString()}, fp bigint, n bigint, digest binary, sig binary, keys array<bigint>")


#: Classes to fetch that may be broadcast (some 40 bytes each); more are joined by a shuffle.
MOST_CLASSES = 500_000


def _sets(docs: DataFrame, wanted: DataFrame, rules: NearRules) -> DataFrame:
    """node, set: full shingle sets of the wanted classes (w_node, w_id, w_fp)."""
    few = wanted.count() <= MOST_CLASSES
    texts = docs.join(F.broadcast(wanted) if few else wanted, (F.col("id") == F.col("w_id")) & (F.col("fp") == F.col("w_fp"))).select("w_node", "text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, rules.shingle).tobytes() for t in binaries(b.column(1))], pa.binary())], names=["node", "set"])

    # rows that repeat id and text would give a set twice
    return work_table(map_batches(texts, f, "node bigint, set binary").dropDuplicates(["node"]), "near-sets")


def _pivot_links(docs: DataFrame, classes: DataFrame, shared: DataFrame, rules: NearRules) -> DataFrame:
    """Verified links (a, b) of bucket members with their pivots."""
    pairs = shared.select(F.col("pivot").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= rules.percent * F.greatest("n_a", "n_b"))

    def prune(t: pa.RecordBatch) -> pa.RecordBatch:
        wide = rules.bands * rules.values
        a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, wide) for c in ("sig_a", "sig_b"))
        return t.select(["a", "b"]).filter(pa.array(may_link(a, b, rules)))

    alive = work_table(map_batches(both.select("a", "b", "sig_a", "sig_b"), prune, "a bigint, b bigint"), "near-alive")
    nodes = alive.select(F.col("a").alias("w")).union(alive.select("b")).distinct()
    sets = _sets(docs, classes.join(nodes, F.col("node") == F.col("w"), "left_semi").select(F.col("node").alias("w_node"), F.col("id").alias("w_id"), F.col("fp").alias("w_fp")), rules)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    full = alive.join(side("a"), "a").join(side("b"), "b")

    def verify(t: pa.RecordBatch) -> pa.RecordBatch:
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rules.percent) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
        return t.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return work_table(map_batches(full.select("a", "b", "set_a", "set_b"), verify, "a bigint, b bigint"), "near-links")


def _stray_links(docs: DataFrame, classes: DataFrame, shared: DataFrame, comps: DataFrame, rules: NearRules) -> DataFrame | None:
    """Links (a, b) between different components of one bucket; of many between two components one is enough. None if no bucket is mixed."""
    comps = comps.select(F.col("node").alias("c_node"), "comp")
    rows = shared.join(comps, F.col("node") == F.col("c_node"), "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    in_bucket = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"))
    main = work_table(in_bucket.where("comps > 1").select(F.col("key").alias("m_key"), F.col("m.comp").alias("main")), "near-mains")
    strays = rows.join(main, (F.col("key") == F.col("m_key")) & (F.col("comp") != F.col("main"))).select("main", "node", "comp").distinct()
    strays = work_table(strays, "near-strays")
    if strays.isEmpty():
        return None
    groups = strays.select("main").distinct()
    everyone = shared.select("node").distinct().join(comps, F.col("node") == F.col("c_node"), "left").select("node", F.coalesce("comp", "node").alias("comp"))
    members = everyone.join(groups, F.col("comp") == F.col("main")).select("main", "node", "comp")
    targets = work_table(members.unionByName(strays), "near-targets")
    blocks = targets.groupBy(F.col("main").alias("b_main")).agg(F.ceil(F.count("*") / rules.block).cast("int").alias("blocks"))
    sblocks = strays.groupBy(F.col("main").alias("s_main")).agg(F.ceil(F.count("*") / rules.strays).cast("int").alias("sblocks"))
    sizes = work_table(blocks.join(sblocks, F.col("b_main") == F.col("s_main")).select("b_main", "blocks", "sblocks"), "near-tiles")
    wanted = classes.join(targets.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi")
    sets = _sets(docs, wanted.select(F.col("node").alias("w_node"), F.col("id").alias("w_id"), F.col("fp").alias("w_fp")), rules)
    held = wanted.select(F.col("node").alias("h_node"), "n", "sig").join(sets.withColumnRenamed("node", "s_node"), F.col("h_node") == F.col("s_node")).select("h_node", "n", "sig", "set")

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        """Each row with its own block, once for each block of the other side."""
        own, other = ("sblocks", "blocks") if query else ("blocks", "sblocks")
        rows = rows.join(sizes, F.col("main") == F.col("b_main"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        block, sblock = ("other", "own") if query else ("own", "other")
        return rows.select("main", F.col(block).alias("block"), F.col(sblock).alias("sblock"), F.lit(query).alias("query"), "node", "comp")

    cast = dealt(targets, False).unionByName(dealt(strays, True))
    full = cast.join(held, F.col("node") == F.col("h_node")).select("main", "block", "sblock", "query", "node", "comp", "n", "sig", "set")

    def compare(t: pa.Table) -> pa.Table:
        query = np.array(t.column("query").to_pylist(), bool)
        node, comp, n = t.column("node").to_pylist(), t.column("comp").to_pylist(), t.column("n").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(query), -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        up: dict = {c: c for c in comp}
        number = {c: k for k, c in enumerate(up)}
        code = np.array([number[c] for c in comp])

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        ask, hold = np.flatnonzero(query), np.flatnonzero(~query)
        out = []
        for at in range(0, len(ask), 128):
            q = ask[at : at + 128]
            fits = (code[q][:, None] != code[hold]) & (100 * np.minimum(n[q][:, None], n[hold]) >= rules.percent * np.maximum(n[q][:, None], n[hold]))
            i, j = np.nonzero(fits)
            i, j = q[i], hold[j]
            for k in surviving(sig, sig, i, j, rules).tolist():
                x, y = int(i[k]), int(j[k])
                if root(comp[x]) != root(comp[y]) and linked(sets[x], sets[y], rules.percent):
                    up[root(comp[x])] = root(comp[y])
                    out.append((node[x], node[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return work_table(full.groupBy("main", "block", "sblock").applyInArrow(compare, "a bigint, b bigint"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each component of the links (a, b)."""
    edges = work_table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "near-edges")
    labels = work_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "near-labels")
    while True:
        # the least label around each node, then the label of that label
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("seen"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("comp").alias("j_comp"))
        new = work_table(near.join(jump, F.col("comp") == F.col("j_node"), "left").select("node", "old", F.least("comp", F.coalesce("j_comp", "comp")).alias("comp")), "near-labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def _judged(docs: DataFrame, rules: NearRules) -> DataFrame:
    """Of docs (id, fp, text): id, fp, n, component; a class of equal sets is one node, whatever ids it has."""
    sketches = work_table(_sketches(docs, rules), "near-sketches")
    firsts = sketches.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "fp")).alias("f"))
    firsts = work_table(firsts.select(F.col("digest").alias("f_digest"), F.col("f.id").alias("f_id"), F.col("f.fp").alias("f_fp"), F.monotonically_increasing_id().alias("node")), "near-firsts")
    first = sketches.where("sig IS NOT NULL").join(firsts, (F.col("digest") == F.col("f_digest")) & (F.col("id") == F.col("f_id")) & (F.col("fp") == F.col("f_fp")))
    classes = work_table(first.select("node", "id", "fp", "n", "sig", "keys").dropDuplicates(["node"]), "near-classes")

    bands = classes.select(F.explode("keys").alias("key"), "node")
    pivots = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = work_table(bands.join(pivots.select(F.col("key").alias("p_key"), "pivot"), F.col("key") == F.col("p_key")).select("key", "node", "pivot"), "near-buckets")

    known = classes.select("node", "id", "fp", "n", "sig")
    links = _pivot_links(docs, known, shared, rules)
    comps = components(links)
    more = _stray_links(docs, known, shared, comps, rules)
    if more is not None and not more.isEmpty():
        comps = components(links.unionByName(more))

    comps = comps.select(F.col("node").alias("c_node"), "comp")
    named = firsts.join(comps, F.col("node") == F.col("c_node"), "left").select("f_digest", "f_id", "comp")
    least = named.where("comp IS NOT NULL").groupBy(F.col("comp").alias("l_comp")).agg(F.min("f_id").alias("component"))
    named = named.join(least, F.col("comp") == F.col("l_comp"), "left").select("f_digest", F.coalesce("component", "f_id").alias("component"))
    out = sketches.select("id", "fp", "n", "digest").join(named, F.col("digest") == F.col("f_digest"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", "fp", "n", component.alias("component"))


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (a hash of the text, which tells apart rows of one id), text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach), kept (id = component_id)."""
    out = _judged(_input(docs, id_col, text_col), rules)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each component (rows that repeat its id and text stay with it)."""
    name = "gone"
    while any(c.lower().startswith(name) for c in docs.columns):  # a name of our own, whatever theirs are
        name += "_"
    gone = _judged(_input(docs, id_col, text_col), rules).where("id <> component").select(F.col("id").alias(name), F.col("fp").alias(f"{name}fp")).distinct()
    gone = work_table(gone, "near-gone")
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(f"{name}fp")), "left_anti")
