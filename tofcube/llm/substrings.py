"""Suffix-array dedup of byte strings across documents, by longest-previous-factor arrays.

A byte goes if it lies in a string of `min_len` bytes that also starts in a document with a
smaller id. The whole corpus has no one suffix array here; its windows of min_len bytes are dealt
so that equal windows meet, and each task builds the order of its own suffixes:

1. Texts that equal the text of a smaller id are found by digest; they go whole, and only the
   first of them takes part in the rest.
2. Every window is owned by its minimizer, the gram of `gram` bytes in it with the least hash.
   The minimizers' hashes build two Bloom filters; windows whose minimizer was seen once can't
   repeat and stay. The filter that is broadcast grows with the distinct repeats and is bounded;
   too small a filter passes more windows on and changes no result.
3. The other windows are dealt by minimizer, as runs of neighbouring windows with their bytes.
   A task sorts the starts in suffix order (to the depth of min_len bytes, equal ones by
   document), takes the common prefix lengths of neighbours, and finds for every start the
   previous and the next position in that order whose document is smaller; the longer of the
   two common prefixes is the longest previous factor.
   Windows that a document repeats are sorted once.
4. A minimizer found very often is dealt over blocks of documents. What is first in its block
   is settled between blocks by the windows themselves, of which each block has one; they are
   dealt, many to a row, over as many groups as the minimizer has blocks.

A run goes on as long as the minimizer's hash stays the same, wherever it stands, so a text that
repeats itself within a few bytes is one run; a long stretch of one period is sent as its first
period with the number of windows that it stands for.

Defined cases: a null text is empty; a null id counts as greater than all others, and such
documents do not remove from each other; repeated rows (equal id) do not remove from each other;
a text below min_len bytes stays whole; matches never cross documents; an empty table gives an
empty result; other columns are ignored. The id must be an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import TwiceFilter, binaries, bound_batches, map_batches, mix64, packed_hashes, parts_for, short, twice_filter, work_table

_M = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 28) - 1)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class SubstringRules:
    min_len: int = 50
    gram: int = 24
    #: Text bytes for each group of windows that a task sorts at once.
    group_bytes: int = 1 << 20
    #: A minimizer found more often than this, and than one in 4096 of all or 100 000 times, is dealt over blocks of so many occurrences.
    heavy: int = 2000
    max_filter_log2: int = 28
    #: Bytes that are hashed at once; longer texts are worked through in overlapping slices.
    slice_bytes: int = 1 << 20


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all k-grams of a byte array."""
    with np.errstate(over="ignore"):
        level = {1: b.astype(np.uint64) + np.uint64(1)}
        n = 1
        while 2 * n <= k:
            level[2 * n] = level[n][: len(b) - 2 * n + 1] * np.uint64(pow(_M, n, 1 << 64)) + level[n][n:]
            n *= 2
        out, done, size = None, 0, len(b) - k + 1
        for n in sorted((x for x in level if k & x), reverse=True):
            part = level[n][done : done + size]
            out = part if out is None else out * np.uint64(pow(_M, n, 1 << 64)) + part
            done += n
        return mix64(out)


def window_runs(b: np.ndarray, ends: np.ndarray, rules: SubstringRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows with one minimizer, and the minimizer's hash.

    b: texts one after the other; ends: where each ends. Windows that cross an end are left out."""
    size = len(b) - rules.min_len + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b, rules.gram)
    width = rules.min_len - rules.gram + 1
    least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: len(h) - width + 1], least[width - n :][: len(h) - width + 1])
    value = h[(least & _POS).astype(np.int64)]
    inside = np.ones(size, bool)
    for e in ends.tolist():
        inside[max(0, e - rules.min_len + 1) : e] = False
    change = np.ones(size, bool)
    change[1:] = (value[1:] != value[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], size) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    # mixed again: hashes that are least in their windows are small
    return first, last, mix64(value[first])


def periods(b: np.ndarray, need: int, most: int) -> list[tuple[int, int, int]]:
    """The windows of a long run, in order, as pieces (first window, windows to sort, windows they stand for).

    A stretch of period p, up to `most`, is its first p windows and stands for all of it; what
    else there is stands for itself."""
    size = len(b) - need + 1
    breaks = [np.append(np.flatnonzero(b[p:] != b[:-p]), len(b) - p) for p in range(1, most + 1)]
    out: list[tuple[int, int, int]] = []
    at = plain = 0
    while at < size:
        # windows from here that lie within the stretch of each period
        reach = [int(x[np.searchsorted(x, at)]) + p - at - need + 1 for p, x in enumerate(breaks, 1)]
        p = int(np.argmax(reach))
        if reach[p] < 4 * need:
            at += need
            continue
        if plain < at:
            out.append((plain, at - plain, at - plain))
        out.append((at, p + 1, reach[p]))
        at = plain = at + reach[p]
    if plain < size:
        out.append((plain, size - plain, size - plain))
    return out


def slices(texts: list[bytes | None], rules: SubstringRules) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Buffers of about slice_bytes: bytes, ends, and for each piece (row, offset in the text, offset in the buffer)."""
    parts: list[bytes] = []
    pieces: list[tuple[int, int, int]] = []
    ends: list[int] = []
    size = 0
    over = rules.min_len - 1
    for row, t in enumerate(texts):
        if t is None or len(t) < rules.min_len:
            continue
        for at in range(0, len(t) - over, rules.slice_bytes):
            piece = t[at : at + rules.slice_bytes + over]
            if size and size + len(piece) > rules.slice_bytes + over:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), pieces
                parts, pieces, ends, size = [], [], [], 0
            pieces.append((row, at, size))
            parts.append(piece)
            size += len(piece)
            ends.append(size)
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), pieces


# -- suffix order and longest previous factors ------------------------------------------


def _words(buf: bytes, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """The depth bytes from each start, as big-endian numbers of 8 bytes, the rest of the last one zero."""
    flat = np.frombuffer(buf + bytes(8), np.uint8)
    view = np.lib.stride_tricks.as_strided(flat[:8].view(">u8"), (len(buf) + 1,), (1,))
    out = []
    for at in range(0, depth, 8):
        w = view[starts + at].astype(np.uint64)
        if depth - at < 8:
            w &= np.uint64((0xFFFFFFFFFFFFFFFF << 8 * (8 - (depth - at))) & 0xFFFFFFFFFFFFFFFF)
        out.append(w)
    return out


def common_prefix(words: list[np.ndarray], depth: int) -> np.ndarray:
    """Common prefix length, up to depth, of each entry with the one before it (0 for the first)."""
    n = len(words[0])
    out = np.zeros(n, np.int64)
    equal = np.ones(n, bool)
    equal[:1] = False
    for k, w in enumerate(words):
        x = np.zeros(n, np.uint64)
        x[1:] = w[1:] ^ w[:-1]
        same = np.full(n, 8, np.int64)
        for byte in range(7, -1, -1):
            same[(x >> np.uint64(8 * (7 - byte))) & np.uint64(0xFF) != 0] = byte
        out[equal] += same[equal]
        equal &= same == 8
        if not equal.any():
            break
    return np.minimum(out, depth)


def smaller_before(doc: np.ndarray, lcp: np.ndarray, need: int) -> np.ndarray:
    """Common prefix with the nearest earlier entry of a smaller document; 0 where it would be below need.

    Pointer jumping: all entries between one and its pointer have documents at least its own."""
    prev, low = np.arange(len(doc)) - 1, lcp.copy()
    low[:1] = 0
    active = np.flatnonzero((prev >= 0) & (low >= need))
    active = active[doc[prev[active]] >= doc[active]]
    while len(active):
        p = prev[active]
        low[active] = np.minimum(low[active], low[p])
        prev[active] = prev[p]
        active = active[(prev[active] >= 0) & (low[active] >= need)]
        active = active[doc[prev[active]] >= doc[active]]
    return np.where((prev >= 0) & (low >= need), low, 0)


def previous_factors(buf: bytes, starts: np.ndarray, doc: np.ndarray, need: int) -> np.ndarray:
    """Longest previous factor, cut at need bytes, of each start: its longest common prefix with a start of a smaller document. Below need it is given as 0."""
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), _CHUNK):
            part = h[at : at + _CHUNK]
            for w in _words(buf, starts[at : at + _CHUNK], need):
                part[:] = mix64(part * np.uint64(_M) + w)
    # one start stands for all of its document with the same bytes
    o = np.lexsort((doc, h))
    new = np.ones(len(o), bool)
    new[1:] = (h[o][1:] != h[o][:-1]) | (doc[o][1:] != doc[o][:-1])
    one = o[new]
    stands = np.empty(len(o), np.int64)
    stands[o] = np.cumsum(new) - 1
    again = o[~new]
    for at in range(0, len(again), _CHUNK):
        part = again[at : at + _CHUNK]
        odd = np.zeros(len(part), bool)
        for x, y in zip(_words(buf, starts[part], need), _words(buf, starts[one[stands[part]]], need), strict=True):
            odd |= x != y
        stands[part[odd]] = np.arange(len(one), len(one) + odd.sum())
        one = np.append(one, part[odd])
    return _factors(buf, starts[one], doc[one], h[one], need)[stands]


_CHUNK = 1 << 18


def _factors(buf: bytes, starts: np.ndarray, doc: np.ndarray, h: np.ndarray, need: int) -> np.ndarray:
    out = np.zeros(len(starts), np.int64)
    # Starts whose hash no start of another document shares have no factor of that length.
    o = np.argsort(h)
    new = np.ones(len(o), bool)
    new[1:] = h[o][1:] != h[o][:-1]
    heads = np.flatnonzero(new)
    mixed = np.minimum.reduceat(doc[o], heads) < np.maximum.reduceat(doc[o], heads) if len(heads) else np.zeros(0, bool)
    some = np.sort(o[np.repeat(mixed, np.diff(np.append(heads, len(o))))])
    if not len(some):
        return out
    words, doc = _words(buf, starts[some], need), doc[some]
    order = np.lexsort((doc, *reversed(words)))
    words, doc = [w[order] for w in words], doc[order]
    lcp = common_prefix(words, need)
    before = smaller_before(doc, lcp, need)
    after = smaller_before(doc[::-1], np.append(0, lcp[1:][::-1]), need)[::-1]
    out[some[order]] = np.maximum(before, after)
    return out


# -- the distributed steps -----------------------------------------------------------------


def _spans(removed: np.ndarray, row: np.ndarray, at: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the bytes that runs of removed windows cover."""
    k = np.flatnonzero(removed)
    if not len(k):
        return k, k, k
    head = np.ones(len(k), bool)
    head[1:] = (row[k][1:] != row[k][:-1]) | (at[k][1:] > at[k][:-1] + need)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(k)) - 1
    return row[k][first], at[k][first], at[k][last] + need


#: What a packed run of windows has besides its bytes. reach: the windows that it stands for;
#: deal: over how many groups its firsts are dealt if its minimizer is hot, else 0.
_HEAD = np.dtype([("id", "<i8"), ("fp", "<u4"), ("at", "<i4"), ("size", "<u4"), ("reach", "<u4"), ("deal", "<u4"), ("key", "<u8")])
_SPAN = np.dtype([("id", "<i8"), ("fp", "<u4"), ("start", "<i4"), ("stop", "<i4")])
#: spans: packed _SPAN rows of one dgrp; firsts: packed _SPAN rows and their windows, of one wgrp.
_FOUND = "dgrp bigint, spans binary, wgrp bigint, firsts binary"
_FLUSH = 200_000


def _pieces(x: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, rules: SubstringRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs with the number of windows that each stands for; long ones cut into their periods."""
    reach = last - first + 1
    long = reach > 8 * rules.min_len
    if not long.any():
        return first, last, h, reach
    rows = [r for r in zip(first[~long].tolist(), last[~long].tolist(), h[~long].tolist(), reach[~long].tolist(), strict=True)]
    for k in np.flatnonzero(long).tolist():
        s = int(first[k])
        rows += [(s + at, s + at + n - 1, int(h[k]), stands) for at, n, stands in periods(x[s : last[k] + rules.min_len], rules.min_len, rules.min_len - rules.gram + 1)]
    a, b, c, d = zip(*rows, strict=True)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.uint64), np.array(d, np.int64)


def _packed_runs(batches: Iterator[pa.RecordBatch], twice: TwiceFilter, keys: np.ndarray, blocks: np.ndarray, groups: int, rules: SubstringRules) -> Iterator[pa.RecordBatch]:
    """grp, payload: the suspected runs of the texts in batches (id, fp, text), many to a row."""
    heads: list[np.ndarray] = []
    grps: list[np.ndarray] = []
    raws: list[bytes] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not raws:
            return
        head, grp = np.concatenate(heads), np.concatenate(grps)
        order = np.argsort(grp, kind="stable")
        grp, head = grp[order], head[order]
        cuts = np.append(np.flatnonzero(np.diff(grp, prepend=-1)), len(grp)).tolist()
        pack = zstandard.ZstdCompressor(level=1).compress
        at = order.tolist()
        rows = [(int(grp[x]), pack(b"".join([(y - x).to_bytes(8, "little"), *(head[x:y][c].tobytes() for c in _HEAD.names), *(raws[k] for k in at[x:y])]))) for x, y in zip(cuts, cuts[1:], strict=False)]
        heads.clear(), grps.clear(), raws.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "payload"])

    for b in batches:
        ids, fps, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), binaries(b.column(2))
        for x, ends, pieces in slices(texts, rules):
            first, last, h = window_runs(x, ends, rules)
            keep = twice.test(h)
            first, last, h = first[keep], last[keep], h[keep]
            if not len(h):
                continue
            first, last, h, reach = _pieces(x, first, last, h, rules)
            begin = np.array([p[2] for p in pieces])
            piece = np.searchsorted(begin, first, "right") - 1
            row = np.array([p[0] for p in pieces])[piece]
            head = np.zeros(len(h), _HEAD)
            head["id"], head["fp"] = ids[row], fps[row]
            head["at"] = first - begin[piece] + np.array([p[1] for p in pieces])[piece]
            head["size"], head["reach"], head["key"] = last - first + rules.min_len, reach, h
            block = np.zeros(len(h), np.uint64)
            if len(keys):
                own = short(h, twice.parts_log2)
                k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hot = keys[k] == own
                block[hot] = np.uint64(1) + mix64(head["id"][hot].astype(np.uint64)) % blocks[k[hot]]
                head["deal"][hot] = blocks[k[hot]]
            with np.errstate(over="ignore"):
                grps.append((mix64(h + block * np.uint64(_M)) % np.uint64(groups)).astype(np.int64))
            heads.append(head)
            raw = x.tobytes()
            raws.extend(raw[s:e] for s, e in zip(first.tolist(), (last + rules.min_len).tolist(), strict=True))
            if len(raws) >= _FLUSH:
                yield from flush()
    yield from flush()


def _unpacked(payloads: list[bytes]) -> tuple[np.ndarray, bytes]:
    heads, raws = [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for raw in map(unpack, payloads):
        n, at = int.from_bytes(raw[:8], "little"), 8
        head = np.zeros(n, _HEAD)
        for c in _HEAD.names:
            width = _HEAD[c].itemsize * n
            head[c] = np.frombuffer(raw[at : at + width], _HEAD[c])
            at += width
        heads.append(head)
        raws.append(raw[at:])
    return np.concatenate(heads), b"".join(raws)


def repeated_spans(docs: DataFrame, rules: SubstringRules, known: DataFrame) -> DataFrame:
    """id, fp, spans (packed _SPAN pairs start, stop; maximal): what goes from each document that loses bytes.

    docs: id bigint (never null), fp bigint below 2**32, text. known: id, fp, start, stop of spans found otherwise."""
    spark, need = docs.sparkSession, rules.min_len
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    minis = math.ceil(2 * chars / (need - rules.gram + 2))
    parts = parts_for(minis)
    heavy_at = max(rules.heavy, min(minis >> 12, 100_000))

    def hashes(b: pa.RecordBatch) -> list[np.ndarray]:
        return [window_runs(x, ends, rules)[2] for x, ends, _ in slices(binaries(b.column(0)), rules)]

    twice, heavy = twice_filter(packed_hashes(docs.select("text"), hashes, parts), minis, parts, rules.max_filter_log2, heavy_at)
    keys = np.array(sorted(heavy), np.uint64)
    blocks = np.array([-(-heavy[int(k)] // heavy_at) + 1 for k in keys], np.uint64)
    shared = spark.sparkContext.broadcast((twice, keys, blocks))
    groups = max(1, -(-chars // rules.group_bytes)) | 1
    # documents' spans meet in fewer groups, so that a task's spans for one of them fill a row
    dgroups = max(1, -(-chars // (32 * rules.group_bytes))) | 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed_runs(batches, *shared.value, groups, rules)

    bound_batches(spark)
    runs = docs.select("id", "fp", "text").mapInArrow(emit, "grp bigint, payload binary")

    def dealt(span: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Spans packed by group of documents."""
        dgrp = span["id"] % dgroups
        order = np.argsort(dgrp, kind="stable")
        span, dgrp = span[order], dgrp[order]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(dgrp) != 0)), len(dgrp)).tolist() if len(dgrp) else []
        return [int(dgrp[x]) for x in cuts[:-1]], [span[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]

    def settle(t: pa.Table) -> pa.Table:
        head, buf = _unpacked(t.column("payload").to_pylist())
        size = head["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        n = size - need + 1
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts, at = begin[row] + off, head["at"].astype(np.int64)[row] + off
        # the last window that each stands for: a whole number of periods on
        stop = at + (head["reach"].astype(np.int64)[row] - 1 - off) // n[row] * n[row] + need
        gone = previous_factors(buf, starts, head["id"][row], need) >= need
        alone = stop > at + need
        r, s, e = _spans(gone & ~alone, row, at, need)
        more = np.flatnonzero(gone & alone)
        r, s, e = np.append(r, row[more]), np.append(s, at[more]), np.append(e, stop[more])
        span = np.zeros(len(r), _SPAN)
        span["id"], span["fp"], span["start"], span["stop"] = head["id"][r], head["fp"][r], s, e
        dgrp, packs = dealt(span)
        left = np.flatnonzero(~gone & (head["deal"] > 0)[row])
        first = np.zeros(len(left), _SPAN)
        first["id"], first["fp"], first["start"], first["stop"] = head["id"][row[left]], head["fp"][row[left]], at[left], stop[left]
        wins = np.frombuffer(b"".join([buf[x : x + need] for x in starts[left].tolist()]), f"V{need}")
        with np.errstate(over="ignore"):
            h = np.zeros(len(left), np.uint64)
            for w in _words(buf, starts[left], need):
                h = mix64(h * np.uint64(_M) + w)
            wgrp = mix64(head["key"][row[left]] + (h % np.maximum(head["deal"][row[left]], 1)) * np.uint64(_M)).view(np.int64)
        order = np.argsort(wgrp, kind="stable")
        first, wins, wgrp = first[order], wins[order], wgrp[order]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(wgrp) != 0)), len(wgrp)).tolist() if len(wgrp) else []
        firsts = [zstandard.ZstdCompressor(level=1).compress((y - x).to_bytes(8, "little") + first[x:y].tobytes() + wins[x:y].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]
        names, none = [int(wgrp[x]) for x in cuts[:-1]], [None] * len(firsts)
        return pa.table([pa.array(dgrp + none, pa.int64()), pa.array(packs + none, pa.binary()), pa.array([None] * len(packs) + names, pa.int64()), pa.array([None] * len(packs) + firsts, pa.binary())], names=["dgrp", "spans", "wgrp", "firsts"])

    def across(t: pa.Table) -> pa.Table:
        """Between blocks: what is not of the smallest document that has the window goes."""
        parts = []
        for raw in map(zstandard.ZstdDecompressor().decompress, t.column("firsts").to_pylist()):
            n = int.from_bytes(raw[:8], "little")
            parts.append((np.frombuffer(raw, _SPAN, n, 8), np.frombuffer(raw, f"V{need}", n, 8 + n * _SPAN.itemsize)))
        span, wins = (np.concatenate(x) for x in zip(*parts, strict=True))
        words = _words(wins.tobytes() + bytes(8), np.arange(len(wins)) * need, need)
        order = np.lexsort((span["id"], *reversed(words)))
        span = span[order]
        new = np.zeros(len(span), bool)
        new[:1] = True
        for w in words:
            new[1:] |= w[order][1:] != w[order][:-1]
        least = span["id"][new][np.cumsum(new) - 1]
        dgrp, packs = dealt(span[span["id"] > least])
        return pa.table({"dgrp": pa.array(dgrp, pa.int64()), "spans": pa.array(packs, pa.binary())})

    found = work_table(runs.groupBy("grp").applyInArrow(settle, _FOUND), "substring-found")
    late = found.where("firsts IS NOT NULL").select("wgrp", "firsts").groupBy("wgrp").applyInArrow(across, "dgrp bigint, spans binary")
    named = ["dgrp", "spans", "id", "fp", "start", "stop"]
    blank = {"id": F.lit(None).cast("bigint"), "fp": F.lit(None).cast("bigint"), "start": F.lit(None).cast("bigint"), "stop": F.lit(None).cast("bigint")}
    all_ = found.where("spans IS NOT NULL").select("dgrp", "spans").unionByName(late).withColumns(blank).select(named)
    all_ = all_.unionByName(known.withColumns({"dgrp": F.pmod("id", F.lit(dgroups)), "spans": F.lit(None).cast("binary")}).select(named))

    def merge(t: pa.Table) -> pa.Table:
        one = t.filter(pc.is_null(t.column("spans")))
        more = np.zeros(one.num_rows, _SPAN)
        for c in _SPAN.names:
            more[c] = one.column(c).to_numpy()
        span = np.concatenate([more, *(np.frombuffer(x, _SPAN) for x in t.column("spans").to_pylist() if x)])
        span = np.sort(span, order=["id", "fp", "start"])
        cuts = np.append(np.flatnonzero(np.append(True, (span["id"][1:] != span["id"][:-1]) | (span["fp"][1:] != span["fp"][:-1]))), len(span)).tolist()
        rows = [(int(span["id"][x]), int(span["fp"][x]), np.array(merged(span["start"][x:y], span["stop"][x:y]), "<i8").tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "fp": pa.array([r[1] for r in rows], pa.int64()), "spans": pa.array([r[2] for r in rows], pa.binary())})

    return all_.groupBy("dgrp").applyInArrow(merge, "id bigint, fp bigint, spans binary")


def dedup_substrings(docs: DataFrame, rules: SubstringRules = SubstringRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: a cut may fall within a character).

    Documents are told apart by id and a 32-bit hash of the text."""
    src = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    src = src.withColumn("fp", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    long = F.octet_length("text") >= rules.min_len
    named = src.where(long).select("id", "fp", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("bigint").alias("stop"))
    firsts = work_table(named.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(F.col("digest").alias("f_digest"), "first"), "substring-firsts")
    copies = work_table(named.join(firsts, (F.col("digest") == F.col("f_digest")) & (F.col("id") > F.col("first"))).select("id", "fp", F.lit(0).cast("bigint").alias("start"), "stop"), "substring-copies")
    known = copies.select(F.col("id").alias("k_id"), F.col("fp").alias("k_fp")).distinct()
    if known.count() <= 1_000_000:  # 16 bytes each
        known = F.broadcast(known)
    rest = src.where(long).join(known, (F.col("id") == F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left_anti").select("id", "fp", "text")

    spans = work_table(repeated_spans(rest, rules, copies), "substring-spans").select(F.col("id").alias("s_id"), F.col("fp").alias("s_fp"), "spans")
    joined = src.join(spans, (F.col("id") == F.col("s_id")) & (F.col("fp") == F.col("s_fp")), "left").select("own", "text", "spans")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, runs, kept = [], [], [], []
        for t, spans in zip(binaries(b.column(1)), b.column(2).to_pylist(), strict=True):
            t = t or b""
            out, done, count = [], 0, 0
            for s, e in np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist():
                out.append(t[done:s])
                done = e
                count += 1
            rest = b"".join([*out, t[done:]])
            n.append(len(t))
            removed.append(len(t) - len(rest))
            runs.append(count)
            kept.append(rest)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    out = map_batches(joined, cut, f"own {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("own", id_col)


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by start; touching ones are one."""
    reach = np.maximum.accumulate(stop)
    head = np.append(True, start[1:] > reach[:-1])
    last = np.append(head[1:], True)
    return list(zip(start[head].tolist(), reach[last].tolist(), strict=True))
