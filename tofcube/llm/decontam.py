"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all normalised items is built once, from a benchmark whose size is checked, and
broadcast; the training texts stream through it word by word, each position knowing the length
of the longest item substring that ends there. A benchmark of more words than one automaton may
hold is dealt into blocks, each with an automaton and a pass of its own, and what they hit is
joined by document. No text is shuffled with one block. An automaton of n words has 2 n states
at most, held in flat arrays, with a dict for the states that branch alone.

Words are runs of ASCII letters and digits and of all characters above U+007F, A-Z lower-cased.
A window is `window` consecutive words of an item; a shorter item with words is one window.

Defined cases: a null or empty text has no words and no hits; a null or wordless item matches
nothing; an item without an id hits words but is not named; items with equal texts are all reported; repeated rows are judged alike; with an empty
benchmark nothing is hit; columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import binaries, map_batches, work_path, work_table

#: Bytes to themselves if they belong to words, A-Z to a-z, all else to a space.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over item word numbers.

    Of a state's transitions the first is held in the arrays `word` and `to` (the start has none
    there) and all others in the dict `more`."""

    def __init__(self, window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {0: {}}
        #: The state that stands for the last `window` words, by state that is as long at least.
        self.tail = array("i")
        #: Item numbers by such a state.
        self.items: dict[int, list[int]] = {}
        #: By state: (words, item numbers) of whole short items that are suffixes of it.
        self.short: dict[int, list[tuple[int, list[int]]]] = {}

    @classmethod
    def build(cls, texts: list[bytes], window: int) -> Automaton:
        a = cls(window)
        seqs = [array("i", [a.number.setdefault(w, len(a.number)) for w in words_of(t)]) for t in texts]
        for s in seqs:
            last = 0
            for c in s:
                last = a._extend(last, c)
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__)
        a.tail = array("i", bytes(4 * len(a.length)))
        for v in order:
            up = a.link[v]
            a.tail[v] = a.tail[up] if a.length[up] >= window else v
        whole: dict[int, dict[int, list[int]]] = {}
        for k, s in enumerate(seqs):
            if not s:
                continue
            if len(s) < window:
                v = 0
                for c in s:
                    v = a.next(v, c)
                whole.setdefault(v, {}).setdefault(len(s), []).append(k)
                continue
            v = n = 0
            for c in s:
                v, n = a.step(v, n, c)
                if n >= window:
                    own = a.items.setdefault(a.tail[v], [])
                    if not own or own[-1] != k:
                        own.append(k)
        if whole:
            for v in order:
                found = list(whole.get(v, {}).items()) + a.short.get(a.link[v], [])
                if found:
                    a.short[v] = found
        return a

    def next(self, v: int, c: int) -> int | None:
        if self.word[v] == c:
            return self.to[v]
        rest = self.more.get(v)
        return rest.get(c) if rest else None

    def _set(self, v: int, c: int, to: int) -> None:
        if v and self.word[v] in (-1, c):
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _new(self, length: int) -> int:
        self.word.append(-1)
        self.to.append(0)
        self.length.append(length)
        self.link.append(-1)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        twin = self._new(self.length[p] + 1)
        self.word[twin], self.to[twin] = self.word[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p != -1 and self.next(p, c) == q:
            self._set(p, c, twin)
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.next(last, c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur, p = self._new(self.length[last] + 1), last
        while p != -1 and (q := self.next(p, c)) is None:
            self._set(p, c, cur)
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        to = self.next(v, c)
        while to is None and v:
            v = self.link[v]
            n = self.length[v]
            to = self.next(v, c)
        return (0, 0) if to is None else (to, n + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Maximal hit spans [start, end) in words, item numbers hit, and the longest match."""
        window, word, dest, more, link, length, short = self.window, self.word, self.to, self.more, self.link, self.length, self.short
        none: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        v = n = longest = i = 0
        for c in map(self.number.get, words):
            i += 1
            if c is None:
                v = n = 0
                continue
            if word[v] == c:
                to = dest[v]
            else:
                to = more.get(v, none).get(c)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = dest[v] if word[v] == c else more.get(v, none).get(c)
                if to is None:
                    continue
            v = to
            n += 1
            start = i
            if n >= window:
                states.add(v)
                start = i - window
                if n > longest:
                    longest = n
            if short and v in short:
                for k, which in short[v]:
                    if k <= n:
                        found.update(which)
                        start = min(start, i - k)
                        longest = max(longest, k)
            if start < i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        for v in states:
            found.update(self.items[self.tail[v]])
        return spans, found, longest


#: Words of one automaton.
MOST_WORDS = 1 << 20


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int, window: int, most_words: int = MOST_WORDS) -> Iterator[tuple[list[str | None], list[bytes]]]:
    """The items in blocks of at most most_bytes of text and most_words words, one block at a time.

    An item of more words is cut into pieces that overlap by all but one word of a window, so
    that its windows are those of the pieces; one of more bytes is a block alone."""
    names, texts, size, count = [], [], 0, 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        words = words_of(row["t"].encode())
        for at in range(0, max(1, len(words) - window + 1), max(1, most_words - window + 1)):
            piece = words[at : at + most_words]
            t = b" ".join(piece)
            if names and (size + len(t) > most_bytes or count + len(piece) > most_words):
                yield names, texts
                names, texts, size, count = [], [], 0, 0
            names.append(row["i"])
            texts.append(t)
            size += len(t)
            count += len(piece)
    if names:
        yield names, texts


_HITS = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>, longest bigint"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _hits(src: DataFrame, names: list[str | None], texts: list[bytes], window: int) -> tuple[DataFrame, Broadcast]:
    """id and _HITS of the texts (id, text) with one block of items, and what is broadcast for it."""
    shared = src.sparkSession.sparkContext.broadcast((names, Automaton.build(texts, window)))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        names, a = shared.value
        ns, spans, items, longest = [], [], [], []
        for t in binaries(b.column(1)):
            ws = words_of(t or b"")
            s, found, most = a.scan(ws)
            ns.append(len(ws))
            spans.append([{"start": x, "stop": y} for x, y in s])
            items.append(sorted({names[k] for k in found} - {None}))
            longest.append(most)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=["id", "n_words", "spans", "items", "longest"])

    return map_batches(src, f, f"id {src.schema['id'].dataType.simpleString()}, {_HITS}"), shared


def _all_hits(src: DataFrame, blocks: Iterable[tuple[list[str | None], list[bytes]]], window: int, hit_only: bool = False) -> DataFrame:
    """The rows of _hits for all blocks, written block by block: one automaton at a time is held."""
    path = work_path(src.sparkSession, "decontam-hits")
    for names, texts in blocks:
        out, shared = _hits(src, names, texts, window)
        (out.where(F.size("spans") > 0) if hit_only else out).write.mode("append").parquet(path)
        shared.destroy()
    return src.sparkSession.read.schema(out.schema).parquet(path)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (hit words [start, stop), maximal), items
    (ids hit, sorted as strings), longest (longest matching length in words).

    block_bytes bounds what is broadcast at once."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes, window)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        out = _hits(src, *first, window)[0]
    else:
        src = work_table(src.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
        found = _all_hits(src.select(F.struct("row", "id").alias("id"), "text"), chain([first, second], blocks), window)
        out = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
        out = out.withColumn("spans", _merged(F.array_sort("spans"))).withColumn("id", F.col("id.id"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items", "longest")


def _merged(spans):
    """Sorted spans, overlapping and touching ones joined."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(TABLE))]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, text[done:]])


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The documents with all their columns, hit spans cut from the text. Documents of which
    more than max_coverage of the words are hit are dropped. Cutting is repeated until no
    window is left, as the ends of a cut may meet in a new one."""
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != text_col])
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns])
    kind = rest.schema.simpleString()
    out = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes, window)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(first[1], window))

        def f(b: pa.RecordBatch) -> pa.Table:
            a = shared.value
            texts, keep = [], []
            for t in binaries(b.column(1)):
                ws = words_of(t or b"")
                spans, _, _ = a.scan(ws)
                keep.append(sum(e - s for s, e in spans) <= max_coverage * len(ws))
                while spans:
                    t = cut_words(t, spans)
                    spans, _, _ = a.scan(words_of(t))
                texts.append(t)
            return pa.Table.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"]).filter(pa.array(keep, pa.bool_()))

        out = map_batches(out, f, f"row {kind}, text string")
    else:
        out = _remove_by_blocks(out, lambda: item_blocks(benchmark, item_col, item_text_col, block_bytes, window), window, max_coverage)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _remove_by_blocks(src: DataFrame, blocks: Callable[[], Iterable[tuple[list[str | None], list[bytes]]]], window: int, max_coverage: float) -> DataFrame:
    """remove_benchmark of (row, text) with more items than one automaton holds.

    Each round takes the spans of all blocks from the same texts and joins them by text, so
    coverage is judged on their union and cuts are those of a single automaton. Texts without a
    hit are done; those that were cut go into the next round."""
    kind = src.schema["row"].dataType.simpleString()
    now = work_table(src.withColumn("id", F.monotonically_increasing_id()), "decontam-texts")
    done, limit = [], max_coverage
    while True:
        found = _all_hits(now.select("id", "text"), blocks(), window, hit_only=True)
        spans = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        if found.isEmpty():
            return reduce(DataFrame.unionByName, [*done, now.select("row", "text")])
        done.append(now.join(spans, "id", "left_anti").select("row", "text"))

        def f(b: pa.RecordBatch, limit=limit) -> pa.Table:
            texts, keep = [], []
            for t, spans in zip(binaries(b.column(2)), b.column(3).to_pylist(), strict=True):
                spans = [(s["start"], s["stop"]) for s in spans]
                keep.append(sum(e - s for s, e in spans) <= limit * len(words_of(t)))
                texts.append(cut_words(t, spans))
            return pa.Table.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "row", "text"]).filter(pa.array(keep, pa.bool_()))

        cut = now.join(spans, "id").select("id", "row", "text", _merged(F.col("spans")).alias("spans"))
        now, limit = work_table(map_batches(cut, f, f"id bigint, row {kind}, text string"), "decontam-texts"), 1.0
