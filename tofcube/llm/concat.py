"""Concatenate and cut: documents as one stream of token ids, cut into sequences of a fixed length.

A first pass encodes each document once, puts the end id behind it, and writes its ids with the
number of ids before it in its partition. The partitions' totals, one row each, are summed to
global offsets. The second pass knows from them the place of every id in the stream, and cuts
each document at the multiples of the capacity: every sequence but the last is full, so there is
no padding before it. Texts move nowhere and ids are shuffled nowhere; whole sequences are put
together where their ids are read, and only the two that reach over the ends of a run of rows
leave boundary records, which are joined by their sequence.

The stream follows the order of the input's partitions and of the rows in them. A very long text
is encoded in chunks, cut where the tokenizer itself always cuts, so a task holds one document's
ids and one chunk's encoding.

Defined cases: a null or empty text is the end id alone; repeated rows are documents each; an
empty table gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube.llm.common import bound_batches, work_table

#: Characters of a chunk, and of the chunks that are encoded together.
CHUNK, TOGETHER = 1 << 15, 1 << 19
#: A single space between ASCII letters: byte-level pre-tokenizers start a piece there, whatever is around.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: The pieces of byte-level pre-tokenizers, and the letters that stand for bytes in their vocabularies. Fixed values.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: A space between white space and white space or the end, and the other spaces: where no special string is near, a piece starts at each of these.
_INSIDE, _STARTS = re.compile(r"\s (?=\s|\Z)"), re.compile(r"(?<=\S) | (?=\S)")


class Encoder:
    """A tokenizer file as a function of texts; without added tokens, truncation or padding.

    Byte-level vocabularies are looked up by word: words between spaces where a piece always
    starts are encoded by the tokenizer once, and kept. A dictionary of more than MOST words is
    set aside for a new one, into which it gives what is met again until that is full too."""

    MOST, LONG = 500_000, 48

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = all(not (a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"])) for a in added)
        self.cuts = plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [a["content"] for a in added]
        self.tokenize, self.short = self.tokenizer.model.tokenize, {}
        self.most = max(self.tokenizer.get_vocab().values(), default=0)
        self.heads: dict[str, bytes] = {}  # words that start a text, to their ids of four bytes each
        self.words: dict[str, bytes] = {}  # words behind a space
        self.older: dict[str, bytes] = {}  # such words of before

    def chunks(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cuts and len(text) - at > CHUNK and (m := _CUT.search(text, at + CHUNK)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _together(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each, some at a time."""
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= TOGETHER):
                held += len(texts[stop])
                stop += 1
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[at:stop], add_special_tokens=False))
            at = stop

    def _ids(self, word: str) -> bytes:
        """The ids of a short text of Latin letters or ASCII: its pieces follow from the pattern, and the vocabulary is asked for each, past the steps that align characters."""
        out: list[int] = []
        for p in (word,) if word.isalpha() or word[1:].isalpha() and word[0] == " " else _PIECES.findall(word):
            ids = self.short.get(p)
            if ids is None:
                ids = [t.id for t in self.tokenize(p.encode().decode("latin-1").translate(_LETTERS))]
                if len(p) < 3:  # few of them
                    self.short[p] = ids
            out += ids
        return array("i", out).tobytes()

    def _learn(self, held: dict[str, bytes], words: set[str], before: str) -> list[str]:
        """Encode the words that aren't held; those too long to be kept are returned."""
        new = words.difference(held)
        if len(held) + len(new) > self.MOST:
            if before:
                self.older = dict(held)
            held.clear()
            new = words
        if before:
            rest = new.difference(self.older)
            held.update((w, self.older[w]) for w in new.difference(rest))
            new = rest
        alone = []
        for w in new:
            if 0 < len(w) <= self.LONG and (w.isascii() or max(w) < "\u0250"):
                held[w] = self._ids(before + w)
            else:
                alone.append(w)
        held.update(zip(alone, (array("i", ids).tobytes() for ids in self._together([before + w for w in alone])), strict=True))
        return [w for w in new if len(w) > self.LONG]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if self.cuts and not any(s in t for s in self.special):
                split[i] = _STARTS.split(t) if _INSIDE.search(t) else t.split(" ")
        heads = [p[0] for p in split.values()]
        for p in split.values():
            del p[0]
        long = [(self.heads, self._learn(self.heads, set(heads), "")), (self.words, self._learn(self.words, set().union(*split.values()), " "))]
        find = self.words.__getitem__
        out = {i: np.frombuffer(b"".join([self.heads[h], *map(find, p)]), np.int32) for h, (i, p) in zip(heads, split.items(), strict=True)}
        for held, words in long:
            for w in words:
                del held[w]
        pieces = {i: self.chunks(t) for i, t in enumerate(texts) if i not in split}
        ids = self._together([c for p in pieces.values() for c in p])
        for i, p in pieces.items():
            out[i] = np.array([x for _ in p for x in next(ids)], np.int32)
        return [out[i] for i in range(len(texts))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (with the end id; binary, little-endian, of two bytes each where all ids of the vocabulary fit, else of four), n and place (the ids before it in the whole stream), one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer_path)
        width = "<u2" if max(own.most, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # a few long documents, or many short ones
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) <= 4 * TOGETHER):
                    held += len(texts[stop])
                    stop += 1
                found = own.encode(texts[at:stop])
                n = np.array([len(x) + 1 for x in found], np.int64)
                ids = [x.astype(width).tobytes() + end for x in found]
                local = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(local)], names=["id", "ids", "n", "part", "local"])
                at = stop

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = work_table(rows.mapInArrow(run, f"id {kind}, ids binary, n bigint, part int, local bigint"), "token-stream")
    totals = rows.groupBy(F.col("part").alias("t_part")).agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("t_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("t_part", before.alias("before"))  # a row for each partition of the input
    return rows.join(F.broadcast(offsets), F.col("part") == F.col("t_part")).select("id", "ids", "n", (F.col("local") + F.col("before")).alias("place"))


def _ids(col: pa.Array, n: list[int]) -> list[np.ndarray]:
    """The ids of each row, of four bytes."""
    return [np.frombuffer(raw, "<u2" if len(raw) == 2 * k else "<u4").astype("<u4", copy=False) for raw, k in zip(col.to_pylist(), n, strict=True)]


def pieces(stream: DataFrame, capacity: int = 1024) -> DataFrame:
    """id, start, length, ids (binary, little-endian 32-bit), n, sequence_id, offset: one row per piece of a document, each within one sequence."""
    if capacity < 1:
        raise ValueError("a capacity of one id or more is needed")
    kind = stream.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, place = (b.column(k).to_numpy() for k in (2, 3))
            first, last = place // capacity, (place + n - 1) // capacity
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            start = np.maximum(sequence * capacity - place[row], 0)
            stop = np.minimum((sequence + 1) * capacity - place[row], n[row])
            ids = _ids(b.column(1), n.tolist())
            cut = [ids[r][x:y].tobytes() for r, x, y in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(cut, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(place[row] + start - sequence * capacity)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids", "n", "sequence_id", "offset"])

    return stream.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, n bigint, sequence_id bigint, offset bigint")


def sequences(stream: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids, ids (binary, padded) of every sequence.

    The last is padded to the capacity, unless its length is a power of two. A sequence whose ids
    are read together is whole at once; the others are joined from boundary records, of which
    each run of rows leaves two at most, and a sequence has at most `capacity` ids of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # of the ids from `at` on, fewer than a sequence after each row
        at = end = -1

        def record(ids: bytes, at: int) -> tuple[int, int, bytes]:
            return at // capacity, at % capacity, ids

        def batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            k, o, x = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(o, pa.int64()), pa.array(x, pa.binary())], names=["sequence_id", "offset", "ids"])

        for b in batches:
            out = []
            for ids, place in zip(_ids(b.column(1), b.column(2).to_pylist()), b.column(3).to_pylist(), strict=True):
                if place != end and held:
                    out.append(record(b"".join(held), at))
                    held = []
                if not held:
                    at = place
                end = place + len(ids)
                held.append(ids.tobytes())
                if end // capacity > at // capacity:
                    raw = b"".join(held)
                    while end // capacity > at // capacity:
                        n = capacity - at % capacity
                        out.append(record(raw[: 4 * n], at))
                        raw, at = raw[4 * n :], at + n
                    held = [raw] if raw else []
            yield batch(out)
        yield batch([record(b"".join(held), at)] if held else [])

    found = work_table(stream.mapInArrow(run, "sequence_id bigint, offset bigint, ids binary"), "sequence-parts")
    whole = F.octet_length("ids") == 4 * capacity
    parts = found.where(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))
    n = (F.octet_length("ids") / 4).cast("int")
    pad = F.when((n == capacity) | (F.bit_count(n) == 1), F.lit(0)).otherwise(F.lit(capacity) - n)
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad))
    return found.where(whole).select("sequence_id", "ids").unionByName(joined).select("sequence_id", n.cast("bigint").alias("n_ids"), F.concat("ids", padding).alias("ids"))


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids, doc_tokens, sequence_id, offset of every piece."""
    out = pieces(token_stream(docs, tokenizer_path, end_id, id_col, text_col), capacity)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
