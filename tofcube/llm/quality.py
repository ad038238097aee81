"""Quality rules by repetition coverage.

Every text is judged on its own, whole, in one pass without a shuffle. Words are numbered
exactly; rolling polynomial hashes of several n-gram lengths are then taken in numpy over the
word numbers, and the characters inside duplicated n-grams and duplicated lines are measured.

Defined cases: a null or empty text has no words and fails; repeated rows are judged alike;
an empty table gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import SPACE, binaries, map_batches

SYMBOLS = b"#*$%&|<>"
NGRAMS = (5, 8, 10)


@dataclass(frozen=True)
class QualityRules:
    """A text is kept with at least min_words words, at most max_repeat_percent of its words in
    repeated 3-word windows, and at most the given shares of its word characters inside
    duplicated n-grams (all occurrences) and inside duplicated lines (later occurrences)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_ngram_share: tuple[tuple[int, float], ...] = ((5, 0.50), (8, 0.45), (10, 0.40))
    max_line_share: float = 0.45


SIGNALS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, dup_line_chars bigint, dup5_chars bigint, dup8_chars bigint, dup10_chars bigint, base_failed boolean, kept boolean"
_NAMES = [x.split()[0] for x in SIGNALS.split(", ")]
_M = np.uint64(0x9E3779B97F4A7C15)


def _points(b: bytes) -> int:
    """Code points in words."""
    return int(np.count_nonzero((np.frombuffer(b.translate(None, SPACE), np.uint8) & 0xC0) != 0x80))


def _duplicated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    o = np.argsort(keys, kind="stable")
    s = keys[o]
    same = s[1:] == s[:-1]
    d = np.zeros(len(keys), bool)
    d[o[1:]] = same
    d[o[:-1]] |= same
    return d


def _covered(dup: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the marked windows."""
    steps = np.zeros(size + 1, np.int32)
    steps[: len(dup)] += dup
    steps[n : n + len(dup)] -= dup
    return np.cumsum(steps[:size]) > 0


def rolling(ids: np.ndarray, lengths: tuple[int, ...] = NGRAMS) -> dict[int, np.ndarray]:
    """Polynomial hashes, modulo 2**64, of all windows of each length: H_{a+b}(i) = H_a(i) M**b + H_b(i+a)."""
    one = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    one ^= one >> np.uint64(29)
    out: dict[int, np.ndarray] = {1: one}
    power = {1: _M}
    with np.errstate(over="ignore"):
        k = 1
        while 2 * k <= max(lengths) and 2 * k <= len(ids):
            out[2 * k] = out[k][: len(ids) - 2 * k + 1] * power[k] + out[k][k:]
            power[2 * k] = power[k] * power[k]
            k *= 2
        for n in lengths:
            if n in out or n > len(ids):
                continue
            h, done = None, 0
            for k in sorted((2**i for i in range(n.bit_length()) if n >> i & 1), reverse=True):
                part = out[k][done : done + len(ids) - n + 1]
                h = part if h is None else h * power[k] + part
                done += k
            out[n] = h
    return {n: out[n] for n in lengths if n <= len(ids)}


def signals(text: bytes, rules: QualityRules) -> tuple:
    """The values of SIGNALS for one text."""
    words = text.split()
    n = len(words)
    word_chars = _points(text) if n else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup_lines = line_chars = 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                if line.strip(SPACE):
                    dup_lines += 1
                    line_chars += _points(line)
            else:
                seen.add(line)
    lengths = tuple(dict.fromkeys((*NGRAMS, *(k for k, _ in rules.max_ngram_share))))  # those of the rules are measured too
    repeat, dup = 0, dict.fromkeys(lengths, 0)
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        if v < 2_000_000:
            keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        if v < n:  # else no window can repeat
            again = _duplicated(keys)
            if again.any():
                repeat = int(_covered(again, 3, n).sum())
                flat = (np.frombuffer(text.translate(None, SPACE), np.uint8) & 0xC0) != 0x80
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
                chars = np.diff(np.concatenate(([0], np.cumsum(flat)[ends - 1])))
                for k, h in rolling(ids, lengths).items():
                    d = _duplicated(h)
                    if d.any():
                        dup[k] = int(chars[_covered(d, k, n)].sum())
    base = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not base and line_chars <= rules.max_line_share * word_chars and all(dup[k] <= share * word_chars for k, share in rules.max_ngram_share)
    return n, word_chars, symbols, dup_lines, repeat, line_chars, *(dup[k] for k in NGRAMS), base, kept


def quality_signals(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements of SIGNALS, and the verdict `kept`."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [signals(t or b"", rules) for t in binaries(b.column(1))]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in SIGNALS.split(", ")]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", *_NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f, f"id {kind}, {SIGNALS}")
    return out.withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array([signals(t or b"", rules)[-1] for t in binaries(b.column(1))], pa.bool_())
        return pa.RecordBatch.from_arrays([pc.filter(c, kept) for c in b.columns], names=["row", "text"])

    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != text_col])
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns])
    out = map_batches(docs.select(row.alias("row"), F.col(text_col).alias("text")), f, f"row {row_type(rest)}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def row_type(df: DataFrame) -> str:
    return df.schema.simpleString()
