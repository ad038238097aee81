"""Token counts by prefix dynamic programming.

A text is split at ASCII white space into chunks, across which the tokenizer never merges. Within
a chunk the tokenizer's own normaliser and pre-tokenizer give the pieces, and the count of a
piece comes from a dynamic programme over its prefixes: the last token of every prefix is the
one vocabulary entry that ends there and is compatible with the last token of the prefix before
it (two tokens are compatible if encoding their concatenation gives just these two). So each
prefix stores its exact count, and truncation and budget questions need no second encoding.

Defined cases: a null or empty text has 0 tokens; chunks of any length are counted whole;
repeated rows are counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.llm.common import binaries, map_batches

END = "</w>"
NEVER = 1 << 60
#: For chunks of printable ASCII, the pre-tokenizer's pattern (a fixed value of the vocabulary file) with its classes cut to ASCII.
_ASCII = re.compile(rb"[!-~]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class PrefixCounter(dict):
    """Counts for one BPE vocabulary file with word-end symbols. As a dict: chunk (bytes) to its token count."""

    #: Entries held before the cache starts anew; longer chunks than LONG bytes are never held.
    MOST, LONG = 1_000_000, 48

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"]["type"] != "BPE" or model["model"]["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word-end symbols is expected")
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.vocab = model["model"]["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["model"]["merges"])}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, int] = {}

    # -- one piece -----------------------------------------------------------------

    def _apart(self, left: list[str], right: list[str]) -> bool:
        """Whether merging by rank, the leftmost first, ends with just these two tokens: no merge ever crosses from left to right."""
        symbols, cut, rank = left + right, len(left), self.rank
        ranks = [rank.get(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            if i == cut - 1:
                return False
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            cut -= i < cut
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), NEVER)
        return len(symbols) == 1 + (cut > 0)

    def _fits(self, left: str, right: str) -> bool:
        """Whether the token `left` ('' at the start) may stand before the token `right`."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > self.MOST:
                self.pairs.clear()
            chars = list(right)
            if right.endswith(END) and len(right) > len(END):
                chars[-len(END) - 1 :] = [right[-len(END) - 1 :]]
            got = self.pairs[key] = self._apart(list(left), chars)
        return got

    def _plain(self, piece: str) -> list[tuple[int, str]]:
        """Count and last token of each prefix, from the empty one on, without a word end."""
        out: list[tuple[int, str]] = [(0, "")]
        vocab, fits, longest = self.vocab, self._fits, self.longest
        for i in range(1, len(piece) + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = piece[j:i]
                if token in vocab and fits(out[j][1], token):
                    out.append((out[j][0] + 1, token))
                    break
            else:
                raise ValueError(f"no encoding of {piece[:i]!r}")
        return out

    def _ended(self, piece: str, plain: list[tuple[int, str]], i: int) -> int:
        """Count of piece[:i] as a whole piece."""
        for j in range(max(0, i - self.longest), i):
            token = piece[j:i] + END
            if token in self.vocab and self._fits(plain[j][1], token):
                return plain[j][0] + 1
        raise ValueError(f"no encoding of {piece[:i]!r}")

    def piece_prefix_counts(self, piece: str) -> list[int]:
        """Token counts of piece[:1], piece[:2], ... each taken as a whole piece."""
        plain = self._plain(piece[:-1])
        return [self._ended(piece, plain, i) for i in range(1, len(piece) + 1)]

    def piece_count(self, piece: str) -> int:
        got = self.pieces.get(piece)
        if got is None:
            got = self._ended(piece, self._plain(piece[:-1]), len(piece))
            if len(piece) <= self.LONG:
                if len(self.pieces) >= self.MOST:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    # -- chunks and texts ------------------------------------------------------------

    def _pieces(self, chunk: str) -> list[str]:
        tok = self.tokenizer
        return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(chunk))]

    def chunk_count(self, chunk: str) -> int:
        parts = self.special.split(chunk) if self.special else [chunk]  # a special string in a text is one token
        return len(parts) - 1 + sum(self.piece_count(p) for part in parts if part for p in self._pieces(part))

    def __missing__(self, chunk: bytes) -> int:
        if _ASCII.fullmatch(chunk) and b"<|" not in chunk:
            n = sum(map(self.piece_count, _PIECES.findall(chunk.decode("ascii").lower())))
        else:
            n = self.chunk_count(chunk.decode("utf-8"))
        if len(chunk) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[chunk] = n
        return n

    def prefix_counts(self, text: bytes) -> list[int]:
        """Exact counts of the prefixes that end with each chunk of the text."""
        return list(accumulate(map(self.__getitem__, text.split())))

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))

    def ends(self, text: bytes) -> list[int]:
        """Byte offsets at which the chunks end."""
        out, at = [], 0
        for c in text.split():
            at = text.index(c, at) + len(c)
            out.append(at)
        return out

    def truncate(self, text: bytes, budget: int) -> tuple[bytes, int]:
        """The longest prefix of at most `budget` tokens, and its count."""
        counts = self.prefix_counts(text)
        k = bisect_right(counts, budget)
        if k == len(counts):
            return text, counts[-1] if counts else 0
        ends, base = self.ends(text), counts[k - 1] if k else 0
        start = ends[k - 1] if k else 0
        chunk = text.split()[k].decode()
        lead = text.index(chunk.encode(), start)
        i, n = self._longest(chunk, budget - base)
        return text[: lead + len(chunk[:i].encode())], base + n

    def _longest(self, chunk: str, budget: int) -> tuple[int, int]:
        """Length of the longest proper prefix of a chunk with at most `budget` tokens, and its count.

        Only the piece in which the budget ends is looked into, by the counts at its prefixes; a
        chunk whose pieces don't line up with its characters (normalisation changes their number)
        and special strings are tried prefix by prefix."""
        pieces = self._pieces(chunk)
        if "".join(pieces) == chunk.lower() and len(chunk.lower()) == len(chunk) and not (self.special and self.special.search(chunk)):
            at = n = 0
            for p in pieces:
                if n + (c := self.piece_count(p)) > budget or at + len(p) == len(chunk):
                    break
                at, n = at + len(p), n + c
            inner = self.piece_prefix_counts(p)
            for i in range(len(p) - 1, 0, -1):
                if n + inner[i - 1] <= budget and n + self.chunk_count(chunk[at : at + i]) <= budget:
                    return at + i, n + self.chunk_count(chunk[at : at + i])
            return at, n
        for i in range(len(chunk) - 1, 0, -1):
            if (n := self.chunk_count(chunk[:i])) <= budget:
                return i, n
        return 0, 0


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(path)


def _input(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every whole text."""
    src, kind = _input(docs, id_col, text_col)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        texts = [t or b"" for t in binaries(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(c.count, texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return map_batches(src, f, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def token_prefixes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, byte_ends and tokens: where each chunk of the text ends, and the exact count of the prefix up to there."""
    src, kind = _input(docs, id_col, text_col)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        texts = [t or b"" for t in binaries(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.ends(t) for t in texts], pa.list_(pa.int64())), pa.array([c.prefix_counts(t) for t in texts], pa.list_(pa.int64()))], names=["id", "byte_ends", "tokens"])

    return map_batches(src, f, f"id {kind}, byte_ends array<bigint>, tokens array<bigint>").withColumnRenamed("id", id_col)


def truncate_to_budget(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text cut to its longest prefix of at most `budget` tokens (null stays null), and n_tokens of that."""
    src, kind = _input(docs, id_col, text_col)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        cut = [(None, 0) if t is None else c.truncate(t, budget) for t in binaries(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in cut], pa.binary()).cast(pa.string()), pa.array([n for _, n in cut], pa.int64())], names=["id", "text", "n_tokens"])

    return map_batches(src, f, f"id {kind}, text string, n_tokens bigint").withColumnRenamed("id", id_col)
