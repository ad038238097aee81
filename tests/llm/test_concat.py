"""Concatenate and cut: exact round trips, whatever the split, chunks of long texts, and the query itself."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube.llm import concat, queries

from .test_operators import EMPTY, corpus, frame


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(out, rows, tokenizer, capacity):
    """out: (id, start, length, crc, doc_tokens, sequence_id, offset) rows."""
    want = Counter((i, tuple(ids_of(tokenizer, t))) for i, t in rows)
    length = {i: {len(x) for k, x in want if k == i} for i, _ in rows}
    assert all(r[4] in length[r[0]] and r[2] >= 1 for r in out)
    assert sum(r[2] for r in out) == sum(len(x) * n for (_, x), n in want.items())
    filled = Counter()
    for s in {r[5] for r in out}:
        at = 0
        for r in sorted((r for r in out if r[5] == s), key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        filled[s] = at
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == capacity for s, n in filled.items() if s != len(filled) - 1)
    texts = dict(rows)
    for i, start, n, crc, *_ in out:
        if sum(1 for j, _ in rows if j == i) == 1:
            assert crc == zlib.crc32(np.array(ids_of(tokenizer, texts[i])[start : start + n], "<u4").tobytes())
    for i in {r[0] for r in out if len(length[r[0]]) == 1}:
        copies = sum(1 for j, _ in rows if j == i)
        assert Counter(k for r in out if r[0] == i for k in range(r[1], r[1] + r[2])) == Counter(list(range(next(iter(length[i])))) * copies)


@pytest.mark.parametrize("capacity,parts", [(16, 1), (64, 5), (1, 3), (100_000, 3)])
def test_pieces_and_sequences(spark, path, tokenizer, capacity, parts):
    rows = corpus(8, 20 if capacity == 1 else 60)
    rows += [rows[3], rows[3], (999, "odd <|endoftext|> end  \U0001f600  "), (None, "no id")]
    if capacity == 1:
        rows = [r for r in rows if len(r[1] or "") < 400]
    df = frame(spark, rows).repartition(parts)
    got = concat.concatenate_and_cut(df, path, capacity=capacity)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check([tuple(r) for r in got.withColumn("ids", F.crc32("ids")).collect()], rows, tokenizer, capacity)
    stream = concat.token_stream(df, path)
    whole = {r.sequence_id: r for r in concat.sequences(stream, capacity, pad_id=7).collect()}
    flat = [x for r in sorted(stream.collect(), key=lambda r: r.place) for x in np.frombuffer(r.ids, "<u2").tolist()]
    assert sorted(whole) == list(range(-(-len(flat) // capacity)))
    for s, r in whole.items():
        own = flat[s * capacity : (s + 1) * capacity]
        pad = 0 if len(own) & (len(own) - 1) == 0 else capacity - len(own)
        assert r.n_ids == len(own) and np.frombuffer(r.ids, "<u4").tolist() == own + [7] * pad


def test_ids_of_four_bytes(spark, path, tokenizer):
    """An end id that needs more than two bytes."""
    rows = [(1, "one two"), (2, ""), (3, None)]
    stream = concat.token_stream(spark.createDataFrame(rows, EMPTY), path, end_id=1 << 20)
    assert {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in stream.collect()} == {i: ids_of(tokenizer, t)[:-1] + [1 << 20] for i, t in rows}
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in concat.pieces(stream, 100).collect())[0] == [*ids_of(tokenizer, "one two")[:-1], 1 << 20][:100]


def test_power_of_two_is_not_padded(spark, path):
    stream = concat.token_stream(spark.createDataFrame([(1, ""), (2, None), (3, ""), (4, "")], EMPTY), path)
    assert [(r.n_ids, len(r.ids)) for r in concat.sequences(stream, 7).collect()] == [(4, 16)]


def test_chunks_give_the_same_ids(path, tokenizer, monkeypatch):
    monkeypatch.setattr(concat, "CHUNK", 20)
    rnd = random.Random(3)
    parts = ["a", "Bc", "é", " ", "  ", "\n", "12", "'s", "don't", "<|endoftext|>", " ", "!", "\U0001f600", "x y", " z w "]
    e = concat.Encoder(path)
    assert e.cuts
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 200))) for _ in range(300)]
    assert any(len(e.chunks(t)) > 3 for t in texts)
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert "".join(e.chunks(t)) == t and ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_empty_table_and_long_text(spark, path, tokenizer):
    assert concat.concatenate_and_cut(spark.createDataFrame([], EMPTY), path).count() == 0
    assert concat.sequences(concat.token_stream(spark.createDataFrame([], EMPTY), path)).count() == 0
    rows = [(1, "word and more of it " * 100_000), (2, "z" * 50_000)]
    got = [tuple(r) for r in concat.concatenate_and_cut(frame(spark, rows), path).withColumn("ids", F.crc32("ids")).collect()]
    assert sum(r[2] for r in got) == sum(len(ids_of(tokenizer, t)) for _, t in rows)
    assert {r[4] for r in got} == {len(ids_of(tokenizer, t)) for _, t in rows}
    with pytest.raises(ValueError):
        concat.concatenate_and_cut(frame(spark, rows), path, capacity=0)


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_concatenate_and_cut(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check([tuple(r) for r in got.collect()], rows, tokenizer, 1024)
