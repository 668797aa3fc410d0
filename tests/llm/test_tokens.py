"""Token counts and ids against the library on whole texts."""

import random

import numpy as np
import pytest

from strata.llm import tokens

PIECES = [
    "don't", "we'll", "I've", "they're", "'s", "''s", " 's", "'", "''", "it's", "x'y", "'re", "'ree", "'rx", "'ll", "'l",
    "word", "Straße", "café", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", "12", "3.5", "²", "½x", "ª", "µm",
    "×", "a×b", "…", "–", "“q”", " ", "­", "日本", " ", "!", "?!", "a_b", "_", "\x0b", "\x1c", "\x00", "\x85",
    "<|endoftext|>", "<|endof", "😀", "ŉ", "Œuvre", "١٢", "é", "\x7f", "¡hola!", "€",
]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder()


def _texts(seed, n, length):
    draw = random.Random(seed)
    plain = [p for p in PIECES if p.isascii()]
    return ["".join(draw.choices(PIECES if i % 3 == 0 else plain, k=draw.randrange(length))) for i in range(n)]


def _library(encoder, text):
    return encoder.library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(encoder):
    texts = ["", " ", "\x00", "a", *_texts(1, 1500, 14)]
    got = list(encoder.encode([t.encode() for t in texts]))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == _library(encoder, text), repr(text)
    assert list(encoder.encode([t.encode() for t in texts], want_ids=False)) == [len(x) for x in got]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (200, 30)])
def test_spliced_chunks_equal_the_whole(encoder, chunk, overlap):
    for text in [*_texts(2, 60, 150), "a" * 1000, " " * 500 + "x" + "\n" * 300, "ab <|endoftext|>" * 60, "é" * 400]:
        parts = list(tokens.encode_long(encoder, text.encode(), chunk, overlap))
        assert np.concatenate(parts).tolist() == _library(encoder, text), repr(text)


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_SPANS", 60)
    encoder = tokens.Encoder()
    texts = _texts(3, 200, 10)
    got = [x for t in texts for x in encoder.encode([t.encode()])]
    assert [x.tolist() for x in got] == [_library(encoder, t) for t in texts]


def test_rows_of_any_kind(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "a b", 7), (2, "", 7), (3, "word " * 600, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokens.token_counts(docs).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False),
                          (3, 3000, 601, True)], key=str)
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_long_rows_of_a_table_are_spliced(spark, monkeypatch, encoder):
    rng = random.Random(9)
    texts = ["".join(rng.choices(PIECES, k=n)) for n in (3000, 9000, 20000, 30000)]
    texts += ["word " * 9000, "x" * 40000, " " * 40000, "é" * 30000, "a" * tokens.CHUNK_BYTES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()}
    assert got == {i: (len(t.encode()), len(_library(encoder, t))) for i, t in enumerate(texts)}
    calls = []
    monkeypatch.setattr(tokens, "encode_long", lambda e, t: calls.append(len(t)) or iter([]))
    list(encoder.encode([t.encode() for t in texts], want_ids=False))
    assert len(calls) == sum(len(t.encode()) > tokens.CHUNK_BYTES for t in texts) >= 6
