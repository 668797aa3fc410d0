"""Substring dedup against the plain definition of covered words."""

import random
import re

import numpy as np
import pytest

from strata.llm import substrings
from strata.llm.tables import read


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    last = 1 << 63
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, last), last if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < (last if doc is None else doc):
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def _got(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, part int")
    out = substrings.without_repeats(docs, **how).collect()
    for r in out:
        assert r["n_removed"] == sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") * draw.randrange(1, 3)
    passages = [[word() for _ in range(draw.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(draw.randrange(4)):
            text += [word() for _ in range(draw.randrange(20))] + draw.choice(passages)[draw.randrange(8) :]
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("subtree", [1 << 20, 200, 3])
def test_against_the_definition(spark, subtree):
    rows = corpus(6, 120)
    assert _got(spark, rows, subtree=subtree) == brute(rows)


def test_rows_of_any_kind(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (3, "x " + text + "\x0by é"), (None, text), (None, text + " z"), (8, None), (9, ""), (10, " \n "),
            (11, "a " * 5000), (-4, "a " * 12), (12, "a " * 13)]
    assert _got(spark, rows) == brute(rows)
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert _got(spark, rows) == brute(rows)


def test_blobs_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 500, 70_000):
        paths = np.sort(draw.integers(0, 1 << 56, n, dtype=np.uint64))
        docs = draw.integers(-5, 1 << 62, n)
        for ordered in (True, False):
            a, b = substrings.unpack(substrings.pack(paths, docs, ordered), ordered)
            assert (a == paths).all() and (b == docs).all()


def test_census_grows_with_the_text():
    limit = substrings.SUBTREE
    assert substrings._bits(0, limit) == substrings._bits(10**8, limit) == 10
    for size in (10**10, 10**11):
        # Of evenly spread prefixes, each bucket of the shortest ones fits into a subtree.
        assert size / 2 / 2 ** substrings._bits(size, limit) < limit / 2
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    fine, coarse = (substrings._buckets(words, 13, bits) for bits in (16, 10))
    assert (fine >> np.uint64(6) == coarse).all()
    counts = np.zeros((4, 1 << 16), np.int64)
    known = substrings._subtree_of(fine, substrings.paths_of(words, 13), counts, limit)
    assert known.max() < 1 << 56  # all by their first word
