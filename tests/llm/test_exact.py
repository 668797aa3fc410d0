"""Exact dedup against grouping whole texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from strata.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for _, no_id, doc, i in members:
            out.append((None if no_id else doc, keep, len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def _corpus():
    draw = random.Random(3)
    base = ["".join(draw.choices("abc é\n\t", k=draw.choice([0, 3, 40, 3000, 30_000]))) for _ in range(30)]
    rows = [(i, draw.choice(base)) for i in range(150)]
    rows += [(200 + i, t.replace(" ", " \n") if i % 2 else t + "!") for i, t in enumerate(base)]
    rows += [(None, base[3]), (None, base[3]), (7, rows[7][1]), (400, None), (-3, ""), (401, " \x0b\x0c\r"), (402, "\xa0")]
    return rows


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, `a.b` int")


def test_against_grouping(spark):
    rows = _corpus()
    out = exact.exact_duplicates(_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == brute(rows)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in out}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_rows_that_stay(spark):
    rows = _corpus()
    docs = _docs(spark, rows)
    got = exact.without_exact_duplicates(docs)
    assert got.columns == docs.columns
    stay = {(r[1], r[3]) for r in brute(rows)}
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((d for d, _ in stay), key=str)
    assert exact.without_exact_duplicates(docs.limit(0)).count() == 0
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_chunks_are_content_defined():
    draw = random.Random(1)
    data = bytes(draw.randrange(256) for _ in range(60_000))
    for text in (data, b"", b"x", data[:512], data[:513], b"a" * 50_000):
        parts = exact.chunks(text)
        assert b"".join(parts) == text and all(0 < len(p) <= exact.MAX_CHUNK for p in parts)
    shared = set(exact.chunks(data)) & set(exact.chunks(b"new start " + data))
    assert len(shared) >= 0.8 * len(exact.chunks(data))


@pytest.mark.parametrize("size", [1, 2])
def test_identifiers_are_verified(spark, size):
    docs = _docs(spark, [(i, f"text {i}") for i in range(600)])
    found = exact.verified_size(docs, size)
    assert found > size and not exact._colliding(docs, found)
