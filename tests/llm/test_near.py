"""Near duplicates against all pairs compared one by one."""

import random
import re

import pytest

from strata.llm import near


def brute(rows, percent=85, width=5):
    """(doc_id, n_shingles, component_id) by comparing every pair."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = max(1, len(words) - width + 1)
        sets.append({tuple(words[i : i + width]) for i in range(n)} if words else set())
    label = {doc: doc for doc, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and a is not None and b is not None:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted(((d, len(s), root(d)) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, groups, copies, length, edits):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=3))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randrange(3, length))]
        for _ in range(draw.randrange(1, copies)):
            text = list(base)
            for _ in range(draw.randrange(edits)):
                text[draw.randrange(len(text))] = word()
            rows.append(" ".join(text))
    draw.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def _got(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    out = near.near_duplicates(docs, **how).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) or r["doc_id"] is None for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("limit", [2048, 12])
def test_against_all_pairs(spark, limit):
    rows = corpus(4, 40, 12, 160, 4)
    assert _got(spark, rows, node_limit=limit) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rows = corpus(8, 1, 2, 400, 1)[:1]
    draw = random.Random(2)
    base = [f"w{draw.randrange(500)}" for _ in range(300)]
    for i in range(1, 120):
        text = list(base)
        for _ in range(i % 5):
            text[draw.randrange(300)] = f"z{i}"
        rows.append((i, " ".join(text)))
    assert _got(spark, rows, node_limit=30) == brute(rows)


def test_rows_of_any_kind(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d e f"),
            (None, "a b c d e"), (9, "word " * 3000), (10, "Word " * 4000), (11, "É b"), (12, "é b")]
    got = _got(spark, rows)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 2, 7), (None, 1, None),
         (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 1, 12)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(empty).count() == 0
    assert near.without_near_duplicates(empty).count() == 0
