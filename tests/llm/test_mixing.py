"""Mixing: targets against water filling step by step, quotas met, draws disjoint."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from strata.llm import mixing


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([600, 10, 10], [1, 2, 3]) == [560, 30, 30]
    assert mixing.targets([0, 5], [1, 2]) == [0, 5]
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]
    draw = random.Random(1)
    for _ in range(50):
        sizes = [draw.choice([0, 1, 10, 1000]) * draw.randrange(20) for _ in range(8)]
        weights = [1 + i % 3 for i in range(8)]
        goals = mixing.targets(sizes, weights)
        assert sum(goals) == sum(sizes)
        open_ = [i for i in range(8) if goals[i] < 3 * sizes[i]]
        assert all(g <= 3 * s for g, s in zip(goals, sizes))
        assert len({goals[i] / weights[i] for i in open_}) <= 1
        level = max((goals[i] / weights[i] for i in open_), default=Fraction(10**9))
        assert all(goals[i] / weights[i] <= level for i in range(8) if sizes[i])


def test_split_is_exact():
    quotas = np.array([5, 0, 100, 7])
    left = mixing._split(quotas, Fraction(1, 2), np.random.default_rng(1))
    assert left.sum() == 56 and (left >= 0).all() and (left <= quotas).all()
    draws = [mixing._split(quotas, Fraction(1, 2), np.random.default_rng(i))[2] for i in range(300)]
    assert abs(np.mean(draws) - 50) < 0.5 and 1 < np.std(draws) < 2.5


def _corpus(seed, n):
    draw = random.Random(seed)
    names = ["b", "a", "é", "z", None, "Z"]
    rows = []
    for i in range(n):
        source = "b" if draw.random() < 0.4 else draw.choice(names)
        rows.append((i, " ".join("w" * (1 + k % 3) for k in range(draw.randrange(30) if i % 9 else 0)), source, 0, 0))
    return rows + [(5, rows[5][1], rows[5][2], 0, 0), (None, "no id here", "a", 0, 0), (n, None, "a", 0, 0)]


def test_plan(spark):
    rows = _corpus(2, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, `take.shard` int")
    planned = mixing.plan(docs, shard_words=300).cache()
    got = planned.collect()
    again = mixing.plan(docs, shard_words=300).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = Counter()
    for _, text, source, *_ in rows:
        words[source] += _size(text)
    order = sorted(words, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([words[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    assert len(got) == len(rows)
    by_doc = {}
    for doc, text, source, *_ in rows:
        by_doc.setdefault((doc, _size(text)), source)
    taken, shards = Counter(), defaultdict(int)
    for r in got:
        source = by_doc[r["doc_id"], r["size"]]
        assert r["source_size"] == words[source] and r["target"] == float(goals[source])
        total = sum(t["words"] for t in r["takes"])
        assert total <= 3 * r["size"] and all(0 < t["words"] <= r["size"] for t in r["takes"])
        assert len({t["pass"] for t in r["takes"]}) == len(r["takes"])
        taken[source] += total
        for t in r["takes"]:
            shards[t["shard"]] += t["words"]
    # Documents are taken whole: within half of a source's largest one.
    largest = {s: max(_size(t) for _, t, o, *_ in rows if o == s) for s in order}
    assert all(2 * abs(taken[s] - goals[s]) <= largest[s] + 1 for s in order)
    assert len(shards) > 3 and max(shards) < 20


def test_mix_repeats_whole_documents(spark):
    rows = _corpus(3, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, `take.shard` int")
    mixed = mixing.mix(docs, shard_words=500)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += _size(r["text"])
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += _size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    largest = {s: max(_size(t) for _, t, o, *_ in rows if o == s) for s in order}
    assert all(2 * abs(got[s] - g) <= largest[s] + 1 for s, g in zip(order, goals))
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(i, t) for i, t, *_ in rows}


def test_other_splits_give_the_same_mix(spark):
    docs = spark.createDataFrame(_corpus(4, 300), "doc_id long, text string, source string, size int, `take.shard` int")
    plans = [
        sorted(map(str, mixing.plan(d, shard_words=300).collect())) for d in (docs.coalesce(1), docs.repartition(3), docs.repartition(11))
    ]
    assert plans[0] == plans[1] == plans[2]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0), (2, " ", "a", 1)], empty.schema)
    assert [r["takes"] for r in mixing.plan(blank).orderBy("doc_id").collect()] == [[], []]
    assert mixing.plan(blank).agg(F.sum("target")).first()[0] == 0.0
