"""Packing: every piece once, within its sequence, against the plain definition of pieces."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np

from strata.llm import packing
from strata.llm.tokens import Encoder


def _check(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_steps_keep_every_piece_once():
    draw = random.Random(5)
    sizes = np.array([draw.randrange(1, 100) for _ in range(300)])
    packer = packing.Packer(sizes, 100, [1])
    a, b = packer.start(), packer.start()
    for bins in (a, b, packer.crossover(a, b), packer.mutate(a), *packer.evolve([a, b], 5)):
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert all(packer.room(x) >= 0 for x in bins)
    best = packer.evolve([a, b], 20)[0]
    assert len(best) <= min(len(a), len(b))
    assert packing._bins(packing._flat(best, 300)) == [sorted(x) for x in best]


def test_pack_against_brute_force(spark):
    draw = random.Random(9)
    texts = [" ".join("w" * draw.randrange(1, 9) for _ in range(draw.randrange(60))) for _ in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1), (None, "x y z", 1), (900, None, 1), (901, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack(docs, length=32).collect()
    encoder, want = Encoder(), []
    for doc, text, _ in rows:
        ids = encoder.library.encode(text or "", add_special_tokens=False).ids + [2]
        for k, (at, size) in enumerate(packing.cut(len(ids), 32)):
            want.append((doc, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
    mine = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert _check(got, 32) <= math.ceil(sum(w[3] for w in want) / 32) * 1.05 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_islands_and_migration(spark):
    draw = random.Random(3)
    sizes = [draw.randrange(1, 1024) for _ in range(500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    got = packing.solve(items, problem=100, islands=3, epochs=3).join(items, "item").withColumnRenamed("size", "length").collect()
    assert len(got) == 500
    assert _check(got, 1024) <= sum(sizes) / 1024 * 1.08 + 5
