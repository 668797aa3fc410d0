"""The pipeline's stages against brute-force versions, each on its own input."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from strata.llm import mixing
from strata.llm.tables import read
from strata.session import save
from test_near import brute as near_brute


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    documents = read(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame(
        [(10**9, None, "en", "src1", 0), (10**9 + 1, "12 34", "en", None, 5), (10**9 + 2, "", None, "src2", 0)], documents.schema
    )
    docs = save(documents.unionByName(extra), "documents")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(save(stage(spark, outs[-1], "unused"), name))
        if name != "best_fit_packing":
            assert outs[-1].columns == docs.columns
    before, language, exact, near, mixed, packed = map(_rows, outs)

    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in language}
    assert gone >= {10**9, 10**9 + 1, 10**9 + 2} and len(gone) <= 0.05 * len(before)

    groups = defaultdict(list)
    for r in language:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", r["text"])].append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in exact) == sorted(min(g)[1] for g in groups.values())

    labels = near_brute([(r["doc_id"], r["text"]) for r in exact], percent=80)
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, _, c in labels if d == c)

    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in near:
        sizes[r["source"]] += _size(r["text"])
    for r in mixed:
        taken[r["source"]] += _size(r["text"])
        copies[r["doc_id"]] += 1
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    largest = {s: max(_size(r["text"]) for r in near if r["source"] == s) for s in order}
    assert all(2 * abs(taken[s] - g) <= largest[s] + 1 for s, g in zip(order, goals))
    assert max(copies.values()) <= 3 + 1 and set(copies) <= {r["doc_id"] for r in near}

    tokens, places = Counter(), defaultdict(list)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(tokens) == set(copies)
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024
    assert len(places) <= math.ceil(sum(tokens.values()) / 1024) * 1.02 + 1


def test_run(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 100
