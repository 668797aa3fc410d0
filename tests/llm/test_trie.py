"""Prefix trie against a trie in plain Python; list ranking, running sums, digests of ids."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strata.llm import queries, trie


def _brute(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(c - 100 * int(c / 100)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in members if p}
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in parents for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _rows(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 350), n):
        for t in range(draw.randrange(9)):
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "é😀", "", None, "long " * 9])))
    rows += [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (None, 1, "user", "lost"), (100, 0, None, None)]
    # One conversation holds a third of all rows and copies of one conversation another part.
    rows += [(100, k, "user", str(k % 3)) for k in range(len(rows))]
    return rows + [(200 + 7 * k, t, "user", "same") for k in range(12) for t in range(7)]


def _query(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    named = table.select("*", F.lit(1).alias("node"), F.lit(2).alias("arc.to"))
    named.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return queries.op11_prefix_trie(spark, str(tmp_path))


def test_query_against_plain_trie(spark, tmp_path):
    rows = _rows(1, 60)
    got = _query(spark, tmp_path, rows).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)


def test_empty(spark, tmp_path):
    assert _query(spark, tmp_path, []).collect() == []


def test_only_a_turnless_conversation(spark, tmp_path):
    """Conversation 1 keeps nothing of its own and its hundred's first does not exist."""
    conv = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    (row,) = _query(spark, tmp_path, [(conv, 0, "user", "x")]).collect()
    assert (row.conv_id, row.depth, row.n_convs, row.n_leaves) == (conv, 0, 1, 1)
    assert row.ends_sha256 == hashlib.sha256(str(conv).encode()).hexdigest()


def test_list_rank(spark):
    draw = random.Random(3)
    for n, short in ((1, 1), (2, 1), (40, 4), (300, 10)):
        arcs = draw.sample(range(10 * n), n)
        gaps = [draw.randrange(1, 5) for _ in arcs]
        links = [(a, arcs[i + 1] if i + 1 < n else None, gaps[i]) for i, a in enumerate(arcs)]
        got = trie.list_rank(spark.createDataFrame(links, "arc long, to long, gap long"), short=short, rate=4)
        assert dict(map(tuple, got.collect())) == {a: sum(gaps[i:]) for i, a in enumerate(arcs)}


def test_subtree_sums_of_a_path_and_a_star(spark):
    path = [("0", None)] + [(str(k), str(k - 1)) for k in range(1, 60)]
    star = [("r", None)] + [(f"c{k}", "r") for k in range(60)]
    for tree, deep in ((path, 60), (star, 61)):
        nodes = spark.createDataFrame(tree, "node string, parent string")
        got = trie.subtree_sums(nodes, {"n": F.lit(1)}, short=8, rate=4).collect()
        assert max(r.n for r in got) == deep and len(got) == len(tree)
        if tree is path:
            assert {r.node: r.n for r in got} == {str(k): 60 - k for k in range(60)}


def test_running_sums_cross_stretches(spark):
    rows = [(g, p, g + p) for g in (1, 2) for p in range(50)]
    got = trie.running_sums(spark.createDataFrame(rows, "g long, p long, v long"), ["g"], "p", ["v"], stretch=7)
    assert {(r.g, r.p): r.upto_v for r in got.collect()} == {(g, p): sum(g + q for q in range(p + 1)) for g, p, _ in rows}


def test_a_long_conversation_fills_several_parts(spark):
    rows = spark.range(400).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    got = trie.digested(rows).collect()
    assert sorted(r.pos for r in got) == list(range(1, 401)) and len({r.part for r in got}) > 1
