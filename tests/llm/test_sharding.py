"""Uniform shards: the draw against its exact distribution, the matrix's sums, whole results."""

import zlib
from collections import Counter, defaultdict
from math import comb

from pyspark.sql import functions as F

from strata.llm import queries, sharding


def test_hypergeometric_draws(spark):
    for good, bad, sample in ((3, 5, 4), (40, 60, 30), (500, 20, 100)):
        n = 4000
        draws = spark.range(n).select(sharding.hypergeometric(F.lit(good), F.lit(bad), F.lit(sample), F.lit(3), F.col("id")))
        seen = Counter(r[0] for r in draws.collect())
        expected = {x: n * comb(good, x) * comb(bad, sample - x) / comb(good + bad, sample) for x in range(max(0, sample - bad), min(good, sample) + 1)}
        assert set(seen) <= set(expected)
        common = [x for x, e in expected.items() if e > 5]
        chi = sum((seen[x] - expected[x]) ** 2 / expected[x] for x in common)
        assert chi < len(common) + 5 * (2 * len(common)) ** 0.5 + 5


def test_hypergeometric_at_its_limits_and_large(spark):
    one = spark.range(1)
    for g, b, s, x in ((0, 5, 3, 0), (5, 0, 3, 3), (4, 4, 8, 4), (0, 0, 0, 0), (7, 2, 0, 0)):
        args = [F.col("id") + v for v in (g, b, s)]
        assert one.select(sharding.hypergeometric(*args, F.lit(1))).first()[0] == x
    large = [F.lit(v) + 0 * F.col("id") for v in (4 * 10**11, 6 * 10**11, 5 * 10**11)]
    draws = [r[0] for r in spark.range(400).select(sharding.hypergeometric(*large, F.col("id"))).collect()]
    mean, variance = 2 * 10**11, 5e11 * 0.4 * 0.6 * 0.5
    assert abs(sum(draws) / 400 - mean) < 5 * (variance / 400) ** 0.5
    assert 0.7 < sum((x - mean) ** 2 for x in draws) / 400 / variance < 1.4


def test_matrix_sums(spark):
    rows = [(b, 37 + 11 * b) for b in range(70) if b != 5]
    total = sum(n for _, n in rows)
    sizes = [total // 5 + (s < total % 5) for s in range(5)]
    got = sharding.matrix(spark.createDataFrame(rows, "block int, n long"), 70, sizes).collect()
    assert {r.block: sum(r.counts) for r in got if sum(r.counts)} == dict(rows)
    assert [sum(c) for c in zip(*(r.counts for r in got))] == sizes
    assert all(c >= 0 for r in got for c in r.counts)


def _shards(df, shards):
    out = defaultdict(list)
    for r in df.collect():
        out[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in out.values())
    sizes = [len(out.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return out


def test_whole_rows_and_clashing_names(spark):
    rows = [(k, "x" * (k % 7), k % 3, {"a": k}) for k in range(3000)] + [(None, None, None, None)] * 4000 + [(5, "x" * 400_000, 1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, shard int, `take.row` map<string,int>")
    got = sharding.shuffle_rows(table, 7).cache()
    _shards(got, 7)
    back = [(r.row.doc_id, len(r.row.text or ""), r.row.shard, r.row["take.row"]) for r in got.collect()]
    assert Counter(map(str, back)) == Counter(str((i, len(t or ""), s, m)) for i, t, s, m in rows)
    shard_of_nulls = Counter(r.shard for r in got.where("row.doc_id IS NULL").collect())
    assert all(450 < n < 690 for n in shard_of_nulls.values()) and len(shard_of_nulls) == 7


def test_same_result_for_other_splits(spark):
    rows = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    one = {r.row.id: (r.shard, r.slot) for r in sharding.shuffle_rows(rows.coalesce(1), 5).collect()}
    other = {r.row.id: (r.shard, r.slot) for r in sharding.shuffle_rows(rows.repartition(9), 5).collect()}
    assert one == other
    # Uniform: neither shard nor slot follows the id.
    pairs = sorted(one.items())
    same = sum(a[1][0] == b[1][0] for a, b in zip(pairs, pairs[1:])) / len(pairs)
    rising = sum(a[1][1] < b[1][1] for a, b in zip(pairs, pairs[1:])) / len(pairs)
    assert 0.16 < same < 0.24 and 0.45 < rising < 0.55


def test_few_rows_and_none(spark):
    assert sharding.shuffle_rows(spark.range(0), 4).collect() == []
    assert {r.row.id for r in sharding.shuffle_rows(spark.range(3), 24).collect()} == {0, 1, 2}
    assert sorted(r.slot for r in sharding.shuffle_rows(spark.range(5), 1).collect()) == [0, 1, 2, 3, 4]


def test_query(spark, tmp_path):
    rows = [(k, "é" * (k % 5) if k % 4 else None) for k in range(100)] + [(7, "é" * 2), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_uniform_shards(spark, str(tmp_path))
    _shards(got, 24)
    told = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got.collect())
    assert told == Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
