"""Row numbers and slices when a second read of the documents is split in another way."""

import os
import random

import pyarrow as pa
import pytest

from strata.llm import exact, mixing, substrings
from test_exact import brute as exact_brute
from test_mixing import _size
from test_substrings import brute, corpus

OPEN_COST, SPLITS = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def resplit(spark, monkeypatch):
    """After every stored table, files are read as by a cluster of more cores."""
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, "1")
    spark.conf.set(SPLITS, "1")
    for module in (exact, mixing):
        def saved(df, name, kept=module.save):
            out = kept(df, name)
            spark.conf.set(SPLITS, "20")
            return out

        monkeypatch.setattr(module, "save", saved)
    yield
    spark.conf.set(OPEN_COST, before)
    spark.conf.unset(SPLITS)


def _stored(spark, rows, path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(7, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_exact_dedup(spark, resplit, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"text {draw.randrange(150)} " + "x" * draw.randrange(3), "s") for i in range(400)]
    docs = _stored(spark, rows, str(tmp_path / "docs"))
    got = sorted(r["doc_id"] for r in exact.without_exact_duplicates(docs).collect())
    assert got == sorted({r[1] for r in exact_brute([(d, t) for d, t, _ in rows])})


def test_mix(spark, resplit, tmp_path):
    draw = random.Random(6)
    rows = [(i, " ".join([f"w{i}"] * draw.randrange(1, 30)), f"s{i % 3}") for i in range(300)]
    docs = _stored(spark, rows, str(tmp_path / "docs"))
    sizes = [sum(_size(t) for _, t, s in rows if s == f"s{k}") for k in range(3)]
    got = mixing.mix(docs).collect()
    taken = [sum(_size(r["text"]) for r in got if r["source"] == f"s{k}") for k in range(3)]
    assert all(abs(n - g) <= 15 for n, g in zip(taken, mixing.targets(sizes, [1, 2, 3])))  # half the largest document
    assert all(set(r["text"].split()) == {f"w{r['doc_id']}"} for r in got)


def test_substrings(spark):
    rows = corpus(6, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def other_order(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        order = sorted(range(table.num_rows), key=lambda _: os.urandom(8))
        yield from table.take(order).combine_chunks().to_batches()

    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "10")
    try:
        read = docs.coalesce(1).mapInArrow(other_order, "doc_id long, text string")
        out = substrings.without_repeats(read, subtree=200).collect()
    finally:
        spark.conf.set(BATCH_ROWS, before)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out), key=str) == brute(rows)
