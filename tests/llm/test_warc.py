"""WARC: exact round trips, push-down on headers, foreign archives, repeated pages."""

import gzip
import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from strata.llm import warc


def _records():
    return [
        {"record_type": "response", "record_id": "<a>", "target_uri": "http://x/%41\r\ny: z", "payload": b"WARC/1.1\r\n\r\n" * 3},
        {"record_type": "revisit", "record_id": "<b>", "refers_to": "<a>", "payload_bytes": 39, "payload": b""},
        {"record_type": "response", "record_id": "<c>", "target_uri": "é", "payload": bytes(range(256)) * 5000},
        {"record_type": "metadata", "record_id": "<d>", "payload": None},
    ]


def _plain(record):
    return gzip.decompress(warc.encode(record))


@pytest.mark.parametrize("form", ["named", "unnamed", "plain"])
@pytest.mark.parametrize("payload", [True, False])
def test_records(form, payload):
    shape = {"named": warc.encode, "unnamed": lambda r: gzip.compress(_plain(r)), "plain": _plain}[form]
    data = b"".join(map(shape, _records()))
    got = list(warc.read_records(io.BytesIO(data), warc._Wanted([], payload)))
    for want, row in zip(_records(), got, strict=True):
        for name in ("record_type", "record_id", "target_uri", "refers_to"):
            assert row[name] == want.get(name)
        assert row["payload_bytes"] == want.get("payload_bytes", len(want["payload"] or b""))
        assert row.get("payload") == ((want["payload"] or b"") if payload else None)


def test_unwanted_payloads_are_not_decoded():
    data = b"".join(map(warc.encode, _records()))
    filters = [warc.EqualTo(("record_type",), "revisit")]
    before = warc.Decoded.payload_bytes
    got = list(warc.read_records(io.BytesIO(data), warc._Wanted(filters, True)))
    assert [r["record_id"] for r in got] == ["<b>"] and warc.Decoded.payload_bytes == before


def test_source(spark, tmp_path):
    rows = [(i, f"http://h/{i % 3}\n", f"<p>{i}</p>" * (1 + 40 * (i % 7))) for i in range(60)]
    records = warc.page_records(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string"))
    path = str(tmp_path / "archive")
    records = records.cache()
    warc.write_archive(records.repartition(4), path)
    (tmp_path / "archive" / "part-left-over.warc.gz").write_bytes(b"of a lost attempt")
    back = warc.read_archive(spark, path)
    columns = ["record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "payload"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, records.select(*columns).collect()))
    some = back.where((F.col("record_type") == "response") & F.col("record_id").isin("<urn:page:3>", "<urn:page:4>") & F.col("date").isNull())
    assert some.count() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan), plan
    assert warc.read_archive(spark, path, payload=False).where("payload IS NOT NULL").count() == 0


def test_pages_of_any_kind(spark, tmp_path):
    big, small = "x" * 100, "y" * 99
    rows = [(3, "u", big), (2, "v", big), (2, "v", big), (None, None, big), (5, "u", small), (4, "u", small), (6, None, None),
            (7, "", ""), (8, "a\r\nb%0A", "é" * 50), (9, "b", "é" * 50), (None, "z", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "pages")
    warc.write_archive(warc.page_records(pages), path)
    got = sorted((r["record_id"][10:-1], r["record_type"], r["refers_to"], r["target_uri"], r["payload_bytes"], r["payload_digest"])
                 for r in warc.read_archive(spark, path).collect())
    sha = lambda t: "sha256:" + hashlib.sha256((t or "").encode()).hexdigest()
    kinds = {0: ("revisit", "<urn:page:2>"), 3: ("revisit", "<urn:page:2>"), 9: ("revisit", "<urn:page:8>")}
    want = [(str(p) if p is not None else "none", *kinds.get(i, ("response", None)), u, len((h or "").encode()), sha(h)) for i, (p, u, h) in enumerate(rows)]
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    none = str(tmp_path / "none")
    warc.write_archive(warc.page_records(pages.limit(0)), none)
    assert warc.read_archive(spark, none).count() == 0


def test_a_second_append_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "twice")
    for first, last in ((0, 10), (10, 15)):
        pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(first, last)], "page_id long, url string, html string")
        warc.write_archive(warc.page_records(pages), path)
    assert {r["payload"].decode() for r in warc.read_archive(spark, path).collect()} == {f"page {k}" for k in range(15)}
