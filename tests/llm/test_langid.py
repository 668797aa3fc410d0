"""Language identification: gradients by differences, windows, held-out accuracy."""

import numpy as np
import pytest

from strata.llm import langid
from strata.llm.tables import read


def test_windows_hold_every_filter_place():
    for n in (0, 1, 127, 128, 129, 252, 253, 1000):
        text = bytes(1 + i % 250 for i in range(n))
        rows = langid.windows(text)
        assert rows.shape[1] == langid.WINDOW
        grams = {bytes(r[i : i + 5]) for r in rows for i in range(langid.WINDOW - 4)}
        assert {text[i : i + 5] for i in range(n - 4)} <= grams
        assert len(rows) <= max(1, -(-n // 100))


def test_gradients():
    draw = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], draw)
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.dense = net.dense.astype(np.float64)
    rows, labels = draw.integers(97, 101, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = net.probabilities(net.pooled(rows)[0])
        return -np.log(p[np.arange(6), labels]).mean()

    for weights, grad in zip([*net.filters, net.dense], net.gradients(rows, labels)):
        flat = np.flatnonzero(np.abs(grad).ravel() > 1e-4)[:5]
        for at in flat:
            step, old = 1e-6, weights.ravel()[at]
            weights.ravel()[at] = old + step
            up = loss()
            weights.ravel()[at] = old - step
            down = loss()
            weights.ravel()[at] = old
            assert grad.ravel()[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    rows = [r for r in got.collect() if r["lang_pred"] != "und"]
    assert len(rows) > 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame(
        [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
        + [(None, "the dog", "en", "x"), (100, None, "en", "x"), (101, "12 !? \n", "en", "x"), (102, "", None, "x"),
           (103, "the dog " * 9000, None, "x"), (104, "é", None, "x"), (104, "é", "de", "x")],
        "doc_id long, text string, lang string, score string",
    )
    got = langid.predictions(docs)
    rows = [tuple(r) for r in got.collect()]
    by = {r[0]: r for r in rows}
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == 47
    assert all(by[d][2:] == ("und", 0.0) for d in (100, 101, 102))
    assert by[103][2] == "en" and by[0][2] == "en" and by[1][2] == "de" and by[None][1] is False
    assert len({r for r in rows if r[0] == 104}) == 1
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (100, 101, 102)").count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in langid.predictions(unlabelled).collect()} == {"und"}
    assert langid.predictions(docs.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    rows = [(k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de", k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} <= set(range(20)) and kept.count() > 0
