"""Language identification by a byte convolutional network.

Filters of 2 to 5 bytes slide over a window of 128 bytes; each filter's maximum over the
window, through a rectifier, feeds a softmax over the languages. The filters read bytes as
such, so a filter of k bytes is k tables of 256 rows, and its value is a sum of looked-up
rows. Training is plain numpy (Adam) on the driver; a text is classified in its task, all
its windows in batches, and its score is the windows' mean, weighted by their letters.

The network learns from a bounded sample: ``per_language`` documents of every language (the
least by hash of ``doc_id``), ``_CROPS`` windows of each. That bound, and at most
``MAX_LANGUAGES`` languages, keep what reaches the driver below a fixed size.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and if there
is nothing to learn from; the label, source and id of a row never change its prediction;
repeated rows get the same answer; a row without ``doc_id`` is not learnt from and not held
out; an empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strata.llm.tables import map_batches, quoted, slices, texts_of

WIDTHS, FILTERS, WINDOW = (2, 3, 4, 5), 16, 128
PER_LANGUAGE, MAX_LANGUAGES, STEPS = 500, 1000, 800
UNKNOWN, MIN_SCORE = "und", 0.3
_CROPS, _BATCH, _RATE = 4, 64, 0.004
_STRIDE = WINDOW - max(WIDTHS) + 1
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def windows(text: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW bytes that overlap by the widest filter less one."""
    n = max(1, -(-(len(text) - (WINDOW - _STRIDE)) // _STRIDE))
    padded = np.zeros((n - 1) * _STRIDE + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STRIDE]


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # one per width: (width, 256, FILTERS)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS + 1, languages), the last row the bias

    @classmethod
    def new(cls, languages: list[str], draw: np.random.Generator) -> Network:
        filters = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        dense = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))).astype(np.float32)
        return cls(languages, filters, dense)

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Every filter's maximum over each window, and on demand where it was."""
        best, places = [], []
        for width, tables in zip(WIDTHS, self.filters):
            n = WINDOW - width + 1
            total = tables[0][rows[:, :n]]
            for k in range(1, width):
                total += tables[k][rows[:, k : k + n]]
            best.append(total.max(axis=1))
            if where:
                places.append(total.argmax(axis=1))
        return np.concatenate(best, axis=1), places

    def _pairs(self) -> list[list[np.ndarray]]:
        """Per width, the tables of neighbouring bytes two by two: (65536, FILTERS) each."""
        return [
            [(t[k][:, None] + t[k + 1][None, :]).reshape(1 << 16, FILTERS) for k in range(0, width - 1, 2)]
            for width, t in zip(WIDTHS, self.filters)
        ]

    def pooled_by_pairs(self, rows: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """What :meth:`pooled` gives, with about half the look-ups."""
        two = rows[:, :-1].astype(np.uint16) << 8 | rows[:, 1:]
        best = []
        for width, tables, own in zip(WIDTHS, self.filters, pairs):
            n = WINDOW - width + 1
            total = own[0].take(two[:, :n], axis=0, mode="clip")
            for k, table in enumerate(own[1:], 1):
                total += table.take(two[:, 2 * k : 2 * k + n], axis=0, mode="clip")
            if width % 2:
                total += tables[-1].take(rows[:, width - 1 : width - 1 + n], axis=0, mode="clip")
            best.append(total.max(axis=1))
        return np.concatenate(best, axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled, 0) @ self.dense[:-1] + self.dense[-1]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, by every filter table and the dense layer."""
        pooled, places = self.pooled(rows, where=True)
        error = self.probabilities(pooled)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.dense[:-1].T) * (pooled > 0)
        out = []
        for k, (width, tables, place) in enumerate(zip(WIDTHS, self.filters, places)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad, which = np.zeros_like(tables), np.arange(FILTERS)[None, :]
            for at in range(width):
                byte = np.take_along_axis(rows, place + at, axis=1)
                np.add.at(grad[at], (byte, which), part)
            out.append(grad)
        dense = np.concatenate((np.maximum(pooled, 0).T @ error, error.sum(axis=0, keepdims=True)))
        return [*out, dense]

    def train(self, rows: np.ndarray, labels: np.ndarray, steps: int, draw: np.random.Generator) -> None:
        weights = [*self.filters, self.dense]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = draw.permutation(len(labels))
            pick, order = order[:_BATCH], order[_BATCH:]
            for w, g, m, v in zip(weights, self.gradients(rows[pick], labels[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def classify(self, texts: list[bytes]) -> Iterator[tuple[str, float]]:
        """(language, score) of every whole text."""
        pairs = self._pairs()
        totals, sums = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            rows = np.concatenate([r for _, r in held])
            owner = np.repeat([i for i, _ in held], [len(r) for _, r in held])
            weight = _LETTERS[rows].sum(axis=1) - (rows == 0).sum(axis=1) * _LETTERS[0] + 1e-3
            np.add.at(totals, owner, self.probabilities(self.pooled_by_pairs(rows, pairs)) * weight[:, None])
            np.add.at(sums, owner, weight)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            rows = windows(text.lower())
            for at in range(0, len(rows), _BATCH):
                part = rows[at : at + _BATCH]
                held.append((i, part))
                size += len(part)
                if size >= _BATCH:
                    flush()
                    size = 0
        if held:
            flush()
        for total, weight in zip(totals, sums):
            best = int(total.argmax())
            yield self.languages[best], float(min(1.0, total[best] / weight))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, labels, languages) of the bounded training sample."""
    rows = docs.select("doc_id", "text", "lang").where(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    ).where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    # A hash below the share of each language, and a few standard deviations more, leaves
    # little above the sample's size; the least hashes of these are the sample.
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    share = {x: min(1.0, (per_language + 6 * per_language**0.5 + 20) / n) for x, n in counts.items()}
    below = F.create_map(*(F.lit(y) for x in languages for y in (x, int(share[x] * (1 << 40)))))
    near = rows.withColumn("drawn", drawn).where(F.col("drawn") < below[F.col("lang")])

    def crop(batch: pa.RecordBatch) -> dict:
        out: list[np.ndarray] = []
        for text, seed in zip(texts_of(batch), batch.column("drawn").to_pylist()):
            draw, low = np.random.default_rng(seed), text.lower()
            found = np.zeros((_CROPS, WINDOW), np.uint8)
            for k in range(_CROPS):
                size = WINDOW if k else int(draw.integers(8, 64))
                at = int(draw.integers(0, max(1, len(low) - size + 1)))
                part = low[at : at + size]
                found[k, : len(part)] = np.frombuffer(part, np.uint8)
            out.append(found.tobytes())
        return {"lang": batch.column("lang"), "drawn": batch.column("drawn"), "crops": pa.array(out, pa.binary())}

    crops = map_batches(near.select("text", "lang", "drawn"), "text", "lang string, drawn long, crops binary", crop)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "crops"))
    kept = crops.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank").collect()
    kept.sort(key=lambda r: (r["lang"], r["drawn"], r["crops"]))
    number = {x: i for i, x in enumerate(languages)}
    data = np.frombuffer(b"".join(bytes(r["crops"]) for r in kept), np.uint8).reshape(-1, WINDOW)
    return data, np.repeat([number[r["lang"]] for r in kept], _CROPS), languages


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = STEPS, seed: int = 3) -> Network | None:
    """A network trained on ``text`` and ``lang``; None if no language is known."""
    rows, labels, languages = sample(docs, per_language)
    if not languages:
        return None
    draw = np.random.default_rng(seed)
    network = Network.new(languages, draw)
    network.train(rows, labels, steps, draw)
    return network


def identify(docs: DataFrame, network: Network | None, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, in columns of the given names."""
    schema = StructType([*docs.schema.fields, StructField(language, StringType()), StructField(score, DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known = [
                i
                for i, text in enumerate(batch.column("text").to_pylist())
                if network is not None and text is not None and any(map(str.isalpha, text))
            ]
            found, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            texts = texts_of(batch)
            for i, (name, value) in zip(known, network.classify([texts[i] for i in known]) if known else ()):
                found[i], scores[i] = name, value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names
            )

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    rows = docs.select("doc_id", "text")
    return identify(rows, fit(docs, **how)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, min_score: float = MIN_SCORE, **how: int) -> DataFrame:
    """The rows whose language is known with at least ``min_score``, with all their columns."""
    # Other columns pass through Python in a struct, whatever their names.
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*(F.col(quoted(c)) for c in others)).alias("__strata_doc") if others else F.lit(0).alias("__strata_doc"))
    found = identify(packed, fit(docs, **how), "__strata_lang", "__strata_score")
    kept = found.where((F.col("__strata_lang") != UNKNOWN) & (F.col("__strata_score") >= min_score))
    return kept.select(*("text" if c == "text" else F.col(f"__strata_doc.{quoted(c)}") for c in docs.columns))
