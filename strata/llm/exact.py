"""Exact dedup by content-defined chunk recipes.

A text, white space deleted, is cut where its own bytes say so, so equal texts are cut
alike. Every distinct chunk is moved once, to the place where all chunks of one identifier
meet and are compared byte by byte; from then on a document is its recipe, the ordered
list of its chunks' identifiers, and only recipes are grouped and joined.

Defined results: null text counts as empty; all empty texts are equal; of repeated rows
one stays; a row without ``doc_id`` comes last among equals; an empty table gives none.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import every, map_batches, row_number, texts_of
from strata.session import save

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHUNK, MAX_CHUNK = 512, 8192
_CUT_BITS = 11
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chunks(data: bytes) -> list[bytes]:
    """Cut before the places whose last 8 bytes hash to zero, 512 to 8192 bytes apart."""
    if len(data) <= MIN_CHUNK:
        return [data] if data else []
    last8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    places = np.flatnonzero((last8 * _FACTOR) >> np.uint64(64 - _CUT_BITS) == 0) + 8
    cuts, at = [0], 0
    for place in places.tolist():
        while place - at > MAX_CHUNK:
            at += MAX_CHUNK
            cuts.append(at)
        if place - at >= MIN_CHUNK:
            at = place
            cuts.append(at)
    while len(data) - at > MAX_CHUNK:
        at += MAX_CHUNK
        cuts.append(at)
    if at < len(data):
        cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def identifier(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _colliding(docs: DataFrame, size: int) -> bool:
    """Whether two different chunks of the corpus share an identifier of ``size`` bytes."""

    def distinct(batch: pa.RecordBatch) -> dict | None:
        met: dict[tuple[bytes, bytes], None] = {}
        for text in texts_of(batch):
            for chunk in chunks(text.translate(None, SPACE)):
                met[(identifier(chunk, size), chunk)] = None
        if not met:
            return None
        keys, found = zip(*met)
        return {"key": pa.array(keys, pa.binary()), "chunk": pa.array(found, pa.binary())}

    places = map_batches(docs.select("text"), "text", "key binary, chunk binary", distinct).repartition("key")
    unequal = places.groupBy("key").agg((F.min("chunk") != F.max("chunk")).alias("unequal"))
    return bool(unequal.agg(F.max("unequal")).first()[0])


def verified_size(docs: DataFrame, size: int = 16) -> int:
    """Bytes of an identifier that no two different chunks of the corpus share."""
    while _colliding(docs, size):
        if size >= 64:
            raise ValueError("two different chunks share a 64-byte digest")
        size = min(64, 2 * size)
    return size


def recipes(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, recipe, n_chars, text_sha256), one row per row of ``rows`` (doc_id, text, row)."""

    def cook(batch: pa.RecordBatch) -> dict:
        bare = [t.translate(None, SPACE) for t in texts_of(batch)]
        return {
            "doc_id": batch.column("doc_id"),
            "row": batch.column("row"),
            "recipe": pa.array([b"".join(identifier(c, size) for c in chunks(b)) for b in bare], pa.binary()),
            "n_chars": pc.fill_null(pc.utf8_length(batch.column("text")).cast(pa.int64()), 0),
            "text_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in bare], pa.string()),
        }

    schema = "doc_id long, row long, recipe binary, n_chars long, text_sha256 string"
    return map_batches(rows, "text", schema, cook)


def _marked(rows: DataFrame) -> DataFrame:
    """:func:`exact_duplicates` of rows (doc_id, text, row); ``row`` tells them apart."""
    cooked = save(recipes(rows, verified_size(rows)), "recipes")
    best = F.struct("n_chars", F.bitwise_not("doc_id").alias("back"), F.bitwise_not("row").alias("row"))
    groups = cooked.groupBy("recipe").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return cooked.join(groups, "recipe").select(
        "doc_id",
        F.bitwise_not("best.back").alias("keep_id"),
        "group_size",
        (F.col("row") == F.bitwise_not("best.row")).alias("kept"),
        "text_sha256",
        "row",
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row), one row per row of ``docs``.

    Of equal texts the row with the most code points, then least ``doc_id``, stays. ``row``
    tells the rows of this result apart and means nothing in another read of ``docs``.
    """
    return _marked(row_number(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row"))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows are numbered once and stored: a second read may be split in another way.
    """
    numbered = save(row_number(docs, "__strata_row"), "numbered")
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__strata_row").alias("row"))
    gone = _marked(rows).where(~F.col("kept")).select(F.col("row").alias("__strata_row"))
    return numbered.join(gone.hint("merge"), "__strata_row", "left_anti").select(*every(docs))
