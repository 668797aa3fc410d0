"""Substring dedup over prefix-partitioned suffix trees.

The suffixes of all documents' word sequences form one tree; a passage that occurs twice
is an inner node of it. Only the depth that counts is built: a suffix is followed down to
``width`` words (13), and its place there is the hash of these words.

1. A census counts the suffixes under prefixes of 1, 2, 4 and all ``width`` words, in more
   buckets the more text there is.
2. Every suffix belongs to the subtree of its shortest prefix under which few enough lie to
   be held in memory; where even the whole window is too coarse, more bits of its hash split
   on. So frequent words get long prefixes and rare ones short.
3. A task sorts a subtree's suffixes. Equal ones are one node; if it has leaves in several
   documents, the window is a repeat, and all leaves but those of the least ``doc_id`` are
   covered. A slice of the input sends each node's least document only, and reports its
   other leaves by itself, so a passage that a third of all documents share stays small.
4. Covered windows travel back packed, to the place where the documents come; there the
   words that any covered window holds are removed. Neighbouring windows add up to the
   maximal repeat.

Windows are told apart by 56 bits of hash within their subtree (a false match of a window
has a chance of about 10^-11). ``docs`` is read several times, in any slices: what a slice
sends and what it reports by itself come from one pass over it.

Defined results: null text has no words; documents of equal ``doc_id`` do not cover each
other; a row without ``doc_id`` counts as the last of all; an empty table gives an empty
result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.hashing import mix, window_hashes, word_hashes, word_spans
from strata.llm.tables import map_batches, slices, texts_of

WIDTH = 13
SUBTREE = 1 << 21
PREFIXES = (1, 2, 4)
_LEAST_BITS = 10
_MOST_BITS = 16
_COUNTED = 1 << 17
_LAST = np.iinfo(np.int64).max
_HELD = 1 << 21
_PART_BYTES = 64 << 20


def pack(paths: np.ndarray, docs: np.ndarray, ordered: bool) -> bytes:
    """56-bit paths (as differences if ``ordered``) and their documents, compressed by byte planes."""
    known, index = np.unique(docs, return_inverse=True)
    values = np.diff(paths, prepend=np.uint64(0)) if ordered else paths
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T
    width = 2 if len(known) <= 1 << 16 else 4
    marks = index.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    head = np.array([len(paths), len(known), width], "<i8").tobytes() + known.astype("<i8").tobytes()
    return zstandard.compress(head + planes.tobytes() + marks.tobytes(), 1)


def unpack(blob: bytes, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, m, width = np.frombuffer(raw, "<i8", 3).tolist()
    known = np.frombuffer(raw, "<i8", m, 24)
    at = 24 + 8 * m
    values = np.zeros((n, 8), np.uint8)
    values[:, :7] = np.frombuffer(raw, np.uint8, 7 * n, at).reshape(7, n).T
    marks = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at + 7 * n).reshape(width, n).T)
    paths = values.view("<u8").ravel()
    return np.cumsum(paths, dtype=np.uint64) if ordered else paths, known[marks.view(f"<u{width}").ravel()]


def paths_of(words: np.ndarray, width: int) -> np.ndarray:
    """The 56-bit place of every suffix at the depth of ``width`` words."""
    return window_hashes(words, width) >> np.uint64(8)


def _bits(size: int, limit: int) -> int:
    """Bits of a prefix bucket's number: some eight buckets for every subtree that ``size``
    bytes of text can fill, in which a window has two bytes at least."""
    return min(max(math.ceil(math.log2(max(4 * size / limit, 1))), _LEAST_BITS), _MOST_BITS)


def _buckets(words: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Of every suffix, the bucket of its prefix of every length, shortest first, the window last."""
    n = max(0, len(words) - width + 1)
    lengths = [k for k in PREFIXES if k < width]
    found = [window_hashes(words, k)[:n] for k in lengths] + [mix(window_hashes(words, width))]
    return np.array(found, np.uint64).reshape(len(found), n) >> np.uint64(64 - bits)


def census(docs: DataFrame, width: int, limit: int) -> tuple[np.ndarray, int]:
    """(suffixes under every prefix bucket, by prefix length; bytes of text).

    The number of buckets grows with the text. Counts up to ``limit`` are all the same to
    :func:`_subtree_of`, so only those beyond it come to the driver, which the number of
    subtrees bounds.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    bits = _bits(size, limit)

    def count(batch: pa.RecordBatch) -> dict:
        total = np.zeros((len(PREFIXES) + 1, 1 << bits), np.int64)
        waiting, n = [], 0

        def add() -> None:
            for level, buckets in enumerate(np.concatenate(waiting, axis=1).astype(np.int64)):
                total[level] += np.bincount(buckets, minlength=1 << bits)

        for words in word_hashes(texts_of(batch)):
            waiting.append(_buckets(words, width, bits))
            n += len(words)
            if n > _COUNTED:
                add()
                waiting, n = [], 0
        if waiting:
            add()
        level, bucket = np.nonzero(total)
        return {"level": level, "bucket": bucket, "n": total[level, bucket]}

    rows = map_batches(docs.select("text"), "text", "level long, bucket long, n long", count)
    over = rows.groupBy("level", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    counts = np.zeros((len(PREFIXES) + 1, 1 << bits), np.int64)
    for level, bucket, n in over.collect():
        counts[level, bucket] = n
    return counts, size


def _subtree_of(buckets: np.ndarray, paths: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The number of every suffix's subtree."""
    last = len(buckets) - 1
    parts = np.maximum(-(-counts[last][buckets[last]] // limit), 1)
    more = (mix(paths) % parts.astype(np.uint64)).astype(np.int64)
    found = (last << 56) + (buckets[last].astype(np.int64) << 40) + more
    for level in range(last - 1, -1, -1):
        own = buckets[level].astype(np.int64)
        found = np.where(counts[level][own] <= limit, (level << 56) + (own << 40), found)
    return found


def _doc_numbers(batch: pa.RecordBatch) -> list[int]:
    return [_LAST if d is None else d for d in batch.column("doc_id").to_pylist()]


def _nodes(texts: list[bytes], ids: list[int], width: int) -> tuple:
    """A slice's suffixes by path: (paths, documents, first of each node, words of each text, order)."""
    words = list(word_hashes(texts))
    found = [paths_of(w, width) for w in words]
    paths = np.concatenate([np.zeros(0, np.uint64), *found])
    docs = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
    order = np.argsort(paths)
    paths, docs = paths[order], docs[order]
    first = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])) if len(paths) else np.zeros(0, np.int64)
    return paths, docs, first, words, order


def _by_part(docs: np.ndarray, paths: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, blob) of covered windows."""
    part = (mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((docs, part))
    docs, paths, part = docs[order], paths[order], part[order]
    values = np.unique(part)
    cuts = np.append(np.searchsorted(part, values), len(part))
    blobs = [pack(paths[a:b], docs[a:b], False) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _leaves(docs: DataFrame, counts: np.ndarray, width: int, limit: int, parts: int) -> DataFrame:
    """(subtree, part, blob): of every slice and node, the least document; with ``part``, the
    windows whose node has a lesser document in the same slice."""
    bits = counts.shape[1].bit_length() - 1

    def send(batch: pa.RecordBatch) -> dict | None:
        paths, ids, first, words, order = _nodes(texts_of(batch), _doc_numbers(batch), width)
        if not len(first):
            return None
        least = np.minimum.reduceat(ids, first)
        over = ids > np.repeat(least, np.diff(np.append(first, len(paths))))
        own = _by_part(ids[over], paths[over], parts) if over.any() else None
        buckets = np.concatenate([_buckets(w, width, bits) for w in words], axis=1)[:, order[first]]
        paths = paths[first]
        subtrees, rank = np.unique(_subtree_of(buckets, paths, counts, limit), return_inverse=True)
        by = np.argsort(rank.astype(np.uint16 if len(subtrees) <= 1 << 16 else np.int64), kind="stable")
        cuts = np.searchsorted(rank[by], np.arange(len(subtrees) + 1))
        blobs = [pack(paths[by[a:b]], least[by[a:b]], True) for a, b in zip(cuts, cuts[1:])]
        part = [None] * len(blobs)
        if own is not None:
            # Numbers below zero are no subtrees; they only spread these rows.
            told = own.column("blob").to_pylist()
            subtrees = np.append(subtrees, [-1 - zlib.crc32(b) for b in told])
            part, blobs = part + own.column("part").to_pylist(), blobs + told
        return {"subtree": pa.array(subtrees, pa.int64()), "part": pa.array(part, pa.int64()), "blob": pa.array(blobs, pa.binary())}

    return map_batches(docs, "text", "subtree long, part long, blob binary", send)


def _covered(leaves: DataFrame, parts: int) -> DataFrame:
    """(part, blob): windows whose node has a lesser document, in the same slice or another."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        docs, paths, held = [], [], 0

        def subtree() -> int:
            got = [unpack(b, True) for b in blobs]
            path, doc = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            order = np.argsort(path)
            path, doc = path[order], doc[order]
            first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            over = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(path))))
            docs.append(doc[over])
            paths.append(path[over])
            return int(over.sum())

        for batch in batches:
            told = batch.filter(pc.is_valid(batch.column("part")))
            if told.num_rows:
                yield told.select(["part", "blob"])
            batch = batch.filter(pc.is_null(batch.column("part")))
            for number, blob in zip(batch.column("subtree").to_pylist(), batch.column("blob").to_pylist()):
                if number != current and blobs:
                    held += subtree()
                    blobs = []
                    if held > _HELD:
                        yield _by_part(np.concatenate(docs), np.concatenate(paths), parts)
                        docs, paths, held = [], [], 0
                current = number
                blobs.append(blob)
        if blobs:
            held += subtree()
        if held:
            yield _by_part(np.concatenate(docs), np.concatenate(paths), parts)

    return leaves.repartition("subtree").sortWithinPartitions("subtree").mapInArrow(find, "part long, blob binary")


def removed_words(words: np.ndarray, covered: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a covered window; ``covered`` holds the windows' sorted paths."""
    gone = np.zeros(len(words) + 1, np.int64)
    if len(covered) and len(words) >= width:
        start = np.flatnonzero(np.isin(paths_of(words, width), covered))
        np.add.at(gone, start, 1)
        np.add.at(gone, np.minimum(start + width, len(words)), -1)
    return np.cumsum(gone)[:-1] > 0


def without_repeats(docs: DataFrame, width: int = WIDTH, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): one row per row of ``docs``.

    ``spans`` are the maximal repeats removed, as [first word, last word + 1) pairs;
    ``kept`` is what is left, joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, size = census(rows, width, subtree)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / _PART_BYTES))
    covered = _covered(_leaves(rows, counts, width, subtree, parts), parts)

    def part_of(batch: pa.RecordBatch) -> dict:
        numbers = np.array(_doc_numbers(batch), np.int64)
        return {
            "part": (mix(numbers.view(np.uint64)) % np.uint64(parts)).astype(np.int64),
            "doc_id": batch.column("doc_id"),
            "text": batch.column("text"),
        }

    placed = map_batches(rows, "text", "part long, doc_id long, text string", part_of)
    meeting = (
        covered.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
        .unionByName(placed.select("part", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob")))
        .repartition(parts, "part")
        .sortWithinPartitions("part", "kind")
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, index = None, [], None
        out = ["doc_id", "n_words", "n_removed", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

        def covered_by() -> dict[int, np.ndarray]:
            if not blobs:
                return {}
            got = [unpack(b, False) for b in blobs]
            paths, ids = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            order = np.lexsort((paths, ids))
            paths, ids = paths[order], ids[order]
            known, first = np.unique(ids, return_index=True)
            return dict(zip(known.tolist(), np.split(paths, first[1:])))

        for batch in slices(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("part", "kind", "doc_id", "blob")]
            rows, texts = [], texts_of(batch)
            for part, kind, doc, blob, text in zip(*columns, texts):
                if part != current:
                    current, blobs, index = part, [], None
                if kind == 0:
                    blobs.append(blob)
                    continue
                if index is None:
                    index, blobs = covered_by(), []
                words = next(iter(word_hashes([text])))
                mine = index.get(_LAST if doc is None else doc, np.zeros(0, np.uint64))
                gone = removed_words(words, mine, width)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                if gone.any():
                    starts, ends = word_spans(np.frombuffer(text, np.uint8))
                    kept = b" ".join(text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist()))
                else:
                    kept = b" ".join(text.split())
                rows.append((doc, len(words), int(gone.sum()), edges, kept.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], out)

    schema = "doc_id long, n_words long, n_removed long, spans array<long>, kept string"
    return meeting.mapInArrow(strip, schema)

