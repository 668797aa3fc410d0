"""Hashes of words and other byte spans, computed for whole blocks of text at once.

A span's hash is multilinear: the sum over its bytes of a random number for the byte times a
random odd number for its place in the span, modulo 2^64, read off prefix sums and then mixed.
So a block costs a few numpy passes however many spans it has. Equal spans have equal hashes;
two different ones share a hash with a chance of about 2^-64, whatever their pattern (a
polynomial in one base would take some patterned texts of 1024 bytes for each other). The
random numbers are fixed, so texts made against them could still collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_places = np.ones(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places_upto(n: int) -> np.ndarray:
    """The random odd number of every place, the same ones however far they are asked for."""
    global _places
    if len(_places) < n:
        blocks = -(-n // BLOCK)
        drawn = [np.random.default_rng([20240602, k]).integers(0, 1 << 64, BLOCK, dtype=np.uint64) for k in range(blocks)]
        _places = np.concatenate(drawn) | np.uint64(1)
    return _places


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of every data[start:end]; spans rise and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Every byte's place in its span; between spans, that after the last one's start (never read).
    n = len(data)
    begun = np.zeros(n, np.int32)
    begun[starts] = starts
    place = np.arange(n, dtype=np.int32) - np.maximum.accumulate(begun)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _places_upto(int(place.max()) + 1)[place], out=sums[1:])
    sizes = ends - starts
    raw = sums[ends] - sums[starts]
    return mix(raw ^ sizes.astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, tab, line feed, VT, FF and CR."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = _SPACE[data]
    edges = np.flatnonzero(np.diff(gap))
    return edges[0::2], edges[1::2]


def lower_ascii(data: bytes) -> bytes:
    """A to Z in lower case, every other byte unchanged."""
    return data.lower()


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a block each; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def _long_words(text: bytes) -> Iterator[np.ndarray]:
    """Word hashes of one long text, part by part; parts end at spaces."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end, width = min(at + BLOCK, len(data)), BLOCK
        while end < len(data) and not (gaps := _SPACE[data[at:end]]).any():
            width *= 2
            end = min(at + width, len(data))
        if end < len(data):
            end = at + int(np.flatnonzero(gaps)[-1]) + 1
        part = data[at:end]
        yield span_hashes(part, *word_spans(part))
        at = end


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For every text, the hashes of its words in order."""
    for first, last in blocks(texts):
        if last == first + 1 and len(texts[first]) > BLOCK:
            yield np.concatenate([np.zeros(0, np.uint64), *_long_words(texts[first])])
            continue
        joined = np.frombuffer(b" ".join(texts[first:last]), np.uint8)
        starts, ends = word_spans(joined)
        hashes = span_hashes(joined, starts, ends)
        sizes = np.fromiter((len(t) + 1 for t in texts[first:last]), np.int64, last - first)
        cuts = np.searchsorted(starts, np.cumsum(sizes))
        at = 0
        for cut in cuts:
            yield hashes[at:cut]
            at = cut


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` consecutive words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = words[:n].copy(), np.uint64(_BASE)
    for k in range(1, width):
        total += words[k : k + n] * factor
        factor = np.uint64(int(factor) * _BASE & (1 << 64) - 1)
    return mix(total)
