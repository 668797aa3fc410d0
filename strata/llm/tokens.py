"""Token counts and ids of whole texts, exactly as the tokenizers library gives them.

Huge texts are encoded in overlapping chunks with offsets and spliced where both chunks
prove the same: see :func:`encode_long`. Within a chunk the library is asked about each
distinct pre-token once per worker. A byte-level BPE merges within pre-tokens only, so a
text's ids are its pre-tokens' ids in a row; the split into pre-tokens is computed here for
whole blocks of text, for the characters listed at :data:`_PLAIN`, and by the library for
texts that hold any other character or a special token's string.

Defined results: null text counts as empty; repeated rows are counted each; an empty table
gives an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm.hashing import BLOCK, span_hashes
from strata.llm.tables import map_batches, texts_of

VOCABULARY = "byte_bpe_50k.json"
CHUNK_BYTES, OVERLAP_BYTES = 1 << 14, 1 << 9
MEMO_SPANS = 1 << 20
_LETTER, _NUMBER, _OTHER, _BLANK, _EDGE = range(5)
# ASCII without the separators 0x1C to 0x1F, Latin-1 from U+00A1, Latin Extended-A, and the
# general punctuation U+2010 to U+2027.
_PLAIN = re.compile(
    rb"(?:[\x00-\x1b\x20-\x7f]++|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf]|[\xc4\xc5][\x80-\xbf]|\xe2\x80[\x90-\xa7])*+"
)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for byte in range(128):
        char = chr(byte)
        if char.isalpha():
            table[byte] = _LETTER
        elif char.isdigit():
            table[byte] = _NUMBER
        elif char in " \t\n\x0b\x0c\r":
            table[byte] = _BLANK
    table[[0xC3, 0xC4, 0xC5]] = _LETTER
    return table


_CLASS = _classes()
# The second byte after 0xC2: feminine and masculine ordinals and micro are letters,
# superscripts and fractions are numbers.
_AFTER_C2 = np.full(256, _OTHER, np.uint8)
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER


def _class_of(data: np.ndarray) -> np.ndarray:
    """The class of every byte's character."""
    kind = _CLASS[data]
    if (data >= 0x80).any():
        for lead in (0xC3, 0xC4, 0xC5):
            at = np.flatnonzero(data == lead)
            kind[at + 1] = _LETTER
        at = np.flatnonzero(data == 0xC3)
        at = at[np.isin(data[at + 1], [0x97, 0xB7])]
        kind[at] = kind[at + 1] = _OTHER
        at = np.flatnonzero(data == 0xC2)
        kind[at] = kind[at + 1] = _AFTER_C2[data[at + 1]]
    return kind


def pretoken_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in plain texts, each followed by one byte at ``edges``.

    Every edge is a start too.
    """
    kind = _class_of(data)
    kind[edges] = _EDGE
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[edges] = True
    # The last blank before a word stands alone, or goes with the word if it is a space.
    after = np.flatnonzero((kind[1:] < _BLANK) & (kind[:-1] == _BLANK)) + 1
    start[after - 1] = True
    start[after[data[after - 1] == 0x20]] = False
    # An apostrophe that starts a pre-token takes the letters of a contraction along.
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[(quote + 2 < len(data))]
    quote = quote[kind[quote + 1] == _LETTER]
    one, two = data[quote + 1], data[quote + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, length in ((single, 2), (double, 3)):
        at = quote[which]
        start[at + 1] = False
        rest = at + length
        start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


def _longer(room: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` written behind the first ``used`` entries; the room doubles where it is full."""
    if used + len(more) > len(room):
        room = np.concatenate([room[:used], np.zeros(used + 2 * len(more), room.dtype)])
    room[used : used + len(more)] = more
    return room


class Encoder:
    """The library's tokenizer, with a bounded memo of pre-tokens."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.longest = max([1, *map(len, self.specials)])
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(2 * MEMO_SPANS, np.uint64)  # open addressing, 0: free
        self.where = np.zeros(2 * MEMO_SPANS, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.firsts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.used = self.ids_used = 0  # of counts and firsts, and of flat; what follows is room

    def is_plain(self, text: bytes) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The memo's place of every span, -1 if it has none."""
        place, wanted = np.full(len(hashes), -1), np.arange(len(hashes))
        slot = hashes % np.uint64(len(self.keys))
        while len(wanted):
            there = self.keys[slot]
            hit = there == hashes[wanted]
            place[wanted[hit]] = self.where[slot[hit]]
            on = ~hit & (there != 0)
            wanted, slot = wanted[on], (slot[on] + np.uint64(1)) % np.uint64(len(self.keys))
        return place

    def _insert(self, hashes: np.ndarray) -> None:
        """Give distinct new spans the places after those in use."""
        left, slot = np.arange(len(hashes)), hashes % np.uint64(len(self.keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, pick = np.unique(slot[free], return_index=True)
            won = free[pick]
            self.keys[slot[won]] = hashes[won]
            self.where[slot[won]] = self.used + won
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) % np.uint64(len(self.keys))

    def _ask(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of every span, where they begin, ids) from the library.

        Spans that are not blank go in one text with line breaks between, which split it
        into just these spans; the rest one by one, their ids after those of the others.
        """
        blank = np.fromiter((span.isspace() for span in spans), bool, len(spans))
        joint = np.flatnonzero(~blank)
        text = b"\n".join([span for span, is_blank in zip(spans, blank.tolist()) if not is_blank])
        encoding = self.library.encode(text.decode(), add_special_tokens=False)
        ids, words = np.array(encoding.ids, np.uint32), np.array(encoding.word_ids, np.int64)
        cuts = np.append(np.flatnonzero(np.diff(words, prepend=-1)), len(words))
        if len(joint) and len(cuts) != 2 * len(joint):
            raise AssertionError("the library splits a pre-token")
        counts, firsts = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
        counts[joint], firsts[joint] = np.diff(cuts)[::2], cuts[:-1][::2]
        parts, size = [ids], len(ids)
        for i in np.flatnonzero(blank).tolist():
            part = np.array(self.library.encode(spans[i].decode(), add_special_tokens=False).ids, np.uint32)
            counts[i], firsts[i] = len(part), size
            parts.append(part)
            size += len(part)
        return counts, firsts, np.concatenate(parts)

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's place of every span."""
        hashes = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        place = self._find(hashes)
        if (place < 0).any():
            missing = np.flatnonzero(place < 0)
            new, first = np.unique(hashes[missing], return_index=True)
            if self.used + len(new) > MEMO_SPANS:
                self._forget()
                if len(new) < len(hashes):
                    new, first = np.unique(hashes, return_index=True)
                    missing = np.arange(len(hashes))
                if len(new) > MEMO_SPANS:
                    raise ValueError("a block holds more distinct pre-tokens than the memo")
            at, raw = missing[first], data.tobytes()
            counts, firsts, ids = self._ask([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self._insert(new)
            self.firsts = _longer(self.firsts, self.used, firsts + self.ids_used)
            self.counts = _longer(self.counts, self.used, counts)
            self.flat = _longer(self.flat, self.ids_used, ids)
            self.used, self.ids_used = self.used + len(new), self.ids_used + len(ids)
            place = self._find(hashes)
        return place

    def _plain(self, texts: list[bytes], want_ids: bool) -> Iterator[np.ndarray | int]:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        edges = np.cumsum(sizes) - 1
        data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        starts = pretoken_starts(data, edges)
        ends = np.append(starts[1:], len(data))
        is_edge = np.isin(starts, edges, assume_unique=True)
        stops = np.flatnonzero(is_edge) - np.arange(len(texts))
        starts, ends = starts[~is_edge], ends[~is_edge]
        place = self._lookup(data, starts, ends)
        counts = self.counts[place]
        total = np.concatenate(([0], np.cumsum(counts)))
        cuts = total[np.concatenate(([0], stops))]
        if not want_ids:
            yield from np.diff(cuts).tolist()
            return
        ids = self.flat[np.repeat(self.firsts[place] - total[:-1], counts) + np.arange(total[-1])]
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]

    def offsets(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte of every pre-token, number of its ids, all ids) of one chunk."""
        if self.is_plain(text):
            data = np.frombuffer(text + b"\x00", np.uint8)
            starts = pretoken_starts(data, np.array([len(text)]))
            ends, starts = starts[1:], starts[:-1]
            place = self._lookup(data, starts, ends)
            counts = self.counts[place]
            total = np.cumsum(counts)
            ids = self.flat[np.repeat(self.firsts[place] - total + counts, counts) + np.arange(counts.sum())]
            return starts, counts, ids
        chars = text.decode()
        encoding = self.library.encode(chars, add_special_tokens=False)
        width = np.fromiter((len(c.encode()) for c in chars), np.int64, len(chars))
        byte_at = np.concatenate(([0], np.cumsum(width)))
        words = encoding.word_ids  # None for special tokens, numbered anew after each of them
        begins = [
            i
            for i, w in enumerate(words)
            if i == 0 or w is None or words[i - 1] is None or w != words[i - 1]
        ]
        begins = np.array(begins, np.int64)
        starts = byte_at[np.array([encoding.offsets[i][0] for i in begins], np.int64)]
        return starts, np.diff(np.append(begins, len(words))), np.array(encoding.ids, np.uint32)

    def encode(self, texts: list[bytes], want_ids: bool = True) -> Iterator[np.ndarray | int]:
        """The ids of every text (or their number), in order."""
        plain: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) <= CHUNK_BYTES and self.is_plain(text):
                if size > BLOCK:
                    yield from self._plain(plain, want_ids)
                    plain, size = [], 0
                plain.append(text)
                size += len(text)
                continue
            if plain:
                yield from self._plain(plain, want_ids)
                plain, size = [], 0
            if len(text) > CHUNK_BYTES:
                parts = list(encode_long(self, text))
                ids = np.concatenate(parts) if want_ids else sum(map(len, parts))
            else:
                ids = self.library.encode(text.decode(), add_special_tokens=False).ids
                ids = np.array(ids, np.uint32) if want_ids else len(ids)
            yield ids
        if plain:
            yield from self._plain(plain, want_ids)


def _char_start(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def encode_long(
    encoder: Encoder, text: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES
) -> Iterator[np.ndarray]:
    """The ids of a huge text, part by part, by overlap resynchronisation.

    The left chunk's pre-tokens are the whole text's, but for those near its right end,
    whose next characters it does not see (a margin of the longest special token and the
    last two pre-tokens). The right chunk starts ``overlap`` bytes earlier, at a place that
    may be inside a pre-token. Pre-tokens are matched from left to right, so from a start
    that both chunks have, both go on as the whole text does: there they are spliced. If no
    common start exists, the right chunk starts earlier (twice the overlap) and the left
    one is made longer, until there is one or a chunk holds all that is left.
    """
    begin, known = 0, 0  # the chunk starts at begin; ids before known are out
    while True:
        size = chunk
        while True:
            end = _char_start(text, min(begin + size, len(text)))
            starts, counts, ids = encoder.offsets(text[begin:end])
            starts = starts + begin
            ends_at = np.concatenate(([0], np.cumsum(counts)))
            first = int(np.searchsorted(starts, known))
            if end == len(text):
                yield ids[ends_at[first] :]
                return
            sure = starts[:-2][starts[:-2] < end - encoder.longest]
            sure = sure[sure > known]
            width, splice = overlap, None
            while splice is None and len(sure):
                right = _char_start(text, max(begin + 1, end - width))
                theirs, _, _ = encoder.offsets(text[right : _char_start(text, min(end + width, len(text)))])
                common = np.intersect1d(sure, (theirs + right)[theirs > 0], assume_unique=True)
                if len(common):
                    splice = int(common[0])
                elif right <= known or width >= size:
                    break
                width *= 2
            if splice is not None:
                break
            size *= 2
        cut = int(np.searchsorted(starts, splice))
        yield ids[ends_at[first] : ends_at[cut]]
        begin, known = right, splice


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text."""

    def count(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        counts = pa.array(encoder_of(vocabulary).encode(texts, want_ids=False), pa.int64())
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array(map(len, texts), pa.int64()),
            "n_tokens": counts,
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = map_batches(rows, "text", "doc_id long, n_bytes long, n_tokens long", count)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
