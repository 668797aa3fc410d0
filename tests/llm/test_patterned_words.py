"""Two different words that a polynomial hash modulo 2^64 takes for one: Thue-Morse and its swap."""

import numpy as np
import tokenizers
from public_tokenizers import path

from strata.llm import hashing, near, packing, substrings, tokens


def _pair(letters="ae", size=1024):
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_hashes_differ():
    for letters in ("ab", "ae", "xy"):
        words = _pair(letters)
        one, other = hashing.word_hashes([w.encode() for w in words])
        assert one[0] != other[0]
    # Equal spans at any place, in any text and block, have one hash.
    text = b"ab " * 5 + b"x" * 3000 + b" ab"
    hashes = next(iter(hashing.word_hashes([text])))
    assert len({hashes[k] for k in (0, 1, 4, 6)}) == 1 and len(set(hashes.tolist())) == 2
    draw = np.random.default_rng(1)
    many = [bytes(draw.integers(97, 100, 9).tolist()) for _ in range(20000)]
    found = np.concatenate(list(hashing.word_hashes(many)))
    assert len(set(found.tolist())) == len(set(many))


def test_operators(spark):
    one, other = _pair()
    docs = spark.createDataFrame([(1, "same " * 12 + one), (2, "same " * 12 + other)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.without_repeats(docs).collect()] == [0, 0]
    few = spark.createDataFrame(
        [(k, " ".join([f"w{j}" for j in range(8)] + [w])) for k, w in enumerate((one, other))], "doc_id long, text string"
    )
    assert {r["component_id"] for r in near.near_duplicates(few).collect()} == {0, 1}
    library = tokenizers.Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    both = spark.createDataFrame([(1, f"{one} {other} {one}"), (2, other), (3, one)], "doc_id long, text string")
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in both.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(both).collect()} == want
    packed = packing.pack(both).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] - 1 for r in packed} == want
