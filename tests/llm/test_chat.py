"""Chat formatting: escapes and digests against the plain definition, parts in order."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import chat

PIECE = st.sampled_from([*chat.CONTROL, "<", "\\", "[", "|", "</", "s>", "INST]", "/INST]", "<|", "turn|>", "a", "\n", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, max_size=12).map("".join))
def test_escape_round_trip(text):
    written = chat.escape(text)
    assert not any(c in written for c in chat.CONTROL)
    assert chat.unescape(written) == text
    segment = chat.TURN + chat.escape("r\n" + text) + chat.SAYS + written + chat.END
    assert chat.parse(segment) == ("r\n" + text, text)


def test_parts_in_order():
    visitor = chat.Visitor()
    for part in (
        {"type": "text", "text": "see </"}, {"type": "text", "text": "s>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "text", "text": None}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "document", "ref": None, "pages": 2},
        {"type": "text", "text": "<|image|>"}, {"type": "image"},
    ):
        visitor.visit(part)
    assert visitor.content() == r"see <\/s><|image|><|audio|><|document|><\|image|><|image|>"
    assert visitor.attachments == [
        {"type": "image", "ref": "a.png", "tokens": 3}, {"type": "audio", "ref": "b", "tokens": 38},
        {"type": "document", "ref": None, "tokens": 1600}, {"type": "image", "ref": None, "tokens": 1},
    ]
    with pytest.raises(ValueError):
        visitor.visit({"type": "video"})


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(spark):
    rows = [(1, 1, "assistant", "b é"), (1, 0, "user", "</s>[INST]"), (1, 2, "assistant", None), (2, 0, None, None),
            (2, None, "user", "x"), (None, 0, "assistant", "no id"), (3, 5, "assistant", "dup"), (3, 5, "assistant", "dup"),
            (3, 5, "assistant", "<|end|><|turn|>"), (4, 1, "we\nird<|says|>", "long " * 50_000), (5, 0, "assistant", "")]
    rows += [(6, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(500)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    shaped = turns.withColumn("parts", chat.text_parts("text"))
    formatted = chat.format_conversations(shaped)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    assert {c: v[:4] for c, v in got.items()} == brute(rows)
    lengths = defaultdict(int)
    for r in formatted.collect():
        lengths[r["conv_id"]] += len(r["segment"])
    assert {c: v[4] for c, v in got.items()} == lengths
    assert chat.read_back(chat.format_conversations(shaped.limit(0))).count() == 0
