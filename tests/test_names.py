"""The kept dictionary of names: ids stay, collisions are told apart, repeats change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from strata.streaming.names import NameDictionary


def few_ids(name):
    """So few ids that most names collide."""
    return F.pmod(F.crc32(name.cast("binary")), F.lit(37)).cast("bigint")


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "screen_name string")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def by_hand(batches, hashed):
    """Open addressing, a batch at a time, the least name first in each attempt."""
    holder, given = {}, {}
    for batch in batches:
        left, attempt = sorted({n for n in batch if n is not None and n not in given}), 0
        while left:
            after = []
            for name in left:
                at = hashed(name if attempt == 0 else f"{name}#{attempt}")
                if at in holder:
                    after.append(name)
                else:
                    holder[at], given[name] = name, at
            left, attempt = after, attempt + 1
    return given


def test_colliding_names_keep_their_ids_when_others_come(spark, tmp_path):
    import zlib

    draw = random.Random(4)
    batches = [[f"n{draw.randrange(40)}" for _ in range(9)] + [None, ""] for _ in range(3)]
    names = NameDictionary(spark, str(tmp_path), buckets=4, hashed=few_ids)
    seen = {}
    for number, batch in enumerate(batches):
        names.add(frame(spark, batch), number)
        if number == 1:
            names.compact()
        now = pairs(names.read())
        assert all(now[name] == at for name, at in seen.items()), "ids never change"
        assert len(set(now.values())) == len(now)
        seen = now
    assert seen == by_hand(batches, lambda n: zlib.crc32(n.encode()) % 37)
    everyone = [n for batch in batches for n in batch]
    assert pairs(names.ids(frame(spark, [*everyone, "nobody"]))) == seen


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    names = NameDictionary(spark, str(tmp_path), buckets=4, hashed=few_ids)
    names.add(frame(spark, ["a", "b", "c"]), 0)
    names.add(frame(spark, ["c", "d", "e"]), 1)
    before = pairs(names.read())
    names.add(frame(spark, ["c", "d", "e"]), 1)
    assert pairs(names.read()) == before and set(before) == set("abcde")
    names.add(frame(spark, []), 2)
    assert pairs(names.read()) == before


def test_an_empty_dictionary(spark, tmp_path):
    names = NameDictionary(spark, str(tmp_path))
    assert names.ids(frame(spark, ["a"])).isEmpty() and names.read().isEmpty()
    names.add(frame(spark, [None, ""]), 0)
    assert set(pairs(names.read())) == {""}


def test_no_free_id_is_an_error(spark, tmp_path):
    names = NameDictionary(spark, str(tmp_path), buckets=1, hashed=lambda n: F.length(n) * F.lit(0).cast("bigint"))
    with pytest.raises(RuntimeError, match="free id"):
        names.add(frame(spark, ["a", "b"]), 0)
