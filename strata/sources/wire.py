"""The text feed: records end in ``:``, fields are split by ``,``.

Every function works the same on a batch frame and on a stream of lines (column
``value``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import (
    escape_delimiters,
    lenient_boolean,
    lenient_millis,
    unescape_delimiters,
)


def records(lines: DataFrame) -> DataFrame:
    """One row per non-empty record, its fields as an array."""
    record = F.explode(F.split("value", ":")).alias("record")
    return (
        lines.where(F.length("value") > 0)
        .select(record)
        .where(F.trim("record") != "")
        .select(F.split("record", ",").alias("fields"))
    )


def key_value(decoded: DataFrame) -> DataFrame:
    """First field as key, the rest as an array of values."""
    fields = F.col("fields")
    return decoded.select(
        F.get(fields, F.lit(0)).alias("key"),
        F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))).alias("values"),
    )


def _field(i: int) -> Column:
    return F.get(F.col("fields"), F.lit(i))


def _string(i: int) -> Column:
    """A string field; ``None`` stands for NULL."""
    return F.nullif(unescape_delimiters(_field(i)), F.lit("None"))


def _int(i: int) -> Column:
    return _field(i).try_cast("int")


def decode_relations(lines: DataFrame) -> DataFrame:
    return records(lines).select(
        F.trim(_string(0)).alias("user"), F.trim(_string(1)).alias("follower")
    )


def decode_tag_uses(lines: DataFrame) -> DataFrame:
    return records(lines).select(
        _string(0).alias("screen_name"),
        _string(1).alias("hashtag"),
        lenient_millis(_field(2)).alias("time"),
        _int(3).alias("quote_count"),
        _int(4).alias("reply_count"),
        _int(5).alias("retweet_count"),
        _int(6).alias("favorite_count"),
        lenient_boolean(_field(7)).alias("favorited"),
        lenient_boolean(_field(8)).alias("retweeted"),
        _string(9).alias("filter_level"),
        _string(10).alias("text"),
    )


def decode_profiles(lines: DataFrame) -> DataFrame:
    return records(lines).select(
        _string(0).alias("screen_name"),
        _int(1).alias("followers_count"),
        _int(2).alias("friends_count"),
        _int(3).alias("listed_count"),
        lenient_millis(_field(4)).alias("time"),
        _int(5).alias("favourites_count"),
        lenient_boolean(_field(6)).alias("verified"),
        _int(7).alias("statuses_count"),
        lenient_boolean(_field(8)).alias("contributors_enabled"),
        lenient_boolean(_field(9)).alias("default_profile"),
        lenient_boolean(_field(10)).alias("default_profile_image"),
    )


_DECODERS = {
    "relations": decode_relations,
    "tag_uses": decode_tag_uses,
    "profiles": decode_profiles,
}


def decode_wire(lines: DataFrame, kind: str) -> DataFrame:
    return _DECODERS[kind](lines)


def _text(name: str, dtype: str) -> Column:
    if dtype == "boolean":
        return F.initcap(F.col(name).cast("string"))
    text = F.col(name).cast("string")
    return F.coalesce(escape_delimiters(text) if dtype == "string" else text, F.lit("None"))


def encode_wire(df: DataFrame) -> DataFrame:
    """One wire line per row of a relation, tag-use or profile frame.

    Delimiters and line breaks are escaped in every string; NULL is written ``None``.
    """
    parts = [
        _text(name, dtype) for name, dtype in df.dtypes
    ]
    return df.select(F.concat(F.concat_ws(",", *parts), F.lit(",:")).alias("value"))
