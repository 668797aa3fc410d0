"""Older text stores: one printed tuple ``(key,v v v)`` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import lenient_boolean, lenient_millis

_TUPLE = r"^\(([^,]*),(.*)\)$"


def key_and_value(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.regexp_extract("value", _TUPLE, 1).alias("key"),
        F.regexp_extract("value", _TUPLE, 2).alias("value"),
    )


def parse_relations(lines: DataFrame) -> DataFrame:
    return key_and_value(lines).select(
        F.col("key").alias("user"), F.col("value").alias("follower")
    )


def _part(i: int) -> Column:
    return F.get(F.col("parts"), F.lit(i))


def _int(i: int) -> Column:
    return _part(i).try_cast("int")


def _parts(lines: DataFrame) -> DataFrame:
    return key_and_value(lines).select("key", F.split("value", " ").alias("parts"))


def parse_tag_uses(lines: DataFrame) -> DataFrame:
    """``hashtag time quote reply retweet favorite favorited retweeted filter_level``."""
    return _parts(lines).select(
        F.col("key").alias("screen_name"),
        _part(0).alias("hashtag"),
        _part(1).try_cast("bigint").alias("time"),
        _int(2).alias("quote_count"),
        _int(3).alias("reply_count"),
        _int(4).alias("retweet_count"),
        _int(5).alias("favorite_count"),
        lenient_boolean(_part(6)).alias("favorited"),
        lenient_boolean(_part(7)).alias("retweeted"),
        _part(8).alias("filter_level"),
    )


def parse_tag_uses_with_text(lines: DataFrame) -> DataFrame:
    """The layout without time: eight properties, then free text that may hold spaces."""
    return _parts(lines).select(
        F.col("key").alias("screen_name"),
        _part(0).alias("hashtag"),
        _int(1).alias("quote_count"),
        _int(2).alias("reply_count"),
        _int(3).alias("retweet_count"),
        _int(4).alias("favorite_count"),
        lenient_boolean(_part(5)).alias("favorited"),
        lenient_boolean(_part(6)).alias("retweeted"),
        _part(7).alias("filter_level"),
        F.array_join(
            F.slice("parts", F.lit(9), F.greatest(F.size("parts") - 8, F.lit(0))), " "
        ).alias("text"),
    )


def parse_profiles(lines: DataFrame) -> DataFrame:
    """The eighteen stored values of the wide profile layout."""
    return _parts(lines).select(
        F.col("key").alias("screen_name"),
        _int(0).alias("followers_count"),
        _int(1).alias("friends_count"),
        _int(2).alias("listed_count"),
        lenient_millis(_part(3)).alias("time"),
        _int(4).alias("favourites_count"),
        _part(5).alias("time_zone"),
        lenient_boolean(_part(6)).alias("geo_enabled"),
        lenient_boolean(_part(7)).alias("verified"),
        _int(8).alias("statuses_count"),
        lenient_boolean(_part(9)).alias("contributors_enabled"),
        lenient_boolean(_part(10)).alias("is_translator"),
        lenient_boolean(_part(11)).alias("profile_use_background_image"),
        lenient_boolean(_part(12)).alias("default_profile"),
        lenient_boolean(_part(13)).alias("default_profile_image"),
        lenient_boolean(_part(14)).alias("following"),
        lenient_boolean(_part(15)).alias("follow_request_sent"),
        lenient_boolean(_part(16)).alias("notifications"),
        _part(17).alias("translator_type"),
    )


_PARSERS = {
    "relations": parse_relations,
    "tag_uses": parse_tag_uses,
    "tag_uses_with_text": parse_tag_uses_with_text,
    "profiles": parse_profiles,
}


def parse_store(lines: DataFrame, kind: str) -> DataFrame:
    return _PARSERS[kind](lines)


def format_store(df: DataFrame, key: str) -> DataFrame:
    """Print rows as ``(key,v v v)`` lines, the inverse of the parsers."""
    values = [
        F.initcap(F.col(name).cast("string"))
        if dtype == "boolean"
        else F.coalesce(F.col(name).cast("string"), F.lit("None"))
        for name, dtype in df.dtypes
        if name != key
    ]
    return df.select(
        F.concat(F.lit("("), F.col(key), F.lit(","), F.concat_ws(" ", *values), F.lit(")")).alias(
            "value"
        )
    )
