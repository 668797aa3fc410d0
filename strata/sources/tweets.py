"""Status objects and follower pages (JSON text, column ``value``) to the three relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import created_at_ms
from strata.schemas import FOLLOWER_PAGE_JSON, TWEET_JSON

_PROFILE_COLUMNS = [
    "screen_name",
    "followers_count",
    "friends_count",
    "listed_count",
    "time",
    "favourites_count",
    "verified",
    "statuses_count",
    "contributors_enabled",
    "default_profile",
    "default_profile_image",
]


def _profile(users: DataFrame) -> DataFrame:
    return users.select("user.*").withColumn("time", created_at_ms(F.col("created_at"))).select(
        *_PROFILE_COLUMNS
    )


def _parsed(lines: DataFrame, schema: str, wanted) -> DataFrame:
    """Parsed objects that are ``wanted``. As a generator, so that each line is parsed once
    and not again by the pushed-down filter."""
    parsed = F.array(F.from_json("value", schema))
    return lines.select(F.explode(F.filter(parsed, wanted)).alias("object")).select("object.*")


def parse_tweets(lines: DataFrame) -> DataFrame:
    """Status objects; control messages (those with a ``limit`` member) and lines that are
    no status are skipped."""
    return _parsed(
        lines, TWEET_JSON, lambda t: t["user"]["screen_name"].isNotNull() & t["limit"].isNull()
    )


def only_tracked(uses: DataFrame, tags: DataFrame) -> DataFrame:
    """Uses of tracked tags, compared in lower case on both sides.

    ``tags`` is the tag dimension (each tag once); the planner broadcasts it when its
    measured size allows.
    """
    wanted = tags.select(F.lower("hashtag").alias("hashtag")).distinct()
    return uses.withColumn("hashtag", F.lower("hashtag")).join(wanted, "hashtag", "left_semi")


def tagged(tweets: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row per hashtag of a status (column ``hashtag``, lower case), all or tracked ones."""
    rows = tweets.select("*", F.explode("entities.hashtags.text").alias("hashtag"))
    rows = rows.withColumn("hashtag", F.lower("hashtag"))
    return rows if tags is None else only_tracked(rows, tags)


def _uses(tagged_rows: DataFrame) -> DataFrame:
    return tagged_rows.select(
        F.col("user.screen_name").alias("screen_name"),
        "hashtag",
        F.col("timestamp_ms").try_cast("bigint").alias("time"),
        "quote_count",
        "reply_count",
        "retweet_count",
        "favorite_count",
        F.coalesce("favorited", F.lit(False)).alias("favorited"),
        F.coalesce("retweeted", F.lit(False)).alias("retweeted"),
        "filter_level",
        "text",
    )


def tag_uses(tweets: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Tag-use rows of the statuses."""
    return _uses(tagged(tweets, tags))


def author_profiles(tweets: DataFrame) -> DataFrame:
    return _profile(tweets)


def parse_follower_pages(lines: DataFrame) -> DataFrame:
    pages = _parsed(lines, FOLLOWER_PAGE_JSON, lambda p: p["next_cursor"].isNotNull())
    return pages.select("author", F.explode("users").alias("user"))


def follower_relations(followers: DataFrame) -> DataFrame:
    return followers.select(
        F.col("author").alias("user"), F.col("user.screen_name").alias("follower")
    )


def follower_profiles(followers: DataFrame) -> DataFrame:
    return _profile(followers)


def tweets_to_relations(
    statuses: DataFrame, pages: DataFrame, tags: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Follow edges, tracked tag uses and profiles (authors of tracked tags, followers)."""
    rows = tagged(parse_tweets(statuses), tags)
    followers = parse_follower_pages(pages)
    return (
        follower_relations(followers),
        _uses(rows),
        _profile(rows).distinct().unionByName(follower_profiles(followers)),
    )
