"""Explicit schemas of the JSON feeds; nothing is inferred from their lines.

They are DDL texts, which every reader takes and which need no session to be defined.
"""

from __future__ import annotations

# The parts of a status object that are read; other members are ignored.
TWEET_JSON = (
    "timestamp_ms string, text string, quote_count int, reply_count int, retweet_count int, "
    "favorite_count int, favorited boolean, retweeted boolean, filter_level string, "
    "entities struct<hashtags: array<struct<text: string>>>, "
    "user struct<screen_name: string, followers_count: int, friends_count: int, "
    "listed_count: int, created_at: string, favourites_count: int, verified: boolean, "
    "statuses_count: int, contributors_enabled: boolean, default_profile: boolean, "
    "default_profile_image: boolean>, "
    "limit struct<track: bigint>"
)

# One stored page of an author's followers.
FOLLOWER_PAGE_JSON = (
    "author string, next_cursor bigint, users array<struct<screen_name: string, "
    "followers_count: int, friends_count: int, listed_count: int, created_at: string, "
    "favourites_count: int, verified: boolean, statuses_count: int, "
    "contributors_enabled: boolean, default_profile: boolean, default_profile_image: boolean>>"
)
