"""Record-level operators: de-duplication, latest or first per key, users and their tag uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best_per_key(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], best
) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct(*order_cols)
    return (
        df.groupBy(*keys)
        .agg(best(row, order).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]
) -> DataFrame:
    """The row with the greatest ``order_cols`` of each key.

    An aggregate, not a window: partial results per task keep a hot key cheap. End
    ``order_cols`` with an ingest sequence so that the order is total.
    """
    return _best_per_key(df, keys, order_cols, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The row with the least ``order_cols`` of each key."""
    return _best_per_key(df, keys, order_cols, F.min_by)


def tag_times(uses: DataFrame, user: str, tag: str, time: str) -> DataFrame:
    """The user -> tag -> times map in long form: one row per (user, tag, time).

    ``uses`` counts repeats, so the multiset of times is whole, and no list grows with
    the activity of one user.
    """
    return uses.groupBy(user, tag, time).agg(F.count(F.lit(1)).alias("uses"))


def user_tag_join(profiles: DataFrame, uses: DataFrame, key: str = "screen_name") -> DataFrame:
    """Profiles with each of their tag uses. ``profiles`` has one row per key."""
    return uses.join(profiles, key, "inner")


def ego_network(
    relations: DataFrame, uses: DataFrame, profiles: DataFrame, user: str, tag: str
) -> DataFrame:
    """Uses of ``tag`` by ``user`` and the user's followers, with their profiles and label 1.

    Names and tags compare in any case. Profiles: the first row per name in stored order
    (column ``seq`` if there is one).
    """
    ego = profiles.sparkSession.range(1).select(F.lit(user).alias("screen_name"))
    members = (
        relations.where(F.lower("user") == user.lower())
        .select(F.col("follower").alias("screen_name"))
        .unionByName(ego)
        .distinct()
    )
    order = ["seq"] if "seq" in profiles.columns else sorted(set(profiles.columns) - {"screen_name"})
    member_profiles = first_per_key(
        profiles.join(members, "screen_name", "left_semi"), ["screen_name"], order
    ).drop("seq")
    return (
        uses.where(F.lower("hashtag") == tag.lower())
        .join(member_profiles, "screen_name", "inner")
        .withColumn("label", F.lit(1))
    )


def asof_recency(uses: DataFrame, as_of, show_days: int = 20) -> DataFrame:
    """Last use of each tag by each user up to ``as_of``, its age in whole days, and whether
    the age is recent enough to be shown. ``uses`` has (screen_name, hashtag, ts)."""
    as_of_col = F.lit(as_of).cast("timestamp_ntz")
    day = F.floor(
        F.timestamp_diff("MICROSECOND", F.col("last_use"), as_of_col) / F.lit(86_400_000_000)
    ).cast("bigint")
    return (
        uses.where(F.col("ts") <= as_of_col)
        .groupBy("screen_name", "hashtag")
        .agg(F.max("ts").alias("last_use"))
        .withColumn("days_ago", day)
        .withColumn("shown", F.col("days_ago") <= show_days)
    )


def prediction_buckets(predictions: DataFrame, floor: float = 0.1) -> DataFrame:
    """The display rule for predictions: at least ``floor``, labelled with the ceiling."""
    shown = F.col("prediction") >= floor
    return predictions.withColumn("shown", shown).withColumn(
        "bucket", F.when(shown, F.ceil("prediction").cast("bigint"))
    )


def daily_tag_counts(uses: DataFrame, watermark: str | None = None) -> DataFrame:
    """Uses per (user, tag, day). With ``watermark`` the same plan runs on a stream and
    drops rows that come later than that."""
    if watermark is not None:
        uses = uses.withWatermark("ts", watermark)
    return (
        uses.groupBy(F.window("ts", "1 day"), "screen_name", "hashtag")
        .agg(F.count(F.lit(1)).alias("uses"))
        .select(F.col("window.start").alias("day"), "screen_name", "hashtag", "uses")
    )


def tag_recency_eligible(uses: DataFrame, cutoff_ms: int) -> DataFrame:
    """(user, tag) pairs with any use more than a day before the cut-off."""
    return uses.where(F.col("time") < cutoff_ms - 86_400_000).select("screen_name", "hashtag").distinct()
