"""As-of activity features per (user, tag, day), own and of the followers.

Uses are first counted per (user, tag, day slot). Everything after that works on slot
counts: the follower join, the unfolding of a slot into the few cut-offs it touches, and
the final sum. No use is ever joined with the list of cut-offs. Slots are unfolded only
after they were dealt by user and tag to partitions of bounded size, so what a task holds
of the unfolded rows does not grow with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000
# Uses a partition of the unfolded slots is made for, a shuffle's size says little of them.
_PARTITION_USES = 50_000


def _age_us(as_of: dt.datetime) -> Column:
    """Microseconds from a use to ``as_of``."""
    return F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(as_of).cast("timestamp_ntz"))


def slot_counts(uses: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(id, hashtag, slot, edge, n): uses per day slot before ``as_of``.

    Slot s covers ages in (s-1, s] days; ``edge`` marks ages of exactly s days, which the
    open far end of the look-back window excludes.
    """
    slot = F.expr(f"(age + {_DAY_US - 1}) div {_DAY_US}").cast("int")
    return (
        uses.where(F.col("ts") < F.lit(as_of).cast("timestamp_ntz"))
        .select("id", "hashtag", _age_us(as_of).alias("age"))
        .groupBy(
            "id", "hashtag", slot.alias("slot"), (F.col("age") % _DAY_US == 0).alias("edge")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _unfolded(lookback_days: int) -> Column:
    """The cut-offs that a row of slot counts touches, with what it brings to them: cut-off j
    lies j days before ``as_of``. A row with ``last`` only marks cut-offs 0 to last."""
    zero = F.lit(0).cast("bigint")
    no_edge = F.when(F.col("edge"), zero)

    def part(j: Column, eligible: bool, label: Column, tweets: Column, relations: Column) -> Column:
        return F.struct(
            j.alias("j"),
            F.lit(eligible).alias("eligible"),
            label.alias("label"),
            tweets.alias("num_tweets"),
            relations.alias("num_user_relations"),
        )

    parts = [part(F.col("slot") - 1, False, F.col("n"), zero, zero)]
    for back in range(2, lookback_days + 2):
        own, theirs = F.col("n"), F.col("theirs")
        if back > lookback_days:
            own, theirs = no_edge.otherwise(own), no_edge.otherwise(theirs)
        parts.append(part(F.col("slot") - back, False, zero, own, theirs))
    marks = F.transform(F.sequence(F.lit(0), "last"), lambda j: part(j, True, zero, zero, zero))
    return F.inline(F.when(F.col("last").isNull(), F.array(*parts)).otherwise(marks))


def _partitions(uses: DataFrame) -> int:
    """To how many partitions slots are dealt: by the uses, and one a core at least."""
    cores = uses.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-uses.count() // _PARTITION_USES))


def tag_features(
    uses: DataFrame,
    edges: DataFrame,
    profiles: DataFrame,
    begin: dt.datetime,
    as_of: dt.datetime,
    lookback_days: int = 3,
) -> DataFrame:
    """Training rows: one per (user, tag, cut-off T) with T = as_of, as_of - 1 day, ... > begin.

    A user is eligible at T if any use of the tag is older than T - 1 day. ``label`` counts
    uses in [T - 1 day, T), ``num_tweets`` those in (T - lookback - 1 days, T - 1 day), and
    ``num_user_relations`` the followers' uses in that same window.

    ``uses`` (id, hashtag, ts), ``edges`` distinct (src = user, dst = follower) between
    known users, ``profiles`` one row per ``id``.
    """
    slots = slot_counts(uses, as_of)
    days = -(-int((as_of - begin) / dt.timedelta(microseconds=1)) // _DAY_US)
    # ``n`` is read here only so that the slot counts are the same sub-plan in all three
    # places and Spark shuffles the uses once.
    first_use = slots.groupBy("id", "hashtag").agg(
        F.max(F.when(F.col("n") > 0, F.col("slot"))).alias("slot")
    )
    last = F.least(F.col("slot") - 2, F.lit(days - 1))
    eligible = first_use.select("id", "hashtag", last.alias("last")).where("last >= 0")
    # Followers count only for users who are eligible for something.
    wanted = edges.join(eligible.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    follower_slots = (
        slots.join(wanted.select("src", F.col("dst").alias("id")), "id")
        .groupBy(F.col("src").alias("id"), "hashtag", "slot", "edge")
        .agg(F.sum("n").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("int").alias("last")
    key = ["id", "hashtag"]
    dealt = (
        slots.select(*key, "slot", "edge", "n", zero.alias("theirs"), none)
        .unionByName(
            follower_slots.select(*key, "slot", "edge", zero.alias("n"), F.col("n").alias("theirs"), none)
        )
        .unionByName(eligible, allowMissingColumns=True)
        .repartition(_partitions(uses), *key)
    )
    rows = (
        dealt.select(*key, _unfolded(lookback_days))
        .where((F.col("j") >= 0) & (F.col("j") < days))
        .groupBy("id", "hashtag", "j")
        .agg(
            F.bool_or("eligible").alias("eligible"),
            F.sum("label").alias("label"),
            F.sum("num_tweets").alias("num_tweets"),
            F.sum("num_user_relations").alias("num_user_relations"),
        )
        .where("eligible")
    )
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.col("j"))
    return rows.select(
        "id", "hashtag", cutoff.alias("cutoff"), "label", "num_tweets", "num_user_relations"
    ).join(profiles, "id")


def score_features(
    uses: DataFrame,
    edges: DataFrame,
    profiles: DataFrame,
    as_of: dt.datetime,
    lookback_days: int = 3,
) -> DataFrame:
    """Scoring rows: every user who used a tag up to ``as_of``, with the own and the
    followers' uses later than ``as_of`` minus the look-back. Later uses do not exist yet."""
    recent = _age_us(as_of) < lookback_days * _DAY_US
    known = uses.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
    own = known.groupBy("id", "hashtag").agg(F.count_if(recent).alias("n"))
    zero = F.lit(0).cast("bigint")
    mine = own.select(
        "id",
        "hashtag",
        F.lit(True).alias("used"),
        F.col("n").alias("num_tweets"),
        zero.alias("num_user_relations"),
    )
    theirs = (
        own.where("n > 0")
        .join(edges.select("src", F.col("dst").alias("id")), "id")
        .select(
            F.col("src").alias("id"),
            "hashtag",
            F.lit(False).alias("used"),
            zero.alias("num_tweets"),
            F.col("n").alias("num_user_relations"),
        )
    )
    return (
        mine.unionByName(theirs)
        .groupBy("id", "hashtag")
        .agg(
            F.bool_or("used").alias("used"),
            F.sum("num_tweets").alias("num_tweets"),
            F.sum("num_user_relations").alias("num_user_relations"),
        )
        .where("used")
        .drop("used")
        .join(profiles, "id")
    )
