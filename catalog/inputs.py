"""The relations of the engine, derived by Spark from the given tables.

* follow graph: consecutive orders link their customers
* geo hierarchy and graph: customer - nation - region
* attribute graph: customer - nation, market segment, order priorities
* page graph: page - link target
* tag uses: events; profiles: customers
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import name_id

AS_OF = dt.datetime(2024, 1, 31)
BEGIN = dt.datetime(2024, 1, 1)
# Within the events: what comes later must not be seen.
SCORE_AS_OF = dt.datetime(2024, 1, 20)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_follow(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, weight): one row per consecutive pair of orders; weight is the priority
    digit of the first."""
    orders = table(spark, sf, "orders")
    first = orders.select(
        (F.col("o_orderkey") + 1).alias("k"),
        F.col("o_custkey").alias("src"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("weight"),
    )
    second = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("dst"))
    return first.join(second, "k").where("src <> dst").select("src", "dst", "weight")


def follow(spark: SparkSession, sf: str) -> DataFrame:
    return raw_follow(spark, sf).select("src", "dst").distinct()


def weighted_follow(spark: SparkSession, sf: str) -> DataFrame:
    return raw_follow(spark, sf).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """Hierarchy region / nation / customer over the customers."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    keys = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.col("n_regionkey").cast("bigint").alias("key_0"),
        F.col("n_nationkey").cast("bigint").alias("key_1"),
        F.col("c_custkey").alias("key_2"),
    )
    return keys.select("id", F.array("key_0", "key_1", "key_2").alias("key"), "key_0", "key_1", "key_2")


def geo_edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation -> region; nations and regions have negative ids."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("src"), (-F.col("c_nationkey").cast("bigint") - 1).alias("dst")
    )
    n = table(spark, sf, "nation").select(
        (-F.col("n_nationkey").cast("bigint") - 1).alias("src"),
        (-F.col("n_regionkey").cast("bigint") - 101).alias("dst"),
    )
    return c.unionByName(n)


def attribute_edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation, market segment and the priorities of its orders."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    nation = c.select(
        F.col("c_custkey").alias("src"), (-F.col("c_nationkey").cast("bigint") - 1).alias("dst")
    )
    segment = c.select(F.col("c_custkey").alias("src"), name_id(F.col("c_mktsegment")).alias("dst"))
    priority = o.select(F.col("o_custkey").alias("src"), name_id(F.col("o_orderpriority")).alias("dst"))
    return nation.unionByName(segment).unionByName(priority).distinct()


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, href), each once."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.explode(hrefs).alias("href")).distinct()


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(spark, sf).select(
        F.col("page_id").alias("src"), name_id(F.col("href")).alias("dst")
    )


def uses(spark: SparkSession, sf: str) -> DataFrame:
    """(id, screen_name, hashtag, ts, time, value, seq)"""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"),
        F.col("event_type").alias("hashtag"),
        "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        "value",
        F.col("event_id").alias("seq"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer in the shape of a user profile."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("screen_name"),
        F.floor("c_acctbal").cast("int").alias("followers_count"),
        F.col("c_nationkey").alias("friends_count"),
        F.col("c_mktsegment").alias("time_zone"),
        (F.col("c_acctbal") > 5000).alias("verified"),
    )


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """(user, follower) names of the raw follow rows."""
    def name(end: str):
        return F.concat(F.lit("u"), F.col(end).cast("string"))

    return raw_follow(spark, sf).select(name("src").alias("user"), name("dst").alias("follower"))


# The same relations for the SQL side.
SQL_RAW_FOLLOW = """raw_follow AS (
  SELECT a.o_custkey AS src, b.o_custkey AS dst, CAST(substr(a.o_orderpriority, 1, 1) AS INTEGER) AS weight
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey)"""
SQL_FOLLOW = f"""{SQL_RAW_FOLLOW},
follow AS (SELECT DISTINCT src, dst FROM raw_follow)"""
SQL_GEO = """geo AS (
  SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS key_0, CAST(n_nationkey AS BIGINT) AS key_1, c_custkey AS key_2
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SQL_GEO_EDGES = """geo_edges AS (
  SELECT c_custkey AS src, -CAST(c_nationkey AS BIGINT) - 1 AS dst FROM customer
  UNION ALL SELECT -CAST(n_nationkey AS BIGINT) - 1, -CAST(n_regionkey AS BIGINT) - 101 FROM nation)"""
SQL_NAME_ID = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"
SQL_ATTRIBUTE_EDGES = f"""attribute_edges AS (
  SELECT c_custkey AS src, -CAST(c_nationkey AS BIGINT) - 1 AS dst FROM customer
  UNION SELECT c_custkey, {SQL_NAME_ID.format("c_mktsegment")} FROM customer
  UNION SELECT o_custkey, {SQL_NAME_ID.format("o_orderpriority")} FROM orders)"""
SQL_PAGE_LINKS = """page_links AS (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
SQL_PAGE_EDGES = f"""{SQL_PAGE_LINKS},
page_edges AS (SELECT page_id AS src, {SQL_NAME_ID.format("href")} AS dst FROM page_links)"""
SQL_USES = """uses AS (
  SELECT user_id AS id, 'u' || user_id AS screen_name, event_type AS hashtag, ts, epoch_us(ts) // 1000 AS time, value, event_id AS seq
  FROM events)"""
SQL_PROFILES = """profiles AS (
  SELECT c_custkey AS id, 'u' || c_custkey AS screen_name, CAST(floor(c_acctbal) AS INTEGER) AS followers_count,
         c_nationkey AS friends_count, c_mktsegment AS time_zone, c_acctbal > 5000 AS verified FROM customer)"""
SQL_RELATIONS = f"""{SQL_RAW_FOLLOW},
relations AS (SELECT 'u' || src AS "user", 'u' || dst AS follower FROM raw_follow)"""
