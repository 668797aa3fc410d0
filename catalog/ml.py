"""Queries of the regression models: train, score, evaluate."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog import inputs as I
from strata.operators import records
from strata.plans import features, model
from strata.session import new_path, save
from strata.sources.edges import read_libsvm

_NUMERIC = ["followers_count", "friends_count", "num_tweets", "num_user_relations"]
_CATEGORICAL = ["time_zone"]
_HASHED = 256


def _training(spark, sf):
    rows = features.tag_features(
        I.uses(spark, sf), I.follow(spark, sf), I.profiles(spark, sf), I.BEGIN, I.AS_OF
    )
    return save(rows.withColumn("label", F.col("label").cast("double")), "training")


def _scoring(spark, sf):
    return features.score_features(
        I.uses(spark, sf), I.follow(spark, sf), I.profiles(spark, sf), I.AS_OF
    )


def _pipeline(algo):
    return model.feature_pipeline(_NUMERIC, _CATEGORICAL, algo, num_features=_HASHED, seed=1)


def _judged(scored, fitted, known):
    """``scored`` with two verdicts on its predictions: within the labels of ``known``, and
    a model whose error there is at most that of always saying the mean."""
    labels = known.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.stddev_pop("label").alias("spread"))
    low, high, spread = labels.first()
    within = F.col("prediction").between(low - 1e-9, high + 1e-9)
    fits = model.rmse(model.score(fitted, known)) <= spread + 1e-9
    return scored.select("*", within.alias("in_range"), F.lit(fits).alias("beats_mean"))


def tree_predictions(spark, sf):
    """Tomorrow's tag uses per user and tag; the model goes through its stored form."""
    path, training = new_path(spark, "model"), _training(spark, sf)
    model.train(training, _pipeline("tree"), path)
    fitted = model.load(path)
    predictions = model.prediction_map(model.score(fitted, _scoring(spark, sf)))
    return _judged(predictions, fitted, training).drop("prediction")


def forest_predictions(spark, sf):
    """A forest on ready vectors: LibSVM in, every row scored."""
    li = I.table(spark, sf, "lineitem")
    vector = array_to_vector(
        F.array(
            F.col("l_quantity"),
            F.col("l_discount"),
            F.col("l_tax"),
            F.col("l_linenumber").cast("double"),
        )
    )
    path = new_path(spark, "libsvm")
    li.select(F.col("l_extendedprice").alias("label"), vector.alias("features")).write.format(
        "libsvm"
    ).save(path)
    rows = read_libsvm(spark, path, 4)
    training, held_out = model.split(rows, ["label", "features"], 0.7, seed=3)
    training = save(training, "training")
    fitted = model.train(training, model.vector_pipeline("forest", seed=1))
    scored = model.score(fitted, held_out).unionByName(model.score(fitted, training))
    return _judged(scored.select("label", "prediction"), fitted, training).drop("prediction")


def forest_ego(spark, sf):
    """A forest over the ego network of the most followed user; every label is 1 there."""
    relations = I.relations(spark, sf).distinct()
    user = relations.groupBy("user").count().orderBy(F.desc("count"), "user").first()["user"]
    rows = records.ego_network(
        relations, I.uses(spark, sf).drop("id"), I.profiles(spark, sf).drop("id"), user, "click"
    )
    training, held_out = model.split(save(rows, "ego"), ["seq"], 0.5, seed=5)
    pipeline = model.feature_pipeline(
        ["followers_count", "friends_count", "value"],
        ["time_zone"],
        "forest",
        num_features=_HASHED,
        seed=1,
    )
    scored = model.score(model.train(training, pipeline), held_out)
    return model.rmse_frame(scored)


def score_all_tags(spark, sf):
    """All tags scored in one job and stored with one directory per tag."""
    path, training = new_path(spark, "predictions"), _training(spark, sf)
    fitted = model.train(training, _pipeline("tree"))
    model.score_all_tags(fitted, _scoring(spark, sf), path)
    predictions = spark.read.parquet(path).select("id", "tag", "prediction")
    return _judged(predictions, fitted, training).drop("prediction")


def string_index(spark, sf):
    """Market segments as indices: most frequent first, ties by name."""
    rows = I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    indexer = StringIndexer(inputCol="c_mktsegment", outputCol="index", stringOrderType="frequencyDesc")
    return indexer.fit(rows).transform(rows).select("c_custkey", "index")


def vector_index(spark, sf):
    """Entries of few values as category indices, the others unchanged."""
    li = I.table(spark, sf, "lineitem")
    entries = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"))
    rows = li.select("l_orderkey", array_to_vector(entries).alias("features"))
    indexed = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=8).fit(rows).transform(rows)
    pair = vector_to_array("indexed")
    return indexed.select("l_orderkey", pair[0].alias("line_index"), pair[1].alias("quantity"))


def random_split(spark, sf):
    """Every order on one side of a 70/30 split by its key."""
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    left, right = model.split(orders, ["o_orderkey", "o_custkey"], 0.7, seed=3)
    return left.withColumn("side", F.lit("training")).unionByName(right.withColumn("side", F.lit("held out")))


def rmse(spark, sf):
    """Error of a fixed prediction: order price estimated from its line items."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = I.table(spark, sf, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = o.join(lines, "o_orderkey").select(
        F.col("o_totalprice").alias("label"), (F.col("n") * 50000.0).alias("prediction")
    )
    return model.rmse_frame(rows).select(F.round("rmse", 3).alias("rmse"))


QUERIES = {
    "tree_predictions": tree_predictions,
    "forest_predictions": forest_predictions,
    "forest_ego": forest_ego,
    "score_all_tags": score_all_tags,
    "rmse": rmse,
    "string_index": string_index,
    "vector_index": vector_index,
    "random_split": random_split,
}

_SQL_SCORED = f"""WITH {I.SQL_USES}, {I.SQL_PROFILES}, scored AS (
  SELECT DISTINCT p.id, p.screen_name, hashtag FROM uses u JOIN profiles p ON p.id = u.id WHERE ts <= TIMESTAMP '{I.AS_OF}')"""

ORACLES = {
    # A prediction itself is not SQL; that it is there for every key, and its verdicts, are.
    "tree_predictions": f"{_SQL_SCORED} SELECT screen_name, hashtag, true AS in_range, true AS beats_mean FROM scored",
    "score_all_tags": f"{_SQL_SCORED} SELECT id, hashtag AS tag, true AS in_range, true AS beats_mean FROM scored",
    "forest_predictions": "SELECT l_extendedprice AS label, true AS in_range, true AS beats_mean FROM lineitem",
    # Every label in an ego network is 1.
    "forest_ego": "SELECT CAST(0 AS DOUBLE) AS rmse",
    "string_index": """WITH ranked AS (
  SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT c_custkey, CAST(i AS DOUBLE) AS index FROM customer JOIN ranked USING (c_mktsegment)""",
    "vector_index": """WITH ranked AS (
  SELECT l_linenumber, row_number() OVER (ORDER BY l_linenumber) - 1 AS i FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(i AS DOUBLE) AS line_index, CAST(l_quantity AS DOUBLE) AS quantity
FROM lineitem JOIN ranked USING (l_linenumber)""",
    "random_split": """SELECT o_orderkey, o_custkey,
  CASE WHEN CAST('0x' || substr(md5(o_orderkey || '/' || o_custkey || ':3'), 1, 15) AS BIGINT)
    < CAST(floor(0.7::DOUBLE * 1152921504606846976) AS BIGINT) THEN 'training' ELSE 'held out' END AS side
FROM orders""",
    "rmse": """SELECT round(sqrt(avg((o_totalprice - n * 50000.0) ** 2)), 3) AS rmse FROM orders
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
}
