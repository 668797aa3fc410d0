"""Training, scoring and explaining the tag-use models with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import below_share
from strata.sources.sinks import write_predictions

# Of a row training keeps four bytes per entry of its vector and, in a forest of the default
# 20 trees, about so many more.
_ROW_BYTES = 256
_PARTITION_BYTES = 64 << 20

_ALGORITHMS = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor}


def feature_pipeline(
    numeric: Sequence[str],
    categorical: Sequence[str],
    algo: str = "tree",
    label: str = "label",
    num_features: int = 1 << 12,
    seed: int = 0,
) -> Pipeline:
    """Index the categories, hash all columns into one vector, fit a tree or a forest.

    Tree training holds one number per hashed slot and row, so ``num_features`` may be
    small; that no two columns share a slot is checked, and raises if they do.
    """
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep")
        for c in categorical
    ]
    hasher = FeatureHasher(
        inputCols=[*numeric, *[f"{c}_index" for c in categorical]],
        outputCol="features",
        numFeatures=num_features,
    )
    _check_slots(hasher)
    regressor = _ALGORITHMS[algo](labelCol=label, featuresCol="features", seed=seed)
    return Pipeline(stages=[*indexers, hasher, regressor])


def _check_slots(hasher: FeatureHasher) -> None:
    """Every input is a number, whose slot depends on its column's name alone: a row of
    ones shows as many slots as there are columns, unless two of them collide."""
    columns = hasher.getInputCols()
    ones = SparkSession.active().range(1).select(*[F.lit(1.0).alias(c) for c in columns])
    vector = hasher.transform(ones).first()["features"]
    if vector.numNonzeros() < len(columns) or max(vector.values) > 1:
        raise ValueError(f"input columns share one of the {hasher.getNumFeatures()} slots; raise num_features")


def vector_pipeline(
    algo: str = "forest", max_categories: int = 4, seed: int = 0
) -> Pipeline:
    """For ready vectors (LibSVM): index low-cardinality entries, then fit."""
    indexer = VectorIndexer(
        inputCol="features",
        outputCol="indexed",
        maxCategories=max_categories,
        handleInvalid="keep",
    )
    regressor = _ALGORITHMS[algo](labelCol="label", featuresCol="indexed", seed=seed)
    return Pipeline(stages=[indexer, regressor])


def train(df: DataFrame, pipeline: Pipeline, path: str | None = None) -> PipelineModel:
    """Fit, and store the model at ``path`` so that scoring jobs can load it.

    Training keeps the rows as arrays and passes over them many times, so they are spread
    first: over all cores, and so that a partition's arrays stay below a bound. How many
    files the rows come from says nothing of that, since stored rows are far smaller.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    model = pipeline.fit(df.repartition(max(cores, _training_partitions(df, pipeline))))
    if path is not None:
        model.write().overwrite().save(path)
    return model


def _training_partitions(df: DataFrame, pipeline: Pipeline) -> int:
    """Partitions in which the arrays that training keeps of their rows fit."""
    row_bytes = _ROW_BYTES + 4 * _vector_size(df, pipeline)
    return -(-df.count() * row_bytes // _PARTITION_BYTES)


def _vector_size(df: DataFrame, pipeline: Pipeline) -> int:
    """Entries of a row's feature vector: the hasher's slots, or those of the ready vectors."""
    for stage in pipeline.getStages():
        if isinstance(stage, FeatureHasher):
            return stage.getNumFeatures()
        if isinstance(stage, VectorIndexer):
            first = df.select(stage.getInputCol()).first()
            return 0 if first is None or first[0] is None else len(first[0])
    return 0


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def score_all_tags(model: PipelineModel, df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Score every tag in one job; the output has one directory per tag."""
    write_predictions(score(model, df).withColumnRenamed("hashtag", "tag"), path, "tag", fmt)


def split(
    df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """A random split by the rows' key: the same rows on each side in every run."""
    share = below_share(F.concat_ws("/", *[F.col(c).cast("string") for c in key]), fraction, seed)
    return df.where(share), df.where(~share)


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return RegressionEvaluator(
        labelCol=label, predictionCol=prediction, metricName="rmse"
    ).evaluate(df)


def rmse_frame(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the root mean squared error."""
    error = F.col(label).cast("double") - F.col(prediction)
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def describe(model: PipelineModel) -> str:
    return model.stages[-1].toDebugString


def importances(model: PipelineModel) -> dict[int, float]:
    """Non-zero feature importances by hashed or indexed position."""
    vector = model.stages[-1].featureImportances
    return dict(zip(map(int, vector.indices), map(float, vector.values), strict=True))


def prediction_map(predictions: DataFrame) -> DataFrame:
    """(screen_name, hashtag, prediction), what the explorer colours by."""
    return predictions.select("screen_name", "hashtag", "prediction")
