"""Where intermediate tables live and how loops cut their lineage.

Iterative operators write each round as a Parquet table under the folder that the
cluster names in ``spark.checkpoint.dir``. Such a table survives the loss of any
executor, carries real sizes (so the planner can choose a broadcast by measured bytes
and not by guess), and keeps plans short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Adaptive execution splits the hot partitions of plain equi joins; the engine's own
# salting covers the tables that loops keep partitioned (see operators.skew).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a folder in the session's warehouse, which all
    executors share as well. The session's own checkpoint folder is left as it is.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strata-tables"


def _run_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strata-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table of this application."""
    return f"{_run_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Like :func:`save`, with the number of rows, counted while they are written.

    The number steers loops (is anything left) and partition sizes; results never use it.
    """
    seen = Observation()
    table = save(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, seen.get["rows"]


def purge(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once their results are stored."""
    root = _run_root(spark)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)
