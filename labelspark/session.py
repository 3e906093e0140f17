"""Session helpers: where intermediate tables go, and how a plan is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the session's ``spark.checkpoint.dir``.

    Without that setting the session's warehouse is taken, which executors share too.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where several later steps read the same expensive result. A written table
    outlives lost executors, and its file sizes let Catalyst choose join strategies.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Partitions for steps that are heavy for the bytes they read, such as pair joins.

    Adaptive execution merges small shuffle partitions by their bytes; an explicit number
    keeps such steps spread over the cluster.
    """
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


# Bytes of input per task for steps that make many rows of one, such as n-grams of texts.
TASK_BYTES = 64 << 20
# Sizes from here on say that Catalyst does not know the size.
_UNKNOWN_BYTES = 1 << 60


def spread_partitions(df: DataFrame) -> int:
    """Partitions for such steps: by the bytes that Catalyst expects of ``df``, and one per core
    at least. Files with few row groups would otherwise be the work of few tasks."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = work_partitions(df.sparkSession)
    return least if size >= _UNKNOWN_BYTES else max(least, -(-size // TASK_BYTES))
