"""Reading the instance table and the label catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.session import materialize

INSTANCE_COLUMNS = ("title", "overview", "genre_ids")
CATALOGUE_COLUMNS = ("id", "name")

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def require_columns(df: DataFrame, expected: tuple[str, ...], what: str) -> DataFrame:
    """Raise if columns are missing; further columns pass through. Runs no job."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"missing required {what} columns {missing} in {sorted(df.columns)}")
    return df


def _read(spark: SparkSession, path: str, source: str, options: dict) -> DataFrame:
    try:
        return spark.read.format(source).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"file not found: {path}") from error
        raise


def read_instances(
    spark: SparkSession, path: str, source: str = "csv", multi_line: bool = True
) -> DataFrame:
    """The instance table with all columns as text (CSV) or as stored (Parquet).

    A CSV file whose texts hold line ends is read by one task; say ``multi_line=False`` where
    they hold none, or keep large tables as Parquet: both are split over tasks.

    Rows have no position in Spark: a table without ``instance_id`` must get one, see
    ``with_instance_id``.
    """
    df = _read(spark, path, source, CSV_OPTIONS | {"multiLine": multi_line} if source == "csv" else {})
    return require_columns(df, INSTANCE_COLUMNS, "instance")


def with_instance_id(instances: DataFrame) -> DataFrame:
    """Cast a given ``instance_id``, or number the rows.

    Numbers have gaps. Rows of one file part keep their order; which part comes first is
    Spark's choice (it reads large parts first), so "first" means lowest number, not first
    file. The numbered table is written once, so every later step and every repeated task
    sees the same ids.
    """
    if "instance_id" in instances.columns:
        return instances.withColumn("instance_id", F.col("instance_id").cast("bigint"))
    numbered = instances.withColumn("instance_id", F.monotonically_increasing_id())
    return materialize(numbered, "numbered-instances")


def read_catalogue(spark: SparkSession, path: str, source: str = "csv") -> DataFrame:
    """(id BIGINT, name STRING, ...)."""
    df = _read(spark, path, source, CSV_OPTIONS if source == "csv" else {})
    require_columns(df, CATALOGUE_COLUMNS, "catalogue")
    return df.withColumn("id", df["id"].cast("bigint"))
