"""Writing a report as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """Write the one-row nested report as indented JSON text; parent folders are made."""
    text = F.to_json(F.struct(*report.columns), {"pretty": "true"})
    report.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
