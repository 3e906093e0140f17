"""The given tables, seen as instances, labels, scores and a prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue of the documents' labels; the last two are never used.
DOCUMENT_LABELS = (
    (1, "en"), (2, "de"), (3, "fr"), (4, "es"), (5, "high_quality"),
    (6, "toxic"), (7, "long_text"), (8, "unused"), (9, "unused_two"),
)
LONG_TEXT = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOCUMENT_LABELS), "id int, name string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, title, overview)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("instance_id"), F.col("lang").alias("title"),
        F.col("text").alias("overview"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, title, overview, genre_ids): language, quality, toxicity and length labels."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels")
    lang = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2)
    lang = lang.when(F.col("lang") == "fr", 3).otherwise(4)
    labels = F.array_compact(
        F.array(
            lang,
            F.when(F.col("quality") == 1, 5),
            F.when(F.col("toxic") == 1, 6),
            F.when(F.col("n_chars") > LONG_TEXT, 7),
        )
    )
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("instance_id"), F.col("lang").alias("title"),
        F.col("text").alias("overview"), labels.cast("array<bigint>").alias("genre_ids"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, title, overview, genre_ids STRING): label lists in every spelling."""
    spelling = F.element_at(
        F.array(
            F.lit("[1, 5]"), F.lit('["2","6"]'), F.lit("[3.7, 99]"), F.lit("7"), F.lit("[]"),
            F.lit(None).cast("string"), F.lit('["4","abc"]'), F.lit("3,4"),
        ),
        (F.col("instance_id") % 8 + 1).cast("int"),
    )
    return documents(spark, sf_dir).withColumn("genre_ids", spelling)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, label_id): an order's line items seen as nation labels, with repeats."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("instance_id"), F.col("s_nationkey").alias("label_id")
    )


def basket_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, label_id, name, score, y): a fixed score for every document and label."""
    ids = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in DOCUMENT_LABELS])
    score = ((F.col("instance_id") * 7919 + F.col("label.id") * 104729) % 1000).cast("double") / 1000.0
    return (
        labelled_documents(spark, sf_dir)
        .select("instance_id", "genre_ids", F.explode(ids).alias("label"))
        .select(
            "instance_id", F.col("label.id").alias("label_id"), "label.name", score.alias("score"),
            F.array_contains("genre_ids", F.col("label.id").cast("bigint")).cast("int").alias("y"),
        )
    )


def prediction_log(events: DataFrame) -> DataFrame:
    """The events table, batch or streaming, seen as a prediction log."""
    even = F.col("user_id") % 2 == 0
    value = F.col("value")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("POST").alias("method"),
        F.when(even, "transformation").otherwise("adaptation").alias("model_type"),
        F.when(even, "/predict/transformation").otherwise("/predict/adaptation").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (value / 1000.0).alias("latency_sec"),
        F.col("event_type").alias("genre"),
        F.when(value > 500, 1.0).otherwise(value / 500.0).alias("confidence"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_log(table(spark, sf_dir, "events"))
