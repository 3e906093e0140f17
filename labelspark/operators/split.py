"""Multi-label stratified split."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.checks import require

# Instances of one label set are spread over this many ordered buckets (hex digits of a
# digest), so that no label set is ranked by a single task.
BUCKET_DIGITS = 3


def stratified_split(
    instances: DataFrame, test_size: float = 0.2, seed: int | None = None
) -> DataFrame:
    """(instance_id, set_key, is_validation): systematic sampling along the label sets.

    Instances are lined up by (digest of label set, label set, digest of id, id) and number
    p goes to validation where floor(p * t) steps up. Each label set's share is within one
    row of t, and so is the total. The position p is found without a global sort: counts
    per (set, bucket) give the offset of a bucket, and rows are numbered inside buckets. A
    seed changes the order of the instances. An instance without labels, null or empty, has
    the empty label set; one without an id has the empty digest.
    """
    require("test_size", test_size, "between 0 and 1, without both", 0 < test_size < 1)
    share = Fraction(test_size).limit_denominator(10_000)
    salt = "" if seed is None else f"{seed}:"

    labels = F.array_sort(F.array_distinct(F.col("genre_ids").cast("array<bigint>")))
    set_key = F.coalesce(F.array_join(labels.cast("array<string>"), ","), F.lit(""))
    id_text = F.coalesce(F.col("instance_id").cast("string"), F.lit(""))
    rows = instances.select(
        "instance_id",
        set_key.alias("set_key"),
        F.md5(F.concat(F.lit(salt), id_text)).alias("digest"),
    ).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))

    sizes = rows.groupBy("set_key", "bucket").agg(F.count("*").alias("n"))
    sets = (
        sizes.groupBy("set_key")
        .agg(F.sum("n").alias("n_set"))
        .withColumn("set_digest", F.md5("set_key"))
        .withColumn("set_bucket", F.substring("set_digest", 1, BUCKET_DIGITS))
    )
    set_buckets = (
        sets.groupBy("set_bucket")
        .agg(F.sum("n_set").alias("n_bucket"))
        .select(
            "set_bucket",
            (F.sum("n_bucket").over(Window.orderBy("set_bucket")) - F.col("n_bucket")).alias(
                "bucket_offset"
            ),
        )
    )
    in_bucket = Window.partitionBy("set_bucket").orderBy("set_digest", "set_key")
    set_offsets = (
        sets.withColumn("in_bucket", F.sum("n_set").over(in_bucket) - F.col("n_set"))
        .join(set_buckets, "set_bucket")
        .select("set_key", (F.col("bucket_offset") + F.col("in_bucket")).alias("set_offset"))
    )
    in_set = Window.partitionBy("set_key").orderBy("bucket")
    offsets = (
        sizes.withColumn("in_set", F.sum("n").over(in_set) - F.col("n"))
        .join(set_offsets, "set_key")
        .select("set_key", "bucket", (F.col("set_offset") + F.col("in_set")).alias("offset"))
    )
    inside = Window.partitionBy("set_key", "bucket").orderBy("digest", "instance_id")
    position = F.col("offset") + F.row_number().over(inside)
    a, b = share.numerator, share.denominator
    return (
        rows.join(offsets, ["set_key", "bucket"])
        .withColumn("p", position)
        .select(
            "instance_id", "set_key",
            F.expr(f"(p * {a}L) div {b}L > ((p - 1) * {a}L) div {b}L").alias("is_validation"),
        )
    )
