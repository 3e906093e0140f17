"""Distinct vectors: instances with equal term counts share one vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instance_vectors(weights: DataFrame) -> DataFrame:
    """(instance_id, terms, weights, lead, digest): one row per instance with known terms.

    ``terms`` are the rarity numbers of the vocabulary, ascending, with their ``weights``;
    ``lead`` is the heaviest term; equal digests mean equal term counts, so equal vectors.
    """
    entries = F.array_sort(F.collect_list(F.struct("rarity", "tf", "weight")))
    counts = F.transform("entries", lambda e: F.concat_ws(":", e["rarity"], e["tf"]))
    heaviest = F.array_max(
        F.transform("entries", lambda e: F.struct(e["weight"].alias("w"), e["rarity"].alias("t")))
    )
    return (
        weights.groupBy("instance_id")
        .agg(entries.alias("entries"))
        .select(
            "instance_id",
            F.col("entries.rarity").alias("terms"),
            F.col("entries.weight").alias("weights"),
            heaviest["t"].alias("lead"),
            F.sha2(F.array_join(counts, ","), 256).alias("digest"),
        )
    )


def vector_groups(vectors: DataFrame) -> DataFrame:
    """(rep, instance_id): instances with equal vectors, named by their lowest id.

    However many copies of a text there are, later joins see its vector once. Grouping
    moves digests, not vectors, and copies are combined before the shuffle.
    """
    digests = vectors.select("instance_id", "digest")
    reps = digests.groupBy("digest").agg(F.min("instance_id").alias("rep"))
    return digests.join(reps, "digest").select("rep", "instance_id")


def representatives(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``rows`` that belong to representatives, keyed by ``rep``."""
    reps = groups.filter(F.col("rep") == F.col("instance_id")).select("instance_id")
    return rows.join(reps, "instance_id", "left_semi").withColumnRenamed("instance_id", "rep")
