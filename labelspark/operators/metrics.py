"""Evaluation of multi-label predictions.

Input is long: one row per (instance_id, label_id) with the truth ``y`` (0/1) and either a
``score`` or a decision ``predicted`` (0/1). Every instance has a row for every label; where the
numbers of rows differ, the figures per instance are an error. Each result is a one-row
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.checks import require

# Fixed values of the evaluation.
DECISION_THRESHOLD = 0.5
DEFAULT_K = 3


def decide(scores: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Add ``predicted``: 1 where the score reaches the threshold."""
    return scores.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def hamming_loss(decisions: DataFrame) -> DataFrame:
    wrong = (F.col("y") != F.col("predicted")).cast("double")
    return decisions.agg(F.avg(wrong).alias("hamming_loss"))


def subset_accuracy(decisions: DataFrame) -> DataFrame:
    right = (F.col("y") == F.col("predicted")).cast("int")
    return (
        decisions.groupBy("instance_id")
        .agg(F.min(right).alias("all_right"), F.count(F.lit(1)).alias("n_labels"))
        .agg(_whole(F.avg(F.col("all_right").cast("double"))).alias("subset_accuracy"))
    )


def _f1() -> Column:
    hits = F.count_if((F.col("y") == 1) & (F.col("predicted") == 1))
    errors = F.count_if(F.col("y") != F.col("predicted"))
    return F.when(2 * hits + errors > 0, 2 * hits / (2 * hits + errors)).otherwise(0.0)


def f1_micro(decisions: DataFrame) -> DataFrame:
    return decisions.agg(_f1().alias("f1_micro"))


def f1_macro(decisions: DataFrame) -> DataFrame:
    return (
        decisions.groupBy("label_id").agg(_f1().alias("f1")).agg(F.avg("f1").alias("f1_macro"))
    )


def ranked(scores: DataFrame) -> DataFrame:
    """Add ``rank`` within each instance: by score, ties by label id."""
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), "label_id")
    return scores.withColumn("rank", F.row_number().over(order))


def _require_positive(k: int) -> None:
    require("k", k, "1 or more", k >= 1)


def _whole(value: Column) -> Column:
    """``value`` if all instances have as many labels; else an error. Costs no pass: it compares
    the smallest and the largest ``n_labels`` of rows that are added up anyway."""
    uneven = F.coalesce(F.min("n_labels") != F.max("n_labels"), F.lit(False))
    error = F.raise_error(F.lit("instances differ in their number of label rows"))
    return F.when(uneven, error.cast("double")).otherwise(value)


def _per_instance(scores: DataFrame, k: int) -> DataFrame:
    """Hits among the first k, true labels, labels and DCG. Reuses the ranking's shuffle."""
    hit = (F.col("rank") <= k) & (F.col("y") == 1)
    gain = F.when(hit, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return (
        ranked(scores)
        .groupBy("instance_id")
        .agg(
            F.count_if(hit).alias("hits"),
            F.count_if(F.col("y") == 1).alias("n_true"),
            F.count("*").alias("n_labels"),
            F.sum(gain).alias("dcg"),
        )
    )


def precision_at_k(scores: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Mean share of true labels among the first min(k, number of labels)."""
    _require_positive(k)
    share = F.col("hits") / F.least(F.lit(k), F.col("n_labels"))
    return _per_instance(scores, k).agg(_whole(F.avg(share)).alias("precision_at_k"))


def recall_at_k(scores: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Mean share of the true labels found among the first k; 1 where there is none."""
    _require_positive(k)
    share = F.when(F.col("n_true") > 0, F.col("hits") / F.col("n_true")).otherwise(1.0)
    return _per_instance(scores, k).agg(_whole(F.avg(share)).alias("recall_at_k"))


def ndcg_at_k(scores: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Mean discounted gain relative to the best order; 1 where there is no true label."""
    require("k", k, "0 or more", k >= 0)
    depth = F.least(F.col("n_true"), F.lit(k), F.col("n_labels")).cast("int")
    best = F.aggregate(
        F.sequence(F.lit(1), depth), F.lit(0.0), lambda total, at: total + 1.0 / F.log2(at + 1)
    )
    ndcg = (
        F.when(F.col("n_true") == 0, 1.0)
        .when(depth > 0, F.col("dcg") / best)
        .otherwise(0.0)
    )
    return _per_instance(scores, k).agg(_whole(F.avg(ndcg)).alias("ndcg_at_k"))


def evaluate(decisions: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """One row with the six figures of a trained model.

    ``decisions`` holds ``score`` and ``predicted``. One ranking and one grouping by
    instance give the four per-instance figures; the label-wise F1 needs its own grouping.
    """
    _require_positive(k)
    hit = (F.col("rank") <= k) & (F.col("y") == 1)
    right = F.col("y") == F.col("predicted")
    rows = ranked(decisions).groupBy("instance_id").agg(
        F.count_if(hit).alias("hits"),
        F.count_if(F.col("y") == 1).alias("n_true"),
        F.count("*").alias("n_labels"),
        F.count_if(~right).alias("wrong"),
        F.count_if((F.col("y") == 1) & (F.col("predicted") == 1)).alias("both"),
    )
    wrong, both = F.sum("wrong"), F.sum("both")
    return rows.agg(
        _whole(F.avg((F.col("wrong") == 0).cast("double"))).alias("subset_accuracy"),
        (wrong / F.sum("n_labels")).alias("hamming_loss"),
        F.when(2 * both + wrong > 0, 2 * both / (2 * both + wrong)).otherwise(0.0).alias("f1_micro"),
        F.avg(F.col("hits") / F.least(F.lit(k), F.col("n_labels"))).alias(f"precision_at_{k}"),
        F.avg(F.when(F.col("n_true") > 0, F.col("hits") / F.col("n_true")).otherwise(1.0)).alias(
            f"recall_at_{k}"
        ),
    ).withColumn("f1_macro", f1_macro(decisions).scalar())
