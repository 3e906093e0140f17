"""Statistics of label sets.

Everything here is computed from one small table, the *label sets*: each distinct
combination of labels with the number of instances that carry it,

    label_ids ARRAY<BIGINT> (sorted, distinct), copies ARRAY<BIGINT>, n BIGINT

``copies[i]`` is how often ``label_ids[i]`` occurs in one such instance. Instances are
combined before they are shuffled, and later steps work on combinations, not instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE = "*"

# Fixed values of the profile.
HEAD_LABELS = 3
TAIL_SUPPORT_PERCENT = 1.0
TOP_PAIRS = 10
MATRIX_LABELS = 15
MAX_LABELS = 7


def label_sets(instances: DataFrame) -> DataFrame:
    """Label sets of rows with an array column ``genre_ids``."""
    return (
        instances.select(F.array_sort(F.col("genre_ids").cast("array<bigint>")).alias("all_ids"))
        .groupBy("all_ids")
        .agg(F.count(ONE).alias("n"))
        .withColumn("label_ids", F.array_distinct("all_ids"))
        .select(
            "label_ids",
            F.transform(
                "label_ids",
                lambda i: F.size(F.filter("all_ids", lambda j: j == i)).cast("bigint"),
            ).alias("copies"),
            "n",
        )
    )


def label_sets_of_incidence(incidence: DataFrame) -> DataFrame:
    """Label sets of long rows (instance_id, label_id), repeats included.

    Repeats are counted first, so that even an instance with very many rows is collected
    as at most one element per label.
    """
    return (
        incidence.groupBy("instance_id", F.col("label_id").cast("bigint").alias("label_id"))
        .agg(F.count(ONE).alias("copies"))
        .groupBy("instance_id")
        .agg(F.array_sort(F.collect_list(F.struct("label_id", "copies"))).alias("labels"))
        .groupBy("labels")
        .agg(F.count(ONE).alias("n"))
        .select(
            F.col("labels.label_id").alias("label_ids"), F.col("labels.copies").alias("copies"), "n"
        )
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, x: total + x)


def instance_count(sets: DataFrame) -> DataFrame:
    return sets.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_instances"))


def label_density(sets: DataFrame) -> DataFrame:
    """One row: mean and maximum number of labels per instance, repeats counted."""
    size = _total(F.col("copies"))
    return sets.select("n", size.alias("size")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("label_density"),
        F.max("size").alias("max_labels"),
    )


def label_combinations(sets: DataFrame) -> DataFrame:
    """(label_ids, copies, n_instances): the combination -> count map."""
    return sets.select("label_ids", "copies", F.col("n").alias("n_instances"))


def label_cardinality(sets: DataFrame) -> DataFrame:
    """One row: number of distinct combinations."""
    return sets.agg(F.count(ONE).alias("label_cardinality"))


def label_counts(sets: DataFrame) -> DataFrame:
    """(label_id, count, n_with): occurrences with repeats, and instances holding the label."""
    return (
        sets.select("n", F.explode(F.arrays_zip("label_ids", "copies")).alias("l"))
        .groupBy(F.col("l.label_ids").alias("label_id"))
        .agg(F.sum(F.col("l.copies") * F.col("n")).alias("count"), F.sum("n").alias("n_with"))
    )


def label_distribution(sets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(label_id, name, count, support, position) of the used and catalogued labels.

    ``support`` is a percentage of the instances; ``position`` ranks by count, then id. The
    ranking window sees one row per label.
    """
    n_instances = instance_count(sets).scalar()
    return (
        label_counts(sets)
        .join(catalogue.select(F.col("id").cast("bigint").alias("label_id"), "name"), "label_id")
        .withColumn("n_instances", n_instances)
        .select(
            "label_id", "name", "count",
            (F.lit(100.0) * F.col("count") / F.col("n_instances")).alias("support"),
            F.row_number().over(Window.orderBy(F.desc("count"), "label_id")).alias("position"),
        )
    )


def label_distribution_of_incidence(incidence: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The same distribution straight from long rows: two aggregations, no label sets."""
    n_instances = incidence.agg(F.count_distinct("instance_id").alias("n_instances")).scalar()
    return (
        incidence.groupBy(F.col("label_id").cast("bigint").alias("label_id"))
        .agg(F.count(ONE).alias("count"))
        .join(catalogue.select(F.col("id").cast("bigint").alias("label_id"), "name"), "label_id")
        .withColumn("n_instances", n_instances)
        .select(
            "label_id", "name", "count",
            (F.lit(100.0) * F.col("count") / F.col("n_instances")).alias("support"),
            F.row_number().over(Window.orderBy(F.desc("count"), "label_id")).alias("position"),
        )
    )


def label_imbalance(distribution: DataFrame) -> DataFrame:
    """One row: Gini coefficient, share of the top three labels, rare labels, label total."""
    ranked = distribution.withColumn(
        "rank_up", F.row_number().over(Window.orderBy("count", "label_id"))
    )
    total = F.sum("count")
    labels = F.count(ONE)
    gini = 2 * F.sum(F.col("rank_up") * F.col("count")) / (labels * total) - (labels + 1) / labels
    head = F.sum(F.when(F.col("position") <= HEAD_LABELS, F.col("count")))
    return ranked.agg(
        F.when(total > 0, gini).otherwise(0.0).alias("gini"),
        F.when(total > 0, head / total).otherwise(0.0).alias("head_ratio"),
        F.count_if(F.col("support") < TAIL_SUPPORT_PERCENT).alias("tail_labels"),
        F.coalesce(total, F.lit(0).cast("bigint")).alias("label_instances"),
    )


def label_count_histogram(sets: DataFrame) -> DataFrame:
    """(n_labels, n_instances): instances per number of labels."""
    return (
        sets.groupBy(_total(F.col("copies")).alias("n_labels"))
        .agg(F.sum("n").alias("n_instances"))
        .filter(F.col("n_labels") >= 1)
    )


def over_labelled(sets: DataFrame, limit: int = MAX_LABELS) -> DataFrame:
    """One row: instances with more than ``limit`` labels."""
    many = F.when(_total(F.col("copies")) > limit, F.col("n")).otherwise(0)
    return sets.agg(F.coalesce(F.sum(many), F.lit(0)).cast("bigint").alias("over_labelled"))


def _pairs(sets: DataFrame) -> DataFrame:
    """(n, a, copies_a, b, copies_b): label pairs a <= b inside each combination.

    Built in the row, without a join. The size is bounded by the square of the label set,
    once per distinct combination.
    """
    labels = sets.select("n", F.arrays_zip("label_ids", "copies").alias("labels"))
    first = labels.select("n", "labels", F.posexplode("labels").alias("at", "one"))
    return first.select(
        "n",
        F.col("one.label_ids").alias("a"),
        F.col("one.copies").alias("copies_a"),
        F.explode(F.slice("labels", F.col("at") + 1, F.size("labels"))).alias("two"),
    ).select(
        "n", "a", "copies_a", F.col("two.label_ids").alias("b"), F.col("two.copies").alias("copies_b")
    )


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, n_both): instances that hold both labels, a < b, repeats ignored."""
    return (
        _pairs(sets).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    )


def label_cooccurrence(sets: DataFrame) -> DataFrame:
    """(a, b, count) over all 2-combinations of each instance's ids, a <= b.

    Repeats count: a label held c times next to one held d times gives c * d pairs, and
    c * (c - 1) / 2 pairs with itself.
    """
    pairs = F.when(
        F.col("a") == F.col("b"), F.expr("copies_a * (copies_a - 1) div 2")
    ).otherwise(F.col("copies_a") * F.col("copies_b"))
    return (
        _pairs(sets)
        .select("a", "b", (pairs * F.col("n")).alias("pairs"))
        .filter(F.col("pairs") > 0)
        .groupBy("a", "b")
        .agg(F.sum("pairs").alias("count"))
    )


def top_cooccurrence(sets: DataFrame, catalogue: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """The ``top`` most frequent pairs with names; ties by id."""
    names = catalogue.select(F.col("id").cast("bigint").alias("id"), "name")
    best = label_cooccurrence(sets).orderBy(F.desc("count"), "a", "b").limit(top)
    return (
        best.join(names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a", "left")
        .join(names.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b", "left")
        .select("a", "b", "name_a", "name_b", "count")
    )


def cooccurrence_matrix(
    sets: DataFrame, distribution: DataFrame, top: int = MATRIX_LABELS
) -> DataFrame:
    """(a, b, n_both) for the ``top`` labels: symmetric, the diagonal counts single labels.

    Labels are reduced to the top ones before pairs are formed; every cell is present.
    """
    chosen = distribution.filter(F.col("position") <= top).select(F.col("label_id").alias("a"))
    inside = F.array_intersect(F.col("label_ids"), F.col("chosen"))
    reduced = sets.withColumn(
        "chosen", chosen.agg(F.collect_list("a").alias("chosen")).scalar()
    ).select(inside.alias("label_ids"), "n")
    counted = (
        reduced.select("label_ids", "n", F.explode("label_ids").alias("a"))
        .select("n", "a", F.explode("label_ids").alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_both"))
    )
    cells = chosen.withColumn(
        "all_chosen", chosen.agg(F.collect_list("a").alias("chosen")).scalar()
    ).select("a", F.explode("all_chosen").alias("b"))
    return cells.join(counted, ["a", "b"], "left").select(
        "a", "b", F.coalesce("n_both", F.lit(0).cast("bigint")).alias("n_both")
    )


def observed_labels(sets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(label_id, name, column_no): observed labels by id, numbered as matrix columns.

    A label missing from the catalogue is an error.
    """
    names = catalogue.select(F.col("id").cast("bigint").alias("label_id"), "name")
    return (
        label_counts(sets)
        .join(names, "label_id", "left")
        .select(
            "label_id",
            F.coalesce(
                "name",
                F.raise_error(F.concat(F.lit("label not in the catalogue: "), F.col("label_id"))),
            ).alias("name"),
            (F.row_number().over(Window.orderBy("label_id")) - 1).alias("column_no"),
        )
    )


def label_matrix(instances: DataFrame, sets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(instance_id, label_id, name, column_no): the ones of the 0/1 label matrix."""
    held = instances.select(
        "instance_id",
        F.explode(F.array_distinct(F.col("genre_ids").cast("array<bigint>"))).alias("label_id"),
    )
    return held.join(observed_labels(sets, catalogue), "label_id").select(
        "instance_id", "label_id", "name", "column_no"
    )


def label_matrix_density(sets: DataFrame) -> DataFrame:
    """One row: share of ones in the label matrix, and distinct labels per instance."""
    labels = label_counts(sets).agg(F.count(ONE).alias("n_labels")).scalar()
    per_instance = F.sum(F.size("label_ids") * F.col("n")) / F.sum("n")
    return (
        sets.agg(per_instance.alias("labels_per_instance"))
        .withColumn("n_labels", labels)
        .select(
            (F.col("labels_per_instance") / F.col("n_labels")).alias("density"),
            "labels_per_instance",
        )
    )
