"""Every query by name: (spark, sf_dir) -> DataFrame, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.operators import (
    association, binary_relevance, cleaning, contracts, dense, labelsets, metrics, mlknn,
    neighbours, pair_split, ranking, similarity, split, textprofile, tfidf, traffic,
)
from labelspark.plans import inputs, prediction, profile, training
from labelspark.session import materialize, new_path
from labelspark.sources import artifacts, reports, runs, tables
from labelspark.streaming import prediction as scoring
from labelspark.streaming import traffic as live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The reference windows are 1 minute and 10 seconds; the events come every few minutes, so
# the registered queries look at hours.
WINDOW = "1 hour"
SLIDE = "10 minutes"

DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), DIGITS) for n in names})


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


# Cleaning and contracts


@query
def clean_parse_labels(spark, sf_dir):
    parsed = cleaning.parse_labels(inputs.raw_documents(spark, sf_dir))
    return parsed.select("instance_id", joined("parsed_ids").alias("parsed_ids"))


def _known(spark, sf_dir):
    return cleaning.keep_known_labels(
        cleaning.parse_labels(inputs.raw_documents(spark, sf_dir)),
        inputs.document_catalogue(spark),
    )


@query
def clean_valid_labels(spark, sf_dir):
    return _known(spark, sf_dir).select("instance_id", joined("known_ids").alias("known_ids"))


@query
def clean_rows(spark, sf_dir):
    rows = cleaning.clean(inputs.raw_documents(spark, sf_dir), inputs.document_catalogue(spark))
    return rows.select(
        "instance_id", "title", F.length("overview").cast("bigint").alias("n_chars"),
        joined("genre_ids").alias("genre_ids"),
    )


@query
def clean_counts(spark, sf_dir):
    return cleaning.clean_counts(
        inputs.raw_documents(spark, sf_dir), inputs.document_catalogue(spark)
    )


@query
def dedup_exact(spark, sf_dir):
    kept = cleaning.dedup_exact(inputs.documents(spark, sf_dir))
    return kept.select("instance_id", "title", F.md5("overview").alias("digest"))


@query
def contract_instances(spark, sf_dir):
    rows = _known(spark, sf_dir).drop("genre_ids").withColumnRenamed("known_ids", "genre_ids")
    return contracts.check_instances(rows).select(
        "instance_id", joined("genre_ids").alias("genre_ids"),
        F.col("is_valid").cast("int").alias("is_valid"),
    )


@query
def contract_catalogue(spark, sf_dir):
    return contracts.check_catalogue(inputs.basket_catalogue(spark, sf_dir)).select(
        F.col("id").cast("bigint").alias("id"), "name", F.col("is_valid").cast("int").alias("is_valid")
    )


@query
def contract_requests(spark, sf_dir):
    return contracts.check_requests(inputs.documents(spark, sf_dir)).select(
        "instance_id",
        F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason"),
        F.coalesce(F.length("clean_text"), F.lit(0)).cast("bigint").alias("clean_chars"),
    )


# Profile of texts and label sets


@query
def table_counts(spark, sf_dir):
    return textprofile.table_counts(
        inputs.documents(spark, sf_dir), inputs.document_catalogue(spark)
    )


@query
def text_length_stats(spark, sf_dir):
    return rounded(
        textprofile.text_length_stats(inputs.documents(spark, sf_dir)),
        "avg_chars", "median_chars", "p95_chars",
    )


def _basket_sets(spark, sf_dir):
    return labelsets.label_sets_of_incidence(inputs.baskets(spark, sf_dir))


def _document_sets(spark, sf_dir):
    return labelsets.label_sets(inputs.labelled_documents(spark, sf_dir))


def _stored(sets):
    """Label sets that several parts of one query read."""
    return materialize(sets, "label-sets")


def _basket_distribution(spark, sf_dir):
    return labelsets.label_distribution_of_incidence(
        inputs.baskets(spark, sf_dir), inputs.basket_catalogue(spark, sf_dir)
    )


@query
def label_density(spark, sf_dir):
    return rounded(labelsets.label_density(_basket_sets(spark, sf_dir)), "label_density")


@query
def label_combinations(spark, sf_dir):
    rows = labelsets.label_combinations(_basket_sets(spark, sf_dir))
    return rows.select(
        joined("label_ids").alias("label_ids"), joined("copies").alias("copies"), "n_instances"
    )


@query
def label_cardinality(spark, sf_dir):
    return labelsets.label_cardinality(_basket_sets(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    return rounded(_basket_distribution(spark, sf_dir), "support")


@query
def label_distribution_documents(spark, sf_dir):
    rows = labelsets.label_distribution(
        _document_sets(spark, sf_dir), inputs.document_catalogue(spark)
    )
    return rounded(rows, "support")


@query
def label_gini(spark, sf_dir):
    rows = labelsets.label_imbalance(_basket_distribution(spark, sf_dir))
    return rounded(rows.select("gini"), "gini")


@query
def label_head_tail(spark, sf_dir):
    rows = labelsets.label_imbalance(_basket_distribution(spark, sf_dir))
    return rounded(rows.select("head_ratio", "tail_labels", "label_instances"), "head_ratio")


@query
def label_cooccurrence(spark, sf_dir):
    return labelsets.top_cooccurrence(
        _basket_sets(spark, sf_dir), inputs.basket_catalogue(spark, sf_dir)
    )


@query
def label_cooccurrence_all(spark, sf_dir):
    return labelsets.label_cooccurrence(_basket_sets(spark, sf_dir))


@query
def label_nmi(spark, sf_dir):
    pairs = association.pair_tables(
        _stored(_basket_sets(spark, sf_dir)), inputs.basket_catalogue(spark, sf_dir)
    )
    return rounded(association.label_nmi(pairs), "nmi")


@query
def label_nmi_top(spark, sf_dir):
    pairs = association.pair_tables(
        _stored(_document_sets(spark, sf_dir)), inputs.document_catalogue(spark)
    )
    return rounded(association.top_nmi(pairs), "nmi")


@query
def label_phi(spark, sf_dir):
    pairs = association.pair_tables(
        _stored(_basket_sets(spark, sf_dir)), inputs.basket_catalogue(spark, sf_dir)
    )
    return rounded(association.label_phi(pairs), "phi", "phi_signed")


@query
def label_phi_documents(spark, sf_dir):
    pairs = association.pair_tables(
        _stored(_document_sets(spark, sf_dir)), inputs.document_catalogue(spark)
    )
    return rounded(association.label_phi(pairs), "phi", "phi_signed")


@query
def near_duplicates(spark, sf_dir):
    return rounded(similarity.near_duplicates(inputs.documents(spark, sf_dir)), "similarity")


@query
def near_duplicates_by_bands(spark, sf_dir):
    """Pairs proposed by hyperplane bands against the exact ones: per threshold how many there
    are, how many proposed rows are wrong, and whether nine in ten are found."""
    docs = inputs.documents(spark, sf_dir)
    keys = ["instance_a", "instance_b"]
    exact = similarity.near_duplicates(docs).select(*keys, F.col("similarity").alias("s"), F.col("n_pairs").alias("n"))
    found = similarity.near_duplicates(docs, exact=False)
    both = materialize(exact.join(found, keys, "full"), "bands-and-exact")
    wrong = F.col("s").isNull() | (F.abs(F.col("s") - F.col("similarity")) > 1e-8) | (F.col("n") != F.col("n_pairs"))
    marked = both.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.9, 0.95, 1.0)))))
    held = F.col("s") >= F.col("threshold")
    return marked.groupBy("threshold").agg(
        F.count_if(held).alias("n_exact"),
        F.count_if(wrong & F.col("similarity").isNotNull()).alias("n_wrong"),
        (F.count_if(held & F.col("similarity").isNotNull()) >= 0.9 * F.count_if(held)).alias("enough"),
    )


@query
def near_duplicate_members(spark, sf_dir):
    return similarity.near_duplicate_members(inputs.documents(spark, sf_dir))


@query
def anomaly_counts(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return (
        cleaning.duplicate_count(docs)
        .withColumn("short_texts", textprofile.short_texts(docs).scalar())
        .withColumn("over_labelled", labelsets.over_labelled(_basket_sets(spark, sf_dir)).scalar())
    )


@query
def profile_warnings(spark, sf_dir):
    docs = inputs.labelled_documents(spark, sf_dir)
    sets = materialize(labelsets.label_sets(docs), "label-sets")
    near = materialize(similarity.near_duplicates(docs), "near-pairs")
    row = profile.figures(docs, sets, inputs.document_catalogue(spark), near)
    return profile.profile_warnings(row)


@query
def profile_report(spark, sf_dir):
    return profile.profile_report(
        inputs.labelled_documents(spark, sf_dir), inputs.document_catalogue(spark)
    )


@query
def profile_report_rows(spark, sf_dir):
    """The nested report as (section, position, name, value), each list in its order."""
    report = profile.profile_report(
        inputs.labelled_documents(spark, sf_dir), inputs.document_catalogue(spark)
    )

    def listed(section, column, name, value):
        rows = report.select(F.posexplode(column).alias("at", "r"))
        return rows.select(
            F.lit(section).alias("section"), (F.col("at") + 1).alias("position"),
            F.expr(name).alias("name"), F.round(F.expr(value).cast("double"), 6).alias("value"),
        )

    single = [
        "n_instances", "n_labels", "label_density", "label_cardinality", "max_labels_per_instance",
        "text_stats.avg_chars", "text_stats.median_chars", "text_stats.p95_chars", "imbalance.gini",
        "imbalance.head_ratio", "imbalance.tail_labels", "anomalies.duplicates",
        "anomalies.short_texts", "anomalies.over_labelled", "anomalies.near_duplicate_pairs",
    ]
    figures = F.array(*[
        F.struct(F.lit(c.split(".")[-1]).alias("name"), F.col(c).cast("double").alias("value"))
        for c in single
    ])
    rows = report.select(F.inline(figures)).select(
        F.lit("figure").alias("section"), F.lit(0).alias("position"), "name",
        F.round("value", 6).alias("value"),
    )
    pair = "concat(r.name_a, '/', r.name_b)"
    for part in (
        listed("label", "label_distribution", "r.label_name", "r.count"),
        listed("support", "label_distribution", "r.label_name", "r.support"),
        listed("co_occurrence", "top_co_occurrences", pair, "r.count"),
        listed("mutual_info", "top_mutual_info", pair, "r.nmi"),
        listed("warning", "warnings", "r", "length(r)"),
    ):
        rows = rows.unionAll(part)
    return rows


@query
def label_count_histogram(spark, sf_dir):
    return labelsets.label_count_histogram(_basket_sets(spark, sf_dir))


@query
def cooccurrence_matrix(spark, sf_dir):
    return labelsets.cooccurrence_matrix(
        _stored(_basket_sets(spark, sf_dir)), _basket_distribution(spark, sf_dir)
    )


@query
def label_matrix(spark, sf_dir):
    docs = inputs.labelled_documents(spark, sf_dir)
    return labelsets.label_matrix(
        docs, labelsets.label_sets(docs), inputs.document_catalogue(spark)
    )


@query
def label_matrix_density(spark, sf_dir):
    rows = labelsets.label_matrix_density(_basket_sets(spark, sf_dir))
    return rounded(rows, "density", "labels_per_instance")


# Text and TF-IDF


def _token_table(spark, sf_dir, stop_words):
    settings = tfidf.TextProfile((1, 1), 1, fold_accents=True, stop_words=stop_words)
    return tfidf.corpus_counts(inputs.documents(spark, sf_dir), settings).select(
        F.col("term").alias("token"), F.col("cf").alias("n"), F.col("df").alias("n_instances")
    )


@query
def tokens(spark, sf_dir):
    return _token_table(spark, sf_dir, ())


@query
def tokens_no_stop(spark, sf_dir):
    return _token_table(spark, sf_dir, tfidf.ENGLISH)


@query
def ngrams(spark, sf_dir):
    return tfidf.gram_lists(inputs.documents(spark, sf_dir), tfidf.NEAR_DUPLICATES).select(
        "instance_id", F.size("grams").cast("bigint").alias("n_grams"),
        F.size(F.array_distinct("grams")).cast("bigint").alias("n_distinct"),
        F.array_min("grams").alias("first_gram"), F.array_max("grams").alias("last_gram"),
    ).filter("n_grams > 0")


@query
def vocabulary(spark, sf_dir):
    rows = tfidf.fit_vocabulary(inputs.documents(spark, sf_dir), tfidf.FEATURES)
    return rounded(rows.select("term", "df", "cf", "idf"), "idf")


@query
def tfidf_weights(spark, sf_dir):
    docs = tfidf.tokenized(inputs.documents(spark, sf_dir), tfidf.FEATURES)
    words = materialize(tfidf.fit_vocabulary(docs, tfidf.FEATURES), "vocabulary")
    rows = tfidf.weights(docs, words, tfidf.FEATURES)
    return rounded(rows.select("instance_id", "term", "weight"), "weight")


def _prepared(spark, sf_dir):
    return training.prepare(
        inputs.labelled_documents(spark, sf_dir), inputs.document_catalogue(spark)
    )


@query
def tfidf_unseen(spark, sf_dir):
    rows = _prepared(spark, sf_dir).validation_weights
    return rounded(rows.select("instance_id", "term", "weight"), "weight")


@query
def feature_shape(spark, sf_dir):
    return training.feature_shape(_prepared(spark, sf_dir))


# Split and models


@query
def pair_split_shares(spark, sf_dir):
    """Every label and label pair of the split by pairs: how many rows, and whether its share of
    validation rows is within one row of the target."""
    docs = inputs.labelled_documents(spark, sf_dir)
    parts = _stored(pair_split.second_order_split(docs, training.TEST_SIZE))
    off = F.abs(F.col("n_validation") - F.lit(training.TEST_SIZE) * F.col("n"))
    return pair_split.pair_shares(docs, parts).select(
        F.col("a").alias("label_a"), F.col("b").alias("label_b"), "n", (off <= 1 + 1e-9).alias("within_one")
    )


@query
def stratified_split(spark, sf_dir):
    rows = split.stratified_split(inputs.labelled_documents(spark, sf_dir))
    return rows.withColumn("is_validation", F.col("is_validation").cast("int"))


@query
def br_scores(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    model = training.train_binary_relevance(prepared)
    return training.score_weights(
        model, prepared.validation.select("instance_id"), prepared.validation_weights
    )


# Largest slope of the penalised loss that counts as the optimum, per training row. The solver
# stops on relative changes of the mean loss, so it ends near the optimum, not on it: slopes of
# up to 0.0005 per row were measured at the default tolerance.
GRADIENT_BOUND = 0.001
# Largest slope left by the fit of all labels at once.
JOINT_BOUND = 1e-4


@query
def br_optimum(spark, sf_dir):
    """Per label with two classes: whether the fit is at the optimum of its penalised loss."""
    prepared = _prepared(spark, sf_dir)
    model = training.train_binary_relevance(prepared)
    n_train = prepared.train.count()
    slopes = binary_relevance.gradients(
        prepared.train, prepared.train_weights, model.tables["label_models"],
        model.tables["coefficients"],
    )
    return slopes.select(
        "label_id", (F.col("largest") <= GRADIENT_BOUND * n_train).cast("int").alias("at_optimum")
    )


@query
def br_joint_optimum(spark, sf_dir):
    """As ``br_optimum`` for the fit of all labels at once, at a bound that does not grow with
    the rows: weights are at most this far from the optimum."""
    prepared = _prepared(spark, sf_dir)
    model = training.train_binary_relevance(prepared, together=True)
    slopes = binary_relevance.gradients(
        prepared.train, prepared.train_weights, model.tables["label_models"],
        model.tables["coefficients"],
    )
    return slopes.select(
        "label_id", (F.col("largest") <= JOINT_BOUND).cast("int").alias("at_optimum")
    )


@query
def mlknn_figures(spark, sf_dir):
    """The six figures of a trained ML-kNN on the validation rows."""
    prepared = _prepared(spark, sf_dir)
    priors, conditionals = _conditionals(prepared)
    near = materialize(_neighbours(prepared, of_train=False), "neighbours")
    scored = mlknn.posterior(
        prepared.validation.select("instance_id"), near, prepared.train, priors,
        materialize(conditionals, "conditionals"),
    )
    truth = training.with_truth(materialize(scored, "scores"), prepared.validation)
    return rounded(metrics.evaluate(truth), *training.METRIC_ORDER)


@query
def br_stored_model(spark, sf_dir):
    """A stored and reloaded binary-relevance model: its facts and the size of its answers."""
    prepared = _prepared(spark, sf_dir)
    path = new_path(spark, "model")
    artifacts.save(training.train_binary_relevance(prepared), path)
    model = artifacts.load(spark, path)
    answers = prediction.score_texts(model, prepared.validation)
    return prediction.model_facts(model).withColumns({
        "n_scores": answers.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "n_texts": prepared.validation.agg(F.count(F.lit(1)).alias("n")).scalar(),
    })


@query
def hard_decision(spark, sf_dir):
    return metrics.decide(inputs.scores(spark, sf_dir)).select(
        "instance_id", "label_id", "predicted"
    )


@query
def one_class_scores(spark, sf_dir):
    labels = inputs.document_catalogue(spark).select(F.col("id").cast("bigint").alias("label_id"))
    rows = binary_relevance.one_class_scores(inputs.labelled_documents(spark, sf_dir), labels)
    return rows.withColumn("is_constant", F.col("is_constant").cast("int"))


def _neighbours(prepared, of_train: bool, probes: int | None = None):
    part = prepared.train if of_train else prepared.validation
    weights = prepared.train_weights if of_train else prepared.validation_weights
    return neighbours.nearest_neighbours(
        part.select("instance_id"), weights,
        prepared.train.select("instance_id"), prepared.train_weights, training.N_NEIGHBOURS, probes,
    )


@query
def mlknn_neighbours(spark, sf_dir):
    return rounded(_neighbours(_prepared(spark, sf_dir), of_train=False), "distance2")


@query
def mlknn_train_neighbours(spark, sf_dir):
    return rounded(_neighbours(_prepared(spark, sf_dir), of_train=True), "distance2")


@query
def mlknn_neighbours_by_lists(spark, sf_dir):
    """Neighbours found in the lists nearest to each query, against the exact ones: how many
    there are, how many are nearer than is possible, and whether nine in ten are as near."""
    prepared = _prepared(spark, sf_dir)
    exact = _stored(_neighbours(prepared, of_train=False))
    found = _stored(_neighbours(prepared, of_train=False, probes=neighbours.PROBES))
    ranked = exact.select("instance_id", "rank", F.col("distance2").alias("nearest"))
    last = exact.groupBy("instance_id").agg(F.max("distance2").alias("last"))
    return ranked.join(found, ["instance_id", "rank"], "left").join(last, "instance_id").agg(
        F.count("*").alias("n_neighbours"),
        F.count_if(F.col("distance2") < F.col("nearest") - 1e-9).alias("n_too_near"),
        (F.count_if(F.col("distance2") <= F.col("last") + 1e-9) >= 0.9 * F.count("*")).alias("enough"),
    )


@query
def embedding_neighbours(spark, sf_dir):
    """Neighbours of every fiftieth dense vector among all of them."""
    rows = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    found = dense.nearest_dense(rows.filter("id % 50 = 0"), rows, training.N_NEIGHBOURS)
    return rounded(found, "distance2")


@query
def mlknn_priors(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    rows = mlknn.priors(prepared.train, prepared.labels)
    return rounded(rows.select("label_id", "prior"), "prior")


def _conditionals(prepared):
    own = materialize(_neighbours(prepared, of_train=True), "train-neighbours")
    priors = mlknn.priors(prepared.train, prepared.labels)
    return priors, mlknn.conditionals(own, prepared.train, priors, training.N_NEIGHBOURS)


@query
def mlknn_conditionals(spark, sf_dir):
    return rounded(_conditionals(_prepared(spark, sf_dir))[1], "cond1", "cond0")


@query
def mlknn_posterior(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    priors, conditionals = _conditionals(prepared)
    near = materialize(_neighbours(prepared, of_train=False), "neighbours")
    rows = mlknn.posterior(
        prepared.validation.select("instance_id"), near, prepared.train, priors,
        materialize(conditionals, "conditionals"),
    )
    return rounded(rows, "score")


@query
def train_all_models(spark, sf_dir):
    return training.compare_models(
        training.train_all(
            inputs.labelled_documents(spark, sf_dir), inputs.document_catalogue(spark),
            new_path(spark, "artifacts"), complete=True,
        )
    )


@query
def model_comparison(spark, sf_dir):
    path = new_path(spark, "runs")
    scored = inputs.scores(spark, sf_dir)
    mirrored = scored.withColumn("score", 1 - F.col("score"))
    for name, rows in zip(training.MODELS, (scored, mirrored)):
        figures = metrics.evaluate(metrics.decide(rows)).first().asDict()
        runs.append(spark, path, uuid.uuid4().hex, name, "metric", figures)
    rows = training.compare_models(runs.read(spark, path))
    return rounded(rows, *training.MODELS, "best_value")


# Evaluation


@query
def hamming_loss(spark, sf_dir):
    return rounded(
        metrics.hamming_loss(metrics.decide(inputs.scores(spark, sf_dir))), "hamming_loss"
    )


@query
def subset_accuracy(spark, sf_dir):
    return rounded(
        metrics.subset_accuracy(metrics.decide(inputs.scores(spark, sf_dir))), "subset_accuracy"
    )


@query
def f1_micro(spark, sf_dir):
    return rounded(metrics.f1_micro(metrics.decide(inputs.scores(spark, sf_dir))), "f1_micro")


@query
def f1_macro(spark, sf_dir):
    return rounded(metrics.f1_macro(metrics.decide(inputs.scores(spark, sf_dir))), "f1_macro")


@query
def precision_at_k(spark, sf_dir):
    return rounded(metrics.precision_at_k(inputs.scores(spark, sf_dir)), "precision_at_k")


@query
def recall_at_k(spark, sf_dir):
    return rounded(metrics.recall_at_k(inputs.scores(spark, sf_dir)), "recall_at_k")


@query
def ndcg_at_k(spark, sf_dir):
    return rounded(metrics.ndcg_at_k(inputs.scores(spark, sf_dir)), "ndcg_at_k")


# Prediction


def _joined_scores(column: str):
    return F.array_join(
        F.transform(column, lambda s: F.format_string("%.3f", s)), ","
    )


@query
def predict_topk(spark, sf_dir):
    rows = ranking.predict_topk(inputs.scores(spark, sf_dir))
    return rows.select(
        "instance_id", joined("labels").alias("labels"),
        _joined_scores("confidences").alias("confidences"),
    )


@query
def predict_response(spark, sf_dir):
    rows = ranking.predict_response(inputs.scores(spark, sf_dir))
    return rows.select(
        "instance_id", joined("predicted_labels").alias("predicted_labels"),
        _joined_scores("confidence_scores").alias("confidence_scores"),
    )


@query
def label_confidence(spark, sf_dir):
    rows = ranking.label_confidence(
        inputs.scores(spark, sf_dir), inputs.document_catalogue(spark), "toxic"
    )
    return rounded(rows, "confidence")


@query
def predict_batch(spark, sf_dir):
    """A stored and reloaded ML-kNN model answers the validation texts."""
    prepared = _prepared(spark, sf_dir)
    path = new_path(spark, "model")
    artifacts.save(training.train_ml_knn(prepared), path)
    rows = prediction.predict_batch(artifacts.load(spark, path), prepared.validation)
    return rows.select(
        "instance_id", joined("labels").alias("labels"),
        F.size("confidences").alias("n_labels"),
    )


@query
def prediction_log_records(spark, sf_dir):
    """Responses appended to the prediction log and read back."""
    path = new_path(spark, "prediction-log")
    responses = ranking.predict_response(inputs.scores(spark, sf_dir)).withColumns(
        {"model_type": F.lit("binary_relevance"), "inference_time_sec": F.lit(0.02)}
    )
    runs.log_predictions(responses, path)
    return (
        spark.read.parquet(path)
        .groupBy("model_type", F.size("labels").cast("bigint").alias("n_labels"))
        .agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms"))
    )


# Sources and sinks


@query
def source_instances_csv(spark, sf_dir):
    path = new_path(spark, "instances-csv")
    raw = inputs.raw_documents(spark, sf_dir)
    raw.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = tables.with_instance_id(tables.read_instances(spark, path))
    parsed = cleaning.parse_labels(rows)
    return parsed.select(
        "instance_id", "title", F.md5("overview").alias("digest"),
        joined("parsed_ids").alias("parsed_ids"),
    )


@query
def source_catalogue_csv(spark, sf_dir):
    path = new_path(spark, "catalogue-csv")
    inputs.basket_catalogue(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_catalogue(spark, path).select("id", "name")


@query
def report_json(spark, sf_dir):
    path = new_path(spark, "report")
    row = labelsets.label_imbalance(_basket_distribution(spark, sf_dir)).select(
        F.struct("gini", "head_ratio", "tail_labels").alias("imbalance"), "label_instances"
    )
    reports.write_report(row, path)
    back = reports.read_report(spark, path).select("imbalance.*", "label_instances")
    return rounded(back, "gini", "head_ratio")


# Prediction traffic


@query
def request_count(spark, sf_dir):
    return traffic.request_count(inputs.log(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    return rounded(traffic.latency_histogram(inputs.log(spark, sf_dir)), "sum")


@query
def inference_histogram(spark, sf_dir):
    return rounded(traffic.inference_histogram(inputs.log(spark, sf_dir)), "sum")


@query
def confidence_histogram(spark, sf_dir):
    seen = ranking.confidence_observations(inputs.scores(spark, sf_dir)).select(
        F.lit("transformation").alias("model_type"), F.col("name").alias("genre"),
        F.col("score").alias("confidence"),
    )
    return rounded(traffic.confidence_histogram(seen), "sum")


@query
def prediction_volume(spark, sf_dir):
    return traffic.prediction_volume(inputs.log(spark, sf_dir))


@query
def request_rate(spark, sf_dir):
    return traffic.request_rate(inputs.log(spark, sf_dir), WINDOW, SLIDE).withColumn(
        "rate", F.round("rate", 9)
    )


@query
def volume_rate(spark, sf_dir):
    return traffic.volume_rate(inputs.log(spark, sf_dir), WINDOW, SLIDE).withColumn(
        "rate", F.round("rate", 9)
    )


@query
def mean_inference_time(spark, sf_dir):
    rows = traffic.mean_inference_time(inputs.log(spark, sf_dir), WINDOW, SLIDE)
    return rows.withColumn("mean_sec", F.round("mean_sec", 12))


@query
def request_rate_minute(spark, sf_dir):
    return traffic.request_rate(inputs.log(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query
def volume_rate_minute(spark, sf_dir):
    return traffic.volume_rate(inputs.log(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query
def mean_inference_time_minute(spark, sf_dir):
    rows = traffic.mean_inference_time(inputs.log(spark, sf_dir))
    return rows.withColumn("mean_sec", F.round("mean_sec", 12))


@query
def mean_confidence(spark, sf_dir):
    return rounded(traffic.mean_confidence(inputs.log(spark, sf_dir)), "mean_confidence")


@query
def metrics_snapshot(spark, sf_dir):
    return _series_rows(traffic.metrics_snapshot(inputs.log(spark, sf_dir)))


def _series_rows(rows):
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return rounded(
        rows.select("metric", F.array_join(pairs, ",").alias("labels"),
                    F.coalesce("le", F.lit("")).alias("le"), "value"),
        "value",
    )


def _streamed(spark, sf_dir, build, keys):
    """Run an aggregate over the events as a stream until all is read; its final rows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = live.read_log(spark, sf_dir, schema, pattern="events.parquet")
    out = new_path(spark, "stream-out")
    running = live.run(
        build(inputs.prediction_log(events)), out, new_path(spark, "stream-state")
    )
    running.awaitTermination()
    return live.latest(spark, out, keys)


@query
def stream_predictions(spark, sf_dir):
    """The documents as a stream of requests, answered and logged; the log, read as a stream too,
    as counts of requests."""
    model = training.train_binary_relevance(_prepared(spark, sf_dir), together=True)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    texts = live.read_log(spark, sf_dir, schema, pattern="documents.parquet").select(
        F.col("doc_id").alias("instance_id"), F.col("text").alias("overview")
    )
    log, out = new_path(spark, "prediction-log"), new_path(spark, "stream-out")
    scoring.score_stream(model, texts, log, new_path(spark, "stream-state")).awaitTermination()
    counts = traffic.request_count(scoring.requests(scoring.read_log(spark, log)))
    live.run(counts, out, new_path(spark, "stream-state")).awaitTermination()
    return live.latest(spark, out, ["method", "endpoint", "status"], counts.schema)


@query
def stream_request_count(spark, sf_dir):
    return _streamed(
        spark, sf_dir, traffic.request_count, ["method", "endpoint", "status"]
    )


@query
def stream_latency_histogram(spark, sf_dir):
    return rounded(
        _streamed(spark, sf_dir, traffic.latency_histogram, ["endpoint", "le"]), "sum"
    )


@query
def stream_request_rate(spark, sf_dir):
    rows = _streamed(
        spark, sf_dir, lambda log: live.request_rate(log, WINDOW, SLIDE),
        ["window_start", "method", "endpoint", "status"],
    )
    return rows.select(
        "window_start", "method", "endpoint", "status",
        F.round(F.col("n") / 3600.0, 9).alias("rate"),
    )


@query
def stream_mean_inference_time(spark, sf_dir):
    rows = _streamed(
        spark, sf_dir, lambda log: live.mean_inference_time(log, WINDOW, SLIDE),
        ["window_start", "model_type"],
    )
    return rows.select("window_start", "model_type", F.round("mean_sec", 12).alias("mean_sec"))


@query
def stream_inference_histogram(spark, sf_dir):
    return rounded(
        _streamed(spark, sf_dir, traffic.inference_histogram, ["model_type", "le"]), "sum"
    )


@query
def stream_prediction_volume(spark, sf_dir):
    return _streamed(spark, sf_dir, traffic.prediction_volume, ["model_type"])


@query
def stream_volume_rate(spark, sf_dir):
    rows = _streamed(
        spark, sf_dir, lambda log: live.volume_rate(log, WINDOW, SLIDE),
        ["window_start", "model_type"],
    )
    return rows.select(
        "window_start", "model_type", F.round(F.col("n") / 3600.0, 9).alias("rate")
    )


@query
def stream_mean_confidence(spark, sf_dir):
    return rounded(_streamed(spark, sf_dir, traffic.mean_confidence, []), "mean_confidence")


@query
def stream_metrics_snapshot(spark, sf_dir):
    """Every series from running streams: five aggregates, put together when asked for."""
    parts = [
        _streamed(spark, sf_dir, build, keys) for build, keys in traffic.SNAPSHOT_PARTS
    ]
    return _series_rows(traffic.snapshot_of(*parts))


@query
def stream_current_snapshot(spark, sf_dir):
    """As ``stream_metrics_snapshot``, from streams that keep their present result only."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    parts = []
    for build, keys in traffic.SNAPSHOT_PARTS:
        events = live.read_log(spark, sf_dir, schema, pattern="events.parquet")
        running, out = build(inputs.prediction_log(events)), new_path(spark, "stream-current")
        live.run_current(running, out, new_path(spark, "stream-state"), keys).awaitTermination()
        parts.append(live.current(spark, out, running.schema))
    return _series_rows(traffic.snapshot_of(*parts))
