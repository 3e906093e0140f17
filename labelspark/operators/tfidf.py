"""Word n-gram TF-IDF: counts, vocabulary, weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from labelspark.functions import text as T
from labelspark.functions.stopwords import ENGLISH
from labelspark.operators import grams
from labelspark.session import materialize, spread_partitions

# Terms that the driver hands to the tasks, at most; larger vocabularies are joined.
HANDED_TERMS = 1_000_000


@dataclass(frozen=True)
class TextProfile:
    """How texts become weighted terms."""

    ngram_range: tuple[int, int]
    max_features: int
    fold_accents: bool = False
    stop_words: tuple[str, ...] = ()
    min_df: int = 1
    max_df_ratio: float = 1.0
    sublinear_tf: bool = False


# The settings of the classifiers' features and of near-duplicate detection.
FEATURES = TextProfile(
    ngram_range=(1, 2), max_features=20000, fold_accents=True, stop_words=ENGLISH,
    min_df=2, max_df_ratio=0.95, sublinear_tf=True,
)
NEAR_DUPLICATES = TextProfile(ngram_range=(2, 3), max_features=1000)


def tokens(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, tokens): normalised words in text order, stop words removed."""
    words = T.tokenize(T.normalize_text(F.col("overview"), profile.fold_accents))
    return instances.select(
        "instance_id", T.remove_stop_words(words, profile.stop_words).alias("tokens")
    )


def gram_lists(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, grams): all n-grams of an instance, with repeats."""
    grams = T.ngrams(F.col("tokens"), *profile.ngram_range)
    return tokens(instances, profile).select("instance_id", grams.alias("grams"))


def _placed(instances: DataFrame) -> DataFrame:
    texts = instances.select("instance_id", "overview")
    return texts.repartition(spread_partitions(texts), "instance_id")


def _together(rows: DataFrame) -> DataFrame:
    """(instance_id, n_rows, texts) of (instance_id, tokens), one row per instance."""
    return rows.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.collect_list("tokens").alias("texts")
    )


def _is_tokenized(instances: DataFrame) -> bool:
    return "texts" in instances.columns


def tokenized(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, n_rows, texts): the tokens of all rows of an instance, a list per text,
    written once for several passes; ``fit_vocabulary`` and ``weights`` take it for instances.

    Rows are put together by a grouping only if an id is repeated.
    """
    rows = tokens(_placed(instances), profile)
    ids = instances.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        rows = rows.select(
            "instance_id", F.lit(1).cast("bigint").alias("n_rows"),
            F.array_compact(F.array("tokens")).alias("texts"),
        )
    else:
        rows = _together(rows)
    return materialize(rows, "tokens")


def terms(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, term): one row per n-gram occurrence.

    Texts are placed by ``instance_id`` first, over tasks enough for the n-grams made of them;
    whatever groups by instance afterwards moves nothing more. In front of a plain ``explode``
    Spark puts a filter that repeats the whole n-gram expression, hence the outer form.
    """
    if _is_tokenized(instances):
        each = F.transform("texts", lambda words: T.ngrams(words, *profile.ngram_range))
        lists = instances.select("instance_id", F.flatten(each).alias("grams"))
    else:
        lists = gram_lists(_placed(instances), profile)
    return (
        lists
        .select("instance_id", F.explode_outer("grams").alias("term"))
        .filter(F.col("term").isNotNull())
    )


def term_counts(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, term, tf), counted where the texts are placed."""
    return (
        terms(instances, profile)
        .groupBy("instance_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_counts(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(term, df, cf): instances that hold a term, and its occurrences, from the counts per
    instance."""
    return (
        term_counts(instances, profile)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def _cut(counted: DataFrame, order: Column, limit: int):
    """(value, n, upto): the value of ``order`` that the row at ``limit`` has, how many rows have
    it, and how many have it or come before; None if there are fewer rows."""
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted.groupBy(order.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .filter(F.col("upto") >= limit).orderBy("value").select("value", "n", "upto").first()
    )


def _first(counted: DataFrame, order: Column, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows surely among the first ``limit`` by ``order``, rows tied at the cut, how many of
    those belong to the first). Counts per value of ``order`` find the cut."""
    cut = _cut(counted, order, limit)
    if cut is None:
        return counted, counted.limit(0), 0
    value = F.lit(cut["value"])
    return (
        counted.filter(order < value), counted.filter(order == value),
        limit - (cut["upto"] - cut["n"]),
    )


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of (term, cf, ...) with the highest cf, ties by term.

    The cut is found from counts per cf, then per first letters among its ties, and only what
    is tied there too is ordered. ``counted`` is read several times: pass a written table.
    """
    sure, ties, more = _first(counted, -F.col("cf"), limit)
    early, rest, last = _first(ties, F.substring("term", 1, 4), more) if more else (ties, ties, 0)
    return sure.unionAll(early).unionAll(rest.orderBy("term").limit(last))


def _frequent_counts(tokenized_rows: DataFrame, profile: TextProfile, n_docs: int) -> DataFrame | None:
    """(term, df, cf), exact, of terms among which all of the vocabulary are, or None if that
    cannot be shown.

    Tasks summarise their n-grams in bounded memory. What no task's summary can hide reaches
    ``cut`` as surely as ``max_features`` terms do; only that is counted, as strings. The result
    holds if then ``max_features`` terms within the limits do reach ``cut``.
    """
    lo, hi = profile.ngram_range
    rows = tokenized_rows.select("instance_id", "texts")
    found = rows.mapInArrow(grams.summary(lo, hi), "hash bigint, cf bigint, df bigint, slack bigint")
    found = materialize(
        found.groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("cf", "df", "slack"))), "term-summary"
    )
    lacking = found.filter("hash IS NULL").first()
    slack = lacking["slack"] if lacking else 0
    known = found.filter("hash IS NOT NULL")
    within = known.filter(
        (F.col("df") >= profile.min_df)
        & (F.col("df") + F.lit(slack) <= F.lit(n_docs) * F.lit(float(profile.max_df_ratio)))
    )
    cut = _cut(within, -F.col("cf"), profile.max_features)
    if cut is None or -cut["value"] <= slack:
        return None
    least = -cut["value"]
    hashes = known.filter(F.col("cf") + F.lit(slack) >= least).select("hash")
    hashes = hashes.limit(HANDED_TERMS + 1).toArrow()["hash"].to_numpy()
    if len(hashes) > HANDED_TERMS:
        return None
    wanted = np.sort(hashes.view(np.uint64))
    counted = materialize(
        _within_limits(
            rows.mapInArrow(grams.counts_of(wanted, lo, hi), "term string, df bigint, cf bigint")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")),
            profile, n_docs,
        ),
        "term-counts",
    )
    return counted if counted.filter(F.col("cf") >= least).count() >= profile.max_features else None


def _within_limits(counted: DataFrame, profile: TextProfile, n_docs: int) -> DataFrame:
    return (
        counted.filter(F.col("df") >= profile.min_df)
        .withColumn("n_docs", F.lit(n_docs).cast("bigint"))
        .filter(F.col("df") <= F.col("n_docs") * F.lit(float(profile.max_df_ratio)))
    )


def fit_vocabulary(instances: DataFrame, profile: TextProfile) -> DataFrame:
    """(term, df, cf, idf, term_id, rarity): at most ``max_features`` terms.

    Document-frequency limits come first, then the most frequent terms of the corpus stay
    (ties by term). ``term_id`` numbers the terms alphabetically, ``rarity`` from the
    rarest up. Both windows run over ``max_features`` rows at most. Rare terms are not
    counted one by one where their summaries show that they cannot be among the first.
    """
    rows = instances if _is_tokenized(instances) else tokenized(instances, profile)
    n_docs = rows.agg(F.sum("n_rows")).first()[0] or 0
    counted = _frequent_counts(rows, profile, n_docs)
    if counted is None:
        counted = materialize(
            _within_limits(corpus_counts(rows, profile), profile, n_docs), "term-counts"
        )
    top = most_frequent(counted, profile.max_features)
    return top.select(
        "term", "df", "cf",
        (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"),
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        F.row_number().over(Window.orderBy("df", "term")).alias("rarity"),
    )


def weights(instances: DataFrame, vocabulary: DataFrame, profile: TextProfile) -> DataFrame:
    """(instance_id, term, term_id, rarity, tf, weight): L2-normalised TF-IDF, known terms only.

    The one shuffle places the texts by ``instance_id``; tasks weigh each instance whole, with
    the vocabulary at hand. Profiles that allow more than ``HANDED_TERMS`` terms join it.
    Instances without a known term have no rows.
    """
    if profile.max_features > HANDED_TERMS:
        return _joined_weights(instances, vocabulary, profile)
    rows = instances if _is_tokenized(instances) else _together(tokens(_placed(instances), profile))
    words = vocabulary.select("term", "term_id", "rarity", "idf")
    schema = types.StructType(
        [rows.schema["instance_id"], *(words.schema[c] for c in ("term", "term_id", "rarity"))]
    ).add("tf", "long").add("weight", "double")
    weigh = grams.weights_of(words.toArrow(), *profile.ngram_range, profile.sublinear_tf)
    return rows.select("instance_id", "texts").mapInArrow(weigh, schema)


def _joined_weights(instances: DataFrame, vocabulary: DataFrame, profile: TextProfile) -> DataFrame:
    """``weights`` with a vocabulary of any size."""
    tf = F.col("tf").cast("double")
    raw = ((1 + F.log(tf)) if profile.sublinear_tf else tf) * F.col("idf")
    per_instance = Window.partitionBy("instance_id")
    return (
        terms(instances, profile)
        .join(vocabulary.select("term", "term_id", "rarity", "idf"), "term")
        .groupBy("instance_id", "term", "term_id", "rarity", "idf")
        .agg(F.count(F.lit(1)).alias("tf"))
        .withColumn("raw", raw)
        .withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(per_instance)))
        .select(
            "instance_id", "term", "term_id", "rarity", "tf",
            (F.col("raw") / F.col("norm")).alias("weight"),
        )
    )
