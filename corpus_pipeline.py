"""A corpus made ready for training, stage by stage; each works on all its predecessor kept.

Lists of documents that stay grow with the corpus, so they are merged, never broadcast.

Defined cases, for every stage: ``docs`` is a table read from files, so that its rows are numbered
alike whenever it is read; its columns, in their order, are those of the result, whatever their
names (columns that a stage adds for itself take free names); rows with one doc_id, also null
ones, are documents of their own; an empty table gives an empty table. What a null or empty text
means is said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from labelspark.llm.common import documents, free_name
from labelspark.llm.queries import WORD_VOCABULARY
from labelspark.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. A null text is scored as the empty one."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("toxic_score", docs.columns)
    scored = toxicity.with_scores(docs, model, score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: most code points, then smallest doc_id, then first
    row. Null, empty and blank texts are one group."""
    key = free_name("row", docs.columns)
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    kept = exact_dedup.exact_dedup(rows, row=key).filter("kept")
    kept = kept.select(F.col("row").alias(key)).hint("merge")
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (then the first row; a
    null doc_id is smallest). Groups are the SimHash operator's: 3-word shingles, fingerprints
    linked at 3 or fewer differing bits. Texts without words have fingerprint zero."""
    key = free_name("row", docs.columns)
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    plain = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    groups = simhash.simhash_groups(plain.select(F.col("row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("root")
    )
    ranked = materialize(
        plain.select("row", "id").join(groups.hint("merge"), "row"), "near-copy-rows"
    )
    # Scalars only, so that a large group is a partial minimum per task: a null id is smallest.
    first = ranked.groupBy("root").agg(
        F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("no_id")
    ).select("root", F.when(F.col("no_id") == 0, F.col("low")).alias("low"))
    # Written, so that a join on a large group's root may be split before rows are grouped by it.
    lowest = materialize(
        ranked.join(first.hint("merge"), "root").filter(F.col("id").eqNullSafe(F.col("low")))
        .select("root", "row"),
        "near-copy-firsts",
    )
    best = lowest.groupBy("root").agg(F.min("row").alias("row"))
    gone = materialize(
        ranked.select(F.col("row").alias(key))
        .join(best.select(F.col("row").alias(key)).hint("merge"), key, "left_anti"),
        "near-copies",
    ).hint("merge")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines, paragraphs and passages that stand earlier in the corpus;
    ``n_chars``, if there is one, is counted anew. A null text stays null."""
    spans, removed = (free_name(n, docs.columns) for n in ("cut_spans", "cut_chars"))
    done = substring_dedup.cleaned(docs, spans, removed).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.length("text").cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, a null text as the empty one. Other columns than
    doc_id and text are not part of the result."""
    return packing.best_fit_packing(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# The stages score, fingerprint and tokenize, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
