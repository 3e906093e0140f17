"""Benchmark decontamination by winnowing.

Texts are sequences of words. A window is ``SPAN`` consecutive words of a benchmark item; an
item of fewer words is one window. Documents and items keep fingerprints: of every
``SPAN - k + 1`` consecutive k-word grams the ones with the smallest hash. Which grams these are
depends on the words alone, so any shared span of ``SPAN`` words leaves a common fingerprint at
the same place of the span. Spark joins the fingerprints; around each common one the windows of
the document that hold it are looked up among the items' windows by 128-bit digests, so a hit
grows to the ends of what is shared and no hash decides alone. Items shorter than ``SPAN`` have
a class of fingerprints for their own length, with the same guarantee for it.

What scales: fingerprints of documents stay in their task unless the benchmark's are too many
for a broadcast (Catalyst decides by the size of the written table; else both are merged). No
pair of positions is ever formed: a window is either known or not. Items with equal words are
one class, and documents with the same classes share one list of items.

Defined cases: a null or empty text has no words; rows of ``docs`` with one doc_id (also null)
are documents of their own; a row of the benchmark without an item_id or without words is no
item; rows with one item_id are one item that occurs if any of them does; an empty table of
documents gives an empty result, an empty benchmark clean documents; other columns of either
table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import slices
from labelspark.llm.words import WORD_FACTOR, WORDS_BYTES, Powers, Words, lowest_grams
from labelspark.session import materialize

SPAN = 10

# Bytes of words are digits, letters and all of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x41:0x5B] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True

WINDOWS = "row long, doc_id long, n_words long, start int, size int, digest binary"


def gram_size(span: int) -> int:
    return (span + 1) // 2


def winnow(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, fingerprints): the smallest grams of every span inside one text."""
    k = gram_size(span)
    return lowest_grams(words, k, span - k + 1, span)


def _words(column: pa.Array, powers: Powers) -> Words:
    return Words(column, powers, IN_WORD)


def fingerprints(rows: DataFrame, spans: list[int]) -> DataFrame:
    """(row, at, span, fingerprint) of texts (row, text), ``at`` counting words of the text."""

    def run(batches: Iterator[pa.RecordBatch]):
        powers = Powers(WORD_FACTOR)
        for batch in slices(batches, limit=WORDS_BYTES):
            words = _words(batch.column("text"), powers)
            for span in spans:
                at, found = winnow(words, span)
                text = words.text_of[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(text)),
                     pa.array((at - words.first[text]).astype(np.int32)),
                     pa.array(np.full(len(at), span, np.int32)),
                     pa.array(found.view(np.int64))],
                    names=["row", "at", "span", "fingerprint"],
                )

    return rows.select("row", "text").mapInArrow(
        run, "row long, at int, span int, fingerprint long"
    )


def _digests(words: Words, lowered: bytes, starts: np.ndarray, size: int) -> list[bytes]:
    """128-bit digests of ``size`` words from each of ``starts``."""
    a, b = words.starts.tolist(), words.ends.tolist()
    return [
        blake2b(b" ".join([lowered[a[i]:b[i]] for i in range(s, s + size)]), digest_size=16).digest()
        for s in starts.tolist()
    ]


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, class, row, text, n_words) and (digest, size, class): the items that have words,
    and the distinct windows of each class of items with equal words."""

    def classes(batches: Iterator[pa.RecordBatch]):
        powers = Powers(WORD_FACTOR)
        for batch in slices(batches, limit=WORDS_BYTES):
            words = _words(batch.column("text"), powers)
            lowered = words.lowered()
            whole = [
                _digests(words, lowered, np.array([first]), n)[0] if n else None
                for first, n in zip(words.first.tolist(), words.counts.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(whole, pa.binary()),
                 pa.array(words.counts.astype(np.int64)), batch.column("text")],
                names=["item_id", "class", "n_words", "text"],
            )

    known = materialize(
        items.select(F.col("item_id").cast("string"), "text").filter("item_id IS NOT NULL")
        .mapInArrow(classes, "item_id string, class binary, n_words long, text string")
        .filter("n_words > 0"),
        "benchmark-items",
    )

    def windows(batches: Iterator[pa.RecordBatch]):
        powers = Powers(WORD_FACTOR)
        for batch in slices(batches, limit=WORDS_BYTES):
            words = _words(batch.column("text"), powers)
            lowered = words.lowered()
            for size in range(1, SPAN + 1):
                whole = words.counts[words.text_of] == size if size < SPAN else True
                starts = np.arange(len(words.starts))
                starts = starts[(starts + size <= words.last_of) & whole]
                text = pa.array(words.text_of[starts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").take(text),
                     pa.array(np.full(len(starts), size, np.int32)),
                     pa.array(_digests(words, lowered, starts, size), pa.binary())],
                    names=["class", "size", "digest"],
                )

    one_each = known.groupBy("class").agg(F.first("text").alias("text"))
    found = one_each.mapInArrow(windows, "class binary, size int, digest binary").distinct()
    return known, materialize(found, "benchmark-windows")


def _candidate_windows(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Of every row its number of words (``digest`` null) and its windows around ``hits``."""
    near = hits.groupBy("row").agg(F.collect_list(F.struct("at", "span")).alias("near"))
    joined = rows.join(near.hint("merge"), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]):
        powers = Powers(WORD_FACTOR)
        for batch in slices(batches, limit=WORDS_BYTES):
            words = _words(batch.column("text"), powers)
            n = batch.num_rows
            counts = pa.array(words.counts.astype(np.int64))
            none = pa.nulls(n, pa.int32())
            names = ["row", "doc_id", "n_words", "start", "size", "digest"]
            own = [batch.column("row"), batch.column("doc_id"), counts]
            yield pa.RecordBatch.from_arrays([*own, none, none, pa.nulls(n, pa.binary())], names=names)
            near = batch.column("near")
            text = np.repeat(
                np.arange(n), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False)
            )
            if not len(text):
                continue
            lowered = words.lowered()
            flat = near.flatten()
            at, spans = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = at + words.first[text]
            for size in np.unique(spans).tolist():
                places = at[spans == size]
                # All windows of this size that hold the gram.
                reach = np.arange(size - gram_size(size) + 1)
                starts = np.unique(places[:, None] - reach)
                starts = starts[starts >= 0]
                # A window that began in the text before would not end there.
                starts = starts[starts + size <= words.last_of[starts]]
                owner = words.text_of[starts]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(owner)) for c in own),
                     pa.array((starts - words.first[owner]).astype(np.int32)),
                     pa.array(np.full(len(starts), size, np.int32)),
                     pa.array(_digests(words, lowered, starts, size), pa.binary())],
                    names=names,
                )

    return joined.select("row", "doc_id", "text", "near").mapInArrow(run, WINDOWS)


def spans_hit(windows: DataFrame) -> DataFrame:
    """(row, start, end): the words of each row inside hits, as places not yet counted.

    ``windows`` holds (row, start, size). Rows of the result do not overlap; a window that adds
    nothing is left out.
    """
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    return (
        windows.select("row", "start", end.alias("end"), reached.alias("reached"))
        .filter("end > reached")
        .select("row", F.greatest("start", "reached").alias("start"), "end")
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, found) of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    ``documents``: (row, doc_id, n_words) of every row; ``spans``: (row, start, end), hit words
    of the contaminated ones; ``found``: (row, n_items, items), the items with windows in them.
    ``docs`` is a table read from files, so that its rows are numbered alike whenever it is read.
    """
    known, windows = item_windows(items)
    # At most SPAN lengths, whatever the benchmark's size.
    spans = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"
    )
    texts = known.groupBy("class").agg(F.first("text").alias("text"), F.first("n_words").alias("n"))
    texts = texts.select("text", "n", F.lit(0).cast("long").alias("row"))
    marks = None
    for span in spans:
        own = texts.filter(F.col("n") >= span if span == SPAN else F.col("n") == span)
        own = fingerprints(own, [span]).select("span", "fingerprint")
        marks = own if marks is None else marks.unionAll(own)
    if marks is None:
        hits = rows.select("row", F.lit(0).alias("at"), F.lit(0).alias("span")).limit(0)
    else:
        marks = materialize(marks.distinct(), "benchmark-fingerprints")
        hits = fingerprints(rows, spans).join(marks, ["span", "fingerprint"], "left_semi")
        hits = materialize(hits.select("row", "at", "span"), "common-fingerprints")
    placed = materialize(_candidate_windows(rows, hits), "candidate-windows")
    documents = placed.filter("digest IS NULL").select("row", "doc_id", "n_words")
    asked = placed.filter("digest IS NOT NULL")
    digests = windows.select("digest").distinct()
    spans_found = spans_hit(asked.join(digests, "digest", "left_semi").select("row", "start", "size"))
    found = (
        asked.select("row", "digest").join(windows.select("digest", "class"), "digest")
        .select("row", "class").distinct()
    )
    return documents, spans_found, item_lists(found, known)


def item_lists(found: DataFrame, known: DataFrame) -> DataFrame:
    """(row, n_items, items): per row of ``found`` (row, class) the ids, sorted as strings.

    Rows with the same classes share a list: it is made once per distinct set of classes.
    """
    sets = materialize(
        found.groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("classes"))
        .withColumn("set_key", F.sha2(F.concat_ws(",", F.transform("classes", lambda c: F.hex(c))), 256)),
        "item-sets",
    )
    once = sets.groupBy("set_key").agg(F.first("classes").alias("classes"))
    lists = (
        once.select("set_key", F.explode("classes").alias("class"))
        .join(known.select("class", "item_id"), "class")
        .groupBy("set_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("set_key", "items", F.size("items").cast("long").alias("n_items"))
    )
    return sets.select("row", "set_key").join(materialize(lists, "item-lists"), "set_key").select(
        "row", "n_items", "items"
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    documents, spans, found = decontaminate(docs, items)
    hit = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    listed = found.select("row", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    zero, nothing = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    return (
        documents.join(hit.hint("merge"), "row", "left").join(listed.hint("merge"), "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", nothing).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
