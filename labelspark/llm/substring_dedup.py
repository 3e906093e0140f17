"""Removal of repeated lines, paragraphs and passages; the earliest occurrence stays.

A text is its sequence of lower-cased words, whatever white space stands between them. Units are
hashed and grouped over all documents:

* every line and every paragraph (lines without a blank one between) of ``UNIT_WORDS`` or more
  words;
* passages of ``UNIT_WORDS`` words, for what is repeated among other words. They begin at anchors
  that depend on the words around them only (the smallest hash of ``GRAM`` words in any
  ``WINDOW`` of positions), so copies of a passage have the same ones: any shared passage of
  WINDOW + GRAM + UNIT_WORDS - 2 words, with these values 48, holds a whole unit.

Occurrences are ranked by doc_id, row and position. The first one stays, every later one goes,
in the same document too: a periodic text keeps its first period. What overlaps or touches is one
run; it grows, up to ``REACH`` words at either end, as far as the words beside it are those beside
the first occurrence of the unit at that end (32 bits of each word's hash are compared). Every
word that goes has an equal one at an earlier rank, so something that is said stays once.

Texts are cut into words three times and shuffled twice: for the units, for the words beside runs,
and for the cut. Units are written once. Digests (128 bits) are counted with partial sums; only
repeated ones are joined back to the units, where adaptive execution splits a hot digest once its
partition passes Spark's threshold for skew.

Defined cases: null text is empty (null stays null in the result's text); a null doc_id counts as
the smallest; rows with the same doc_id rank by their row and each is cut at its own places; of
repeated rows the first keeps the text; an empty table gives an empty result; other columns of
the input are ignored, or kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm.common import free_name, slices
from labelspark.llm.words import (
    GRAM_FACTOR, SECOND_FACTOR, WORD_FACTOR, WORDS_BYTES, Powers, Words, lowest_grams, mixed,
)
from labelspark.session import materialize

UNIT_WORDS = 20
WINDOW = 26
GRAM = 4
# Words between a passage's end and the nearest unit, at most.
REACH = WINDOW + GRAM - 2

IN_WORD = ~np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])

UNITS = "row long, doc_id long, start int, size int, d1 long, d2 long"
BESIDE = "row long, at int, side int, own boolean, d1 long, d2 long, beside binary"
SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("keep_ids", T.ArrayType(T.LongType())),
    ]
)


class Cutter:
    """Words of slices, units among them, and digests of units."""

    def __init__(self):
        self.bytes, self.first, self.second = (
            Powers(f) for f in (WORD_FACTOR, GRAM_FACTOR, SECOND_FACTOR)
        )

    def words(self, column: pa.Array) -> Words:
        return Words(column, self.bytes, IN_WORD)

    @staticmethod
    def units(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of all units, in order."""
        n = len(words.starts)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        line = np.cumsum(words.data == 0x0A)[words.starts]
        other_text = np.append(True, np.diff(words.text_of) > 0)
        gap = np.append(0, np.diff(line))
        starts, sizes = [], []
        for breaks in (1, 2):  # lines, paragraphs
            first = np.flatnonzero(other_text | (gap >= breaks))
            size = np.diff(np.append(first, n))
            starts.append(first[size >= UNIT_WORDS])
            sizes.append(size[size >= UNIT_WORDS])
        at, _ = lowest_grams(words, GRAM, WINDOW, GRAM)
        at = at[at + UNIT_WORDS <= words.last_of[at]]
        starts.append(at)
        sizes.append(np.full(len(at), UNIT_WORDS))
        both = np.unique(np.concatenate(starts) << 32 | np.concatenate(sizes))
        return both >> 32, both & 0xFFFFFFFF

    def digests(self, words: Words, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        ends = starts + sizes
        size = sizes.astype(np.uint64)
        other = mixed(words.hashes + np.uint64(WORD_FACTOR))
        return [
            mixed(powers.sums(values, starts, ends) + size * np.uint64(GRAM_FACTOR)).view(np.int64)
            for powers, values in ((self.first, words.hashes), (self.second, other))
        ]


def units(rows: DataFrame) -> DataFrame:
    """(row, doc_id, start, size, d1, d2): units of texts (row, doc_id, text) in words."""

    def run(batches: Iterator[pa.RecordBatch]):
        own = Cutter()
        for batch in slices(batches, limit=WORDS_BYTES):
            words = own.words(batch.column("text"))
            starts, sizes = own.units(words)
            text = words.text_of[starts]
            at = pa.array(text)
            d1, d2 = own.digests(words, starts, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc_id").take(at),
                 pa.array((starts - words.first[text]).astype(np.int32)),
                 pa.array(sizes.astype(np.int32)), pa.array(d1), pa.array(d2)],
                names=["row", "doc_id", "start", "size", "d1", "d2"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(run, UNITS)


def repeats(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, later) occurrences of the units that occur more than once: (d1, d2, keep_id, row,
    start, size) and (row, start, end, d1, d2, keep_id)."""
    keys = ["d1", "d2"]
    many = materialize(
        found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys),
        "repeated-units",
    )
    hits = materialize(found.join(many.hint("merge"), keys), "unit-places")
    first = materialize(
        hits.groupBy(*keys).agg(F.min(F.struct("doc_id", "row", "start", "size")).alias("f"))
        .select(*keys, F.col("f.doc_id").alias("keep_id"), "f.row", "f.start", "f.size"),
        "first-places",
    )
    kept = first.select(
        *keys, "keep_id", F.col("row").alias("first_row"), F.col("start").alias("first_start")
    )
    later = hits.join(kept.hint("merge"), keys).filter("row <> first_row OR start <> first_start")
    end = (F.col("start") + F.col("size")).alias("end")
    return first, later.select("row", "start", end, *keys, "keep_id")


def runs(later: DataFrame) -> DataFrame:
    """(row, lo, hi, keep_ids, left, right): later occurrences that overlap or touch, joined;
    ``left`` and ``right`` are the digests of the units at the ends."""
    ordered = Window.partitionBy("row").orderBy("start", "end", "d1", "d2")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    return (
        later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(so_far))
        .groupBy("row", "run")
        .agg(
            F.min("start").alias("lo"), F.max("end").alias("hi"),
            F.array_sort(F.collect_set(F.struct("keep_id"))).alias("keepers"),
            F.min_by(F.struct("d1", "d2"), F.struct("start", "end")).alias("left"),
            F.max_by(F.struct("d1", "d2"), F.struct("end", "start")).alias("right"),
        )
        .withColumn("keep_ids", F.col("keepers.keep_id")).drop("run", "keepers")
    )


def _beside(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (row, at, side, own, d1, d2) with the hashes of up to REACH words before (side 0)
    or from (side 1) word ``at`` of the row, the nearest first; no word is 0."""
    lists = asked.groupBy("row").agg(
        F.collect_list(F.struct("at", "side", "own", "d1", "d2")).alias("asked")
    )

    def run(batches: Iterator[pa.RecordBatch]):
        own = Cutter()
        steps = np.arange(REACH)
        for batch in slices(batches, limit=WORDS_BYTES):
            words = own.words(batch.column("text"))
            short = np.maximum((words.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1)
            lists = batch.column("asked")
            of = np.repeat(
                np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            )
            flat = lists.flatten()
            at, side = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            low, high = words.first[of], (words.first + words.counts)[of]
            place = (at + low)[:, None] + np.where(side[:, None] == 1, steps, -1 - steps)
            there = (place >= low[:, None]) & (place < high[:, None])
            padded = np.append(short, np.uint32(0))
            found = padded[np.where(there, place, len(short))]
            ends = np.arange(len(of) + 1, dtype=np.int32) * (4 * REACH)
            beside = pa.BinaryArray.from_buffers(
                pa.binary(), len(of),
                [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found).tobytes())],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(of)), *(flat.field(i) for i in range(5)), beside],
                names=["row", "at", "side", "own", "d1", "d2", "beside"],
            )

    joined = rows.select("row", "text").join(lists.hint("merge"), "row")
    return joined.mapInArrow(run, BESIDE)


def _equal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, side, n): by how many words a run's side and its keeper's agree."""
    for batch in batches:
        own, keeper = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REACH)
            for c in ("beside", "kept")
        )
        equal = (own == keeper) & (own > 0)
        n = np.logical_and.accumulate(equal, axis=1).sum(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "at", "side")), pa.array(n)],
            names=["row", "at", "side", "n"],
        )


def removals(rows: DataFrame) -> DataFrame:
    """(row, spans): what each row (row, doc_id, text) loses, as (start, end, keep_ids) in words;
    ``keep_ids`` are the documents that keep what the span holds."""
    found = materialize(units(rows), "passage-units")
    first, later = repeats(found)
    joined = materialize(runs(later), "repeated-runs")
    keys = ["d1", "d2"]
    ends = [("left", "lo", 0, F.col("start")), ("right", "hi", 1, F.col("start") + F.col("size"))]
    asked = None
    for name, at, side, keeper_at in ends:
        side = F.lit(side).alias("side")
        own = joined.select("row", F.col(at).alias("at"), side, F.lit(True).alias("own"), f"{name}.d1", f"{name}.d2")
        used = own.select(*keys).distinct()
        kept = first.join(used.hint("merge"), keys).select(
            "row", keeper_at.alias("at"), side, F.lit(False).alias("own"), *keys
        )
        asked = own.unionAll(kept) if asked is None else asked.unionAll(own).unionAll(kept)
    around = materialize(_beside(rows, asked), "surroundings")
    kept = around.filter("NOT own").select(*keys, "side", F.col("beside").alias("kept"))
    grown = materialize(
        around.filter("own").join(kept.hint("merge"), [*keys, "side"])
        .select("row", "at", "side", "beside", "kept")
        .mapInArrow(_equal_words, "row long, at int, side int, n int").filter("n > 0"),
        "grown-runs",
    )
    more = [
        grown.filter(F.col("side") == side).select("row", F.col("at").alias(at), F.col("n").alias(f"n{side}"))
        for _, at, side, _ in ends
    ]
    spans = (
        joined.join(more[0].hint("merge"), ["row", "lo"], "left")
        .join(more[1].hint("merge"), ["row", "hi"], "left")
        .select(
            "row",
            F.struct(
                (F.col("lo") - F.coalesce("n0", F.lit(0))).alias("start"),
                (F.col("hi") + F.coalesce("n1", F.lit(0))).alias("end"),
                "keep_ids",
            ).alias("span"),
        )
    )
    return spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _merged(spans: list[dict], text: bytes) -> list[tuple[int, int]]:
    """Places to cut: overlapping spans joined, with the white space behind them."""
    out: list[list[int]] = []
    for span in spans:
        start, end = span["start"], span["end"]
        if out and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    for cut in out:
        if cut[1] < len(text) and text[cut[1] : cut[1] + 1] in b" \t":
            cut[1] += 1
    return [tuple(c) for c in out]


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """(text without the spans, characters removed)."""
    kept, at, removed = [], 0, 0
    for start, end in _merged(spans, text):
        kept.append(text[at:start])
        removed += len(text[start:end].decode("utf-8", "replace"))
        at = end
    return b"".join([*kept, text[at:]]), removed


def cleaned(docs: DataFrame, spans: str = "_spans", removed: str = "_removed") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and what was cut from each row. ``docs`` is a
    table read from files, so that its rows are numbered alike whenever it is read.

    Columns added under the names given, which ``docs`` must not have: ``spans`` (byte places in
    the original text, and who keeps what went) and ``removed`` (characters).
    """
    for name in (spans, removed):
        if free_name(name, docs.columns) != name:
            raise ValueError(f"docs has a column {name}: give another name for the added one")
    key = free_name("row", docs.columns)
    numbered = docs.withColumn(key, F.monotonically_increasing_id())
    rows = numbered.select(
        F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    lost = materialize(removals(rows), "removals").select(
        F.col("row").alias(key), F.col("spans").alias(spans)
    )
    # Spans grow with the corpus: they are not for a broadcast at any size.
    joined = numbered.join(lost.hint("merge"), key, "left").select(*docs.columns, spans)
    place = docs.columns.index("text")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(spans, T.ArrayType(SPAN)), T.StructField(removed, T.LongType())]
    )
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("keep_ids", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]):
        own = Cutter()
        for batch in slices(batches, limit=WORDS_BYTES):
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column("text")
            out, places, counts = texts, [[] for _ in lists], np.zeros(len(lists), np.int64)
            hit = [i for i, s in enumerate(lists) if s]
            if hit:
                chosen = texts.take(pa.array(hit))
                words = own.words(chosen)
                raw = chosen.cast(pa.large_binary()).to_pylist()
                whole = texts.cast(pa.large_binary()).to_pylist()
                for n, i in enumerate(hit):
                    first, base = int(words.first[n]), int(words.offsets[n])
                    places[i] = [
                        {
                            "start": int(words.starts[first + s["start"]]) - base,
                            "end": int(words.ends[first + s["end"] - 1]) - base,
                            "keep_ids": s["keep_ids"],
                        }
                        for s in lists[i]
                    ]
                    whole[i], counts[i] = _cut(raw[n], places[i])
                out = pa.array(whole, pa.large_binary()).cast(pa.large_string()).cast(texts.type)
            columns = list(batch.columns[:-1])
            columns[place] = out
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(places, kind), pa.array(counts)], names=schema.names
            )

    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed_chars, spans, keep_ids): every row with what is left of it,
    the byte places that went and the documents that keep those passages."""
    done = cleaned(docs.select("doc_id", "text"))
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.col("_removed").alias("n_removed_chars"),
        F.col("_spans").alias("spans"),
        F.array_distinct(F.flatten(F.col("_spans.keep_ids"))).alias("keep_ids"),
    )
