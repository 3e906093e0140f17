"""Near-duplicates by 64-bit SimHash fingerprints at three or fewer differing bits.

Deletion variants instead of many segments: with two segments of 32 bits, three differing bits
leave one segment with at most one. Two segments differ in exactly bit i if they are equal with
bit i deleted and one holds 0 there, the other 1; so every fingerprint is entered once for each
bit of each segment, on the side its bit says, and once with the whole segment. Entries that
are equal are joined, and the distance of the whole fingerprints is part of the join condition.

Only distinct fingerprints are linked, so copies cost nothing more, and a group of copies is
never expanded into pairs. Near copies of one text share most bits for good, so that their
distinct fingerprints stay few. Components are found by rounds of joins on the links.

Defined cases: null text is empty; a text without words has fingerprint zero, linked like any
other; fewer than three words are one shingle; repeated rows each give a row; a row without
doc_id keeps null and takes its component from the others (null if there are none); an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import slices
from labelspark.llm.components import components
from labelspark.session import materialize

MAX_DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
SEGMENT_BITS = 32
# Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        starts = [0, *ends[: -SHINGLE_WORDS]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        block = np.array(hashes[at : at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            found = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))],
                names=["doc_id", "fp"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _entries(distinct: DataFrame, side: int) -> DataFrame:
    """(key, fp): whole segments, and segments without bit i where the bit equals ``side``."""
    bits = F.array(*[F.lit(i) for i in range(SEGMENT_BITS + 1)])
    halves = F.array(*[
        F.struct(F.lit(s).cast("long").alias("s"),
                 F.expr(f"shiftrightunsigned(fp, {SEGMENT_BITS * s}) & 4294967295L").alias("v"))
        for s in (0, 1)
    ])
    whole = F.col("i") == SEGMENT_BITS
    mask = F.expr("shiftleft(1L, i)")
    at_bit = F.expr("shiftright(h.v, i) & 1L") == side
    rows = distinct.select("fp", F.explode(halves).alias("h")).select(
        "fp", "h", F.explode(bits).alias("i")
    )
    value = F.when(whole, F.col("h.v")).otherwise(F.col("h.v").bitwiseAND(F.bitwise_not(mask)))
    place = (F.col("h.s") * 64 + F.col("i")) * F.lit(1 << SEGMENT_BITS)
    return rows.filter(whole | at_bit).select((place + value).alias("key"), "fp")


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at ``max_distance`` or fewer differing bits."""
    if not 0 <= max_distance <= 3:
        raise ValueError(f"max_distance must be from 0 to 3, got {max_distance}")
    left = _entries(distinct, 0).select("key", F.col("fp").alias("a"))
    right = _entries(distinct, 1).select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    # Entries are many times the table they are made from: never broadcast them by its size.
    return left.join(
        right.hint("merge"), (F.col("key") == F.col("key_b")) & near & (F.col("a") != F.col("b"))
    ).select("a", "b")


def simhash_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to."""
    known = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(
        known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints"
    )
    roots = components(fingerprint_links(distinct.select("fp"), max_distance))
    rooted = materialize(
        distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"),
        "rooted",
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(firsts, "root").select("fp", "component_id"), "fp-components")
    return known.join(named, "fp").select("doc_id", "fp", "component_id")
