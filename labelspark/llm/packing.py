"""Best-fit packing of token sequences, after a dominance reduction.

What packing depends on is only how many pieces there are of each length, at most
``capacity`` numbers whatever the corpus. The plan is made on these counts:

1. Reduction (Martello and Toth): a set of pieces that dominates every other set with the
   same largest piece is one sequence of some best packing. It is fixed for good, for all
   pieces of that length at once, and the instance shrinks:
   a piece with which nothing else fits stays alone; two pieces that fill the capacity
   exactly belong together; a piece with which at most one other fits takes the largest that
   fits; where at most two fit, the largest pair dominates if its parts are no smaller than
   those of every other choice.
2. The rest is packed by best fit, longest first: a piece goes where least room is left.

Equal sequences are planned together with a multiplicity, so the plan is bounded by the
capacity too. Pieces then find their place by their number among the pieces of the same
length. Such numbers are given in two steps (inside hashed buckets, then offsets per bucket),
so that one length with a third of all pieces is not numbered by one task.

Defined cases: null or empty text is one piece with the closing id; a longer document is cut
every ``capacity`` tokens; repeated rows are packed each by itself; an empty table gives an
empty packing; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import Memo, buffers, pieces, slices
from labelspark.session import materialize

CAPACITY = 2048
END_ID = 0
# Pieces of one length are numbered in buckets of about this many rows.
BUCKET_ROWS = 200_000
MIN_BUCKETS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokenizer:
    """A tokenizer file and a memo of the ids of words.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its
    words one after the other. Words are cut once more between an ASCII letter and plain
    ASCII punctuation, where its own pre-tokenizer cuts too (not beside an apostrophe, nor
    beside the signs that names of special tokens are made of), and A-Z are lower-cased as it
    does: far fewer words are distinct then.
    """

    BREAKS = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
    LETTERS = np.isin(np.arange(256), list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)))
    MARKS = np.isin(np.arange(256), list(b'!"#$%&()*+,-./:;=?@[]^_{}~'))
    SPECIAL = b"<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.memo = Memo(self._encode_all, 1)

    def _encode_all(self, words: list[bytes]) -> list[tuple[bytes]]:
        found = self.file.encode_batch_fast(
            [w.decode("utf-8") for w in words], add_special_tokens=False
        )
        return [(struct.pack(f"<{len(ids)}I", *ids),) for ids in (e.ids for e in found)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        data, offsets = buffers(column)
        if self.SPECIAL not in data.tobytes():
            data = data | (((data - 0x41) < 26).view(np.uint8) << 5)
        white, letter, mark = self.BREAKS[data], self.LETTERS[data], self.MARKS[data]
        opens = ~white
        opens[1:] &= white[:-1]
        opens[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(opens)
        numbered = pieces(data, starts).dictionary_encode()
        known = self.memo.numbers(numbered.dictionary)
        out, ends = self.memo.gather(0, known[numbered.indices.to_numpy(zero_copy_only=False)])
        bounds = ends[np.searchsorted(starts, offsets)]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the closing id, cut
    every ``capacity`` tokens. ``vocabulary`` is a path that every executor can read."""
    closing = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        own = tokenizer(vocabulary)
        for batch in slices(batches):
            rows = []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, own.encode(batch.column("text"))):
                ids += closing
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _largest(left: list[int], most: int) -> int:
    """The largest of the ascending ``left`` that is at most ``most``, or 0."""
    at = np.searchsorted(left, most, side="right")
    return int(left[at - 1]) if at else 0


def _dominating(length: int, counts: Counter, capacity: int) -> tuple[int, ...] | None:
    """A set with ``length`` that dominates all others with it, as the rest of its lengths.

    ``counts`` are the pieces left, without the one at hand. A set dominates another if the
    other's pieces can be put into places as large as its own.
    """
    room = capacity - length
    left = sorted(x for x, n in counts.items() if n > 0)
    if not left or left[0] > room:
        return ()
    if counts.get(room, 0) > 0:
        return (room,)
    smallest = []
    for x in left[:3]:
        smallest += [x] * min(counts[x], 3)
    smallest = smallest[:3]
    top = _largest(left, room)
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (top,)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # At most two others fit. The best second is the largest that can share the room at all.
    second = 0
    for x in left:
        if 2 * x <= room and counts[x] > 1:
            second = max(second, x)
        partner = _largest(left, room - x)
        if partner > x or (partner == x and counts[x] > 1):
            second = max(second, x)
    if second <= room - top and (top != second or counts[top] > 1):
        return (top, second)
    pairs = max(
        (x + _largest(left, room - x) for x in left if _largest(left, room - x)), default=0
    )
    return (top,) if top >= pairs else None


def reduce_instance(
    counts: dict[int, int], capacity: int = CAPACITY
) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """(fixed sets with multiplicity, pieces left) by dominance, for counts by length."""
    left, fixed = Counter({x: n for x, n in counts.items() if n > 0}), []

    def fix(members: tuple[int, ...], times: int) -> None:
        fixed.append((members, times))
        for x in members:
            left[x] -= times

    for x in sorted(left, reverse=True):
        if x == capacity:
            fix((x,), left[x])
        elif 2 * x > capacity and left.get(capacity - x, 0) > 0:
            fix((x, capacity - x), min(left[x], left[capacity - x]))
    if capacity % 2 == 0 and left.get(capacity // 2, 0) > 1:
        fix((capacity // 2,) * 2, left[capacity // 2] // 2)
    # One largest piece after the other, until a set with more than three would be needed.
    while largest := max((x for x, n in left.items() if n > 0), default=0):
        left[largest] -= 1
        others = _dominating(largest, left, capacity)
        left[largest] += 1
        if others is None:
            break
        members = (largest, *others)
        need = Counter(members)
        # While enough of each length is left, the same set dominates again.
        times = min(left[x] // n for x, n in need.items()) if len(need) < 3 else 1
        if others and largest + sum(others) < capacity and len(others) > 1:
            times = 1
        fix(members, max(1, times))
    return fixed, +left


def best_fit(counts: Counter, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences (their lengths) with multiplicity."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r, open_ in by_room.items() if r >= x and open_), default=capacity)
            members, times = by_room[room].pop() if room in by_room and by_room[room] else ((), n)
            # The piece fills one sequence as often as it fits, then goes on to the next.
            each = room // x
            full = min(times, n // each)
            if full:
                by_room.setdefault(room - each * x, []).append((members + (x,) * each, full))
                n -= full * each
            rest = times - full
            if n and rest and full < times and n < each:
                by_room.setdefault(room - n * x, []).append((members + (x,) * n, 1))
                n, rest = 0, rest - 1
            if rest and members:
                by_room.setdefault(room, []).append((members, rest))
    return [group for groups in by_room.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences (their lengths) with multiplicity for ``counts`` pieces by length."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, ...]]]:
    """By length: (first number, first sequence, offset), one run of numbers after the other.

    The pieces of a length with numbers from ``first number`` on lie in consecutive sequences
    at the same offset.
    """
    runs: dict[int, list[tuple[int, ...]]] = {}
    used: Counter = Counter()
    sequence = 0
    for members, times in sequences:
        offset = 0
        for x in members:
            runs.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return runs


def numbered(rows: DataFrame, key: str, ids: list[str], n_rows: int) -> DataFrame:
    """Add ``number``, from 0 inside each value of ``key``, without one task per value."""
    buckets = max(MIN_BUCKETS, -(-n_rows // BUCKET_ROWS))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*ids), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*ids)
    return (
        dealt.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_bucket"])
        .withColumn("number", F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece``, ``length``.

    ``parts`` is read several times: pass a written table.
    """
    counts = {
        r["length"]: r["n"]
        for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}, got {min(counts)}..{max(counts)}")
    runs = {
        x: tuple(np.array(c, np.int64) for c in zip(*found))
        for x, found in places(plan(counts, capacity)).items()
    }
    known = numbered(parts, "length", ["doc_id", "piece"], sum(counts.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            numbers = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for x in np.unique(lengths):
                own = np.flatnonzero(lengths == x)
                first, opened, at = runs[int(x)]
                run = np.searchsorted(first, numbers[own], side="right") - 1
                sequence[own] = opened[run] + numbers[own] - first[run]
                offset[own] = at[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    placed = known.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    return placed.select(*parts.columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all ``docs``."""
    parts = materialize(token_pieces(docs, vocabulary, capacity), "token-pieces")
    return pack(parts, capacity)
