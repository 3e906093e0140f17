"""Document fingerprints from prefix polynomial hashes.

``prefix[i]`` is the polynomial hash of the first i code points modulo a prime. The hash of any
span follows from two entries, so spans are compared in constant time and the longest common
extension of two places is found by binary search. Code points j are added as c_j * B^j, so a
prefix array is one running sum, and spans are compared after scaling to the same power. Two
primes below 2^31 are used side by side.

A fingerprint is made of hashes that prefix arrays give: the length, the hash of the whole
text, hashes of prefixes whose lengths are 1, 2, 3, 4, 6, 8, 12, ..., and a sketch, the lowest
hash in each of 64 classes of all spans of ``SPAN`` code points. Two fingerprints are compared
by their sketches (an estimate of the Jaccard coefficient of the spans) and by the longest
prefix they agree on, found by binary search.

To pair each document with the next one, rows are ranged by doc_id and read in order; only the
first and last document of each range meet another range. The text is shuffled once.

Defined cases: null text is empty; the fingerprints of empty texts are equal and alike (1.0);
rows with the same doc_id are ordered by their text; a null doc_id comes first; a table of one
row is its own next document; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.session import materialize

# Two primes below 2^31 and a base for each.
PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = np.array([911382323, 972663749], np.uint64)

SPAN = 16
CLASSES = 64


class _Powers:
    """Powers of the bases, grown as needed."""

    def __init__(self):
        self.table = np.ones((2, 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while self.table.shape[1] < n:
            step = self.table[:, -1] * BASES % PRIMES
            grown = self.table * step[:, None] % PRIMES[:, None]
            self.table = np.concatenate([self.table, grown], axis=1)
        return self.table[:, :n]


POWERS = _Powers()


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        powers = POWERS.upto(self.n + 1)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * powers[:, : self.n] % PRIMES[:, None]
        self.table = np.zeros((2, self.n + 1), np.uint64)
        np.cumsum(terms, axis=1, out=self.table[:, 1:])
        self.table %= PRIMES[:, None]

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(code_points(text))

    def span(self, start: int, end: int, at: int) -> tuple[int, int]:
        """Hash of the span, scaled as if it began at ``at`` (at least ``start``)."""
        primes, bases = PRIMES.tolist(), BASES.tolist()
        return tuple(
            (int(self.table[i, end]) - int(self.table[i, start])) * pow(bases[i], at - start, p) % p
            for i, p in enumerate(primes)
        )

    def whole(self) -> int:
        return int(self.table[0, -1]) << 32 | int(self.table[1, -1])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, size: int) -> bool:
    """Whether a[i : i + size] equals b[j : j + size]."""
    if i + size > a.n or j + size > b.n:
        return False
    at = max(i, j)
    return a.span(i, i + size, at) == b.span(j, j + size, at)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of a from i and b from j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


@lru_cache(maxsize=256)
def grid(n: int) -> tuple[int, ...]:
    """Lengths of the hashed prefixes of a text of n code points."""
    lengths, x = [], 1
    while x <= n:
        lengths += [x, x + x // 2] if x > 1 else [x]
        x *= 2
    return tuple(sorted({x for x in lengths if x <= n}))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


@lru_cache(maxsize=64)
def _inverse_powers(n: int) -> np.ndarray:
    """Powers of the first base's inverse, by which spans become comparable; n a power of 2."""
    inverse = np.uint64(pow(int(BASES[0]), -1, int(PRIMES[0])))
    table = np.ones(1, np.uint64)
    while len(table) < n:
        step = table[-1] * inverse % PRIMES[0]
        table = np.concatenate([table, table * step % PRIMES[0]])
    return table[:n]


def sketch(prefixes: Prefixes) -> np.ndarray:
    """Lowest span hash per class, as one byte each; 0 for a class without spans."""
    size = min(SPAN, prefixes.n)
    out = np.zeros(CLASSES, np.uint8)
    if not size:
        return out
    low = prefixes.table[0]
    prime, n = PRIMES[0], prefixes.n - size + 1
    scale = _inverse_powers(1 << max(0, n - 1).bit_length())[:n]
    spans = (low[size:] + prime - low[:-size]) % prime * scale % prime
    values = _mixed(spans)
    kinds = (values >> np.uint64(58)).astype(np.int64)
    lowest = np.full(CLASSES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(lowest, kinds, values & np.uint64((1 << 58) - 1))
    filled = np.flatnonzero(lowest != np.iinfo(np.uint64).max)
    out[filled] = (_mixed(lowest[filled]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def fingerprint(prefixes: Prefixes) -> str:
    """Length, whole hash, prefix hashes (16 bits each) and sketch, as hex fields."""
    points = list(grid(prefixes.n))
    marks = (_mixed(prefixes.table[0, points]) >> np.uint64(48)).astype(">u2").tobytes().hex()
    return (
        f"{prefixes.n:x}.{prefixes.whole():016x}.{marks}.{sketch(prefixes).tobytes().hex()}"
    )


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    n_a, _, marks_a, sketch_a = a.split(".")
    n_b, _, marks_b, sketch_b = b.split(".")
    n_a, n_b = int(n_a, 16), int(n_b, 16)
    if not n_a or not n_b:
        return 0.0
    x = np.frombuffer(bytes.fromhex(sketch_a), np.uint8)
    y = np.frombuffer(bytes.fromhex(sketch_b), np.uint8)
    either = (x > 0) | (y > 0)
    same = np.count_nonzero((x == y) & (x > 0)) / max(1, np.count_nonzero(either))
    spans = max(0.0, (same - 1 / 255) / (1 - 1 / 255))
    points = grid(min(n_a, n_b))
    low, high = 0, len(points)
    while low < high:
        middle = (low + high + 1) // 2
        if marks_a[4 * (middle - 1) : 4 * middle] == marks_b[4 * (middle - 1) : 4 * middle]:
            low = middle
        else:
            high = middle - 1
    prefix = points[low - 1] / max(n_a, n_b) if low else 0.0
    return min(1.0, max(spans, prefix if prefix >= 0.05 else 0.0))


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, common_prefix long"
)
_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


class _Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefixes = Prefixes.of(text)
        self.mark = fingerprint(self.prefixes)

    def compared(self, following: _Document) -> tuple:
        """The result row of this document with the next one."""
        changed = edited(self.text, following.text)
        other = Prefixes.of(changed)
        mark = fingerprint(other)
        return (
            self.doc_id, len(self.text),
            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            self.mark, mark, likeness(self.mark, mark), likeness(self.mark, following.mark),
            common_extension(self.prefixes, 0, other, 0),
        )


def _rows(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return [pa.array(c, t) for c, t in zip(columns, _TYPES)]


def _compare_neighbours(batches: Iterator[pa.RecordBatch]):
    """Rows of ordered documents; the first and the last text are given in ``edge``, since the
    document before or behind them is in another range."""

    def batch_of(rows, edges):
        arrays = _rows(rows)
        count = len(rows) + len(edges)
        nulls = [pa.nulls(len(edges), t) for t in _TYPES]
        arrays = [pa.concat_arrays([a, b]) for a, b in zip(arrays, nulls)]
        kinds = pa.array([None] * len(rows) + [k for k, _, _ in edges], pa.string())
        texts = pa.array([None] * len(rows) + [t for _, _, t in edges], pa.string())
        ids = pa.array([None] * len(rows) + [i for _, i, _ in edges], pa.int64())
        assert len(kinds) == count
        return pa.RecordBatch.from_arrays(
            [*arrays, kinds, ids, texts], names=[*_NAMES, "edge", "edge_id", "edge_text"]
        )

    last = None
    for batch in batches:
        rows, edges = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            own = _Document(doc_id, text.as_py() or "")
            if last is None:
                edges.append(("first", doc_id, own.text))
            else:
                rows.append(last.compared(own))
            last = own
        yield batch_of(rows, edges)
    if last is not None:
        yield batch_of([], [("last", last.doc_id, last.text)])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_prefix), a row per row of ``docs``; the next document is that with the
    next doc_id, after the last the first."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("_order", F.xxhash64("text"))
    ranged = own.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order", "text")
    done = materialize(
        ranged.select("doc_id", "text").mapInArrow(
            _compare_neighbours, f"{RESULT}, edge string, edge_id long, edge_text string"
        ).withColumn("range", F.spark_partition_id()),
        "fingerprints",
    )
    # Two texts per range: the last one of each meets the first one of the next range.
    edges = done.filter("edge IS NOT NULL").select("edge", "edge_id", "edge_text", "range")
    firsts = edges.filter("edge = 'first'")
    ranges = firsts.select("range").withColumn(
        "next_range",
        F.coalesce(
            F.lead("range").over(Window.orderBy("range")),
            F.min("range").over(Window.partitionBy()),
        ),
    )
    pairs = (
        edges.filter("edge = 'last'").select("range", "edge_id", F.col("edge_text").alias("text"))
        .join(ranges, "range")
        .join(firsts.select(F.col("range").alias("next_range"),
                            F.col("edge_text").alias("following")), "next_range")
        .select("edge_id", "text", "following")
    )

    def compare(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                _rows([
                    _Document(r["edge_id"], r["text"]).compared(_Document(None, r["following"]))
                    for r in batch.to_pylist()
                ]),
                names=_NAMES,
            )

    return (
        done.filter("edge IS NULL").select(*_NAMES)
        .unionByName(pairs.mapInArrow(compare, RESULT))
    )
