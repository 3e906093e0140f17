"""Alignment of two tokenizers' tokens, and how often token pairs are linked in the corpus.

Both tokenizations of a text cover the same bytes. Where tokens of both end, a group ends; every
stretch between two ends belongs to one token of each side, a link. A pair of ids counts the
documents that hold it linked.

The count is external, in three steps over what Spark shuffles:

* Each task turns its documents into records (pair, document, links), sorts a run of bounded
  size, radix-partitions it by the low digits of the A id, and writes every part as zstd frames:
  the pairs with their numbers of documents, and, apart from these, the documents per pair.
* Of the runs of a part only the pairs are merged, ``FAN_IN`` at a time, by a heap over the runs
  in the order of A ids; rounds go on until one list per part is left. The last round sees all
  pairs of an A id at once and marks the highest counts.
* Runs, a few per task, read these lists part by part and stream contributions back to their own
  documents, whose sums are all that a task keeps.

So no pair, A id or document gathers more than a run's records in one task, however frequent it
is, and a list is at most as long as the pairs that the vocabularies can form. Runs are a written
table, which outlives lost executors.

Defined cases: a null or empty text, one that is no valid UTF-8, and one whose tokens do not give
back its bytes (as with U+2581, which one tokenizer takes for a blank) has no tokens: zeros and
an empty string; repeated rows and doc_ids, also null ones, are documents of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.byte_bpe import boundaries
from labelspark.llm.common import Memo, buffers, pieces, slices
from labelspark.session import materialize

# Parts of a run, by the A id's low digits.
PARTS = 16
# Records and documents of a run at most (it may exceed them by one slice of texts).
RUN_RECORDS, RUN_DOCS = 3_000_000, 100_000
# Runs merged at a time, and runs whose documents one group of rows sums up.
FAN_IN, RUNS_BACK = 64, 4

FIGURES = ("n_a", "n_b", "n_groups", "n_links")
DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RUNS = f"run long, part int, heads binary, places binary, docs array<struct<{DOC}>>"
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32 as one zstd frame, byte plane by byte plane."""
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    planes = [
        np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
        for a in arrays
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def unpacked(frame: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    n = int(data[:4].view(np.uint32)[0])
    sizes = data[4 : 4 + 4 * n].view(np.uint32).tolist()
    out, at = [], 4 + 4 * n
    for size in sizes:
        planes = data[at : at + 4 * size].reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel())
        at += 4 * size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences modulo 2 ** 32; ``np.cumsum(..., dtype=np.uint32)`` undoes them."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0))


def restored(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint32)


class Settled:
    """Which code points have had their general category since Unicode 3.2. For all of these the
    boundaries found by classes are those of any tokenizer library; texts with others are given
    to the library whole. Code points are looked up when they are first met."""

    UNKNOWN = 2

    def __init__(self):
        self.known = np.full(0x110000, self.UNKNOWN, np.uint8)
        self.known[:0x80] = 1

    def odd(self, codes: np.ndarray) -> np.ndarray:
        """Where code points stand that are not settled."""
        state = self.known[codes]
        new = codes[state == self.UNKNOWN]
        if len(new):
            for c in set(new.tolist()):
                same = unicodedata.category(chr(c)) == unicodedata.ucd_3_2_0.category(chr(c))
                self.known[c] = same
            state = self.known[codes]
        return np.flatnonzero(state == 0)


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable characters of
    Latin-1 are themselves, the other bytes are counted up from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _table(values: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(values, pa.large_binary()), np.array([len(v) for v in values], np.int64)


class SideA:
    """A byte-level BPE file: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(path)
        self.file.encode_special_tokens = True
        signs = _byte_of_sign()
        entries = self.file.get_vocab()
        said = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            if all(c in signs for c in entry):
                said[i] = bytes(signs[c] for c in entry)
        self.bytes, self.sizes = _table(said)
        self.memo, self.settled = Memo(self._encode, 1), Settled()

    def _encode(self, parts: list[bytes]) -> list[tuple[bytes]]:
        found = self.file.encode_batch([p.decode() for p in parts], add_special_tokens=False)
        return [(np.array(f.ids, np.uint32).tobytes(),) for f in found]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts begin that are encoded apart."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(codes), bool)
        opening = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
        first[opening] = True
        start = boundaries(codes, first)
        odd = self.settled.odd(codes)
        if len(odd):
            text = np.cumsum(first) - 1
            whole = np.zeros(int(text[-1]) + 1, bool)
            whole[text[odd]] = True
            start &= first | ~whole[text]
        return lead[start]


class SideB:
    """A sentencepiece BPE model with byte fallback, which adds a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.file = sentencepiece.SentencePieceProcessor(model_file=path)
        said, self.apart = [], True
        for i in range(self.file.get_piece_size()):
            piece = self.file.id_to_piece(i)
            if self.file.is_byte(i):
                said.append(bytes([int(piece[3:5], 16)]))
                continue
            said.append(piece.replace("▁", " ").encode())
            # No piece has a blank behind another character, so none spans two words.
            self.apart &= "▁" not in piece.lstrip("▁")
        self.blank = self.file.piece_to_id("▁")
        self.bytes, self.sizes = _table(said)
        self.memo = Memo(self._encode, 1)

    def _encode(self, parts: list[bytes]) -> list[tuple[bytes]]:
        found = self.file.encode([p[1:].decode() for p in parts], num_threads=1)
        return [(np.array(ids or [self.blank], np.uint32).tobytes(),) for ids in found]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every run of blanks begins a part, if no piece spans two; every text has one first."""
        opens = data == 0x20
        opens[1:] &= data[:-1] != 0x20
        if not self.apart:
            opens[:] = False
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(opens)


def encoded(side: SideA | SideB, data: np.ndarray, offsets: np.ndarray):
    """(ids, text of each id, which texts the ids give back)."""
    starts = side.cuts(data, offsets)
    numbered = pieces(data, starts).dictionary_encode()
    known = side.memo.numbers(numbered.dictionary)
    found, ends = side.memo.gather(0, known[numbered.indices.to_numpy(zero_copy_only=False)])
    ids = np.frombuffer(found, np.uint32)
    bounds = ends[np.searchsorted(starts, offsets)] // 4
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    said, at = buffers(side.bytes.take(pa.array(ids)))
    if len(said) == len(data) and (said == data).all() and (at[bounds] == offsets).all():
        return ids, text, np.ones(len(offsets) - 1, bool)
    given = [
        np.array_equal(said[at[a] : at[b]], data[c:d])
        for a, b, c, d in zip(bounds, bounds[1:], offsets, offsets[1:])
    ]
    return ids, text, np.array(given, bool)


@dataclass
class Aligned:
    """Figures per text of a slice, and the links in order."""

    figures: list[np.ndarray]
    groups: list[str]
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        most = max(len(self.a.sizes), len(self.b.sizes))
        self.decimals = pa.array(
            [f"{i}{sign}".encode() for i in range(most) for sign in ",|;"], pa.large_binary()
        )

    def align(self, column: pa.Array) -> Aligned:
        data, offsets = _led(column)
        n = len(offsets) - 1
        if not len(data):
            none = np.empty(0, np.int64)
            return Aligned([np.zeros(n, np.int64)] * 4, [""] * n, none, none, none)
        a, text_a, given = encoded(self.a, data, offsets)
        b, text_b, given_b = encoded(self.b, data, offsets)
        given &= given_b
        # Texts without tokens leave no bytes.
        used = np.where(given, np.diff(offsets), 0)
        offsets = np.concatenate([[0], np.cumsum(used)])
        a, text_a = a[given[text_a]], text_a[given[text_a]]
        b, text_b = b[given[text_b]], text_b[given[text_b]]
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # Ends marked on the bytes: how many lie before a byte numbers tokens and groups.
        ends = np.zeros((2, len(data) + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        both, either = np.flatnonzero(ends[0] & ends[1]), np.flatnonzero(ends[0] | ends[1])
        upto_a, upto_b = np.cumsum(ends[0], dtype=np.int32), np.cumsum(ends[1], dtype=np.int32)
        link_text = np.searchsorted(offsets, either, side="left") - 1
        group_text = np.searchsorted(offsets, both, side="left") - 1
        figures = [np.bincount(t, minlength=n) for t in (text_a, text_b, group_text, link_text)]
        sides = (a, upto_a[both]), (b, upto_b[both])
        groups = self._groups(*sides[0], *sides[1], figures[0] + figures[1])
        return Aligned(figures, groups, link_text, a[upto_a[either - 1]], b[upto_b[either - 1]])

    def _groups(self, a, upto_a, b, upto_b, tokens) -> list[str]:
        """Per text SHA-256 of its groups' ids in decimals; ``upto``: tokens up to each group's
        end."""
        group_a = np.repeat(np.arange(len(upto_a)), np.diff(upto_a, prepend=0))
        group_b = np.repeat(np.arange(len(upto_b)), np.diff(upto_b, prepend=0))
        before_b = np.concatenate([[0], upto_b[:-1]]) if len(upto_b) else upto_b
        signs = np.zeros(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + before_b[group_a]] = a.astype(np.int64) * 3
        signs[np.arange(len(b)) + upto_a[group_b]] = b.astype(np.int64) * 3
        signs[upto_a + before_b - 1] += 1
        signs[upto_a + upto_b - 1] += 2
        said, at = buffers(self.decimals.take(pa.array(signs)))
        said = said.tobytes()
        bounds = at[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [
            hashlib.sha256(said[c : d - 1]).hexdigest() if d > c else ""
            for c, d in zip(bounds, bounds[1:])
        ]


def _led(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with a blank before each; unreadable ones are empty."""
    data, offsets = buffers(column)
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
        read = [t if t.decode("utf-8", "replace").encode() == t else b"" for t in texts]
        data, offsets = buffers(pa.array(read, pa.large_binary()))
    full = np.diff(offsets) > 0
    led = np.insert(data, offsets[:-1][full], 0x20)
    return led, offsets + np.concatenate([[0], np.cumsum(full)])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Radix:
    """Pairs as numbers that sort by (part, A id, B id)."""

    def __init__(self, size_a: int, size_b: int):
        self.per_part, self.size_b = -(-size_a // PARTS), size_b
        if self.per_part * PARTS * size_b >= 1 << 32:
            raise ValueError("the vocabularies form more than 2 ** 32 pairs")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a.astype(np.uint64)
        place = (a % np.uint64(PARTS)) * np.uint64(self.per_part) + a // np.uint64(PARTS)
        return place * np.uint64(self.size_b) + b.astype(np.uint64)

    def starts(self) -> np.ndarray:
        """The lowest pair of each part, and the end of the last."""
        return np.arange(PARTS + 1, dtype=np.uint64) * np.uint64(self.per_part * self.size_b)


class Run:
    """Records (pair, document) with their links, until they are written."""

    def __init__(self, radix: Radix):
        self.radix = radix
        self.clear()

    def clear(self) -> None:
        self.keys, self.links, self.docs, self.records = [], [], [], 0

    def add(self, ids: list, found: Aligned) -> None:
        base = len(self.docs)
        pair = self.radix.pairs(found.link_a, found.link_b)
        key = (pair << np.uint64(32)) | (found.link_text + base).astype(np.uint64)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
        self.keys.append(key[first])
        self.links.append(np.diff(np.append(first, len(key))))
        self.records += len(first)
        figures = zip(ids, *[f.tolist() for f in found.figures], found.groups)
        self.docs += [dict(zip(("doc_id", *FIGURES, "groups_sha256"), f)) for f in figures]

    def full(self, records: int) -> bool:
        return self.records >= records or len(self.docs) >= RUN_DOCS

    def rows(self, run: int) -> pa.RecordBatch:
        """The documents (part -1) and the frames of every part that has records."""
        keys, links = np.concatenate(self.keys), np.concatenate(self.links)
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        pairs, docs = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        cuts = np.searchsorted(pairs, self.radix.starts())
        parts, heads, places = [-1], [None], [None]
        for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if low == high:
                continue
            own = pairs[low:high]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(first, len(own)))
            parts.append(part)
            heads.append(packed(steps(own[first]), sizes))
            places.append(packed(steps(docs[low:high]), links[low:high]))
        n = len(parts)
        rows = [self.docs] + [None] * (n - 1)
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([run] * n, pa.int64()), pa.array(parts, pa.int32()),
             pa.array(heads, pa.binary()), pa.array(places, pa.binary()), pa.array(rows, _DOCS)],
            names=["run", "part", "heads", "places", "docs"],
        )


_DOCS = pa.list_(
    pa.struct([("doc_id", pa.int64()), *[(f, pa.int64()) for f in FIGURES], ("groups_sha256", pa.string())])
)


def _radix(path_a: str, path_b: str) -> Radix:
    own = aligner(path_a, path_b)
    return Radix(len(own.a.sizes), len(own.b.sizes))


def runs(
    docs: DataFrame, path_a: str, path_b: str, run_records: int = RUN_RECORDS
) -> DataFrame:
    """(run, part, heads, places, docs): sorted runs of all records, as written by their tasks."""

    def work(batches: Iterator[pa.RecordBatch]):
        own, run, n = aligner(path_a, path_b), Run(_radix(path_a, path_b)), 0
        task = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            run.add(batch.column("doc_id").to_pylist(), own.align(batch.column("text")))
            if run.full(run_records):
                yield run.rows(task + n)
                n += 1
        if run.docs:
            yield run.rows(task + n)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, RUNS)


def merged(frames: list[bytes], size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) per A id of one part, in order: a heap holds the next A id of each run."""
    open_runs, heap = [], []
    for i, frame in enumerate(frames):
        differences, counts = unpacked(frame)
        pairs = restored(differences)
        side = pairs // np.uint32(size_b)
        cuts = np.append(np.flatnonzero(np.append(True, side[1:] != side[:-1])), len(pairs))
        open_runs.append((pairs, counts.astype(np.int64), side, cuts))
        heap.append((int(side[0]), i, 0))
    heapq.heapify(heap)
    while heap:
        a, found = heap[0][0], []
        while heap and heap[0][0] == a:
            _, i, at = heap[0]
            pairs, counts, side, cuts = open_runs[i]
            found.append((pairs[cuts[at] : cuts[at + 1]], counts[cuts[at] : cuts[at + 1]]))
            if at + 2 < len(cuts):
                heapq.heapreplace(heap, (int(side[cuts[at + 1]]), i, at + 1))
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            yield found[0]
            continue
        pairs, place = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate([c for _, c in found]))
        yield pairs, total


def _merge_round(lists: DataFrame, groups: int, size_b: int, last: bool) -> DataFrame:
    """Lists (run, part, heads) merged into one per part and group; the ``last`` round adds
    which pairs have the highest count of their A id."""

    def work(table: pa.Table) -> pa.Table:
        found = list(merged(table.column("heads").to_pylist(), size_b))
        pairs = np.concatenate([p for p, _ in found])
        counts = np.concatenate([c for _, c in found])
        out = [steps(pairs), counts & 0xFFFFFFFF]
        if last:
            out += [counts >> 32, np.concatenate([c == c.max() for _, c in found])]
        elif counts.max() >> 32:
            raise OverflowError("a pair's partial count exceeds 32 bits")
        return pa.table(
            {
                "run": pa.array([table.column("group")[0].as_py()], pa.int64()),
                "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                "heads": pa.array([packed(*out)], pa.binary()),
            }
        )

    grouped = lists.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    return grouped.groupBy("part", "group").applyInArrow(work, "run long, part int, heads binary")


def pair_counts(written: DataFrame, size_b: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, heads): per part one list of pairs, counts and highest counts, from all runs."""
    lists = written.filter("part >= 0").select("run", "part", "heads")
    while True:
        n = lists.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        # Groups are drawn by hash: half of ``fan_in`` on average keeps nearly all below it.
        groups = -(-n // (fan_in // 2)) if n and n > fan_in else 1
        lists = materialize(_merge_round(lists, groups, size_b, groups == 1), "pair-lists")
        if groups == 1:
            return lists.select("part", "heads")


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of the documents, from rows sorted by (bucket, part, kind, run): of each bucket
    the documents come first, then for each part its list and the frames of the runs."""
    bucket, sums, docs, known = None, {}, {}, None

    def done():
        for run, rows in docs.items():
            columns = [[r[c] for r in rows] for c in ("doc_id", *FIGURES)]
            best, total = sums[run]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(best), pa.array(total),
                 pa.array([r["groups_sha256"] for r in rows], pa.string())],
                names=["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"],
            )

    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("bucket", "part", "run", "heads", "places")}
            if row["bucket"] != bucket:
                yield from done()
                bucket, sums, docs = row["bucket"], {}, {}
            if row["part"] < 0:
                docs[row["run"]] = batch.column("docs")[i].as_py()
                sums[row["run"]] = [np.zeros(len(docs[row["run"]]), np.int64) for _ in range(2)]
            elif row["places"] is None:
                differences, low, high, top = unpacked(row["heads"])
                counts = low.astype(np.int64) | high.astype(np.int64) << 32
                known = restored(differences), counts, top.astype(bool)
            else:
                pairs, counts, top = known
                differences, sizes = unpacked(row["heads"])
                at = np.repeat(np.searchsorted(pairs, restored(differences)), sizes)
                of, links = unpacked(row["places"])
                of, links = restored(of), links.astype(np.int64)
                best, total = sums[row["run"]]
                np.add.at(total, of, counts[at] * links)
                np.add.at(best, of, top[at] * links)
    yield from done()


def align(
    docs: DataFrame, path_a: str, path_b: str, run_records: int = RUN_RECORDS, fan_in: int = FAN_IN
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    The paths name a byte-level BPE file and a sentencepiece model that every executor can read.
    ``run_records`` bounds a run, ``fan_in`` (4 or more) the runs merged at a time.
    """
    import sentencepiece

    written = materialize(runs(docs, path_a, path_b, run_records), "alignment-runs")
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    lists = pair_counts(written, size_b, fan_in)
    n = written.filter("part < 0").count()
    buckets = max(1, -(-n // RUNS_BACK))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("places", "binary"), ("docs", f"array<struct<{DOC}>>"))]
    every = lists.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    every = every.select(
        "bucket", "part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("run"), "heads", *none
    )
    own = written.select(
        F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int").alias("bucket"), "part",
        F.lit(1).alias("kind"), "run", "heads", "places", "docs",
    )
    order = ["bucket", "part", "kind", "run"]
    placed = own.unionByName(every).repartition(buckets, "bucket").sortWithinPartitions(*order)
    return placed.mapInArrow(_back, RESULT)
