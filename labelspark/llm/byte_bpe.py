"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries come from arrays of code-point classes, without a regular expression. The automaton's
state is the place where the present run of characters was opened. A character's transition
function is either constant (it opens a run, whatever came before) or the identity (it continues
one). Such functions compose associatively, and a composition is its last constant one, so a
running maximum over positions scans them for a whole slice of texts. What is left, white space
before a word and letters behind an apostrophe, is settled by the classes beside it.

Slices between boundaries are numbered by Arrow's dictionary encoding; each distinct slice is
merged once and kept in a bounded memo. Ids, decimals and decoded bytes of all tokens are then
gathered by number.

Defined cases: null text is empty (no ids, SHA-256 of nothing); repeated rows each give a row;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelspark.llm.common import Memo, buffers, pieces, slices

OTHER, LETTER, NUMBER, BLANK, SPACE, NONE = 0, 1, 2, 3, 4, 5

# Code points with the property White_Space besides U+0020 (BLANK).
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# What may follow an apostrophe as a token of its own with it.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
        np.uint8, 0x110000,
    )
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    return table


def last_constant(constant: np.ndarray) -> np.ndarray:
    """For each position the last one at or before it whose function is constant.

    The scan of composed transition functions; position 0 must be constant.
    """
    return np.maximum.accumulate(np.where(constant, np.arange(len(constant)), 0))


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a token starts. ``codes``: code points of texts laid end to end; ``first``:
    True at the first one of each text."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[codes]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[first] = NONE
    after = np.full_like(kind, NONE)
    after[:-1] = np.where(first[1:], NONE, kind[1:])

    white = (kind == BLANK) | (kind == SPACE)
    white_before = (before == BLANK) | (before == SPACE)
    white_after = (after == BLANK) | (after == SPACE)
    # The state is the place where the present run was opened. A character that continues a run
    # leaves it as it is, any other sets it to its own place.
    opens = np.where(white, ~white_before, kind != before)
    opened = last_constant(opens)
    at_open = opened == np.arange(n)
    # A run of white space gives its last character away, unless the text ends there.
    white_start = white & (at_open | (~white_after & (after != NONE)))
    # A blank before another run belongs to that run.
    word_start = ~white & at_open & (before != BLANK)
    start = white_start | word_start

    # An apostrophe that opens its token may take letters with it.
    quote = np.flatnonzero((codes == 0x27) & word_start)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        inner = np.concatenate([~first, np.zeros(2, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        has_one = inner[quote + 1]
        has_two = has_one & inner[quote + 2]
        short = has_one & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quote), bool)
        for a, b in LONG_ENDINGS:
            long |= has_two & (one == ord(a)) & (two == ord(b))
        size = np.where(short, 2, np.where(long, 3, 0))
        opened, size = quote[size > 0], size[size > 0]
        start[opened + 1] = False
        end = opened + size
        start[end[end < n]] = True
    return start


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is joined until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    big = len(ranks)
    pair = [ranks.get(a + b, big) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == big:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], big)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], big)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, with a heap and links, for pieces of any length."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

    for i in range(n):
        offer(i)
    while heap:
        _, i, size, next_size = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or len(parts[i]) != size or j < 0 or len(parts[j]) != next_size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Ranks of one vocabulary file and the memo of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)
            }
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.memo = Memo(self._merge_all, 3)

    def _merge_all(self, found: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """(ids, their decimals, the bytes they decode to) of each piece."""
        out = []
        for piece in found:
            ids = merge(piece, self.ranks)
            decoded = b"".join([self.tokens[i] for i in ids])
            packed = struct.pack(f"<{len(ids)}I", *ids)
            out.append((packed, "".join([f"{i}," for i in ids]).encode(), decoded))
        return out

    def encode(self, column: pa.Array) -> list[list[bytes]]:
        """Ids (little-endian), their decimals (a comma behind each) and decoded bytes."""
        data, offsets = buffers(column)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(
            data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"),
            np.uint32,
        )
        first = np.zeros(len(codes), bool)
        opening = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
        first[opening] = True
        starts = lead[boundaries(codes, first)]
        numbered = pieces(data, starts).dictionary_encode()
        known = self.memo.numbers(numbered.dictionary)
        number = known[numbered.indices.to_numpy(zero_copy_only=False)]
        runs, out = np.searchsorted(starts, offsets), []
        for column in range(3):
            found, ends = self.memo.gather(column, number)
            bounds = ends[runs].tolist()
            out.append([found[a:b] for a, b in zip(bounds, bounds[1:])])
        return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every text and the bytes they decode to.

    ``vocabulary`` is the path of a rank file that every executor can read.
    """

    def run(batches):
        own = codec(vocabulary)
        for batch in slices(batches):
            ids, _, decoded = own.encode(batch.column("text"))
            arrays = [np.frombuffer(i, np.uint32).astype(np.int32) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array(arrays, pa.list_(pa.int32())),
                    pa.array(decoded, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` gives, made
    where the ids are, so that they need not be written."""

    def run(batches):
        own = codec(vocabulary)
        for batch in slices(batches):
            ids, decimals, decoded = own.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(d[:-1]).hexdigest() for d in decimals]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
