"""Words of whole slices of texts as arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from labelspark.llm.common import buffers

# Texts are cut into words in runs of about this many bytes: arrays of words take some 60 bytes
# per byte of text while they are made.
WORDS_BYTES = 512 << 10

# Odd multipliers of the rolling hashes.
WORD_FACTOR = 0x9E3779B97F4A7C15
GRAM_FACTOR = 0xC2B2AE3D27D4EB4F
SECOND_FACTOR = 0x165667B19E3779F9

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Powers:
    """Powers of an odd factor and of its inverse modulo 2 ** 64, as far as needed."""

    def __init__(self, factor: int):
        self.factors = [factor, pow(factor, -1, 1 << 64)]
        self.tables = [np.ones(1, np.uint64)] * 2

    def up_to(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) <= n:
            size = (n // 65_536 + 1) * 65_536 + 1
            self.tables = []
            for factor in self.factors:
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                self.tables.append(np.multiply.accumulate(steps))
        return self.tables

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of ``values`` from each start to each end."""
        forth, back = self.up_to(len(values))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forth[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * back[starts]


class Words:
    """The words of a slice of texts; ``inside`` says which bytes belong to words."""

    def __init__(self, column: pa.Array, powers: Powers, inside: np.ndarray):
        self.data, self.offsets = buffers(column)
        data, offsets = self.data, self.offsets
        within = inside[data]
        opens, closes = within.copy(), within.copy()
        opens[1:] &= ~within[:-1]
        closes[:-1] &= ~within[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        opens[edges] = within[edges]
        closes[edges[1:] - 1] = within[edges[1:] - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text_of = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.text_of, minlength=len(offsets) - 1)
        # One past the last word of each word's text, and the first word of each text.
        self.last_of = np.cumsum(self.counts)[self.text_of]
        self.first = np.cumsum(self.counts) - self.counts
        lowered = LOWER[data].astype(np.uint64) + np.uint64(1)
        self.hashes = mixed(powers.sums(lowered, self.starts, self.ends))

    def lowered(self) -> bytes:
        return LOWER[self.data].tobytes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Hashes spread so that their order says nothing about what was hashed."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(GRAM_FACTOR)
    return values ^ (values >> np.uint64(29))


def over(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``size`` consecutive values, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def lowest_grams(words: Words, gram: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the ``gram``-word grams that are the smallest of ``window``
    consecutive ones inside one text."""
    n = len(words.hashes) - gram - window + 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.full(n + window - 1, seed, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(WORD_FACTOR) + words.hashes[i : i + n + window - 1]
    grams = mixed(grams)
    lowest = over(grams, window, np.minimum)
    # Windows that reach into the next text say nothing; 0 is no minimum of any of them.
    lowest[np.arange(n) + gram + window - 1 > words.last_of[:n]] = 0
    around = np.zeros(n + 2 * (window - 1), np.uint64)
    around[window - 1 : window - 1 + n] = lowest
    at = np.flatnonzero((over(around, window, np.maximum) == grams) & (grams > 0))
    return at, grams[at]
