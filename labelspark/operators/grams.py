"""N-grams of token lists as numbers, counted with numpy and Arrow inside tasks.

A task reads (instance_id, n_rows, texts) in batches, each instance a list of token lists. Words
become numbers of their batch, an n-gram the number of its (n-1)-gram and its last word, and
sorting these numbers counts them; a string is made only for n-grams that are asked for. Between
tasks an n-gram is named by a 64-bit hash, which only chooses what is counted: whatever is
returned was compared as a string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Tokens that are counted together. An instance is never split, so a longer one stands alone.
CHUNK_TOKENS = 1 << 20
# N-grams that a task's summary holds before it drops the rarest half.
SUMMARY_TERMS = 1 << 20

_ROWS = 1 << 18
# Key and position are sorted as one number where both fit.
_POSITION_BITS = 21


@dataclass
class Level:
    """The n-grams of one length in a chunk, sorted: distinct ones, and (n-gram, instance) pairs."""

    first: np.ndarray  # token position of a distinct n-gram
    cf: np.ndarray
    df: np.ndarray
    pair_gram: np.ndarray  # number of the pair's n-gram
    pair_owner: np.ndarray
    pair_tf: np.ndarray


@dataclass
class Chunk:
    rows: pa.RecordBatch
    ids: np.ndarray
    words: np.ndarray
    levels: dict[int, Level]

    @cached_property
    def _word_hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    def hashes(self, n: int) -> np.ndarray:
        first = self.levels[n].first
        return gram_hashes([self._word_hashes[self.ids[first + j]] for j in range(n)])

    def terms(self, n: int, which: np.ndarray) -> list[str]:
        first = self.levels[n].first[which]
        return [" ".join(t) for t in zip(*(self.words[self.ids[first + j]] for j in range(n)))]


def word_hashes(words: np.ndarray) -> np.ndarray:
    """The same in every process."""
    return pd.util.hash_array(words, categorize=False) if len(words) else np.empty(0, np.uint64)


def gram_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash per n-gram from the hashes of its words, in order."""
    found = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        found = found * np.uint64(0x9E3779B97F4A7C15) + part
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(29)
    return found


def _ends(changes: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(changes, size))


def _sorted_by(keys: np.ndarray, top: int) -> np.ndarray:
    """Positions by key, then position."""
    if len(keys) < 1 << _POSITION_BITS and top < 1 << (63 - _POSITION_BITS):
        packed = np.sort((keys << _POSITION_BITS) | np.arange(len(keys)))
        return packed & ((1 << _POSITION_BITS) - 1)
    return np.argsort(keys, kind="stable")


def _chunk(rows: pa.RecordBatch, lo: int, hi: int) -> Chunk:
    lists = rows.column("texts")
    texts = lists.flatten()
    per_instance = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    per_text = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    coded = texts.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(per_text)), per_text)
    owner = np.repeat(np.arange(len(per_instance)), per_instance)[text]

    levels = {}
    at, keys, top = np.arange(len(ids)), ids, len(words)
    for n in range(1, hi + 1):
        if n > 1:
            whole = at + (n - 1) < len(ids)
            whole[whole] = text[at[whole]] == text[at[whole] + (n - 1)]
            at, keys = at[whole], keys[whole] * len(words) + ids[at[whole] + (n - 1)]
            top *= max(1, len(words))
        order = _sorted_by(keys, top)
        by_key, by_owner = keys[order], owner[at[order]]
        new = np.ones(len(order), bool)
        new[1:] = by_key[1:] != by_key[:-1]
        if n >= lo:
            apart = new.copy()
            apart[1:] |= by_owner[1:] != by_owner[:-1]
            starts, pairs = np.flatnonzero(new), np.flatnonzero(apart)
            gram = np.cumsum(new)[pairs] - 1
            levels[n] = Level(
                at[order[starts]], _ends(starts, len(order)),
                np.bincount(gram, minlength=len(starts)), gram, by_owner[pairs], _ends(pairs, len(order)),
            )
        if n < hi:
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.cumsum(new) - 1
            keys, top = ranks, len(order)
    return Chunk(rows, ids, words, levels)


def chunks(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[Chunk]:
    for batch in batches:
        lists = batch.column("texts")
        per_text = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)))
        upto = per_text[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, done + CHUNK_TOKENS, side="right")))
            yield _chunk(batch.slice(start, stop - start), lo, hi)
            start, done = stop, int(upto[stop - 1])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums of cf and df per hash, and the lowest base."""
    h, cf, df, base = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(h)
    h = h[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    if not len(starts):
        return h, cf, df, base
    return (
        h[starts], np.add.reduceat(cf[order], starts), np.add.reduceat(df[order], starts),
        np.minimum.reduceat(base[order], starts),
    )


def summary(lo: int, hi: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(hash, cf, df, slack) of a task: its frequent n-grams, and in a row without hash the most
    that any n-gram's counts can lack, 0 while nothing was dropped.

    ``base`` is what an n-gram can have had before it was last taken in; it is dropped if its
    count and base do not pass the new bound, so no lack exceeds that bound.
    """

    def run(batches):
        bound, held = 0, [(np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))]
        waiting = 0
        for chunk in chunks(batches, lo, hi):
            for n, level in chunk.levels.items():
                held.append((chunk.hashes(n), level.cf, level.df, np.full(len(level.cf), bound)))
                waiting += len(level.cf)
            if waiting > SUMMARY_TERMS:
                merged, waiting = _merged(held), 0
                if len(merged[0]) > SUMMARY_TERMS:
                    most = merged[1] + merged[3]
                    bound = max(bound, int(np.partition(most, -(SUMMARY_TERMS // 2))[-(SUMMARY_TERMS // 2)]))
                    merged = tuple(column[most > bound] for column in merged)
                held = [merged]
        h, cf, df, _ = _merged(held)
        yield pa.record_batch(
            {"hash": pa.array([None], pa.int64()), "cf": [0], "df": [0], "slack": [bound]}
        )
        for at in range(0, len(h), _ROWS):
            some = slice(at, at + _ROWS)
            yield pa.record_batch({
                "hash": h[some].view(np.int64), "cf": cf[some], "df": df[some],
                "slack": np.zeros(len(h[some]), np.int64),
            })

    return run


def counts_of(hashes: np.ndarray, lo: int, hi: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, df, cf) per chunk of the n-grams with one of the sorted ``hashes`` (uint64)."""

    def run(batches):
        for chunk in chunks(batches, lo, hi):
            for n, level in chunk.levels.items():
                which = np.flatnonzero(among(chunk.hashes(n), hashes))
                yield pa.record_batch({
                    "term": pa.array(chunk.terms(n, which), pa.string()),
                    "df": level.df[which].astype(np.int64), "cf": level.cf[which].astype(np.int64),
                })

    return run


def among(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(found), bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


def weights_of(
    vocabulary: pa.Table, lo: int, hi: int, sublinear: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(instance_id, term, term_id, rarity, tf, weight) of the n-grams in ``vocabulary``, of unit
    length per instance, by instance and rarity."""
    vocabulary = vocabulary.combine_chunks()
    terms = vocabulary["term"].to_pylist()

    def run(batches):
        row_of = {term: i for i, term in enumerate(terms)}
        idf = vocabulary["idf"].to_numpy()
        rarity = vocabulary["rarity"].to_numpy()
        split = [t.split(" ") for t in terms]
        known = {}
        for n in range(lo, hi + 1):
            parts = [np.array(column, object) for column in zip(*(t for t in split if len(t) == n))]
            known[n] = np.sort(gram_hashes([word_hashes(p) for p in parts])) if parts else np.empty(0, np.uint64)
        for chunk in chunks(batches, lo, hi):
            found = [np.empty((3, 0), np.int64)]
            for n, level in chunk.levels.items():
                which = np.flatnonzero(among(chunk.hashes(n), known[n]))
                row = np.full(len(level.cf), -1)
                row[which] = [row_of.get(t, -1) for t in chunk.terms(n, which)]
                pair_row = row[level.pair_gram]
                held = pair_row >= 0
                found.append(np.stack([level.pair_owner[held], pair_row[held], level.pair_tf[held]]))
            owner, row, tf = np.concatenate(found, axis=1)
            order = np.lexsort((rarity[row], owner))
            owner, row, tf = owner[order], row[order], tf[order]
            raw = ((1 + np.log(tf)) if sublinear else tf.astype(float)) * idf[row]
            norm = np.sqrt(np.bincount(owner, raw * raw, minlength=chunk.rows.num_rows))
            weight = raw / norm[owner]
            for at in range(0, len(owner), _ROWS):
                some = slice(at, at + _ROWS)
                of = vocabulary.take(pa.array(row[some])).combine_chunks()
                columns = {
                    "instance_id": chunk.rows.column("instance_id").take(pa.array(owner[some])),
                    **{c: of[c].combine_chunks() for c in ("term", "term_id", "rarity")},
                    "tf": tf[some], "weight": weight[some],
                }
                yield pa.record_batch({c: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for c, a in columns.items()})

    return run
