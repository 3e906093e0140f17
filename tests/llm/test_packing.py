"""Packing: tokens against the library, plans against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelspark.llm import packing
from tests.llm.data import awkward, plain, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    """Smallest number of sequences, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def best_fit_decreasing(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def members(sequences):
    found = Counter()
    for lengths, times in sequences:
        for x in lengths:
            found[x] += times
    return found


def test_reduction_keeps_the_best_packing_possible():
    pick = random.Random(1)
    for _ in range(1500):
        capacity = pick.choice([7, 10, 13, 20])
        items = [pick.randint(1, capacity) for _ in range(pick.randint(0, 9))]
        fixed, left = packing.reduce_instance(Counter(items), capacity)
        assert members(fixed) + left == Counter(items)
        n_fixed = sum(times for _, times in fixed)
        assert n_fixed + fewest(list(left.elements()), capacity) == fewest(items, capacity)


def test_best_fit_on_counts_equals_best_fit_on_pieces():
    pick = random.Random(2)
    for _ in range(1500):
        capacity = pick.choice([10, 20, 64])
        counts = Counter(pick.randint(1, capacity) for _ in range(pick.randint(0, 80)))
        found = packing.best_fit(counts, capacity)
        assert members(found) == counts and all(sum(m) <= capacity for m, _ in found)
        assert sum(t for _, t in found) == best_fit_decreasing(list(counts.elements()), capacity)


def test_plan_does_not_grow_with_the_counts():
    pick = random.Random(3)
    counts = {x: pick.randint(1, 50) for x in range(1, 300)}
    small = packing.plan(counts, 300)
    large = packing.plan({x: n * 100_000 for x, n in counts.items()}, 300)
    assert len(large) < 3 * len(small) + 300


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_whole_and_gapless(spark, capacity):
    rows = awkward()
    library = Tokenizer.from_file(PATH)
    got = packing.best_fit_packing(table(spark, rows, clashing=True), PATH, capacity).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[doc_id, n, at, len(part), crc] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.1 * total / capacity + 2


def test_many_pieces_of_one_length(spark):
    parts = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "CAST(7 AS long) AS length")
    got = packing.pack(parts, 20).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
    assert len({r.sequence_id for r in got}) == 2500


def test_lengths_beyond_the_capacity_are_refused(spark):
    parts = spark.sql("SELECT 1L AS doc_id, 0 AS piece, 21L AS length")
    with pytest.raises(ValueError):
        packing.pack(parts, 20)


def test_words_give_the_library_ids():
    pick = random.Random(4)
    signs = list("ab's  \n\t'tmdv5!?é中½Ⅷ_-́.,|<>") + [
        "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "a.'s", "A-'S", "\x1c", "\U0001f600",
    ]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 30))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    own = packing.Tokenizer(PATH)
    import pyarrow as pa

    for run in (texts, [t for t in texts if "<|" not in t]):
        for text, ids in zip(run, own.encode(pa.array(run))):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(
                text, add_special_tokens=False
            ).ids


def test_empty_table(spark):
    assert packing.best_fit_packing(table(spark, []), PATH).count() == 0
    assert plain(packing.best_fit_packing(table(spark, [(1, None)]), PATH))[0][:4] == (1, 0, 0, 1)
