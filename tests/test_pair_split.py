"""The split by label pairs against plain Python, and against serving one pair at a time."""

import random
from collections import Counter
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from labelspark.operators import pair_split, split


def pairs_of(labels):
    return list(combinations_with_replacement(sorted(set(labels)), 2)) or [None]


def made(seed, n, n_labels, width):
    pick = random.Random(seed)
    return [(i, [min(int(pick.expovariate(0.25)), n_labels - 1) for _ in range(pick.randint(0, width))]) for i in range(n)]


def one_pair_at_a_time(rows, share):
    """Deviation per pair of the sequential greedy: the pair with fewest open sets first."""
    sets = Counter(tuple(sorted(set(ls))) for _, ls in rows)
    lack, holders, taken = Counter(), {}, {}
    for s, n in sets.items():
        taken[s] = int(n * share + 1e-9)
        rest = n * share - taken[s]
        for p in pairs_of(s):
            if rest > 1e-9:
                lack[p] += rest
                holders.setdefault(p, set()).add(s)
    while holders:
        pair = min(holders, key=lambda p: (len(holders[p]), str(p)))
        own = sorted(holders[pair], key=lambda s: (-sum(lack[p] for p in pairs_of(s)), s))
        for at, s in enumerate(own, 1):
            goes = at <= lack[pair] + 0.5 if at == 1 else len(own) and at <= first_lack + 0.5
            if at == 1:
                first_lack = lack[pair]
            if goes:
                taken[s] += 1
                for p in pairs_of(s):
                    lack[p] -= 1
        for s in own:
            for p in pairs_of(s):
                holders[p].discard(s)
                if not holders[p]:
                    del holders[p]
    return deviations(rows, taken, share)


def deviations(rows, taken, share):
    n, v = Counter(), Counter()
    for s, size in Counter(tuple(sorted(set(ls))) for _, ls in rows).items():
        for p in pairs_of(s):
            n[p] += size
            v[p] += taken[s]
    return {p: v[p] - n[p] * share for p in n}


def split_of(spark, rows, share, seed=None):
    df = spark.createDataFrame(rows, "instance_id bigint, genre_ids array<bigint>")
    return df, pair_split.second_order_split(df, share, seed)


@pytest.mark.parametrize(("seed", "n", "n_labels", "width"), [(1, 300, 12, 3), (2, 150, 30, 6)])
def test_pairs_are_as_even_as_one_at_a_time(spark, seed, n, n_labels, width):
    rows, share = made(seed, n, n_labels, width), 0.2
    df, parts = split_of(spark, rows, share)
    got = {r.instance_id: r.is_validation for r in parts.collect()}
    assert len(got) == n
    taken = Counter()
    for i, ls in rows:
        taken[tuple(sorted(set(ls)))] += got[i]
    mine, other = deviations(rows, taken, share), one_pair_at_a_time(rows, share)
    plain = Counter()
    simple = {r.instance_id: r.is_validation for r in split.stratified_split(df, share).collect()}
    for i, ls in rows:
        plain[tuple(sorted(set(ls)))] += simple[i]
    before = deviations(rows, plain, share)
    def size(d):
        return sum(x * x for x in d.values())

    assert size(mine) <= size(other) and size(mine) < 0.6 * size(before)
    # Within one row is not always possible here; few pairs are beyond it, and not far.
    far = [d for d in mine.values() if abs(d) > 1 + 1e-9]
    assert len(far) <= 5 and max(map(abs, mine.values())) <= 1.5
    # No set is further than two rows from its share, and no single row could move to the good.
    for s, total in Counter(tuple(sorted(set(ls))) for _, ls in rows).items():
        v = taken[s] - int(total * share + 1e-9)
        assert -1 <= v <= 2
        for way, possible in ((1, v < 2 and taken[s] < total), (-1, v > -1 and taken[s] > 0)):
            assert not possible or sum(1 + 2 * way * mine[p] for p in pairs_of(s)) > -1e-6
    shares = {(r.a, r.b): (r.n, r.n_validation) for r in pair_split.pair_shares(df, parts).collect()}
    assert {p: v - m * share for p, (m, v) in shares.items()} == pytest.approx(
        {p: d for p, d in mine.items() if p}
    )


def test_unique_label_sets_keep_pairs_within_a_row(spark):
    """Every row has a set of its own, where sets alone say nothing; pairs are disjoint."""
    rows = [(g * 10 + k, [g * 2, g * 2 + 1, 1000 + g * 10 + k]) for g in range(8) for k in range(10)]
    _, parts = split_of(spark, rows, 0.2)
    got = {r.instance_id for r in parts.filter("is_validation").collect()}
    assert [sum(g * 10 <= i < g * 10 + 10 for i in got) for g in range(8)] == [2] * 8


def test_nulls_hot_sets_seeds_and_bounds(spark):
    rows = [(i, [1, 2]) for i in range(1000)] + [(2000, None), (2001, []), (2002, [None, 3]), (None, [3])]
    df, parts = split_of(spark, rows, 0.25)
    found = parts.collect()
    assert len(found) == 1004 and sum(r.is_validation for r in found if r.set_key == "1,2") == 250
    assert {r.set_key for r in found} == {"1,2", "", "3"}
    other = pair_split.second_order_split(df, 0.25, seed=7)
    assert sum(r.is_validation for r in other.collect() if r.set_key == "1,2") == 250
    changed = other.join(parts.withColumnRenamed("is_validation", "was").drop("set_key"), "instance_id")
    assert changed.filter(F.col("was") != F.col("is_validation")).count() > 100
    assert split_of(spark, [], 0.2)[1].count() == 0
    for bad in (0, 1):
        with pytest.raises(ValueError):
            pair_split.second_order_split(df, bad)
