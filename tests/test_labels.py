import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelspark.operators import association, labelsets, textprofile
from tests.conftest import rows

CATALOGUE = [(i, f"l{i}") for i in range(1, 7)]


def _instances(spark, lists):
    data = [(i, ids) for i, ids in enumerate(lists)]
    return spark.createDataFrame(data, "instance_id bigint, genre_ids array<bigint>")


def _incidence(spark, lists):
    data = [(i, label) for i, ids in enumerate(lists) for label in ids]
    return spark.createDataFrame(data, "instance_id bigint, label_id bigint")


LISTS = [[1, 2], [2, 1], [1, 1, 2], [3], [1, 2, 3, 4], [2], [1, 3, 3]]


def test_both_forms_give_the_same_sets(spark):
    order = ["label_ids", "copies"]
    a = rows(labelsets.label_sets(_instances(spark, LISTS)), *order)
    b = rows(labelsets.label_sets_of_incidence(_incidence(spark, LISTS)), *order)
    assert a == b
    assert ([1, 2], [1, 1], 2) in a and ([1, 2], [2, 1], 1) in a


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=6), min_size=1, max_size=12))
def test_cooccurrence_counts_every_combination(spark, lists):
    want = Counter(p for ids in lists for p in combinations(sorted(ids), 2))
    got = labelsets.label_cooccurrence(labelsets.label_sets(_instances(spark, lists)))
    assert {(r["a"], r["b"]): r["count"] for r in got.collect()} == dict(want)


def test_distribution_and_imbalance(spark):
    sets = labelsets.label_sets(_instances(spark, LISTS))
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    dist = labelsets.label_distribution(sets, catalogue)
    got = rows(dist.select("label_id", "count", "support", "position"), "position")
    assert [g[:2] for g in got] == [(1, 6), (2, 5), (3, 4), (4, 1)]
    assert got[0][2] == pytest.approx(600 / 7)
    row = labelsets.label_imbalance(dist).first()
    counts = [1, 4, 5, 6]
    gini = 2 * sum((i + 1) * x for i, x in enumerate(counts)) / (4 * 16) - 5 / 4
    assert row["gini"] == pytest.approx(gini)
    assert row["head_ratio"] == pytest.approx(15 / 16)
    assert row["tail_labels"] == 0 and row["label_instances"] == 16
    same = labelsets.label_distribution_of_incidence(_incidence(spark, LISTS), catalogue)
    assert rows(same, "position") == rows(dist, "position")


def test_sizes_density_histogram(spark):
    sets = labelsets.label_sets(_instances(spark, LISTS + [[1, 2, 3, 4, 5, 6, 1, 2]]))
    row = labelsets.label_density(sets).first()
    assert row["label_density"] == pytest.approx(24 / 8) and row["max_labels"] == 8
    assert rows(labelsets.label_count_histogram(sets), "n_labels") == [(1, 2), (2, 2), (3, 2), (4, 1), (8, 1)]
    assert rows(labelsets.over_labelled(sets)) == [(1,)]
    assert rows(labelsets.label_cardinality(sets)) == [(7,)]


def test_matrix_is_symmetric_with_presence_on_the_diagonal(spark):
    sets = labelsets.label_sets(_instances(spark, LISTS))
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    dist = labelsets.label_distribution(sets, catalogue)
    cells = {(r["a"], r["b"]): r["n_both"] for r in labelsets.cooccurrence_matrix(sets, dist, 3).collect()}
    assert len(cells) == 9
    for (a, b), n in cells.items():
        assert n == cells[b, a] == sum(1 for ids in LISTS if a in ids and b in ids)


def test_unknown_label_in_matrix_is_an_error(spark):
    sets = labelsets.label_sets(_instances(spark, [[1, 99]]))
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    with pytest.raises(Exception, match="label not in the catalogue: 99"):
        labelsets.observed_labels(sets, catalogue).collect()


def test_nmi_and_phi_edges(spark):
    lists = [[1, 2, 3], [1, 2], [1, 3], [1]]
    sets = labelsets.label_sets(_instances(spark, lists))
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    pairs = association.pair_tables(sets, catalogue)
    nmi = {(r["a"], r["b"]): r["nmi"] for r in association.label_nmi(pairs).collect()}
    assert len(nmi) == 15
    assert nmi[4, 5] == 1.0 and nmi[1, 4] == 1.0  # both without variation
    assert nmi[2, 4] == 0.0
    assert nmi[2, 3] == pytest.approx(0.0)
    assert all(0 <= v <= 1 for v in nmi.values())
    phi = {(r["a"], r["b"]): r for r in association.label_phi(pairs).collect()}
    assert phi[1, 2]["phi"] is None and phi[4, 5]["phi"] is None
    assert phi[2, 3]["phi"] == pytest.approx(0.0) and phi[2, 3]["phi_signed"] == pytest.approx(0.0)


def test_phi_has_the_continuity_correction(spark):
    lists = [[1, 2]] * 6 + [[1]] * 2 + [[2]] * 1 + [[3]] * 5
    sets = labelsets.label_sets(_instances(spark, lists))
    catalogue = spark.createDataFrame(CATALOGUE[:2], "id int, name string")
    row = association.label_phi(association.pair_tables(sets, catalogue)).first()
    n, table = 14, [[6, 2], [1, 5]]
    chi2 = 0
    for i in range(2):
        for j in range(2):
            e = sum(table[i]) * (table[0][j] + table[1][j]) / n
            chi2 += (abs(table[i][j] - e) - 0.5) ** 2 / e
    assert row["phi"] == pytest.approx(math.sqrt(chi2 / n))
    assert row["phi_signed"] == pytest.approx((6 * 5 - 2 * 1) / math.sqrt(8 * 6 * 7 * 7))


def test_text_lengths(spark):
    texts = ["x" * n for n in (5, 6, 9, 10, 20)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "instance_id bigint, overview string")
    row = textprofile.text_length_stats(df).first()
    assert (row["avg_chars"], row["median_chars"]) == (10.0, 9.0)
    assert row["p95_chars"] == pytest.approx(18.0)
    assert textprofile.short_texts(df).first()[0] == 3


def test_empty_input(spark):
    empty = spark.createDataFrame([], "instance_id bigint, genre_ids array<bigint>")
    sets = labelsets.label_sets(empty)
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    dist = labelsets.label_distribution(sets, catalogue)
    assert dist.count() == 0
    row = labelsets.label_imbalance(dist).first()
    assert (row["gini"], row["head_ratio"], row["tail_labels"], row["label_instances"]) == (0, 0, 0, 0)
    assert labelsets.label_cooccurrence(sets).count() == 0
