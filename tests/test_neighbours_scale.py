"""The exact search keeps what it writes in proportion to queries and training vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspark.operators import neighbours, similarity

neighbours_type = pa.struct(
    {"rep": pa.int64(), "terms": pa.list_(pa.int32()), "weights": pa.list_(pa.float64())}
)


def _vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    found = []
    for rep in range(n):
        terms = np.sort(rng.choice(np.arange(1, 31), 8, replace=False))
        weights = rng.random(8) + 0.1
        weights /= np.sqrt((weights * weights).sum())
        lead = int(terms[weights.argmax()])
        found.append((rep, terms.tolist(), weights.tolist(), lead))
    return found, spark.createDataFrame(
        found, "rep bigint, terms array<int>, weights array<double>, lead int"
    )


def test_written_rows_do_not_grow_with_pairs(spark, monkeypatch):
    k, sizes = 3, {}
    written = neighbours.materialize

    def counted(df, name, *args):
        found = written(df, name, *args)
        sizes[name] = found.count()
        return found

    for name, value in (("TILE_ROWS", 4), ("TASK_BLOCKS", 2), ("TASK_TILES", 3)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "materialize", counted)
    queries, q = _vectors(spark, 70, 1)
    train, t = _vectors(spark, 90, 2)
    got = {}
    for r in neighbours.nearest_vectors(q, t, k).collect():
        got.setdefault(r["query"], []).append((round(2 - 2 * r["cosine"], 9), r["rep"]))
    assert max(sizes.values()) <= k * len(queries)

    def dense(rows):
        matrix = np.zeros((len(rows), 31))
        for rep, terms, weights, _ in rows:
            matrix[rep, terms] = weights
        return matrix

    distances = np.round(2 - 2 * dense(queries) @ dense(train).T, 9)
    for rep, row in enumerate(distances):
        order = np.lexsort((np.arange(len(train)), row))[:k]
        assert sorted(got[rep]) == [(row[i], i) for i in order if row[i] < 2]


def test_near_duplicates_write_no_list_per_term(spark, monkeypatch):
    """All vectors share one heavy term; what is written holds each of them once."""
    sizes, written = {}, similarity.materialize

    def counted(df, name, *args):
        found = written(df, name, *args)
        sizes[name] = found.count()
        return found

    monkeypatch.setattr(similarity, "SPLIT_ROWS", 8)
    monkeypatch.setattr(similarity, "materialize", counted)
    rows = [(rep, 1, 0.95) for rep in range(40)] + [
        (rep, 2 + rep % 20 + 20 * j, ((1 - 0.95**2) / 3) ** 0.5) for rep in range(40) for j in range(3)
    ]
    vectors = spark.createDataFrame(rows, "rep bigint, rarity int, weight double")
    found = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_vectors(vectors, 0.9).collect()}
    assert found == {
        (a, b): 1.0 if (b - a) % 20 == 0 else 0.9025 for a in range(40) for b in range(a + 1, 40)
    }
    assert max(sizes.values()) <= 40


@pytest.mark.parametrize(("share", "entries"), [(50, 1_000_000), (50, 7), (10**9, 7)])
def test_sketches_leave_few_pairs_to_multiply(monkeypatch, share, entries):
    """Blocks with few similar vectors are not multiplied as a whole; what is found is the same
    whether sketches or whole products are used."""
    pick = np.random.default_rng(3)
    n, n_terms = 60, 300
    matrix = np.zeros((2 * n, n_terms + 1))
    for row in matrix:
        row[pick.choice(n_terms, 12, replace=False) + 1] = pick.random(12) + 0.1
    matrix[n : n + 5] = matrix[:5]
    matrix[n : n + 5, 1:4] += 0.2
    matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
    blocks = [
        pa.array([
            {"rep": i, "terms": np.flatnonzero(matrix[i]).tolist(), "weights": matrix[i][matrix[i] > 0].tolist()}
            for i in reps
        ], neighbours_type)
        for reps in (range(n), range(n, 2 * n))
    ]
    monkeypatch.setattr(neighbours, "POSSIBLE_SHARE", share)
    monkeypatch.setattr(neighbours, "DOT_PRODUCTS", entries)
    whole, made = neighbours._cosines, []
    monkeypatch.setattr(neighbours, "_cosines", lambda *args: made.append(1) or whole(*args))
    a, b, cosines = neighbours._pairs_from(*blocks, 0.8)
    assert bool(made) == (share > n * n)
    want = {(i, j): matrix[i] @ matrix[j] for i in range(n) for j in range(n, 2 * n) if matrix[i] @ matrix[j] >= 0.8}
    assert len(want) == 5 and dict(zip(zip(a.tolist(), b.tolist()), cosines)) == pytest.approx(want)


def test_every_task_meets_as_many_blocks_and_tiles(spark):
    packed = spark.range(32).selectExpr("id AS tile", "array(id) AS packed")
    pairs = neighbours.block_pairs(packed, packed)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 32 * 32
    # 4 blocks and a third of the 32 tiles, at 4 cores and partitions.
    assert len(sizes) == 8 * 3 and max(sizes) == 4 * 11 and min(sizes) == 4 * 10


def test_products_of_a_few_queries_are_held_at_a_time(monkeypatch):
    """However many terms are frequent or rare, the same cosines come in parts of few queries."""
    pick = np.random.default_rng(5)
    a, b = (pick.random((n, 40)) * (pick.random((n, 40)) < 0.5) for n in (20, 30))
    entries = [neighbours._by_term((*np.nonzero(m), m[np.nonzero(m)])) for m in (a, b)]
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 6)
    for terms, products in ((2048, 100_000), (3, 50), (0, 1)):
        monkeypatch.setattr(neighbours, "DENSE_TERMS", terms or 1)
        monkeypatch.setattr(neighbours, "DENSE_SHARE", 1e-9 if not terms else 300)
        monkeypatch.setattr(neighbours, "SLICE_PRODUCTS", products)
        parts = list(neighbours._products((20, 30), *entries))
        assert [low for low, _ in parts] == [0, 6, 12, 18]
        assert np.allclose(np.concatenate([p for _, p in parts]), a @ b.T)
