"""Exact k nearest neighbours between TF-IDF vectors.

Distances are Euclidean between unit vectors, so squared distance is 2 - 2 * cosine; an
instance without a known term is the zero vector: distance 0 to another zero vector and
squared distance 1 to any unit vector.

Training vectors are placed in *tiles* of limited size, together with vectors that share
their heaviest term. A query first looks into the tile of its own heaviest term; the k-th
cosine found there is a threshold. Then blocks of queries meet tiles, a few of either in a task:
both are written once and read by every task that needs them, so nothing is repeated on disk.
Inside a task a query looks only into tiles that could hold something above its threshold, which
rises with what the task has found, and only its k best leave the task. Where all vectors are
about equally far from each other no exact search can leave much out: then the time grows with
queries times tiles, while disk and memory do not. Pairs are never written out, and no task holds
a frequent term, a copied text or a whole side.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.checks import require
from labelspark.operators import projection
from labelspark.operators.vectors import instance_vectors, representatives, vector_groups
from labelspark.session import materialize, work_partitions

# The task functions below travel with the job; executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors per tile and queries per task: both bound the memory of one task.
TILE_ROWS = 2048
QUERY_ROWS = 2048

# Blocks of queries and tiles that meet in one task.
TASK_BLOCKS = 4
TASK_TILES = 16

# Lists searched per query where a search by lists is asked for: at sf0.01 and sf0.1 these find
# 0.98 and 0.91 of the 10 neighbours, of 27 and 89 lists.
PROBES = 16

# Trained lists at most; their centres are fitted on the driver.
MAX_LISTS = 1024

# A term whose pairs fill more than one in this many cells of a task counts as frequent.
DENSE_SHARE = 300

# Frequent terms at most; queries multiplied at once, and products of rare terms made at once.
DENSE_TERMS = 2048
SLICE_ROWS = 256
SLICE_PRODUCTS = 100_000

# Parts of a sketch, rows of sketches multiplied at once, and the slack for their rounding.
SKETCH_DIMS = 64
SKETCH_ROWS = 256
SKETCH_SLACK = 1e-4

# Pairs that sketches leave are multiplied one by one if they are one in so many at most, in
# slices of so many entries.
POSSIBLE_SHARE = 50
DOT_PRODUCTS = 1_000_000

# Distances are rounded to this many digits before ranking; slack keeps pruning safe.
DIGITS = 9
SLACK = 1e-8


def check_k(k: int) -> None:
    require("k", k, "1 or more", k >= 1)


def _tiling(leads: DataFrame) -> DataFrame:
    """(lead, first_tile, tiles): where vectors with this heaviest term are placed.

    A lead term with many vectors gets several tiles of its own, terms with few share one.
    The running sum sees one row per vocabulary term.
    """
    sizes = leads.groupBy("lead").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("lead")) - F.col("n")
    own = F.ceil(F.col("n") / TILE_ROWS).cast("bigint")
    return (
        sizes.withColumn("running", running)
        .withColumn("tiles", own)
        .select("lead", F.floor(F.col("running") / TILE_ROWS).alias("first_tile"), "tiles")
    )


def _tile(rep: str):
    return F.col("first_tile") + F.pmod(F.xxhash64(rep), F.col("tiles"))


def _nearest(queries, tile, k: int):
    """(query, rep, cosine, distance) of the k nearest vectors of a tile for each query, above
    its threshold. ``queries`` is (thresholds, entries), ``tile`` is (reps, entries), both with
    entries as ``_flat`` gives them; queries are named by their place."""
    thresholds, (q_rows, q_terms, q_weights) = queries
    reps, (t_rows, t_terms, t_weights) = tile
    q_terms, t_terms, kept_q, kept_t = _shared(q_terms, t_terms)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low, cosines in _products(
        (len(thresholds), len(reps)),
        (q_rows[kept_q], q_terms, q_weights[kept_q]),
        (t_rows[kept_t], t_terms, t_weights[kept_t]),
    ):
        highest = cosines.max(axis=1)
        asking = np.flatnonzero((highest >= thresholds[low : low + len(cosines)]) & (highest > 0))
        cosines = cosines[asking]
        at_q, at_t = np.nonzero((cosines >= thresholds[low + asking, None]) & (cosines > 0))
        parts.append((low + asking[at_q], at_t, cosines[at_q, at_t]))
    found_q, found_t, found = (np.concatenate(p) for p in zip(*parts))
    distances = np.round(2 - 2 * found, DIGITS)
    kept = _first_k(found_q, distances, reps[found_t], k)
    return found_q[kept], reps[found_t[kept]], found[kept], distances[kept]


def _first_k(queries: np.ndarray, distances: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by distance, then id, ordered by query."""
    order = np.lexsort((reps, distances, queries))
    ordered = queries[order]
    return order[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < k]


def _best_in_tile(k: int):
    """The k nearest vectors of a tile for each of a task's queries, above their thresholds."""

    def best(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(tile) == 0:
            return pd.DataFrame({"query": [], "rep": [], "cosine": []})
        found, reps, cosines, _ = _nearest(
            (queries["threshold"].to_numpy(), _flat(queries)), (tile["rep"].to_numpy(), _flat(tile)), k
        )
        return pd.DataFrame({"query": queries["rep"].to_numpy()[found], "rep": reps, "cosine": cosines})

    return best


class _Block:
    """A block of queries and the k best found so far for each."""

    def __init__(self, vectors: pa.StructArray, k: int):
        self.k = k
        self.reps = vectors.field("rep").to_numpy()
        self.thresholds = vectors.field("threshold").to_numpy().copy()
        self.entries = _entries(vectors)
        none = np.zeros(0)
        self.best = none.astype(np.int64), none.astype(np.int64), none, none

    def meet(self, tile: pa.StructArray) -> None:
        """Look into a tile with the queries that may find something there."""
        entries = _entries(tile)
        asking = np.flatnonzero(self._bounds(entries) >= self.thresholds - SLACK)
        if not len(asking):
            return
        place = np.full(len(self.reps), -1)
        place[asking] = np.arange(len(asking))
        rows, terms, weights = self.entries
        own = place[rows] >= 0
        mine = place[rows[own]], terms[own], weights[own]
        found = _nearest((self.thresholds[asking], mine), (tile.field("rep").to_numpy(), entries), self.k)
        found = asking[found[0]], *found[1:]
        queries, reps, cosines, distances = (np.concatenate(p) for p in zip(self.best, found))
        kept = _first_k(queries, distances, reps, self.k)
        self.best = queries[kept], reps[kept], cosines[kept], distances[kept]
        full = np.flatnonzero(np.bincount(self.best[0], minlength=len(self.reps)) >= self.k)
        last = np.searchsorted(self.best[0], full, side="right") - 1
        self.thresholds[full] = np.maximum(self.thresholds[full], self.best[2][last] - SLACK)

    def _bounds(self, tile) -> np.ndarray:
        """The highest cosine that a query may have in a tile: shared terms meet their heaviest
        weight there, or one vector has all of them to itself (Cauchy-Schwarz)."""
        _, t_terms, t_weights = tile
        rows, terms, weights = self.entries
        first = np.flatnonzero(np.append(True, t_terms[1:] != t_terms[:-1]))
        held = np.zeros(int(max(t_terms[-1], terms[-1])) + 1)
        held[t_terms[first]] = np.maximum.reduceat(t_weights, first)
        shared = held[terms] > 0
        rows, weights, heaviest = rows[shared], weights[shared], held[terms[shared]]
        by_weight = np.bincount(rows, weights * heaviest, minlength=len(self.reps))
        by_norm = np.sqrt(np.bincount(rows, weights * weights, minlength=len(self.reps)))
        return np.minimum(by_weight, by_norm)

    def rows(self) -> pa.RecordBatch:
        queries, reps, cosines, _ = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.reps[queries]), pa.array(reps), pa.array(cosines)],
            names=["query", "rep", "cosine"],
        )


def _listed(vectors: pa.StructArray):
    """Entries of packed vectors as (row, term, weight), ordered by row and term."""
    terms, weights = vectors.field("terms"), vectors.field("weights")
    rows = np.repeat(np.arange(len(vectors)), np.diff(terms.offsets.to_numpy()))
    terms = terms.flatten().to_numpy(zero_copy_only=False)
    return rows, terms, weights.flatten().to_numpy(zero_copy_only=False)


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 up; numpy sorts 16 bits by radix."""
    small = len(numbers) and numbers.max() < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


def _by_term(entries):
    rows, terms, weights = entries
    order = _order(terms)
    return rows[order], terms[order], weights[order]


def _entries(vectors: pa.StructArray):
    """As ``_flat``, of packed vectors."""
    return _by_term(_listed(vectors))


def _flat(vectors: pd.DataFrame):
    """Entries of all vectors as (row, term, weight), ordered by term."""
    lengths = vectors["terms"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(vectors)), lengths)
    terms = np.concatenate(vectors["terms"].to_list())
    return _by_term((rows, terms, np.concatenate(vectors["weights"].to_list())))


def _shared(q_terms: np.ndarray, t_terms: np.ndarray):
    """Terms of both sides renumbered 0.. without gaps, and masks of the entries kept."""
    size = int(max(q_terms.max(initial=0), t_terms.max(initial=0))) + 1
    shared, of_tile = np.zeros(size, bool), np.zeros(size, bool)
    shared[q_terms], of_tile[t_terms] = True, True
    shared &= of_tile
    number = np.cumsum(shared) - 1
    kept_q, kept_t = shared[q_terms], shared[t_terms]
    return number[q_terms[kept_q]], number[t_terms[kept_t]], kept_q, kept_t


def _cosines(shape: tuple[int, int], queries, tile) -> np.ndarray:
    """Dot products of all queries with all tile vectors, from entries ordered by term."""
    return np.concatenate([np.zeros((0, shape[1])), *(part for _, part in _products(shape, queries, tile))])


def _products(shape: tuple[int, int], queries, tile) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, dot products with all tile vectors) of a few queries at a time, which stay in
    the processor's cache; entries of both sides are ordered by term.

    Frequent terms, of a limited number, go through a dense product; the many rare ones are added
    entry by entry, in slices of a limited number of products. Memory is that of a few matrices of
    the given shape, whatever the texts are.
    """
    q_rows, q_terms, q_weights = queries
    t_rows, t_terms, t_weights = tile
    n_terms = int(q_terms[-1]) + 1 if len(q_terms) else 0
    q_count = np.bincount(q_terms, minlength=n_terms)
    t_count = np.bincount(t_terms, minlength=n_terms)
    frequent = _most(q_count * t_count, shape[0] * shape[1] / DENSE_SHARE)
    place = np.full(n_terms, -1)
    place[frequent] = np.arange(len(frequent))
    at = place[t_terms]
    right = np.zeros((shape[1], len(frequent)))
    right[t_rows[at >= 0], at[at >= 0]] = t_weights[at >= 0]

    order = _order(q_rows)
    q_rows, q_terms, q_weights = q_rows[order], q_terms[order], q_weights[order]
    at = place[q_terms]
    often, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    repeats = t_count[q_terms[rare]]
    starts = (np.cumsum(t_count) - t_count)[q_terms[rare]]
    lows = np.append(np.arange(0, shape[0], SLICE_ROWS), shape[0])
    of_often, of_rare = (np.searchsorted(q_rows[own], lows) for own in (often, rare))
    for i, (low, high) in enumerate(zip(lows[:-1], lows[1:])):
        own = often[of_often[i] : of_often[i + 1]]
        left = np.zeros((high - low, len(frequent)))
        left[q_rows[own] - low, at[own]] = q_weights[own]
        found = left @ right.T
        first, last = of_rare[i], of_rare[i + 1]
        slices = np.cumsum(repeats[first:last]) // SLICE_PRODUCTS
        for own in np.split(np.arange(first, last), np.flatnonzero(np.diff(slices)) + 1):
            if not len(own):
                continue
            n, entries = repeats[own], rare[own]
            upto, rows = np.cumsum(n), q_rows[entries]
            flat = found[rows[0] - low : rows[-1] + 1 - low].reshape(-1)
            at_tile = np.arange(upto[-1]) + np.repeat(starts[own] - upto + n, n)
            cells = np.repeat((rows - rows[0]) * shape[1], n) + t_rows[at_tile]
            products = np.repeat(q_weights[entries], n) * t_weights[at_tile]
            if len(cells) * 8 > len(flat):
                flat += np.bincount(cells, products, minlength=len(flat))
            else:
                np.add.at(flat, cells, products)
        yield low, found


def _most(counts: np.ndarray, least: float) -> np.ndarray:
    """Places of the counts above ``least``, the DENSE_TERMS highest at most."""
    found = np.flatnonzero(counts > least)
    if len(found) > DENSE_TERMS:
        found = np.sort(found[np.argpartition(-counts[found], DENSE_TERMS - 1)[:DENSE_TERMS]])
    return found


def _visit(visits: DataFrame, queries: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """(query, rep, cosine): the k best of every visited (query, tile, threshold).

    Queries of one tile are dealt over as many tasks as needed; each task gets the tile.
    """
    spark = visits.sparkSession
    crowd = visits.groupBy("tile").agg(
        F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")
    )
    asking = (
        visits.join(crowd, "tile")
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .join(queries, "rep")
        .select("tile", "part", "rep", "threshold", "terms", "weights")
    )
    asked = (
        tiles.join(crowd, "tile")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("tile", "part", "rep", "terms", "weights")
    )
    tasks = work_partitions(spark)
    return (
        asking.repartition(tasks, "tile", "part")
        .groupBy("tile", "part")
        .cogroup(asked.repartition(tasks, "tile", "part").groupBy("tile", "part"))
        .applyInPandas(_best_in_tile(k), "query bigint, rep bigint, cosine double")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query, by rounded distance, then id."""
    order = Window.partitionBy("query").orderBy(F.round(2 - 2 * F.col("cosine"), DIGITS), "rep")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")


def _found_at_home(first: DataFrame, k: int, floor: float) -> DataFrame:
    """(rep, threshold): the cosine a vector from another tile has to beat."""
    worst = F.greatest(F.min("cosine") - SLACK, F.lit(floor))
    return first.groupBy(F.col("query").alias("rep")).agg(
        F.when(F.count("*") >= k, worst).otherwise(floor).alias("threshold")
    )


def packed(vectors: DataFrame, *names: str) -> DataFrame:
    """(tile, packed): all vectors of a tile in one row."""
    return vectors.groupBy("tile").agg(F.collect_list(F.struct("rep", *names, "terms", "weights")).alias("packed"))


def block_pairs(blocks: DataFrame, tiles: DataFrame, condition=None) -> DataFrame:
    """(block_id, block, tile_id, tile): packed blocks beside packed tiles, all or those of a
    condition on their ids. Every task takes a few blocks and a few tiles from where they were
    written; no row is copied for another task, and a block's tiles follow each other."""
    # Few tasks are no use either: twice as many as work at a time, if there are as many blocks.
    least = math.ceil((2 * work_partitions(blocks.sparkSession)) ** 0.5)

    def dealt(packed: DataFrame, per_task: int, name: str) -> DataFrame:
        n = packed.count()
        parts = max(1, -(-n // per_task), min(n, least))
        # Tiles are numbered without gaps, so every part gets as many.
        part = F.pmod("tile", F.lit(parts)).cast("int")
        return packed.repartitionById(parts, part).select(F.col("tile").alias(f"{name}_id"), F.col("packed").alias(name))

    left = dealt(blocks, TASK_BLOCKS, "block")
    right = dealt(tiles, TASK_TILES, "tile").hint("shuffle_replicate_nl")
    return left.crossJoin(right) if condition is None else left.join(right, condition)


def _met(blocks: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """(query, rep, cosine): what queries find in all tiles, their k best per task."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, block = None, None
        for batch in batches:
            for row, name in enumerate(batch.column("block_id").to_pylist()):
                if block is None or name != now:
                    if block is not None:
                        yield block.rows()
                    now, block = name, _Block(_row(batch.column("block"), row), k)
                block.meet(_row(batch.column("tile"), row))
        if block is not None:
            yield block.rows()

    pairs = block_pairs(blocks, tiles).select("block_id", "block", "tile")
    return pairs.mapInArrow(run, "query bigint, rep bigint, cosine double")


def cosines_from(packed: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): all pairs of different vectors, a < b, with a cosine of ``least`` or more.
    Every two blocks of ``packed`` meet once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            same = np.equal(batch.column("block_id").to_numpy(), batch.column("tile_id").to_numpy())
            for row in range(len(batch)):
                left, right = (_row(batch.column(name), row) for name in ("block", "tile"))
                a, b, cosines = _pairs_from(left, right, least)
                once = a < b if same[row] else np.ones(len(a), bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)[once]), pa.array(np.maximum(a, b)[once]),
                     pa.array(cosines[once])],
                    names=["a", "b", "cosine"],
                )

    pairs = block_pairs(packed, packed, F.col("block_id") <= F.col("tile_id"))
    return pairs.mapInArrow(run, "a bigint, b bigint, cosine double")


def _pairs_from(left: pa.StructArray, right: pa.StructArray, least: float):
    """(rep, rep, cosine) of the pairs of two blocks that reach ``least``: those that their
    sketches cannot rule out are multiplied one by one, all at once where that is too many."""
    l_entries, r_entries = _listed(left), _listed(right)
    at_l, at_r = _possible(
        _sketch(len(left), *l_entries), _sketch(len(right), *r_entries), least,
        len(left) * len(right) // POSSIBLE_SHARE,
    )
    if at_l is None:
        l_rows, l_terms, l_weights = _by_term(l_entries)
        r_rows, r_terms, r_weights = _by_term(r_entries)
        l_terms, r_terms, kept_l, kept_r = _shared(l_terms, r_terms)
        matrix = _cosines(
            (len(left), len(right)),
            (l_rows[kept_l], l_terms, l_weights[kept_l]), (r_rows[kept_r], r_terms, r_weights[kept_r]),
        )
        at_l, at_r = np.nonzero(matrix >= least)
        cosines = matrix[at_l, at_r]
    else:
        cosines = _dots(l_entries, r_entries, at_l, at_r)
        kept = cosines >= least
        at_l, at_r, cosines = at_l[kept], at_r[kept], cosines[kept]
    return left.field("rep").to_numpy()[at_l], right.field("rep").to_numpy()[at_r], cosines


def _sketch(n: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per vector the lengths of its parts, the terms being dealt over SKETCH_DIMS parts. Two
    vectors' cosine is no higher than the product of their sketches (Cauchy-Schwarz, part by
    part)."""
    cells = rows * SKETCH_DIMS + terms % SKETCH_DIMS
    squares = np.bincount(cells, weights * weights, minlength=n * SKETCH_DIMS)
    return np.sqrt(squares).astype(np.float32).reshape(n, SKETCH_DIMS)


def _possible(left: np.ndarray, right: np.ndarray, least: float, most: int):
    """Places of the pairs whose sketches allow a cosine of ``least``; none if more than ``most``."""
    found_l, found_r, n = [], [], 0
    for low in range(0, len(left), SKETCH_ROWS):
        bounds = left[low : low + SKETCH_ROWS] @ right.T
        near = np.flatnonzero(bounds.max(axis=1) >= least - SKETCH_SLACK)
        at_l, at_r = np.nonzero(bounds[near] >= least - SKETCH_SLACK)
        found_l.append(near[at_l] + low)
        found_r.append(at_r)
        n += len(at_l)
        if n > most:
            return None, None
    return np.concatenate(found_l), np.concatenate(found_r)


def _dots(left, right, at_l: np.ndarray, at_r: np.ndarray) -> np.ndarray:
    """Dot products of the given pairs of rows, from entries ordered by row and term."""
    (l_rows, l_terms, l_weights), (r_rows, r_terms, r_weights) = left, right
    width = int(max(l_terms.max(), r_terms.max())) + 1
    keys = l_rows * width + l_terms
    starts = np.searchsorted(r_rows, np.arange(r_rows[-1] + 2))
    sizes = np.diff(starts)[at_r]
    found = np.zeros(len(at_l))
    part = np.cumsum(sizes) // DOT_PRODUCTS
    for own in np.split(np.arange(len(at_l)), np.flatnonzero(np.diff(part)) + 1):
        if not len(own):
            continue
        n = sizes[own]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[at_r[own]] - ends + n, n)
        wanted = np.repeat(at_l[own] * width, n) + r_terms[at]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        products = np.where(keys[place] == wanted, l_weights[place] * r_weights[at], 0.0)
        found[own] = np.add.reduceat(products, ends - n)
    return found


def _row(lists: pa.ListArray, at: int) -> pa.StructArray:
    """The vectors packed in one row, without those of its neighbours."""
    packed = lists.slice(at, 1).flatten()
    return pa.StructArray.from_arrays(packed.flatten(), fields=list(packed.type))


def nearest_vectors(queries: DataFrame, train: DataFrame, k: int, zero_rows: int = 0) -> DataFrame:
    """(query, rep, cosine): for each distinct query vector its k nearest by positive cosine.

    Both inputs are distinct unit vectors (rep, terms, weights, lead). ``zero_rows`` is how
    many zero vectors the training side has: with k of them, nothing below a cosine of 0.5
    can matter.
    """
    tiling = materialize(_tiling(train.select("lead")), "knn-tiling")
    tiles = materialize(
        train.join(tiling, "lead").select("rep", _tile("rep").alias("tile"), "terms", "weights"),
        "knn-tiles",
    )
    # At home are the vectors with the same heaviest term.
    home = materialize(
        queries.select("rep", "lead").join(tiling, "lead").select("rep", _tile("rep").alias("tile")),
        "knn-home",
    )
    floor = 0.5 - SLACK if zero_rows >= k else 0.0
    first = materialize(
        _visit(home.withColumn("threshold", F.lit(floor)), queries, tiles, k), "knn-first"
    )
    asking = queries.join(_found_at_home(first, k, floor), "rep", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(floor))
    )
    # Blocks of queries are tiles of their own, so that their size is limited too.
    own = tiling if queries is train else materialize(_tiling(queries.select("lead")), "knn-query-tiling")
    blocks = asking.join(own, "lead").withColumn("tile", _tile("rep"))
    return _best(
        _met(
            materialize(packed(blocks, "threshold"), "knn-blocks"),
            materialize(packed(tiles), "knn-packed"), k,
        ),
        k,
    )


def probed_vectors(
    queries: DataFrame, train: DataFrame, k: int, probes: int, lists: int | None = None, seed: int = 0
) -> DataFrame:
    """(query, rep, cosine): as ``nearest_vectors``, looking only into the ``probes`` lists whose
    trained centres are nearest to the query.

    By default there are as many lists as the root of the training vectors (``MAX_LISTS`` at
    most), so what a query visits grows like that root and not like the number of tiles. Every
    training vector is in a list; cosines inside the lists are exact.
    """
    require("probes", probes, "1 or more", probes >= 1)
    if lists is None:
        lists = max(1, min(MAX_LISTS, round(train.count() ** 0.5)))
    cut = projection.Lists(train, lists, seed=seed)
    home = materialize(cut.nearest(train, 1), "knn-lists")
    sizes = home.groupBy("list").agg(F.ceil(F.count("*") / TILE_ROWS).cast("bigint").alias("parts"))
    # As many rows as lists.
    first = F.sum("parts").over(Window.orderBy("list")) - F.col("parts")
    sizes = materialize(sizes.withColumn("first_tile", first).withColumn("tiles", F.col("parts")), "knn-sizes")
    tiles = materialize(
        train.join(home, "rep").join(sizes, "list")
        .select("rep", _tile("rep").alias("tile"), "terms", "weights"),
        "knn-tiles",
    )
    last = F.col("first_tile") + F.col("parts") - 1
    visits = (
        cut.nearest(queries, probes).join(sizes, "list")
        .select("rep", F.explode(F.sequence("first_tile", last)).alias("tile"), F.lit(0.0).alias("threshold"))
    )
    return _best(_visit(materialize(visits, "knn-visits"), queries, tiles, k), k)


def _distinct(weights: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """(groups, vectors) of one side, written once as both are read by several steps."""
    vectors = materialize(instance_vectors(weights), f"knn-{side}-vectors")
    groups = materialize(vector_groups(vectors), f"knn-{side}-groups")
    return groups, representatives(vectors, groups)


def nearest_neighbours(
    query_ids: DataFrame,
    query_weights: DataFrame,
    train_ids: DataFrame,
    train_weights: DataFrame,
    k: int,
    probes: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(instance_id, neighbour_id, rank, distance2): the k nearest training instances.

    ``*_ids`` list all instances, ``*_weights`` the long TF-IDF rows of those with known
    terms. Order is by squared distance (9 digits), then neighbour id. A training instance
    asked about itself is its own neighbour.

    The search is exact unless ``probes`` is given: then only so many trained lists are searched
    per query (``probed_vectors``), and what lies in others may be missed.
    """
    check_k(k)
    train_groups, train = _distinct(train_weights, "train")
    if query_weights is train_weights:
        query_groups, queries = train_groups, train
    else:
        query_groups, queries = _distinct(query_weights, "query")

    # k ids of either kind are all that can be needed, so these arrays are small.
    known = train_groups.select("instance_id")
    zero_ids = [
        r["instance_id"]
        for r in train_ids.select("instance_id")
        .join(known, "instance_id", "left_anti")
        .orderBy("instance_id")
        .take(k)
    ]
    unit_ids = [r["instance_id"] for r in known.orderBy("instance_id").take(k)]

    if probes is None:
        near = nearest_vectors(queries, train, k, len(zero_ids))
    else:
        near = probed_vectors(queries, train, k, probes, seed=seed)
    in_group = Window.partitionBy("rep").orderBy("instance_id")
    copies = (
        train_groups.withColumn("at", F.row_number().over(in_group))
        .filter(F.col("at") <= k)
        .select("rep", F.col("instance_id").alias("neighbour_id"))
    )
    matches = near.join(copies, "rep").select(
        "query", "neighbour_id", F.round(2 - 2 * F.col("cosine"), DIGITS).alias("distance2")
    )

    def fixed(ids: list[int], distance2: float):
        return F.array(
            *[
                F.struct(F.lit(i).cast("bigint").alias("neighbour_id"), F.lit(distance2).alias("distance2"))
                for i in ids
            ]
        ).cast("array<struct<neighbour_id: bigint, distance2: double>>")

    # Training ids that share no term with a query lie at distance 2; those that do share
    # one are already matched closer, and the lower distance is kept.
    # Queries whose k matches all lie nearer than a zero vector need none of them.
    filler = F.concat(fixed(zero_ids, 1.0), fixed(unit_ids, 2.0))
    full = (
        matches.filter("distance2 < 1").groupBy("query")
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    )
    reps = query_groups.select(F.col("rep").alias("query")).distinct()
    fill = reps.join(full, "query", "left_anti").select("query", F.inline(filler))
    order = Window.partitionBy("query").orderBy("distance2", "neighbour_id")
    unit = (
        matches.unionAll(fill)
        .groupBy("query", "neighbour_id")
        .agg(F.min("distance2").alias("distance2"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(query_groups.withColumnRenamed("rep", "query"), "query")
        .select("instance_id", "neighbour_id", "rank", "distance2")
    )
    zero_answer = F.slice(F.concat(fixed(zero_ids, 0.0), fixed(unit_ids, 1.0)), 1, k)
    zero = (
        query_ids.select("instance_id")
        .join(query_groups.select("instance_id"), "instance_id", "left_anti")
        .select("instance_id", F.posexplode(zero_answer).alias("at", "n"))
        .select("instance_id", "n.neighbour_id", (F.col("at") + 1).alias("rank"), "n.distance2")
    )
    return unit.unionAll(zero)
