"""Random projections of sparse unit vectors: sign signatures in bands, and trained lists.

Two vectors at angle t lie on the same side of a random hyperplane with probability 1 - t / pi.
``candidates`` cuts the signs of many hyperplanes into bands and pairs vectors that agree in a
whole band. ``Lists`` cuts the projected space around trained centres, for searches that probe
only the lists next to a query. Both only propose; the caller computes true cosines.

Directions come from a seed, so results repeat. They are made anew in each task from the number
of terms (the vocabulary's bound), not sent.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.checks import require
from labelspark.session import materialize, work_partitions

# The task functions below travel with the job; executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits per band and bands: a pair at cosine 0.9 agrees in some band with probability 0.985, one
# at 0.95 with 0.9999.
BITS, BANDS = 16, 48

# Standard deviations by which the signs of a pair may differ more than its angle says.
SPREAD = 6

# A band's list longer than this is split, and its blocks are joined pairwise.
SPLIT_ROWS = 20_000

# Entries projected at once.
CHUNK_ENTRIES = 8_000


def directions(n_terms: int, dims: int, seed: int) -> np.ndarray:
    """A normally distributed direction per term (numbered from 1) and dimension."""
    return np.random.default_rng(seed).standard_normal((n_terms + 1, dims), dtype=np.float32)


def project(terms: pa.ListArray, weights: pa.ListArray, towards: np.ndarray) -> np.ndarray:
    """Sums of weight times direction per row, a limited number of entries at a time."""
    sizes = np.diff(terms.offsets.to_numpy())
    terms = terms.flatten().to_numpy(zero_copy_only=False)
    weights = weights.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), towards.shape[1]))
    run = np.cumsum(sizes) // CHUNK_ENTRIES
    at = np.concatenate([[0], np.cumsum(sizes)])
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(run)) + 1):
        rows = rows[sizes[rows] > 0]
        if not len(rows):
            continue
        low, high = at[rows[0]], at[rows[-1] + 1]
        parts = weights[low:high, None].astype(np.float32) * towards[terms[low:high]]
        out[rows] = np.add.reduceat(parts, at[rows] - low, axis=0)
    return out


def listed(vectors: DataFrame) -> DataFrame:
    """(rep, terms, weights): long rows (rep, rarity, weight) as one row per vector."""
    entries = F.array_sort(F.collect_list(F.struct("rarity", "weight")))
    return (
        vectors.groupBy("rep").agg(entries.alias("e"))
        .select("rep", F.col("e.rarity").alias("terms"), F.col("e.weight").alias("weights"))
    )


def _n_terms(vectors: DataFrame) -> int:
    return int(vectors.agg(F.max(F.array_max("terms"))).first()[0] or 0)


def signatures(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(rep, signs, keys): the signs of all hyperplanes as longs, and one key per band."""
    n_terms = _n_terms(vectors)

    def run(batches: Iterator[pa.RecordBatch]):
        towards = directions(n_terms, bits * bands, seed)
        for batch in batches:
            found = project(batch.column("terms"), batch.column("weights"), towards) > 0
            signs = np.zeros((len(found), -(-bits * bands // 64) * 64), bool)
            signs[:, : bits * bands] = found
            words = np.packbits(signs, axis=1, bitorder="little").view(np.int64)
            keys = found.reshape(len(found), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
            keys = (np.arange(bands, dtype=np.int64) << bits) + keys
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), _lists(words), _lists(keys)], names=["rep", "signs", "keys"]
            )

    return vectors.select("rep", "terms", "weights").mapInArrow(
        run, "rep long, signs array<long>, keys array<long>"
    )


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))


def candidates(
    vectors: DataFrame, threshold: float, bits: int = BITS, bands: int = BANDS, seed: int = 0
) -> DataFrame:
    """(a, b): pairs of vectors that agree in a band and whose signs differ about as much as an
    angle of cosine ``threshold`` allows.

    ``vectors`` holds unit vectors as long rows (rep, rarity, weight). A band that many vectors
    share is cut into blocks, and every two blocks meet in a task of their own.
    """
    require("bits", bits, "from 1 to 32", 1 <= bits <= 32)
    require("bands", bands, "from 1 to 256", 1 <= bands <= 256)
    planes = bits * bands
    apart = math.acos(min(1.0, threshold)) / math.pi
    most = planes * apart + SPREAD * math.sqrt(planes * apart * (1 - apart)) + bits / 2
    signed = materialize(signatures(listed(vectors), bits, bands, seed), "signatures")
    keyed = signed.select("rep", "signs", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("parts")
    )
    cut = materialize(
        keyed.join(sizes, "key").withColumn(
            "block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        ),
        "bands",
    )
    lo = F.explode(F.sequence(F.lit(0), F.col("block")))
    hi = F.explode(F.sequence(F.col("block"), F.col("parts") - 1))
    left = cut.withColumn("lo", F.col("block")).withColumn("hi", hi).alias("l")
    right = cut.withColumn("hi", F.col("block")).withColumn("lo", lo).alias("r")
    differ = reduce(
        lambda total, i: total + F.bit_count(F.get("l.signs", F.lit(i)).bitwiseXOR(F.get("r.signs", F.lit(i)))),
        range(-(-planes // 64)), F.lit(0),
    )
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "lo", "hi")]
    once = (F.col("l.lo") < F.col("l.hi")) | (F.col("l.rep") < F.col("r.rep"))
    return (
        left.join(right.hint("merge"), same[0] & same[1] & same[2] & once & (differ <= most))
        .select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
        .repartition(work_partitions(vectors.sparkSession), "a", "b")
        .dropDuplicates()
    )


class Lists:
    """Centres of the projected space, fitted on a bounded sample of vectors.

    ``sample`` vectors at most, drawn by a hash of ``rep``, reach the driver, as ``dims`` numbers
    each (40 MB by default); there spherical k-means runs ``rounds`` times. Every vector, sampled or not, is then
    put into the list of its nearest centre by ``nearest``.
    """

    def __init__(
        self, vectors: DataFrame, lists: int, dims: int = 1024, sample: int = 10_000,
        rounds: int = 8, seed: int = 0,
    ):
        require("lists", lists, "1 or more", lists >= 1)
        self.dims, self.seed, self.n_terms = dims, seed, _n_terms(vectors)
        drawn = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample)
        found = self._projected(drawn.select("rep", "terms", "weights")).select("place").toPandas()
        points = np.stack(found["place"]) if len(found) else np.zeros((1, dims))
        self.centres = _centres(points, min(lists, len(points)), rounds)

    def _projected(self, vectors: DataFrame) -> DataFrame:
        n_terms, dims, seed = self.n_terms, self.dims, self.seed

        def run(batches: Iterator[pa.RecordBatch]):
            towards = directions(n_terms, dims, seed)
            for batch in batches:
                places = _unit(project(batch.column("terms"), batch.column("weights"), towards))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), _lists(places.astype(np.float32))], names=["rep", "place"]
                )

        return vectors.mapInArrow(run, "rep long, place array<float>")

    def nearest(self, vectors: DataFrame, probes: int) -> DataFrame:
        """(rep, list): the ``probes`` lists whose centres are nearest, of vectors (rep, terms,
        weights). Terms that the fit did not know are left out."""
        n_terms, dims, seed, centres = self.n_terms, self.dims, self.seed, self.centres
        probes = min(probes, len(centres))

        def run(batches: Iterator[pa.RecordBatch]):
            towards = directions(n_terms, dims, seed)
            for batch in batches:
                places = project(batch.column("terms"), batch.column("weights"), towards)
                near = np.argsort(-(places @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), _lists(near.astype(np.int64))], names=["rep", "lists"]
                )

        known = F.filter(F.arrays_zip("terms", "weights"), lambda e: e["terms"] <= n_terms)
        return (
            vectors.select("rep", known.alias("e"))
            .select("rep", F.col("e.terms").alias("terms"), F.col("e.weights").alias("weights"))
            .mapInArrow(run, "rep long, lists array<long>")
            .select("rep", F.explode("lists").alias("list"))
        )


def _unit(points: np.ndarray) -> np.ndarray:
    length = np.sqrt((points * points).sum(axis=1, keepdims=True))
    return np.divide(points, length, out=np.zeros_like(points), where=length > 0)


def _centres(points: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Spherical k-means, from evenly spread points; an empty list keeps its centre."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        held = np.bincount(own, minlength=n) > 0
        centres[held] = _unit(sums[held])
    return centres
