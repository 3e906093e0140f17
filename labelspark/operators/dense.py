"""Exact k nearest neighbours between dense vectors of one length.

Without rare terms to look up nothing can be left out safely, so every query meets every
training vector; but only in blocks. Both sides are dealt into blocks of limited size, a task
multiplies one block of queries with one block of training vectors, and only the k best of a
query leave it. Queries are repeated once per training block and the other way round, so use it
with a stated, small query set. Distances are Euclidean between unit vectors, as in
``neighbours``.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.operators.neighbours import DIGITS, check_k
from labelspark.session import materialize

# The task functions below travel with the job; executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per block on either side: both bound the memory of one task.
QUERY_ROWS = 1024
TRAIN_ROWS = 8192


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_list()).astype(np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best_of_block(k: int):
    def best(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(train):
            return pd.DataFrame({"query_id": [], "neighbour_id": [], "distance2": []})
        cosines = _unit(queries["vector"]) @ _unit(train["vector"]).T
        distances = np.round(2 - 2 * cosines, DIGITS)
        ids = train["id"].to_numpy()
        depth = min(k, len(ids))
        limits = np.partition(distances, depth - 1, axis=1)[:, depth - 1 : depth]
        at_q, at_t = np.nonzero(distances <= limits)
        order = np.lexsort((ids[at_t], distances[at_q, at_t], at_q))
        at_q, at_t = at_q[order], at_t[order]
        chosen = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
        at_q, at_t = at_q[chosen], at_t[chosen]
        return pd.DataFrame(
            {
                "query_id": queries["id"].to_numpy()[at_q],
                "neighbour_id": ids[at_t],
                "distance2": distances[at_q, at_t],
            }
        )

    return best


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    count = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")), count


def nearest_dense(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbour_id, rank, distance2): the k nearest by distance, then id.

    Both inputs hold (id, vector); rows without a vector are left out.
    """
    check_k(k)
    asking, n_asking = _blocks(queries.filter("vector IS NOT NULL"), QUERY_ROWS)
    asked, n_asked = _blocks(train.filter("vector IS NOT NULL"), TRAIN_ROWS)

    def against(rows: DataFrame, own: str, other: str, n_other: int) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(n_other - 1))
        return rows.select(
            F.col("block").alias(own), F.explode(numbers).alias(other), "id", "vector"
        )

    found = (
        against(asking, "q", "t", n_asked).groupBy("q", "t")
        .cogroup(against(asked, "t", "q", n_asking).groupBy("q", "t"))
        .applyInPandas(_best_of_block(k), "query_id bigint, neighbour_id bigint, distance2 double")
    )
    order = Window.partitionBy("query_id").orderBy("distance2", "neighbour_id")
    return (
        materialize(found, "dense-found")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "neighbour_id", "rank", "distance2")
    )
