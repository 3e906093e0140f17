"""Toxicity by a linear classifier over character n-grams with naive Bayes scaling.

Texts are lower-cased, white space and digits are made alike, and all n-grams of 4 to 6 code
points are hashed into 2^20 features that are present or absent. Each feature is scaled by its
naive Bayes log-count ratio, the logarithm of how much more often it occurs in toxic texts, and
a logistic regression, both labels weighing the same, is fitted on the scaled features.

The fit uses at most ``MAX_ROWS`` labelled rows, those with the smallest hash of doc_id; that
bound also bounds the list of ids that is broadcast to the scan and what is sent to the driver:
for each of these rows the numbers of its telling features (in enough texts, and clearly more
usual with one label), found by a count in Spark before. The model is one weight per feature, a fixed 4 MB. Scoring reads every whole text once and
shuffles nothing.

Only the text enters a score. Rows whose crc32(doc_id as text) mod 3 is 1 are held out of the
fit. Defined cases: null text is empty; an empty text is scored by the intercept; a null doc_id
is not held out (crc32 of null is null) and never has a label; several labels of one document
count as its largest; without labels of both kinds all scores are 1 if there are toxic labels
and else 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import slices
from labelspark.session import materialize

SIZES = (4, 5, 6)
BITS = 20
MAX_ROWS = 8_000
THRESHOLD = 0.7
SMOOTHING = 1.0
PENALTY = 1e-2
STEPS = 80
# Tasks that go through the labelled texts; each counts all features for itself.
FIT_TASKS = 4
# A feature in fewer labelled texts says nothing.
MIN_TEXTS = 5
# A feature as usual in toxic texts as in others (within this factor, as a logarithm) neither.
MIN_RATIO = 1.0

# Odd multipliers of the rolling hash, by size.
FACTORS = {4: 0x85EBCA77, 5: 0xC2B2AE3D, 6: 0x27D4EB2F}


def normalise(text: str) -> np.ndarray:
    """Code points: lower case, one blank for white space, one digit for all, blank at ends."""
    line = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    return codes


class Features:
    """Distinct features of texts; keeps scratch space of fixed size."""

    def __init__(self, bits: int = BITS):
        self.bits, self.scratch = bits, np.zeros(1 << bits, np.int64)

    def of(self, text: str) -> np.ndarray:
        codes = normalise(text)
        found = []
        for size in SIZES:
            if len(codes) < size:
                continue
            value = np.full(len(codes) - size + 1, size, np.uint32)
            for k in range(size):
                value = (value ^ codes[k : len(codes) - size + 1 + k]) * np.uint32(FACTORS[size])
                value ^= value >> np.uint32(15)
            found.append(value >> np.uint32(32 - self.bits))
        if not found:
            return np.empty(0, np.int64)
        every = np.concatenate(found).astype(np.int64)
        # Of equal features the one that wrote last finds its own number.
        order = np.arange(len(every))
        self.scratch[every] = order
        return every[self.scratch[every] == order]


class Model:
    """Intercept and one weight per feature."""

    def __init__(self, intercept: float, weights: np.ndarray):
        self.intercept, self.weights = intercept, weights.astype(np.float32)

    def score(self, features: np.ndarray) -> float:
        margin = self.intercept + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weights): logistic regression by accelerated gradient steps.

    ``rows`` hold the numbers of the features present, ``scale`` the value of each feature.
    Both labels weigh the same in total, however rare one is.
    """
    share = float(toxic.mean())
    label = toxic.astype(np.float64)
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows)
    norms = np.bincount(row, (scale**2)[column], len(rows))
    step = 1.0 / (0.25 * (float(np.mean(weight * norms)) + 1.0) + PENALTY)
    w, intercept = np.zeros(len(scale)), 0.0
    ahead, ahead_0, momentum = w.copy(), intercept, 1.0
    for _ in range(STEPS):
        margin = np.bincount(row, (ahead * scale)[column], len(rows)) + ahead_0
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
        slope = np.bincount(column, error[row], len(scale)) * scale / len(label)
        new = ahead - step * (slope + PENALTY * ahead)
        new_0 = ahead_0 - step * float(error.mean())
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        ahead_0 = new_0 + (momentum - 1) / following * (new_0 - intercept)
        w, intercept, momentum = new, new_0, following
    return intercept, w * scale


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of ``labels`` (doc_id, toxic), rows held out left aside.

    At most ``max_rows`` labels, by hash of doc_id, so their ids may be broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), "toxic")
        .filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    sample = materialize(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id"))
        .select("_id", F.col("_toxic").cast("int").alias("toxic"), "text"),
        "toxicity-sample",
    )
    n_yes, n_no = (
        sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    )
    if not n_yes or not n_no:
        return Model(500.0 if n_yes else -500.0, np.zeros(1 << BITS))
    chosen_features = log_count_ratios(sample, n_yes, n_no).toArrow().sort_by("feature")
    use = chosen_features["feature"].to_numpy()
    scale = chosen_features["ratio"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]):
        features = Features()
        place = np.full(1 << BITS, -1, np.int32)
        place[use] = np.arange(len(use))
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                own = place[features.of(text or "")]
                found.append(np.sort(own[own >= 0]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("toxic"), pa.array(found, pa.binary())],
                names=["id", "toxic", "features"],
            )

    rows = (
        sample.coalesce(FIT_TASKS)
        .mapInArrow(run, "id long, toxic int, features binary")
        .toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    )
    found = [np.frombuffer(f, np.int32) for f in rows["features"].to_pylist()]
    intercept, own = fit(found, (rows["toxic"].to_numpy() > 0).astype(np.int64), scale)
    weights = np.zeros(1 << BITS)
    weights[use] = own
    return Model(intercept, weights)


def log_count_ratios(sample: DataFrame, n_yes: int, n_no: int) -> DataFrame:
    """(feature, ratio) of the features that say something, from texts with (toxic, text).

    At most one row per feature, whatever the sample; tasks count for themselves first.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        features, counts = Features(), np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            toxic = batch.column("toxic").to_pylist()
            for text, label in zip(batch.column("text").to_pylist(), toxic):
                counts[int(label > 0), features.of(text or "")] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[0, seen])],
            names=["feature", "yes", "no"],
        )

    smooth = lambda count, n: F.log((count + SMOOTHING) / (n + 2 * SMOOTHING))
    return (
        sample.select("toxic", "text").coalesce(FIT_TASKS)
        .mapInArrow(run, "feature long, yes long, no long")
        .groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        .filter(F.col("yes") + F.col("no") >= MIN_TEXTS)
        .select("feature", (smooth(F.col("yes"), n_yes) - smooth(F.col("no"), n_no)).alias("ratio"))
        .filter(F.abs("ratio") >= MIN_RATIO)
    )


def with_scores(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score under ``name``; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((model.intercept, model.weights))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]):
        features, own = Features(), Model(*sent.value)
        for batch in slices(batches):
            scores = [own.score(features.of(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                names=[*batch.schema.names, name],
            )

    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_scores(own, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
