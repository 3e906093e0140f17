"""The classifier on made and on given labels."""

import os
import zlib

import numpy as np
import pytest

from labelspark.llm import toxicity
from tests.llm.data import awkward, table, words

SF_DIR = "/root/testdata/sf0.01"


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = words(60, i) + (" you utter blockhead " if toxic else " ") + words(60, n + i)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_features_are_distinct_and_complete():
    own = toxicity.Features()
    for text in ("", "a", "abc abc abc abc", words(500, 1), "1234 9999"):
        found = own.of(text)
        codes = toxicity.normalise(text)
        grams = {
            tuple(codes[i : i + n]) for n in toxicity.SIZES for i in range(len(codes) - n + 1)
        }
        assert len(set(found.tolist())) == len(found) <= len(grams)
        assert len(found) >= 0.99 * len(grams)
    assert sorted(own.of("A\t b1")) == sorted(own.of("a b7"))


def test_learns_what_is_labelled(spark):
    rows, labels = labelled(400)
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.train(docs, marks)).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.doc_id % 4 == 0) == (r.score >= 0.7)


def test_held_out_labels_have_no_influence(spark):
    rows, labels = labelled(100)
    docs = table(spark, rows)
    out = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (
        toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"))
        for x in (labels, out)
    )
    assert a.intercept == b.intercept and np.array_equal(a.weights, b.weights)


def test_bound_on_rows(spark):
    rows, labels = labelled(200)
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels + labels[:9] + [(None, 1), (7, None)], "doc_id long, toxic int")
    once = toxicity.train(docs, marks, 40)
    again = toxicity.train(docs.repartition(3), marks.repartition(5), 40)
    assert once.intercept == again.intercept and np.array_equal(once.weights, again.weights)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    rows, labels = labelled(60)
    train = table(spark, rows)
    model = toxicity.train(train, spark.createDataFrame(labels, "doc_id long, toxic int"))
    docs = table(spark, awkward(), clashing)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = toxicity.with_scores(docs, model)
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == len(awkward())


def test_without_labels_of_both_kinds(spark):
    docs = table(spark)
    for labels, score in (([], 0.0), ([(4, 0)], 0.0), ([(5, 1), (9, 1), (3, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {round(r.score, 9) for r in toxicity.toxicity(docs, model).collect()} == {score}
    assert toxicity.toxicity(table(spark, []), model).count() == 0


def test_labels_without_telling_features(spark):
    docs = table(spark, [(i, words(50, i)) for i in range(6)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == 6 and all(0.3 < r.score < 0.7 and not r.predicted for r in got)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = toxicity.toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    found = got.filter("held_out").select("score", "predicted", "toxic").collect()
    yes, no = ([r.score for r in found if r.toxic == t] for t in (1, 0))
    area = np.mean([(y > n) + 0.5 * (y == n) for y in yes for n in no])
    assert area > 0.95
    assert sum(r.predicted and not r.toxic for r in found) <= 0.01 * len(found)
