"""Winnowing against plain Python over every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import decontamination as D
from tests.llm.data import CLASHING, awkward, plain, table, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(ASCII))


def expected(docs, items):
    known = {}
    for item, text in items:
        w = split(text)
        size = min(len(w), 10)
        if item is not None and size:
            for i in range(len(w) - size + 1):
                known.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                here = known.get(tuple(w[i : i + size]))
                if here:
                    hit |= set(range(i, i + size))
                    found |= here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def written(df, tmp_path):
    df.write.parquet(str(tmp_path / "docs"))
    return df.sparkSession.read.parquet(str(tmp_path / "docs"))


LONG = words(40, 11)
ITEMS = [
    (1, LONG), (2, LONG.upper()), (10, "One Two"), (3, words(70, 2)), (4, ""), (5, None),
    (None, words(60, 4)), (6, words(9, 21)), (7, words(10, 22)), (8, "one"), (8, words(12, 23)),
    (9, "a b a b a b a b a b a b a b a b"), (11, "It's  one's"),
]


def test_awkward_rows(spark, tmp_path):
    part = LONG.split(" ")
    rows = awkward() + [
        (200, "x " + ", ".join(part[5:15]) + " y"), (201, "x " + " ".join(part[5:14]) + " y"),
        (202, words(30, 31) + " " + LONG + " " + words(9, 21)), (203, "a b " * 500),
        (204, " ".join(part[:12]) + " " + " ".join(part[20:33])), (205, words(10, 22)),
    ]
    docs = written(table(spark, rows), tmp_path)
    assert plain(D.report(docs, benchmark(spark, ITEMS))) == expected(rows, ITEMS)


def test_random_texts_share_windows_of_every_length(spark, tmp_path):
    pick = random.Random(5)
    vocabulary = ["ba", "ko", "ti"]
    draw = lambda n: " ".join(pick.choices(vocabulary, k=n))
    items = [(i, draw(pick.randint(1, 25))) for i in range(30)]
    rows = [(i, draw(pick.randint(0, 120))) for i in range(60)]
    docs = written(table(spark, rows), tmp_path)
    assert plain(D.report(docs, benchmark(spark, items))) == expected(rows, items)
    long = [(i, t) for i, t in items if len(t.split()) >= 10]
    assert plain(D.report(docs, benchmark(spark, long))) == expected(rows, long)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    rows = [(1, LONG), (2, words(30, 9))]
    docs = written(table(spark, rows, clashing=True), tmp_path)
    items = benchmark(spark, [(1, LONG)]).selectExpr("*", "1 AS row", "'x' AS class", "2 AS size")
    assert plain(D.report(docs, items)) == expected(rows, [(1, LONG)])
    assert plain(D.report(docs, items.limit(0))) == expected(rows, [])
    empty = spark.createDataFrame([], CLASHING)
    assert plain(D.report(empty, items)) == []


@pytest.mark.parametrize("span", [1, 2, 3, 7, 10])
def test_every_shared_span_leaves_a_common_fingerprint(span):
    pick = random.Random(span)
    powers = D.Powers(D.WORD_FACTOR)
    texts = [" ".join(pick.choices("abcdefgh", k=pick.randint(0, 60))) for _ in range(40)]
    found = D._words(pa.array(texts), powers)
    at, marks = D.winnow(found, span)
    kept = dict(zip(at.tolist(), marks.tolist()))
    by_window = {}
    for text, first in zip(texts, found.first.tolist()):
        w = text.split()
        for i in range(len(w) - span + 1):
            inside = {
                kept[first + i + j] for j in range(span - D.gram_size(span) + 1) if first + i + j in kept
            }
            key = tuple(w[i : i + span])
            by_window[key] = by_window[key] & inside if key in by_window else inside
    assert by_window and all(by_window.values())


def test_items_and_spans(spark, tmp_path):
    rows = [(1, "x y " + LONG + " z"), (2, "clean")]
    docs = written(table(spark, rows), tmp_path)
    _, spans, found = D.decontaminate(docs, benchmark(spark, [(7, LONG), (6, LONG)]))
    pieces = sorted((r["start"], r["end"]) for r in spans.collect())
    covered = np.concatenate([np.arange(a, b) for a, b in pieces])
    assert sorted(covered.tolist()) == list(range(2, 42))
    assert [r["items"] for r in found.collect()] == [["6", "7"]]
