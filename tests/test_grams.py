from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspark.operators import grams, similarity, tfidf
from labelspark.session import shared_dir

LO, HI = 1, 3


def _instances(seed, n=80, words=40):
    """Per instance some token lists; words differ in frequency, some lists are empty."""
    rng = np.random.default_rng(seed)
    return [
        [[f"w{int(w)}" for w in rng.zipf(1.3, int(rng.integers(0, 12))) % words] for _ in range(int(rng.integers(0, 4)))]
        for _ in range(n)
    ]


def _batch(instances):
    return pa.record_batch({
        "instance_id": pa.array([10 * i for i in range(len(instances))]),
        "texts": pa.array(instances, pa.list_(pa.list_(pa.string()))),
    })


def _counted(instances):
    """Per instance, how often it has each n-gram; none crosses its texts."""
    return [
        Counter(" ".join(t[i : i + n]) for t in texts for n in range(LO, HI + 1) for i in range(len(t) - n + 1))
        for texts in instances
    ]


def _rows(found):
    return [r for batch in found for r in batch.to_pylist()]


def _named(term):
    return int(grams.gram_hashes([grams.word_hashes(np.array([w], object)) for w in term.split(" ")])[0])


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_chosen_n_grams_are_counted_exactly(monkeypatch, chunk):
    monkeypatch.setattr(grams, "CHUNK_TOKENS", chunk)
    instances = _instances(1)
    per_instance = _counted(instances)
    cf = sum(per_instance, Counter())
    df = Counter(t for c in per_instance for t in c)
    chosen = sorted(cf)[::3]
    hashes = np.sort(np.array([_named(t) for t in chosen], np.uint64))
    batches = [_batch(instances), _batch(instances).slice(5, 7), _batch([])]
    got_df, got_cf = Counter(), Counter()
    for r in _rows(grams.counts_of(hashes, LO, HI)(iter(batches[:1]))):
        got_df[r["term"]] += r["df"]
        got_cf[r["term"]] += r["cf"]
    assert got_cf == {t: cf[t] for t in chosen} and got_df == {t: df[t] for t in chosen}
    part = sum(per_instance[5:12], Counter())
    got = Counter()
    for r in _rows(grams.counts_of(hashes, LO, HI)(iter(batches[1:]))):
        got[r["term"]] += r["cf"]
    assert got == {t: part[t] for t in chosen if t in part}


@pytest.mark.parametrize("room", [20, 200, 1 << 20])
def test_a_summary_says_how_much_it_can_lack(monkeypatch, room):
    monkeypatch.setattr(grams, "CHUNK_TOKENS", 30)
    monkeypatch.setattr(grams, "SUMMARY_TERMS", room)
    instances = _instances(2, n=300)
    cf = sum(_counted(instances), Counter())
    rows = _rows(grams.summary(LO, HI)(iter([_batch(instances)])))
    slack = sum(r["slack"] for r in rows if r["hash"] is None)
    low = {r["hash"] % (1 << 64): r["cf"] for r in rows if r["hash"] is not None}
    assert (slack > 0) == (room < len(cf))
    for term, n in cf.items():
        assert low.get(_named(term), 0) <= n <= low.get(_named(term), 0) + slack


def test_weights_match_counts_and_have_unit_length():
    instances = _instances(3)
    per_instance = _counted(instances)
    terms = sorted(sum(per_instance, Counter()))[::2]
    vocabulary = pa.table({
        "term": terms, "term_id": pa.array(range(len(terms)), pa.int32()),
        "rarity": pa.array(range(len(terms), 0, -1), pa.int32()), "idf": [1.0 + i / 7 for i in range(len(terms))],
    })
    got = {}
    for r in _rows(grams.weights_of(vocabulary, LO, HI, False)(iter([_batch(instances)]))):
        assert terms[r["term_id"]] == r["term"] and r["rarity"] == len(terms) - r["term_id"]
        got.setdefault(r["instance_id"], {})[r["term"]] = (r["tf"], r["weight"])
    for i, counts in enumerate(per_instance):
        known = {t: n for t, n in counts.items() if t in set(terms)}
        raw = {t: n * (1.0 + terms.index(t) / 7) for t, n in known.items()}
        norm = sum(x * x for x in raw.values()) ** 0.5
        assert got.get(10 * i, {}) == {t: (n, pytest.approx(raw[t] / norm)) for t, n in known.items()}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "instance_id bigint, overview string")


def test_repeated_and_missing_ids_are_one_instance(spark):
    docs = _docs(spark, [(1, "ant bee cat"), (1, "cat dog"), (None, "ant bee"), (None, None), (2, "bee cat"), (3, "")])
    profile = tfidf.TextProfile((1, 2), 4)
    rows = tfidf.tokenized(docs, profile)
    got = {r["instance_id"]: (r["n_rows"], sorted(map(tuple, r["texts"]))) for r in rows.collect()}
    assert got[1] == (2, [("ant", "bee", "cat"), ("cat", "dog")]) and got[None] == (2, [("ant", "bee")])
    for given in (docs, rows):
        found = tfidf.fit_vocabulary(given, profile).orderBy("term").collect()
        assert [(r["term"], r["df"], r["cf"]) for r in found] == [
            ("ant", 2, 2), ("ant bee", 2, 2), ("bee", 3, 3), ("cat", 2, 3),
        ]
        weighed = tfidf.weights(given, tfidf.fit_vocabulary(given, profile), profile)
        tf = {(r["instance_id"], r["term"]): r["tf"] for r in weighed.collect()}
        assert tf[1, "cat"] == 2 and tf[None, "ant bee"] == 1 and tf[2, "cat"] == 1 and len(tf) == 9


def test_rare_n_grams_are_neither_named_nor_written(spark):
    """Counts of every n-gram were shuffled and written, though a thousand are asked for."""
    texts = [f"often said words here one{i} two{i} three{i} four{i} five{i}" for i in range(300)]
    docs = _docs(spark, list(enumerate(texts)))
    profile = tfidf.TextProfile((2, 3), 5)
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(shared_dir(spark))

    def written():
        status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs.Path(folder, "term-counts-*"))
        return {s.getPath().toString() for s in status}

    before = written()
    found = tfidf.fit_vocabulary(docs, profile).collect()
    (path,) = written() - before
    assert {r["term"] for r in found} == {
        "often said", "said words", "words here", "often said words", "said words here",
    }
    assert all(r["df"] == r["cf"] == 300 for r in found)
    assert spark.read.parquet(path).count() == 5


def test_texts_are_cut_into_tokens_once(spark):
    docs = _docs(spark, [(1, "ant bee cat"), (2, "bee cat"), (3, "ant bee cat")])
    weights, groups = similarity.duplicate_vectors(docs)
    plan = weights._jdf.queryExecution().toString() + groups._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
    assert sorted(map(tuple, groups.select("rep", "instance_id").collect())) == [(1, 1), (1, 3), (2, 2)]
    assert weights.filter(F.col("instance_id") == 2).count() == 1
