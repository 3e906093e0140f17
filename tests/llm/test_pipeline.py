"""The pipeline's stages on planted cases, and the queries that have SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from labelspark.llm.simhash import fingerprint
from tests.llm.data import SCHEMA, words

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def planted(spark, tmp_path):
    rows, labels = [], []
    for i in range(240):
        toxic = i % 5 == 0
        rows.append((i, words(80, i) + (" such a dirty blockhead " if toxic else " plain ") + words(40, 900 + i)))
        labels.append((i, int(toxic)))
    clean = [r[0] for r in rows if r[0] % 5]
    passage = words(60, 7777)
    rows += [
        (1000, rows[1][1]), (1001, rows[1][1].replace(" ", "  ")),
        (2000, words(2000, 5)), (2001, words(2000, 5) + " tail"),
        (3000, words(30, 6) + " " + passage + " " + words(30, 7)),
        (3001, words(30, 8) + " " + passage + " " + words(30, 9)),
        (4000, ""), (4001, None), (4002, " "),
    ]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), dict(rows), clean, passage


def test_stages_take_effect(spark, planted):
    folder, texts, clean, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = set(seen["toxicity"])
    assert not {i for i in range(0, 240, 5)} & ids and set(clean) <= ids
    # Most code points stay: the copy with more white space.
    assert {1, 1000, 1001} & set(seen["exact_dedup"]) == {1001}
    assert {4000, 4001, 4002} & set(seen["exact_dedup"]) == {4002}
    assert {2000, 2001} & set(seen["simhash_near_dedup"]) == {2000}
    assert set(clean) - {1} <= set(seen["simhash_near_dedup"])
    last = seen["substring_dedup"]
    assert set(last) == set(seen["simhash_near_dedup"])
    assert passage in last[3000] and passage not in last[3001]
    assert all(last[i] == texts[i] for i in clean if i != 1)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(last)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_columns_named_like_those_of_the_stages_stay(spark, planted, tmp_path):
    folder = planted[0]
    names = ("row", "Row_id", "toxic_score", "cut_spans", "cut_chars", "_spans", "kept", "id", "root")
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 300 OR doc_id >= 3000")
    docs = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / f"in-{name}"))
        docs = stage(spark, spark.read.parquet(str(tmp_path / f"in-{name}")), folder)
    rows = docs.collect()
    assert docs.columns[-len(names) :] == list(names) and len(rows) > 150
    assert all(r[n] == n for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(rows)


def test_simhash_stage_links_at_three_bits(spark, tmp_path):
    """Groups are those of all pairs of fingerprints, chains included."""
    base = words(400, 3).split()
    rows = [(i, " ".join(base[: 400 - i] + base[:i])) for i in range(12)] + [(50, None), (51, ""), (60, words(50, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    marks = {i: fingerprint((t or "").encode()) for i, t in rows}
    root = {i: i for i in marks}
    for _ in rows:
        for a in marks:
            for b in marks:
                if bin(marks[a] ^ marks[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(root.values()) and len(got) < len(rows) - 3


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", [
    "op3_license_scan", "op4_exact_dedup", "op5_line_dedup", "op11_benchmark_decontamination",
    "op12_conversation_trie",
])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
