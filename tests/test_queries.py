"""Every query with SQL, at the smallest scale, against DuckDB."""

import glob
import json
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from labelspark.plans import profile, registry
from labelspark.sources import reports

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_preparation():
    """Split, vocabulary and weights are the same for all model queries: prepare them once."""
    prepare, kept = registry._prepared, {}

    def once(spark, sf_dir):
        if sf_dir not in kept:
            kept[sf_dir] = prepare(spark, sf_dir)
        return kept[sf_dir]

    registry._prepared = once
    yield
    registry._prepared = prepare


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def _sorted(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = [tuple(r) for r in got.collect()]
    assert found and _sorted(got.columns, found) == _sorted(columns, want.fetchall())


def test_sql_has_no_unknown_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_report_is_complete_and_within_bounds(spark, tmp_path):
    report = entry.queries()["profile_report"](spark, SF_DIR)
    row = report.first()
    assert len(row) == 13 and row["n_instances"] == 200
    assert 0 <= row["imbalance"]["gini"] <= 1 and 0 <= row["imbalance"]["head_ratio"] <= 1
    assert [r["count"] for r in row["label_distribution"]] == sorted(
        (r["count"] for r in row["label_distribution"]), reverse=True
    )
    assert len(row["top_mutual_info"]) == 10
    assert all(0 <= r["nmi"] <= 1 for r in row["top_mutual_info"])
    assert all(0 <= r["support"] <= 100 for r in row["label_distribution"])
    path = str(tmp_path / "deep" / "report")
    reports.write_report(spark.createDataFrame([row], report.schema), path)
    text = "".join(open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert json.loads(text)["n_instances"] == 200 and "\n  " in text
    assert reports.read_report(spark, path).first()["label_cardinality"] == row["label_cardinality"]


def test_charts(spark):
    from labelspark.operators import labelsets
    from labelspark.plans import inputs

    sets = labelsets.label_sets(inputs.labelled_documents(spark, SF_DIR))
    charts = profile.chart_data(sets, inputs.document_catalogue(spark))
    assert charts["label_bars"].count() == 7
    assert charts["cooccurrence_matrix"].count() == 49
    assert charts["label_count_histogram"].agg({"n_instances": "sum"}).first()[0] == 200
