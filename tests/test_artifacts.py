"""Stored models are whole or not there; guards of inputs."""

import pytest

from labelspark.operators import tfidf
from labelspark.plans import training
from labelspark.sources import artifacts, tables
from tests.conftest import rows


def _model(spark, n, broken=None):
    found = {name: spark.createDataFrame([(n,)], "n int") for name in artifacts.TABLES["binary_relevance"]}
    if broken:
        found[broken] = found[broken].selectExpr("raise_error('disk is full') AS n")
    return artifacts.Model("binary_relevance", tfidf.FEATURES, {"C": float(n)}, found)


def _numbers(model):
    return {name: rows(df) for name, df in model.tables.items()}


def test_a_save_that_breaks_off_leaves_the_model_before_it(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, path)
    first = artifacts.save(_model(spark, 1), path)
    reading = artifacts.load(spark, path)
    with pytest.raises(Exception, match="disk is full"):
        artifacts.save(_model(spark, 2, broken="coefficients"), path)
    kept = artifacts.load(spark, path)
    assert kept.params == {"C": 1.0} and set(map(tuple, _numbers(kept).values())) == {((1,),)}
    artifacts.save(_model(spark, 3), path)
    assert artifacts.load(spark, path).params == {"C": 3.0}
    # Who loaded before a save still reads its own version, and versions can be named.
    assert set(map(tuple, _numbers(reading).values())) == {((1,),)}
    assert artifacts.load(spark, path, first).params == {"C": 1.0}
    assert artifacts.versions(spark, path).count() == 2
    assert artifacts.load(spark, path).profile == tfidf.FEATURES
    with pytest.raises(FileNotFoundError, match="no version"):
        artifacts.load(spark, path, "none")


def test_instance_columns_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,overview\nt,o\n")
    with pytest.raises(ValueError, match=r"missing required instance columns \['genre_ids'\]"):
        tables.read_instances(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("genre_ids,more,title,overview\n[1],x,t,o\n")
    assert tables.read_instances(spark, str(tmp_path / "b.csv")).columns == ["genre_ids", "more", "title", "overview"]


@pytest.mark.parametrize(("n", "which"), [(0, "training"), (1, "validation")])
def test_empty_parts_are_refused(spark, n, which):
    docs = spark.createDataFrame([(1, "some text", [1])][:n], "instance_id long, overview string, genre_ids array<long>")
    catalogue = spark.createDataFrame([(1, "a")], "id int, name string")
    with pytest.raises(ValueError, match=f"{which} texts cannot be empty"):
        training.prepare(docs, catalogue)
