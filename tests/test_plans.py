"""Physical plans: what must not, and what must, be in them."""

import os

import pytest

from labelspark.operators import tfidf
from labelspark.plans import inputs, registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

LAZY = [
    "clean_rows", "dedup_exact", "label_distribution", "label_cooccurrence", "label_nmi",
    "label_phi", "cooccurrence_matrix", "label_matrix", "vocabulary", "stratified_split",
    "one_class_scores", "precision_at_k", "predict_topk", "latency_histogram", "request_rate",
    "metrics_snapshot",
]


def _plan(spark, name):
    return registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = _plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


def _nodes(query, executed):
    """All nodes of the physical (or optimized logical) plan."""
    execution = query._jdf.queryExecution()
    todo = [execution.executedPlan() if executed else execution.optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        yield node
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def _n_grams(spark, name):
    docs = inputs.documents(spark, SF_DIR)
    return {
        "terms": lambda: tfidf.terms(docs, tfidf.FEATURES),
        "counts": lambda: tfidf.corpus_counts(docs, tfidf.NEAR_DUPLICATES),
        "weights": lambda: tfidf.weights(
            docs, spark.createDataFrame([("a", 0, 1, 1.0)], "term string, term_id int, rarity int, idf double"),
            tfidf.FEATURES,
        ),
    }[name]()


@pytest.mark.parametrize("name", ["terms", "counts", "weights"])
def test_texts_move_once_and_are_cut_once(spark, name):
    """One exchange carries texts; what n-grams are made of is no part of any filter."""
    query = _n_grams(spark, name)
    moved = [n for n in _nodes(query, True) if "Exchange" in n.nodeName() and "overview" in n.output().mkString(",")]
    assert len(moved) == 1
    optimized = [n for n in _nodes(query, False)]
    said = [n.simpleString(100_000) for n in optimized]
    assert sum(line.count("regexp_extract_all") for line in said) == 1
    assert not any("transform(" in line or "regexp_extract_all" in line for line in said if line.startswith("Filter"))


@pytest.mark.parametrize("name", ["terms", "counts", "weights"])
def test_n_grams_use_every_core(spark, name):
    """A file of one row group is no reason for one task."""
    placed = [
        n for n in _nodes(_n_grams(spark, name), True)
        if "Exchange" in n.nodeName() and "overview" in n.output().mkString(",")
    ]
    assert placed[0].outputPartitioning().numPartitions() >= spark.sparkContext.defaultParallelism


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "label_distribution")
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
    assert "l_extendedprice" not in plan
    assert "ReadSchema: struct<title" not in _plan(spark, "text_length_stats")
