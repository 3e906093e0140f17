import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.operators import (
    binary_relevance,
    metrics,
    mlknn,
    neighbours,
    ranking,
    split,
    tfidf,
)
from labelspark.plans import prediction, registry, training
from labelspark.sources import artifacts, runs
from tests.conftest import rows

SCORES = [  # instance, label, score, y
    (1, 1, 0.9, 1), (1, 2, 0.5, 0), (1, 3, 0.1, 1), (1, 4, 0.1, 0),
    (2, 1, 0.2, 0), (2, 2, 0.1, 0), (2, 3, 0.05, 0), (2, 4, 0.01, 0),
    (3, 1, 0.6, 1), (3, 2, 0.7, 1), (3, 3, 0.8, 1), (3, 4, 0.65, 1),
]
CATALOGUE = [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def _scores(spark, data=SCORES):
    df = spark.createDataFrame(data, "instance_id bigint, label_id int, score double, y int")
    names = spark.createDataFrame(CATALOGUE, "label_id int, name string")
    return df.join(names, "label_id")


def test_set_metrics(spark):
    d = metrics.decide(_scores(spark))
    assert metrics.hamming_loss(d).first()[0] == pytest.approx(2 / 12)
    assert metrics.subset_accuracy(d).first()[0] == pytest.approx(2 / 3)
    assert metrics.f1_micro(d).first()[0] == pytest.approx(10 / 12)
    assert metrics.f1_macro(d).first()[0] == pytest.approx((1 + 2 / 3 + 2 / 3 + 1) / 4)


def test_ranking_metrics(spark):
    s = _scores(spark)
    assert metrics.precision_at_k(s, 3).first()[0] == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert metrics.recall_at_k(s, 3).first()[0] == pytest.approx((1 + 1 + 3 / 4) / 3)
    assert metrics.precision_at_k(s, 9).first()[0] == pytest.approx((2 / 4 + 0 + 1) / 3)
    best = 1 + 1 / np.log2(3)
    assert metrics.ndcg_at_k(s, 3).first()[0] == pytest.approx(((1 + 0.5) / best + 1 + 1) / 3)
    for function in (metrics.precision_at_k, metrics.recall_at_k):
        with pytest.raises(ValueError):
            function(s, 0)


def test_evaluate_agrees_with_the_single_metrics(spark):
    d = metrics.decide(_scores(spark))
    row = metrics.evaluate(d).first()
    for name, value in (
        ("hamming_loss", metrics.hamming_loss(d)), ("subset_accuracy", metrics.subset_accuracy(d)),
        ("f1_micro", metrics.f1_micro(d)), ("f1_macro", metrics.f1_macro(d)),
        ("precision_at_3", metrics.precision_at_k(d)), ("recall_at_3", metrics.recall_at_k(d)),
    ):
        assert row[name] == pytest.approx(value.first()[0]), name


def test_perfect_and_empty_decisions(spark):
    perfect = metrics.decide(_scores(spark, [(1, 1, 1.0, 1), (1, 2, 0.0, 0)]))
    assert metrics.f1_micro(perfect).first()[0] == 1.0
    nothing = metrics.decide(_scores(spark, [(1, 1, 0.0, 0), (1, 2, 0.0, 0)]))
    assert metrics.f1_micro(nothing).first()[0] == 0.0
    assert metrics.f1_macro(nothing).first()[0] == 0.0


def test_predictions(spark):
    s = _scores(spark)
    got = rows(ranking.predict_topk(s), "instance_id")
    assert got == [(1, ["a", "b", "c"], [0.9, 0.5, 0.1]), (2, ["a", "b"], [0.2, 0.1]),
                   (3, ["c", "b", "d"], [0.8, 0.7, 0.65])]
    high = rows(ranking.predict_topk(s, min_confidence=0.3), "instance_id")
    assert high[1] == (2, [], [])
    answers = rows(ranking.predict_response(s, k=1, min_confidence=0.3), "instance_id")
    assert answers[1] == (2, [], [0.2, 0.1, 0.05]) and answers[0] == (1, ["a"], [0.9, 0.5, 0.1])
    assert ranking.confidence_observations(s).count() == 6
    catalogue = spark.createDataFrame(CATALOGUE, "id int, name string")
    assert rows(ranking.label_confidence(s, catalogue, "b"), "instance_id") == [(1, 0.5), (2, 0.1), (3, 0.7)]
    with pytest.raises(ValueError, match="a, b, c, d"):
        ranking.label_confidence(s, catalogue, "z")


def test_split_is_complete_balanced_and_repeatable(spark):
    df = spark.range(503).select(
        F.col("id").alias("instance_id"),
        F.when(F.col("id") < 300, F.array(F.lit(1))).when(F.col("id") % 7 == 0, F.array(F.lit(2), F.lit(1)))
        .otherwise(F.array(F.lit(3))).alias("genre_ids"),
    )
    parts = split.stratified_split(df, 0.2)
    assert parts.count() == 503 and parts.select("instance_id").distinct().count() == 503
    for r in parts.groupBy("set_key").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("v")).collect():
        assert abs(r["v"] - r["n"] / 5) < 1
    assert abs(parts.filter("is_validation").count() - 503 / 5) < 1
    assert rows(parts, "instance_id") == rows(split.stratified_split(df.repartition(7), 0.2), "instance_id")
    assert rows(parts, "instance_id") != rows(split.stratified_split(df, 0.2, seed=1), "instance_id")
    for bad in (0, 1, -0.1, 1.5):
        with pytest.raises(ValueError):
            split.stratified_split(df, bad)


def test_mlknn_formulas(spark):
    train = spark.createDataFrame(
        [(1, [1]), (2, [1, 2]), (3, [2]), (4, [3])], "instance_id bigint, genre_ids array<bigint>"
    )
    near = [(1, 1), (1, 2), (2, 2), (2, 1), (3, 3), (3, 2), (4, 4), (4, 3)]
    neighbours = spark.createDataFrame(near, "instance_id bigint, neighbour_id bigint")
    labels = spark.createDataFrame([(1,), (2,), (3,)], "label_id bigint")
    priors = mlknn.priors(train, labels, 1.0)
    assert {r["label_id"]: r["prior"] for r in priors.collect()} == {1: 0.5, 2: 0.5, 3: 2 / 6}
    table = {(r["label_id"], r["j"]): (r["cond1"], r["cond0"]) for r in
             mlknn.conditionals(neighbours, train, priors, 2, 1.0).collect()}
    held = {1: {1}, 2: {1, 2}, 3: {2}, 4: {3}}
    for label in (1, 2, 3):
        c1, c0 = [0] * 3, [0] * 3
        for i in held:
            j = sum(label in held[b] for a, b in near if a == i)
            (c1 if label in held[i] else c0)[j] += 1
        for j in range(3):
            want = ((1 + c1[j]) / (3 + sum(c1)), (1 + c0[j]) / (3 + sum(c0)))
            assert table[label, j] == pytest.approx(want)
    conditionals = mlknn.conditionals(neighbours, train, priors, 2, 1.0)
    post = mlknn.posterior(train.select("instance_id"), neighbours, train, priors, conditionals)
    assert post.count() == 12
    r = post.filter("instance_id = 4 AND label_id = 1").first()
    p1, p0 = 0.5 * table[1, 0][0], 0.5 * table[1, 0][1]
    assert r["score"] == pytest.approx(p1 / (p1 + p0)) and r["predicted"] == int(p1 >= p0)
    with pytest.raises(ValueError):
        mlknn.priors(train, labels, 0)


def _toy(spark, n=60):
    words = {1: "alpha beta gamma", 2: "delta epsilon zeta", 3: "eta theta iota"}
    data = []
    for i in range(n):
        a, b = 1 + i % 3, 1 + (i // 3) % 3
        ids = sorted({a, b})
        data.append((i, f"t{i}", " ".join(words[x] for x in ids) + f" filler{i % 4} filler{i % 5}", ids))
    data.append((n, "t0", data[0][2], [1]))  # a copy of row 0 by title and text
    return spark.createDataFrame(
        data, "instance_id bigint, title string, overview string, genre_ids array<bigint>"
    )


TOY = tfidf.TextProfile((1, 1), 100, min_df=2, max_df_ratio=0.95, sublinear_tf=True)


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    docs = _toy(spark)
    vocabulary = tfidf.fit_vocabulary(docs, TOY)
    weights = tfidf.weights(docs, vocabulary, TOY)
    n_terms = vocabulary.count()
    labels = spark.createDataFrame([(1,), (2,), (7,)], "label_id bigint")
    models, coefficients = binary_relevance.fit(docs, weights, labels, n_terms, tol=1e-9)
    by_label = {r["label_id"]: r for r in models.collect()}
    assert by_label[7]["constant_score"] == 0.0 and by_label[7]["intercept"] is None
    ids = [r[0] for r in docs.select("instance_id").orderBy("instance_id").collect()]
    x = np.zeros((len(ids), n_terms + 1))
    x[:, n_terms] = 1
    for r in weights.collect():
        x[ids.index(r["instance_id"]), r["rarity"] - 1] = r["weight"]
    held = {r["instance_id"]: set(r["genre_ids"]) for r in docs.collect()}
    scored = {(r["instance_id"], r["label_id"]): r for r in
              binary_relevance.scores(docs.select("instance_id"), weights, models, coefficients).collect()}
    for label in (1, 2):
        w = np.zeros(n_terms + 1)
        for r in coefficients.filter(F.col("label_id") == label).collect():
            w[r["rarity"] - 1] = r["coefficient"]
        w[n_terms] = by_label[label]["intercept"]
        p = 1 / (1 + np.exp(-x @ w))
        y = np.array([label in held[i] for i in ids], float)
        gradient = w + x.T @ (p - y)
        assert np.abs(gradient).max() < 1e-2
        for row, i in enumerate(ids):
            assert scored[i, label]["score"] == pytest.approx(p[row])
    assert scored[0, 7]["score"] == 0.0 and scored[0, 7]["is_constant"]


def test_train_all_stores_models_that_predict(spark, tmp_path):
    catalogue = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, name string")
    docs, path = _toy(spark), str(tmp_path / "artifacts")
    records = training.train_all(docs, catalogue, path, k=5, profile=TOY)
    assert records.filter("kind = 'error'").count() == 0
    assert records.filter("kind = 'metric' AND key = 'f1_micro' AND cast(value as double) > 0.8").count() == 2
    table = rows(training.compare_models(records), "position")
    assert [r[1] for r in table] == list(training.METRIC_ORDER)
    texts = spark.createDataFrame(
        [(1, "alpha beta gamma"), (2, "short"), (3, "nothing known in here"), (4, "delta epsilon zeta")],
        "instance_id bigint, overview string",
    )
    for name in training.MODELS:
        model = artifacts.load(spark, f"{path}/{name}")
        facts = prediction.model_facts(model).first()
        assert (facts["model_type"], facts["n_labels"]) == (name, 3)
        best = {r["instance_id"]: r["labels"] for r in prediction.predict_batch(model, texts, k=1).collect()}
        assert best[1] == ["a"] and best[4] == ["b"] and len(best) == 4
        answers, rejected = prediction.answer_requests(model, texts)
        assert rows(rejected) == [(2, "too_short")]
        assert answers.count() == 3 and answers.first()["inference_time_sec"] >= 0
        assert prediction.predict_batch(model, texts.limit(0)).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, f"{path}/missing")
    with pytest.raises(ValueError, match="unknown models"):
        training.train_all(docs, catalogue, path, models=("tree",))


def test_a_failing_model_does_not_stop_the_other(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise RuntimeError("no fit today")

    monkeypatch.setattr(training, "train_binary_relevance", fail)
    catalogue = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    records = training.train_all(_toy(spark), catalogue, str(tmp_path / "a"), k=3, profile=TOY)
    kinds = {(r["experiment"], r["kind"]) for r in records.collect()}
    assert ("binary_relevance", "error") in kinds and ("ml_knn", "metric") in kinds
    table = rows(training.compare_models(records).select("best_model"))
    assert set(table) == {("ml_knn",)}


def test_a_failure_does_not_pass_for_a_result(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise ValueError("no fit today")

    monkeypatch.setattr(training, "train_binary_relevance", fail)
    catalogue = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    path = str(tmp_path / "a")
    with pytest.raises(RuntimeError, match="binary_relevance; no fit today"):
        training.train_all(_toy(spark), catalogue, path, k=3, profile=TOY, complete=True)
    kinds = {(r["experiment"], r["kind"]) for r in runs.read(spark, f"{path}/runs").collect()}
    assert ("binary_relevance", "error") in kinds and ("ml_knn", "metric") in kinds
    with pytest.raises(RuntimeError, match="no fit today"):
        training.train_all(
            _toy(spark), catalogue, str(tmp_path / "b"), models=("binary_relevance",), k=3, profile=TOY
        )


def test_train_all_models_asks_for_every_model(spark, monkeypatch):
    def fail(*_):
        raise ValueError("no fit today")

    docs = _toy(spark)
    catalogue = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    monkeypatch.setattr(training, "train_ml_knn", fail)
    monkeypatch.setattr(registry.inputs, "labelled_documents", lambda *_: docs)
    monkeypatch.setattr(registry.inputs, "document_catalogue", lambda *_: catalogue)
    with pytest.raises(RuntimeError, match="ml_knn"):
        registry.QUERIES["train_all_models"](spark, "")


def test_compare_models_prefers_low_loss(spark):
    data = [("r", "binary_relevance", "metric", "hamming_loss", "0.2"), ("s", "ml_knn", "metric", "hamming_loss", "0.1"),
            ("r", "binary_relevance", "metric", "f1_micro", "0.2"), ("s", "ml_knn", "metric", "f1_micro", "0.1")]
    got = rows(training.compare_models(spark.createDataFrame(data, runs.RUN_SCHEMA)).select("metric", "best_model", "best_value"), "metric")
    assert got == [("f1_micro", "binary_relevance", 0.2), ("hamming_loss", "ml_knn", 0.1)]


def test_unlabelled_instances_stay_in_the_split(spark):
    df = spark.createDataFrame(
        [(1, [1]), (2, None), (3, []), (4, [1]), (None, [2])],
        "instance_id long, genre_ids array<long>",
    )
    parts = split.stratified_split(df, 0.25)
    assert parts.count() == 5
    assert {r["set_key"] for r in parts.collect()} == {"1", "", "2"}


def test_responses_are_bounded_by_their_labels_not_by_k(spark):
    scores = spark.createDataFrame(
        [(1, i, f"n{i}", 0.9 - i / 100) for i in range(15)],
        "instance_id long, label_id int, name string, score double",
    )
    few = ranking.predict_response(scores.filter("label_id < 3"), k=20).first()
    assert few["predicted_labels"] == ["n0", "n1", "n2"]
    assert len(ranking.predict_response(scores, k=10).first()["predicted_labels"]) == 10
    with pytest.raises(Exception, match="at most 10"):
        ranking.predict_response(scores, k=20).collect()


def test_unknown_label_lists_all_names(spark):
    catalogue = spark.range(1001).selectExpr("CAST(id AS int) AS id", "concat('l', id) AS name")
    scores = spark.createDataFrame([], "instance_id long, label_id int, score double")
    with pytest.raises(ValueError, match="l1000$"):
        ranking.label_confidence(scores, catalogue, "none")


@pytest.mark.parametrize(("dense", "products"), [(1024, 4_000_000), (2, 7), (1, 1)])
def test_kernel_slices_give_the_same_cosines(monkeypatch, dense, products):
    monkeypatch.setattr(neighbours, "DENSE_TERMS", dense)
    monkeypatch.setattr(neighbours, "SLICE_PRODUCTS", products)
    pick = np.random.default_rng(1)
    sides = []
    for n in (9, 13):
        matrix = pick.random((n, 30)) * (pick.random((n, 30)) < 0.3)
        matrix[:, :3] = pick.random((n, 3))
        rows_, terms = np.nonzero(matrix)
        order = np.argsort(terms, kind="stable")
        rows_, terms = rows_[order], terms[order]
        sides.append((matrix, (rows_, terms, matrix[rows_, terms])))
    (a, flat_a), (b, flat_b) = sides
    shared = np.intersect1d(flat_a[1], flat_b[1])
    flat = [
        tuple(x[np.isin(f[1], shared)] for x in (f[0], np.searchsorted(shared, f[1]), f[2]))
        for f in (flat_a, flat_b)
    ]
    got = neighbours._cosines((9, 13), *flat)
    assert np.allclose(got, a @ b.T)
