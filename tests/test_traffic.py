import datetime as dt
import math
import os

import pytest

from labelspark.operators import traffic
from labelspark.streaming import traffic as live
from tests.conftest import rows

SCHEMA = (
    "ts timestamp, method string, endpoint string, status int, model_type string, genre string, "
    "latency_sec double, confidence double"
)


def _log(spark, n=40):
    start = dt.datetime(2024, 1, 1, 12, 0, 3)
    data = []
    for i in range(n):
        model = "transformation" if i % 3 else "adaptation"
        data.append((start + dt.timedelta(seconds=7 * i), "POST", f"/predict/{model}",
                     500 if i % 10 == 0 else 200, model, "ab"[i % 2], 0.005 * (i % 9), 0.05 * (i % 12)))
    data.append((start, "GET", "/health", 200, None, None, 0.001, None))
    return spark.createDataFrame(data, SCHEMA)


def test_histogram_buckets_are_cumulative_and_inclusive(spark):
    df = spark.createDataFrame([("a", 0.005), ("a", 0.0051), ("a", 99.0), ("b", 0.1)], "k string, v double")
    got = {(r["k"], r["le"]): r for r in traffic.histogram(df, "v", ["k"]).collect()}
    assert len(got) == 2 * (len(traffic.BUCKETS) + 1)
    assert got["a", "0.005"]["cumulative"] == 1 and got["a", "0.01"]["cumulative"] == 2
    assert got["a", "10.0"]["cumulative"] == 2 and got["a", "+Inf"]["cumulative"] == 3
    assert got["b", "0.075"]["cumulative"] == 0 and got["b", "0.1"]["cumulative"] == 1
    assert got["a", "+Inf"]["sum"] == pytest.approx(99.0101)


def test_counts_and_failures(spark):
    log = _log(spark)
    assert sum(r["count"] for r in traffic.request_count(log).collect()) == 41
    volume = {r["model_type"]: r["count"] for r in traffic.prediction_volume(log).collect()}
    assert volume["adaptation"] == 14 and volume["transformation"] == 26
    endpoints = {r["endpoint"] for r in traffic.latency_histogram(log).collect()}
    assert endpoints == set(traffic.PREDICT_ENDPOINTS)
    observed = {r["model_type"]: r["total"] for r in traffic.inference_histogram(log.filter("method = 'POST'")).collect()}
    assert sum(observed.values()) == 36


def test_sliding_rates_equal_spark_windows(spark):
    log = _log(spark)
    got = rows(traffic.request_rate(log), "window_start", "method", "endpoint", "status")
    want = rows(
        live.request_rate(log).selectExpr("window_start", "method", "endpoint", "status", "n / 60.0D AS rate"),
        "window_start", "method", "endpoint", "status",
    )
    assert got == want and len(got) > 50
    with pytest.raises(ValueError):
        traffic.request_rate(log, "1 minute", "7 seconds")


def test_mean_confidence_and_snapshot(spark):
    log = _log(spark)
    kept = [r["confidence"] for r in log.collect() if r["status"] < 400 and (r["confidence"] or 0) > 0.1]
    assert traffic.mean_confidence(log).first()[0] == pytest.approx(sum(kept) / len(kept))
    snapshot = traffic.metrics_snapshot(log).collect()
    total = sum(r["value"] for r in snapshot if r["metric"] == "http_requests_total")
    assert total == 41
    counts = [r["value"] for r in snapshot if r["metric"] == "model_prediction_confidence_count"]
    assert sum(counts) == len(kept)


@pytest.mark.parametrize("files_per_trigger", [1, None])
def test_stream_equals_batch(spark, tmp_path, files_per_trigger):
    log = _log(spark)
    path = str(tmp_path / "log")
    log.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 11).parquet(path)
    keys = ["window_start", "method", "endpoint", "status"]
    cases = [
        (live.request_rate, live.request_rate, keys),
        (traffic.request_count, traffic.request_count, keys[1:]),
        (traffic.latency_histogram, traffic.latency_histogram, ["endpoint", "le"]),
        (live.mean_inference_time, live.mean_inference_time, ["window_start", "model_type"]),
    ]
    for i, (build, batch, by) in enumerate(cases):
        stream = live.read_log(spark, path, log.schema, files_per_trigger)
        query = live.run(build(stream), f"{tmp_path}/out{i}", f"{tmp_path}/state{i}")
        query.awaitTermination()
        got = live.latest(spark, f"{tmp_path}/out{i}", by)
        want = batch(log).select(*got.columns)
        a, b = rows(got, *by), rows(want, *by)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or math.isclose(u, v)


def test_stream_of_unordered_files(spark, tmp_path):
    """With a lateness that spans the files their order does not matter; counts need none."""
    log = _log(spark)
    path = str(tmp_path / "log")
    for i, part in enumerate(log.randomSplit([1.0] * 6, seed=3)):
        part.orderBy(*(["ts"] if i % 2 else [log["ts"].desc()])).coalesce(1).write.mode("append").parquet(path)
    late = "1 day"
    cases = [
        (lambda x: live.request_rate(x, lateness=late), ["window_start", "method", "endpoint", "status"]),
        (lambda x: live.volume_rate(x, lateness=late), ["window_start", "model_type"]),
        (lambda x: live.mean_inference_time(x, lateness=late), ["window_start", "model_type"]),
        (traffic.inference_histogram, ["model_type", "le"]),
        (traffic.logged_confidence_histogram, ["model_type", "genre", "le"]),
        (traffic.prediction_volume, ["model_type"]),
        (traffic.mean_confidence, []),
    ]
    for i, (build, by) in enumerate(cases):
        stream = live.read_log(spark, path, log.schema, 1)
        running = build(stream)
        live.run(running, f"{tmp_path}/out{i}", f"{tmp_path}/state{i}").awaitTermination()
        got = live.latest(spark, f"{tmp_path}/out{i}", by, running.schema)
        a, b = rows(got, *by), rows(build(log).select(*got.columns), *by)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(u == v or math.isclose(u, v) for u, v in zip(x, y))


def test_latest_before_any_batch(spark, tmp_path):
    schema = traffic.prediction_volume(_log(spark)).schema
    assert live.latest(spark, f"{tmp_path}/nothing", ["model_type"], schema).count() == 0


def test_current_result_is_one_bounded_version(spark, tmp_path):
    """Whatever the number of batches, the present result equals the batch and is read from one
    folder; a version before it is kept, older ones go."""
    log = _log(spark)
    path = str(tmp_path / "log")
    log.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 5).parquet(path)
    for i, (build, keys) in enumerate([*traffic.SNAPSHOT_PARTS, (traffic.mean_confidence, [])]):
        running, out = build(live.read_log(spark, path, log.schema, 1)), f"{tmp_path}/out{i}"
        assert live.current(spark, out, running.schema).count() == 0
        live.run_current(running, out, f"{tmp_path}/state{i}", keys).awaitTermination()
        got = live.current(spark, out, running.schema)
        a, b = rows(got, *keys), rows(build(log).select(*got.columns), *keys)
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert all(u == v or math.isclose(u, v) for u, v in zip(x, y))
        assert sorted(os.listdir(out)) == ["version=7", "version=8"]
        # The last batch run again, its state lost: finished versions stay as they are.
        before = os.path.getmtime(f"{out}/version=8/_SUCCESS")
        live.run_current(build(live.read_log(spark, path, log.schema)), out, f"{tmp_path}/other{i}", keys).awaitTermination()
        assert os.path.getmtime(f"{out}/version=8/_SUCCESS") == before
        assert sorted(os.listdir(out)) == ["version=7", "version=8"]


def test_past_windows_expire(spark, tmp_path):
    log = _log(spark)
    path = str(tmp_path / "log")
    log.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 7).parquet(path)
    running = live.request_rate(live.read_log(spark, path, log.schema, 1))
    keys = ["window_start", "method", "endpoint", "status"]
    live.run_current(running, f"{tmp_path}/out", f"{tmp_path}/state", keys, ("window_start", 60)).awaitTermination()
    got = live.current(spark, f"{tmp_path}/out", running.schema)
    want = live.request_rate(log)
    last = want.agg({"window_start": "max"}).first()[0]
    columns = want.columns
    assert rows(got.select(*columns), *keys) == rows(want.filter(f"window_start >= {last - 60}"), *keys)
