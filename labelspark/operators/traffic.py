"""Aggregates of a prediction log.

The log has one row per request: (ts, method, endpoint, status, model_type, genre,
latency_sec, confidence). All functions but ``request_rate`` and its like work unchanged on
a streaming log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histogram buckets, a last open one follows.
BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)
OPEN_BUCKET = "+Inf"

# The endpoints whose latency is observed, and the confidence floor.
PREDICT_ENDPOINTS = ("/predict/transformation", "/predict/adaptation")
MIN_CONFIDENCE = 0.1

# The dashboard's rate window and its refresh interval.
RATE_WINDOW = "1 minute"
RATE_SLIDE = "10 seconds"


def succeeded() -> Column:
    """Requests that got as far as a prediction."""
    return F.col("status") < 400


def request_count(log: DataFrame) -> DataFrame:
    """(method, endpoint, status, count)."""
    return log.groupBy("method", "endpoint", "status").agg(F.count("*").alias("count"))


def histogram(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., le, cumulative, total, sum): cumulative buckets, one grouping, no join."""
    counts = [F.count_if(F.col(value) <= le).alias(f"le_{i}") for i, le in enumerate(BUCKETS)]
    buckets = [
        F.struct(F.lit(repr(le)).alias("le"), F.col(f"le_{i}").alias("cumulative"))
        for i, le in enumerate(BUCKETS)
    ]
    buckets.append(F.struct(F.lit(OPEN_BUCKET).alias("le"), F.col("total").alias("cumulative")))
    return (
        rows.groupBy(*by)
        .agg(*counts, F.count(value).alias("total"), F.sum(value).alias("sum"))
        .select(*by, "total", "sum", F.explode(F.array(*buckets)).alias("bucket"))
        .select(*by, "bucket.le", "bucket.cumulative", "total", "sum")
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    """Request latency by endpoint, prediction endpoints only."""
    return histogram(
        log.filter(F.col("endpoint").isin(*PREDICT_ENDPOINTS)), "latency_sec", ["endpoint"]
    )


def inference_histogram(log: DataFrame) -> DataFrame:
    """Inference time by model; failed requests have none."""
    return histogram(log.filter(succeeded()), "latency_sec", ["model_type"])


def confidence_histogram(observations: DataFrame) -> DataFrame:
    """Recorded confidences by model and label."""
    return histogram(observations, "confidence", ["model_type", "genre"])


def logged_confidences(log: DataFrame) -> DataFrame:
    """Log rows that hold a recorded confidence: successful, strictly above the floor."""
    return log.filter(succeeded() & (F.col("confidence") > MIN_CONFIDENCE))


def prediction_volume(log: DataFrame) -> DataFrame:
    """(model_type, count): all prediction requests, failed ones too."""
    return log.groupBy("model_type").agg(F.count("*").alias("count"))


def _seconds(duration: str) -> int:
    """Length of an interval such as '10 seconds'."""
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    number, name = duration.split()
    return int(number) * unit[name.rstrip("s")]


def sliding(
    log: DataFrame, by: list[str], window: str, slide: str, value: str | None = None
) -> DataFrame:
    """(window_start, by..., n, total) per sliding window, for a batch log.

    Rows are first combined into slots one slide long; only the slots, not the rows, are
    repeated for the windows they fall into.
    """
    width, step = _seconds(window), _seconds(slide)
    if width % step:
        raise ValueError(f"window {window} must be a multiple of slide {slide}")
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / step) * step
    total = F.sum(value) if value else F.count("*")
    slots = log.groupBy(slot.alias("slot"), *by).agg(
        F.count(value if value else "*").alias("n"), total.alias("total")
    )
    starts = F.sequence(F.col("slot") - (width - step), F.col("slot"), F.lit(step).cast("bigint"))
    return (
        slots.select(F.explode(starts).alias("window_start"), *by, "n", "total")
        .groupBy("window_start", *by)
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


def request_rate(log: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE) -> DataFrame:
    """(window_start, method, endpoint, status, rate): requests per second."""
    by = ["method", "endpoint", "status"]
    return sliding(log, by, window, slide).select(
        "window_start", *by, (F.col("n") / F.lit(float(_seconds(window)))).alias("rate")
    )


def volume_rate(log: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE) -> DataFrame:
    """(window_start, model_type, rate): prediction requests per second."""
    return sliding(log, ["model_type"], window, slide).select(
        "window_start", "model_type",
        (F.col("n") / F.lit(float(_seconds(window)))).alias("rate"),
    )


def mean_inference_time(
    log: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE
) -> DataFrame:
    """(window_start, model_type, mean_sec) of the successful requests."""
    rows = sliding(log.filter(succeeded()), ["model_type"], window, slide, "latency_sec")
    return rows.select(
        "window_start", "model_type", (F.col("total") / F.col("n")).alias("mean_sec")
    )


def mean_confidence(log: DataFrame) -> DataFrame:
    """One row: mean of all recorded confidences."""
    return logged_confidences(log).agg(F.avg("confidence").alias("mean_confidence"))


def _labels(names: list[str]) -> Column:
    return F.create_map(*[p for n in names for p in (F.lit(n), F.col(n).cast("string"))])


def _counter_series(rows: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    return rows.select(
        F.lit(metric).alias("metric"), _labels(labels).alias("labels"),
        F.lit(None).cast("string").alias("le"), F.col("count").cast("double").alias("value"),
    )


def _histogram_series(rows: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """Bucket, sum and count series of one histogram, from a single pass over it."""
    none = F.lit(None).cast("string")

    def point(suffix: str, le: Column, value: str) -> Column:
        return F.struct(
            F.lit(f"{metric}_{suffix}").alias("metric"), le.alias("le"),
            F.col(value).cast("double").alias("value"),
        )

    bucket = point("bucket", F.col("le"), "cumulative")
    totals = F.array(bucket, point("sum", none, "sum"), point("count", none, "total"))
    points = F.when(F.col("le") == OPEN_BUCKET, totals).otherwise(F.array(bucket))
    return rows.select(_labels(labels).alias("labels"), F.explode(points).alias("point")).select(
        "point.metric", "labels", "point.le", "point.value"
    )


def logged_confidence_histogram(log: DataFrame) -> DataFrame:
    """Confidences that the log records, by model and label."""
    return confidence_histogram(logged_confidences(log))


# The aggregates a snapshot is made of, in the order ``snapshot_of`` takes them, and the keys of
# their rows. Each of them also runs on a stream.
SNAPSHOT_PARTS = (
    (request_count, ["method", "endpoint", "status"]),
    (prediction_volume, ["model_type"]),
    (latency_histogram, ["endpoint", "le"]),
    (inference_histogram, ["model_type", "le"]),
    (logged_confidence_histogram, ["model_type", "genre", "le"]),
)


def snapshot_of(
    requests: DataFrame, volume: DataFrame, latency: DataFrame, inference: DataFrame,
    confidence: DataFrame,
) -> DataFrame:
    """(metric, labels MAP, le, value) from the five aggregates."""
    # Names of the series.
    parts = [
        _counter_series(requests, "http_requests_total", ["method", "endpoint", "status"]),
        _counter_series(volume, "model_requests_total", ["model_type"]),
        _histogram_series(latency, "http_request_duration_seconds", ["endpoint"]),
        _histogram_series(inference, "model_inference_duration_seconds", ["model_type"]),
        _histogram_series(confidence, "model_prediction_confidence", ["model_type", "genre"]),
    ]
    snapshot = parts[0]
    for part in parts[1:]:
        snapshot = snapshot.unionAll(part)
    return snapshot


def metrics_snapshot(log: DataFrame) -> DataFrame:
    """(metric, labels MAP, le, value): the current value of every series."""
    return snapshot_of(*[build(log) for build, _ in SNAPSHOT_PARTS])
