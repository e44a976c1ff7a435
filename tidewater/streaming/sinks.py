"""Writing micro-batches so that a repeated batch leaves one copy."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


METRIC_ROW = "batch_id bigint, outcome string, rows bigint, seconds double"


def record(batch: DataFrame, path: str, layer: str, dataset: str, batch_id: int, counts: dict[str, int],
           seconds: float) -> None:
    """One row per outcome of a batch, in that batch's own folder: a repeated batch replaces its rows."""
    rows = [(batch_id, outcome, n, seconds) for outcome, n in counts.items()]
    if rows:
        frame = batch.sparkSession.createDataFrame(rows, METRIC_ROW).coalesce(1)
        frame = frame.withColumn("layer", F.lit(layer)).withColumn("dataset", F.lit(dataset))
        write_batch(frame, path, batch_label(batch, batch_id), "layer", "dataset")


def batch_label(df: DataFrame, batch_id: int) -> str:
    """Batch number within its query: a query started afresh never overwrites what another one wrote."""
    query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    return f"{query[:8]}-{batch_id}"


def write_day_partitions(df: DataFrame, path: str, label: str, *leading: str) -> None:
    """Dated output of one batch. Rows of a day are brought together before the write, so a day costs
    one file and not one per task; a day with very many rows is split again by adaptive execution."""
    write_batch(df.hint("rebalance", *leading, "date"), path, label, *leading, "date")


def write_batch(df: DataFrame, path: str, label: str, *partitions: str) -> None:
    """Overwrite this label's partitions only. The data has its own folder per batch, so running the
    batch again replaces its output instead of adding to it."""
    (
        df.withColumn("batch", F.lit(label))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch")
        .parquet(path)
    )


def _observed(watch: Observation) -> dict[str, int] | None:
    """What the finished write has counted; None where a result without rows was planned away, and the count with it."""
    try:
        return {name: n or 0 for name, n in watch.get.items()}
    except Py4JJavaError:
        return None


def routed_sink(layer: str, dataset: str, tag: Callable[[DataFrame], DataFrame], column: str,
                outputs: dict[str, Callable[[DataFrame, str], None]],
                metrics: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: `tag` is computed once, each row goes to the output named by `column`.

    Rows are counted by outcome while the first output is written, which also keeps the tagged batch for the others;
    of these, the ones without rows are skipped. Counts and seconds of each batch go to the table `metrics`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        started, label, watch = time.monotonic(), batch_label(batch, batch_id), Observation()
        each = [F.count_if(F.col(column) == name).alias(name) for name in outputs]
        tagged = tag(batch).observe(watch, *each).persist()
        counts: dict[str, int] | None = None
        try:
            for name, emit in outputs.items():
                if counts is None or counts.get(name):
                    emit(tagged, label)
                if counts is None:
                    counts = _observed(watch)
            if counts is None:
                counts = tagged.agg(*each).first().asDict()
        finally:
            tagged.unpersist()
        if metrics:
            record(batch, metrics, layer, dataset, batch_id, {k: n for k, n in counts.items() if n}, time.monotonic() - started)

    return write


def plain_sink(layer: str, dataset: str, path: str, metrics: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for aggregates: one dated output, counted while it is written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        started, label, watch = time.monotonic(), batch_label(batch, batch_id), Observation()
        write_day_partitions(batch.observe(watch, F.count(F.lit(1)).alias("output")), path, label)
        counts = _observed(watch)
        if metrics and counts and counts["output"]:
            record(batch, metrics, layer, dataset, batch_id, counts, time.monotonic() - started)

    return write


def metrics_frame(spark: SparkSession, path: str) -> DataFrame:
    """Rows by outcome and seconds of every batch of every query that wrote to this metrics table."""
    return spark.read.schema(f"{METRIC_ROW}, layer string, dataset string, batch string").parquet(path)
