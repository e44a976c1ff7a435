"""Starting and stopping the queries of the three layers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater import contracts as C
from tidewater.operators import aggregates, intake, refine
from tidewater.sources import lake as L
from tidewater.streaming import sinks


def _start(df: DataFrame, name: str, checkpoint: str, sink, once: bool, seconds: int) -> StreamingQuery:
    """Each query runs in a scheduler pool of its own, so that none waits for the others' jobs."""
    context = df.sparkSession.sparkContext
    context.setLocalProperty("spark.scheduler.pool", name)
    try:
        writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode("append")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
        return writer.foreachBatch(sink).start()
    finally:
        context.setLocalProperty("spark.scheduler.pool", None)


def start_bronze(raw: DataFrame, lake: L.Lake, *, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Bus records of all topics to bronze, unusable ones to quarantine.

    The arrival time is taken in the streaming plan, where it is fixed with the batch: a batch repeated after
    midnight keeps its dates.
    """
    arrived = F.col("_arrived_at")

    def tag(batch: DataFrame) -> DataFrame:
        inspected = intake.inspect_records(batch)
        return inspected.withColumn("fate", F.when(F.col("defect").isNull(), "valid").otherwise("malformed"))

    def valid(tagged: DataFrame, label: str) -> None:
        sinks.write_day_partitions(intake.bronze_rows(tagged, arrived), lake.bronze_all, label, "event_type")

    def malformed(tagged: DataFrame, label: str) -> None:
        sinks.write_day_partitions(intake.bronze_rejects(tagged, arrived), lake.bronze_rejects, label)

    sink = sinks.routed_sink("bronze", "all_topics", tag, "fate", {"valid": valid, "malformed": malformed},
                             lake.metrics)
    return _start(raw.withColumn("_arrived_at", F.current_timestamp()), "bronze", lake.checkpoint("bronze"), sink, once, seconds)


def silver_sink(lake: L.Lake, event_type: str):
    paths = {refine.ON_TIME: lake.silver, refine.LATE: lake.late, refine.REJECTED: lake.rejects}

    def emit(route: str, tagged: DataFrame, label: str) -> None:
        rows = refine.destination(tagged, route).drop("event_type")
        sinks.write_day_partitions(rows, paths[route](event_type), label)

    return sinks.routed_sink(
        "silver", event_type, lambda batch: batch, "route", {route: partial(emit, route) for route in paths},
        lake.metrics,
    )


def start_silver(spark: SparkSession, lake: L.Lake, event_type: str, *, once: bool = False, seconds: int = 5,
                 files_per_trigger: int | None = None) -> StreamingQuery:
    """One type's bronze to silver, late events or rejects, without repeated events."""
    source = L.bronze_stream(spark, lake, event_type, files_per_trigger)
    events = refine.distinct_events_stream(refine.candidates(source, event_type))
    return _start(events, f"silver-{event_type}", lake.checkpoint(f"silver/{event_type}"),
                  silver_sink(lake, event_type), once, seconds)


def start_gold(spark: SparkSession, lake: L.Lake, dataset: str, *, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """One aggregate over silver.

    Rows appear when their window has closed. The joined datasets close a window only after the join's
    time bound of seven days has passed it; earlier figures come from `plans/backfill.py`. Files that a backfill
    of silver swapped in are not counted again: the same backfill of gold accounts for them.
    """
    df = aggregates.build(dataset, lambda t: L.silver_stream(spark, lake, t, backfilled=False))
    return _start(df, f"gold-{dataset}", lake.checkpoint(f"gold/{dataset}"),
                  sinks.plain_sink("gold", dataset, lake.gold(dataset), lake.metrics), once, seconds)


def start_all_silver(spark: SparkSession, lake: L.Lake, **options) -> list[StreamingQuery]:
    return [start_silver(spark, lake, t, **options) for t in C.EVENT_TYPES]


def start_all_gold(spark: SparkSession, lake: L.Lake, **options) -> list[StreamingQuery]:
    return [start_gold(spark, lake, name, **options) for name in aggregates.DATASETS]


def finish(queries: list[StreamingQuery]) -> None:
    """Wait for run-once queries; the first failure is raised."""
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
