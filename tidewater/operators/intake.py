"""Bronze: raw bus records become envelope rows; what carries no envelope is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import contracts as C

EMPTY_VALUE = "empty_kafka_value"
NO_ENVELOPE = "unparseable_or_empty_envelope"


def inspect_records(raw: DataFrame) -> DataFrame:
    """Adds `body` (text), `envelope` (parsed once, with `data` as JSON text) and `defect` (null for a
    usable record).

    A record is unusable when it has no value, or when neither an id nor a type can be read from it;
    an envelope that lacks just one of the two is kept and judged later.
    """
    # The one-element explode keeps later filters on `defect` from repeating the parse below it.
    read = raw.withColumn("body", F.col("value").cast("string")).withColumn(
        "envelope", F.explode(F.array(F.from_json("body", f"{C.ENVELOPE}, data string")))
    )
    anonymous = F.coalesce(F.col("envelope.event_id"), F.col("envelope.event_type")).isNull()
    return read.withColumn("defect", F.when(F.col("body").isNull(), EMPTY_VALUE).when(anonymous, NO_ENVELOPE))


def bronze_rows(inspected: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Usable records flattened; repeated deliveries stay, the payload stays JSON text."""
    when = F.current_timestamp() if ingested_at is None else ingested_at
    header = [F.col(f"envelope.{name}") for name in (
        "event_id", "event_type", "schema_version", "occurred_at", "producer", "correlation_id", "causation_id",
    )]
    return inspected.where(F.col("defect").isNull()).select(
        *header,
        F.col("envelope.trace_context.traceparent").alias("traceparent"),
        F.col("envelope.data").alias("data_json"),
        *_coordinates(),
        when.alias("ingested_at"),
        F.to_date(F.try_to_timestamp(F.col("envelope.occurred_at"))).alias("date"),
    )


def bronze_rejects(inspected: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """The complement of `bronze_rows`, with the text as received; dated by arrival."""
    when = F.current_timestamp() if ingested_at is None else ingested_at
    return inspected.where(F.col("defect").isNotNull()).select(
        *_coordinates(),
        F.col("body").alias("raw_value"),
        F.col("defect").alias("reason"),
        when.alias("ingested_at"),
        F.to_date(when).alias("date"),
    )


def _coordinates() -> list[Column]:
    return [
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    ]
