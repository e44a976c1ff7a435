"""Silver: typed payloads, a verdict per row, deduplication, and one destination per row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import contracts as C

ON_TIME, LATE, REJECTED = "on_time", "late", "rejected"
_HEADER = ("event_id", "event_type", "schema_version", "producer", "correlation_id", "causation_id", "traceparent",
           "kafka_topic", "kafka_partition", "kafka_offset", "ingested_at")


def typed(bronze: DataFrame, event_type: str, version: str = C.V1) -> DataFrame:
    """Payload fields as typed columns next to the header.

    A field of the wrong type becomes null on its own. The time text stays in `occurred_at`;
    `event_time` is its parsed form, null when unusable.
    """
    payload = C.payload_type(event_type, version)
    documents = {"original_event"} & set(payload.names) if event_type == C.DEAD_LETTER else set()
    parsed = bronze.withColumn("payload", F.from_json("data_json", payload)).withColumn(
        "event_time", F.try_to_timestamp(F.col("occurred_at"))
    )
    fields = [
        F.get_json_object("data_json", f"$.{name}").alias(name) if name in documents else F.col(f"payload.{name}")
        for name in payload.names
    ]
    return parsed.select(*_HEADER, "occurred_at", "event_time", *fields)


def defect(event_type: str) -> Column:
    """First applicable reason against a row, null for a sound one.

    Every test is null-safe: a missing version is an unknown version, so no row can fall between
    the valid and the rejected ones.
    """
    known = F.coalesce(F.col("schema_version").isin(C.versions_of(event_type)), F.lit(False))
    verdict = (
        F.when(~known, "unknown_schema_version")
        .when(F.col("event_id").isNull(), "missing_event_id")
        .when(F.col("event_time").isNull(), "invalid_timestamp")
    )
    for name in C.MANDATORY.get(event_type, ()):
        verdict = verdict.when(F.col(name).isNull(), f"missing_required_field:{name}")
    return verdict


def is_late() -> Column:
    """Arrived more than ten minutes after it happened; an unknown arrival time counts as prompt."""
    lag = F.col("ingested_at").cast("double") - F.col("event_time").cast("double")
    return F.coalesce(lag > C.LATE_AFTER_SECONDS, F.lit(False))


def judged(candidates: DataFrame, event_type: str) -> DataFrame:
    """Adds `defect` and `route`; validity is decided before lateness. Never drops a row."""
    return _with_route(candidates.withColumn("defect", defect(event_type)))


def _with_route(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "route", F.when(F.col("defect").isNotNull(), REJECTED).when(is_late(), LATE).otherwise(ON_TIME)
    )


def judged_any(bronze: DataFrame) -> DataFrame:
    """`event_time`, `defect` and `route` for bronze rows of all types in one pass.

    Only the mandatory keys are read from the payload, so one parse serves every type. For reports and
    counts; tables of a type need `candidates`.
    """
    keys = sorted({name for names in C.MANDATORY.values() for name in names})
    read = bronze.withColumn("event_time", F.try_to_timestamp(F.col("occurred_at"))).withColumn(
        "payload", F.from_json("data_json", ", ".join(f"{name} string" for name in keys))
    )
    known = " or ".join(f"(event_type = '{t}' and schema_version = '{v}')" for t, v in C.PAYLOADS)
    missing = " ".join(
        f"when event_type = '{t}' and payload.{name} is null then 'missing_required_field:{name}'"
        for t, names in C.MANDATORY.items() for name in names
    )
    verdict = F.expr(f"""case when not coalesce({known}, false) then 'unknown_schema_version'
        when event_id is null then 'missing_event_id' when event_time is null then 'invalid_timestamp'
        {missing} end""")
    return _with_route(read.withColumn("defect", verdict)).drop("payload")


def distinct_events(df: DataFrame, *keys: str) -> DataFrame:
    """Batch form of deduplication: the copy with the lowest bus position survives.

    An aggregate rather than a window, so copies collapse before the shuffle. Over rows of several
    types the keys are `event_type`, `event_id`; within one type the id alone.
    """
    row = F.struct(*df.columns)
    position = F.struct("kafka_partition", "kafka_offset")
    return df.groupBy(*(keys or ("event_id",))).agg(F.min_by(row, position).alias("kept")).select("kept.*")


def decisions(judged: DataFrame) -> DataFrame:
    """(event_type, event_id, rows, latest, defect, route): the verdict of the copy that `distinct_events` keeps, the rows
    of the id, and when the last of them came.

    For reports over all types. Position and verdict are one number, whose least a hash aggregate keeps in place, where
    rows or text would be sorted first. A missing partition or offset is the lowest position.
    """
    defects = ["unknown_schema_version", "missing_event_id", "invalid_timestamp",
               *sorted({f"missing_required_field:{name}" for names in C.MANDATORY.values() for name in names})]
    verdicts = [ON_TIME, LATE, *defects]
    code = F.array_position(F.lit(verdicts), F.coalesce("defect", "route"))
    whole, room = "decimal(38,0)", 1 << (len(verdicts) + 1).bit_length()
    place = F.coalesce((F.col("kafka_partition").cast(whole) + F.lit(Decimal((1 << 31) + 1))).cast(whole), F.lit(Decimal(0)))
    offset = F.coalesce((F.col("kafka_offset").cast(whole) + F.lit(Decimal((1 << 63) + 1))).cast(whole), F.lit(Decimal(0)))
    # Exact: at most 2 ** 33 places, 2 ** 65 offsets and 2 ** 7 verdicts, below 10 ** 38.
    at = ((place * F.lit(Decimal(1 << 65))).cast(whole) + offset).cast(whole)
    least = ((at * F.lit(Decimal(room))).cast(whole) + code.cast(whole)).cast(whole)
    found = judged.select("event_type", "event_id", "ingested_at", least.alias("least")).groupBy("event_type", "event_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ingested_at").alias("latest"), F.min("least").alias("least"))
    verdict = F.element_at(F.lit(verdicts), F.pmod("least", F.lit(Decimal(room))).cast("int"))
    settled = F.col("verdict").isin(ON_TIME, LATE)
    return found.select("event_type", "event_id", "rows", "latest", verdict.alias("verdict")).select(
        "event_type", "event_id", "rows", "latest", F.when(~settled, F.col("verdict")).alias("defect"),
        F.when(settled, F.col("verdict")).otherwise(REJECTED).alias("route"))


def distinct_events_stream(df: DataFrame) -> DataFrame:
    """Streaming form. The watermark is on arrival time, which only moves forward: business time can
    jump ahead, and rows behind such a jump would be lost."""
    return df.withWatermark("ingested_at", C.DEDUP_DELAY).dropDuplicatesWithinWatermark(["event_id"])


def candidates(bronze: DataFrame, event_type: str, version: str = C.V1) -> DataFrame:
    """Bronze rows of one type, typed and judged, not yet deduplicated."""
    return judged(typed(bronze, event_type, version), event_type)


def destination(routed: DataFrame, route: str) -> DataFrame:
    """Rows of one route in the shape of that route's table."""
    rows = routed.where(F.col("route") == route)
    header = [c for c in _HEADER if c in routed.columns]
    payload = [c for c in routed.columns if c not in {*_HEADER, "occurred_at", "event_time", "defect", "route"}]
    extra = {
        ON_TIME: [],
        LATE: [F.lit(True).alias("_late"), F.lit("late").alias("dropped_reason")],
        REJECTED: [F.col("defect").alias("_rejection_reason")],
    }[route]
    return rows.select(
        *header, F.col("event_time").alias("occurred_at"), *payload, *extra, F.to_date("event_time").alias("date")
    )
