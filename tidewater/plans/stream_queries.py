"""Streaming runs over the given tables: a file stream is read to its end, its output is read back."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater import contracts as C
from tidewater.operators import aggregates as A
from tidewater.operators import intake, refine
from tidewater.plans.gold_queries import _window
from tidewater.plans.layer_queries import _sql
from tidewater.plans.registry import STATEMENTS, query, statement
from tidewater.plans.request_queries import LIMIT, WINDOW_SECONDS
from tidewater.session import scratch_path
from tidewater.sources import lake as L
from tidewater.sources import retail as R
from tidewater.streaming import sinks, stateful


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as a file stream. The pattern fits a single file as well as a folder of them."""
    schema = R.table(spark, root, name).schema
    return spark.readStream.schema(schema).parquet(f"{root}/{name}.parque[t]")


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Everything available in one pass: the tables are not ordered by time, so a second pass would meet
    a watermark ahead of its rows."""
    spark, home = stream.sparkSession, scratch_path(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("path", f"{home}/out").option(
        "checkpointLocation", f"{home}/checkpoint"
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


@query("stream_orders_per_minute", statement(
    f"""SELECT * FROM (SELECT {_window('minute', 'created_at')}, count(*) AS order_count FROM steps GROUP BY ALL)
    WHERE window_end <= (SELECT max(created_at) FROM steps) - INTERVAL 10 MINUTE""", "steps"))
def stream_orders_per_minute(spark, root):
    """Windows the watermark has closed."""
    created = R.happened(R.steps_of(table_stream(spark, root, "orders")), "created_at")
    return run_to_end(A.orders_per_minute(created), "orders-per-minute")


@query("stream_success_rate", statement(
    f"""SELECT * FROM (SELECT {_window('hour', 'ts')}, count(*) FILTER (WHERE ok) AS shipped_count,
      count(*) FILTER (WHERE NOT ok) AS failed_count,
      round(count(*) FILTER (WHERE ok) / greatest(count(*), 1), 4) AS success_rate
    FROM outcomes GROUP BY ALL)
    WHERE window_end <= (SELECT max(ts) FROM outcomes) - INTERVAL 30 MINUTE""", "steps",
    outcomes="""SELECT shipped_at AS ts, true AS ok FROM steps WHERE shipped_at IS NOT NULL
      UNION ALL SELECT failed_at, false FROM steps WHERE failed_at IS NOT NULL"""))
def stream_success_rate(spark, root):
    facts = R.steps_of(table_stream(spark, root, "orders"))
    rates = A.fulfillment_success_rate(R.happened(facts, "shipped_at"), R.happened(facts, "failed_at"))
    return run_to_end(rates, "success-rate").withColumn("success_rate", F.round("success_rate", 4))


def _bronze_stream(spark, root, event_type):
    records = R.records_of(R.steps_of(table_stream(spark, root, "orders")), event_type)
    return intake.bronze_rows(intake.inspect_records(records), F.col("timestamp"))


@query("stream_dedup", _sql(
    "SELECT event_id, ingested_at FROM judged WHERE event_type = 'order.validated' AND event_id IS NOT NULL"))
def stream_dedup(spark, root):
    """Which copy survives is open, so only what copies share is compared; rows without id count as copies."""
    events = _bronze_stream(spark, root, C.ORDER_VALIDATED).where("event_id is not null")
    return run_to_end(refine.distinct_events_stream(events).select("event_id", "ingested_at"), "dedup")


@query("stream_routed", _sql(
    """SELECT route, event_id, event_time::DATE AS date FROM judged
    WHERE event_type = 'order.shipped' AND event_id IS NOT NULL"""))
def stream_routed(spark, root):
    """Silver's streaming sink: each event ends up in exactly one of three tables."""
    home = scratch_path(spark, "routed")
    events = refine.candidates(_bronze_stream(spark, root, C.ORDER_SHIPPED).where("event_id is not null"), C.ORDER_SHIPPED)
    routes = (refine.ON_TIME, refine.LATE, refine.REJECTED)

    def emit(route: str, tagged: DataFrame, label: str) -> None:
        rows = refine.destination(tagged, route).select(F.lit(route).alias("route"), "event_id", "date")
        sinks.write_batch(rows, f"{home}/{route}", label)

    sink = sinks.routed_sink("silver", C.ORDER_SHIPPED, lambda batch: batch, "route", {r: partial(emit, r) for r in routes})
    events = refine.distinct_events_stream(events)
    events.writeStream.option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(
        availableNow=True
    ).foreachBatch(sink).start().awaitTermination()
    schema = StructType.fromDDL("route string, event_id string, date date")
    return reduce(DataFrame.unionByName, [L.read_or_empty(spark, f"{home}/{r}", schema) for r in routes])


_REPLAY = STATEMENTS["rate_limit_replay"]


@query("stream_rate_limit", f"""SELECT request_id, client::VARCHAR AS client, admitted FROM ({_REPLAY})
    WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_rate_limit(spark, root):
    """Verdicts of all seconds the watermark has passed."""
    return run_to_end(stateful.admit_stream(R.log_of(table_stream(spark, root, "events")), LIMIT, WINDOW_SECONDS), "rate-limit")
