"""Gold: nine windowed business aggregates, each valid on batch and on streaming input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import contracts as C


def per_window(df: DataFrame, width: str, keys: list[Column], *measures: Column, at: str = "occurred_at") -> DataFrame:
    """Tumbling aggregate with the window as flat columns and the date of its start."""
    grouped = df.groupBy(F.window(at, width).alias("w"), *keys).agg(*measures)
    plain = [c for c in grouped.columns if c != "w"]
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        F.to_date(F.col("w.start")).alias("date"),
        *plain,
    )


def share(part: str, *whole: str) -> Column:
    """part / sum(whole), 0 for an empty whole."""
    total = sum((F.col(c) for c in whole[1:]), F.col(whole[0]))
    return F.col(part) / F.greatest(total, F.lit(1))


def followed_by(first: DataFrame, second: DataFrame, within: str = C.FULFILLMENT_HORIZON) -> DataFrame:
    """Pairs of the same order where `second` happened no earlier than `first` and at most `within` later.

    Columns of `second` get the prefix `then_`. Both bounds are inclusive. The time bound is what lets
    a streaming join forget old orders; in batch it is a residual on the equi-join.
    """
    a = first.withWatermark("occurred_at", C.FULFILLMENT_WATERMARK)
    b = second.withWatermark("occurred_at", C.FULFILLMENT_WATERMARK)
    b = b.select(*[F.col(c).alias(f"then_{c}") for c in b.columns])
    return a.join(
        b,
        (F.col("order_id") == F.col("then_order_id"))
        & (F.col("then_occurred_at") >= F.col("occurred_at"))
        & (F.col("then_occurred_at") <= F.col("occurred_at") + F.expr(f"interval {within}")),
    )


def explode_lines(created: DataFrame) -> DataFrame:
    """One row per item of order.created; orders without items vanish."""
    return created.select("order_id", "occurred_at", F.inline("items"))


def explode_reasons(rejected: DataFrame) -> DataFrame:
    return rejected.select("order_id", "occurred_at", F.inline("reasons"))


def orders_per_minute(created: DataFrame) -> DataFrame:
    seen = created.select("occurred_at").withWatermark("occurred_at", C.SHORT_WATERMARK)
    return per_window(seen, "1 minute", [], F.count(F.lit(1)).alias("order_count"))


def revenue_by_product_location(lines: DataFrame, shipped: DataFrame, within: str = C.FULFILLMENT_HORIZON) -> DataFrame:
    """Booked in the hour of shipment; `lines` as from `explode_lines`."""
    pairs = followed_by(
        lines.select("order_id", "occurred_at", "sku", (F.col("qty") * F.col("unit_price")).alias("amount")),
        shipped.select("order_id", "occurred_at", "node_id"),
        within,
    )
    return per_window(
        pairs, "1 hour", [F.col("sku"), F.col("then_node_id").alias("node_id")],
        F.sum("amount").alias("revenue"), at="then_occurred_at",
    )


def _two_outcomes(good: DataFrame, bad: DataFrame, good_name: str, bad_name: str, delay: str) -> DataFrame:
    both = (
        good.select("occurred_at", F.lit(True).alias("good"))
        .unionByName(bad.select("occurred_at", F.lit(False).alias("good")))
        .withWatermark("occurred_at", delay)
    )
    return per_window(both, "1 hour", [], F.count_if("good").alias(good_name), F.count_if(~F.col("good")).alias(bad_name))


def fulfillment_success_rate(shipped: DataFrame, failed: DataFrame) -> DataFrame:
    counts = _two_outcomes(shipped, failed, "shipped_count", "failed_count", C.FULFILLMENT_WATERMARK)
    return counts.withColumn("success_rate", share("shipped_count", "shipped_count", "failed_count"))


def inventory_reservation_failure_rate(reserved: DataFrame, rejected: DataFrame) -> DataFrame:
    counts = _two_outcomes(reserved, rejected, "reserved_count", "rejected_count", C.SHORT_WATERMARK)
    return counts.withColumn("failure_rate", share("rejected_count", "reserved_count", "rejected_count"))


def fulfillment_latency(created: DataFrame, shipped: DataFrame, within: str = C.FULFILLMENT_HORIZON) -> DataFrame:
    pairs = followed_by(created.select("order_id", "occurred_at"), shipped.select("order_id", "occurred_at"), within)
    took = F.col("then_occurred_at").cast("double") - F.col("occurred_at").cast("double")
    return per_window(
        pairs, "1 hour", [], F.avg(took).alias("avg_latency_seconds"), F.count(F.lit(1)).alias("sample_count"),
        at="then_occurred_at",
    )


def stockout_frequency(reasons: DataFrame) -> DataFrame:
    """`reasons` as from `explode_reasons`."""
    seen = reasons.select("occurred_at", "sku").withWatermark("occurred_at", C.SHORT_WATERMARK)
    return per_window(seen, "1 hour", [F.col("sku")], F.count(F.lit(1)).alias("stockout_count"))


def late_order_rate(shipped: DataFrame, assigned: DataFrame, within: str = C.FULFILLMENT_HORIZON) -> DataFrame:
    """`assigned.estimated_ship_date` may be text or a timestamp; an unknown promise is never late."""
    promise = F.col("estimated_ship_date")
    if dict(assigned.dtypes)["estimated_ship_date"] == "string":
        promise = F.try_to_timestamp(promise)
    pairs = followed_by(
        assigned.select("order_id", "occurred_at", promise.alias("promised")),
        shipped.select("order_id", "occurred_at"),
        within,
    )
    counts = per_window(
        pairs, "1 hour", [],
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("then_occurred_at") > F.col("promised")).alias("late_count"),
        at="then_occurred_at",
    )
    return counts.withColumn("late_rate", share("late_count", "total_count"))


def product_demand_by_window(lines: DataFrame) -> DataFrame:
    seen = lines.select("occurred_at", "sku", "qty").withWatermark("occurred_at", C.SHORT_WATERMARK)
    return per_window(seen, "15 minutes", [F.col("sku")], F.sum("qty").alias("qty_demanded"))


def dead_letter_volume(dead: DataFrame) -> DataFrame:
    seen = dead.select(
        "occurred_at", F.get_json_object("original_event", "$.event_type").alias("original_event_type"),
        "failed_consumer",
    ).withWatermark("occurred_at", C.SHORT_WATERMARK)
    return per_window(
        seen, "1 hour", [F.col("original_event_type"), F.col("failed_consumer")],
        F.count(F.lit(1)).alias("dead_letter_count"),
    )


@dataclass(frozen=True)
class Dataset:
    """A Gold table: the Silver types it reads, in argument order, and how they are combined."""

    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    lookback_days: int = 0  # how long before its output's day an input row may lie


HORIZON_DAYS = int(C.FULFILLMENT_HORIZON.split()[0])

# The one registry used by streaming and by backfill.
DATASETS: dict[str, Dataset] = {
    "orders_per_minute": Dataset((C.ORDER_CREATED,), orders_per_minute),
    "revenue_by_product_location": Dataset(
        (C.ORDER_CREATED, C.ORDER_SHIPPED), lambda c, s: revenue_by_product_location(explode_lines(c), s),
        HORIZON_DAYS,
    ),
    "fulfillment_success_rate": Dataset((C.ORDER_SHIPPED, C.ORDER_FAILED), fulfillment_success_rate),
    "fulfillment_latency": Dataset((C.ORDER_CREATED, C.ORDER_SHIPPED), fulfillment_latency, HORIZON_DAYS),
    "inventory_reservation_failure_rate": Dataset(
        (C.INVENTORY_RESERVED, C.INVENTORY_REJECTED), inventory_reservation_failure_rate
    ),
    "stockout_frequency": Dataset((C.INVENTORY_REJECTED,), lambda r: stockout_frequency(explode_reasons(r))),
    "late_order_rate": Dataset((C.ORDER_SHIPPED, C.FULFILLMENT_ASSIGNED), late_order_rate, HORIZON_DAYS),
    "product_demand_by_window": Dataset((C.ORDER_CREATED,), lambda c: product_demand_by_window(explode_lines(c))),
    "dead_letter_volume": Dataset((C.DEAD_LETTER,), dead_letter_volume),
}


def build(name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """One dataset from a reader of Silver types; the reader decides batch or stream."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    dataset = DATASETS[name]
    return dataset.build(*[read(t) for t in dataset.inputs])


def consumer_lag(snapshots: DataFrame) -> DataFrame:
    """Lag per group, topic and partition; without a commit the log start counts as committed."""
    committed = F.when(F.col("committed_offset") >= 0, F.col("committed_offset")).otherwise(F.col("low_offset"))
    return snapshots.select(
        "polled_at", "consumer_group", "topic", "partition",
        committed.alias("committed_offset"),
        F.col("high_offset").alias("latest_offset"),
        F.greatest(F.col("high_offset") - committed, F.lit(0)).alias("lag"),
        F.to_date("polled_at").alias("date"),
    )


def max_lag(lags: DataFrame) -> DataFrame:
    return lags.groupBy("topic", "consumer_group").agg(F.max("lag").alias("max_lag"))
