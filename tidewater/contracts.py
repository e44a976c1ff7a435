"""Event contracts: envelope, payloads per (type, version), mandatory keys, rule constants.

Everything in this module is a fixed value: producers and consumers of the event bus agree on it,
so it has to be stated exactly.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# --- fixed values: event types, in catalogue order -----------------------------------------
ORDER_CREATED = "order.created"
ORDER_VALIDATED = "order.validated"
RESERVATION_REQUESTED = "inventory.reservation.requested"
INVENTORY_RESERVED = "inventory.reserved"
INVENTORY_REJECTED = "inventory.rejected"
FULFILLMENT_ASSIGNED = "fulfillment.assigned"
ORDER_SHIPPED = "order.shipped"
ORDER_CANCELLED = "order.cancelled"
ORDER_FAILED = "order.failed"
INVENTORY_LOW = "inventory.low"
DEAD_LETTER = "deadletter.event"

V1 = "1.0.0"

# --- fixed values: table layouts as DDL ------------------------------------------------------
RAW_RECORD = "value string, topic string, partition int, offset bigint, timestamp timestamp"

ENVELOPE = """
    event_id string, event_type string, schema_version string, occurred_at string,
    producer string, correlation_id string, causation_id string,
    trace_context struct<traceparent: string>
"""

BRONZE_FILE = """
    event_id string, schema_version string, occurred_at string, producer string,
    correlation_id string, causation_id string, traceparent string, data_json string,
    kafka_topic string, kafka_partition int, kafka_offset bigint,
    kafka_timestamp timestamp, ingested_at timestamp
"""

SILVER_HEADER = """
    event_id string, schema_version string, occurred_at timestamp, producer string,
    correlation_id string, causation_id string, traceparent string,
    kafka_topic string, kafka_partition int, kafka_offset bigint, ingested_at timestamp
"""

# (type, version) -> payload. New versions are added here, existing ones never change.
PAYLOADS: dict[tuple[str, str], str] = {
    (ORDER_CREATED, V1): """
        order_id string, customer_id string,
        items array<struct<sku: string, qty: bigint, unit_price: double>>,
        order_total double, currency string, idempotency_key string""",
    (ORDER_VALIDATED, V1): "order_id string, validated_at string",
    (RESERVATION_REQUESTED, V1): """
        order_id string, items array<struct<sku: string, qty: bigint>>,
        candidate_node_ids array<string>""",
    (INVENTORY_RESERVED, V1): """
        order_id string,
        reservations array<struct<sku: string, node_id: string, qty: bigint,
                                  reservation_id: string, expires_at: string>>""",
    (INVENTORY_REJECTED, V1): """
        order_id string,
        reasons array<struct<sku: string, requested_qty: bigint, available_qty: bigint>>""",
    (FULFILLMENT_ASSIGNED, V1): """
        order_id string, node_id string, score double,
        score_breakdown struct<stock: double, distance: double, capacity: double,
                               delivery_estimate: double, backlog: double>,
        estimated_ship_date string""",
    (ORDER_SHIPPED, V1): """
        order_id string, node_id string, shipped_at string, carrier_sim string,
        tracking_ref string""",
    (ORDER_CANCELLED, V1): """
        order_id string, cancelled_by string, reason string, previous_state string""",
    (ORDER_FAILED, V1): """
        order_id string, failed_step string, reason string,
        compensations_applied array<string>""",
    (INVENTORY_LOW, V1): """
        sku string, node_id string, available_qty bigint, threshold bigint,
        evaluated_at string""",
    (DEAD_LETTER, V1): """
        original_event string, failed_consumer string, error_type string,
        error_message string, attempt_count bigint, first_failed_at string,
        last_failed_at string""",
}

MANDATORY: dict[str, tuple[str, ...]] = {
    ORDER_CREATED: ("order_id", "customer_id"),
    ORDER_VALIDATED: ("order_id",),
    RESERVATION_REQUESTED: ("order_id",),
    INVENTORY_RESERVED: ("order_id",),
    INVENTORY_REJECTED: ("order_id",),
    FULFILLMENT_ASSIGNED: ("order_id", "node_id"),
    ORDER_SHIPPED: ("order_id", "node_id"),
    ORDER_CANCELLED: ("order_id",),
    ORDER_FAILED: ("order_id",),
    INVENTORY_LOW: ("sku", "node_id"),
    DEAD_LETTER: ("failed_consumer",),
}

# --- fixed values: rule constants ------------------------------------------------------------
LATE_AFTER_SECONDS = 600
DEDUP_DELAY = "10 minutes"
SHORT_WATERMARK = "10 minutes"
FULFILLMENT_WATERMARK = "30 minutes"
FULFILLMENT_HORIZON = "7 days"

MAX_REJECT_RATE = 0.05
MAX_LATE_RATE = 0.10
MAX_AGE_MINUTES = 60

EARTH_RADIUS_KM = 6371.0
KM_PER_DAY = 500.0
HANDLING_DAYS = 1.0
SCORE_WEIGHTS = {"distance": 0.35, "delivery": 0.25, "backlog": 0.20, "capacity": 0.20}

RESERVATION_TTL_MINUTES = 15
IDEMPOTENCY_TTL_HOURS = 24
RATE_LIMIT_HITS = 120
RATE_LIMIT_SECONDS = 60
OUTBOX_BATCH = 100
RETRY_BASE_SECONDS = 0.2
RETRY_MAX_SECONDS = 30.0
RETRY_ATTEMPTS = 5
OUTBOX_MAX_BACKOFF_SECONDS = 60

# Order states: each state with the states that may follow it.
NEXT_STATES: dict[str, tuple[str, ...]] = {
    "CREATED": ("VALIDATED", "CANCELLED", "FAILED"),
    "VALIDATED": ("INVENTORY_PENDING", "CANCELLED", "FAILED"),
    "INVENTORY_PENDING": ("INVENTORY_RESERVED", "CANCELLED", "FAILED"),
    "INVENTORY_RESERVED": ("FULFILLMENT_ASSIGNED", "CANCELLED", "FAILED"),
    "FULFILLMENT_ASSIGNED": ("PROCESSING", "CANCELLED", "FAILED"),
    "PROCESSING": ("SHIPPED", "FAILED"),
    "SHIPPED": ("DELIVERED",),
    "DELIVERED": (),
    "CANCELLED": (),
    "FAILED": (),
}
# --- end of fixed values ---------------------------------------------------------------------

EVENT_TYPES: tuple[str, ...] = tuple(MANDATORY)


def payload_type(event_type: str, version: str = V1) -> StructType:
    try:
        return StructType.fromDDL(PAYLOADS[(event_type, version)])
    except KeyError:
        raise ValueError(f"no payload contract for {event_type!r} version {version!r}") from None


def versions_of(event_type: str) -> list[str]:
    return sorted(v for t, v in PAYLOADS if t == event_type)


def bronze_type() -> StructType:
    """Bronze files plus the `date` partition, always declared: an empty folder infers nothing."""
    return StructType.fromDDL(f"{BRONZE_FILE}, date date")


def silver_type(event_type: str, version: str = V1) -> StructType:
    header = StructType.fromDDL(SILVER_HEADER)
    return StructType(
        header.fields + payload_type(event_type, version).fields + StructType.fromDDL("date date").fields
    )
