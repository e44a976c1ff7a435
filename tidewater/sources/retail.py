"""Event streams, stock and operational tables derived from the retail tables.

Each frame is a map-only projection of one table wherever possible, so that a query reading it
costs one pruned scan. All arithmetic is on integer keys and thus repeatable in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import contracts as C


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def order_facts(spark: SparkSession, root: str) -> DataFrame:
    """One row per order with the time of every step it went through (null: never happened)."""
    return steps_of(table(spark, root, "orders"))


def steps_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey as k",
        "concat('O', o_orderkey) as order_id",
        "concat('C', o_custkey) as customer_id",
        "concat('N', o_orderkey % 25) as node_id",
        "o_orderstatus as status",
        "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, int(o_orderkey % 1440)) as created_at",
    ).selectExpr(
        "*",
        "created_at + interval 5 seconds as validated_at",
        "created_at + interval 10 seconds as requested_at",
        "if(k % 10 <> 0, created_at + interval 20 seconds, null) as reserved_at",
        "if(k % 10 = 0, created_at + interval 20 seconds, null) as rejected_at",
        "if(k % 10 <> 0, created_at + interval 30 seconds, null) as assigned_at",
        "if(k % 10 <> 0 and k % 29 <> 0, created_at + make_dt_interval(int(k % 4 + 1), 0, 0, 30), null) as promised_at",
        "if(k % 10 <> 0 and k % 19 <> 0, created_at + make_dt_interval(0, int((k * 7) % 12) * 18, 0, 60), null)"
        " as shipped_at",
        "if(k % 10 = 0 or k % 19 = 0, created_at + interval 90 seconds, null) as failed_at",
        "if(k % 23 = 0 and status = 'P', created_at + interval 45 seconds, null) as cancelled_at",
        "if(k % 20 = 3, created_at + interval 25 seconds, null) as low_at",
        "if(k % 97 = 0, created_at + interval 120 seconds, null) as dead_at",
    )


def happened(facts: DataFrame, at: str, *columns: str) -> DataFrame:
    """Stream of one step: `order_id`, `occurred_at` and further SQL columns, only where it happened."""
    return facts.where(f"{at} is not null").selectExpr("order_id", f"{at} as occurred_at", *columns)


def order_lines(spark: SparkSession, root: str) -> DataFrame:
    """Order lines with the creation time of their order: the exploded form of order.created."""
    facts = order_facts(spark, root).select("k", "order_id", "customer_id", "node_id", "created_at")
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, root, "part").select("p_partkey", "p_retailprice", "p_brand")
    return (
        lines.join(facts, lines.l_orderkey == facts.k)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .selectExpr(
            "order_id", "created_at as occurred_at", "concat('P', l_partkey) as sku", "bigint(l_quantity) as qty",
            "p_retailprice as unit_price", "node_id", "customer_id", "k", "l_partkey as part_no", "p_brand as brand",
            "l_extendedprice as line_price",
        )
    )


def rejection_reasons(spark: SparkSession, root: str) -> DataFrame:
    """The exploded `reasons` of inventory.rejected: every line of a rejected order."""
    facts = order_facts(spark, root).where("rejected_at is not null").select("k", "order_id", "rejected_at")
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(facts, lines.l_orderkey == facts.k).selectExpr(
        "order_id", "rejected_at as occurred_at", "concat('P', l_partkey) as sku",
        "bigint(l_quantity) as requested_qty", "0L as available_qty",
    )


_ORIGINAL_TYPE = f"""case k % 3 when 0 then '{C.ORDER_CREATED}' when 1 then '{C.ORDER_VALIDATED}'
    else '{C.ORDER_SHIPPED}' end"""
_CONSUMER = "if(k % 2 = 0, 'order-validator', 'fulfillment-orchestrator')"


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """deadletter.event rows whose `original_event` is the JSON text of the failed envelope."""
    return order_facts(spark, root).where("dead_at is not null").selectExpr(
        "concat('dead-', k) as dead_letter_id",
        "concat('evt-', k) as original_event_id",
        f"{_ORIGINAL_TYPE} as event_type",
        f"{_CONSUMER} as failed_consumer",
        "'ValueError' as error_type",
        "k % 5 + 1 as attempt_count",
        "created_at as first_failed_at",
        "dead_at as last_failed_at",
        "if(k % 4 = 1, dead_at + interval 1 hour, null) as replayed_at",
        f"""to_json(named_struct('event_id', concat('evt-', k), 'event_type', {_ORIGINAL_TYPE},
            'schema_version', '{C.V1}', 'data', named_struct('order_id', order_id))) as original_event""",
        "dead_at as occurred_at",
    )


# event type, time column, producing service, cause (None: a root or undeclared)
EVENT_STEPS = (
    (C.ORDER_CREATED, "created_at", "order-service", None),
    (C.ORDER_VALIDATED, "validated_at", "order-service", C.ORDER_CREATED),
    (C.RESERVATION_REQUESTED, "requested_at", "fulfillment-orchestrator", C.ORDER_VALIDATED),
    (C.INVENTORY_RESERVED, "reserved_at", "inventory-service", C.RESERVATION_REQUESTED),
    (C.INVENTORY_REJECTED, "rejected_at", "inventory-service", C.RESERVATION_REQUESTED),
    (C.FULFILLMENT_ASSIGNED, "assigned_at", "fulfillment-orchestrator", C.INVENTORY_RESERVED),
    (C.ORDER_SHIPPED, "shipped_at", "fulfillment-orchestrator", C.FULFILLMENT_ASSIGNED),
    (C.ORDER_CANCELLED, "cancelled_at", "order-service", None),
    (C.ORDER_FAILED, "failed_at", "fulfillment-orchestrator", C.RESERVATION_REQUESTED),
    (C.INVENTORY_LOW, "low_at", "inventory-service", None),
)


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """Envelope headers of all order events from one scan; every 53rd shipment names a lost cause."""
    entries = []
    for event_type, at, producer, cause in EVENT_STEPS:
        cause_id = "cast(null as string)" if cause is None else f"concat('{cause}:', k)"
        if event_type == C.ORDER_SHIPPED:
            cause_id = f"if(k % 53 = 0, concat('lost:', k), {cause_id})"
        entries.append(
            f"struct(concat('{event_type}:', k) as event_id, '{event_type}' as event_type, {at} as occurred_at,"
            f" '{producer}' as producer, {cause_id} as causation_id)"
        )
    return (
        order_facts(spark, root)
        .selectExpr("k", "order_id", "node_id", "concat('cor-', k) as correlation_id",
                    f"inline(array({', '.join(entries)}))")
        .where("occurred_at is not null")
    )


RAW_TYPES = (C.ORDER_CREATED, C.ORDER_VALIDATED, C.ORDER_SHIPPED, C.DEAD_LETTER)
_RAW_TIME = {C.ORDER_CREATED: "created_at", C.ORDER_VALIDATED: "validated_at", C.ORDER_SHIPPED: "shipped_at",
             C.DEAD_LETTER: "dead_at"}
_ISO = "date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_RAW_PAYLOAD = {
    C.ORDER_CREATED: """struct(
        if(k % 227 <> 0, order_id, null) as order_id, customer_id,
        array(struct(concat('P', k % 200) as sku, k % 5 + 1 as qty, double(k % 40 + 0.5) as unit_price),
              struct(concat('P', (k + 7) % 200) as sku, 2L as qty, 3.25D as unit_price)) as items,
        double((k % 5 + 1) * (k % 40 + 0.5) + 6.5) as order_total, 'EUR' as currency,
        concat('key-', k) as idempotency_key)""",
    C.ORDER_VALIDATED: "struct(if(k % 227 <> 0, order_id, null) as order_id, {iso} as validated_at)",
    C.ORDER_SHIPPED: """struct(
        if(k % 227 <> 0, order_id, null) as order_id, if(k % 233 <> 0, node_id, null) as node_id,
        {iso} as shipped_at, 'ground' as carrier_sim, concat('T', k) as tracking_ref)""",
    C.DEAD_LETTER: f"""struct(
        struct(concat('evt-', k) as event_id, '{C.ORDER_CREATED}' as event_type) as original_event,
        {_CONSUMER} as failed_consumer, 'ValueError' as error_type, k % 5 + 1 as attempt_count)""",
}


def raw_records(spark: SparkSession, root: str, *types: str) -> DataFrame:
    """Bus records of the given topics (all four by default), from one scan, with real topics' faults."""
    return records_of(spread(order_facts(spark, root)), *(types or RAW_TYPES))


UNREGISTERED = "order.returned"
_CATALOGUE_TIME = {
    **_RAW_TIME, C.RESERVATION_REQUESTED: "requested_at", C.INVENTORY_RESERVED: "reserved_at",
    C.INVENTORY_REJECTED: "rejected_at", C.FULFILLMENT_ASSIGNED: "assigned_at", C.ORDER_CANCELLED: "cancelled_at",
    C.ORDER_FAILED: "failed_at", C.INVENTORY_LOW: "low_at",
    UNREGISTERED: "if(k % 9 = 4, created_at + interval 30 days, null)",
}
_ORDER_REF = "if(k % 227 <> 0, order_id, null) as order_id"
_CATALOGUE_PAYLOAD = {
    **_RAW_PAYLOAD,
    C.ORDER_CREATED: f"""struct({_ORDER_REF}, customer_id, items, total as order_total, 'EUR' as currency,
        concat('key-', k) as idempotency_key)""",
    C.RESERVATION_REQUESTED: f"""struct({_ORDER_REF}, transform(items, i -> struct(i.sku, i.qty)) as items,
        transform(sequence(0, 2), n -> concat('N', (k + n) % 25)) as candidate_node_ids)""",
    C.INVENTORY_RESERVED: f"""struct({_ORDER_REF}, transform(items, (i, n) -> struct(i.sku, node_id, i.qty,
        concat('R', k, '-', n) as reservation_id, {{iso}} as expires_at)) as reservations)""",
    C.INVENTORY_REJECTED: f"""struct({_ORDER_REF},
        transform(items, i -> struct(i.sku, i.qty as requested_qty, 0L as available_qty)) as reasons)""",
    C.FULFILLMENT_ASSIGNED: f"""struct({_ORDER_REF}, if(k % 233 <> 0, node_id, null) as node_id, 0.75D as score,
        struct(1D as stock, 0.5D as distance, if(k % 31 <> 0, 0.25D, null) as capacity, 0.5D as delivery_estimate,
               0.5D as backlog) as score_breakdown, {{iso}} as estimated_ship_date)""",
    C.ORDER_CANCELLED: f"""struct({_ORDER_REF}, 'customer' as cancelled_by, 'changed mind' as reason,
        'CREATED' as previous_state)""",
    C.ORDER_FAILED: f"""struct({_ORDER_REF}, if(k % 10 = 0, 'RESERVE_INVENTORY', 'PROCESS_PAYMENT') as failed_step,
        'refused' as reason, if(k % 10 = 0, array(), array('RELEASE_INVENTORY')) as compensations_applied)""",
    C.INVENTORY_LOW: "struct(get(items, 0).sku as sku, node_id, 3L as available_qty, 10L as threshold)",
    UNREGISTERED: f"struct({_ORDER_REF}, size(items) as parcels)",
}


def catalogue_records(spark: SparkSession, root: str) -> DataFrame:
    """Bus records of all eleven registered types and an unregistered one, with the orders' own lines as items.

    Faults as in `records_of`; besides, every 241st key has text for the quantities of items and every 251st names a
    field that no contract knows.
    """
    lines = table(spark, root, "lineitem").join(
        table(spark, root, "part").selectExpr("p_partkey as l_partkey", "p_retailprice"), "l_partkey")
    # One list per order, of its own lines.
    items = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.expr(
        "struct(concat('P', l_partkey) as sku, bigint(l_quantity) as qty, double(p_retailprice) as unit_price)"))).alias("items"))
    facts = order_facts(spark, root).join(items, "k", "left") \
        .withColumn("items", F.coalesce("items", F.expr("cast(array() as array<struct<sku:string,qty:bigint,unit_price:double>>)"))) \
        .withColumn("total", F.expr("aggregate(items, 0D, (t, i) -> t + i.qty * i.unit_price)"))
    document = """if(k % 241 = 0, replace(document, '"qty":', '"qty":"many","was_qty":'), document)"""
    document = f"""if(k % 251 = 0, replace({document}, '"data":{{', '"data":{{"channel":"app",'), {document})"""
    return records_of(facts, *_CATALOGUE_PAYLOAD, payloads=_CATALOGUE_PAYLOAD, times=_CATALOGUE_TIME, document=document)


ROWS_PER_PIECE = 200_000


def spread(df: DataFrame) -> DataFrame:
    """JSON work and expansions are bound by CPU and memory, and a table comes in fewer pieces than there are cores, or in
    pieces of millions of rows: then its rows are dealt out, at most ROWS_PER_PIECE to a piece. The count of rows comes
    from the footers of the files. Tables of at least as many pieces are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = max(cores, -(-df.count() // ROWS_PER_PIECE))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def _document(event_type: str, payloads: dict[str, str], times: dict[str, str]) -> str:
    iso = _ISO.format(at=times[event_type])
    return f"""to_json(struct(
        if(k % 229 <> 0, concat('{event_type}:', k), null) as event_id, '{event_type}' as event_type,
        case when k % 213 = 0 then '9.9.9' when k % 211 <> 0 then '{C.V1}' end as schema_version,
        if(k % 223 = 0, 'not-a-time', {iso}) as occurred_at, 'order-service' as producer,
        concat('cor-', k) as correlation_id, struct(concat('00-', k) as traceparent) as trace_context,
        {payloads[event_type].replace("{iso}", iso)} as data))"""


def records_of(facts: DataFrame, *types: str, payloads: dict[str, str] = _RAW_PAYLOAD, times: dict[str, str] = _RAW_TIME,
               document: str = "document") -> DataFrame:
    """Every 20th key is delivered twice; some values are null, not JSON, or JSON without an envelope;
    some envelopes miss the id, the version, a mandatory key, or carry an unusable time; some totals
    are text instead of a number.

    Only the times are expanded; the document of an event is written after that, for events that happened.
    """
    happened = ", ".join(f"struct('{t}' as topic, {times[t]} as at)" for t in types)
    documents = " ".join(f"when '{t}' then {_document(t, payloads, times)}" for t in types)
    return (
        facts.selectExpr("*", f"inline(array({happened}))")
        .where("at is not null")
        .selectExpr("k", "topic", "at", f"case topic {documents} end as document")
        .selectExpr("k", "topic", "at", f"{document} as document")
        .selectExpr("k", "topic", "at", """posexplode(array_repeat(
            case when k % 350 = 7 then null when k % 50 = 1 then '{bad' when k % 450 = 2 then '{"note":"no envelope"}'
                 when k % 239 = 0 then replace(document, '"order_total":', '"order_total":"?","was":')
                 else document end,
            if(k % 20 = 0, 2, 1))) as (copy, value)""")
        .selectExpr(
            "value", "topic", "int(k % 6) as `partition`", "k * 2 + copy as offset",
            "at + make_dt_interval(0, 0, 0, (k % 125) * 5) as timestamp",
        )
    )


def nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nation").selectExpr(
        "concat('N', n_nationkey) as node_id",
        "double(n_nationkey * 5 - 60) as latitude",
        "double(n_nationkey * 14 - 180) as longitude",
        "int(n_nationkey * 10 + 100) as capacity_per_day",
        "int((n_nationkey * 37) % 120) as current_backlog",
        "n_nationkey % 8 <> 7 as active",
    )


def stock(spark: SparkSession, root: str) -> DataFrame:
    """Stock per sku and node; every seventh combination holds none at all (no row).

    Each part gets its node rows from a literal list; the parts of one file are dealt out before they are expanded.
    """
    return (
        spread(table(spark, root, "part").selectExpr("p_partkey as p"))
        .selectExpr("p", "explode(sequence(0, 24)) as n")
        .where("(p + n * 3) % 7 <> 0")
        .selectExpr(
            "concat('P', p) as sku", "concat('N', n) as node_id", "int((p * 31 + n * 17) % 90) as available_qty",
            "int((p + n) % 5) as reserved_qty", "10 as reorder_threshold", "1 as version",
        )
    )


def reservation_requests(spark: SparkSession, root: str) -> DataFrame:
    """Every order line as a reservation request at the order's own node, totally ordered.

    Lines equal in all ordering columns are interchangeable, so ties cannot change any outcome.
    """
    return order_lines(spark, root).selectExpr(
        "order_id", "sku", "node_id", "qty", "occurred_at as requested_at", "k", "line_price"
    )


# The order of a full life after CREATED.
STEP_STATES = ("VALIDATED", "INVENTORY_PENDING", "INVENTORY_RESERVED", "FULFILLMENT_ASSIGNED", "PROCESSING",
               "SHIPPED", "DELIVERED")
_STATES = "array(" + ", ".join(f"'{s}'" for s in STEP_STATES) + ")"


def transition_requests(spark: SparkSession, root: str) -> DataFrame:
    """Requested status changes per order; fixed shares ask for a wrong state, version or no node."""
    return (
        order_facts(spark, root)
        .selectExpr("k", "order_id", "node_id", "created_at", "explode(sequence(1, int(3 + k % 5))) as i")
        .selectExpr(
            "order_id",
            "bigint(i) as seq",
            "case when k % 31 = 0 and i = 3 then 'SHIPPED' when k % 23 = 0 and i = 5 then 'CANCELLED'"
            f" else element_at({_STATES}, i) end as to_status",
            "bigint(i - if(k % 37 = 0 and i = 4, 1, 0)) as expected_version",
            "if(k % 41 <> 0, node_id, null) as node_id",
            "created_at + make_dt_interval(0, 0, i) as requested_at",
        )
    )


def status_history(spark: SparkSession, root: str) -> DataFrame:
    """Recorded status changes; every 31st order jumps a state, every 43rd lost one record."""
    states = f"concat(array('CREATED'), {_STATES})"
    return (
        order_facts(spark, root)
        .selectExpr("k", "order_id", "created_at", "explode(sequence(0, int(k % 8))) as i")
        .where("not (k % 43 = 0 and i = 2)")
        .selectExpr(
            "order_id",
            f"if(i > 0, element_at({states}, greatest(i, 1)), null) as from_status",
            f"if(k % 31 = 0 and i = 3, 'SHIPPED', element_at({states}, i + 1)) as to_status",
            "created_at + make_dt_interval(0, 0, i * 5) as changed_at",
        )
    )


def order_requests(spark: SparkSession, root: str) -> DataFrame:
    """Submitted order requests with idempotency keys: repeats and changed repeats included."""
    return (
        order_facts(spark, root)
        .selectExpr("*", "explode(case when k % 37 = 0 then array(0, 2) when k % 11 = 0 then array(0, 1)"
                    " else array(0) end) as n")
        .selectExpr(
            "concat('key-', k) as idempotency_key", "concat('req-', k, '-', n) as request_id", "customer_id",
            "concat('P', k % 200) as sku", "k % 5 + 1 + if(n = 2, 1, 0) as qty", "'EUR' as currency",
            "created_at + make_dt_interval(0, 0, n) as received_at",
        )
    )


def reservations(spark: SparkSession, root: str) -> DataFrame:
    """Held reservations: one per reserved order, at its node, some already ended."""
    return order_facts(spark, root).where("reserved_at is not null").selectExpr(
        "concat('R', k) as reservation_id", "order_id", "concat('P', k % 200) as sku", "node_id",
        "int(k % 5 + 1) as qty",
        "case k % 6 when 0 then 'RELEASED' when 1 then 'COMMITTED' else 'ACTIVE' end as status",
        f"reserved_at + interval {C.RESERVATION_TTL_MINUTES} minutes as expires_at",
        "reserved_at as created_at",
    )


def releases(spark: SparkSession, root: str) -> DataFrame:
    return (
        order_facts(spark, root)
        .where("reserved_at is not null and failed_at is not null and k % 3 <> 0")
        .selectExpr("concat('R', k) as reservation_id", "failed_at as released_at")
    )


def sagas(spark: SparkSession, root: str) -> DataFrame:
    """Workflow instances: every fourth order with an open status is still running."""
    running = "(status = 'O' and k % 4 = 0)"
    return order_facts(spark, root).selectExpr(
        "concat('S', k) as saga_id",
        "order_id",
        f"case when {running} then 'RUNNING' when shipped_at is not null then 'COMPLETED' else 'FAILED' end as status",
        f"case when {running} and k % 8 = 0 then 'SELECT_AND_RESERVE' when {running} then 'AUTHORIZE_PAYMENT'"
        " else 'DONE' end as current_step",
        "int(k % 4) as attempt_count",
        "validated_at as created_at",
        f"if({running}, validated_at + interval 1 minute, coalesce(shipped_at, failed_at)) as updated_at",
    )


def cancel_events(spark: SparkSession, root: str) -> DataFrame:
    return order_facts(spark, root).where("k % 12 = 4").selectExpr(
        f"concat('{C.ORDER_CANCELLED}:', k) as event_id", "order_id", "created_at + interval 45 seconds as occurred_at"
    )


def outbox(spark: SparkSession, root: str) -> DataFrame:
    return order_facts(spark, root).selectExpr(
        "concat('out-', k) as outbox_id", "order_id as aggregate_id", f"'{C.ORDER_CREATED}' as event_type",
        "created_at", "if(k % 3 <> 0, created_at + interval 2 seconds, null) as published_at",
        "int(k % 9) as attempt_count",
        "if(k % 6 = 0, created_at + make_dt_interval(0, 0, int(k % 90)), null) as next_attempt_at",
    )


def processed_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Ledger of events each consumer has finished."""
    return order_facts(spark, root).where("k % 41 < 20").selectExpr(
        "if(k % 41 < 10, 'order-validator', 'fulfillment-orchestrator') as consumer_name",
        f"concat('{C.ORDER_VALIDATED}:', k) as event_id", "validated_at as processed_at",
    )


def offsets(spark: SparkSession, root: str) -> DataFrame:
    """Offset snapshots per consumer group, topic and partition; -1 means nothing committed yet."""
    return order_facts(spark, root).selectExpr(
        "created_at as polled_at", f"{_CONSUMER} as consumer_group",
        f"if(k % 3 = 0, '{C.ORDER_CREATED}', '{C.ORDER_VALIDATED}') as topic", "int(k % 6) as `partition`",
        "if(k % 17 = 0, -1L, k * 3) as committed_offset", "k % 5 as low_offset", "k * 3 + (k % 13) - 2 as high_offset",
    )


def stock_changes(spark: SparkSession, root: str) -> DataFrame:
    """Stock settings sent in over time; the last one per (sku, node) wins."""
    return order_facts(spark, root).selectExpr(
        "concat('P', k % 200) as sku", "node_id", "int((k * 7) % 100) as available_qty",
        "int(k % 15) as reorder_threshold", "k as seq",
    )


def request_log(spark: SparkSession, root: str) -> DataFrame:
    """Access log: latency in ms, client, scenario and whether the request failed."""
    return log_of(table(spark, root, "events"))


def log_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as request_id", "cast(ts as timestamp) as ts", "user_id as client", "event_type as scenario",
        "value as latency_ms", "event_type = 'error' as failed",
    )


def page_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", F.col("url").alias("path"))


def demand_lines(spark: SparkSession, root: str) -> DataFrame:
    """Order lines by brand and by the region of the serving node, as input of the demand history."""
    regions = table(spark, root, "nation").join(
        table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).selectExpr("concat('N', n_nationkey) as node_id", "r_name as location_id")
    return order_lines(spark, root).join(regions, "node_id").select(
        "occurred_at", F.col("brand").alias("sku"), "location_id", "qty", "unit_price"
    )
