"""Bronze and silver rows, quality checks, contract and reference reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.operators import assurance, conformity, intake, refine
from tidewater.plans.registry import query, statement
from tidewater.sources import retail as R

RAW = """
    SELECT s.k, t.event_type, t.happened, c.copy, s.order_id, s.customer_id,
      CASE WHEN s.k % 350 = 7 THEN 'empty_kafka_value'
           WHEN s.k % 50 = 1 OR s.k % 450 = 2 THEN 'unparseable_or_empty_envelope' END AS reason,
      CASE WHEN s.k % 229 <> 0 THEN t.event_type || ':' || s.k END AS event_id,
      CASE WHEN s.k % 213 = 0 THEN '9.9.9' WHEN s.k % 211 <> 0 THEN '1.0.0' END AS schema_version,
      CASE WHEN s.k % 223 = 0 THEN 'not-a-time' ELSE strftime(t.happened, '%Y-%m-%dT%H:%M:%SZ') END AS occurred_text,
      CASE WHEN s.k % 223 <> 0 THEN t.happened END AS event_time,
      (s.k % 6)::INTEGER AS kafka_partition, s.k * 2 + c.copy AS kafka_offset,
      t.happened + to_seconds((s.k % 125) * 5) AS ingested_at
    FROM steps s
    CROSS JOIN LATERAL (VALUES ('order.created', s.created_at), ('order.validated', s.validated_at),
      ('order.shipped', s.shipped_at), ('deadletter.event', s.dead_at)) t(event_type, happened)
    JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR s.k % 20 = 0
    WHERE t.happened IS NOT NULL"""
BRONZE = "SELECT * EXCLUDE (reason) FROM raw WHERE reason IS NULL"
JUDGED = """
    SELECT *, CASE WHEN defect IS NOT NULL THEN 'rejected'
        WHEN epoch(ingested_at) - epoch(event_time) > 600 THEN 'late' ELSE 'on_time' END AS route
    FROM (SELECT *, CASE WHEN schema_version IS DISTINCT FROM '1.0.0' THEN 'unknown_schema_version'
        WHEN event_id IS NULL THEN 'missing_event_id'
        WHEN event_time IS NULL THEN 'invalid_timestamp'
        WHEN event_type <> 'deadletter.event' AND k % 227 = 0 THEN 'missing_required_field:order_id'
        WHEN event_type = 'order.shipped' AND k % 233 = 0 THEN 'missing_required_field:node_id' END AS defect
      FROM bronze)
    QUALIFY row_number() OVER (PARTITION BY event_type, event_id ORDER BY kafka_partition, kafka_offset) = 1"""
_LAYERS = {"raw": RAW, "bronze": BRONZE, "judged": JUDGED}


def _sql(body: str, upto: str = "judged") -> str:
    names = list(_LAYERS)[: list(_LAYERS).index(upto) + 1]
    return statement(body, "steps", **{n: _LAYERS[n] for n in names})


def inspected(spark, root: str, *types: str) -> DataFrame:
    return intake.inspect_records(R.raw_records(spark, root, *types))


def bronze(spark, root: str, *types: str) -> DataFrame:
    """Arrival is the bus timestamp here: a clock reading could not be compared."""
    return intake.bronze_rows(inspected(spark, root, *types), F.col("timestamp"))


def decided(spark, root: str) -> DataFrame:
    """One decision per event over all types."""
    columns = ("event_id", "event_type", "kafka_partition", "kafka_offset", "ingested_at", "event_time", "defect", "route")
    return refine.distinct_events(refine.judged_any(bronze(spark, root)).select(*columns), "event_type", "event_id")


@query("bronze_valid", _sql(
    """SELECT event_id, event_type, schema_version, occurred_text AS occurred_at, 'order-service' AS producer,
      'cor-' || k AS correlation_id, '00-' || k AS traceparent,
      CASE WHEN event_type <> 'deadletter.event' AND k % 227 <> 0 THEN order_id END AS order_ref,
      event_type AS kafka_topic, kafka_partition, kafka_offset, ingested_at, event_time::DATE AS date
    FROM bronze""", "bronze"))
def bronze_valid(spark, root):
    return bronze(spark, root).select(
        "event_id", "event_type", "schema_version", "occurred_at", "producer", "correlation_id", "traceparent",
        F.get_json_object("data_json", "$.order_id").alias("order_ref"),
        "kafka_topic", "kafka_partition", "kafka_offset", "ingested_at", "date",
    )


@query("bronze_rejects", _sql(
    """SELECT event_type AS kafka_topic, kafka_partition, kafka_offset, reason, ingested_at,
      ingested_at::DATE AS date, CASE WHEN k % 350 = 7 THEN NULL WHEN k % 50 = 1 THEN '{bad'
        ELSE '{"note":"no envelope"}' END AS raw_value
    FROM raw WHERE reason IS NOT NULL""", "raw"))
def bronze_rejects(spark, root):
    return intake.bronze_rejects(inspected(spark, root), F.col("timestamp")).select(
        "kafka_topic", "kafka_partition", "kafka_offset", "reason", "ingested_at", "date", "raw_value",
    )


@query("silver_routed_counts", _sql(
    "SELECT event_type, route, defect, count(*) AS n FROM judged GROUP BY ALL"))
def silver_routed_counts(spark, root):
    counted = refine.decisions(refine.judged_any(bronze(spark, root)))
    return counted.groupBy("event_type", "route", "defect").agg(F.count(F.lit(1)).alias("n"))


@query("silver_order_created", _sql(
    """SELECT event_id, order_id, customer_id, event_time AS occurred_at, event_time::DATE AS date,
      CASE WHEN k % 239 <> 0 THEN ((k % 5 + 1) * (k % 40 + 0.5) + 6.5)::DOUBLE END AS order_total,
      'EUR' AS currency, 'key-' || k AS idempotency_key, 2 AS item_count, 'P' || (k % 200) AS first_sku,
      k % 5 + 1 AS first_qty
    FROM judged WHERE event_type = 'order.created' AND route = 'on_time'"""))
def silver_order_created(spark, root):
    candidates = refine.candidates(bronze(spark, root, C.ORDER_CREATED), C.ORDER_CREATED)
    rows = refine.destination(refine.distinct_events(candidates), refine.ON_TIME)
    return rows.select(
        "event_id", "order_id", "customer_id", "occurred_at", "date", "order_total", "currency", "idempotency_key",
        F.size("items").alias("item_count"),
        F.col("items")[0]["sku"].alias("first_sku"),
        F.col("items")[0]["qty"].alias("first_qty"),
    )


@query("silver_rejects", _sql(
    """SELECT event_id, event_type, kafka_partition, kafka_offset, defect AS rejection_reason, event_time::DATE AS date
    FROM judged WHERE route = 'rejected'"""))
def silver_rejects(spark, root):
    return refine.destination(decided(spark, root), refine.REJECTED).select(
        "event_id", "event_type", "kafka_partition", "kafka_offset",
        F.col("_rejection_reason").alias("rejection_reason"), "date",
    )


@query("late_events", _sql(
    """SELECT event_id, event_type, event_time AS occurred_at, ingested_at, 'late' AS dropped_reason,
      event_time::DATE AS date FROM judged WHERE route = 'late'"""))
def late_events(spark, root):
    return refine.destination(decided(spark, root), refine.LATE).select(
        "event_id", "event_type", "occurred_at", "ingested_at", "dropped_reason", "date",
    )


@query("dedup_events", _sql(
    "SELECT event_id, event_type, kafka_partition, kafka_offset, ingested_at FROM judged"))
def dedup_events(spark, root):
    columns = ("event_id", "event_type", "kafka_partition", "kafka_offset", "ingested_at")
    return refine.distinct_events(bronze(spark, root).select(*columns), "event_type", "event_id").select(
        "event_id", "event_type", "kafka_partition", "kafka_offset", "ingested_at",
    )


_FIELDS = {
    C.ORDER_CREATED: "order_id customer_id items order_total currency idempotency_key",
    C.ORDER_VALIDATED: "order_id validated_at",
    C.ORDER_SHIPPED: "order_id node_id shipped_at carrier_sim tracking_ref",
    C.DEAD_LETTER: "original_event failed_consumer error_type error_message attempt_count first_failed_at last_failed_at",
}


def _contract_sql() -> str:
    parts = []
    for event_type, names in _FIELDS.items():
        for name in names.split():
            absent, wrong = "false", "false"
            if name == "order_id":
                absent = "k % 227 = 0"
            elif name == "node_id":
                absent = "k % 233 = 0"
            elif name in ("error_message", "first_failed_at", "last_failed_at"):
                absent = "true"
            elif name == "order_total":
                wrong = "k % 239 = 0"
            parts.append(
                f"SELECT '{event_type}' AS event_type, '1.0.0' AS schema_version, '{name}' AS field, count(*) AS rows, "
                f"count(*) FILTER (WHERE {absent}) AS absent, count(*) FILTER (WHERE {wrong}) AS wrong_type "
                f"FROM bronze WHERE event_type = '{event_type}' AND schema_version = '1.0.0'"
            )
    return "\nUNION ALL ".join(parts)


@query("contract_report", _sql(_contract_sql(), "bronze"))
def contract_report(spark, root):
    return reduce(
        DataFrame.unionByName,
        [conformity.contract_report(bronze(spark, root, t), t) for t in R.RAW_TYPES],
    )


@query("unknown_contracts", _sql(
    """SELECT event_type, schema_version, count(*) AS rows FROM bronze
    WHERE schema_version IS DISTINCT FROM '1.0.0' GROUP BY ALL""", "bronze"))
def unknown_contracts(spark, root):
    return conformity.unknown_contracts(bronze(spark, root))


_RECONCILED = """
    SELECT event_type, b.bronze_rows, b.bronze_distinct, coalesce(j.on_time, 0) AS on_time,
      coalesce(j.late, 0) AS late, coalesce(j.rejected, 0) AS rejected,
      b.bronze_distinct - coalesce(j.on_time, 0) - coalesce(j.late, 0) - coalesce(j.rejected, 0) AS unaccounted,
      b.latest_ingested_at
    FROM (SELECT event_type, count(*) AS bronze_rows, max(ingested_at) AS latest_ingested_at,
        count(DISTINCT coalesce(event_id, '')) AS bronze_distinct FROM bronze GROUP BY 1) b
    LEFT JOIN (SELECT event_type, count(*) FILTER (WHERE route = 'on_time') AS on_time,
        count(*) FILTER (WHERE route = 'late') AS late, count(*) FILTER (WHERE route = 'rejected') AS rejected
      FROM judged GROUP BY 1) j USING (event_type)"""


@query("dq_reconciliation", _sql(_RECONCILED))
def dq_reconciliation(spark, root):
    return assurance.reconciliation_of_bronze(bronze(spark, root), C.EVENT_TYPES)


@query("dq_rates", statement(
    """SELECT 'bronze_silver_reconciliation' AS name, sum(abs(unaccounted)) = 0 AS passed,
      sum(unaccounted)::DOUBLE AS value, 0.0::DOUBLE AS threshold FROM reconciled
    UNION ALL SELECT 'schema_rejection_rate', sum(rejected) / (sum(on_time) + sum(rejected)) <= 0.05,
      round(sum(rejected) / (sum(on_time) + sum(rejected)), 4), 0.05 FROM reconciled
    UNION ALL SELECT 'duplicate_rate', true, round((sum(bronze_rows) - sum(bronze_distinct)) / sum(bronze_rows), 4),
      NULL FROM reconciled
    UNION ALL SELECT 'late_event_rate', sum(late) / (sum(on_time) + sum(late)) <= 0.1,
      round(sum(late) / (sum(on_time) + sum(late)), 4), 0.1 FROM reconciled
    UNION ALL SELECT 'freshness', (epoch(TIMESTAMP '2001-08-09 12:00:00') - epoch(max(latest_ingested_at))) / 60 <= 60,
      round((epoch(TIMESTAMP '2001-08-09 12:00:00') - epoch(max(latest_ingested_at))) / 60, 4), 60.0
    FROM reconciled""", "steps", raw=RAW, bronze=BRONZE, judged=JUDGED, reconciled=_RECONCILED))
def dq_rates(spark, root):
    now = F.lit("2001-08-09 12:00:00").cast("timestamp")
    return assurance.checks(assurance.reconciliation_of_bronze(bronze(spark, root), C.EVENT_TYPES), now).withColumn("value", F.round("value", 4))


@query("reprocess_silver_counts", _sql(
    """SELECT b.event_type, b.bronze_distinct, j.on_time, j.late, j.rejected,
      b.bronze_distinct = j.on_time + j.late + j.rejected AS balanced
    FROM (SELECT event_type, count(DISTINCT coalesce(event_id, '')) AS bronze_distinct FROM bronze GROUP BY 1) b
    JOIN (SELECT event_type, count(*) FILTER (WHERE route = 'on_time') AS on_time,
        count(*) FILTER (WHERE route = 'late') AS late, count(*) FILTER (WHERE route = 'rejected') AS rejected
      FROM judged GROUP BY 1) j ON b.event_type = j.event_type"""))
def reprocess_silver_counts(spark, root):
    per_type = assurance.reconciliation_of_bronze(bronze(spark, root), C.EVENT_TYPES)
    return per_type.select(
        "event_type", "bronze_distinct", "on_time", "late", "rejected", (F.col("unaccounted") == 0).alias("balanced")
    )


@query("request_violations", statement(
    """SELECT source, checked, rule, violations FROM (
      SELECT 'order_line' AS source, count(*) AS checked, 'qty_positive' AS rule,
        count(*) FILTER (WHERE qty - CASE WHEN k % 101 = 0 THEN 30 ELSE 0 END <= 0) AS violations FROM lines
      UNION ALL SELECT 'order_line', count(*), 'sku_length', count(*) FILTER (WHERE part_no % 997 = 0) FROM lines
      UNION ALL SELECT 'order_line', count(*), 'unit_price_not_negative', count(*) FILTER (WHERE unit_price < 0) FROM lines
      UNION ALL SELECT 'order', count(*), 'has_items', count(*) FILTER (WHERE n = 0) FROM per_order
      UNION ALL SELECT 'order', count(*), 'currency_length', count(*) FILTER (WHERE k % 103 = 0) FROM per_order
      UNION ALL SELECT 'transition', count(*), 'expected_version_positive',
        count(*) FILTER (WHERE k % 107 = 0) FROM facts)""", "lines",
    per_order="SELECT k, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS n FROM facts"))
def request_violations(spark, root):
    k = F.col("k")
    lines = R.order_lines(spark, root).select(
        F.when(F.col("part_no") % 997 == 0, "").otherwise(F.col("sku")).alias("sku"),
        (F.col("qty") - F.when(k % 101 == 0, 30).otherwise(0)).alias("qty"), "unit_price",
    )
    per_order = R.table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("line_count")
    )
    facts = R.order_facts(spark, root).select("k")
    orders = facts.join(per_order, "k", "left").select(
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.when(k % 103 == 0, "EURO").otherwise("EUR").alias("currency"),
    )
    transitions = facts.select(F.when(k % 107 == 0, 0).otherwise(1).alias("expected_version"))
    return (
        conformity.violations(lines, "order_line", conformity.LINE_RULES)
        .unionByName(conformity.violations(orders, "order", conformity.ORDER_RULES))
        .unionByName(conformity.violations(transitions, "transition", conformity.TRANSITION_RULES))
    )


@query("constraint_violations", statement(
    """SELECT 'inventory_stock' AS source, count(*) AS checked, 'available_not_negative' AS rule,
      count(*) FILTER (WHERE available_qty < 5) AS violations FROM stock
    UNION ALL SELECT 'inventory_stock', count(*), 'reserved_not_negative', 0 FROM stock
    UNION ALL SELECT 'inventory_stock', count(*), 'committed_not_negative', count(*) FILTER (WHERE reserved_qty = 0) FROM stock
    UNION ALL SELECT 'reservations', count(*), 'qty_positive', count(*) FILTER (WHERE k % 5 = 0) FROM steps
      WHERE reserved_at IS NOT NULL
    UNION ALL SELECT 'orders', count(*), 'total_not_negative', count(*) FILTER (WHERE o_totalprice < 50000) FROM orders""",
    "steps", "stock"))
def constraint_violations(spark, root):
    stock = R.stock(spark, root).select(
        (F.col("available_qty") - 5).alias("available_qty"), "reserved_qty",
        (F.col("reserved_qty") - 1).alias("committed_qty"),
    )
    held = R.reservations(spark, root).select((F.col("qty") - 1).alias("qty"))
    orders = R.table(spark, root, "orders").select((F.col("o_totalprice") - 50000).alias("order_total"))
    return (
        conformity.violations(stock, "inventory_stock", conformity.STOCK_RULES)
        .unionByName(conformity.violations(held, "reservations", conformity.RESERVATION_RULES))
        .unionByName(conformity.violations(orders, "orders", conformity.ORDER_TABLE_RULES))
    )


@query("orphan_references", statement(
    """SELECT 'orders.assigned_node_id' AS reference, count(DISTINCT k % 27) AS missing_keys, count(*) AS orphan_rows
      FROM steps WHERE assigned_at IS NOT NULL AND k % 27 >= (SELECT count(*) FROM nation)
    UNION ALL SELECT 'reservations.node_id', 0, 0
    UNION ALL SELECT 'reservations.order_id', count(DISTINCT k), count(*) FROM steps
      WHERE reserved_at IS NOT NULL AND k % 61 = 0""", "steps"))
def orphan_references(spark, root):
    facts, nodes = R.order_facts(spark, root), R.nodes(spark, root)
    k = F.col("k")
    orders = facts.where(F.col("assigned_at").isNotNull()).select(
        F.concat(F.lit("N"), (k % 27).cast("string")).alias("assigned_node_id")
    )
    held = R.reservations(spark, root)
    number = F.substring("order_id", 2, 30).cast("bigint")
    strayed = held.select(F.when(number % 61 == 0, F.concat("order_id", F.lit("?"))).otherwise(F.col("order_id"))
                          .alias("order_id"))
    return (
        conformity.missing_references(orders, "orders.assigned_node_id", "assigned_node_id", nodes, "node_id")
        .unionByName(conformity.missing_references(held, "reservations.node_id", "node_id", nodes, "node_id"))
        .unionByName(conformity.missing_references(strayed, "reservations.order_id", "order_id", facts, "order_id"))
    )


@query("causation_orphans", statement(
    """SELECT event_type, causation, count(*) AS n FROM (
      SELECT 'order.created' AS event_type, 'root' AS causation FROM steps
      UNION ALL SELECT 'order.validated', 'ok' FROM steps
      UNION ALL SELECT 'inventory.reservation.requested', 'ok' FROM steps
      UNION ALL SELECT 'inventory.reserved', 'ok' FROM steps WHERE reserved_at IS NOT NULL
      UNION ALL SELECT 'inventory.rejected', 'ok' FROM steps WHERE rejected_at IS NOT NULL
      UNION ALL SELECT 'fulfillment.assigned', 'ok' FROM steps WHERE assigned_at IS NOT NULL
      UNION ALL SELECT 'order.shipped', CASE WHEN k % 53 = 0 THEN 'orphan' ELSE 'ok' END FROM steps
        WHERE shipped_at IS NOT NULL
      UNION ALL SELECT 'order.failed', 'ok' FROM steps WHERE failed_at IS NOT NULL
      UNION ALL SELECT 'order.cancelled', 'non_root_without_parent' FROM steps WHERE cancelled_at IS NOT NULL
      UNION ALL SELECT 'inventory.low', 'non_root_without_parent' FROM steps WHERE low_at IS NOT NULL)
    GROUP BY ALL""", "steps"))
def causation_orphans(spark, root):
    classes = conformity.causation_classes(R.event_log(spark, root))
    return classes.groupBy("event_type", "causation").agg(F.count(F.lit(1)).alias("n"))


@query("unprocessed_events", statement(
    "SELECT 'order.validated:' || k AS event_id, order_id, validated_at AS occurred_at FROM steps WHERE k % 41 >= 10",
    "steps"))
def unprocessed_events(spark, root):
    events = R.event_log(spark, root).where(F.col("event_type") == C.ORDER_VALIDATED)
    left = conformity.not_yet_processed(events, R.processed_ledger(spark, root), "order-validator")
    return left.select("event_id", "order_id", "occurred_at")


@query("stale_order_events", statement(
    """SELECT 'order.validated:' || k AS event_id, order_id,
      CASE WHEN k % 71 = 0 THEN 'unknown_order' WHEN status <> 'O' THEN 'stale' ELSE 'apply' END AS effect
    FROM facts""", "facts"))
def stale_order_events(spark, root):
    events = R.event_log(spark, root).where(F.col("event_type") == C.ORDER_VALIDATED)
    orders = R.order_facts(spark, root).where(F.col("k") % 71 != 0).select("order_id", "status")
    return conformity.guard_stale(events, orders, expected="O").select("event_id", "order_id", "effect")
