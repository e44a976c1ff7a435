"""Contracts, routes and balance of all eleven event types and an unregistered one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.operators import assurance, conformity, intake, lifecycle, refine
from tidewater.plans.registry import query, statement
from tidewater.sources import lake
from tidewater.sources import retail as R

_TIMES = {
    C.ORDER_CREATED: "created_at", C.ORDER_VALIDATED: "validated_at", C.RESERVATION_REQUESTED: "requested_at",
    C.INVENTORY_RESERVED: "reserved_at", C.INVENTORY_REJECTED: "rejected_at", C.FULFILLMENT_ASSIGNED: "assigned_at",
    C.ORDER_SHIPPED: "shipped_at", C.ORDER_CANCELLED: "cancelled_at", C.ORDER_FAILED: "failed_at",
    C.INVENTORY_LOW: "low_at", C.DEAD_LETTER: "dead_at",
    R.UNREGISTERED: "CASE WHEN k % 9 = 4 THEN created_at + INTERVAL 30 DAY END",
}
_EVENTS = f"""
    SELECT s.k, t.event_type, t.happened, coalesce(n.lines, 0) AS lines,
      CASE WHEN s.k % 229 <> 0 THEN t.event_type || ':' || s.k END AS event_id,
      CASE WHEN s.k % 213 = 0 THEN '9.9.9' WHEN s.k % 211 <> 0 THEN '1.0.0' END AS schema_version,
      CASE WHEN s.k % 223 <> 0 THEN t.happened END AS event_time,
      (s.k % 6)::INTEGER AS kafka_partition, s.k * 2 + c.copy AS kafka_offset,
      t.happened + to_seconds((s.k % 125) * 5) AS ingested_at
    FROM steps s LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) n
      ON n.l_orderkey = s.k
    CROSS JOIN LATERAL (VALUES {', '.join(f"('{t}', {at})" for t, at in _TIMES.items())}) t(event_type, happened)
    JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR s.k % 20 = 0
    WHERE t.happened IS NOT NULL AND NOT (s.k % 350 = 7 OR s.k % 50 = 1 OR s.k % 450 = 2)"""
_ROUTED = """
    SELECT *, CASE WHEN defect IS NOT NULL THEN 'rejected'
        WHEN epoch(ingested_at) - epoch(event_time) > 600 THEN 'late' ELSE 'on_time' END AS route
    FROM (SELECT *, CASE WHEN schema_version IS DISTINCT FROM '1.0.0' THEN 'unknown_schema_version'
        WHEN event_id IS NULL THEN 'missing_event_id'
        WHEN event_time IS NULL THEN 'invalid_timestamp'
        WHEN event_type NOT IN ('deadletter.event', 'inventory.low') AND k % 227 = 0 THEN 'missing_required_field:order_id'
        WHEN event_type = 'inventory.low' AND lines = 0 THEN 'missing_required_field:sku'
        WHEN event_type IN ('order.shipped', 'fulfillment.assigned') AND k % 233 = 0
          THEN 'missing_required_field:node_id' END AS defect
      FROM events11 WHERE event_type <> 'order.returned')
    QUALIFY row_number() OVER (PARTITION BY event_type, event_id ORDER BY kafka_partition, kafka_offset) = 1"""


def bronze(spark, root):
    records = intake.inspect_records(R.catalogue_records(spark, root))
    return intake.bronze_rows(records, F.col("timestamp"))


def routed(rows):
    """One decision per event of a registered type: only these have a silver table."""
    return refine.decisions(refine.judged_any(rows.where(F.col("event_type").isin(*C.EVENT_TYPES))))


@query("catalogue_routes", statement(
    "SELECT event_type, route, defect, count(*) AS n FROM routed GROUP BY ALL", "steps", events11=_EVENTS, routed=_ROUTED))
def catalogue_routes(spark, root):
    return routed(bronze(spark, root)).groupBy("event_type", "route", "defect").agg(F.count(F.lit(1)).alias("n"))


@query("catalogue_reconciliation", statement(
    """SELECT event_type, b.bronze_rows, b.bronze_distinct, coalesce(on_time, 0) AS on_time, coalesce(late, 0) AS late,
      coalesce(rejected, 0) AS rejected,
      b.bronze_distinct - coalesce(on_time, 0) - coalesce(late, 0) - coalesce(rejected, 0) AS unaccounted, b.latest_ingested_at
    FROM (SELECT event_type, count(*) AS bronze_rows, count(DISTINCT coalesce(event_id, '')) AS bronze_distinct,
        max(ingested_at) AS latest_ingested_at FROM events11 GROUP BY 1) b
    LEFT JOIN (SELECT event_type, count(*) FILTER (WHERE route = 'on_time') AS on_time,
        count(*) FILTER (WHERE route = 'late') AS late, count(*) FILTER (WHERE route = 'rejected') AS rejected
      FROM routed GROUP BY 1) j USING (event_type)""", "steps", events11=_EVENTS, routed=_ROUTED))
def catalogue_reconciliation(spark, root):
    """Events of the unregistered type reach no silver table: they stay unaccounted, and the check fails."""
    return assurance.reconciliation_of_bronze(bronze(spark, root), C.EVENT_TYPES)


def _findings_sql() -> str:
    """One line per declared or extra field, from the arithmetic the records are made with."""
    ref = ("order_id", "1", "k % 227 = 0", "false")

    def plain(*names: str) -> list[tuple[str, str, str, str]]:
        return [(n, "1", "false", "false") for n in names]

    def each(name: str, *fields: str) -> list[tuple[str, str, str, str]]:
        return [(f"{name}[].{f}", "lines", "false", "k % 241 = 0" if f == "qty" else "false") for f in fields]

    node = ("node_id", "1", "k % 233 = 0", "false")
    scores = [(f"score_breakdown.{f}", "1", "k % 31 = 0" if f == "capacity" else "false", "false")
              for f in ("stock", "distance", "capacity", "delivery_estimate", "backlog")]
    fields = {
        C.ORDER_CREATED: [ref, *plain("customer_id", "items", "currency", "idempotency_key"),
                          ("order_total", "1", "false", "k % 239 = 0"), *each("items", "sku", "qty", "unit_price")],
        C.ORDER_VALIDATED: [ref, *plain("validated_at")],
        C.RESERVATION_REQUESTED: [ref, *plain("items", "candidate_node_ids"), *each("items", "sku", "qty")],
        C.INVENTORY_RESERVED: [ref, *plain("reservations"),
                               *each("reservations", "sku", "node_id", "qty", "reservation_id", "expires_at")],
        C.INVENTORY_REJECTED: [ref, *plain("reasons"), *each("reasons", "sku", "requested_qty", "available_qty")],
        C.FULFILLMENT_ASSIGNED: [ref, node, *plain("score", "score_breakdown", "estimated_ship_date"), *scores],
        C.ORDER_SHIPPED: [ref, node, *plain("shipped_at", "carrier_sim", "tracking_ref")],
        C.ORDER_CANCELLED: [ref, *plain("cancelled_by", "reason", "previous_state")],
        C.ORDER_FAILED: [ref, *plain("failed_step", "reason", "compensations_applied")],
        C.INVENTORY_LOW: [("sku", "1", "lines = 0", "false"), *plain("node_id", "available_qty", "threshold"),
                          ("evaluated_at", "1", "true", "false")],
        C.DEAD_LETTER: [*plain("original_event", "failed_consumer", "error_type", "attempt_count"),
                        *[(n, "1", "true", "false") for n in ("error_message", "first_failed_at", "last_failed_at")]],
    }
    parts = []
    for event_type, declared in fields.items():
        for name, weight, missing, drifted in declared:
            parts.append(f"""SELECT '{event_type}' AS event_type, '1.0.0' AS schema_version, '{name}' AS field, 'declared' AS status,
              sum({weight}) AS containers, sum(CASE WHEN {missing} THEN {weight} ELSE 0 END) AS missing,
              sum(CASE WHEN {drifted} THEN {weight} ELSE 0 END) AS drifted, 0 AS extra
              FROM events11 WHERE event_type = '{event_type}' AND schema_version = '1.0.0'""")
        extras = [("channel", "1", "k % 251 = 0")]
        extras += [(n.replace("[].qty", "[].was_qty"), w, "k % 241 = 0") for n, w, _, _ in declared if n.endswith("[].qty")]
        extras += [("was", "1", "k % 239 = 0")] if event_type == C.ORDER_CREATED else []
        for name, weight, there in extras:
            parts.append(f"""SELECT '{event_type}', '1.0.0', '{name}', 'extra', sum({weight}), 0, 0, sum({weight})
              FROM events11 WHERE event_type = '{event_type}' AND schema_version = '1.0.0' AND {there}""")
    union = "\nUNION ALL ".join(parts)
    return f"""SELECT event_type, schema_version, field, status, containers::BIGINT AS containers, missing::BIGINT AS missing,
      drifted::BIGINT AS drifted, extra::BIGINT AS extra FROM ({union}
    UNION ALL SELECT event_type, schema_version, '*', 'unknown_contract', count(*), 0, 0, 0 FROM events11
      WHERE event_type = 'order.returned' OR schema_version IS DISTINCT FROM '1.0.0' GROUP BY 1, 2) WHERE containers > 0"""


@query("contract_findings", statement(_findings_sql(), "steps", events11=_EVENTS))
def contract_findings(spark, root):
    return conformity.contract_findings(bronze(spark, root))


_FLAGS = ", ".join(f"bool_or(event_type = '{t}') AS s{i}" for i, t in enumerate(lifecycle.FUNNEL, 1))
_PATHS = f"""
    SELECT *, CASE WHEN reached = 6 THEN 'shipped' WHEN failed THEN 'failed' WHEN cancelled THEN 'cancelled' ELSE 'open' END
      AS outcome
    FROM (SELECT *, CASE {' '.join(f"WHEN NOT s{i} THEN {i - 1}" for i in range(1, 7))} ELSE 6 END AS reached
      FROM (SELECT k, {_FLAGS}, bool_or(event_type = 'order.failed') AS failed,
              bool_or(event_type = 'order.cancelled') AS cancelled
            FROM events11 WHERE event_time IS NOT NULL GROUP BY k))"""


def workflow_events(spark, root):
    return bronze(spark, root).select(
        "correlation_id", "event_type", "data_json", F.try_to_timestamp("occurred_at").alias("occurred_at")
    ).where("occurred_at is not null")


@query("workflow_paths", statement(
    """SELECT 'cor-' || k AS correlation_id, reached::BIGINT AS reached, outcome,
      CASE WHEN outcome = 'failed' THEN CASE WHEN k % 10 = 0 THEN 'RESERVE_INVENTORY' ELSE 'PROCESS_PAYMENT' END END
        AS failed_step,
      CASE WHEN outcome = 'failed' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'RELEASE_INVENTORY' END END AS compensations
    FROM paths""", "steps", events11=_EVENTS, paths=_PATHS))
def workflow_paths(spark, root):
    return lifecycle.workflow_paths(workflow_events(spark, root)).select(
        "correlation_id", "reached", "outcome", "failed_step", F.array_join("compensations", ",").alias("compensations"))


@query("workflow_funnel", statement(
    f"""SELECT step::BIGINT AS step, event_type, count(*) AS reached,
      count(*) FILTER (WHERE p.reached = step AND outcome = 'failed') AS failed,
      count(*) FILTER (WHERE p.reached = step AND outcome = 'cancelled') AS cancelled,
      count(*) FILTER (WHERE p.reached = step AND outcome = 'open') AS open,
      count(*) FILTER (WHERE p.reached = step AND outcome = 'failed' AND k % 10 <> 0) AS compensated
    FROM paths p JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(lifecycle.FUNNEL, 1))}) s(step, event_type)
      ON step <= p.reached GROUP BY ALL""", "steps", events11=_EVENTS, paths=_PATHS))
def workflow_funnel(spark, root):
    return lifecycle.funnel(lifecycle.workflow_paths(workflow_events(spark, root)))


@query("workflow_measures", statement(
    """SELECT outcome, count(*) AS workflows, round(count(*) / (SELECT count(*) FROM paths), 4) AS share,
      round(avg(seconds), 4) AS avg_seconds, max(seconds)::DOUBLE AS max_seconds
    FROM paths JOIN (SELECT k, epoch(max(event_time)) - epoch(min(event_time)) AS seconds FROM events11
      WHERE event_time IS NOT NULL GROUP BY k) USING (k) GROUP BY outcome""", "steps", events11=_EVENTS, paths=_PATHS))
def workflow_measures(spark, root):
    measures = lifecycle.workflow_measures(lifecycle.workflow_paths(workflow_events(spark, root)))
    return measures.withColumns({c: F.round(c, 4) for c in ("share", "avg_seconds")})


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


@query("table_inventory", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS numbered_rows FROM {t}" for t in TABLES))
def table_inventory(spark, root):
    """Rows of the files of each table, and how many their row numbers say there are."""
    from functools import reduce

    per_file = [lake.file_inventory(R.table(spark, root, t)).withColumn("table_name", F.lit(t)) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), per_file).groupBy("table_name").agg(
        F.sum("rows").alias("row_count"), F.sum(F.col("last_row") + 1).alias("numbered_rows"))
