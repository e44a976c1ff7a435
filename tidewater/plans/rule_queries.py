"""Stock, node choice, reservation, order state, workflow and dead-letter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.functions import rules
from tidewater.operators import allocation, lifecycle, scoring
from tidewater.plans.registry import query, statement
from tidewater.sources import retail as R

_WANTED = """SELECT l.order_id, 'N' || ((l.k + o.step) % 25) AS node_id, l.sku, l.qty
    FROM lines l JOIN (VALUES (0), (7), (13)) o(step) ON true"""


def wanted(spark, root):
    """Every order line at three candidate nodes of its order."""
    return R.order_lines(spark, root).selectExpr(
        "order_id", "explode(array(k % 25, (k + 7) % 25, (k + 13) % 25)) as n", "sku", "qty"
    ).selectExpr("order_id", "concat('N', n) as node_id", "sku", "qty")


@query("stock_sufficiency", statement(
    """SELECT order_id, node_id, count(*) AS line_count,
      count(*) FILTER (WHERE coalesce(available_qty, 0) < qty) AS short_lines,
      count(*) FILTER (WHERE coalesce(available_qty, 0) < qty) = 0 AS sufficient
    FROM wanted LEFT JOIN stock USING (sku, node_id) GROUP BY ALL""", "lines", "stock", wanted=_WANTED))
def stock_sufficiency(spark, root):
    return scoring.stock_sufficiency(wanted(spark, root), R.stock(spark, root))


@query("stock_shortfalls", statement(
    """SELECT order_id, node_id, sku, qty AS requested_qty, coalesce(available_qty, 0)::INTEGER AS available_qty
    FROM wanted LEFT JOIN stock USING (sku, node_id) WHERE coalesce(available_qty, 0) < qty""",
    "lines", "stock", wanted=_WANTED))
def stock_shortfalls(spark, root):
    return scoring.shortfalls(wanted(spark, root), R.stock(spark, root))


def _fraction(text: str, start: int) -> str:
    return f"('0x' || substr(sha256({text}), {start}, 8))::BIGINT / 4294967295.0::DOUBLE"


@query("customer_location", f"""
    SELECT 'C' || c_custkey AS customer_id, round({_fraction("'C' || c_custkey", 1)} * 180 - 90, 6) AS latitude,
      round({_fraction("'C' || c_custkey", 9)} * 360 - 180, 6) AS longitude FROM customer""")
def customer_location(spark, root):
    lat, lon = rules.pseudo_location("customer_id")
    return R.table(spark, root, "customer").selectExpr("concat('C', c_custkey) as customer_id").select(
        "customer_id", F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude")
    )


_SCORES = {
    "need": "SELECT order_id, customer_id, sku, max(qty) AS qty FROM lines GROUP BY ALL",
    "candidates": """SELECT a.order_id, a.customer_id, a.node_id
        FROM (SELECT n.order_id, n.customer_id, s.node_id, count(*) AS served FROM need n
              JOIN stock s ON s.sku = n.sku AND s.available_qty >= n.qty
              JOIN nodes d ON d.node_id = s.node_id AND d.active GROUP BY ALL) a
        JOIN (SELECT order_id, count(*) AS skus FROM need GROUP BY 1) b
          ON a.order_id = b.order_id AND a.served = b.skus""",
    "placed": f"""SELECT customer_id, {_fraction("customer_id", 1)} * 180 - 90 AS lat,
        {_fraction("customer_id", 9)} * 360 - 180 AS lon
        FROM (SELECT DISTINCT customer_id FROM candidates)""",
    "measured": """SELECT order_id, node_id, capacity_per_day, current_backlog,
        2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2)
          + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) AS km
        FROM candidates JOIN placed USING (customer_id) JOIN nodes USING (node_id)""",
    "parts": """SELECT order_id, node_id, 1 + km / 500 AS days, capacity_per_day, current_backlog,
        CASE WHEN max(km) OVER o = min(km) OVER o THEN 1.0::DOUBLE
             ELSE 1 - (km - min(km) OVER o) / (max(km) OVER o - min(km) OVER o) END AS distance,
        max(capacity_per_day) OVER o AS largest
        FROM measured WINDOW o AS (PARTITION BY order_id)""",
    "scores": """SELECT order_id, node_id,
        round((0.35::DOUBLE * distance + 0.25::DOUBLE * distance
          + 0.20::DOUBLE * greatest(0, 1 - current_backlog / capacity_per_day)
          + 0.20::DOUBLE * (capacity_per_day / largest))::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE AS score,
        round(distance, 4) AS distance_score, round(capacity_per_day / largest, 4) AS capacity_score,
        round(greatest(0, 1 - current_backlog / capacity_per_day), 4) AS backlog_score,
        round(days, 2) AS estimated_ship_date_days FROM parts""",
}


def scores(spark, root):
    lines = R.order_lines(spark, root)
    nodes = R.nodes(spark, root)
    candidates = scoring.serving_nodes(lines, R.stock(spark, root), nodes)
    return scoring.node_scores(candidates, R.order_facts(spark, root), nodes)


@query("node_scores", statement(
    """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, node_id)::INTEGER AS rank FROM scores""",
    "lines", "stock", "nodes", **_SCORES))
def node_scores(spark, root):
    return scoring.ranked(scores(spark, root)).selectExpr(
        "order_id", "node_id", "score", "score_breakdown.distance as distance_score",
        "score_breakdown.capacity as capacity_score", "score_breakdown.backlog as backlog_score",
        "estimated_ship_date_days", "rank",
    )


@query("node_selection", statement(
    """SELECT f.order_id, b.node_id, b.score, b.estimated_ship_date_days,
      CASE WHEN b.node_id IS NULL THEN 'no inventory' END AS failure
    FROM facts f LEFT JOIN (SELECT * FROM scores
      QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY score DESC, node_id) = 1) b USING (order_id)""",
    "lines", "stock", "nodes", **_SCORES))
def node_selection(spark, root):
    return scoring.select_nodes(R.order_facts(spark, root), scores(spark, root))


_ALLOCATION = {
    "numbered": """SELECT order_id, sku, node_id, qty, occurred_at AS requested_at, available_qty AS stock,
        reorder_threshold,
        row_number() OVER (PARTITION BY sku, node_id ORDER BY occurred_at, k, qty, line_price) AS n
        FROM lines LEFT JOIN stock USING (sku, node_id)""",
    "walk": """SELECT order_id, sku, node_id, qty, requested_at, reorder_threshold, n, stock AS before,
          CASE WHEN qty <= stock THEN stock - qty ELSE stock END AS after FROM numbered WHERE n = 1 AND stock IS NOT NULL
        UNION ALL
        SELECT r.order_id, r.sku, r.node_id, r.qty, r.requested_at, r.reorder_threshold, r.n, w.after,
          CASE WHEN r.qty <= w.after THEN w.after - r.qty ELSE w.after END
        FROM walk w JOIN numbered r ON r.sku = w.sku AND r.node_id = w.node_id AND r.n = w.n + 1""",
}


def outcomes(spark, root):
    return allocation.reserve(
        R.reservation_requests(spark, root), R.stock(spark, root), ["requested_at", "k", "qty", "line_price"]
    )


@query("reservation_allocation", statement(
    """SELECT order_id, sku, node_id, qty, requested_at, CASE WHEN qty <= before THEN 'reserved' ELSE 'rejected' END
        AS outcome, before::BIGINT AS available_before, after::BIGINT AS available_after FROM walk
    UNION ALL SELECT order_id, sku, node_id, qty, requested_at, 'unknown_stock', NULL, NULL
    FROM numbered WHERE stock IS NULL""", "lines", "stock", recursive=True, **_ALLOCATION))
def reservation_allocation(spark, root):
    return outcomes(spark, root).select(
        "order_id", "sku", "node_id", "qty", "requested_at", "outcome", "available_before", "available_after"
    )


FALLBACK_ROUNDS = 3


def _fallback_steps() -> dict[str, str]:
    """The rounds of the fallback allocation, written out one after the other."""
    steps = {
        "wants": """SELECT order_id, sku, sum(qty) AS qty, min(k) AS k, min(occurred_at) AS requested_at
            FROM lines GROUP BY ALL""",
        "ranks": """SELECT order_id, node_id, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, node_id) AS rank
            FROM scores""",
        "placed0": "SELECT NULL::VARCHAR AS order_id, NULL::VARCHAR AS node_id, 0 AS round WHERE false",
        "taken0": "SELECT NULL::VARCHAR AS sku, NULL::VARCHAR AS node_id, 0 AS taken WHERE false",
    }
    for turn in range(1, FALLBACK_ROUNDS + 1):
        before = turn - 1
        steps |= {
            f"asks{turn}": f"""SELECT w.order_id, w.sku, r.node_id, w.qty,
                coalesce(s.available_qty, 0) - coalesce(t.taken, 0) AS left_qty,
                sum(w.qty) OVER (PARTITION BY w.sku, r.node_id ORDER BY w.requested_at, w.k ROWS UNBOUNDED PRECEDING) AS upto
                FROM wants w JOIN ranks r ON r.order_id = w.order_id AND r.rank = {turn}
                LEFT JOIN stock s ON s.sku = w.sku AND s.node_id = r.node_id
                LEFT JOIN taken{before} t ON t.sku = w.sku AND t.node_id = r.node_id
                WHERE w.order_id NOT IN (SELECT order_id FROM placed{before})""",
            f"won{turn}": f"""SELECT order_id, node_id, {turn} AS round FROM asks{turn} GROUP BY ALL
                HAVING bool_and(upto <= left_qty)""",
            f"placed{turn}": f"SELECT * FROM placed{before} UNION ALL SELECT * FROM won{turn}",
            f"taken{turn}": f"""SELECT sku, node_id, sum(taken) AS taken FROM (SELECT * FROM taken{before} UNION ALL
                SELECT a.sku, a.node_id, a.qty FROM asks{turn} a JOIN won{turn} USING (order_id)) GROUP BY ALL""",
        }
    return steps


@query("fallback_allocation", statement(
    f"""SELECT f.order_id, p.node_id, p.round::INTEGER AS round,
      CASE WHEN f.order_id NOT IN (SELECT order_id FROM ranks) THEN 'no inventory'
           WHEN p.node_id IS NULL THEN 'all nodes refused' END AS failure
    FROM facts f LEFT JOIN placed{FALLBACK_ROUNDS} p ON p.order_id = f.order_id
    WHERE f.order_id IN (SELECT order_id FROM wants)""",
    "lines", "stock", "nodes", **_SCORES, **_fallback_steps()))
def fallback_allocation(spark, root):
    lines = R.order_lines(spark, root)
    orders = lines.groupBy("order_id").agg(F.min("occurred_at").alias("requested_at"), F.min("k").alias("k"))
    return allocation.allocate_with_fallback(
        orders, lines, scoring.ranked(scores(spark, root)), R.stock(spark, root), ["requested_at", "k"], FALLBACK_ROUNDS)


@query("reservation_events", statement(
    """SELECT CASE WHEN qty <= before THEN 'inventory.reserved' ELSE 'inventory.rejected' END AS event_type,
      order_id, sku, node_id, qty, CASE WHEN qty <= before THEN requested_at + INTERVAL 15 MINUTE END AS expires_at,
      CASE WHEN qty > before THEN before END::BIGINT AS available_qty FROM walk""",
    "lines", "stock", recursive=True, **_ALLOCATION))
def reservation_events(spark, root):
    return allocation.result_events(outcomes(spark, root), "requested_at")


@query("low_stock_alerts", statement(
    """SELECT order_id, sku, node_id, after::BIGINT AS available_qty, reorder_threshold AS threshold
    FROM walk WHERE qty <= before AND after <= reorder_threshold""", "lines", "stock", recursive=True, **_ALLOCATION))
def low_stock_alerts(spark, root):
    return allocation.low_stock(outcomes(spark, root))


@query("incident_counters", statement(
    """SELECT 'conflict' AS counter, sku AS label, count(*) AS n FROM walk WHERE qty > before GROUP BY sku
    UNION ALL SELECT 'dead_letter', CASE k % 3 WHEN 0 THEN 'order.created' WHEN 1 THEN 'order.validated' ELSE 'order.shipped' END,
      count(*) FROM steps WHERE dead_at IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'retry', CASE k % 2 WHEN 0 THEN 'order-validator' ELSE 'fulfillment-orchestrator' END, sum(k % 5)::BIGINT
      FROM steps WHERE dead_at IS NOT NULL GROUP BY 2""", "steps", "lines", "stock", recursive=True, **_ALLOCATION))
def incident_counters(spark, root):
    return lifecycle.incident_counters(outcomes(spark, root), R.dead_letters(spark, root))


_NOW = "1998-06-01 00:00:00"
_HELD = """SELECT 'R' || k AS reservation_id, order_id, 'P' || (k % 200) AS sku, node_id, (k % 5 + 1)::INTEGER AS qty,
    CASE k % 6 WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'COMMITTED' ELSE 'ACTIVE' END AS status,
    reserved_at + INTERVAL 15 MINUTE AS expires_at FROM steps WHERE reserved_at IS NOT NULL"""


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("expired_reservations", statement(
    f"""SELECT reservation_id, order_id, sku, node_id, qty, expires_at FROM held
    WHERE status = 'ACTIVE' AND expires_at < TIMESTAMP '{_NOW}'""", "steps", held=_HELD))
def expired_reservations(spark, root):
    return allocation.expired(R.reservations(spark, root), _now()).select(
        "reservation_id", "order_id", "sku", "node_id", "qty", "expires_at"
    )


@query("stock_after_expiry", statement(
    f"""SELECT sku, node_id, (available_qty + coalesce(q, 0))::BIGINT AS available_qty,
      (reserved_qty - coalesce(q, 0))::BIGINT AS reserved_qty, version + coalesce(t, 0) AS version
    FROM stock LEFT JOIN (SELECT sku, node_id, sum(qty) AS q, count(*) AS t FROM held
      WHERE status = 'ACTIVE' AND expires_at < TIMESTAMP '{_NOW}' GROUP BY ALL) USING (sku, node_id)""",
    "steps", "stock", held=_HELD))
def stock_after_expiry(spark, root):
    ended = allocation.expired(R.reservations(spark, root), _now())
    return allocation.give_back(R.stock(spark, root), ended).drop("reorder_threshold")


@query("stock_upsert", statement(
    """SELECT coalesce(s.sku, c.sku) AS sku, coalesce(s.node_id, c.node_id) AS node_id,
      (CASE WHEN c.sku IS NULL THEN s.available_qty ELSE c.available_qty END)::INTEGER AS available_qty,
      (CASE WHEN c.sku IS NULL THEN s.reorder_threshold ELSE c.reorder_threshold END)::INTEGER AS reorder_threshold,
      (coalesce(s.version, 0) + coalesce(c.times, 0))::BIGINT AS version
    FROM stock s FULL JOIN (SELECT 'P' || (k % 200) AS sku, node_id, count(*) AS times,
        arg_max((k * 7) % 100, k) AS available_qty, arg_max(k % 15, k) AS reorder_threshold FROM facts GROUP BY ALL) c
      ON s.sku = c.sku AND s.node_id = c.node_id""", "facts", "stock"))
def stock_upsert(spark, root):
    return allocation.upsert_stock(R.stock(spark, root), R.stock_changes(spark, root))


_PAIRS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, following in C.NEXT_STATES.items() for b in following
) + ") p(a, b)"
_NAMES = "['CREATED', " + ", ".join(f"'{s}'" for s in R.STEP_STATES) + "]"


@query("transition_audit", statement(
    f"""SELECT order_id, from_status, to_status, changed_at,
      CASE WHEN from_status IS NULL AND before IS NULL AND to_status = 'CREATED' THEN 'ok'
        WHEN from_status IS NULL OR before IS NULL THEN 'bad_start'
        WHEN NOT EXISTS (SELECT 1 FROM pairs WHERE a = from_status AND b = to_status) THEN 'illegal_transition'
        WHEN from_status <> before THEN 'discontinuous' ELSE 'ok' END AS finding
    FROM (SELECT *, lag(to_status) OVER (PARTITION BY order_id ORDER BY changed_at) AS before FROM (
      SELECT k, order_id, created_at + to_minutes(i * 5) AS changed_at,
        CASE WHEN i > 0 THEN ({_NAMES})[i] END AS from_status,
        CASE WHEN k % 31 = 0 AND i = 3 THEN 'SHIPPED' ELSE ({_NAMES})[i + 1] END AS to_status
      FROM facts, range(8) r(i) WHERE i <= k % 8 AND NOT (k % 43 = 0 AND i = 2)))""", "facts", pairs=_PAIRS))
def transition_audit(spark, root):
    return lifecycle.transition_audit(R.status_history(spark, root))


@query("state_replay", statement(
    """SELECT order_id, seq, to_status, expected_version, status_before, version_before, verdict FROM walk WHERE seq > 0""",
    "facts", recursive=True, pairs=_PAIRS,
    requests=f"""SELECT order_id, i AS seq,
        CASE WHEN k % 31 = 0 AND i = 3 THEN 'SHIPPED' WHEN k % 23 = 0 AND i = 5 THEN 'CANCELLED'
          ELSE ({_NAMES})[i + 1] END AS to_status,
        i - CASE WHEN k % 37 = 0 AND i = 4 THEN 1 ELSE 0 END AS expected_version,
        CASE WHEN k % 41 <> 0 THEN node_id END AS node_id
        FROM facts, range(1, 8) r(i) WHERE i <= 3 + k % 5""",
    walk="""SELECT order_id, 0::BIGINT AS seq, NULL::VARCHAR AS to_status, NULL::BIGINT AS expected_version,
          NULL::VARCHAR AS status_before, NULL::BIGINT AS version_before, NULL::VARCHAR AS verdict,
          'CREATED' AS status, 1::BIGINT AS version FROM facts
        UNION ALL
        SELECT order_id, seq, to_status, expected_version, status, version, verdict,
          CASE WHEN verdict = 'applied' THEN to_status ELSE status END,
          CASE WHEN verdict = 'applied' THEN version + 1 ELSE version END
        FROM (SELECT w.status, w.version, r.*, CASE
            WHEN p.a IS NULL THEN 'invalid'
            WHEN r.to_status = 'FULFILLMENT_ASSIGNED' AND r.node_id IS NULL THEN 'missing_node'
            WHEN r.expected_version <> w.version THEN 'conflict' ELSE 'applied' END AS verdict
          FROM walk w JOIN requests r ON r.order_id = w.order_id AND r.seq = w.seq + 1
          LEFT JOIN pairs p ON p.a = w.status AND p.b = r.to_status)"""))
def state_replay(spark, root):
    return lifecycle.replay_states(R.transition_requests(spark, root)).drop("node_id")


@query("idempotency_resolution", statement(
    """SELECT idempotency_key, request_id, request_hash,
      CASE WHEN n = 0 THEN 'created' WHEN request_hash = first_value(request_hash) OVER w THEN 'replayed'
        ELSE 'conflict' END AS resolution,
      first_value(request_id) OVER w AS answered_by
    FROM (SELECT 'key-' || k AS idempotency_key, 'req-' || k || '-' || n AS request_id, n,
        sha256('{"currency":"EUR","customer_id":"' || customer_id || '","qty":'
          || (k % 5 + 1 + CASE WHEN n = 2 THEN 1 ELSE 0 END) || ',"sku":"P' || (k % 200) || '"}') AS request_hash
      FROM facts, (VALUES (0), (1), (2)) t(n)
      WHERE n = 0 OR (n = 2 AND k % 37 = 0) OR (n = 1 AND k % 11 = 0 AND k % 37 <> 0))
    WINDOW w AS (PARTITION BY idempotency_key ORDER BY n)""", "facts"))
def idempotency_resolution(spark, root):
    return lifecycle.resolve_idempotency(R.order_requests(spark, root), ["customer_id", "sku", "qty", "currency"])


@query("order_totals", statement(
    """SELECT order_id, sum(qty::DECIMAL(12, 0) * unit_price::DECIMAL(12, 2))::DECIMAL(18, 2) AS order_total
    FROM lines GROUP BY order_id""", "lines"))
def order_totals(spark, root):
    return lifecycle.order_totals(R.order_lines(spark, root))


@query("order_lifecycle", statement(
    """SELECT 'cor-' || k AS correlation_id, created_at, validated_at, reserved_at, rejected_at, assigned_at,
      shipped_at, failed_at, cancelled_at,
      CASE WHEN shipped_at IS NOT NULL THEN 'shipped' WHEN failed_at IS NOT NULL THEN 'failed'
        WHEN cancelled_at IS NOT NULL THEN 'cancelled' ELSE 'open' END AS outcome,
      CASE WHEN shipped_at IS NULL AND failed_at IS NOT NULL THEN
        CASE WHEN reserved_at IS NULL THEN 'SELECT_AND_RESERVE' ELSE 'AUTHORIZE_PAYMENT' END END AS failed_step,
      shipped_at IS NULL AND failed_at IS NOT NULL AND reserved_at IS NOT NULL AS compensated FROM steps""", "steps"))
def order_lifecycle(spark, root):
    return lifecycle.order_lifecycle(R.event_log(spark, root))


_SAGAS = """SELECT 'S' || k AS saga_id, k, order_id,
    CASE WHEN status = 'O' AND k % 4 = 0 THEN 'RUNNING' WHEN shipped_at IS NOT NULL THEN 'COMPLETED' ELSE 'FAILED' END
      AS status,
    CASE WHEN status = 'O' AND k % 8 = 0 THEN 'SELECT_AND_RESERVE' WHEN status = 'O' AND k % 4 = 0
      THEN 'AUTHORIZE_PAYMENT' ELSE 'DONE' END AS current_step,
    validated_at AS created_at,
    CASE WHEN status = 'O' AND k % 4 = 0 THEN validated_at + INTERVAL 1 MINUTE ELSE coalesce(shipped_at, failed_at) END
      AS updated_at FROM steps"""


@query("saga_duration", statement(
    """SELECT CASE status WHEN 'COMPLETED' THEN 'completed' ELSE 'failed' END AS result,
      quantile_cont(epoch(updated_at) - epoch(created_at), 0.5) AS p50_seconds,
      quantile_cont(epoch(updated_at) - epoch(created_at), 0.95) AS p95_seconds
    FROM sagas WHERE status <> 'RUNNING' GROUP BY 1""", "steps", sagas=_SAGAS))
def saga_duration(spark, root):
    return lifecycle.saga_duration(R.sagas(spark, root))


@query("compensation_audit", statement(
    """SELECT 'R' || k AS reservation_id, order_id, 'P' || (k % 200) AS sku, node_id, (k % 5 + 1)::INTEGER AS qty
    FROM steps WHERE failed_at IS NOT NULL AND reserved_at IS NOT NULL AND k % 3 = 0""", "steps"))
def compensation_audit(spark, root):
    failed = R.happened(R.order_facts(spark, root), "failed_at")
    return lifecycle.unreleased(failed, R.reservations(spark, root), R.releases(spark, root))


@query("incomplete_sagas", statement(
    """SELECT saga_id, order_id, current_step, updated_at FROM sagas
    WHERE status = 'RUNNING' AND updated_at < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 1 HOUR""", "steps", sagas=_SAGAS))
def incomplete_sagas(spark, root):
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return lifecycle.stalled_sagas(R.sagas(spark, root), now, "1 hour").select(
        "saga_id", "order_id", "current_step", "updated_at"
    )


@query("cancelled_while_running", statement(
    """SELECT saga_id, order_id, 'FAILED' AS status, 'DONE' AS current_step,
      'cancelled by the customer before the workflow ended' AS last_error,
      CASE WHEN k % 10 <> 0 AND k % 6 > 1 THEN 1 ELSE 0 END::BIGINT AS released
    FROM sagas WHERE status = 'RUNNING' AND k % 12 = 4""", "steps", sagas=_SAGAS))
def cancelled_while_running(spark, root):
    return lifecycle.cancelled_while_running(
        R.sagas(spark, root), R.cancel_events(spark, root), R.reservations(spark, root)
    )


@query("dead_letter_capture", statement(
    """SELECT 'order.validated:' || k AS original_event_id, 'order.validated' AS event_type,
      'order.validated:' || k AS embedded_id, 'cor-' || k AS embedded_correlation,
      'order-validator' AS failed_consumer, 'TimeoutError' AS error_type, 'no answer for ' || order_id AS error_message,
      5 AS attempt_count, validated_at AS first_failed_at, validated_at + INTERVAL 3 SECOND AS last_failed_at
    FROM steps WHERE k % 59 = 0""", "steps"))
def dead_letter_capture(spark, root):
    failures = R.event_log(spark, root).where(f"event_type = '{C.ORDER_VALIDATED}' and k % 59 = 0").selectExpr(
        "*", "'TimeoutError' as error_type", "concat('no answer for ', order_id) as error_message",
        f"{C.RETRY_ATTEMPTS} as attempt_count", "occurred_at as first_failed_at",
        "occurred_at + interval 3 seconds as last_failed_at",
    )
    envelope = ["event_id", "event_type", "occurred_at", "producer", "correlation_id", "causation_id"]
    captured = lifecycle.capture_dead_letters(failures, envelope, "order-validator")
    return captured.select(
        "original_event_id", "event_type",
        F.get_json_object("original_event", "$.event_id").alias("embedded_id"),
        F.get_json_object("original_event", "$.correlation_id").alias("embedded_correlation"),
        "failed_consumer", "error_type", "error_message", "attempt_count", "first_failed_at", "last_failed_at",
    )


@query("dead_letter_replay", statement(
    """SELECT 'dead-' || k AS dead_letter_id,
      CASE k % 3 WHEN 0 THEN 'order.created' WHEN 1 THEN 'order.validated' ELSE 'order.shipped' END AS topic,
      'evt-' || k AS key, 'send' AS replay, order_id
    FROM steps WHERE dead_at IS NOT NULL AND k % 4 <> 1""", "steps"))
def dead_letter_replay(spark, root):
    return lifecycle.replay_set(R.dead_letters(spark, root)).select(
        "dead_letter_id", "topic", "key", "replay", F.get_json_object("value", "$.data.order_id").alias("order_id")
    )


@query("retry_schedule", statement(
    """SELECT 'S' || k AS saga_id, a::INTEGER AS attempt,
      CASE WHEN a < 5 THEN round(least(0.2::DOUBLE * pow(2, a - 1), 30.0::DOUBLE), 4) END AS delay_seconds,
      validated_at + to_microseconds(round(0.2::DOUBLE * (pow(2, a - 1) - 1) * 1000000)::BIGINT) AS attempt_at
    FROM steps, range(1, 6) t(a)""", "steps"))
def retry_schedule(spark, root):
    tasks = R.sagas(spark, root).select("saga_id", "created_at")
    return lifecycle.retry_schedule(tasks, "created_at").select(
        "saga_id", "attempt", F.round("delay_seconds", 4).alias("delay_seconds"), "attempt_at"
    )


@query("outbox_backoff", statement(
    """SELECT 'out-' || k AS outbox_id, (k % 9)::INTEGER AS attempt_count, least(pow(2, k % 9), 60.0::DOUBLE) AS delay_seconds
    FROM facts WHERE k % 3 = 0""", "facts"))
def outbox_backoff(spark, root):
    waiting = R.outbox(spark, root).where("published_at is null")
    return waiting.select("outbox_id", "attempt_count", rules.outbox_delay(F.col("attempt_count")).alias("delay_seconds"))


@query("status_history", statement(
    f"""SELECT order_id, CASE WHEN i > 0 THEN ({_NAMES})[i] END AS from_status,
      CASE WHEN k % 31 = 0 AND i = 3 THEN 'SHIPPED' ELSE ({_NAMES})[i + 1] END AS to_status,
      created_at + to_minutes(i * 5) AS changed_at
    FROM facts, range(8) r(i) WHERE i <= k % 8 AND NOT (k % 43 = 0 AND i = 2)""", "facts"))
def status_history(spark, root):
    return lifecycle.ordered_history(R.status_history(spark, root))


@query("status_counters", statement(
    """SELECT 'sagas_' || lower(status) AS counter, count(*) AS n FROM sagas GROUP BY 1
    UNION ALL SELECT 'open_dead_letters', count(*) FILTER (WHERE k % 4 <> 1) FROM steps WHERE dead_at IS NOT NULL""",
    "steps", sagas=_SAGAS))
def status_counters(spark, root):
    return lifecycle.status_counters(R.sagas(spark, root), R.dead_letters(spark, root))


@query("due_outbox", statement(
    """SELECT 'out-' || k AS outbox_id, order_id AS aggregate_id, created_at FROM facts
    WHERE k % 3 = 0 AND (k % 6 <> 0 OR created_at + to_minutes(k % 90) <= TIMESTAMP '1999-01-01 00:00:00')
    ORDER BY created_at, outbox_id LIMIT 100""", "facts"))
def due_outbox(spark, root):
    """One relay batch: the limit of 100 is the relay's own."""
    now = F.lit("1999-01-01 00:00:00").cast("timestamp")
    return lifecycle.due_outbox(R.outbox(spark, root), now).select("outbox_id", "aggregate_id", "created_at")


@query("recent_sagas", statement(
    "SELECT saga_id, order_id, created_at FROM sagas WHERE status = 'FAILED' ORDER BY created_at DESC, saga_id",
    "steps", sagas=_SAGAS))
def recent_sagas(spark, root):
    return lifecycle.newest_first(R.sagas(spark, root), "created_at", "saga_id", "status = 'FAILED'").select(
        "saga_id", "order_id", "created_at"
    )


@query("open_dead_letters", statement(
    """SELECT 'dead-' || k AS dead_letter_id, dead_at AS last_failed_at FROM steps
    WHERE dead_at IS NOT NULL AND k % 4 <> 1 ORDER BY dead_at DESC, 1""", "steps"))
def open_dead_letters(spark, root):
    return lifecycle.newest_first(
        R.dead_letters(spark, root), "last_failed_at", "dead_letter_id", "replayed_at is null"
    ).select("dead_letter_id", "last_failed_at")
