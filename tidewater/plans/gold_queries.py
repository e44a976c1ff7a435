"""Business aggregates over the event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import contracts as C
from tidewater.operators import aggregates as A
from tidewater.operators import intake, refine
from tidewater.plans.registry import query, statement
from tidewater.sources import retail as R

_WINDOW = """date_trunc('{unit}', {at}) AS window_start,
    date_trunc('{unit}', {at}) + INTERVAL 1 {unit} AS window_end, date_trunc('{unit}', {at})::DATE AS date"""


def _window(unit: str, at: str) -> str:
    return _WINDOW.format(unit=unit, at=at)


@query("orders_per_minute", statement(
    f"SELECT {_window('minute', 'created_at')}, count(*) AS order_count FROM steps GROUP BY ALL", "steps"))
def orders_per_minute(spark, root):
    return A.orders_per_minute(R.happened(R.order_facts(spark, root), "created_at"))


@query("revenue_by_product_location", statement(
    f"""SELECT {_window('hour', 's.shipped_at')}, l.sku, s.node_id, round(sum(l.qty * l.unit_price), 4) AS revenue
    FROM lines l JOIN steps s ON l.order_id = s.order_id
    WHERE s.shipped_at >= l.occurred_at AND s.shipped_at <= l.occurred_at + INTERVAL 7 DAY GROUP BY ALL""",
    "steps", "lines"))
def revenue_by_product_location(spark, root):
    lines = R.order_lines(spark, root)
    shipped = R.happened(R.order_facts(spark, root), "shipped_at", "node_id")
    return A.revenue_by_product_location(lines, shipped).withColumn("revenue", F.round("revenue", 4))


@query("fulfillment_success_rate", statement(
    f"""SELECT {_window('hour', 'ts')}, count(*) FILTER (WHERE ok) AS shipped_count, count(*) FILTER (WHERE NOT ok) AS failed_count,
      round(count(*) FILTER (WHERE ok) / greatest(count(*), 1), 4) AS success_rate
    FROM (SELECT shipped_at AS ts, true AS ok FROM steps WHERE shipped_at IS NOT NULL
          UNION ALL SELECT failed_at, false FROM steps WHERE failed_at IS NOT NULL) GROUP BY ALL""", "steps"))
def fulfillment_success_rate(spark, root):
    facts = R.order_facts(spark, root)
    rates = A.fulfillment_success_rate(R.happened(facts, "shipped_at"), R.happened(facts, "failed_at"))
    return rates.withColumn("success_rate", F.round("success_rate", 4))


@query("fulfillment_latency", statement(
    f"""SELECT {_window('hour', 'shipped_at')}, round(avg(epoch(shipped_at) - epoch(created_at)), 4)
      AS avg_latency_seconds, count(*) AS sample_count FROM steps
    WHERE shipped_at >= created_at AND shipped_at <= created_at + INTERVAL 7 DAY GROUP BY ALL""", "steps"))
def fulfillment_latency(spark, root):
    facts = R.order_facts(spark, root)
    latency = A.fulfillment_latency(R.happened(facts, "created_at"), R.happened(facts, "shipped_at"))
    return latency.withColumn("avg_latency_seconds", F.round("avg_latency_seconds", 4))


@query("inventory_reservation_failure_rate", statement(
    f"""SELECT {_window('hour', 'ts')}, count(*) FILTER (WHERE ok) AS reserved_count,
      count(*) FILTER (WHERE NOT ok) AS rejected_count,
      round(count(*) FILTER (WHERE NOT ok) / greatest(count(*), 1), 4) AS failure_rate
    FROM (SELECT reserved_at AS ts, true AS ok FROM steps WHERE reserved_at IS NOT NULL
          UNION ALL SELECT rejected_at, false FROM steps WHERE rejected_at IS NOT NULL) GROUP BY ALL""", "steps"))
def inventory_reservation_failure_rate(spark, root):
    facts = R.order_facts(spark, root)
    rates = A.inventory_reservation_failure_rate(R.happened(facts, "reserved_at"), R.happened(facts, "rejected_at"))
    return rates.withColumn("failure_rate", F.round("failure_rate", 4))


@query("stockout_frequency", statement(
    f"""SELECT {_window('hour', 's.rejected_at')}, 'P' || l_partkey AS sku, count(*) AS stockout_count
    FROM lineitem JOIN steps s ON l_orderkey = s.k WHERE s.rejected_at IS NOT NULL GROUP BY ALL""", "steps"))
def stockout_frequency(spark, root):
    return A.stockout_frequency(R.rejection_reasons(spark, root))


@query("late_order_rate", statement(
    f"""SELECT {_window('hour', 'shipped_at')}, count(*) AS total_count,
      count(*) FILTER (WHERE shipped_at > promised_at) AS late_count,
      round(count(*) FILTER (WHERE shipped_at > promised_at) / greatest(count(*), 1), 4) AS late_rate
    FROM steps WHERE shipped_at >= assigned_at AND shipped_at <= assigned_at + INTERVAL 7 DAY GROUP BY ALL""",
    "steps"))
def late_order_rate(spark, root):
    facts = R.order_facts(spark, root)
    assigned = R.happened(facts, "assigned_at", "promised_at as estimated_ship_date")
    return A.late_order_rate(R.happened(facts, "shipped_at"), assigned).withColumn("late_rate", F.round("late_rate", 4))


@query("product_demand_by_window", statement(
    """SELECT time_bucket(INTERVAL '15 minutes', occurred_at) AS window_start,
      time_bucket(INTERVAL '15 minutes', occurred_at) + INTERVAL 15 MINUTE AS window_end,
      time_bucket(INTERVAL '15 minutes', occurred_at)::DATE AS date, sku, sum(qty)::BIGINT AS qty_demanded
    FROM lines GROUP BY ALL""", "lines"))
def product_demand_by_window(spark, root):
    return A.product_demand_by_window(R.order_lines(spark, root))


@query("dead_letter_volume", statement(
    f"""SELECT {_window('hour', 'dead_at')},
      CASE k % 3 WHEN 0 THEN 'order.created' WHEN 1 THEN 'order.validated' ELSE 'order.shipped' END
        AS original_event_type,
      CASE k % 2 WHEN 0 THEN 'order-validator' ELSE 'fulfillment-orchestrator' END AS failed_consumer,
      count(*) AS dead_letter_count
    FROM steps WHERE dead_at IS NOT NULL GROUP BY ALL""", "steps"))
def dead_letter_volume(spark, root):
    return A.dead_letter_volume(R.dead_letters(spark, root))


_LAG = """SELECT created_at AS polled_at,
      CASE k % 2 WHEN 0 THEN 'order-validator' ELSE 'fulfillment-orchestrator' END AS consumer_group,
      CASE k % 3 WHEN 0 THEN 'order.created' ELSE 'order.validated' END AS topic,
      (k % 6)::INTEGER AS partition,
      CASE WHEN k % 17 = 0 THEN k % 5 ELSE k * 3 END AS committed_offset,
      k * 3 + k % 13 - 2 AS latest_offset,
      greatest(k * 3 + k % 13 - 2 - CASE WHEN k % 17 = 0 THEN k % 5 ELSE k * 3 END, 0) AS lag,
      created_at::DATE AS date FROM facts"""


@query("consumer_lag", statement(_LAG, "facts"))
def consumer_lag(spark, root):
    return A.consumer_lag(R.offsets(spark, root))


@query("max_lag_by_topic", statement(
    "SELECT topic, consumer_group, max(lag) AS max_lag FROM lags GROUP BY ALL", "facts", lags=_LAG))
def max_lag_by_topic(spark, root):
    return A.max_lag(A.consumer_lag(R.offsets(spark, root)))


@query("lakehouse_orders_per_minute", statement(
    f"""SELECT {_window('minute', 'created_at')}, count(*) AS order_count FROM facts
    WHERE k % 350 <> 7 AND k % 50 <> 1 AND k % 450 <> 2 AND k % 213 <> 0 AND k % 211 <> 0 AND k % 229 <> 0
      AND k % 223 <> 0 AND k % 227 <> 0 AND (k % 125) * 5 <= 600
    GROUP BY ALL""", "facts"))
def lakehouse_orders_per_minute(spark, root):
    """All three layers end to end: bus records, bronze rows, deduplicated on-time silver rows, aggregate."""
    raw = R.raw_records(spark, root, C.ORDER_CREATED)
    bronze = intake.bronze_rows(intake.inspect_records(raw), F.col("timestamp"))
    routed = refine.distinct_events(refine.candidates(bronze, C.ORDER_CREATED))
    return A.orders_per_minute(refine.destination(routed, refine.ON_TIME))


@query("top_products", statement(
    """SELECT sku, round(sum(qty * unit_price), 4) AS revenue, sum(qty)::BIGINT AS qty_sold
    FROM lines GROUP BY sku ORDER BY revenue DESC, sku LIMIT 10""", "lines"))
def top_products(spark, root):
    """The chart of best sellers: a top-10 report, hence the limit."""
    sales = R.order_lines(spark, root).groupBy("sku").agg(
        F.round(F.sum(F.col("qty") * F.col("unit_price")), 4).alias("revenue"), F.sum("qty").alias("qty_sold")
    )
    return sales.orderBy(F.desc("revenue"), "sku").limit(10)


@query("top_stockouts", statement(
    """SELECT 'P' || l_partkey AS sku, count(*) AS stockout_count FROM lineitem JOIN steps s ON l_orderkey = s.k
    WHERE s.rejected_at IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "steps"))
def top_stockouts(spark, root):
    """The chart of products most often out of stock: a top-10 report, hence the limit."""
    counts = R.rejection_reasons(spark, root).groupBy("sku").agg(F.count(F.lit(1)).alias("stockout_count"))
    return counts.orderBy(F.desc("stockout_count"), "sku").limit(10)
