from datetime import timedelta

import pytest

from samples import BASE, rows
from tidewater.operators import aggregates as A
from tidewater.operators import assurance

T = BASE
ITEMS = "items array<struct<sku string, qty bigint, unit_price double>>".replace(" string", ": string").replace(
    " bigint", ": bigint").replace(" double", ": double")


def created(spark, *data):
    return spark.createDataFrame(list(data), f"order_id string, occurred_at timestamp, {ITEMS}")


def events(spark, *data, extra=""):
    return spark.createDataFrame(list(data), f"order_id string, occurred_at timestamp{extra}")


def test_orders_per_minute(spark):
    df = events(spark, ("a", T), ("b", T + timedelta(seconds=10)), ("c", T + timedelta(minutes=5)))
    assert rows(A.orders_per_minute(df), "window_start", "order_count") == [(T, 2), (T + timedelta(minutes=5), 1)]


def test_revenue_counts_shipments_up_to_seven_days(spark):
    one = [("S1", 2, 10.0)]
    week = timedelta(days=7)
    orders = created(spark, ("a", T, one), ("b", T, one), ("c", T, None), ("d", T, []))
    shipped = events(spark, ("a", T + week, "n1"), ("b", T + week + timedelta(seconds=1), "n1"), ("c", T, "n1"),
                     extra=", node_id string")
    assert rows(A.DATASETS["revenue_by_product_location"].build(orders, shipped), "sku", "node_id", "revenue") == [
        ("S1", "n1", 20.0)]


def test_rates(spark):
    ok, bad = events(spark, ("a", T), ("b", T), ("c", T)), events(spark, ("d", T))
    assert rows(A.fulfillment_success_rate(ok, bad), "shipped_count", "failed_count", "success_rate") == [(3, 1, 0.75)]
    failures = A.inventory_reservation_failure_rate(events(spark, ("a", T)), events(spark, ("b", T), ("c", T)))
    assert failures.first()["failure_rate"] == pytest.approx(2 / 3)


def test_latency_and_late_rate(spark):
    half = timedelta(minutes=30)
    latency = A.fulfillment_latency(events(spark, ("a", T)), events(spark, ("a", T + half)))
    assert rows(latency, "avg_latency_seconds", "sample_count") == [(1800.0, 1)]
    assigned = events(spark, ("a", T, "2026-07-01T12:10:00Z"), ("b", T, "2026-07-02T12:00:00Z"), ("c", T, None),
                      extra=", estimated_ship_date string")
    shipped = events(spark, ("a", T + half), ("b", T + half), ("c", T + half))
    assert rows(A.late_order_rate(shipped, assigned), "total_count", "late_count") == [(3, 1)]


def test_demand_stockouts_and_dead_letters(spark):
    orders = created(spark, ("a", T, [("S1", 2, 1.0)]), ("b", T, [("S1", 3, 1.0)]))
    assert rows(A.DATASETS["product_demand_by_window"].build(orders), "sku", "qty_demanded") == [("S1", 5)]
    rejected = spark.createDataFrame(
        [("a", T, [("S1", 1, 0), ("S2", 1, 0)]), ("b", T, [("S1", 1, 0)])],
        "order_id string, occurred_at timestamp, reasons array<struct<sku: string, requested_qty: bigint, available_qty: bigint>>")
    assert rows(A.DATASETS["stockout_frequency"].build(rejected), "sku", "stockout_count") == [("S1", 2), ("S2", 1)]
    dead = spark.createDataFrame([('{"event_type":"order.created"}', "x", T)] * 2,
                                 "original_event string, failed_consumer string, occurred_at timestamp")
    assert rows(A.dead_letter_volume(dead), "original_event_type", "dead_letter_count") == [("order.created", 2)]


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        A.build("nope", None)
    assert len(A.DATASETS) == 9


def layer(spark, *ids, at=None):
    return spark.createDataFrame([(t, i, at) for t, i in ids], "event_type string, event_id string, ingested_at timestamp")


def checks(spark, bronze, silver, rejects=(), late=(), at=BASE):
    stacked = assurance.stack_layers(layer(spark, *bronze, at=at), layer(spark, *silver), layer(spark, *rejects),
                                     layer(spark, *late))
    results = assurance.checks(assurance.reconciliation(stacked), BASE + timedelta(minutes=30))
    return {r["name"]: (r["passed"], r["value"]) for r in results.collect()}


def test_quality_checks(spark):
    good = checks(spark, [("t", "1"), ("t", "1"), ("t", "2"), ("t", None)], [("t", "1")], [("t", None)], [("t", "2")])
    assert good["bronze_silver_reconciliation"] == (True, 0.0)
    assert good["duplicate_rate"] == (True, 0.25)
    assert good["schema_rejection_rate"] == (False, 0.5) and good["late_event_rate"] == (False, 0.5)
    assert good["freshness"] == (True, 30.0)
    assert checks(spark, [("t", "1"), ("t", "2")], [("t", "1")])["bronze_silver_reconciliation"] == (False, 1.0)


def test_opposite_differences_do_not_cancel(spark):
    got = checks(spark, [("a", "1"), ("a", "2"), ("b", "3")], [("a", "1"), ("b", "3"), ("b", "4")])
    assert got["bronze_silver_reconciliation"] == (False, 0.0)


def test_no_data_is_not_fresh(spark):
    got = checks(spark, [], [])
    assert len(got) == 5 and got["freshness"] == (False, None) and got["bronze_silver_reconciliation"][0]
