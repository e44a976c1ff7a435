"""Registry of runnable queries and, where plain SQL can state them, their reference statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import adopt

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}

# Table expressions shared by the reference statements; they restate sources/retail.py in SQL.
COMMON: dict[str, str] = {
    "facts": """
        SELECT o_orderkey AS k, 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id,
               'N' || (o_orderkey % 25) AS node_id, o_orderstatus AS status,
               o_orderdate + to_minutes(o_orderkey % 1440) AS created_at
        FROM orders""",
    "steps": """
        SELECT *,
               created_at + to_seconds(5) AS validated_at,
               created_at + to_seconds(10) AS requested_at,
               CASE WHEN k % 10 <> 0 THEN created_at + to_seconds(20) END AS reserved_at,
               CASE WHEN k % 10 = 0 THEN created_at + to_seconds(20) END AS rejected_at,
               CASE WHEN k % 10 <> 0 THEN created_at + to_seconds(30) END AS assigned_at,
               CASE WHEN k % 10 <> 0 AND k % 29 <> 0
                    THEN created_at + to_seconds(30) + to_hours(24 * (k % 4 + 1)) END AS promised_at,
               CASE WHEN k % 10 <> 0 AND k % 19 <> 0
                    THEN created_at + to_seconds(60) + to_hours(((k * 7) % 12) * 18) END AS shipped_at,
               CASE WHEN k % 10 = 0 OR k % 19 = 0 THEN created_at + to_seconds(90) END AS failed_at,
               CASE WHEN k % 23 = 0 AND status = 'P' THEN created_at + to_seconds(45) END AS cancelled_at,
               CASE WHEN k % 20 = 3 THEN created_at + to_seconds(25) END AS low_at,
               CASE WHEN k % 97 = 0 THEN created_at + to_seconds(120) END AS dead_at
        FROM facts""",
    "lines": """
        SELECT s.k, s.order_id, s.customer_id, s.node_id, s.created_at AS occurred_at,
               'P' || l_partkey AS sku, l_partkey AS part_no, l_quantity::BIGINT AS qty,
               p_retailprice AS unit_price, p_brand AS brand, l_extendedprice AS line_price
        FROM lineitem JOIN facts s ON l_orderkey = s.k JOIN part ON l_partkey = p_partkey""",
    "stock": """
        SELECT 'P' || p_partkey AS sku, 'N' || n_nationkey AS node_id,
               (p_partkey * 31 + n_nationkey * 17) % 90 AS available_qty,
               (p_partkey + n_nationkey) % 5 AS reserved_qty, 10 AS reorder_threshold, 1 AS version
        FROM part, nation WHERE (p_partkey + n_nationkey * 3) % 7 <> 0""",
    "nodes": """
        SELECT 'N' || n_nationkey AS node_id, (n_nationkey * 5 - 60)::DOUBLE AS latitude,
               (n_nationkey * 14 - 180)::DOUBLE AS longitude, n_nationkey * 10 + 100 AS capacity_per_day,
               (n_nationkey * 37) % 120 AS current_backlog, n_nationkey % 8 <> 7 AS active
        FROM nation""",
    "log": """
        SELECT event_id AS request_id, ts, user_id AS client, event_type AS scenario,
               value AS latency_ms, event_type = 'error' AS failed
        FROM events""",
}
NEEDS = {"steps": ("facts",), "lines": ("facts",)}


def statement(body: str, *uses: str, recursive: bool = False, **local: str) -> str:
    """`body` with the shared expressions it uses (and what those need) and local ones in front."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        ordered.setdefault(name, COMMON[name])

    for name in uses:
        add(name)
    ordered.update(local)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({text})" for name, text in ordered.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with its reference statement when there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(function)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return function(adopt(spark), root)

        QUERIES[name] = run
        if sql is not None:
            STATEMENTS[name] = sql
        return run

    return register
