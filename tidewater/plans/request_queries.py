"""Access-log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import requests as Q
from tidewater.plans.registry import query, statement
from tidewater.session import scratch_path
from tidewater.sources import retail as R

# The log is thin, so the limit is tried over days instead of minutes.
WINDOW_SECONDS = 86_400
LIMIT = 3


@query("request_rate", statement(
    """SELECT scenario, time_bucket(INTERVAL '30 seconds', ts) - to_seconds(30 * b) AS window_start,
      round(count(*) / 300, 4) AS requests_per_second FROM log, range(10) r(b) GROUP BY ALL""", "log"))
def request_rate(spark, root):
    return Q.request_rate(R.request_log(spark, root)).withColumn(
        "requests_per_second", F.round("requests_per_second", 4)
    )


@query("latency_p95", statement(
    """SELECT scenario, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM log GROUP BY 1
    UNION ALL SELECT 'all', round(quantile_cont(latency_ms, 0.95), 4) FROM log""", "log"))
def latency_p95(spark, root):
    return Q.latency_p95(R.request_log(spark, root)).withColumn("p95", F.round("p95", 4))


@query("counters_by_label", statement(
    "SELECT scenario, failed, count(*) AS n FROM log GROUP BY ALL", "log"))
def counters_by_label(spark, root):
    return Q.counters(R.request_log(spark, root), "scenario", "failed")


@query("latency_summary", statement(
    """SELECT scenario, round(avg(latency_ms), 4) AS avg, min(latency_ms) AS min,
      round(quantile_cont(latency_ms, 0.5), 4) AS med, round(quantile_cont(latency_ms, 0.9), 4) AS p90,
      round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99,
      max(latency_ms) AS max FROM log GROUP BY scenario""", "log"))
def latency_summary(spark, root):
    rounded = {name: F.round(name, 4) for name in ("avg", *Q.TREND)}
    return Q.latency_summary(R.request_log(spark, root)).withColumns(rounded)


@query("failure_rate", statement(
    """SELECT scenario, count(*) AS requests, round(avg(failed::INTEGER), 4) AS failure_rate,
      round(1 - avg(failed::INTEGER), 4) AS success_rate,
      round(avg(latency_ms) FILTER (WHERE NOT failed), 4) AS avg_success_ms FROM log GROUP BY scenario""", "log"))
def failure_rate(spark, root):
    return Q.failure_rate(R.request_log(spark, root)).withColumns(
        {name: F.round(name, 4) for name in ("failure_rate", "success_rate", "avg_success_ms")}
    )


@query("threshold_report", statement(
    """SELECT scenario, 'failure_rate<0.01' AS threshold, round(rate, 4) AS value, rate < 0.01 AS passed FROM m
    UNION ALL SELECT scenario, 'p95<1500', round(p95, 4), p95 < 1500 FROM m
    UNION ALL SELECT scenario, 'requests>100', n::DOUBLE, n > 100 FROM m""", "log",
    m="""SELECT scenario, avg(failed::INTEGER) AS rate, quantile_cont(latency_ms, 0.95) AS p95, count(*) AS n
        FROM log GROUP BY scenario"""))
def threshold_report(spark, root):
    return Q.threshold_report(R.request_log(spark, root)).withColumn("value", F.round("value", 4))


@query("route_groups", r"""
    SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[0-9]+(/|\.|$)', '/{id}\1', 'g') AS route,
      count(*) AS requests FROM pages GROUP BY 1""")
def route_groups(spark, root):
    return Q.route_groups(R.page_paths(spark, root))


@query("client_window_hits", statement(
    f"""SELECT request_id, client, ts, count(*) OVER (PARTITION BY client ORDER BY ts
      RANGE BETWEEN INTERVAL {WINDOW_SECONDS} SECOND PRECEDING AND CURRENT ROW) AS hits FROM log""", "log"))
def client_window_hits(spark, root):
    return Q.window_hits(R.request_log(spark, root), WINDOW_SECONDS)


@query("rate_limit_replay", statement(
    "SELECT request_id, client, ts, admitted FROM walk", "log", recursive=True,
    numbered="SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS n FROM log",
    walk=f"""SELECT request_id, client, ts, n, true AS admitted, [ts] AS recent FROM numbered WHERE n = 1
        UNION ALL
        SELECT request_id, client, ts, n, len(kept) < {LIMIT},
          CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, ts) ELSE kept END
        FROM (SELECT r.request_id, r.client, r.ts, r.n,
            list_filter(w.recent, lambda x: x >= r.ts - INTERVAL {WINDOW_SECONDS} SECOND) AS kept
          FROM walk w JOIN numbered r ON r.client = w.client AND r.n = w.n + 1)"""))
def rate_limit_replay(spark, root):
    return Q.rate_limit(R.request_log(spark, root), LIMIT, WINDOW_SECONDS)


@query("latency_by_slices", statement(
    f"""SELECT scenario, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM log,
      (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY AS first, date_trunc('day', max(ts)) - INTERVAL 2 DAY AS last FROM log)
    WHERE ts >= first AND ts < last GROUP BY scenario""", "log"))
def latency_by_slices(spark, root):
    """Quantiles of a range of days from stored hourly sketches, and whether each lies within the stated rank error
    when it is held against the log itself: the share of requests below it, and of those not above it."""
    log = R.request_log(spark, root)
    # One row: the range.
    first, end = log.selectExpr("date_trunc('day', min(ts)) + interval 3 days", "date_trunc('day', max(ts)) - interval 2 days").first()
    path = scratch_path(spark, "latency-slices")
    Q.latency_slices(log).write.parquet(path)
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    asked = Q.latency_of_range(spark.read.parquet(path), F.lit(first), F.lit(end), wanted)
    held = log.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(end))).join(asked, "scenario")
    below = {name: F.avg((F.col("latency_ms") < F.col(name)).cast("double")) for name in wanted}
    upto = {name: F.avg((F.col("latency_ms") <= F.col(name)).cast("double")) for name in wanted}
    return held.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"),
        *(((below[name] <= p + Q.SKETCH_ERROR) & (upto[name] >= p - Q.SKETCH_ERROR) & (F.first("n") == F.count(F.lit(1))))
          .alias(f"{name}_within") for name, p in wanted.items()))
