"""Request-log reports and the per-client sliding-window limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidewater import contracts as C
from tidewater.operators import skew

TREND = {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def request_rate(log: DataFrame, window_seconds: int = 300, step_seconds: int = 30) -> DataFrame:
    """Requests per second by scenario over sliding windows.

    Requests are counted per step first, so only the counts are repeated for the windows they fall in.
    """
    steps = window_seconds // step_seconds
    counted = log.groupBy("scenario", F.window("ts", f"{step_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        counted.selectExpr("scenario", "n", "w.start as slot", f"explode(sequence(0, {steps - 1})) as back")
        .selectExpr("scenario", "n", f"slot - make_dt_interval(0, 0, 0, back * {step_seconds}) as window_start")
        .groupBy("scenario", "window_start")
        .agg((F.sum("n") / window_seconds).alias("requests_per_second"))
    )


def latency_p95(log: DataFrame) -> DataFrame:
    """95th percentile by scenario and over all."""
    by_scenario = skew.exact_quantiles(log, ["scenario"], "latency_ms", {"p95": 0.95})
    overall = skew.exact_quantiles(log, [], "latency_ms", {"p95": 0.95})
    return by_scenario.unionByName(overall.select(F.lit("all").alias("scenario"), "p95"))


def counters(log: DataFrame, *labels: str) -> DataFrame:
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(log: DataFrame) -> DataFrame:
    """The usual trend statistics per scenario."""
    plain = log.groupBy("scenario").agg(
        F.avg("latency_ms").alias("avg"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max")
    )
    return plain.join(skew.exact_quantiles(log, ["scenario"], "latency_ms", TREND), "scenario")


SKETCH_SIZE = 800  # rank error of about 0.004; `SKETCH_ERROR` is five times that
SKETCH_ERROR = 0.02


def latency_slices(log: DataFrame, length: str = "1 hour") -> DataFrame:
    """(scenario, slice_start, slice_end, n, sketch): a mergeable quantile sketch per scenario and slice of time.

    To be stored: a slice costs a few kilobytes however many requests it saw, and any range of slices can be asked
    later without the log. Requests without a time or a latency are left out.
    """
    return log.where("ts is not null and latency_ms is not null").groupBy("scenario", F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"),
    ).select("scenario", F.col("w.start").alias("slice_start"), F.col("w.end").alias("slice_end"), "n", "sketch")


def latency_of_range(slices: DataFrame, first: Column, end: Column, probabilities: dict[str, float]) -> DataFrame:
    """(scenario, n, one column per probability) over the slices that lie in [first, end): quantiles whose rank is off
    by at most SKETCH_ERROR of all requests, but for one case in many thousands."""
    inside = slices.where((F.col("slice_start") >= first) & (F.col("slice_end") <= end))
    merged = inside.groupBy("scenario").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("s"))
    return merged.select("scenario", "n", *(F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(name)
                                           for name, p in probabilities.items()))


def failure_rate(log: DataFrame) -> DataFrame:
    failed = F.col("failed").cast("double")
    return log.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(failed).alias("failure_rate"),
        (1 - F.avg(failed)).alias("success_rate"),
        F.avg(F.when(~F.col("failed"), F.col("latency_ms"))).alias("avg_success_ms"),
    )


# Limits a load run must keep: metric, comparison, bound.
THRESHOLDS = (("failure_rate", "<", 0.01), ("p95", "<", 1500.0), ("requests", ">", 100.0))


def threshold_report(log: DataFrame, limits: tuple[tuple[str, str, float], ...] = THRESHOLDS) -> DataFrame:
    """Every limit against every scenario's measured value."""
    measured = failure_rate(log).select("scenario", "failure_rate", "requests").join(
        skew.exact_quantiles(log, ["scenario"], "latency_ms", {"p95": 0.95}), "scenario"
    )
    verdicts = []
    for metric, comparison, bound in limits:
        value = F.col(metric).cast("double")
        kept = value < bound if comparison == "<" else value > bound
        verdicts.append(F.struct(
            F.lit(f"{metric}{comparison}{bound:g}").alias("threshold"), value.alias("value"), kept.alias("passed")
        ))
    return measured.select("scenario", F.inline(F.array(*verdicts)))


def route_template(path: Column) -> Column:
    """Address with its ids replaced, so that requests to one route count together.

    UUIDs and runs of digits standing alone in a path segment are ids; query and fragment are dropped.
    """
    bare = F.regexp_replace(path, r"[?#].*$", "")
    no_uuid = F.regexp_replace(
        bare, r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?=/|$)", "/{id}"
    )
    return F.regexp_replace(no_uuid, r"/[0-9]+(?=/|\.|$)", "/{id}")


def route_groups(pages: DataFrame) -> DataFrame:
    return pages.groupBy(route_template(F.col("path")).alias("route")).agg(F.count(F.lit(1)).alias("requests"))


def nearby(hits: DataFrame, seconds: int, counted: Column, out: str, *, ahead: bool = False) -> DataFrame:
    """Number of a client's `counted` hits within `seconds` before (or after) each hit, itself included.

    Time is cut into slices as long as the window and each hit is also handed to the neighbouring slice,
    so a group is one client's two slices, however many hits the client has.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros("ts")
    slices = hits.withColumn("_at", at).withColumn("_mine", F.floor(F.col("_at") / micros)).withColumn(
        "_slice", F.explode(F.array(F.col("_mine"), F.col("_mine") + (-1 if ahead else 1)))
    )
    frame = Window.partitionBy("client", "_slice").orderBy("_at")
    frame = frame.rangeBetween(0, micros) if ahead else frame.rangeBetween(-micros, 0)
    return (
        slices.withColumn(out, F.count_if(counted).over(frame))
        .where(F.col("_slice") == F.col("_mine"))
        .drop("_at", "_mine", "_slice")
    )


def window_hits(log: DataFrame, seconds: int = C.RATE_LIMIT_SECONDS) -> DataFrame:
    """Hits of the same client in the window ending at each hit; one exactly that old still counts."""
    return nearby(log.select("request_id", "client", "ts"), seconds, F.lit(True), "hits")


def admission(seconds: int, limit: int):
    """Admission over rows sorted by client and time; keeps no more than `limit` times of one client.

    Returned as an inner function, which travels to the workers whole: they need not have this package.
    """
    span = seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, admitted = None, deque()
        for batch in batches:
            verdicts = []
            for who, at in zip(batch["client"], batch["at"]):
                if who != client:
                    client, admitted = who, deque()
                while admitted and at - admitted[0] > span:
                    admitted.popleft()
                verdicts.append(len(admitted) < limit)
                if verdicts[-1]:
                    admitted.append(at)
            yield batch.assign(admitted=verdicts)

    return walk


def rate_limit(log: DataFrame, limit: int = C.RATE_LIMIT_HITS, seconds: int = C.RATE_LIMIT_SECONDS) -> DataFrame:
    """Admits or rejects each hit; rejected hits do not count towards the limit.

    A hit with no more than `limit` hits in its window is admitted whatever came before, which settles
    all traffic that keeps to the limit without any order. Only clients' overloaded stretches, with the
    hits of one window before them, are walked through in time order. That walk streams over sorted
    partitions and holds `limit` times per client. Inside a stretch each verdict depends on the one
    before, so a stretch is one sequence; separate stretches of a client are separate sequences.
    """
    hits = window_hits(log, seconds)
    over = F.col("hits") > limit
    watched = nearby(hits, seconds, over, "over_ahead", ahead=True)
    settled = watched.where(~over).select("request_id", "client", "ts", F.lit(True).alias("admitted"))
    involved = watched.where(F.col("over_ahead") > 0).select(
        "request_id", "client", "ts", F.unix_micros("ts").alias("at"), over.alias("over")
    )
    walked = _stretches(involved, seconds).repartition("client", "stretch").sortWithinPartitions(
        "client", "stretch", "at", "request_id"
    )
    keyed = walked.select(
        F.concat_ws("|", F.col("client").cast("string"), F.col("stretch").cast("string")).alias("client"),
        F.col("client").alias("original"), "request_id", "ts", "at", "over",
    )
    schema = StructType([*keyed.schema.fields, StructField("admitted", BooleanType())])
    decided = keyed.mapInPandas(admission(seconds, limit), schema)
    return settled.unionByName(
        decided.where("over").select("request_id", F.col("original").alias("client"), "ts", "admitted")
    )


def _stretches(involved: DataFrame, seconds: int) -> DataFrame:
    """Numbers the stretches of a client: a new one starts after a whole window without involved hits."""
    times = involved.groupBy("client", "ts").agg(F.count(F.lit(1)).alias("n"))
    fresh = nearby(times, seconds, F.lit(True), "close").withColumn("fresh", (F.col("close") == 1).cast("int"))
    cold, hot = skew.split_by_size(fresh.select("client", "ts", "fresh"), ["client"])
    numbered = cold.withColumn("stretch", F.sum("fresh").over(Window.partitionBy("client").orderBy("ts")))
    if hot is not None:
        segments = skew.in_segments(hot, ["client"], ["ts"])
        numbered = numbered.unionByName(
            skew.running_sum(segments, ["client"], ["ts"], F.col("fresh"), "stretch").drop("_seg")
        )
    return involved.join(numbered.select("client", "ts", "stretch"), ["client", "ts"])
