"""Rebuilding days of silver or gold, checking the result, and swapping it in."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import aggregates, assurance, refine
from tidewater.sources import lake as L
from tidewater.streaming.sinks import write_day_partitions


class RowCountMismatch(Exception):
    """Decisions made do not add up to the distinct events read."""


def check_range(first: date, last: date) -> list[date]:
    if last < first:
        raise ValueError(f"{first} is after {last}")
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def reprocess_silver(spark: SparkSession, lake: L.Lake, event_type: str, first: date, last: date,
                     *, apply: bool = False) -> dict[str, int]:
    """Bronze days to silver again. Decisions go to a side table and are counted against the distinct
    events before any output is made; without `apply` the live tables stay untouched."""
    days = check_range(first, last)
    run = uuid.uuid4().hex
    targets = {refine.ON_TIME: lake.silver, refine.LATE: lake.late, refine.REJECTED: lake.rejects}
    old = {route: day_entries(spark, target(event_type), days) for route, target in targets.items()}
    bronze = L.bronze_batch(spark, lake, event_type, first, last)
    side = lake.staging(f"silver/{event_type}/run={run}")
    refine.distinct_events(refine.candidates(bronze, event_type)).write.parquet(side)
    decided = spark.read.parquet(side)
    ids = bronze.groupBy("event_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found = {r["route"]: r["n"] for r in decided.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"bronze_distinct": ids, **{r: found.get(r, 0) for r in (refine.ON_TIME, refine.LATE, refine.REJECTED)}}
    if sum(found.values()) != ids:
        raise RowCountMismatch(f"{event_type} {first}..{last}: {counts}")
    for route, target in targets.items():
        rows = refine.destination(decided, route).drop("event_type")
        staged = lake.staging(f"silver_{route}/{event_type}/run={run}")
        rows.write.partitionBy("date").parquet(staged)
        if apply:
            swap_days(spark, spark.read.schema(rows.schema).parquet(staged), target(event_type), days, old[route])
    return counts


def reprocess_gold(spark: SparkSession, lake: L.Lake, dataset: str, first: date, last: date,
                   *, apply: bool = False) -> int:
    """A gold dataset of some days from silver again, by the same functions the stream uses.

    Joined datasets read their inputs from as many days before as the join reaches back, and a day after, as a
    window's day is that of its start; only rows of the wanted days are kept.
    """
    days = check_range(first, last)
    old = day_entries(spark, lake.gold(dataset), days)
    back = aggregates.DATASETS[dataset].lookback_days if dataset in aggregates.DATASETS else 0
    df = aggregates.build(
        dataset, lambda t: L.silver_batch(spark, lake, t, first - timedelta(days=back), last + timedelta(days=1))
    ).where(F.col("date").between(F.lit(first), F.lit(last)))
    side = lake.staging(f"gold/{dataset}/run={uuid.uuid4().hex}")
    df.write.partitionBy("date").parquet(side)
    rebuilt = spark.read.schema(df.schema).parquet(side)
    rows = rebuilt.count()
    if apply:
        swap_days(spark, rebuilt, lake.gold(dataset), days, old)
    return rows


def day_entries(spark: SparkSession, live: str, days: list[date]) -> list[str]:
    """What lies in the folders of these days now: names only, one per batch written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = []
    for day in days:
        folder = hadoop.Path(f"{live}/date={day}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(folder):
            found += [entry.getPath().toString() for entry in fs.listStatus(folder)]
    return found


def swap_days(spark: SparkSession, rebuilt: DataFrame, live: str, days: list[date], old: list[str]) -> None:
    """Replace the given days of a live table. `old` names what the rebuilt rows stand for (`day_entries`).

    The new files are written first and the old ones removed after, so a crash between the two leaves rows twice
    and never none; running it again repairs that. Only what is in `old`, listed before the source was read, is
    removed: a batch that a running stream adds meanwhile stays. Days without rebuilt rows end up empty.
    """
    label = f"{L.BACKFILL}{uuid.uuid4().hex[:8]}"
    wanted = F.col("date").isin(days)
    write_day_partitions(rebuilt.where(wanted), live, label)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in old:
        entry = hadoop.Path(name)
        entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(entry, True)


def quality_report(spark: SparkSession, lake: L.Lake, day: date, now=None) -> tuple[bool, DataFrame]:
    """Checks of one day, written as JSON under the day; the flag tells whether every check passed."""
    stacked = assurance.stack_layers(
        *[L.layer_for_day(spark, lake, layer, day) for layer in ("bronze", "silver", "rejects", "late")]
    )
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    results = assurance.checks(assurance.reconciliation(stacked), at).withColumn("date", F.lit(day))
    results.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(
        lake.reports
    )
    stored = spark.read.schema("name string, passed boolean, value double, threshold double, date date").json(
        lake.reports
    ).where(F.col("date") == F.lit(day))
    return assurance.overall(stored).first()["overall_passed"], stored
