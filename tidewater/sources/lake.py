"""Where the layers live, and how they are read as stream or as batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater import contracts as C


@dataclass(frozen=True)
class Lake:
    """Folders below one root. Every table has its own base folder, so that concurrent writers never
    share a staging area; data folders end in `date=<day>/batch=<writer and batch>`."""

    root: str

    def bronze(self, event_type: str) -> str:
        return f"{self.root}/bronze/event_type={event_type}"

    @property
    def bronze_all(self) -> str:
        return f"{self.root}/bronze"

    @property
    def bronze_rejects(self) -> str:
        return f"{self.root}/bronze_rejects"

    def silver(self, event_type: str) -> str:
        return f"{self.root}/silver/event_type={event_type}"

    def late(self, event_type: str) -> str:
        return f"{self.root}/late_events/event_type={event_type}"

    def rejects(self, event_type: str) -> str:
        return f"{self.root}/silver_rejects/event_type={event_type}"

    def gold(self, dataset: str) -> str:
        return f"{self.root}/gold/{dataset}"

    def staging(self, name: str) -> str:
        return f"{self.root}/backfill/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    @property
    def metrics(self) -> str:
        return f"{self.root}/batch-metrics"

    @property
    def reports(self) -> str:
        return f"{self.root}/dq-reports"


# --- bus records ------------------------------------------------------------------------------

def kafka_records(spark: SparkSession, servers: str, topics: Sequence[str] = C.EVENT_TYPES,
                  starting_offsets: str = "earliest") -> DataFrame:
    """The bus as a stream. Needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", "false")
        .load()
    )


def file_records(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same row shape from Parquet files, for replays and where there is no bus."""
    reader = spark.readStream.schema(C.RAW_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def publish(records: DataFrame, servers: str | None = None, path: str | None = None) -> None:
    """Send (topic, key, value) rows to the bus, or append them to files."""
    rows = records.select("topic", "key", "value")
    if servers:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    elif path:
        rows.write.mode("append").partitionBy("topic").parquet(path)
    else:
        raise ValueError("publish needs the servers of a bus or a path")


# --- layers -----------------------------------------------------------------------------------

def ensure_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """Create the folder of a table nothing was written to yet, so that a stream can start on it."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("batch", "string")


BACKFILL = "backfill-"


def _stream(spark: SparkSession, path: str, schema: StructType, event_type: str, files_per_trigger: int | None,
            backfilled: bool = True) -> DataFrame:
    ensure_table(spark, path, schema)
    reader = spark.readStream.schema(_with_batch(schema))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path)
    if not backfilled:
        rows = rows.where(~F.coalesce(F.col("batch").startswith(BACKFILL), F.lit(False)))
    return rows.drop("batch").withColumn("event_type", F.lit(event_type))


def bronze_stream(spark: SparkSession, lake: Lake, event_type: str, files_per_trigger: int | None = None) -> DataFrame:
    return _stream(spark, lake.bronze(event_type), C.bronze_type(), event_type, files_per_trigger)


def silver_stream(spark: SparkSession, lake: Lake, event_type: str, files_per_trigger: int | None = None,
                  backfilled: bool = True) -> DataFrame:
    """Silver rows of one type; `backfilled=False` leaves out what a backfill swapped in."""
    return _stream(spark, lake.silver(event_type), C.silver_type(event_type), event_type, files_per_trigger, backfilled)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table written by batches; a missing one reads as empty with the same columns."""
    try:
        return spark.read.schema(_with_batch(schema)).parquet(path).drop("batch")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _batch(spark: SparkSession, path: str, schema: StructType, event_type: str | None,
           first: date | None, last: date | None) -> DataFrame:
    """Rows between two days, both included."""
    df = read_or_empty(spark, path, schema)
    if event_type:
        df = df.withColumn("event_type", F.lit(event_type))
    if first:
        df = df.where(F.col("date") >= F.lit(first))
    if last:
        df = df.where(F.col("date") <= F.lit(last))
    return df


def bronze_batch(spark, lake: Lake, event_type: str, first: date | None = None, last: date | None = None) -> DataFrame:
    return _batch(spark, lake.bronze(event_type), C.bronze_type(), event_type, first, last)


def silver_batch(spark, lake: Lake, event_type: str, first: date | None = None, last: date | None = None) -> DataFrame:
    return _batch(spark, lake.silver(event_type), C.silver_type(event_type), event_type, first, last)


_LAYER_COLUMNS = "event_id string, ingested_at timestamp, date date"


def layer_for_day(spark: SparkSession, lake: Lake, layer: str, day: date) -> DataFrame:
    """What the quality checks need of one layer and day over all event types."""
    path = {"bronze": lake.bronze, "silver": lake.silver, "late": lake.late, "rejects": lake.rejects}[layer]
    schema = StructType.fromDDL(_LAYER_COLUMNS)
    return reduce(DataFrame.unionByName, [_batch(spark, path(t), schema, t, day, day) for t in C.EVENT_TYPES])


def partition_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per top-level folder below `path`; placeholders and bookkeeping files are left out.

    Only names and sizes are read, never contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    inner = F.expr("substring(path, locate(root, path) + length(root))")
    segment = F.element_at(F.split(F.ltrim(inner, F.lit("/")), "/"), 1)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    return (
        files.withColumn("root", F.lit(root))
        .select(segment.alias("segment"), "length")
        .where(~F.col("segment").isin(".keep", "_SUCCESS"))
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"))
    )


def file_inventory(table: DataFrame) -> DataFrame:
    """(file, bytes, rows, first_row, last_row, share) of every file of a Parquet table, from a scan of its rows'
    hidden metadata: what a file holds, not what its name says, and its share of the rows of an average file."""
    meta = F.col("_metadata")
    files = table.select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"), meta["row_index"].alias("at")) \
        .groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_row"), F.max("at").alias("last_row"))
    # One row per file.
    mean = files.agg(F.avg("rows").alias("mean")).first()["mean"]
    return files.withColumn("share", F.col("rows") / F.lit(mean))
