"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.scheduler.mode": "FAIR",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str,
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with this package's settings; memory, master and shuffle width are the deployment's."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ADOPTED = ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
           "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.streaming.stateStore.providerClass")


def adopt(spark: SparkSession) -> SparkSession:
    """Set on a session made elsewhere what results (UTC), hot keys (splitting of skewed joins) and keyed state with
    timers (a state store of several column families) rely on."""
    for key in ADOPTED:
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def by_shuffle(df: DataFrame) -> DataFrame:
    """For the side of a join that has a row per order, line or (sku, node), or comes from an explode. Spark's estimate
    knows neither the rows an explode makes nor what compressed columns hold in memory, and would collect tens of
    millions of rows in the driver to broadcast them; so both sides are shuffled whatever the estimate says."""
    return df.hint("merge")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """For work in steps that are each stored once: shuffle files go when the step's action ends. Otherwise they stay until
    the driver happens to collect its garbage, and those of all steps may lie on disk together."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach. One is made only where none is set and all work is in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-tidewater-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, for a stream's sink or checkpoint."""
    return f"{_shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables kept while a block runs and deleted at its end; what outlives the block must be kept outside of it. As Parquet
    they take a fraction of the disk of a checkpoint, whose rows are neither packed nor deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *failure) -> None:
        for path in self.paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table whose last reader has finished."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the reliable checkpoint folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    root = _shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
