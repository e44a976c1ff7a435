"""Shards cut from a Hilbert curve over several metadata columns, so that a filter on any of them skips files.

Each column is quantised to cells of about equal counts, the cells of a row are one point of a grid, and rows are
ordered by the point's index on the Hilbert curve. Consecutive runs of that order are the shards: neighbours on
the curve are neighbours in every dimension, so each file has narrow ranges of all columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import keep, prepare, read

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 8
SHARDS = 16


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell coordinates (rows x dimensions), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        flip ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << one) | ((x[i] >> np.uint64(level)) & one)
    return index


def _measure(name: str, kind: str) -> Column:
    """A column as a double that keeps its order; text by its first seven bytes."""
    if kind in ("string", "binary"):
        head = F.rpad(F.substring(F.col(name).cast("binary"), 1, 7), 7, F.lit(b"\x00"))
        return F.conv(F.hex(head), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def curve(table: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """The table with its curve index as `_curve`.

    Cells are bounded by quantiles of all rows (a mergeable sketch of fixed size), so a column's popular values take
    cells of their own. Null and not-a-number values share the lowest cell.
    """
    if not dimensions or len(dimensions) * bits > 63:
        raise ValueError("the curve index must fit 63 bits")
    prepare(table.sparkSession)
    kinds = dict(table.dtypes)
    measures = [F.nanvl(_measure(d, kinds[d]), F.lit(None)).alias(f"_m{i}") for i, d in enumerate(dimensions)]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = table.select(*measures).agg(
        *(F.percentile_approx(f"_m{i}", steps, 20_000).alias(f"q{i}") for i in range(len(dimensions)))).first()
    cuts = [np.unique(np.array(q if q is not None else [], dtype=float)) for q in found]

    @F.pandas_udf("long")
    def index_of(columns: pd.DataFrame) -> pd.Series:
        cells = np.zeros((len(columns), len(cuts)), np.int64)
        for i, edges in enumerate(cuts):
            values = columns.iloc[:, i].to_numpy(dtype=float)
            known = ~np.isnan(values)
            cells[known, i] = np.searchsorted(edges, values[known], side="right")
        return pd.Series(curve_index(np.minimum(cells, (1 << bits) - 1), bits).astype(np.int64))

    return table.withColumn("_curve", index_of(F.struct(*measures)))


def shards(table: DataFrame, key: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS,
           bits: int = BITS, payload: tuple[str, ...] = ()) -> DataFrame:
    """(key, payload..., curve, shard, slot): every row's place; shard sizes differ by one row at most.

    Rows are ordered by (curve index, key, payload), so equal points are split where the count demands it and the
    order is the same at each run; only these narrow columns are shuffled. Slots are gapless from 0 in each shard.
    An empty table gives no rows; a null key sorts first; repeated rows each get a slot of their own. The
    dimensions, key and payload are read, other columns are not.
    """
    spark = table.sparkSession
    indexed = curve(table, dimensions, bits).select(F.col(key), *payload, F.col("_curve").alias("curve"))
    order = ["curve", key, *payload]
    sorted_rows = indexed.repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("_id", F.monotonically_increasing_id())
    placed = keep(sorted_rows, "curve-order").withColumn("_part", F.shiftright("_id", 33)) \
        .withColumn("_local", F.col("_id").bitwiseAND((1 << 33) - 1))
    # One row per partition of the sorted rows.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
                          F.sum("_n").over(Window.partitionBy()).alias("_total"))
    at = placed.join(bases, "_part").withColumn("_at", F.col("_base") + F.col("_local"))
    return at.withColumn("shard", F.expr(f"cast(_at * {shards} div _total as int)")) \
        .withColumn("slot", F.expr(f"_at - (shard * _total + {shards - 1}) div {shards}")) \
        .select(key, *payload, "curve", "shard", "slot")


def write_shards(table: DataFrame, key: str, folder: str, **options) -> None:
    """Write whole rows as one folder per shard, in curve order; `key` must be unique. Readers prune by file statistics."""
    places = shards(table, key, **options).select(F.col(key).alias("_key"), F.col("shard"), F.col("slot"))
    rows = table.join(places, F.col(key) == F.col("_key")).drop("_key")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot") \
        .write.partitionBy("shard").parquet(folder)


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by row count along the curve over language, source and length."""
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", *DIMENSIONS, (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"))
    return shards(light, "doc_id", payload=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
