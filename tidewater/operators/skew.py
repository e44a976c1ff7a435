"""Building blocks for ordered work on keys of which one may hold a large share of all rows.

A key with few rows is handled in one group. A key with many is cut into ordered segments by a range
shuffle that includes the ordering columns, and only one small row per (key, segment) is combined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

GROUP_BOUND = 1000  # rows one group may hold before its key is treated as hot


def split_by_size(df: DataFrame, keys: Sequence[str], bound: int = GROUP_BOUND) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most `bound` rows, and those of the others (None when there are none).

    There are at most rows/bound hot keys, so the join against them is left to the optimiser, which
    broadcasts only below its own size limit.
    """
    keys = list(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bound).select(*keys)
    if hot.isEmpty():
        return df, None
    hot = cut_lineage(hot)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None,
                store: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Adds `_seg`: ordered pieces of each key. Stored, so that the pieces stay the same when re-read."""
    if segments is None:
        segments = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(segments, *keys, *order)
    return store(ranged.withColumn("_seg", F.spark_partition_id()))


def _earlier_segments(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(segmented: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Exact inclusive running sum per key over a frame made by `in_segments`."""
    keys, order = list(keys), list(order)
    rows = segmented.withColumn("_value", value)
    totals = rows.groupBy(*keys, "_seg").agg(F.sum("_value").alias("_part"))
    before = totals.select(
        *keys, "_seg", F.coalesce(F.sum("_part").over(_earlier_segments(keys)), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(before, [*keys, "_seg"])
        .withColumn(out, F.col("_before") + F.sum("_value").over(local))
        .drop("_value", "_before")
    )


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str,
                   bound: int = GROUP_BOUND) -> DataFrame:
    """Value of `column` in the preceding row of the same key (null in the first)."""
    keys, order = list(keys), list(order)
    cold, hot = split_by_size(df, keys, bound)
    result = cold.withColumn(out, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return result
    rows = in_segments(hot, keys, order)
    position = F.struct(*order)
    ends = rows.groupBy(*keys, "_seg").agg(F.max_by(F.struct(F.col(column).alias("v")), position).alias("_end"))
    carried = ends.select(*keys, "_seg", F.last("_end").over(_earlier_segments(keys)).alias("_carried"))
    local = Window.partitionBy(*keys, "_seg").orderBy(*order)
    stitched = (
        rows.join(carried, [*keys, "_seg"])
        .withColumn("_first", F.row_number().over(local) == 1)
        .withColumn(out, F.when(F.col("_first"), F.col("_carried.v")).otherwise(F.lag(column).over(local)))
        .drop("_seg", "_carried", "_first")
    )
    return result.unionByName(stitched)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                    segments: int | None = None) -> DataFrame:
    """Interpolated quantiles per key, exact for any group size and any spread of values.

    Equal values are counted before the shuffle. The distinct values are cut into ordered segments by a range
    shuffle; the segments' counts tell which of them hold the wanted ranks, and only these are ranked.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull()).withColumn("v", F.col(value).cast("double"))
    whole = not keys
    if whole:  # all rows as one group, by a column of the data
        keys, known = ["_all"], known.withColumn("_all", F.pmod(F.hash("v"), F.lit(1)))
    counts = known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    placed = in_segments(counts, keys, ["v"], segments).withColumnRenamed("_seg", "b")
    upto = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        placed.groupBy(*keys, "b").agg(F.sum("n").alias("bn"))
        .withColumn("b_end", F.sum("bn").over(upto))
        .withColumn("total", F.sum("bn").over(Window.partitionBy(*keys)))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at"))
        for name, p in probabilities.items()
    ])
    ranks = F.explode(F.flatten(F.transform(wanted, lambda w: F.array(
        F.struct(w["name"].alias("name"), F.lit("low").alias("side"), F.floor(w["at"]).alias("rank"), w["at"].alias("at")),
        F.struct(w["name"].alias("name"), F.lit("high").alias("side"), F.ceil(w["at"]).alias("rank"), w["at"].alias("at")),
    ))))
    hits = (
        histogram.withColumn("w", ranks)
        .where((F.col("w.rank") < F.col("b_end")) & (F.col("w.rank") >= F.col("b_end") - F.col("bn")))
        .select(*keys, "b", (F.col("b_end") - F.col("bn")).alias("b_start"), "w")
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    needed = placed.join(hits.select(*keys, "b").distinct(), [*keys, "b"], "left_semi")
    ranked = needed.select(*keys, "b", "v", "n", F.sum("n").over(inside).alias("v_end"))
    chosen = ranked.join(hits, [*keys, "b"]).where(
        (F.col("w.rank") - F.col("b_start") < F.col("v_end"))
        & (F.col("w.rank") - F.col("b_start") >= F.col("v_end") - F.col("n"))
    )

    def side(name: str, which: str) -> Column:
        return F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == which), F.col("v")))

    def share(name: str) -> Column:
        return F.max(F.when(F.col("w.name") == name, F.col("w.at") - F.floor("w.at")))

    out = chosen.groupBy(*keys).agg(
        *[(side(n, "low") + (side(n, "high") - side(n, "low")) * share(n)).alias(n) for n in probabilities]
    )
    return out.drop("_all") if whole else out
