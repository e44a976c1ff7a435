"""SimHash near-duplicates by deletion variants: three segments, one of which differs in at most one bit.

Two fingerprints that differ in at most four bits differ in at most one bit in some of three segments, so
they agree on that segment with one bit left out. Every fingerprint is listed under each of its 64
one-wildcard segment variants; equal variants meet in a join, and the full distance is verified there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, keep, prepare, read, slices
from tidewater.llm.graph import components
from tidewater.session import brief_shuffles, by_shuffle

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 where there is no word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = max(len(words) - shingle + 1, 1)
    starts = [0, *ends[:first - 1].tolist()]
    stops = (ends[len(ends) - first:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row: whole texts, a null text like an empty one."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values.view(np.int64))],
                                             names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, fp long")


def _variants(fp: str) -> Column:
    """The 64 keys of a fingerprint: the segment with one bit cleared, and above it which bit that was."""
    keys = [
        F.shiftrightunsigned(F.col(fp).bitwiseAND(F.lit(signed(((1 << width) - 1) << start & ~(1 << bit)))), start)
        .bitwiseOR(F.lit(bit << 22)).cast("int")
        for start, width in SEGMENTS for bit in range(start, start + width)
    ]
    return F.explode(F.array(*keys))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def links(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Enough of the links between distinct fingerprints (fp) that their components are exact: (a, b).

    First every member of a variant's bucket is held against the bucket's smallest one; a bucket of two is settled by
    that. In larger buckets, members known to be connected carry a common label. Each member without the bucket's
    most frequent label needs one link to those that have it, found by a semi-join, twice over; only members that
    still differ from it are held against each other. A bucket of near copies so yields a row per member, not its
    pairs.

    Spark's estimate of `listed` knows nothing of the 64 rows an explode makes of one and would send them all through the
    driver; the joins with a row per fingerprint or key are shuffled. Of the scratch tables, each with rows for most of the
    64 variants once buckets fill, only those of the present round lie on disk.
    """
    with Scratch(prints.sparkSession) as within, brief_shuffles(prints.sparkSession):
        return keep(_links(prints, most, within), "simhash-linked")


def _links(prints: DataFrame, most: int, within: Scratch) -> DataFrame:
    spark = prints.sparkSession
    listed = prints.select("fp", _variants("fp").alias("key"))
    with Scratch(spark) as first:
        reps = first.keep(listed.groupBy("key").agg(F.min("fp").alias("rep"), F.count("*").alias("n")).where("n > 1"),
                          "simhash-reps")
        star = listed.join(by_shuffle(reps.select("key", "rep")), "key").where(F.col("fp") != F.col("rep")) \
            .where(_near("fp", "rep", most))
        found = within.keep(star.select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct(), "simhash-star")
        crowded = within.keep(listed.join(by_shuffle(reps.where("n > 2").select("key")), "key", "left_semi"), "simhash-crowded")
    for outer in (None, within):
        with Scratch(spark) as turn:
            marked, rest = _by_label(crowded, _labels(found, turn), turn, outer or turn)
            main = marked.select(F.col("key").alias("b_key"), F.col("fp").alias("b"), F.col("label").alias("b_label"))
            near_main = rest.join(by_shuffle(main), (F.col("key") == F.col("b_key")) & (F.col("main") == F.col("b_label"))
                                  & _near("a", "b", most), "left_semi")
            found = within.keep(found.unionByName(near_main.select("a", F.col("main").alias("b"))).distinct(), "simhash-links")
    other = rest.select("key", F.col("a").alias("b"), F.col("label").alias("b_label"))
    between = rest.join(by_shuffle(other), "key").where("a < b and label <> b_label").where(_near("a", "b", most))
    return found.unionByName(between.select("a", "b").distinct())


def _labels(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, label): connected fingerprints that were hung on a common one, two steps up, have one label."""
    up = found.select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("to")).groupBy("fp") \
        .agg(F.min("to").alias("label"))
    for _ in range(2):
        above = up.select(F.col("fp").alias("label"), F.col("label").alias("above"))
        up = up.join(by_shuffle(above), "label", "left").select("fp", F.coalesce("above", "label").alias("label"))
    return scratch.keep(up, "simhash-labels")


def _by_label(crowded: DataFrame, labels: DataFrame, scratch: Scratch, outer: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with their label, (key, fp, label), and those without the bucket's most frequent label,
    (key, a, label, main); the latter are kept in `outer`."""
    marked = scratch.keep(crowded.join(by_shuffle(labels), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label")),
                          "simhash-marked")
    sizes = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"),
                                     F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rest = marked.join(by_shuffle(mixed), "key").where("label <> main").select("key", F.col("fp").alias("a"), "label", "main")
    return marked, outer.keep(rest, "simhash-rest")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `most` bits (up to 4). Null, empty
    and wordless texts all have fingerprint 0 and so belong together, linked like any other. A repeated row
    yields a repeated result. An empty table yields no row. Other columns are not read.
    """
    if not 0 <= most <= 4:
        raise ValueError("three segments with one free bit find up to four differing bits")
    rows = keep(fingerprints(docs, shingle), "simhash-rows")
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = components(links(prints.select("fp"), most))
    grouped = prints.join(by_shuffle(roots.withColumnRenamed("node", "fp")), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(by_shuffle(grouped.join(by_shuffle(least), "root").select("fp", "component_id")), "fp") \
        .select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: the smallest doc_id of each component stays, one row of it."""
    from pyspark.sql import Window

    groups = near_duplicates(docs)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    found = docs.join(by_shuffle(stay), F.col("doc_id").cast("long") == F.col("_stay"), "left_semi")
    turn = Window.partitionBy("doc_id").orderBy(F.col("doc_id"))
    return found.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
