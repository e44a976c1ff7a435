"""Winnowing fingerprints: rolling k-gram hashes, the rightmost minimum of each window, positions kept.

Texts of LONG_FROM code points or more have k-grams of GRAM in windows of WINDOW: any two that share a passage of
WINDOW + GRAM - 1 code points share a selected hash. Texts under SHORT_BELOW have k-grams of SHORT_GRAM in windows of a
sixteenth of their length, rounded down to a power of two: what the larger of two such windows selects, the smaller
one selects too, so two of them share a hash from SHORT_GRAM - 1 and the larger window on. Texts between the
two limits have both, so that a text meets its own half across either limit. Shorter passages never match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Powers, Spans, keep, prepare, read, slices

GRAM = 32
WINDOW = 64
SHORT_GRAM = 8
LONG_FROM = 128
SHORT_BELOW = 512


def select(codes: np.ndarray, powers: Powers, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the selected k-grams; a shorter text is one k-gram, an empty one none."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = min(gram, n)
    starts = np.arange(n - gram + 1)
    hashes = Spans(codes, powers).hashes(starts, starts + gram) >> np.uint64(32)
    # The smallest key is the smallest hash and, among equal ones, the last position.
    low = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - starts.astype(np.uint64))
    width, least = 1, low
    window = min(window, len(low))
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), \
        (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def short_window(n: int) -> int:
    """The window of a text of n code points under SHORT_BELOW: 1 under 32, 2 under 64, and so on to 16."""
    return 1 << max((n // 16).bit_length() - 1, 0)


def select_all(codes: np.ndarray, powers: Powers, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions, in order of position, of what a text of this length has selected."""
    n, found = len(codes), []
    if n < SHORT_BELOW:
        found.append(select(codes, powers, min(SHORT_GRAM, gram), short_window(n)))
    if n >= LONG_FROM:
        found.append(select(codes, powers, gram, window))
    hashes, positions = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(positions, kind="stable")
    return hashes[order], positions[order]


def packed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hex digits of hash and four of the distance from the previous position, per selected k-gram."""
    out = np.empty(len(hashes), dtype=[("hash", ">u4"), ("gap", ">u2")])
    out["hash"], out["gap"] = hashes, np.diff(positions, prepend=0)
    return out.tobytes().hex()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a packed fingerprint."""
    held = np.frombuffer(bytes.fromhex(fingerprint), dtype=[("hash", ">u4"), ("gap", ">u2")])
    return held["hash"].astype(np.uint32), np.cumsum(held["gap"], dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets of hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint) of every row of (doc_id, text); a null or empty text has the empty fingerprint."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text"):
            prints = [packed(*select_all(_codes(t or ""), powers, gram, window)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string())],
                                             names=["doc_id", "fingerprint"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, fingerprint string")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Every row dealt to a block of neighbouring doc_ids in descending order: (block, tail, doc_id, text).

    The first row of each block also closes the block before it (`tail`), and the very first row the last block:
    so every row meets its successor within its block, and each text is shuffled once.
    """
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 1000)).first()[0]
    edges = np.unique(np.array(cuts or [], np.int64))

    def block_of(values: np.ndarray) -> np.ndarray:
        return len(edges) - np.searchsorted(edges, values, side="left")

    @F.pandas_udf("int")
    def number(doc_id: pd.Series) -> pd.Series:
        return pd.Series(block_of(doc_id.to_numpy()).astype(np.int32))

    # One row per block.
    heads = [(b, top) for b, top in sorted(map(tuple, ids.groupBy(number("doc_id").alias("b"))
                                                     .agg(F.max("doc_id")).collect()))]
    before = {top: heads[i - 1][0] for i, (_, top) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def dealt(doc_id: pd.Series) -> pd.Series:
        own = block_of(doc_id.to_numpy())
        return pd.Series([[b] if d not in before else [b, before[d]] for b, d in zip(own.tolist(), doc_id.tolist())])

    spread = docs.select("doc_id", "text", F.posexplode(dealt("doc_id")).alias("tail", "block"))
    return spread.repartition("block").sortWithinPartitions("block", "tail", F.desc("doc_id"), "text")


def edited_pairs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses, for every row of (doc_id, text).

    The edited text replaces the last half by the beginning of the next document's text, in descending doc_id;
    after the last comes the first. A null text is an empty one. Rows that repeat a doc_id follow each other in
    order of text. A single row is its own successor; an empty table gives no rows. Other columns are not read.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    spark = prepare(docs.sparkSession)
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def look(text: str):
            hashes, positions = select_all(_codes(text), powers, gram, window)
            return packed(hashes, positions), np.unique(hashes)

        def close(one, following) -> tuple:
            doc, text, (fingerprint, hashes) = one
            half = len(text) // 2
            edited = text[:len(text) - half] + following[1][:half]
            edited_print, edited_hashes = look(edited)
            return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint, edited_print,
                    likeness(hashes, edited_hashes), likeness(hashes, following[2][1]))

        held, block, closed = None, None, True
        for part in slices(batches, "text"):
            out = []
            for doc, text, tail, number in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "tail", "block"))):
                if number != block:
                    held, block, closed = None, number, False
                if closed:
                    continue
                here = (doc, text, look(text))
                if held is not None:
                    out.append(close(held, here))
                held, closed = here, bool(tail)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out
                                             else [pa.array([], t) for t in kinds], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(whole, blocks).mapInArrow(walk, schema)


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and the likenesses."""
    return edited_pairs(read(spark, sf_dir, "documents"))
