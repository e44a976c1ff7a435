"""Helpers of the operators: session limits, scratch tables, slices of Arrow batches, and words as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import Scratch, adopt, delete, keep  # noqa: F401

SLICE_BYTES = 2 << 20
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
ODD = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """UTC, and Arrow batches small enough for tables whose texts are very long."""
    adopt(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches with at most `most` bytes in `column`, or a single row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bitmap_of(hashes: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Bitmap of 2**bits bits, of fixed size at any scale, with the low bits of every hash set.

    `marked` asks it. It never misses a hash it was made of; others may pass, the more the fuller it is.
    """
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(low, 5).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    # At most 2 ** (bits - 5) rows.
    held = words.toArrow()
    bitmap[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return bitmap


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = (hashes & np.uint64(32 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts with a line feed after each, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts, "")
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    return np.insert(data, offsets[1:], 10), offsets + np.arange(len(offsets))


def spread_bits(values: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values so that every output bit depends on every input bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(base: int) -> np.ndarray:
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                return np.cumprod(steps)
            self.up, self.down = run(BASE), run(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


class Spans:
    """Hashes of any spans of a symbol array, from one cumulative sum."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.to(len(symbols) + 1)
        mixed = spread_bits((symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(mixed * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spread_bits((self.sums[ends] - self.sums[starts]) * self.down[starts] + np.uint64(ODD))


class Words(NamedTuple):
    data: np.ndarray
    bounds: np.ndarray
    inside: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    spans: Spans


def words_of(texts: pa.Array, powers: Powers) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text as 64-bit hashes in order, with the text each belongs to."""
    data, bounds = joined(texts)
    table = np.ones(256, bool)
    table[list(SPACE_BYTES)] = False
    inside = table[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    spans = Spans(data, powers)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Words(data, bounds, inside, doc, spans.hashes(starts, ends), spans)
