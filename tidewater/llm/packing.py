"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

The program asks for the fewest patterns (multisets of lengths that fit a sequence) that hold every length as
often as it occurs. Multiplicative weights price the lengths, a knapsack by dynamic programming finds the pattern
of best price, its last pieces are exchanged for ones that fill the sequence, and the fractional solution is rounded
down; what remains is solved again. Lengths that occur seldom are taken in whole patterns, so that rounding does not
lose them; the last few pieces go by best fit. The histogram has at most `capacity` entries at any size of the
corpus, and a solution at most about five patterns a length; pieces then look up their place by their rank among
pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import keep, prepare, read, slices
from tidewater.llm.tokens import Encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
ROOMS = 128
LAST_PIECES = 64
CLASSES = 64
RATE = 1.0
LONG_BONUS = 10.0


def best_pattern(prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> Counter:
    """A multiset of lengths of high total price that fits, by a knapsack over the capacity in at most ROOMS units.

    Lengths are rounded up to units, and of those of equal units the best priced stands for all, so the result always
    fits. Each length is used at most `most` times in it: a pattern that asks for more than there are is cut back.
    """
    unit = max(1, capacity // ROOMS)
    rooms, units = capacity // unit, -(-lengths // unit)
    order = np.lexsort((prices, units))
    best = order[np.append(np.diff(units[order]) > 0, True)]
    best = best[(prices[best] > 0) & (units[best] <= rooms)]
    sizes, worth = units[best], prices[best]
    fitting = np.searchsorted(sizes, np.arange(rooms + 1), side="right")
    value, pick = np.zeros(rooms + 1), np.full(rooms + 1, -1)
    for room in range(1, rooms + 1):
        value[room] = value[room - 1]
        if fitting[room]:
            gains = worth[:fitting[room]] + value[room - sizes[:fitting[room]]]
            top = gains.argmax()
            if gains[top] > value[room]:
                value[room], pick[room] = gains[top], top
    pattern, room = Counter(), rooms
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        pattern[int(best[pick[room]])] += 1
        room -= int(sizes[pick[room]])
    return Counter({k: min(n, int(most[k])) for k, n in pattern.items()})


def complete(pattern: Counter, lengths: np.ndarray, most: np.ndarray, capacity: int) -> Counter:
    """The pattern filled up: by one length that closes the gap it leaves, in exchange for one of its own if need be,
    else by two; where none do, by the longest that fit, one after the other.
    """
    free = np.zeros(capacity + 1, np.int64)
    free[lengths] = most
    sizes = Counter({int(lengths[k]): n for k, n in pattern.items()})
    for size, n in sizes.items():
        free[size] -= n
    room = capacity - sum(size * n for size, n in sizes.items())
    own = sorted(sizes)
    for dropped, singly in [*((size, True) for size in own), (0, True), *((size, False) for size in [0, *own])]:
        gap = room + dropped
        closing: list[int] = []
        if not room:
            break
        free[dropped] += 1
        if singly:
            closing = [gap] if free[gap] > 0 else []
        else:
            shorter = np.arange(1, gap // 2 + 1)
            pairs = np.flatnonzero((free[shorter] > 0) & (free[gap - shorter] > (2 * shorter == gap)))
            if len(pairs):
                closing = [int(shorter[pairs[0]]), gap - int(shorter[pairs[0]])]
        if closing:
            sizes.subtract([dropped])
            sizes.update(closing)
            room = 0
        else:
            free[dropped] -= 1
    while room > 0:
        fits = np.flatnonzero(free[1:room + 1] > 0)
        if not len(fits):
            break
        size = int(fits[-1]) + 1
        sizes[size] += 1
        free[size] -= 1
        room -= size
    return Counter({int(np.searchsorted(lengths, size)): n for size, n in sizes.items() if size and n})


def cover(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[Counter, float]]:
    """A fractional solution by multiplicative weights: patterns, and how often each is used; no length is used more
    than it occurs, and less than one of each is left.

    A step uses a pattern as often as takes a quarter of its scarcest length, but once at least. The weight of a
    length starts at its share of a sequence, long ones above, and falls exponentially with the share of pieces of
    about its length that is placed.
    """
    left = demand.astype(float)
    start = lengths * (1.0 + LONG_BONUS * lengths / capacity)
    classes = lengths * CLASSES // (capacity + 1)
    total = np.bincount(classes, demand)[classes]
    patterns: list[tuple[Counter, float]] = []
    while True:
        whole = np.floor(left + 1e-9)
        share = 1.0 - np.bincount(classes, left)[classes] / total
        if not whole.any():
            return patterns
        prices = np.where(whole >= 1, start * np.exp(-RATE * (share - share[whole >= 1].min())), 0.0)
        pattern = complete(best_pattern(prices, lengths, whole, capacity), lengths, whole, capacity)
        quarter = min(float(demand[k]) / n for k, n in pattern.items()) / 4
        times = min(max(quarter, 1.0), min(float(left[k]) / n for k, n in pattern.items()))
        patterns.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Rounded columns {length: how often} of the program with how many sequences use each, and the lengths left over.

    Columns that fill a sequence are taken first; where a round places less than an eighth of what it had, ones with
    more room left over are let in, in the end all.
    """
    left = {length: int(n) for length, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    allowed = [0, capacity // 64, capacity]
    while allowed and sum(left.values()) > LAST_PIECES:
        lengths = np.array(sorted(left))
        before = sum(left.values())
        for pattern, times in cover(lengths, np.array([left[k] for k in lengths.tolist()]), capacity):
            wanted, count = {int(lengths[k]): n for k, n in pattern.items()}, int(times + 1e-9)
            if count and capacity - sum(length * n for length, n in wanted.items()) <= allowed[0]:
                out.append((wanted, count))
                for length, n in wanted.items():
                    left[length] -= n * count
        left = {length: n for length, n in left.items() if n}
        if (before - sum(left.values())) * 8 < before:
            allowed.pop(0)
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: how often} with how many sequences use each; together they hold the histogram exactly.

    The program decides unless best fit of the whole histogram needs fewer sequences, as it can where lengths are few
    or even: there full sequences use up the short pieces that long ones need.
    """
    columns, left = solve(histogram, capacity)
    solved, fitted = columns + _best_fit(left, capacity), _best_fit(dict(histogram), capacity)
    return min(solved, fitted, key=lambda patterns: sum(count for _, count in patterns))


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: equal pieces go together, into the bins of least sufficient room."""
    open_bins: dict[int, list[list]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in sorted(r for r in open_bins if r >= length):
            if not n:
                break
            stay = []
            for pattern, count in open_bins.pop(room):
                each = room // length
                full = min(count, n // each)
                if full:
                    open_bins.setdefault(room - each * length, []).append([{**pattern, length: each}, full])
                    n -= full * each
                if count - full and 0 < n < each:
                    open_bins.setdefault(room - n * length, []).append([{**pattern, length: n}, 1])
                    n, full = 0, full + 1
                if count - full:
                    stay.append([pattern, count - full])
            if stay:
                open_bins.setdefault(room, []).extend(stay)
        each = capacity // length
        if n >= each:
            open_bins.setdefault(capacity - each * length, []).append([{length: each}, n // each])
        if n % each:
            open_bins.setdefault(capacity - n % each * length, []).append([{length: n % each}, 1])
    return [(pattern, count) for bins in open_bins.values() for pattern, count in bins]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length the runs of its pieces: first rank, pieces per sequence, first sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            runs.setdefault(length, []).append((ranks[length], n, sequence, offset))
            ranks[length] += n * count
            offset += length * n
        sequence += count
    return {length: tuple(np.array(column) for column in zip(*rows)) for length, rows in runs.items()}


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Every document's ids cut at multiples of the capacity: (doc_id, piece, start, length, ids_crc32, ids or null).

    `part` and `local` number the pieces of one length within the task that made them.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = Encoder(vocabulary_path, byte_level=False), int(end_id).to_bytes(4, "little")
        part, seen, step = TaskContext.get().partitionId(), Counter(), capacity * 4
        for rows in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                for number, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    length = len(cut) // 4
                    out.append((doc, number, at // 4, length, zlib.crc32(cut), part, seen[length],
                                np.frombuffer(cut, "<u4").tolist() if with_ids else None))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long, ids array<long>")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Place every piece of every document of (doc_id, text): (doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset).

    A null or empty text is one piece that holds the end id. Repeated rows are packed each for itself; a null
    doc_id stays null. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = keep(pieces(docs, vocabulary_path, capacity, end_id, with_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    from pyspark.sql import Window

    # A window over one length holds one row per task of the cutting stage.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(lengths)), np.int64)
        for one in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == one)
            first, each, sequence, offset = table.value[one]
            run = np.searchsorted(first, ranks[rows], side="right") - 1
            within = ranks[rows] - first[run]
            out[0, rows] = sequence[run] + within // each[run]
            out[1, rows] = offset[run] + within % each[run] * one
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    return ranked.withColumn("_at", placed("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"), vocabulary(VOCABULARY)).drop("ids")
