"""Near-duplicate lines by a segment-partition edit join.

With at most t edits between two lines, one of t + 1 even segments of the shorter line occurs unchanged in the
longer one, at a place that the two lengths bound. Segments are indexed under (segment number, length, content);
every line probes the substrings at the possible places, for each length it may be near to. Lines that meet are
verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ODD, Powers, Spans, joined, keep, prepare, read, slices, spread_bits

EDITS = 2
SHORTEST = 32
FILTER_BITS = 24
BAG_CELLS = 14
BLANKS = " \t\r\x0b\x0c"
SEED = 42


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most `most`, in code points.

    Common ends are cut off. Then one small bit set per number of edits holds the diagonals, at most `most` off the
    main one, on which a prefix of `a` can be aligned with what has been read of `b`; all diagonals step at once.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    start, end, short = 0, 0, min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    at: dict[str, int] = {}
    for i, char in enumerate(a):
        at[char] = at.get(char, 0) | 1 << i
    band = (1 << (2 * most + 1)) - 1
    reach = [((1 << (e + 1)) - 1) << most for e in range(most + 1)]
    for j, char in enumerate(b):
        places = at.get(char, 0)
        equal = (places >> (j - most) if j >= most else places << (most - j)) & band
        after = [reach[0] & equal]
        for e in range(1, most + 1):
            replaced_or_added = reach[e - 1] | reach[e - 1] >> 1
            after.append((reach[e] & equal | replaced_or_added | after[-1] << 1) & band)
        reach = after
        if not reach[most]:
            return False
    return bool(reach[most] >> (len(a) - len(b) + most) & 1)


class Lines(NamedTuple):
    """Lines of SHORTEST code points or more: where they lie in the bytes, their hash, and their code points."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    chars: np.ndarray
    char_at: np.ndarray
    hashes: np.ndarray


def lines_of(texts: pa.Array, shortest: int) -> Lines:
    """The distinct long lines of all texts together."""
    import xxhash

    data, _ = joined(texts)
    char_at = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(char_at, starts)
    chars = np.searchsorted(char_at, ends) - first
    long = np.flatnonzero(chars >= shortest)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(starts[long].tolist(), ends[long].tolist())],
                      np.uint64).view(np.int64)
    hashes, once = np.unique(hashes, return_index=True)
    long = long[once]
    return Lines(data, starts[long], ends[long], first[long], chars[long], char_at, hashes)


def bags(found: Lines) -> np.ndarray:
    """Per line how often code points of each of 14 classes occur, modulo 16: 4 bits each, above a free lowest bit.

    An edit changes at most two of the counts by one.
    """
    lead = np.arange(256)
    kind = (lead * 5 + lead // 16) % BAG_CELLS
    total = int(found.chars.sum())
    line = np.repeat(np.arange(len(found.chars)), found.chars)
    within = np.arange(total) - np.repeat(np.cumsum(found.chars) - found.chars, found.chars)
    cell = kind[found.data[found.char_at[np.repeat(found.first, found.chars) + within]]]
    counts = np.bincount(line * BAG_CELLS + cell, minlength=len(found.chars) * BAG_CELLS).reshape(-1, BAG_CELLS) & 15
    return (counts << (4 * np.arange(BAG_CELLS) + 1)).sum(axis=1)


def _bags_apart(a: str, b: str) -> Column:
    """How far two bags differ in all, each cell around its circle of 16."""
    terms = []
    for k in range(BAG_CELLS):
        one, two = (F.shiftright(F.col(c), 4 * k + 1).bitwiseAND(15) for c in (a, b))
        apart = F.abs(one - two)
        terms.append(F.least(apart, F.lit(16) - apart))
    return sum(terms[1:], terms[0])


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of one of the edits + 1 even segments of lines of these lengths."""
    parts = edits + 1
    small, longer = length // parts, length % parts
    return number * small + np.maximum(number - (parts - longer), 0), small + (number >= parts - longer)


def signatures(texts: pa.Array, edits: int, shortest: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, tags and line hashes of the long lines; a tag is the line's bag with the role (0 indexed, 1 probing)."""
    found = lines_of(texts, shortest)
    bag = bags(found)
    spans = Spans(found.data, powers)
    edge = np.append(found.char_at, len(found.data))
    keys, tags, owners = [], [], []

    def add(role: int, which: np.ndarray, number: int, length: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        begin = found.first[which] + at
        content = spans.hashes(edge[begin], edge[begin + size])
        label = length.astype(np.uint64) * np.uint64(edits + 1) + np.uint64(number)
        keys.append(spread_bits(content ^ (label * np.uint64(ODD))).view(np.int64))
        tags.append(bag[which] | role)
        owners.append(found.hashes[which])

    everyone = np.arange(len(found.hashes))
    for number in range(edits + 1):
        at, size = segment(found.chars, number, edits)
        add(0, everyone, number, found.chars, at, size)
    for less in range(edits + 1):
        which = np.flatnonzero(found.chars - less >= shortest)
        length = found.chars[which] - less
        for number in range(edits + 1):
            at, size = segment(length, number, edits)
            # Edits before the segment are at most `number`, those after it at most `edits - number`.
            low, high = max(-number, less - (edits - number)), min(number, less + (edits - number))
            for move in range(low, high + 1):
                place = at + move
                fits = (place >= 0) & (place + size <= length + less)
                add(1, which[fits], number, length[fits], place[fits], size[fits])
    return np.concatenate(keys), np.concatenate(tags), np.concatenate(owners)


def _text_column(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text"))


def shared_keys(docs: DataFrame, edits: int, shortest: int) -> DataFrame:
    """Signature rows (key, tag, h, rep) of keys that several distinct lines share; rep is the key's smallest line."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text"):
            columns = signatures(part.column("text"), edits, shortest, powers)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "tag", "h"])

    # One exchange serves both the aggregate and the join: both read all three columns.
    dealt = _text_column(docs).mapInArrow(walk, "key long, tag long, h long").repartition("key")
    reps = dealt.groupBy("key").agg(F.min("h").alias("rep"), F.max("h").alias("top"), F.max("tag").alias("tags")) \
        .where("rep <> top and tags is not null")
    return dealt.join(reps.select("key", "rep"), "key").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, shortest: int) -> DataFrame:
    """(h, line) of the wanted line hashes.

    A bitmap of the wanted hashes' low bits, of fixed size at any scale, spares most other lines the shuffle; the
    join decides.
    """
    low = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    words = wanted.select(F.shiftright(low, 5).alias("word"), F.expr("shiftleft(1L, cast(h & 31 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    # At most 2 ** (FILTER_BITS - 5) rows.
    held = words.toPandas()
    bitmap[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = lines_of(part.column("text"), shortest)
            low = found.hashes & ((1 << FILTER_BITS) - 1)
            hit = np.flatnonzero(shared.value[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1))
            raw = found.data.tobytes()
            lines = [raw[a:b].decode() for a, b in zip(found.starts[hit].tolist(), found.ends[hit].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes[hit]), pa.array(lines, pa.string())],
                                             names=["h", "line"])

    candidates = _text_column(docs).mapInArrow(walk, "h long, line string")
    return candidates.join(wanted, "h", "left_semi").dropDuplicates(["h"])


def later_of_near(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(h) of every distinct line to which a line of smaller hash is near (at most `edits` edits).

    First each line is verified against the smallest line of each key it shares. Only a line that this leaves
    standing is then held against the smaller lines of its keys, so a group of near lines costs one comparison each,
    not one per pair; lines that share a segment but differ in the rest are told apart by their bags within the join.
    """
    shared = keep(shared_keys(docs, edits, shortest), "line-keys")
    texts = keep(texts_of(docs, shared.select("h").distinct(), shortest), "line-texts")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits_within(x, y, edits) for x, y in zip(a, b)], dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.withColumnRenamed("line", "line_a"), "h") \
            .join(texts.select(F.col("h").alias("other"), F.col("line").alias("line_b")), "other")
        return both.where(near("line_a", "line_b")).select("h").distinct()

    first = keep(verified(shared.where("h > rep").select("h", F.col("rep").alias("other")).distinct()), "line-first")
    standing = shared.where("h > rep").join(first, "h", "left_anti")
    smaller = shared.select("key", F.col("tag").alias("other_tag"), F.col("h").alias("other"))
    pairs = standing.join(smaller, "key").where("other < h and other <> rep and other_tag & 1 <> tag & 1") \
        .where(_bags_apart("tag", "other_tag") <= 2 * edits)
    return first.unionByName(verified(pairs.select("h", "other").distinct()))


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of `docs`, all columns, without repeated lines; `n_chars`, where present, is counted anew.

    Lines are what line feeds separate. A line with a word stays only at its first place (by doc_id, where null comes
    first, then by hash of the text, then by line number). A line of `shortest` code points or more goes too if one of
    smaller XXH64 is within `edits` edits of it; in a shorter one so many edits would make another text, so only equal
    ones go. Lines of white space stay. No row goes: a text may become empty, a null text stays null. Rows of equal
    doc_id and text keep the same lines. An empty table stays empty.
    """
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    owner = {"_line_known": own.isNotNull(), "_line_doc": F.coalesce(own, F.lit(0)), "_line_text": F.xxhash64(text)}
    prepare(docs.sparkSession)
    each = docs.select(*(c.alias(name) for name, c in owner.items()), F.posexplode(F.split(text, "\n")).alias("_line", "text"))
    first = each.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy(F.xxhash64("text").alias("h")) \
        .agg(F.min(F.struct(*owner, "_line")).alias("at"))
    stay = first.join(later_of_near(docs, edits, shortest), "h", "left_anti")
    # One list per document, of its own line numbers.
    lists = stay.groupBy(*(F.col(f"at.{name}").alias(name) for name in owner)).agg(F.collect_list("at._line").alias("_line_stay"))

    @F.pandas_udf("string")
    def kept_text(texts: pd.Series, stays: pd.Series) -> pd.Series:
        out = []
        for text, stay in zip(texts, stays):
            if text is None:
                out.append(None)
                continue
            numbers = set(stay) if stay is not None else ()
            out.append("\n".join([line for n, line in enumerate(text.split("\n"))
                                  if n in numbers or not line.strip(BLANKS)]))
        return pd.Series(out, dtype=object)

    out = docs.withColumns(owner).join(lists, [*owner], "left").withColumn("text", kept_text(text, "_line_stay"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line deduplication, by its checksum, with the number of lines before and after."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_count("text", F.lit("\n")).alias("breaks"))
    out = dedup_lines(docs)
    left = F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return out.select("doc_id", (F.col("breaks") + 1).cast("long").alias("n_lines"), left.cast("long").alias("n_kept"),
                      F.char_length("text").cast("long").alias("kept_chars"), F.crc32("text").alias("kept_crc32"))
