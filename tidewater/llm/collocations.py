"""Phrase collocations from a weighted de Bruijn graph of words.

An edge is a run of LONGEST words that joins two nodes of LONGEST - 1 words which overlap in all but one. Only the
edges and the shorter runs that end at the end of a piece are counted from the texts. The count of any shorter phrase
is the flow out of its node, summed over the phrases one word longer that begin with it, plus the pieces that end
with it; so each order follows from the one above. A node all of whose flow passes through a single edge lies on a
unary path and is compacted into that edge: it is the phrase that a longer one of equal count contains.

Every part of a phrase of `least` occurrences has as many. An edge therefore ends where it would become rarer, which
changes no count that matters and leaves few distinct edges. Where that is, is told to the tasks by bitmaps: of the
words, which are counted exactly, then of pairs, then of longer runs, whose hashes fall into buckets that are counted.
A bucket of fewer than `least` holds no frequent run; what the others let through in excess is counted exactly. Tasks
send buckets and runs in chunks, one for each of PARTS parts of the hashes, which are summed part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import ODD, Powers, Spans, bitmap_of, joined, keep, marked, prepare, read, slices, spread_bits

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
SLICE = 2 << 20
TALLY = 1 << 19
SPELLED = 1 << 16
SALTS = 64
PARTS = 256
#: Buckets: one for so many words, within these powers of two; how many of a task's are held at once.
CROWD, FEWEST_BITS, MOST_BITS, HELD = 16, 16, 28, 1 << 20


class Pieces(NamedTuple):
    """Words of some texts in order: hashes that depend on word and language, where each lies, and its text's number.
    `linked` says whether the next word follows in the same piece."""

    data: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    linked: np.ndarray


def pieces_of(texts: pa.Array, langs: pa.Array, powers: Powers) -> Pieces:
    import xxhash

    data, bounds = joined(pc.ascii_lower(pc.fill_null(texts, "")))
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(ENDS)] = 1, 2
    kind = kind[data]
    edge = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    doc = np.searchsorted(bounds, starts, side="right") - 1
    coded = pc.dictionary_encode(langs)
    salts = np.array([xxhash.xxh64_intdigest(name) for name in coded.dictionary.to_pylist()], np.uint64)
    salt = salts[coded.indices.to_numpy(zero_copy_only=False)] if len(salts) else np.zeros(len(texts), np.uint64)
    words = spread_bits(Spans(data, powers).hashes(starts, ends) ^ salt[doc])
    piece = np.cumsum(kind == 2)[starts]
    return Pieces(data, words, starts, ends, doc, np.append(piece[1:] == piece[:-1], False)[:len(words)])


def shifted(values: np.ndarray, by: int) -> np.ndarray:
    """What stands `by` places further on; zeros after the end."""
    return np.append(values[by:], np.zeros(min(by, len(values)), values.dtype))


def grown(found: Pieces, words: np.ndarray, filters: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size from 2 on: at which words a run of so many may begin that is frequent, and the hashes of the runs.

    Its words are marked in `words` and follow each other in a piece, and every part of it whose size has a bitmap in
    `filters` is marked there.
    """
    known = marked(words, found.words)
    able, hashes = known, found.words
    for size in range(2, longest + 1):
        able = able & shifted(able, 1) & (found.linked if size == 2 else True)
        hashes = spread_bits(hashes * np.uint64(ODD) + shifted(found.words, size - 1))
        if size in filters:
            able = able & marked(filters[size], hashes)
        yield size, able, hashes


class Tally:
    """Counts of runs of `width` words over many slices, in memory for at most about TALLY distinct ones."""

    def __init__(self, width: int = 1) -> None:
        self.width = width
        self._clear()

    def _clear(self) -> None:
        self.runs, self.counts, self.held = [np.zeros((0, self.width), np.uint64)], [np.zeros(0, np.int64)], 0

    def keys(self, runs: np.ndarray) -> np.ndarray:
        mixed = runs[:, 0]
        for column in runs.T[1:]:
            mixed = spread_bits(mixed * np.uint64(ODD) + column)
        return mixed

    def add(self, runs: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """Counts each run once, or as often as `counts` says. Whether it is time to take what has been counted."""
        if counts is None:
            _, first, counts = np.unique(self.keys(runs), return_index=True, return_counts=True)
            runs = runs[first]
        self.runs.append(runs)
        self.counts.append(counts)
        self.held += len(runs)
        if self.held > 2 * TALLY:
            self._merge()
        return self.held > TALLY

    def _merge(self) -> None:
        runs = np.concatenate(self.runs)
        _, first, which = np.unique(self.keys(runs), return_index=True, return_inverse=True)
        self.counts = [np.bincount(which, np.concatenate(self.counts), len(first)).astype(np.int64)]
        self.runs, self.held = [runs[first]], len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        runs, counts = self.runs[0], self.counts[0]
        self._clear()
        return runs, counts


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, lang, n): how often each word occurs, with a null lang, and each language's words, with a null h. Several
    rows may count the same."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tally, words = Powers(), Tally(), {}

        def rows() -> pa.RecordBatch:
            runs, counts = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(runs[:, 0].view(np.int64)), pa.nulls(len(runs), pa.string()), pa.array(counts)],
                                              names=["h", "lang", "n"])

        for part in slices(batches, "text", SLICE):
            found = pieces_of(part.column("text"), part.column("lang"), powers)
            sizes = np.bincount(found.doc, minlength=part.num_rows)
            for lang, n in zip(part.column("lang").to_pylist(), sizes.tolist()):
                words[lang] = words.get(lang, 0) + n
            if tally.add(found.words[:, None]):
                yield rows()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.keys(), pa.string()),
                                          pa.array(words.values(), pa.int64())], names=["h", "lang", "n"])

    return texts.mapInArrow(walk, "h long, lang string, n long")


def packed(buckets: np.ndarray) -> bytes:
    """Ascending numbers as their differences, low bytes of all first, so that the zeros of the high ones lie together."""
    return np.diff(buckets, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(4, -1).T).view("<u4")[:, 0], dtype=np.int64)


def crowded(texts: DataFrame, words: np.ndarray, filters: dict[int, np.ndarray], sizes: range, least: int, bits: int) -> np.ndarray:
    """Bitmap of the 2**bits buckets into which at least `least` runs of `sizes` fall by the low bits of their hashes.

    Runs are those that `words` and `filters` leave. The buckets are counted in PARTS parts, each by one task.
    """
    context = texts.sparkSession.sparkContext
    shared, within = context.broadcast((words, filters)), bits - (PARTS.bit_length() - 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, n = Powers(), [], 0

        def rows() -> pa.RecordBatch:
            # More than `least` of a bucket tell nothing further.
            buckets, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
            buckets = np.repeat(buckets, np.minimum(counts, least))
            bounds = np.searchsorted(buckets, np.arange(PARTS + 1, dtype=np.int64) << within)
            full = np.flatnonzero(np.diff(bounds))
            own = buckets & np.uint32((1 << within) - 1)
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed(own[bounds[i]:bounds[i + 1]]) for i in full], pa.binary())],
                                              names=["part", "buckets"])

        for piece in slices(batches, "text", SLICE):
            found = pieces_of(piece.column("text"), piece.column("lang"), powers)
            for size, able, hashes in grown(found, *shared.value, sizes.stop - 1):
                if size in sizes:
                    held.append((hashes[able] & np.uint64((1 << bits) - 1)).astype(np.uint32))
                    n += len(held[-1])
            if n > HELD:
                yield rows()
                held, n = [], 0
        yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, buckets in zip(batch.column("part").to_pylist(), batch.column("buckets")):
                own, counts = np.unique(unpacked(buckets.as_py()), return_counts=True)
                counters.setdefault(part, np.zeros(1 << within, np.int64))[own] += counts
        for part, counter in counters.items():
            marks = np.packbits(counter >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([marks], pa.binary())], names=["part", "marks"])

    bitmap = np.zeros((PARTS, (1 << within) // 32), np.uint32)
    # At most PARTS rows of 2**bits bits in all.
    held = texts.mapInArrow(walk, "part int, buckets binary").repartition("part").mapInArrow(count, "part int, marks binary").toArrow()
    for part, marks in zip(held.column("part").to_pylist(), held.column("marks")):
        bitmap[part] = np.frombuffer(marks.as_py(), "<u4")
    return bitmap.reshape(-1)


def _chunks(keys: np.ndarray, **lists: pa.Array) -> pa.RecordBatch:
    """One row for each part of the keys, with what belongs to them; columns that are not given are null."""
    parts = (keys & np.uint64(PARTS - 1)).astype(np.int32)
    order = np.argsort(parts, kind="stable")
    full, counts = np.unique(parts, return_counts=True)
    columns = [pa.array(full, pa.int32())]
    for name, kind in (("g", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("lang", pa.string())):
        width = 1
        if name not in lists:
            columns.append(pa.nulls(len(full), pa.list_(kind)))
            continue
        values = lists[name]
        if isinstance(values, np.ndarray) and values.ndim == 2:
            width, values = values.shape[1], pa.array(values[order].reshape(-1).view(np.int64))
        else:
            values = pa.array(values).take(pa.array(order))
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts * width)).astype(np.int32)), values))
    return pa.RecordBatch.from_arrays(columns, names=["part", "g", "n", "word", "lang"])


def edges_of(texts: DataFrame, words: np.ndarray, filters: dict[int, np.ndarray], longest: int) -> DataFrame:
    """(g, n, word, lang): runs of two or more word hashes with their counts, and the words in them with n = 0.

    From every word starts one run of `longest` words, or a shorter one that ends where its piece does or where it
    would become one that the bitmaps do not mark. Several rows may count the same.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, filters))
    sizes = range(2, longest + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, told, held = Powers(), np.zeros(0, np.uint64), []
        tallies = {size: Tally(size) for size in sizes}

        def runs(tally: Tally) -> pa.RecordBatch:
            rows, counts = tally.take()
            return _chunks(tally.keys(rows), g=rows, n=counts)

        def spellings(held: list[tuple[np.ndarray, pa.Array, pa.Array]]) -> pa.RecordBatch:
            new, word, lang = zip(*held)
            return _chunks(np.concatenate(new), g=np.concatenate(new)[:, None], word=pa.concat_arrays(word), lang=pa.concat_arrays(lang))

        for part in slices(batches, "text", SLICE):
            found = pieces_of(part.column("text"), part.column("lang"), powers)
            length, inside = np.ones(len(found.words), np.int8), np.zeros(len(found.words), bool)
            for size, able, _ in grown(found, *shared.value, longest):
                length += able
                if size == 2:
                    inside = able | np.append(False, able[:-1])[:len(able)]
            for size, tally in tallies.items():
                at = np.flatnonzero(length == size)
                if tally.add(found.words[at[:, None] + np.arange(size)]):
                    yield runs(tally)
            # Words of runs, once per task while they are remembered.
            new, first = np.unique(found.words[inside], return_index=True)
            fresh = ~np.isin(new, told, assume_unique=True)
            new, at = new[fresh], np.flatnonzero(inside)[first[fresh]]
            if len(new):
                told = np.concatenate([told, new]) if len(told) < TALLY else new
                raw = found.data.tobytes()
                spelled = pa.array([raw[a:b].decode() for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist())], pa.string())
                held.append((new, spelled, part.column("lang").take(pa.array(found.doc[at]))))
            if sum(len(new) for new, _, _ in held) > SPELLED:
                yield spellings(held)
                held = []
        for tally in tallies.values():
            yield runs(tally)
        if held:
            yield spellings(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, names = np.zeros(0, np.uint64), ["g", "n", "word", "lang"]
        tallies = {size: Tally(size) for size in sizes}

        def rows(g: np.ndarray, n: np.ndarray, word: pa.Array, lang: pa.Array) -> pa.RecordBatch:
            offsets = pa.array(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(g.reshape(-1).view(np.int64))), pa.array(n), word, lang], names=names)

        def runs(tally: Tally) -> pa.RecordBatch:
            g, n = tally.take()
            return rows(g, n, pa.nulls(len(g), pa.string()), pa.nulls(len(g), pa.string()))

        for batch in batches:
            for i in range(batch.num_rows):
                g, n, word, lang = (batch.column(name)[i].values for name in names)
                g = g.to_numpy().view(np.uint64)
                if n is not None:
                    tally = tallies[len(g) // len(n)]
                    if tally.add(g.reshape(len(n), -1), n.to_numpy()):
                        yield runs(tally)
                    continue
                fresh = np.flatnonzero(~np.isin(g, told))
                if len(fresh):
                    told = np.concatenate([told, g[fresh]]) if len(told) < TALLY else g[fresh]
                    yield rows(g[fresh, None], np.zeros(len(fresh), np.int64), word.take(pa.array(fresh)), lang.take(pa.array(fresh)))
        for tally in tallies.values():
            yield runs(tally)

    chunks = texts.mapInArrow(walk, "part int, g array<long>, n array<long>, word array<string>, lang array<string>")
    return chunks.repartition("part").mapInArrow(total, "g array<long>, n long, word string, lang string")


def node_flows(edges: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """(g, f) of every phrase of up to `longest` words with `least` occurrences, from (g, n) of edges and their ends and
    from (h, n) of the single words that have as many."""
    level, out = None, [words.select(F.array("h").alias("g"), F.col("n").alias("f"))]
    for size in range(longest, 1, -1):
        ends = edges.where(F.size("g") == size).select("g", "n")
        if level is not None:
            ends = ends.unionByName(level.select(F.slice("g", 1, size).alias("g"), F.col("f").alias("n")))
        level = keep(ends.groupBy("g").agg(F.sum("n").alias("f")), f"flow-{size}")
        out.append(level.where(F.col("f") >= least))
    frequent = out[0]
    for one in out[1:]:
        frequent = frequent.unionByName(one)
    return keep(frequent, "flows")


def compacted(flows: DataFrame) -> DataFrame:
    """(g, f) of the nodes that pass all their flow through one edge, in or out of them."""
    wide = flows.where(F.size("g") > 2)
    return wide.select(F.expr("slice(g, 1, size(g) - 1)").alias("g"), "f") \
        .unionByName(wide.select(F.expr("slice(g, 2, size(g) - 1)").alias("g"), "f")).distinct()


def lowest_cuts(flows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Adds (l, r, score) of each phrase's lowest-scoring cut to phrases (g, a, n); of equal scores the first cut's.

    The score floor(1000 a n / (l r)) is exact: products are decimals of up to 38 digits.
    """
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size(g) - 1)"))) \
        .withColumn("left", F.expr("slice(g, 1, k)")).withColumn("right", F.expr("slice(g, k + 1, size(g) - k)"))
    both = cuts.join(flows.select(F.col("g").alias("left"), F.col("f").alias("l")), "left") \
        .join(flows.select(F.col("g").alias("right"), F.col("f").alias("r")), "right")

    def wide(column: str) -> str:
        return f"cast({column} as decimal(19,0))"

    score = F.expr(f"cast(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')} as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
    best = both.groupBy("g").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("g", "a", "n", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` collocations (None: all), over (lang, text).

    A null text is empty, a null lang is `und`. Equal rows count as often as they stand; rows that tie in score and
    count come in byte order of the phrase. Tables without a frequent phrase give no rows. Words and pairs are told
    apart by 64-bit hashes of language and text. Other columns are not read.
    """
    texts = _texts(docs)
    enough = F.col("n") >= least
    words = keep(word_counts(texts).groupBy("h", "lang").agg(F.sum("n").alias("n")).where(enough | F.col("h").isNull()), "words")
    totals = words.where("h is null").select("lang", "n")
    frequent = words.where("h is not null")
    seen = bitmap_of(frequent, "h")
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max((n // CROWD).bit_length(), FEWEST_BITS), MOST_BITS)
    pairs = crowded(texts, seen, {}, range(2, 3), least, bits)
    runs = crowded(texts, seen, {2: pairs}, range(3, longest + 1), least, bits) if longest > 2 else None
    edges = keep(edges_of(texts, seen, {2: pairs} | {size: runs for size in range(3, longest + 1)}, longest), "edges")
    spelling = edges.where("word is not null").groupBy(F.col("g")[0].alias("w")).agg(F.min("word").alias("word"), F.min("lang").alias("lang"))
    flows = node_flows(edges.where("word is null").select("g", "n"), frequent, least, longest)
    candidates = flows.where(F.size("g") > 1).join(compacted(flows), ["g", "f"], "left_anti")
    spelled = candidates.select("g", "f", F.posexplode("g").alias("at", "w")).join(spelling, "w") \
        .groupBy("g").agg(F.first("f").alias("a"), F.min("lang").alias("lang"),
                          F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = keep(spelled.join(totals, "lang"), "phrases")
    scored = lowest_cuts(flows, named.select("g", "a", "n")).join(named.select("g", "lang", "phrase"), "g")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # The first `top` of each part hold the first `top` of all: no language is ranked whole in one task.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("g"), F.lit(SALTS))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations over all documents."""
    return collocations(read(spark, sf_dir, "documents"))
