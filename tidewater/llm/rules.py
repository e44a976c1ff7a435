"""Quality rules: repetition and length rules, and the log-likelihood ratio of hashed n-grams.

Word unigrams and bigrams are hashed into buckets. The raw multinomial counts the buckets of every document; the
trusted one those of documents marked good. A document's score is the mean over its n-grams of
log(trusted / raw), and one fixed threshold decides about every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ODD, Powers, Words, prepare, read, slices, spread_bits, words_of

BUCKET_BITS = 16
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.25
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
SYMBOLS = b"#*$%&|<>"


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and of every pair of neighbouring words."""
    h, doc = words.hashes, words.doc
    shift = np.uint64(64 - BUCKET_BITS)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    both = spread_bits(h[pair] * np.uint64(ODD) + h[pair + 1])
    return np.concatenate([h >> shift, both >> shift]).astype(np.int64), np.concatenate([doc, doc[pair]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs over all rows of (text); one small vector per task is combined by Spark."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), np.zeros(1 << BUCKET_BITS, np.int64)
        for part in slices(batches, "text"):
            counts += np.bincount(ngram_buckets(words_of(part.column("text"), powers))[0], minlength=1 << BUCKET_BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["bucket", "n"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(walk, "bucket int, n long")
    out = np.zeros(1 << BUCKET_BITS)
    # At most one row per bucket.
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Documents of at most `most` labelled good rows, those of smallest hash: a bounded, repeatable choice."""
    chosen = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_good")).distinct() \
        .orderBy(F.xxhash64("_good"), "_good").limit(most)
    # At most `most` ids.
    return docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_good"), "left_semi")


def log_ratios(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> np.ndarray:
    """log(trusted / raw) of every bucket, with additive smoothing in both multinomials."""
    raw, trusted = bucket_counts(docs), bucket_counts(trusted_rows(docs, labels, most))
    if not trusted.sum():
        return np.zeros(1 << BUCKET_BITS)
    size = 1 << BUCKET_BITS
    prior = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * size)
    # The raw shares are the prior of the trusted ones, so a bucket seldom seen says little.
    return np.log((trusted + SMOOTHING * size * prior) / (trusted.sum() + SMOOTHING * size) / prior)


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(doc: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Per document, occurrences of a key beyond its first in that document."""
    mixed = np.unique(np.stack([doc.astype(np.uint64), keys]), axis=1) if len(keys) else np.zeros((2, 0), np.uint64)
    return np.bincount(doc, minlength=rows) - np.bincount(mixed[0].astype(np.int64), minlength=rows)


class Rules:
    """Measures and verdict of documents by fixed rules and a table of log ratios."""

    def __init__(self, ratios: np.ndarray, threshold: float) -> None:
        self.ratios, self.threshold, self.powers = ratios, threshold, Powers()
        self.symbol = np.isin(np.arange(256), list(SYMBOLS))

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray]:
        w = words_of(texts, self.powers)
        rows = len(texts)
        n_words = np.bincount(w.doc, minlength=rows)
        bucket, doc = ngram_buckets(w)
        grams = np.bincount(doc, minlength=rows)
        score = np.bincount(doc, weights=self.ratios[bucket], minlength=rows) / np.maximum(grams, 1)
        breaks = np.flatnonzero(w.data == 10)
        starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
        filled = np.concatenate([[0], np.cumsum(w.inside)])
        real = filled[breaks] > filled[starts]
        starts, ends = starts[real], breaks[real]
        line_doc = np.searchsorted(w.bounds, starts, side="right") - 1
        repeated = self._repeat_words(w)
        out = {
            "n_words": n_words,
            "word_chars": _per_doc(w.inside & ((w.data & 0xC0) != 0x80), w.bounds),
            "n_symbols": _per_doc(self.symbol[w.data], w.bounds),
            "n_dup_lines": _repeats(line_doc, w.spans.hashes(starts, ends), rows),
            "n_repeat_words": np.bincount(w.doc[repeated], minlength=rows),
        }
        out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * n_words)
        out["score"] = score
        out["kept"] = ~out["base_failed"] & (score >= self.threshold)
        return out

    def _repeat_words(self, w: Words) -> np.ndarray:
        """Which words lie in a five-word window that its text holds at least twice."""
        covered = np.zeros(len(w.hashes), bool)
        count = len(w.hashes) - WINDOW + 1
        if count <= 0:
            return covered
        key = np.zeros(count, np.uint64)
        for k in range(WINDOW):
            key = spread_bits(key * np.uint64(ODD) + w.hashes[k:k + count])
        at = np.flatnonzero(w.doc[:count] == w.doc[WINDOW - 1:])
        key = spread_bits(key[at] ^ (w.doc[at].astype(np.uint64) * np.uint64(ODD)))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        for k in range(WINDOW):
            covered[twice + k] = True
        return covered


def apply_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Measures, score and verdict of every row of (doc_id, text).

    A null text counts as empty: no words, base_failed, not kept. Equal rows get equal results; a null doc_id stays
    null. An empty table gives no rows. Other columns are not read. Words, lines and windows are compared by 64-bit
    hashes.
    """
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "score": pa.float64()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(ratios, threshold)
        for part in slices(batches, "text"):
            out = rules.measure(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())],
                names=["doc_id", *out])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, filtered where they lie."""
    ratios = log_ratios(docs, labels)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(ratios, threshold)
        for part in slices(batches, "text"):
            yield part.filter(pa.array(rules.measure(part.column("text"))["kept"]))

    return docs.mapInArrow(walk, docs.schema)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict, the raw multinomial being that of all documents."""
    docs = read(spark, sf_dir, "documents")
    return apply_rules(docs, log_ratios(docs, read(spark, sf_dir, "labels")))
