"""Quality of documents by a byte-level convolutional network, in numpy.

A document is overlapping chunks of CHUNK bytes, each shifted by half a chunk, that cover it from end to end.
Filters of WIDTH bytes slide over a chunk with a stride of half a width; each filter's largest response in a
chunk is its feature there. The means of the features over all chunks make one logit and so one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import prepare, read, slices
from tidewater.llm.language import held_out

WIDTH = 16
STRIDE = 8
CHUNK = 512
EMBEDDING = 8
FILTERS = 32
PAD = 256
TRAINING_ROWS = 6000
TRAINING_CHUNKS = 8
EPOCH_STEPS = 600
BATCH = 64
THRESHOLD = 0.3
PARTS = ("embedding", "filters", "bias", "weights", "offset")


def start_values(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embedding": rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING), (WIDTH * EMBEDDING, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weights": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "offset": np.zeros(1, np.float32),
    }


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, steps: int = EPOCH_STEPS,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam on the logistic loss. chunks: rows of CHUNK byte values, sorted by owner, an index into labels."""
    model = start_values(seed)
    if not len(labels):
        return model
    rng = np.random.default_rng(seed)
    first = np.searchsorted(owner, np.arange(len(labels) + 1))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    model["offset"][0] = np.log(share / (1 - share))
    moment = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1):
        docs = rng.integers(0, len(labels), BATCH)
        counts = first[docs + 1] - first[docs]
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        grads = _gradient(model, chunks[rows], np.repeat(np.arange(BATCH), counts), counts, labels[docs])
        rate = 0.01 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in PARTS:
            moment[k] += 0.1 * (grads[k] - moment[k])
            square[k] += 0.001 * (grads[k] ** 2 - square[k])
            model[k] -= (rate * (moment[k] / (1 - 0.9 ** step)) /
                         (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
    return model


def _gradient(model, chunks, doc, counts, labels) -> dict[str, np.ndarray]:
    n, blocks, half = len(chunks), CHUNK // STRIDE, STRIDE * EMBEDDING
    x = model["embedding"][chunks].reshape(n, blocks, half)
    response = x[:, :-1] @ model["filters"][:half] + x[:, 1:] @ model["filters"][half:]
    where = response.argmax(axis=1)
    top = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + model["bias"]
    pooled = np.maximum(top, 0)
    features = np.zeros((len(counts), FILTERS), np.float32)
    np.add.at(features, doc, pooled)
    features /= np.maximum(counts, 1)[:, None]
    logit = features @ model["weights"] + model["offset"][0]
    error = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
    back = (error / np.maximum(counts, 1))[doc, None] * model["weights"] * (top > 0)
    at = where[:, :, None] * STRIDE + np.arange(WIDTH)
    picked = np.take_along_axis(chunks[:, None, :], at, axis=2)
    seen = model["embedding"][picked].reshape(n, FILTERS, WIDTH * EMBEDDING)
    filters = np.einsum("nf,nfk->kf", back, seen, optimize=True)
    inward = (back[:, :, None] * model["filters"].T[None]).reshape(-1, EMBEDDING)
    embedding = np.zeros_like(model["embedding"])
    flat = picked.reshape(-1)
    for k in range(EMBEDDING):
        embedding[:, k] = np.bincount(flat, weights=inward[:, k], minlength=257)
    return {"embedding": embedding, "filters": filters, "bias": back.sum(axis=0),
            "weights": features.T @ error, "offset": np.array([error.sum()])}


def score_texts(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for whole texts; an empty text is one chunk of padding."""
    half_chunk = CHUNK // 2
    raw = [(t or "").encode() for t in texts]
    halves = np.array([max(-(-len(r) // half_chunk), 2) for r in raw])
    ends = np.cumsum(halves)
    data = np.full(int(ends[-1]) * half_chunk, PAD, np.int32)
    for r, end, n in zip(raw, ends.tolist(), halves.tolist()):
        start = (end - n) * half_chunk
        data[start:start + len(r)] = np.frombuffer(r, np.uint8)
    per_half, size = half_chunk // STRIDE, STRIDE * EMBEDDING
    x = model["embedding"][data].reshape(-1, size)
    both = x @ np.concatenate([model["filters"][:size], model["filters"][size:]], axis=1)
    response = both[:, :FILTERS].reshape(-1, per_half, FILTERS)
    response[:, :-1] += both[:, FILTERS:].reshape(-1, per_half, FILTERS)[:, 1:]
    # The window that starts in the last block of a half reaches into the next half of the same chunk.
    bridge = response[:-1, -1] + both[per_half::per_half, FILTERS:]
    inner = response[:, :-1].max(axis=1)
    top = np.maximum(np.maximum(inner[:-1], inner[1:]), bridge) + model["bias"]
    pooled = np.maximum(top, 0)
    inside = np.ones(len(pooled), bool)
    inside[ends[:-1] - 1] = False
    doc = np.repeat(np.arange(len(raw)), halves)[:-1]
    sums = np.stack([np.bincount(doc[inside], weights=pooled[inside, k], minlength=len(raw)) for k in range(FILTERS)], 1)
    logit = sums / (halves - 1)[:, None] @ model["weights"].astype(float) + float(model["offset"][0])
    return 1 / (1 + np.exp(-logit))


def training_chunks(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS,
                    per_document: int = TRAINING_CHUNKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, owners and labels of at most `most` labelled rows, those of smallest hash.

    Only in training, a document is seen by at most `per_document` of its chunks, evenly spaced.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")) \
        .agg(F.max("quality").cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, label, text in zip(batch["_id"], batch["_label"], batch["text"]):
                raw = (text or "").encode()
                steps = max(-(-len(raw) // (CHUNK // 2)) - 1, 1)
                picks = sorted({int(p) for p in np.linspace(0, steps - 1, min(per_document, steps))})
                out += [(doc, label, raw[p * CHUNK // 2:p * CHUNK // 2 + CHUNK]) for p in picks]
            yield pd.DataFrame(out, columns=["doc", "label", "chunk"])

    # At most `most` ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(chosen), "_id").mapInPandas(walk, "doc long, label int, chunk binary")
    held = sorted(map(tuple, rows.collect()))
    chunks = np.full((len(held), CHUNK), PAD, np.uint16)
    for row, (_, _, chunk) in zip(chunks, held):
        row[:len(chunk)] = np.frombuffer(bytes(chunk), np.uint8)
    ids = np.array([d for d, _, _ in held], np.int64)
    unique, owner = np.unique(ids, return_inverse=True)
    first = np.searchsorted(ids, unique)
    return chunks, owner, np.array([held[i][1] for i in first], np.float32)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text): from the text alone, whole.

    Null and empty texts are scored as padding; equal texts score alike; a null doc_id stays null; an empty table
    gives no rows. Other columns are not read.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = score_texts(model, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, score double")


def op4_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a network trained on labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = train(*training_chunks(docs, read(spark, sf_dir, "labels").where(~held_out(0, 5))))
    return score(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
