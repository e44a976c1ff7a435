"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A record is the payload's length (8 bytes), the masked CRC-32 of those 8 bytes, the payload, and the masked
CRC-32 of the payload, all little-endian. A payload is the doc_id (8 bytes)
and the ids (2 bytes each where the vocabulary allows it, else 4). The index is a Parquet table (doc_id, part,
file, offset, n_tokens, width) and is
the manifest as well: a task names its file anew at each attempt, so a file left by a lost attempt is in no index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import prepare, read, slices
from tidewater.llm.tokens import shared_encoder, vocabulary
from tidewater.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    """CRC-32 of the data, turned by 15 bits and shifted by a constant, so that checksums of checksums differ."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The payload as a whole record."""
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def _opened(folder: str):
    """File system and path of a folder URI; any store Arrow knows, local disks included."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))


def write_records(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Write (doc_id, text) in ascending doc_id order under `folder`; returns the index table.

    Every file holds one range of doc_ids, sorted; files of later ranges have later part numbers. A null text is
    an empty sequence: its record holds the end id alone. Repeated rows give repeated records; a null doc_id
    is written first, as the smallest long. An empty table gives an empty index. Other columns are not read.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, root = _opened(folder)
        part = TaskContext.get().partitionId()
        name, at, out = f"part-{part:06d}-{uuid.uuid4().hex}.records", 0, None
        encoder = shared_encoder(vocabulary_path, byte_level=True, width=width)
        end = end_id.to_bytes(width, "little")
        try:
            for rows in slices(batches, "text"):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                ids = [encoder.encode(t) + end for t in rows.column("text").to_pylist()]
                names = rows.column("doc_id").to_pylist()
                records = [frame(struct.pack("<q", d) + i) for d, i in zip(names, ids)]
                starts = at + np.cumsum([0, *map(len, records)])
                out.write(b"".join(records))
                at = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array([name] * len(ids)),
                     pa.array(starts[:-1], pa.int64()), pa.array([len(i) // width for i in ids], pa.int64()),
                     pa.array([width] * len(ids), pa.int32())],
                    names=["doc_id", "part", "file", "offset", "n_tokens", "width"])
        finally:
            if out is not None:
                out.close()

    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocabulary_path).get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    spark = prepare(docs.sparkSession)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                          F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(walk, "doc_id long, part int, file string, offset long, n_tokens long, width int")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, start, ids_crc32) of every record of the indexed files, read back and verified.

    `start` counts the ids of all documents before. A checksum that does not fit raises an error. Files are read
    in small parts, so memory is bounded by the longest record.
    """
    files = index.groupBy("part", "file", "width").agg(F.sum("n_tokens").alias("tokens"))
    # One row per file: bounded by the number of write tasks.
    held = sorted(map(tuple, files.collect()))
    before = np.cumsum([0, *(tokens for *_, tokens in held)]).tolist()
    listed = [(file, width, start) for (_, file, width, _), start in zip(held, before)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for file, width, start in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "start"))):
                with store.open_input_stream(f"{root}/{file}") as source:
                    for payloads in _payloads(source):
                        ids = [np.frombuffer(p, f"<u{width}", offset=8).astype("<u4") for p in payloads]
                        counts = [len(i) for i in ids]
                        starts = start + np.cumsum([0, *counts])
                        start = int(starts[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([struct.unpack_from("<q", p)[0] for p in payloads], pa.int64()),
                             pa.array(starts[:-1], pa.int64()), pa.array(counts, pa.int64()),
                             pa.array([zlib.crc32(i) for i in ids], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(listed, "file string, width int, start long")
    return table.repartition(len(listed)).mapInArrow(walk, schema)


def _payloads(source) -> Iterator[list[bytes]]:
    """Verified payloads of a record stream, in groups of about READ_BYTES."""
    rest, done = b"", False
    while not done:
        read_now = source.read(READ_BYTES)
        done = not read_now
        rest += read_now
        at, payloads, lengths, seals = 0, [], [], []
        while len(rest) - at >= 12:
            size = struct.unpack_from("<Q", rest, at)[0]
            if len(rest) - at < size + 16:
                break
            lengths.append(rest[at:at + 8])
            payloads.append(rest[at + 12:at + 12 + size])
            seals.append(struct.unpack_from("<I", rest, at + 8) + struct.unpack_from("<I", rest, at + 12 + size))
            at += size + 16
        if payloads:
            if seals != list(zip(map(masked, lengths), map(masked, payloads))):
                raise ValueError("a record does not fit its checksum")
            yield payloads
        rest = rest[at:]
    if rest:
        raise ValueError("a record file ends within a record")


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the index rows `wanted`, in any order: shuffled reads by offset, one record each."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pydict()
            payloads = []
            for file, offset, count, width in zip(rows["file"], rows["offset"], rows["n_tokens"], rows["width"]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                record = source.read_at(count * width + 24, offset)
                payload = record[12:-4]
                if struct.unpack_from("<I", record, len(record) - 4)[0] != masked(payload):
                    raise ValueError("a record does not fit its checksum")
                payloads.append((struct.unpack_from("<q", payload)[0],
                                 np.frombuffer(payload, f"<u{width}", offset=8).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in payloads], pa.int64()), pa.array([i for _, i in payloads], pa.list_(pa.int64()))],
                names=["doc_id", "ids"])

    return wanted.select("file", "offset", "n_tokens", "width").mapInArrow(walk, "doc_id long, ids array<long>")


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as records, and read back."""
    folder = scratch_path(spark, "records")
    index = write_records(read(spark, sf_dir, "documents"), folder, vocabulary(VOCABULARY))
    return read_records(spark, folder, index)
