r"""Token-ID output with Elias-Fano document boundaries (operator 4).

File format of a segment, all integers little-endian:

    8 bytes   magic "PLEF0001"
    9 x u64   n documents, first doc's ordinal (unused, 0), universe U (ids in the segment), low bits l,
              id width in bytes, bytes of: doc_id array, low array, high array, select samples
    ...       doc_ids (i64), low array, high array, select samples (u32), ids

Document i owns ids[b(i) : b(i+1)]; the n+1 boundaries are monotone and stored by Elias and
Fano: l = floor(log2(U/(n+1))) low bits packed, high parts in unary in a bit vector of
n+1 + U/2^l bits. Every 64th one's position is sampled, so select(i) looks at few bytes: about
2 + l bits a document instead of a 64-bit table. Ids are stored in 2 bytes where the vocabulary allows.

Null texts are empty, an empty document is the end id alone, rows with a null doc_id come last
(stored as the largest 64-bit integer), repeated ids keep one entry for each row in the order of a hash of their texts, an empty table
gives no segments. Segments are bounded by segment_ids, except that a document is never split. Columns other than
doc_id and text are ignored, whatever their names.

Reading keeps the boundaries encoded: a stretch of documents is found by the sample before it, and only its
bits are decoded and only its ids read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import NO_ID, id_and_text, ids_last, tidied
from pairloom.llm.tokenizer_files import TEXTS, text_encoder
from pairloom.session import scratch

MAGIC = b"PLEF0001"
_HEAD = struct.Struct("<8s9Q")
SAMPLE = 64


class EliasFano:
    """A monotone sequence of n integers in [0, universe]."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.l = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        l = max(0, int(universe // max(n, 1)).bit_length() - 1)
        if l:
            bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, universe, l, low, high, ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        out = 0
        for k in range(self.l):
            bit = i * self.l + k
            out |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value, by the nearest sample and a count of ones from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = at >> 3, at & 7
        word = int(self.high[byte]) >> bit << bit
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        return (pos - i) << self.l | self._low(i)

    def stretch(self, first: int, end: int) -> np.ndarray:
        """Values first to end, exclusive: the first is selected by its sample, and the bits from there to the last are read on."""
        if not 0 <= first <= end <= self.n:
            raise IndexError((first, end))
        if first == end:
            return np.zeros(0, np.int64)
        block, after = first // SAMPLE, -(-end // SAMPLE)
        at = int(self.samples[block])
        stop = int(self.samples[after]) >> 3 if after < len(self.samples) else len(self.high) - 1
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 3 : stop + 1], bitorder="little")) + (at >> 3 << 3)
        ones = ones[np.searchsorted(ones, at) :][first - block * SAMPLE :][: end - first]
        out = (ones - np.arange(first, end)).astype(np.int64) << self.l
        for k in range(self.l):
            bit = np.arange(first, end, dtype=np.int64) * self.l + k
            out |= (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64) << k
        return out


def segment_bytes(doc_ids: list[int], lengths: list[int], ids: bytes, width: int) -> Iterator[bytes]:
    """The parts of a segment file."""
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])
    ef = EliasFano.build(bounds, int(bounds[-1]))
    own = np.asarray(doc_ids, dtype="<i8").tobytes()
    parts = [own, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes()]
    yield _HEAD.pack(MAGIC, len(doc_ids), 0, int(bounds[-1]), ef.l, width, *map(len, parts))
    yield from parts
    yield ids


class Segment:
    """A segment in an open file: its boundaries stay encoded in memory, ids are read where they are asked for."""

    def __init__(self, file):
        self._file = file
        magic, self.n, _, universe, low_bits, self.width, *sizes = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self._doc_ids, at = _HEAD.size, _HEAD.size + sizes[0]
        file.seek(at)
        low, high, samples = (np.frombuffer(file.read(size), np.uint8) for size in sizes[1:])
        self.bounds = EliasFano(self.n + 1, universe, low_bits, low, high, samples.view("<u4"))
        self._ids = at + sum(sizes[1:])

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(self._ids + start * self.width, (end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of document i by select(i) and select(i + 1)."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def stretches(self, documents: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, bounds, ids from the first bound on) of so many documents at a time."""
        for first in range(0, self.n, documents):
            end = min(first + documents, self.n)
            bounds = self.bounds.stretch(first, end + 1)
            yield np.frombuffer(self._read(self._doc_ids + 8 * first, 8 * (end - first)), "<i8"), bounds, self.ids(int(bounds[0]), int(bounds[-1]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bytes of text that are encoded at a time; a longer one makes a block of its own.
BLOCK = 8 << 20


def blocks_of(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[list[int], pa.Array]]:
    """(doc_ids, texts) of several batches with so many bytes of text at most, or of one batch."""
    held, bytes_held = [], 0

    def joined():
        return [x for b in held for x in b.column(0).to_pylist()], pa.concat_arrays([b.column(1) for b in held])

    for batch in batches:
        own = batch.column(1).nbytes
        if held and bytes_held + own > size:
            yield joined()
            held, bytes_held = [], 0
        held.append(batch)
        bytes_held += own
    if held:
        yield joined()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, segment_ids: int = 1 << 22, id_width: int = 2) -> DataFrame:
    """Tokenise documents into segments below folder, in ascending doc_id order.

    Returns the manifest (path, n_docs, n_ids, start): start counts the ids of all
    segments before. Rows are dealt out by ranges of doc_id and encoded where they are stored, so the segments of one task
    follow those of the task before it, and ids lie on disk only there. A task that is run again writes the same bytes under a
    name of its own and moves them into place.
    """
    spark = docs.sparkSession

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        k, own, lengths, body, size = 0, [], [], [], 0

        def flush():
            name = f"{root}/segment-{part:07d}-{k:05d}.plef"
            with files.open_output_stream(f"{name}.{attempt}") as out:
                for piece in segment_bytes(own, lengths, b"".join(body), id_width):
                    out.write(piece)
            files.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "path": [os.path.basename(name)], "n_docs": [len(own)], "n_ids": [size]})

        encoder, end = text_encoder(tokenizer_path, id_width), end_id.to_bytes(id_width, "little")
        for doc_ids, texts in blocks_of(batches):
            for doc_id, ids in zip(doc_ids, encoder.encode(texts, end)):
                own.append(doc_id)
                body.append(ids)
                lengths.append(len(ids) // id_width)
                size += lengths[-1]
                if size >= segment_ids:
                    yield flush()
                    k, own, lengths, body, size = k + 1, [], [], [], 0
        if own:
            yield flush()

    # Repeated rows of a doc_id are told apart by their texts, so that a hot doc_id doesn't meet in one range.
    rows = id_and_text(docs).select(ids_last(F.col("doc_id")).alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    listed = ordered.mapInArrow(tidied(store, TEXTS), "part long, k long, path string, n_docs long, n_ids long")
    listed.write.parquet(f"{folder}/manifest.parquet")
    manifest = spark.read.schema(listed.schema).parquet(f"{folder}/manifest.parquet")
    # One row a task is put in order; segments are counted within their task.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n_part").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("k"))), F.lit(0))
    return manifest.withColumn("within", within).join(offsets, "part").select("path", "n_docs", "n_ids", (F.col("base") + F.col("within")).alias("start"))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{path}") as f:
                    for doc_ids, bounds, ids in Segment(f).stretches():
                        wide = ids.astype("<u4")
                        at = bounds - bounds[0]
                        crcs = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                        own = pa.array(doc_ids, mask=doc_ids == NO_ID)
                        yield pa.RecordBatch.from_arrays([own, pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes and returns (folder, manifest); folder defaults to a new one in the shared folder."""
    folder = folder or scratch(docs.sparkSession, "token-store")
    return folder, write_tokens(docs, folder, tokenizer_path)
