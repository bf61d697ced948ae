"""Sum-of-squares packing of tokenised documents into sequences (operator 10).

Each document is its ids and an end id; longer ones are cut into pieces of the capacity, the
last piece may be shorter. N(g) counts the open sequences with a gap of g. A piece goes where the sum of
N(g)^2 becomes smallest: moving a sequence from gap g to g - s changes it by
-2 N(g) + 1 + 2 N(g - s) + 1 (the latter for g - s > 0), a new sequence adds 2 N(c - s) + 1; of
equal places the tightest wins, then an open one. Pieces come by falling length, so long ones open
sequences and short ones even the gaps out.

Pieces are packed in groups of about GROUP rows dealt out by hash: a group leaves at most some
part-filled sequences, which is a small share of tens of thousands. Only (doc_id, piece,
length, crc) is moved, never ids. Full pieces are sequences of their own.

Null texts are empty and hold the end id alone. Repeated rows and rows without a doc_id are packed each; an empty table
gives no sequences; a text of any length is cut into pieces. Columns other than doc_id and text are ignored, whatever their names. A piece's place is a function of the group's rows, so a task run again agrees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import id_and_text, tidied
from pairloom.llm.tokenizer_files import TOKENIZERS, folds_letters, tokenizers_encoder
from pairloom.llm.wordcache import MAX_ENTRIES
from pairloom.session import materialize

CAPACITY = 2048
GROUP = 100_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False, entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian u32, if asked for) of each piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fold = tokenizers_encoder(tokenizer_path, entries=entries), folds_letters(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode_words(batch.column(1).to_pylist(), fold)):
                own = memoryview(own + end)
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *[bytes(part)] * ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return id_and_text(docs).mapInArrow(tidied(run, TOKENIZERS), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


class SumOfSquares:
    """Places pieces one by one; sequences are numbered from 0."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self._count = np.zeros(capacity + 1, np.int64)
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset)"""
        c, count = self.capacity, self._count
        gaps = size + np.flatnonzero(count[size:])
        if len(gaps):
            left = gaps - size
            change = -2 * count[gaps] + np.where(left > 0, 2 * count[left] + 2, 1)
            best = int(np.argmin(change))
            anew = 2 * int(count[c - size]) + 1 if size < c else 0
            if change[best] <= anew:
                gap = int(gaps[best])
                own = self._open[gap].pop()
                count[gap] -= 1
                self._put(own, gap - size)
                return own, c - gap
        own, self.n = self.n, self.n + 1
        self._put(own, c - size)
        return own, 0

    def _put(self, own: int, gap: int) -> None:
        if gap:
            self._open[gap].append(own)
            self._count[gap] += 1


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length."""
    names = [f.name for f in found.schema.fields]
    rows = found.withColumn("__row", F.monotonically_increasing_id())
    n_groups = max(1, -(-found.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("__row", "ascending")])
        packer, places = SumOfSquares(capacity), []
        for size in table.column("length").to_pylist():
            places.append(packer.place(size))
        sequence, offset = zip(*places)
        table = table.select(names).append_column("sequence_id", pa.array([base + x for x in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    # A row number makes equal rows differ, so a repeated document doesn't land in one group.
    return rows.repartition(n_groups, F.xxhash64("doc_id", "piece", "__row")).mapInArrow(tidied(run), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, entries: int = MAX_ENTRIES) -> DataFrame:
    """Pieces are written once to the shared folder, counted, and packed. Fewer entries of the encoder's memo take less memory and more time."""
    return pack(materialize(pieces(docs, tokenizer_path, capacity, entries=entries), "pieces"), capacity)
