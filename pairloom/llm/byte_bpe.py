r"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 7).

1. Every text is cut into chunks where the splitting pattern always cuts. Chunks that a block of texts has more
   than once are counted over the whole corpus; those that the corpus has most often, at most MAX_WORDS, are its
   dictionary (a cut by count: chunks of equal count are all in or all out).
2. The dictionary's distinct pieces are replayed, dealt out over the cluster. An inverted index takes each token
   pair to its positions in all words; a word's pair of lowest rank is merged wherever it stands, and
   the merge puts only its two neighbours' new pairs into the index. Words don't
   depend on each other, so each round merges the next pair in rank order of every word at once.
3. The dictionary, of bounded size, goes to all workers, which look chunks up. Chunks outside it are replayed on the spot by the same rule.

A merge can make a pair of lower rank than its own, which must go before the word's other places of that pair. Ranks for
which this can happen are known from the vocabulary; for them only the word's first place is merged. Long pieces have so many
ranks that rounds would not pay: they replay ranks from a heap, over the same index from pair to positions.
A piece that is itself in the vocabulary is its id, as in the public library.

Null texts are empty; an empty text has no ids, and its digests are those of no bytes. Repeated rows give repeated rows,
an empty table an empty result; very long texts and pieces are encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import id_and_text, keep_in_worker, tidied
from pairloom.llm.wordcache import ChunkEncoder, blocks_of, cut_plainly
from pairloom.session import materialize

#: Chunks of the corpus dictionary at most, and finished chunks that a worker keeps beside it.
MAX_WORDS = 400_000
KEPT = 200_000
#: Pieces of more bytes are replayed from a heap; bytes of shorter ones that are replayed together.
LONG, TOGETHER = 256, 2_000_000
_NONE = np.int64(2**31)
_SHIFT = np.int64(20)


class MergeReplay:
    """Ranks of byte strings, ids equal ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        if len(self.pieces) >= 1 << int(_SHIFT):
            raise ValueError("too many ranks")
        byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in byte:
            raise ValueError("the vocabulary lacks single bytes")
        self._byte = np.array(byte, np.int64)
        self._bytes = np.array([ranks.get(bytes([a, b]), int(_NONE)) for a in range(256) for b in range(256)], np.int64)
        pairs, early = {}, np.zeros(len(self.pieces), bool)
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i], -1), ranks.get(piece[i:], -1)
                if a >= 0 and b >= 0:
                    pairs[a << int(_SHIFT) | b] = rank
                # What is made of a or b may come before it.
                if a > rank:
                    early[a] = True
                if b > rank:
                    early[b] = True
        self._rank_of, self._early = pairs, early
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, looked up once a distinct pair of the index."""
        keys, places = np.unique(left << _SHIFT | right, return_inverse=True)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)[places]

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words of two bytes or more."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        ids = self._byte[data]
        rank = np.full(len(ids), _NONE)
        rank[:-1] = self._bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[np.cumsum(sizes) - 1] = _NONE  # a word's last token has no pair
        done_owner, done_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(rank, starts)
            going = np.repeat(lowest < _NONE, counts)
            if not going.all():
                done_owner.append(owner[~going])
                done_ids.append(ids[~going])
                owner, ids, rank, lowest_each = owner[going], ids[going], rank[going], np.repeat(lowest, counts)[going]
                if not len(ids):
                    break
            else:
                lowest_each = np.repeat(lowest, counts)
            hits = np.flatnonzero(rank == lowest_each)
            # Of overlapping places the first, third, ... are merged; of ranks that can be overtaken a word's first place.
            fresh = np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]])])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            first = np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])
            hits = hits[((np.arange(len(hits)) - run) % 2 == 0) & (first | ~self._early[rank[hits]])]
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = np.cumsum(keep)[hits] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = _NONE
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            touched = touched[touched + 1 < len(ids)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._pair_ranks(ids[touched], ids[touched + 1])
        owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _heap(self, word: bytes) -> list[int]:
        """The ids of one long piece."""
        of, shift = self._rank_of, int(_SHIFT)
        slots = self._byte[np.frombuffer(word, np.uint8)].tolist()
        ahead, behind = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        index: dict[int, list[int]] = {}  # token pair to its positions
        pending: dict[int, list[int]] = {}  # rank to the pairs of that rank
        heap: list[int] = []

        def note(p: int) -> None:
            pair = slots[p] << shift | slots[ahead[p]]
            rank = of.get(pair)
            if rank is None:
                return
            if pair in index:
                heappush(index[pair], p)
                return
            index[pair] = [p]
            if rank in pending:
                pending[rank].append(pair)
            else:
                pending[rank] = [pair]
                heappush(heap, rank)

        for p in range(len(word) - 1):
            note(p)
        while heap:
            rank = heap[0]
            pairs = pending[rank]
            # The first place of any pair of this rank; one at a time, since a merge may bring a lower rank.
            pair = min(pairs, key=lambda x: index[x][0]) if len(pairs) > 1 else pairs[0]
            p = heappop(index[pair])
            if not index[pair]:
                del index[pair]
                pairs.remove(pair)
                if not pairs:
                    del pending[rank]
                    heappop(heap)
            q = ahead[p] if slots[p] >= 0 else -1
            if q < 0 or slots[p] << shift | slots[q] != pair:
                continue
            after, before = ahead[q], behind[p]
            slots[p], slots[q], ahead[p] = rank, -1, after
            if after >= 0:
                behind[after] = p
                note(p)
            if before >= 0:
                note(before)
        out, p = [], 0
        while p >= 0:
            out.append(slots[p])
            p = ahead[p]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian u32, all pieces replayed together."""
        out = [b""] * len(words)
        short: list[int] = []
        size = 0

        def replay() -> None:
            ids, bounds = self._rounds([words[i] for i in short])
            data, ends = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
            for k, i in enumerate(short):
                out[i] = data[ends[k] : ends[k + 1]]

        for i, (w, rank) in enumerate(zip(words, map(self.ranks.get, words))):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = np.array(self._heap(w), "<u4").tobytes()
            elif w:
                short.append(i)
                size += len(w)
                if size > TOGETHER:
                    replay()
                    short, size = [], 0
        if short:
            replay()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


#: Stand-ins of the three classes that the pattern tells apart, and the classes as the regex module has them.
_STAND_INS = {"letter": "\u0138", "number": "\u00b2", "other": "\u00a7"}
_CLASSES = {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}


@lru_cache(maxsize=2)
def class_differences(pattern: str) -> dict[int, str]:
    """Code points that the tiktoken library's splitter takes for another class than the regex module does, with a stand-in of the class it takes them for.

    The two follow different versions of Unicode. The library doesn't show its splits; so each code point is encoded between
    letters, and before an apostrophe and s, with a vocabulary that merges only there. Only code points that the module calls letters or
    numbers, and those that it has no class for, are asked about; no version of Unicode assigns any between U+40000 and U+DFFFF.
    """
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks[b"'s"] = 256
    joint = {bytes([b, 97]): 257 + i for i, b in enumerate(range(128, 192))}
    own = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks | joint, special_tokens={})
    asked = regex.compile(r"[\p{L}\p{N}\p{Cn}]")
    every = [c for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x40000), range(0xE0000, 0x110000))) if asked.match(c)]
    kinds = {k: regex.compile(p) for k, p in _CLASSES.items()}
    out = {}
    for i in range(0, len(every), 20_000):
        part = every[i : i + 20_000]
        # Lines are apart from each other: the id of a line feed ends each.
        within, before = (own.encode_ordinary("".join(f"{a}{c}{z}\n" for c in part)) for a, z in (("a", "a"), ("", "'s")))
        split = lambda ids: np.split(ids, np.flatnonzero(ids == 10) + 1)[: len(part)]
        for c, x, y in zip(part, split(np.array(within)), split(np.array(before))):
            kind = "letter" if (x > 256).any() else "number" if (y == 256).any() else "other"
            if not kinds[kind].match(c):
                out[ord(c)] = _STAND_INS[kind]
    return out


def _splitter(pattern: str, differences: dict[int, str]):
    """A function from a string to the pattern's matches, as the tiktoken library has them."""
    import regex

    compiled = regex.compile(pattern)
    odd = regex.compile("[" + "".join(f"\\U{c:08x}" for c in differences) + "]") if differences else None

    def split(text: str) -> list[str]:
        if odd is None or text.isascii() or not odd.search(text):
            return compiled.findall(text)
        return [text[m.start() : m.end()] for m in compiled.finditer(text.translate(differences))]

    return split


@lru_cache(maxsize=2)
def merge_replay(path: str) -> MergeReplay:
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _piecewise(path: str, pattern: str, differences: dict[int, str]):
    """encode_many of a ChunkEncoder: distinct pieces of the chunks, replayed together."""
    replay, split = merge_replay(path), _splitter(pattern, differences)

    def encode_many(chunks: list[str]) -> Iterator[bytes]:
        cut = list(map(split, chunks))
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        known = dict(zip(distinct, replay.encode_words([w.encode() for w in distinct])))
        return [known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c]) for c in cut]

    return encode_many


def corpus_chunks(docs: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(chunk, n): the chunks that stand most often in all texts, at most so many; chunks of equal count are all in or all out.

    A block of texts tells only of chunks that it has more than once, summed before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column(0).to_pylist(), 8_000_000):
                seen = Counter(chain.from_iterable(c for c in (cut_plainly(t) for t in block if t) if c))
                often = {x: n for x, n in seen.items() if n > 1 and len(x) <= LONG}
                yield pa.RecordBatch.from_arrays([pa.array(often.keys(), pa.string()), pa.array(often.values(), pa.int64())], ["chunk", "n"])

    told = id_and_text(docs).select("text").mapInArrow(tidied(count), "chunk string, n long")
    summed = materialize(told.groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")
    by_count = summed.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect()  # at most 10,000 rows
    least, total = 10_001, 0
    for r in by_count:
        total += r.m
        if total > most:
            break
        least = r.n
    return summed.filter(F.col("n") >= least)


def corpus_dictionary(docs: DataFrame, path: str, pattern: str, most: int = MAX_WORDS) -> bytes:
    """The corpus's most frequent chunks with their ids, replayed once each; an Arrow stream of at most `most` rows."""
    differences = class_differences(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many = _piecewise(path, pattern, differences)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode_many([c if c[0] == "\n" else " " + c for c in chunks]), pa.binary())], ["chunk", "ids"])

    found = corpus_chunks(docs, most).select("chunk").mapInArrow(tidied(run), "chunk string, ids binary").toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as to:
        to.write_table(found)
    return out.getvalue().to_pybytes()


_ENCODERS: dict[tuple, ChunkEncoder] = {}
#: Name under which a worker keeps the encoder.
ENCODER = "byte bpe"


def _encoder(path: str, pattern: str, differences: dict[int, str], key: str, stream) -> ChunkEncoder:
    """The worker's encoder over a dictionary, kept until another one comes."""
    keep_in_worker(ENCODER, _ENCODERS.clear)
    if (path, pattern, key) not in _ENCODERS:
        _ENCODERS.clear()
        found = pa.ipc.open_stream(stream()).read_all()
        fixed = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        _ENCODERS[path, pattern, key] = ChunkEncoder(_piecewise(path, pattern, differences), KEPT, fixed)
    return _ENCODERS[path, pattern, key]


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, ids (little-endian u32 binary); with digests: doc_id, n_tokens, ids_sha256, decoded_sha256 of ids decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_dictionary(docs, path, pattern))  # at most MAX_WORDS chunks of at most LONG characters
    differences, key = class_differences(pattern), uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, replay = _encoder(path, pattern, differences, key, lambda: shared.value), merge_replay(path)
        for batch in batches:
            found = encoder.encode_spaced(batch.column(1).to_pylist())
            if not digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.binary())], ["doc_id", "ids"])
                continue
            n, own, back = [], [], []
            for ids in found:
                n.append(len(ids) // 4)
                own.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(replay.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(tidied(encode, ENCODER), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of the ids column; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = merge_replay(path)
        for batch in batches:
            back = [replay.decode(np.frombuffer(x, "<u4")) if x is not None else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(decode), "doc_id long, bytes binary")
