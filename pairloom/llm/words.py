"""Words of whole texts as arrays: byte classes, boundaries and 64-bit hashes over Arrow buffers.

Everything works on UTF-8 bytes with NumPy, a few megabytes at a time, so the cost is some
nanoseconds a byte and memory doesn't follow the table or a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _wrapping_powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = _wrapping_powers(_BASE, 4096)
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but [\x20\x09-\x0D].
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, limit: int = 2_000_000, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """(first, end) rows of about limit bytes and at most so many rows; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1), i + rows, n)
        yield i, j
        i = j


class Words:
    """Words of a block of texts: byte starts and ends within data, hash, and bounds of each text's words."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, hashes: np.ndarray):
        self.data, self.starts, self.ends, self.bounds, self.hashes = data, starts, ends, bounds, hashes

    @property
    def rows(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = int(sizes.sum())
    inside = np.arange(total) - np.repeat(first, sizes)
    codes = _BYTE_CODES[data[np.repeat(starts, sizes) + inside]]
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _wrapping_powers(_BASE, longest)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(codes * powers[inside], first)
        return mix(sums + (sizes.astype(np.uint64) + np.uint64(salt)) * _GOLD)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, step: int = 200_000) -> np.ndarray:
    """A hash of each span's bytes, a bounded number of spans at a time; 0 for empty spans."""
    full = ends > starts
    if not full.all():
        out = np.zeros(len(starts), np.uint64)
        out[full] = hash_spans(data, starts[full], ends[full], salt, step)
        return out
    if len(starts) <= step:
        return _hash_spans(data, starts, ends, salt)
    return np.concatenate([_hash_spans(data, starts[i : i + step], ends[i : i + step], salt) for i in range(0, len(starts), step)])


def hash_word(word: str, salt: int = 0) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]), salt)[0]) if len(raw) else 0


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, fold: np.ndarray | None = LOWER, hashed: bool = True) -> Words:
    """Maximal runs of the byte class in each text; offsets may start inside data."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = data[lo:hi]
    if fold is not None:
        body = fold[body]
    inside = kind[body]
    edges = offsets - lo
    before = np.empty(len(body) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[edges] = False  # a text starts anew
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(body) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    after[edges] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    hashes = hash_spans(body, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(body, starts, ends, np.searchsorted(starts, edges), hashes)


def code_points(body: np.ndarray) -> np.ndarray:
    """Before each byte: the number of code points up to there (length n + 1)."""
    return np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
