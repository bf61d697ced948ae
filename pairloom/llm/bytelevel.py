r"""Ids of whole texts by a byte-level tokenizer: each distinct piece is encoded once.

Texts stay in Arrow's buffers. They are cut, counted and put together again by array operations; Python sees distinct pieces only.

The splitter's pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+. Texts are cut only where it
surely cuts: between ASCII characters of different kinds, before white space, before the last of several white
spaces that a word follows, and after one that is no space. An apostrophe stays with a letter behind it, and a
character beyond ASCII with its neighbours that are no ASCII white space; so a part may hold several pieces, which the library cuts. No part ends in
white space that goes on in the text, so the library cuts a part as it cuts the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes: beyond ASCII, such that may begin white space, letter, digit, other, apostrophe, white space beyond ASCII, ASCII white space but space, space.
_FAR, _LEAD, _LETTER, _DIGIT, _OTHER, _QUOTE, _FAR_BLANK, _BLANK, _SPACE = range(9)
_LEADS = b"\xc2\xe1\xe2\xe3"
#: Cut before the second byte's character if it is the last of its white space and a word follows.
_LAST = 2


def _kind(byte: int) -> int:
    if byte >= 0x80:
        return _LEAD if byte in _LEADS else _FAR
    c = chr(byte)
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _SPACE if c == " " else _BLANK if c in "\t\n\v\f\r" else _OTHER


def _rule(a: int, b: int) -> int:
    """Whether a text is cut between bytes of these kinds."""
    if b >= _BLANK:
        return _LAST if a >= _FAR_BLANK else 1
    if a == _BLANK:
        return b != _FAR_BLANK
    if a == _SPACE or min(a, b) <= _LEAD or _FAR_BLANK in (a, b) or (a, b) == (_QUOTE, _LETTER):
        return 0
    return min(a, _OTHER) != min(b, _OTHER)


_KINDS = bytes(map(_kind, range(256)))
_RULES = bytes(_rule(x >> 4, x & 15) if max(x >> 4, x & 15) <= _SPACE else 0 for x in range(256))


def _mark_far_blanks(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """kinds, in which the bytes of white space beyond ASCII are told from others."""
    leads = np.flatnonzero(kinds == _LEAD)
    if not len(leads):
        return kinds
    a, b, c = (data[np.minimum(leads + k, len(data) - 1)] for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    three |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    if not (two | three).any():
        return kinds
    kinds = kinds.copy()
    for k in range(3):
        kinds[leads[three | two if k < 2 else three] + k] = _FAR_BLANK
    return kinds


def cut_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts of texts that lie one behind another in UTF-8, and the end; text i is data[offsets[i] : offsets[i + 1]]."""
    size = len(data)
    kinds = _mark_far_blanks(data, np.frombuffer(data.tobytes().translate(_KINDS), np.uint8))
    cut = np.zeros(size + 1, np.uint8)
    cut[1:size] = np.frombuffer((kinds[:-1] << 4 | kinds[1:]).tobytes().translate(_RULES), np.uint8)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    last = np.flatnonzero(cut == _LAST)
    cut[last] = ~edge[last + 1] & (kinds[np.minimum(last + 1, size - 1)] < _FAR_BLANK)
    cut[edge] = 1
    return np.flatnonzero(cut)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets from 0) of strings without nulls."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WholeEncoder:
    """Each text by a call of the library: for tokenizers with another splitter."""

    def __init__(self, encode_whole: Callable[[list[str]], Iterable[bytes]]):
        self._encode_whole = encode_whole

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        return [ids + end for ids in self._encode_whole(texts.to_pylist())]


class PartEncoder:
    """Texts to bytes of their ids; parts are kept in two generations of at most about n and those of one call each.

    A text with the string of an added token, at which the library cuts before it splits, is encoded whole.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], encode_whole: Callable[[list[str]], Iterable[bytes]], added: list[str], n: int):
        self._encode_many, self._n = encode_many, n
        self._whole = WholeEncoder(encode_whole)
        self._added = added
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        if len(self._young) > self._n:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        ids = list(map(young.get, parts))
        lacking = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            x = old.get(parts[i])
            if x is None:
                lacking.append(i)
            else:
                ids[i] = young[parts[i]] = x
        if lacking:
            for i, x in zip(lacking, self._encode_many([parts[i].decode() for i in lacking])):
                ids[i] = young[parts[i]] = x
        return ids

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """The ids of each text, none of which is null, with end behind them."""
        if not len(texts):
            return []
        data, offsets = _buffers(texts)
        every = memoryview(data).tobytes()
        found = [x for x in self._added if x.encode() in every]
        if found:
            apart = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in found])
            if apart.any():
                whole, rest = (iter(e.encode(texts.filter(pa.array(mask)), end)) for e, mask in ((self._whole, apart), (self, ~apart)))
                return [next(whole if x else rest) for x in apart]
        bounds = cut_bounds(data, offsets)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        known = self._look_up(parts.dictionary.to_pylist())
        # The end is a part of its own behind each text's last.
        first = np.searchsorted(bounds, offsets)
        places = np.insert(parts.indices.to_numpy(), first[1:], len(known))
        _, at, ids = pa.array([*known, end], pa.large_binary()).take(pa.array(places)).buffers()
        at, ids = np.frombuffer(at, np.int64)[first + np.arange(len(first))].tolist(), memoryview(ids)
        return [bytes(ids[a:b]) for a, b in zip(at, at[1:])]
