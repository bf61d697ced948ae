r"""Encoding by memoised chunks: exact for tokenizers whose splitter never looks across a chunk's edges.

A corpus repeats its words. Encoding each distinct chunk once and joining the stored ids is
an order of magnitude cheaper than running the merges over the whole text again, and the
result is the same as long as each cut is one that the tokenizer's own splitter makes.

For patterns in which white space occurs only as the first character of a piece or in a piece of its own, a piece
always ends before a run of white space; so a chunk is such a run and the word behind it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain
from string import punctuation

#: A run of white space (none at a text's start) with what follows up to the next; also a last run alone.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:[\S\x1c-\x1f]+|\Z)")
#: White space but space and line feed.
_ODD = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　]")
#: Python's split() also cuts at these controls, which Unicode doesn't call white space.
_NOT_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
_BLANK = " \n"
_WIDE = re.compile("[^\x00-\xff]")


def cut_plainly(text: str) -> list[str] | None:
    """Chunks of a text whose words stand between single spaces or at most two line feeds; None for other texts.

    A chunk's space is left out; one after a line feed keeps that. The text is taken to follow a line feed, so its
    first chunk begins with one. Of two line feeds before a word each is a piece of its own, as the pattern has it.
    """
    if text[0] in _BLANK or text[-1] in _BLANK or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or _ODD.search(text):
        return None
    return f"\n{text}".replace("\n", " \n")[1:].split(" ")


def words_between_spaces(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _NOT_SPACE.search(text) else text.split()


def bare_word(chunk: str) -> str:
    """The chunk without its last ASCII punctuation, where that is surely a piece of its own: after a Latin-1 letter, and with no "<", which may begin a special token. Else the chunk."""
    word = chunk.rstrip(punctuation)
    return word if 0 < len(word) < len(chunk) and "<" not in chunk and word[-1] < "\u0100" and word[-1].isalpha() else chunk


#: Chunks that a worker keeps, in each of two generations; some 200 bytes each.
MAX_ENTRIES = 600_000


class _Memo:
    """Two generations of at most n entries each: what was used in the last generation survives the next change.

    fixed holds chunks that are known from the start and never go.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], lead: str, n: int, fixed: dict[str, bytes] | None = None):
        self._encode_many, self._lead, self._n, self._fixed = encode_many, lead, n, fixed
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}

    def look_up(self, rows: list[list[str]]) -> dict[str, bytes]:
        """The ids of each chunk of the rows. The large memo is asked once a distinct chunk; the small result stays near the processor."""
        if len(self._young) > self._n:
            self._young, self._old = {}, self._young
        keys = list(set(chain.from_iterable(rows)))
        values = list(map((self._young if self._fixed is None else self._fixed).get, keys))
        for known in (self._old,) if self._fixed is None else (self._young, self._old):
            if known and None in values:
                for i in [i for i, ids in enumerate(values) if ids is None]:
                    ids = values[i] = known.get(keys[i])
                    if ids is not None and known is self._old:
                        self._young[keys[i]] = ids
        if None in values:
            places = [i for i, ids in enumerate(values) if ids is None]
            fresh = self._encode([keys[i] for i in places])
            self._young.update(fresh)
            for i in places:
                values[i] = fresh[keys[i]]
        return dict(zip(keys, values))

    def _led(self, chunk: str) -> str:
        return chunk if chunk[:1] == "\n" else self._lead + chunk

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of new chunks, and of the bare words of those that end in marks."""
        wanted, marked = [], {}
        for x in chunks:
            w = x if x[-1].isalpha() else bare_word(x)
            if w is x:
                wanted.append(x)
            else:
                marked[x] = w
        known = {}
        if marked:
            known = {w: self._young.get(w) or self._old.get(w) for w in set(marked.values())}
            own = set(wanted)
            wanted += [w for w, ids in known.items() if ids is None and w not in own]
            if len(self._marks) > self._n:
                self._marks.clear()
            lacking = list({x[len(w) :] for x, w in marked.items()}.difference(self._marks))
            self._marks.update(zip(lacking, self._encode_many(lacking)))
        fresh = dict(zip(wanted, self._encode_many([*map(self._led, wanted)] if self._lead else wanted)))
        for x, w in marked.items():
            fresh[x] = (known[w] or fresh[w]) + self._marks[x[len(w) :]]
        return fresh


class ChunkEncoder:
    """Chunks to little-endian bytes of their ids, about twice max_entries kept at a time."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], max_entries: int = MAX_ENTRIES, fixed: dict[str, bytes] | None = None):
        self._raw = _Memo(encode_many, "", max_entries // 4)
        self._spaced = _Memo(encode_many, " ", max_entries, fixed)
        self._words = _Memo(encode_many, "", max_entries)
        (feed,) = encode_many(["\n"])
        self._feed = len(feed)

    def encode_spaced(self, texts: list[str]) -> Iterable[bytes]:
        """For splitters that hang a space to the word after it."""
        for block in blocks_of(texts):
            plain = [cut_plainly(t) if t else [] for t in block]
            known = self._spaced.look_up([c for c in plain if c])
            other = {i: _CHUNK.findall(block[i])[:-1] for i, c in enumerate(plain) if c is None}
            raw = self._raw.look_up(list(other.values())) if other else {}
            for i, c in enumerate(plain):
                yield b"".join(map(known.__getitem__, c))[self._feed :] if c is not None else b"".join(map(raw.__getitem__, other[i]))

    def encode_words(self, texts: list[str], fold: bool = False) -> Iterable[bytes]:
        """For splitters that drop white space: words stand alone. With fold, for tokenizers that take letters as lower case: texts of Latin-1, where that is one character for one, are folded first."""
        for block in blocks_of(texts):
            cut = [words_between_spaces(t.lower() if fold and not _WIDE.search(t) else t) for t in block]
            known = self._words.look_up(cut)
            for c in cut:
                yield b"".join(map(known.__getitem__, c))


def blocks_of(texts: list[str], chars: int = 2_000_000) -> Iterable[list[str]]:
    """Blocks of bounded size; a longer text makes a block of its own."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block
