"""Encoders from public vocabulary files, one per Python worker."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from pairloom.llm.bytelevel import PartEncoder, WholeEncoder
from pairloom.llm.tables import keep_in_worker
from pairloom.llm.wordcache import MAX_ENTRIES, ChunkEncoder

TOKENIZERS = "tokenizers"
TEXTS = "tokenizers, whole texts"
#: Strings that are encoded in one call.
CALL = 10_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batch_encoder(path: str, width: int = 4, specials_as_text: bool = False) -> Callable[[list[str]], list[bytes]]:
    """A function from strings to little-endian bytes of their ids, by the tokenizers library.

    Short strings are joined by a special token's string, at which the library cuts a text before it
    normalises or splits it, and encoded in one call; the ids are cut at that token's id again. As in the library's
    own call with add_special_tokens=False, a special token's string within a text is its id;
    with specials_as_text it is ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    plain = tok if not specials_as_text else Tokenizer.from_file(path)
    plain.encode_special_tokens = specials_as_text
    own = [t for t in sorted(tok.get_added_tokens_decoder().items()) if t[1].special and not (t[1].normalized or t[1].lstrip or t[1].rstrip or t[1].single_word)]
    kind = np.dtype(f"<u{width}")
    mark = own[0][1].content if own else None
    mark_id = own[0][0] if own else -1

    def alone(strings: list[str]) -> Iterator[bytes]:
        for e in plain.encode_batch_fast(strings, add_special_tokens=False):
            yield np.asarray(e.ids, kind).tobytes()

    def joined(strings: list[str]) -> list[bytes]:
        (found,) = tok.encode_batch_fast([mark.join(strings)], add_special_tokens=False)
        ids = np.asarray(found.ids, kind)
        ends = [*(np.flatnonzero(ids == mark_id) * width).tolist(), len(ids) * width]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(end + width for end in ends)], ends)]

    # Every string of a special token begins with one of these.
    suspects = sorted({t.content[:1] for _, t in tok.get_added_tokens_decoder().items()})

    def encode_many(strings: list[str]) -> list[bytes]:
        every = "".join(strings)
        if mark is None or any(c in every for c in suspects):
            out: list = [None] * len(strings)
            apart = [i for i, x in enumerate(strings) if mark is None or any(c in x for c in suspects)]
            for at in range(0, len(apart), 256):
                for i, ids in zip(apart[at : at + 256], alone([strings[i] for i in apart[at : at + 256]])):
                    out[i] = ids
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, ids in zip(rest, encode_many([strings[i] for i in rest]) if rest else ()):
                out[i] = ids
            return out
        return [ids for at in range(0, len(strings), CALL) for ids in joined(strings[at : at + CALL])]

    return encode_many


@lru_cache(maxsize=4)
def folds_letters(path: str) -> bool:
    """Whether the tokenizer takes letters as lower case."""
    with open(path, encoding="utf-8") as f:
        normalizer = json.load(f)["normalizer"] or {}
    return any(x["type"] == "Lowercase" for x in (normalizer, *normalizer.get("normalizers", ())) if x)


@lru_cache(maxsize=4)
def _kept_encoder(path: str, width: int, specials_as_text: bool, entries: int) -> ChunkEncoder:
    return ChunkEncoder(batch_encoder(path, width, specials_as_text), entries)


def tokenizers_encoder(path: str, width: int = 4, specials_as_text: bool = False, entries: int = MAX_ENTRIES) -> ChunkEncoder:
    """A memoising encoder over the tokenizers library, ids of width bytes, with at most twice so many entries; the worker keeps it for maps that use TOKENIZERS."""
    keep_in_worker(TOKENIZERS, _kept_encoder.cache_clear)
    return _kept_encoder(path, width, specials_as_text, entries)


def whole_encoder(path: str, width: int) -> Callable[[list[str]], list[bytes]]:
    """The library's own call for each text; the file is loaded when it is first needed."""

    @lru_cache(maxsize=1)
    def tokenizer():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode_whole(texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, f"<u{width}").tobytes() for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]

    return encode_whole


@lru_cache(maxsize=4)
def _kept_text_encoder(path: str, width: int, entries: int) -> PartEncoder | WholeEncoder:
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    splitter = own["pre_tokenizer"] or {}
    whole = whole_encoder(path, width)
    if own["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return WholeEncoder(whole)
    return PartEncoder(batch_encoder(path, width), whole, [t["content"] for t in own["added_tokens"]], entries)


def text_encoder(path: str, width: int = 4, entries: int = MAX_ENTRIES) -> PartEncoder | WholeEncoder:
    """An encoder of Arrow's strings over the tokenizers library, ids of width bytes; the worker keeps it for maps that use TEXTS."""
    keep_in_worker(TEXTS, _kept_text_encoder.cache_clear)
    return _kept_text_encoder(path, width, entries)
