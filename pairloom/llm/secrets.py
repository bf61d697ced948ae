r"""Secret spans by a linear-chain CRF over tokens, beside fixed base patterns (operator 9).

Tokens are runs of ASCII letters and digits or of bytes over 0x7F. Features, hashed: the token, its shape
(kinds of characters, length, changes between letters and digits, hexadecimal only), the two
words before and the one after, the characters between it and the word before and which of assignment signs and quotes they have, their
conjunctions, and of the file its length and share of tokens with digits. States: outside, begin, inside.

The field is fitted by the engine itself: at most MAX_DOCS documents of at most FIT_BYTES bytes, chosen by a hash of doc_id from all
rows, are labelled with the values that the base patterns find; that is the only
sample. So that it learns more than the patterns, VARIANTS lines are made from the sample's own prose: assignments to names that
no pattern lists, of random keys in several alphabets (secrets), and of look-alikes (outside): words, numbers, dates, versions,
addresses, identifiers. Viterbi decodes every text in which any token could pay for leaving `outside`, which
is exact: other texts' best labelling is all outside. Runs of at least MIN_CHARS code points
that touch no base span are added as kind "crf"; base spans stay.

Null and empty texts have no spans; texts of any length are scanned whole, in blocks. Repeated rows are scanned each; of a
repeated doc_id the least text may be in the sample; rows with a null doc_id never are. An empty table gives an empty result, and with an empty
sample only base spans are given. scan_secrets ignores columns other than doc_id and text; redact keeps all, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.crf import Adagrad, Chain, viterbi
from pairloom.llm.tables import id_and_text, tidied
from pairloom.llm.words import LOWER, WORD, Words, buffers, byte_class, hash_spans, mix, row_blocks, words_of

# The base patterns, on UTF-8 bytes so that case folding stays within ASCII.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 8, "access": 16, "hex": 32}

HEX = byte_class((0x30, 0x39), (0x61, 0x66))
_EQUALS, _COLON, _QUOTE = byte_class((61, 61)), byte_class((58, 58)), byte_class((34, 34), (39, 39))
_UPPER, _LOWER, _DIGIT, _HIGH = byte_class((65, 90)), byte_class((97, 122)), byte_class((48, 57)), byte_class((128, 255))
BITS = 18
MIN_CHARS = 8
MAX_DOCS, FIT_BYTES = 3000, 32_768
VARIANTS = 2400
_NEVER = -40.0
#: Bytes of texts whose tokens and features are held at a time.
BLOCK_BYTES = 500_000
#: Steps of the optimiser, at least.
MIN_STEPS = 60
#: Blocks of variants that follow a block of documents.
BETWEEN = 4


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str, int, int]]]:
    """Per text (start, kind, end, start of the value) in bytes of that text, sorted by start, then kind as listed."""
    lo = int(offsets[0])
    block = data[lo : int(offsets[-1])]
    edges = offsets - lo
    raw, low = block.tobytes(), LOWER[block].tobytes()

    def rows_with(literal: bytes, where: bytes) -> set[int]:
        found, at = set(), where.find(literal)
        while at >= 0:
            row = int(np.searchsorted(edges, at, "right")) - 1
            found.add(row)
            at = where.find(literal, int(edges[row + 1]) - len(literal) + 1 if int(edges[row + 1]) > at + len(literal) else at + 1)
        return found

    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for row in set().union(*(rows_with(k, low) for k in KEYWORDS)):
        for m in ASSIGN.finditer(raw[edges[row] : edges[row + 1]]):
            if len(m[2]) >= LEAST["assign"]:
                out[row].append((m.start(), 0, m.end(), m.start(2)))
    for row in rows_with(b"AKIA", raw):
        for m in ACCESS.finditer(raw[edges[row] : edges[row + 1]]):
            if len(m[0]) >= LEAST["access"]:
                out[row].append((m.start(), 1, m.end(), m.start()))
    runs = words_of(data, offsets, HEX, None, hashed=False)
    long = np.flatnonzero(runs.ends - runs.starts >= LEAST["hex"])
    for row, i in zip((np.searchsorted(runs.bounds, long, "right") - 1).tolist(), long.tolist()):
        start = int(runs.starts[i] - edges[row])
        out[row].append((start, 2, int(runs.ends[i] - edges[row]), start))
    return [[(a, KINDS[k], b, v) for a, k, b, v in sorted(x)] for x in out]


def features(words: Words, body: np.ndarray) -> np.ndarray:
    """(tokens, features) indices; body has its letters' case."""
    n = len(words.starts)
    size = words.ends - words.starts

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[body])])
        return sums[words.ends] - sums[words.starts]

    upper, lower, digit, high, hexa = (count(k) for k in (_UPPER, _LOWER, _DIGIT, _HIGH, HEX))
    group = _DIGIT[body].astype(np.int8) - _UPPER[body] * 2
    turns = np.concatenate([[0], np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))])
    changes = turns[words.ends] - turns[np.minimum(words.starts + 1, words.ends)]
    levels = np.searchsorted([4, 8, 12, 16, 20, 28, 40, 64], size, "right")
    shape = levels + 9 * (np.minimum(changes, 9) + 10 * ((upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (high > 0) + 16 * (hexa == size)))
    rows = words.rows
    first = np.zeros(n, bool)
    first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    ahead = lambda x, k, fill: np.where(np.concatenate([np.full(min(k, n), -1), rows[:-k]])[:n] == rows, np.concatenate([np.full(min(k, n), fill, x.dtype), x[:-k]])[:n], fill)
    none = np.uint64(0)
    before, earlier = ahead(words.hashes, 1, none), ahead(words.hashes, 2, none)
    after = np.concatenate([np.where(rows[1:] == rows[:-1], words.hashes[1:], none), [none]])
    gap_start = np.where(first, words.starts, np.concatenate([[0], words.ends[:-1]]))
    gap = hash_spans(words.data, np.maximum(gap_start, words.starts - 4), words.starts, salt=9) if n else words.hashes
    gap = np.where(words.starts > gap_start, gap, none)
    signs = np.zeros(n, np.uint64)
    for bit, kind in enumerate((_EQUALS, _COLON, _QUOTE)):
        sums = np.concatenate([[0], np.cumsum(kind[body])])
        signs |= (sums[words.starts] > sums[np.maximum(gap_start, words.starts - 4)]).astype(np.uint64) << np.uint64(bit)
    joint = np.where(words.starts - gap_start == 1, body[np.minimum(gap_start, len(body) - 1)], 0).astype(np.uint64)
    numeric = np.bincount(rows, weights=digit > 0, minlength=len(words.bounds) - 1) / np.maximum(1, np.diff(words.bounds))
    file = (np.searchsorted([50, 200, 1000, 5000], np.diff(words.bounds)) + 5 * np.searchsorted([0.01, 0.05, 0.2], numeric))[rows].astype(np.uint64)
    shape = shape.astype(np.uint64)
    gold = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        columns = [
            words.hashes,
            mix(shape * gold + np.uint64(1)),
            mix(before + np.uint64(2)),
            mix(earlier + np.uint64(3)),
            mix(after + np.uint64(4)),
            mix(gap + np.uint64(5)),
            mix(mix(shape * gold + np.uint64(6)) + before),
            mix(mix(shape * gold + np.uint64(7)) + gap),
            mix(mix(file * gold + np.uint64(8)) + shape),
            mix(mix(shape * gold + np.uint64(9)) + signs),
            mix(joint + np.uint64(10 << 16)),
        ]
    return (np.stack(columns, axis=1) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class SecretModel:
    """weights[state - 1, feature] of begin and inside, and transitions."""

    def __init__(self):
        self.weights = np.zeros((2, 1 << BITS), np.float32)
        self.bias = np.array([-4.0, -3.0])
        self.start = np.array([0.0, 0.0, _NEVER])
        self.trans = np.array([[0.0, 0.0, _NEVER], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
        self.fitted = False

    def emissions(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), 3))
        for k in range(2):
            out[:, k + 1] = self.bias[k] + self.weights[k][index].sum(axis=1)
        return out

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per text (start, end) in bytes of decoded runs."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        if not self.fitted:
            return out
        words = words_of(data, offsets, WORD)
        if not len(words.starts):
            return out
        scores = self.emissions(features(words, data[int(offsets[0]) : int(offsets[-1])]))
        # Every step in or out of a run gains this much at most, so other tokens never pay.
        gain = np.maximum(scores[:, 1] + max(0.0, float(self.start[1])), scores[:, 2]) + 2 * max(0.0, float(self.trans.max()))
        edges = offsets - offsets[0]
        for row in np.unique(words.rows[gain > 0]).tolist():
            a, b = int(words.bounds[row]), int(words.bounds[row + 1])
            states = viterbi(scores[a:b], self.start, self.trans)
            for i in np.flatnonzero(states == 1).tolist():
                j = i
                while j + 1 < len(states) and states[j + 1] == 2:
                    j += 1
                out[row].append((int(words.starts[a + i] - edges[row]), int(words.ends[a + j] - edges[row])))
        return out


def _name(rng: random.Random, words: list[str]) -> str:
    """A name that no base pattern lists, mostly from the corpus's words."""
    part = lambda: "".join(c for c in rng.choice(words) if c.isalpha())[: rng.randint(2, 12)] or "k"
    if rng.random() < 0.3:
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    return rng.choice([part, lambda: part() + rng.choice("_-.") + part(), lambda: part().upper(), lambda: part() + part().title()])()


def _key(rng: random.Random) -> str:
    """A random key in one of several alphabets."""
    draw = lambda alphabet, least, most: "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    shapes = (
        lambda: draw("0123456789abcdef", 16, 64),
        lambda: draw("0123456789ABCDEF", 16, 64),
        lambda: draw(low + up + digits, 16, 48),
        lambda: draw(up + digits, 14, 36),
        lambda: draw(low + digits, 12, 36),
        lambda: draw(low, 2, 4) + "_" + draw(low + up + digits, 16, 40),
        lambda: "-".join(draw(low + digits, 6, 12) for _ in range(rng.randint(2, 4))),
    )
    while True:
        key = rng.choice(shapes)()
        if sum(c.isdigit() for c in key) >= 2 and any(c.isalpha() for c in key):
            return key


def _look_alike(rng: random.Random, words: list[str]) -> str:
    """What stands where a key could, but is none."""
    word = lambda: "".join(c for c in rng.choice(words) if c.isalnum()) or "x"
    number = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    shapes = (
        word,
        word,
        lambda: word() + rng.choice("_-") + word(),
        lambda: word().lower() + word().title() + word().title(),
        lambda: word().upper(),
        lambda: number(rng.randint(1, 19)),
        lambda: f"{number(rng.randint(1, 4))}.{number(rng.randint(1, 3))}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"{word()}.{rng.randrange(99)}@{word()}{rng.randrange(9)}.example.com",
        lambda: f"/{word()}/{word()}{rng.randrange(99)}.{word()[:3]}",
        lambda: f"{word()}{rng.randrange(1000)}",
        lambda: f"v{rng.randrange(9)}.{rng.randrange(20)}",
        lambda: f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}",
    )
    return rng.choice(shapes)()


def variants(texts: list[str], n: int = VARIANTS, seed: int = 7) -> list[tuple[str, tuple[int, int]]]:
    """(line, place of its key in bytes; an empty one for look-alikes), half of each."""
    rng = random.Random(seed)
    prose = [w for w in (t[:4000].split() for t in texts) if w]
    if not prose:
        return []
    out = []
    for i in range(n):
        words = rng.choice(prose)
        at = rng.randrange(len(words))
        left, right = words[max(0, at - rng.randint(0, 15)) : at], words[at : at + rng.randint(0, 15)]
        quote = rng.choice(["", "", '"', "'"])
        sign = rng.choice([" = ", "=", ": ", ":", " := ", " => ", '": ' if quote == '"' else " : "])
        before = " ".join([*left, _name(rng, words) + sign + quote])
        value = _key(rng) if i % 2 == 0 else _look_alike(rng, words)
        start = len(before.encode())
        out.append((" ".join([before + value + quote, *right]), (start, start + len(value.encode()) * (i % 2 == 0))))
    return out


def _labels(words: Words, edges: np.ndarray, places: list[list[tuple[int, int]]]) -> np.ndarray:
    """Begin (1) and inside (2) of the tokens in each text's places (start, end in bytes)."""
    label = np.zeros(len(words.starts), np.int64)
    for row, own in enumerate(places):
        for start, end in own:
            i = int(np.searchsorted(words.ends, edges[row] + start, "right"))
            j = int(np.searchsorted(words.starts, edges[row] + end, "left"))
            if j > i and not label[i:j].any():
                label[i:j] = 2
                label[i] = 1
    return label


def fit(texts: list[str], epochs: int = 8, n_variants: int = VARIANTS) -> SecretModel:
    """Labels the texts' tokens with the base patterns' values and the variants' with their keys, and maximises their likelihood."""
    model, parts = SecretModel(), []
    made = variants(texts, n_variants)
    for own, places, size in ((texts, None, 500_000), ([t for t, _ in made], [[p] if p[1] > p[0] else [] for _, p in made], 50_000)):
        data, offsets = buffers(pa.array(own, pa.large_string()))
        blocks: list = []
        parts.append(blocks)
        for a, b in row_blocks(offsets, size):
            part = offsets[a : b + 1]
            words = words_of(data, part, WORD)
            if not len(words.starts):
                continue
            found = places[a:b] if places else [[(value, end) for _, _, end, value in x] for x in base_spans(data, part)]
            first = np.zeros(len(words.starts), bool)
            first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
            blocks.append((features(words, data[int(part[0]) : int(part[-1])]).astype(np.int32), first, _labels(words, part - part[0], found)))
    real, lines = parts
    if not any(label.any() for _, _, label in real + lines):
        return model
    model.fitted = True
    optimiser, slow, width = Adagrad(0.5), Adagrad(0.1), 1 << BITS
    # Few blocks take more rounds, so that small corpora see as many steps; blocks of variants come between those of documents.
    order = [x for k, block in enumerate(real) for x in (block, *(lines[(BETWEEN * k + i) % len(lines)] for i in range(BETWEEN) if lines))]
    for _ in range(max(epochs, -(-MIN_STEPS // len(real)))):
        for index, first, label in order:
            index = index.astype(np.int64)
            gamma, pair, _ = Chain(model.emissions(index), first, model.start, model.trans).expectations()
            for k in range(2):
                slope = (label == k + 1) - gamma[:, k + 1]
                gradient = np.zeros(width, np.float32)
                for c in range(index.shape[1]):
                    gradient += np.bincount(index[:, c], weights=slope, minlength=width).astype(np.float32)
                optimiser.step(f"weights{k}", model.weights[k], gradient - np.float32(0.01) * model.weights[k])
            seen = np.zeros((3, 3))
            np.add.at(seen, (label[:-1][~first[1:]], label[1:][~first[1:]]), 1)
            moved = seen - pair.sum(axis=0) - 0.1 * model.trans
            moved[0, 0] = moved[0, 2] = 0.0
            slow.step("trans", model.trans, moved)
    return model


def sample_texts(docs: DataFrame, max_docs: int = MAX_DOCS) -> list[str]:
    """At most max_docs texts of at most FIT_BYTES bytes, half with a base span where there are as many in all rows."""
    keyed = id_and_text(docs).filter("doc_id IS NOT NULL").filter(F.octet_length("text") <= FIT_BYTES).withColumn("key", F.xxhash64(F.lit("secrets"), "doc_id"))
    pattern = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{8}"
    flagged = keyed.select("doc_id", "key", F.col("text").rlike(pattern).alias("hit"))
    chosen = [r.doc_id for r in flagged.filter("hit").orderBy("key", "doc_id").limit(max_docs // 2).collect()] + [r.doc_id for r in keyed.select("doc_id", "key").orderBy("key", "doc_id").limit(max_docs // 2).collect()]
    if not chosen:
        return []
    # At most max_docs identifiers: the side that is broadcast doesn't grow with the input.
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(chosen))], "doc_id long")
    return keyed.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")["text"].tolist()


def train(docs: DataFrame) -> SecretModel:
    texts = sample_texts(docs)
    return fit(texts) if texts else SecretModel()


def _spans(model: SecretModel, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Per text (kind, start, end) in code points, by start, then kind."""
    out = []
    edges = offsets - offsets[0]
    body = data[int(offsets[0]) : int(offsets[-1])]
    for row, (base, runs) in enumerate(zip(base_spans(data, offsets), model.runs(data, offsets))):
        if not base and not runs:
            out.append([])
            continue
        found = [(a, KINDS.index(k), b) for a, k, b, _ in base]
        found += [(a, 3, b) for a, b in runs if b - a >= MIN_CHARS and all(b <= x or y <= a for x, _, y, _ in base)]
        own = body[edges[row] : edges[row + 1]]
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        out.append([(KINDS[k], int(points[a]), int(points[b])) for a, k, b in sorted(found)])
    return out


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                found = _spans(shared.value, data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _of_kind(kind: str):
    return lambda x: x["kind"] == F.lit(kind)


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    coded = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    counted = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counted, F.sha2(coded(base).cast("binary"), 256).alias("base_sha256"), coded(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: SecretModel, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by mask in text; other columns stay, n_chars follows the text where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = batch.column(at).fill_null("")
            data, offsets = buffers(filled)
            columns = list(batch.columns)
            texts, new = batch.column(at).to_pylist(), []
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                for text, spans in zip(texts[a:b], _spans(shared.value, data, offsets[a : b + 1])):
                    parts, last = [], 0
                    for _, start, end in spans:
                        if start >= last:
                            parts += [text[last:start], mask]
                        last = max(last, end)
                    new.append("".join(parts) + text[last:] if spans else text)
            columns[at] = pa.array(new, batch.column(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                lengths = [old if x is y else len(x) for old, x, y in zip(columns[k].to_pylist(), new, texts)]
                columns[k] = pa.array(lengths, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidied(run), docs.schema)
