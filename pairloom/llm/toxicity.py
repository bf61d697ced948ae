"""Toxic spans by a linear-chain CRF, and document scores from its marginals (operator 2).

Tokens are runs of letters; a token's features are hashes of itself and of its first 3, 4 and 5
bytes, which also catch inflected and compounded forms. States are clean (all scores 0) and toxic.

Fitting uses at most `max_docs` labelled documents outside the held-out fold, taken by a
hash of doc_id, in a part from each class, of at most FIT_BYTES bytes each (of a repeated doc_id the least text); that bound is the only sample here. Tokens of clean documents are labelled clean. Those of toxic
documents are labelled at first by association: a token is toxic if one of its features is
significantly commoner, by documents, in the toxic class. After some epochs on these labels the toxic
documents' targets become the marginals given that at least one token is toxic, so that the
document score, 1 - P(all clean), fits the document labels.

Scores come from forward-backward over every token of every text: no prefixes or windows. Null
and empty texts score 0. With no labels, or one class alone, every score is 0. Repeated labels
of a document count as toxic if any is; null labels are ignored. Repeated rows are scored each, rows without a doc_id too; an empty
table gives an empty result. score ignores columns other than doc_id and text; keep_clean keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.crf import Adagrad, Chain
from pairloom.llm.tables import id_and_text, tidied
from pairloom.llm.words import IDENTITY, LETTERS, LOWER, Words, buffers, code_points, hash_spans, mix, row_blocks, words_of

BITS = 20
PREFIXES = (3, 4, 5)
MAX_DOCS, FIT_BYTES = 4500, 65_536
FOLDS = 5
#: Bytes of texts whose tokens and features are held at a time.
BLOCK_BYTES = 500_000
#: Steps of the optimiser in each phase, at least.
MIN_STEPS = 120
#: Marginal from which a token is an offending span.
LEAST = 0.5
#: Score of a toxic token of which nothing is known: rare enough that a text of 100,000 unknown words stays clean.
PRIOR = -13.0


def held_out(doc_id: Column) -> Column:
    """Whether a document is of the held-out fold; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letters_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters in lower case; capitals of the Latin-1 block (two bytes, the first C3) are folded too."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = LOWER[data[lo:hi]]
    if len(body) > 1:
        capital = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E)
        body[1:][capital] += 0x20
    return words_of(body, offsets - lo, LETTERS, IDENTITY)


def features(words: Words) -> np.ndarray:
    """(tokens, features) indices into the weights."""
    size = words.ends - words.starts
    columns = [words.hashes]
    for k in PREFIXES:
        columns.append(hash_spans(words.data, words.starts, words.starts + np.minimum(size, k), salt=k))
    return (np.stack(columns, axis=1) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class ToxicModel:
    """weights[feature], bias, start and transitions of the toxic state."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = np.array([PRIOR])
        self.start, self.trans = np.zeros(2), np.zeros((2, 2))
        self.fitted = False

    def chain(self, index: np.ndarray, first: np.ndarray) -> Chain:
        emissions = np.zeros((len(index), 2))
        emissions[:, 1] = self.bias[0] + self.weights[index].sum(axis=1)
        return Chain(emissions, first, self.start, self.trans)

    def clean_log_probability(self, logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log P(all clean) of each text: the all-clean score is 0 (start[0] = trans[0, 0] = 0)."""
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return np.minimum(0.0, -(sums[bounds[1:]] - sums[bounds[:-1]]))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = letters_of(data, offsets)
        if not self.fitted or not len(words.starts):
            return np.zeros(len(offsets) - 1)
        first = np.zeros(len(words.starts), bool)
        first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
        _, logs = self.chain(features(words), first).forward()
        return -np.expm1(self.clean_log_probability(logs, words.bounds))

    def spans(self, data: np.ndarray, offsets: np.ndarray, least: float = LEAST) -> list[list[tuple[int, int, float]]]:
        """Per text (start, end, marginal) of tokens that are toxic, in code points."""
        words = letters_of(data, offsets)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
        if not self.fitted or not len(words.starts):
            return out
        first = np.zeros(len(words.starts), bool)
        first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
        gamma, _, _ = self.chain(features(words), first).expectations()
        points, rows = code_points(words.data), words.rows
        edges = points[offsets - offsets[0]]
        for i in np.flatnonzero(gamma[:, 1] >= least).tolist():
            r = int(rows[i])
            out[r].append((int(points[words.starts[i]] - edges[r]), int(points[words.ends[i]] - edges[r]), round(float(gamma[i, 1]), 4)))
        return out


def _associations(blocks: list[tuple], n_bad: int, n_good: int, least: float = 24.0) -> np.ndarray:
    """Features that toxic documents have significantly more often: G of the 2 x 2 table of documents over `least`, and a rate ten times the clean one's."""
    width = 1 << BITS
    bad, good = np.zeros(width, np.float32), np.zeros(width, np.float32)
    for index, rows, _, own, _ in blocks:
        seen = np.unique((rows[:, None] * width + index).ravel())
        feature, toxic = seen % width, own[seen // width]
        bad += np.bincount(feature[toxic], minlength=width).astype(np.float32)
        good += np.bincount(feature[~toxic], minlength=width).astype(np.float32)
    share = n_bad / (n_bad + n_good)
    both = np.maximum(bad + good, 1)
    g = 2 * (bad * np.log(np.maximum(bad, 1) / (both * share)) + good * np.log(np.maximum(good, 1) / (both * (1 - share))))
    return (g > least) & (bad / n_bad > 10 * good / n_good)


def _first_of_copies(texts: list[str]) -> list[int]:
    """Texts to fit on: of near copies (one of three minima of hashed four-word sequences in common) the first, since a copied text would vouch for all its words."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    seen: set[int] = set()
    kept = []
    for a, b in row_blocks(offsets):
        words = letters_of(data, offsets[a : b + 1])
        h = words.hashes
        with np.errstate(over="ignore"):
            runs = mix(h[:-3] + mix(h[1:-2] + mix(h[2:-1] + mix(h[3:])))) if len(h) > 3 else h
        for i in range(b - a):
            lo, hi = int(words.bounds[i]), int(words.bounds[i + 1]) - 3
            own = runs[lo:hi] if hi > lo else h[lo : hi + 3]
            signs = {int(mix(own ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min()) for k in range(3)} if len(own) else {0}
            if seen.isdisjoint(signs):
                kept.append(a + i)
            seen |= signs
    return kept


def fit(texts: list[str], labels: list[int], label_epochs: int = 4, bag_epochs: int = 5, block_bytes: int = 400_000) -> ToxicModel:
    """Fits on the driver; memory is bounded by the blocks and the bounded sample."""
    model = ToxicModel()
    kept = _first_of_copies(texts)
    texts, toxic = [texts[i] for i in kept], np.asarray(labels, bool)[kept]
    if not toxic.any() or toxic.all():
        return model
    model.fitted = True
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    blocks = []
    for a, b in row_blocks(offsets, block_bytes):
        words = letters_of(data, offsets[a : b + 1])
        if len(words.starts):
            first = np.zeros(len(words.starts), bool)
            first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
            blocks.append((features(words).astype(np.int32), words.rows, first, toxic[a:b], words.bounds))
    marks = _associations(blocks, int(toxic.sum()), int((~toxic).sum()))
    optimiser, slow = Adagrad(0.5), Adagrad(0.05)
    # Few blocks take more rounds, so that small corpora see as many steps.
    label_epochs, bag_epochs = (max(n, -(-MIN_STEPS // max(1, len(blocks)))) for n in (label_epochs, bag_epochs))
    for epoch in range(label_epochs + bag_epochs):
        for index, rows, first, own, bounds in blocks:
            index = index.astype(np.int64)
            gamma, pair, logs = model.chain(index, first).expectations()
            bad = own[rows]
            if epoch < label_epochs:
                label = bad & marks[index].any(axis=1)
                target, joint = label.astype(float), np.zeros_like(pair)
                before = np.concatenate([[False], label[:-1]]).astype(int)
                joint[np.arange(len(label)), before, label.astype(int)] = 1.0
                joint[first] = 0
            else:
                p_clean = np.exp(model.clean_log_probability(logs, bounds))
                share = np.where(own, 1 / np.maximum(1e-9, 1 - p_clean), 0.0)[rows]
                target, joint = np.minimum(1.0, gamma[:, 1] * share), pair * share[:, None, None]
            slope = target - gamma[:, 1]
            gradient = np.zeros(1 << BITS, np.float32)
            for k in range(index.shape[1]):
                gradient += np.bincount(index[:, k], weights=slope, minlength=1 << BITS).astype(np.float32)
            moved = (joint - pair).sum(axis=0)
            moved[0, 0] = 0.0
            optimiser.step("weights", model.weights, gradient - 0.02 * model.weights)
            slow.step("trans", model.trans, moved - model.trans)
    return model


def sample_labelled(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list[str], list[int]]:
    """At most max_docs texts of at most FIT_BYTES bytes with labels outside the held-out fold; toxic ones are up to a third of them."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = known.withColumn("key", F.xxhash64(F.lit("toxicity"), "doc_id"))
    bound = {1: max_docs // 3, 0: max_docs - max_docs // 3}
    chosen = [r for side, n in bound.items() for r in keyed.filter(F.col("toxic") == side).orderBy("key", "doc_id").limit(n).collect()]
    if not chosen:
        return [], []
    # At most max_docs identifiers: the side that is broadcast doesn't grow with the input.
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    own = id_and_text(docs).filter(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(ids), "doc_id")
    found = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return found["text"].tolist(), found["toxic"].tolist()


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> ToxicModel:
    return fit(*sample_labelled(docs, labels, max_docs))


def score(docs: DataFrame, model: ToxicModel, spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, spans of offending code points with their marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                scores = own.scores(data, offsets[a : b + 1])
                out = [batch.column(0).slice(a, b - a), pa.array(scores)]
                if spans:
                    found: list = [[] for _ in range(b - a)]
                    # A token's marginal is at most the document's score, so texts below LEAST have no spans.
                    some = np.flatnonzero(scores >= LEAST)
                    if len(some):
                        texts = batch.column(1).slice(a, b - a).take(pa.array(some))
                        for i, x in zip(some.tolist(), own.spans(*buffers(texts), LEAST)):
                            found[i] = [{"start": s, "end": e, "p": p} for s, e, p in x]
                    out.append(pa.array(found, kind))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "spans"][: len(out)])

    schema = "doc_id long, score double" + ", spans array<struct<start:long,end:long,p:double>>" * spans
    return id_and_text(docs).mapInArrow(tidied(run), schema)


def keep_clean(docs: DataFrame, model: ToxicModel, least: float = 0.5) -> DataFrame:
    """docs without the rows that score at least `least`; columns and other rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at).fill_null(""))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.scores(data, offsets[a : b + 1]) < least))

    return docs.mapInArrow(tidied(run), docs.schema)
