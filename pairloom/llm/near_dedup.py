r"""Near-duplicate classes by HyperMinHash sketches, banding and exact verification (operator 8).

A text's set is its distinct five-word shingles (words: runs of anything but [\x20\x09-\x0D], A-Z
lower-cased); with fewer words the whole sequence is one; without words it is empty and
linked with nothing. Texts are linked where 100 |A n B| >= percent |A u B|; percent is a
parameter, 85 for the query. Cut derives bands and estimate bound from it.

1. One pass over whole texts gives each row n, a 128-bit key of its set, and up to 192 HyperMinHash
   registers: the bucket's smallest hash kept as 5 bits of leading zeros and 5 of mantissa.
   Empty registers copy others by a fixed rule (optimal densification), so small sets band too.
2. Rows with the same key are one class; thousands of copies become one node.
3. Registers make bands (one long each), as wide as leaves at most one pair in a million at the
   threshold without a shared one: 32 of six at 85, (1 - 0.85^6)^32 = 3e-7; 38 of five at 80,
   (1 - 0.8^5)^38 = 3e-7. In each bucket every member is paired with the bucket's
   most central node alone (the one that meets most others over all bands): a star, not all pairs.
4. Pairs whose collision-corrected Jaccard estimate is at most five standard errors below the
   threshold, 0.72 for 85 and 0.65 for 80 (or with a set of at most 64, where estimates are
   coarse), are verified on the full sets; texts stream past their centre, and busy centres are salted.
5. Verified links give components. A bucket that still holds several components is compared in
   tiles: a chunk of the members outside its largest component, against a span of all. Sketches first tell which of a tile's rows
   take part in a pair that is worth verifying; those come back with their texts, and the tile verifies its pairs on full sets
   and keeps a union-find of the components that it has joined. So no link between texts of different
   components is lost to the star, a component of any size is not compared with itself, and a tile gives at
   most as many rows as it has members.

Null texts are empty. Repeated rows and equal texts are one class. Null doc_ids sort last and
give a null component_id only where no other id is in reach; then one row of the component is kept. Texts of any length are
read whole, a block at a time; a chunk's sets are bounded together. An empty table gives an empty result. near_groups ignores columns
other than doc_id and text; drop_near_copies keeps all, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.joins import by_keys
from pairloom.llm.tables import NO_ID, free_names, id_and_text, ids_last, tidied
from pairloom.llm.words import NOT_BLANK, buffers, mix, row_blocks, words_of
from pairloom.session import materialize

SHINGLE = 5
MOST_REGISTERS, WIDEST = 192, 6
ZEROS, MANTISSA = 5, 5
WIDTH = ZEROS + MANTISSA
#: Sets up to this size are verified whatever their estimate.
SMALL = 64
#: Share of pairs at the threshold that may meet in no band, and standard errors an estimate may be below it.
MISSED, ERRORS = 1e-6, 5
#: Members of a bucket outside its largest component that are compared at a time, and rows they are compared with in a task.
BLOCK, SPAN = 512, 8192
#: Shingles of such members' sets that a task holds at a time, about.
SETS = 1_000_000
STAR = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Cut:
    """A Jaccard threshold in percent, with what follows from it."""

    percent: int

    @property
    def band(self) -> int:
        """Registers in a band."""
        t = self.percent / 100
        return next((k for k in range(WIDEST, 1, -1) if (1 - t**k) ** (MOST_REGISTERS // k) <= MISSED), 1)

    @property
    def bands(self) -> int:
        return MOST_REGISTERS // self.band

    @property
    def registers(self) -> int:
        return self.band * self.bands

    @property
    def least_estimate(self) -> float:
        """Estimates below this are not verified, for sets over SMALL."""
        t = self.percent / 100
        return math.floor(100 * (t - ERRORS * math.sqrt(t * (1 - t) / self.registers))) / 100


QUERY = Cut(85)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingle hashes in ascending order."""
    words = words_of(data, offsets, NOT_BLANK)
    h, counts = words.hashes, np.diff(words.bounds)
    with np.errstate(over="ignore"):
        if len(h) >= SHINGLE:
            runs = h[: len(h) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                runs = mix(runs * _GOLD + h[k : len(h) - SHINGLE + 1 + k])
        else:
            runs = np.zeros(0, np.uint64)
    rows = words.rows
    inside = np.arange(len(h)) + SHINGLE <= np.repeat(words.bounds[1:], counts)
    full = np.flatnonzero(inside)
    own, values = rows[full], runs[full]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i, r in enumerate(short):
                acc = np.full(1, counts[r], np.uint64)
                for x in h[words.bounds[r] : words.bounds[r + 1]]:
                    acc = mix(acc * _GOLD + x)
                extra[i] = acc[0]
        own, values = np.concatenate([own, short]), np.concatenate([values, extra])
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    own, values = own[new], values[new]
    return values, np.searchsorted(own, np.arange(len(counts) + 1))


@lru_cache
def _fill_rule(registers: int) -> np.ndarray:
    """For each attempt and register, the register that is copied."""
    at = np.arange(64, dtype=np.uint64)[:, None] * np.uint64(1009) + np.arange(registers, dtype=np.uint64)
    return (mix(at * _GOLD) % np.uint64(registers)).astype(np.int64)


def sketches(values: np.ndarray, bounds: np.ndarray, cut: Cut = QUERY) -> np.ndarray:
    """(texts, cut.bands) longs, each of cut.band register codes; rows of empty sets are 0."""
    n, size, fill = len(bounds) - 1, cut.registers, _fill_rule(cut.registers)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    bucket = ((values >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
    least = np.full(n * size, _FULL)
    np.minimum.at(least, rows * size + bucket, mix(values ^ _GOLD) | np.uint64(1))
    least = least.reshape(n, size)
    empty = least == _FULL
    # The leading one's place, exact for all 64 bits.
    top = np.zeros(least.shape, np.uint8)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        top[big] += step
        rest[big] >>= np.uint64(step)
    zeros = 63 - top
    mantissa = (((least << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    codes = np.minimum(zeros, (1 << ZEROS) - 1).astype(np.uint16) << MANTISSA | mantissa
    out = codes.copy()
    todo_row, todo_reg = np.nonzero(empty & (np.diff(bounds) > 0)[:, None])
    for attempt in range(len(fill) + size):
        if not len(todo_row):
            break
        source = fill[attempt][todo_reg] if attempt < len(fill) else (todo_reg + attempt - len(fill) + 1) % size
        good = ~empty[todo_row, source]
        out[todo_row[good], todo_reg[good]] = codes[todo_row[good], source[good]]
        todo_row, todo_reg = todo_row[~good], todo_reg[~good]
    out[np.diff(bounds) == 0] = 0
    packed = np.zeros((n, cut.bands), np.int64)
    for k in range(cut.band):
        packed |= out[:, k :: cut.band].astype(np.int64) << (WIDTH * k)
    return packed


def registers(bands: np.ndarray, cut: Cut = QUERY) -> np.ndarray:
    """(texts, cut.registers) u16 codes of packed bands."""
    return ((bands[:, :, None] >> (WIDTH * np.arange(cut.band))) & ((1 << WIDTH) - 1)).astype(np.uint16).reshape(len(bands), cut.registers)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray, size: int) -> np.ndarray:
    """The chance that registers of disjoint sets agree: same leading zeros, and then all mantissa bits."""
    level = np.arange(0, 1 << ZEROS)
    below = 1.0 - 2.0 ** -(level + 1.0)
    below[-1] = 1.0
    upper = lambda n: below ** np.maximum(1.0, n / size)[:, None]  # noqa: E731  P(most leading zeros <= level)
    p, q = np.diff(upper(n_a), prepend=0, axis=1), np.diff(upper(n_b), prepend=0, axis=1)
    return (p * q).sum(axis=1) * 2.0**-MANTISSA


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates corrected for chance agreement."""
    same, chance = (a == b).mean(axis=1), collision_rate(n_a, n_b, a.shape[1])
    return (same - chance) / (1 - chance)


def worth_verifying(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, cut: Cut) -> np.ndarray:
    """Sizes allow the threshold, and the estimate doesn't speak against it."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= cut.percent * large) & ((small <= SMALL) | (estimates(a, b, n_a, n_b) >= cut.least_estimate))


def _sketch_rows(docs: DataFrame, cut: Cut) -> DataFrame:
    """(row, doc_id, h, n, hi, lo, bands) for each row, written to the shared folder."""
    names = ["row", "doc_id", "h", "n", "hi", "lo", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            for a, b in row_blocks(offsets):
                values, bounds = shingle_sets(data, offsets[a : b + 1])
                n = np.diff(bounds)
                # Sums over each set, wrapping: an extra zero at the end stands for empty sets there.
                with np.errstate(over="ignore"):
                    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + _GOLD))])
                    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(values * _GOLD ^ np.uint64(77)))])
                    hi, lo = one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]
                bands = sketches(values, bounds, cut)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, cut.bands, dtype=np.int32)), pa.array(bands.ravel()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n.astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), packed], names)

    keyed = id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return materialize(keyed.mapInArrow(tidied(run), "row long, doc_id long, h long, n long, hi long, lo long, bands array<long>"), "sketches")


def _bands(column: pa.Array, cut: Cut) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, cut.bands)


def _passing(pairs: DataFrame, nodes: DataFrame, cut: Cut) -> DataFrame:
    """Pairs (a, b) that are worth verifying, by the sketches of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                size = [batch.column(i).to_numpy() for i in (2, 4)]
                good = worth_verifying(registers(_bands(batch.column(3), cut), cut), registers(_bands(batch.column(5), cut), cut), *size, cut)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bands").alias(f"bands_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bands_a", "n_b", "bands_b").mapInArrow(tidied(run), "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, cut: Cut) -> DataFrame:
    """Links (u, v) among pairs (a, b), on the full sets of the whole texts."""
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n_pairs")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n_pairs") / STAR)))
    salted = materialize(salted.select("a", "b", "salt"), "pairs")
    texts = _texts(salted.select(F.col("a").alias("node")).union(salted.select(F.col("b").alias("node"))), nodes, docs)
    centres = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            for i, j in row_blocks(offsets):
                values, bounds = shingle_sets(data, offsets[i : j + 1])
                part = batch.slice(i, j - i)
                left, right = [], []
                for k, (a, salt, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
                    own = values[bounds[k] : bounds[k + 1]]
                    if b is None:
                        group, centre = (a, salt), own
                    elif group == (a, salt):
                        both = len(np.intersect1d(centre, own, assume_unique=True))
                        if 100 * both >= cut.percent * (len(centre) + len(own) - both):
                            left.append(a)
                            right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    streamed = centres.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(streamed.mapInArrow(tidied(run), "u long, v long").distinct(), "links")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(pos, val, node, n, root, main, chunks, spans): members of the buckets that hold several components, with the bucket's largest one and its tiles."""
    labelled = members.join(roots, "node", "left").select("pos", "val", "node", "n", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("pos", "val").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("pos", "val")
    mixed = materialize(labelled.join(several, ["pos", "val"]), "mixed")
    sizes = mixed.groupBy("pos", "val", "root").agg(F.count("*").alias("n_root"), F.sum("n").alias("sets"))
    largest = sizes.groupBy("pos", "val").agg(F.max_by(F.struct("root", "n_root", "sets"), F.struct("n_root", "root")).alias("top"), F.sum("n_root").alias("total"), F.sum("sets").alias("sets"))
    chunks = F.greatest((F.col("total") - F.col("top.n_root")) / BLOCK, (F.col("sets") - F.col("top.sets")) / SETS)
    tiles = largest.select("pos", "val", F.col("top.root").alias("main"), F.ceil(chunks).cast("int").alias("chunks"), F.ceil(F.col("total") / SPAN).cast("int").alias("spans"))
    return mixed.join(tiles, ["pos", "val"])


_TILE = ["pos", "val", "chunk", "span"]
_TILE_SCHEMA = "pos int, val long, chunk int, span int, kind int, node long, root long, n long, bands array<long>"


def _tiles(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Deals each mixed bucket out: kind 0 are a chunk's members outside the largest component, kind 1 the members of a span that they are compared with."""
    rows = (
        mixed.join(nodes.select("node", "bands"), "node")
        .withColumn("asks", F.col("root") != F.col("main"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("span", F.pmod(F.xxhash64("node", F.lit(1)), F.col("spans")).cast("int"))
    )
    keep = ["pos", "val", "node", "root", "n", "bands"]
    asking = rows.filter("asks").select(*keep, "chunk", F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"), F.lit(0).alias("kind"))
    asked = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "span", F.lit(1).alias("kind"))
    return _by_tile(asking.unionByName(asked).select(*_TILE, "kind", "node", "root", "n", "bands"))


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "kind", "node")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, tuple, int, int, int]]:
    """(batch, tile, first row, first row of kind 1, end) of each tile's stretch within a batch."""
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(n_keys)], axis=1)
        kind = batch.column(n_keys).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield batch, tuple(keys[i].tolist()), i, i + int((kind[i:j] == 0).sum()), j


class _Asked:
    """Rows of a tile that are compared with: node, component, size, codes and bands of each."""

    def __init__(self, rows: pa.RecordBatch, cut: Cut):
        self.node, self.root, self.n = (rows.column(i).to_numpy() for i in (5, 6, 7))
        self.bands = _bands(rows.column(8), cut)
        self.codes = registers(self.bands, cut)

    def passing(self, k: int, other: _Asked, root: np.ndarray, own_root: int, pos: int, cut: Cut) -> np.ndarray:
        """Rows of other that row k is to be verified with: another component, not met in an earlier band, and worth it."""
        n = int(self.n[k])
        able = np.flatnonzero((root != own_root) & (100 * np.minimum(other.n, n) >= cut.percent * np.maximum(other.n, n)))
        if len(able):
            able = able[~(other.bands[able, :pos] == self.bands[k, :pos]).any(axis=1)]
        if len(able):
            codes = other.codes[able]
            able = able[worth_verifying(codes, np.broadcast_to(self.codes[k], codes.shape), other.n[able], np.full(len(able), n), cut)]
        return able


def _suspects(tiles: DataFrame, cut: Cut) -> DataFrame:
    """The rows of each tile that take part in a pair worth verifying: at most each of the tile's rows once, however many the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asks, told = None, [], []
        for batch, now, i, m, j in _runs(batches, 4):
            if now != tile:
                tile, asks, told = now, [], []
            if m > i:
                asks.append(_Asked(batch.slice(i, m - i), cut))
                told.append((batch.slice(i, m - i), np.zeros(m - i, bool)))
            if j == m:
                continue
            other, hit = _Asked(batch.slice(m, j - m), cut), np.zeros(j - m, bool)
            for own, (rows, done) in zip(asks, told):
                fresh = np.zeros(len(done), bool)
                for k in range(len(done)):
                    able = own.passing(k, other, other.root, int(own.root[k]), now[0], cut)
                    if len(able):
                        hit[able] = True
                        fresh[k] = not done[k]
                if fresh.any():
                    done |= fresh
                    yield rows.filter(pa.array(fresh))
            if hit.any():
                yield batch.slice(m, j - m).filter(pa.array(hit))

    return materialize(tiles.mapInArrow(tidied(run), _TILE_SCHEMA), "suspects")


class _Ask:
    """One asking row of a tile with its full set."""

    def __init__(self, rows: _Asked, k: int, own: np.ndarray):
        self.rows, self.k, self.own = rows, k, own


def _link_tiles(suspects: DataFrame, texts: DataFrame, cut: Cut) -> DataFrame:
    """Links (u, v) that join components, verified on the full sets within their tile.

    A tile keeps a union-find of the components it has met: a pair whose components are joined
    already adds nothing, so a tile gives fewer links than it has components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asks, joined = None, [], {}

        def find(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch, now, i, m, j in _runs(batches, 4):
            if now != tile:
                tile, asks, joined = now, [], {}
            data, offsets = buffers(batch.column(9).slice(i, j - i))
            left, right = [], []
            for a, b in row_blocks(offsets):
                values, bounds = shingle_sets(data, offsets[a : b + 1])
                part = _Asked(batch.slice(i + a, b - a), cut)
                q = min(max(m - i - a, 0), b - a)  # rows of kind 0 in this block
                asks += [_Ask(part, k, values[bounds[k] : bounds[k + 1]].copy()) for k in range(q)]
                if q == b - a:
                    continue
                root = np.array([find(x) if t >= q else -1 for t, x in enumerate(part.root.tolist())], np.int64)
                for ask in asks:
                    mine = find(int(ask.rows.root[ask.k]))
                    able = ask.rows.passing(ask.k, part, np.where(root < 0, mine, root), mine, now[0], cut)
                    if not len(able):
                        continue
                    sizes = np.diff(bounds)[able]
                    own = np.concatenate([values[bounds[t] : bounds[t + 1]] for t in able.tolist()])
                    at = np.minimum(np.searchsorted(ask.own, own), len(ask.own) - 1)
                    both = np.add.reduceat((ask.own[at] == own).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    for t in able[100 * both >= cut.percent * (len(ask.own) + sizes - both)].tolist():
                        if root[t] == mine:
                            continue
                        left.append(int(ask.rows.node[ask.k]))
                        right.append(int(part.node[t]))
                        kept, gone = min(mine, int(root[t])), max(mine, int(root[t]))
                        joined[gone] = kept
                        root[root == gone] = kept
                        mine = kept
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    rows = _by_tile(suspects.join(texts, "node").select(*_TILE, "kind", "node", "root", "n", "bands", "text"))
    return materialize(rows.mapInArrow(tidied(run), "u long, v long").distinct(), "links")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: the text of the row that stands for the node."""
    wanted = materialize(nodes.select("node", "id", "h").join(wanted.distinct(), "node"), "wanted")
    own = id_and_text(docs).select(ids_last(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("h"), "text")
    return materialize(by_keys(own, wanted, ["id", "h"], "inner").select("node", "text"), "texts")


def near_rows(docs: DataFrame, percent: int = QUERY.percent) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_shingles, component_id, kept, and stays, which holds for one row of each component."""
    cut = Cut(percent)
    rows = _sketch_rows(docs, cut)
    key = ["hi", "lo", "n"]
    nodes = materialize(
        rows.filter("n > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min(F.struct(ids_last(F.col("doc_id")).alias("id"), "h", "row")).alias("least"), F.min_by("bands", "row").alias("bands")).select("node", "least.id", "least.h", F.col("least.row").alias("first"), *key, "bands"),
        "nodes",
    )
    banded = nodes.select("node", "n", F.posexplode("bands").alias("pos", "val"))
    shared = banded.groupBy("pos", "val").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(banded.join(shared, ["pos", "val"]), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("met"))
    placed = members.join(central, "node")
    centres = placed.groupBy("pos", "val").agg(F.max_by("node", F.struct("met", "node")).alias("a"))
    stars = members.join(centres, ["pos", "val"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = _verify(materialize(_passing(stars, nodes, cut), "tested"), nodes, docs, cut)
    roots = components(links)
    suspects = _suspects(_tiles(_mixed(members, roots), nodes), cut)
    if not suspects.isEmpty():
        more = _link_tiles(suspects, _texts(suspects.select("node"), nodes, docs), cut)
        if not more.isEmpty():
            roots = components(links.union(more))
    classes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min(F.struct("id", "first")).alias("least"))
    named = classes.join(least, "root").select(*key, F.col("least.id").alias("component"), F.col("least.first").alias("stays_row"))
    found = rows.join(named, key, "left").withColumn("component_id", F.coalesce(F.when(F.col("component") == NO_ID, None).otherwise(F.col("component")), "doc_id"))
    stays = F.col("row") == F.coalesce("stays_row", "row")
    kept = F.when(F.col("component_id").isNull(), stays).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return found.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), stays.alias("stays"))


def near_groups(docs: DataFrame, percent: int = QUERY.percent) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return near_rows(docs, percent).drop("h", "stays")


def drop_near_copies(docs: DataFrame, percent: int = QUERY.percent) -> DataFrame:
    """One row of each group stays: the one with the group's smallest id; rows without words all stay.

    Rows are found by doc_id and the text's hash. Where a staying row is repeated with its doc_id and text, one of them is taken.
    """
    id_col, h_col = free_names(docs, "id", "hash")
    found = near_rows(docs, percent).groupBy(ids_last(F.col("doc_id")).alias(id_col), F.col("h").alias(h_col)).agg(F.sum(F.col("stays").cast("long")).alias("n_stay"), F.count("*").alias("n"))
    changed = materialize(found.filter("n_stay < n"), "changed")
    on = [id_col, h_col]
    keyed = docs.withColumn(id_col, ids_last(F.col("doc_id").cast("long"))).withColumn(h_col, F.xxhash64(F.coalesce("text", F.lit(""))))
    rest = by_keys(keyed, changed.select(*on), on, "left_anti").select(*docs.columns)
    repeated = changed.filter("n_stay > 0").select(*on)
    if repeated.isEmpty():
        return rest
    return rest.union(by_keys(keyed, repeated, on).dropDuplicates(on).select(*docs.columns))
