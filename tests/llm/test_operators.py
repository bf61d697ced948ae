"""Each training-data operator against a plain version, a round trip, or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, exact_dedup, html_text, licences, media, near_dedup, packing, queries, secrets, token_store, toxicity
from pairloom.llm.bytelevel import PartEncoder
from pairloom.llm.components import components
from pairloom.llm.crf import Chain, viterbi
from pairloom.llm.tokenizer_files import batch_encoder, public_path, tokenizers_encoder, whole_encoder
from pairloom.llm.wordcache import ChunkEncoder
from pairloom.llm.words import buffers

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Null text, empty, blanks, repeated rows, equal texts, one very long text, other scripts.
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a  b c\td e f "), (6, "it's  42 \n\n 漢字 😀 é"), (7, "word " * 30_000), (None, "lost id"), (8, "x" * 70_000)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "a", 1) for r in EDGE], SCHEMA + ", text_sha256 string, n long")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def blank_free(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def test_exact_dedup(spark, edge):
    got = exact_dedup.exact_groups(edge).collect()
    assert len(got) == len(EDGE) and sum(r.kept for r in got) == len({blank_free(t or "") for _, t in EDGE})
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].keep_id == 5 and by_id[5].group_size == 3 and by_id[1].keep_id == 3
    assert by_id[6].digest == hashlib.sha256(blank_free(EDGE[6][1]).encode()).hexdigest()
    rest = exact_dedup.drop_exact_copies(edge)
    assert rest.columns == edge.columns and sorted(r.doc_id or 0 for r in rest.collect()) == [0, 3, 5, 6, 7, 8]
    assert exact_dedup.exact_groups(edge.limit(0)).count() == 0


def test_exact_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a b", "mine1", "x1", 7), (2, "ab", "mine2", "x2", 8), (None, "c", "mine3", "x3", 9), (None, "c", "mine4", "x4", 9)]
    docs = spark.createDataFrame(rows, SCHEMA + ", __id string, digest string, best int")
    got = sorted(exact_dedup.drop_exact_copies(docs).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.text) for r in got] == [(None, "c"), (1, "a b")] and (got[1]["__id"], got[1].digest, got[1].best) == ("mine1", "x1", 7)


def test_exact_dedup_merges_many_runs(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text")).repartition(40)
    got = exact_dedup.exact_groups(docs).groupBy("keep_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert sorted(r.keep_id for r in got) == list(range(7)) and all(r.k == 1 for r in got) and sum(r.n for r in got) == 500


def test_toxicity_held_out(spark, sf_dir):
    rng = random.Random(5)
    plain = ["river", "stone", "cloud", "green", "walk", "paper", "light", "table", "seven", "north"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 60))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "Wretched"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model, spans=True).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    hit = next(r for r in got if r.score > 0.9)
    assert any(rows[hit.doc_id][1][s.start : s.end].lower() in ("vilest", "rotten", "wretched") for s in hit.spans)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(edge, none)
    got = toxicity.score(edge, model, spans=True).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.0} and not any(r.spans for r in got)
    assert {r.held for r in got if r.doc_id is None} == {False}
    assert toxicity.score(edge.limit(0), model).count() == 0 and toxicity.keep_clean(edge, model).columns == edge.columns


def test_toxicity_of_held_out_documents(spark):
    """The query on the test tables: by the labels of the fold that it has not learnt from."""
    sf_dir = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in queries.op2_toxicity(spark, sf_dir).collect() if r.held_out and marks.get(r.doc_id) is not None]
    right = sum(r.predicted == marks[r.doc_id] for r in got)
    toxic = [r for r in got if marks[r.doc_id] == 1]
    assert right >= 0.95 * len(got) and sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got) and all(r.spans for r in got if r.score > 0.9)
    assert all(0 <= x.start < x.end and x.p >= toxicity.LEAST for r in got for x in r.spans)


def test_toxicity_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 30, f"text {i} of {i % 30}") for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    one, two = (toxicity.sample_labelled(spark.createDataFrame(x, SCHEMA).repartition(n), labels) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert one == two and len(one[0]) == len(set(one[0]))


def test_chain_against_brute_force():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 4, 2]
    emissions, first = rng.normal(size=(sum(sizes), 3)), np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    start, trans = rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, pair, logs = Chain(emissions, first, start, trans).expectations()
    at = 0
    for n in sizes:
        e, total, marginal, best = emissions[at : at + n], 0.0, np.zeros((n, 3)), (-1e9, None)
        for code in range(3**n):
            states = [code // 3**i % 3 for i in range(n)]
            s = start[states[0]] + sum(e[i, x] for i, x in enumerate(states)) + sum(trans[a, b] for a, b in zip(states, states[1:]))
            best = max(best, (s, states))
            total += np.exp(s)
            marginal[range(n), states] += np.exp(s)
        assert np.allclose(gamma[at : at + n], marginal / total) and np.isclose(logs[at : at + n].sum(), np.log(total))
        assert viterbi(e, start, trans).tolist() == best[1]
        at += n


def test_media_round_trip(spark, edge):
    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in media.to_media(edge).collect()}
    got = media.read_media(media.to_media(edge)).collect()
    assert len(got) == len(EDGE)
    for (doc_id, text), r in zip(sorted(EDGE, key=lambda x: str(x)), sorted(got, key=lambda r: str((r.doc_id, dict(EDGE)[r.doc_id])))):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and media.from_wav(stored[r.doc_id, r.n_bytes]) == payload
        assert r.media_bytes == len(stored[r.doc_id, r.n_bytes])
    assert next(r for r in got if r.doc_id == 7).fingerprint
    one_pass = media.media_features(edge, keep=True)
    assert sorted(map(str, one_pass.drop("media").collect())) == sorted(map(str, got)) and {bytes(r.media) for r in one_pass.collect()} == set(stored.values())
    assert media.media_features(edge.limit(0)).count() == 0


def test_fingerprint_finds_a_shifted_passage():
    rng = random.Random(1)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(8192))
    codes = lambda p: Counter(x & 0xFFFFFFFF for x in media.fingerprint(p).tolist())
    common = sum((codes(body) & codes(bytes(media.STEP * 8) + body)).values())
    assert common > 0.9 * sum(codes(body).values())


def test_fingerprint_covers_the_last_samples():
    rng = random.Random(2)
    for size in (320, 448, 4096 + 64):
        body = bytes(rng.choice(b"abcdefgh ") for _ in range(size - 64))
        ends = [(b" " * n + b"~" * n) * (32 // n) for n in (1, 2, 4, 8)]  # clear tones
        assert len({media.fingerprint(body + x).tobytes() for x in ends}) > 1, size


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 3), (1000, 90_000), (300, 10**9)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_store.EliasFano.build(values, int(values[-1]))
        assert ef.stretch(0, n).tolist() == values.tolist() == [ef.select(i) for i in range(n)]
        for _ in range(50):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert ef.stretch(a, b).tolist() == values[a:b].tolist()
        if n > 100:
            assert ef.low.nbytes + ef.high.nbytes + ef.samples.nbytes < 8 * n
    with pytest.raises(IndexError):
        ef.select(n)


def test_token_files(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    folder, manifest = token_store.tokenize_to_files(edge, public_path("byte_bpe_50k.json"))
    got = sorted(token_store.read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in EDGE if i is not None)) + [None]
    start = 0
    texts = defaultdict(set)
    for i, t in EDGE:
        texts[i].add(t or "")
    for r in got:
        (text,) = texts[r.doc_id]
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for path in [r.path for r in manifest.collect()]:
        with open(folder.removeprefix("file://") + "/" + path, "rb") as f:
            segment = token_store.Segment(f)
            own = np.concatenate([ids for _, _, ids in segment.stretches(2)])
            assert own.tolist() == [x for i in range(segment.n) for x in segment.document(i).tolist()] and segment.document(0)[-1] == 0
    folder, manifest = token_store.tokenize_to_files(edge.limit(0), public_path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, folder, manifest).count() == 0


def test_token_store_leaves_one_copy(spark):
    """Beside the store nothing lies in the shared folder; ids are the library's also where white space comes before an added token's string."""
    import os

    from tokenizers import Tokenizer

    from pairloom.session import scratch

    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    texts = ["a\n\n<|endoftext|>b", "it's <|endoftext|>", "plain, text. plain text", "", "\n\n"]
    base = os.path.dirname(scratch(spark, "x").removeprefix("file://"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    folder, manifest = token_store.tokenize_to_files(spark.createDataFrame([*enumerate(texts), (None, "a\n\n<|endoftext|>")], SCHEMA), public_path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_tokens(spark, folder, manifest).collect()}
    for i, text in [*enumerate(texts), (None, "a\n\n<|endoftext|>")]:
        assert got[i] == zlib.crc32(np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()), text
    new = {x for x in os.listdir(base) if x not in before and os.path.isdir(f"{base}/{x}") and any(f for _, _, f in os.walk(f"{base}/{x}"))}
    assert new == {os.path.basename(folder)}


def test_text_encoder_equals_the_library(documents):
    path = public_path("byte_bpe_50k.json")
    calls = []

    def encode_many(parts, encode=batch_encoder(path, 2)):
        calls.extend(parts)
        return encode(parts)

    whole = whole_encoder(path, 2)
    rng = random.Random(4)
    odd = ["".join(rng.choice(a) for _ in range(rng.randint(0, 14))) for a in ("ab \n\t'sdrelv1!.\xa0", "  \n\xa0\u3000\u2009 a'\xe9", "a1 .'\x85\u1680\x1c\ufeff\r\n\u6f22\U0001f600\xe9\u0663", "'tdmsrevl .a") for _ in range(2_000)]
    odd += [f"a{chr(c)}b \n{chr(c)}\n\nx {chr(c)} {chr(c)}'s  {chr(c)}" for c in (*range(0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    odd += ["<|endoftext|>", "a\n\n<|endoftext|>\n\nb", "<|endoftext|", *(t or "" for _, t in EDGE), *documents.values()]
    for entries in (50, 100_000):
        encoder = PartEncoder(encode_many, whole, ["<|endoftext|>"], entries)
        for at in range(0, len(odd), 3_000):
            texts = odd[at : at + 3_000]
            assert encoder.encode(pa.array(["apart", *texts])[1:], b"\0\0") == [x + b"\0\0" for x in whole(texts)]
    assert encoder.encode(pa.array([], pa.string()), b"\0\0") == [] and encoder.encode(pa.array([""]), b"\0\0") == [b"\0\0"]
    # Marks behind a word make no new part, and what was seen before isn't encoded again.
    encoder, calls[:] = PartEncoder(encode_many, whole, [], 100), []
    for _ in range(2):
        encoder.encode(pa.array(["word, word. word! word", "a word, (word)"]), b"\0\0")
    assert sorted(calls) == sorted({"word", ",", " word", ".", "!", "a", " (", ")"})


def test_byte_bpe_equals_the_library(spark, edge, documents):
    import base64

    import tiktoken

    path = public_path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    differences = byte_bpe.class_differences(public_tokenizers.PATTERN)
    encoder = ChunkEncoder(byte_bpe._piecewise(path, public_tokenizers.PATTERN, differences), 2_000)
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab \n\t  é漢1!'s😀\r x") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts = [t or "" for _, t in EDGE if t is None or len(t) < 200] + odd + list(documents.values())
    texts += [f"x{chr(c)}'d {chr(c)}, a{chr(c)}a" for c in [*differences][::7]] + ["\n\n\na", "a\n\nb\n", "a" * 257, "".join(rng.choice("aeinrst") for _ in range(20_000)), "".join(rng.choice("ab") for _ in range(250))]
    for text, ids in zip(texts, encoder.encode_spaced(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(edge, path, public_tokenizers.PATTERN), path)
    assert Counter(bytes(r.bytes) for r in back.collect()) == Counter((t or "").encode() for _, t in EDGE)
    assert byte_bpe.encode_documents(edge.limit(0), path, public_tokenizers.PATTERN, digests=True).count() == 0


def test_corpus_dictionary(spark):
    """The corpus's chunks by count, however its blocks lie; equal counts are all in or all out."""
    rows = [(i, " ".join(["often"] * 6 + ["twice"] * (i % 2 * 2) + [f"rare{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    seen = {r.chunk: r.n for r in byte_bpe.corpus_chunks(docs, 100).collect()}
    assert seen["often"] == 100 and seen["twice"] == 20 and not any(x.startswith("rare") for x in seen)
    assert {r.chunk for r in byte_bpe.corpus_chunks(docs, 1).collect()} == {"often"}


def test_chunks_give_the_library_s_ids():
    """Around marks, white space, special tokens and letters that change under normalisation."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    letters = [chr(c) for c in (0x130, 0x958, 0x95F, 0xF52, 0xF43, 0x345, 0x301, 0x18FD1, 0xDF, 0xFF, 0xAA, 0x1E9E, 0x1C5, 0x3A3)]
    texts = [f"a{c}. {c}, b{c}' {c}.{c}" for c in letters] + ["<|endoftext|>", "a <|endoftext|>. b\n", "x<|startoftext|>, y", "<|", "a\n\nb", "a\n\n\nb", "\na", "a ", ""]
    texts += ["".join(rng.choice([*letters, *" \n\t\u00a0\u3000\x1cab.,'&"]) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    for name, encode in (("byte_bpe_50k.json", "encode_spaced"), ("word_bpe_49k.json", "encode_words")):
        for specials_as_text in (False, True):
            tok = Tokenizer.from_file(public_path(name))
            tok.encode_special_tokens = specials_as_text
            encoder = tokenizers_encoder(public_path(name), 4, specials_as_text)
            for text, ids, e in zip(texts, getattr(encoder, encode)(texts), tok.encode_batch(texts, add_special_tokens=False)):
                assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(text)


PLACES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licences(spark, documents):
    rows = [(i, t) for i, t in documents.items()]
    rows += [(-1, "The MIT License and the mit license; GNU General Public License gnu general public license CC BY-NC 4.0"), (-2, None), (-3, "Licensed under the Apache License, Version 2.0 mit"), (-4, next(t for _, t in licences.TEMPLATES if t.startswith("permission is hereby")).replace("free of charge", "at no cost"))]
    got = {r.doc_id: r for r in licences.licence_digest(licences.scan_licences(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = PLACES.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(label, at) for phrase, label in licences.BASE.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        at = [p for _, p in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[-4].labels == "mit" and 0.6 <= got[-4].score < 1 and "apache-2.0" in got[-3].labels and got[-2].score == 0


def test_licence_templates_that_stand_whole():
    scanner, rng = licences.LicenceScanner(), random.Random(3)
    texts = [t for _, t in licences.TEMPLATES] + [" ".join(rng.choice(["some words", *(t for _, t in licences.TEMPLATES)]) for _ in range(8)) for _ in range(20)]
    data, offsets = buffers(pa.array(texts))
    for text, (_, _, spans) in zip(texts, scanner.scan(data, offsets)):
        words = text.split()
        own = [(label, t.split()) for label, t in licences.TEMPLATES]
        standing = {(label, at, at + len(t), 1.0) for label, t in own for at in range(len(words)) if words[at : at + len(t)] == t}
        assert standing == {s for s in spans if s[3] == 1.0}
    full = next(t for label, t in licences.TEMPLATES if label == "apache")
    ((_, _, spans),) = scanner.scan(*buffers(pa.array([full])))
    assert {s[0] for s in spans} == {"apache", "apache-2.0"}


def test_licences_of_long_and_odd_texts(spark):
    import time

    notice = next(t for label, t in licences.TEMPLATES if label == "bsd")
    scanner = licences.LicenceScanner()

    def took(n):
        began = time.process_time()
        ((words, _, spans),) = scanner.scan(*buffers(pa.array([f"{notice} " * n])))
        assert words == n * len(notice.split()) and sum(s[0] == "bsd" and s[3] == 1 for s in spans) == n
        return time.process_time() - began

    took(10)
    assert took(4000) < 8 * max(took(1000), 0.05)
    got = licences.scan_licences(spark.createDataFrame([(*r, 1, "x") for r in EDGE], SCHEMA + ", n_words long, base string")).collect()
    assert len(got) == len(EDGE) and licences.scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_spans(words, template, gap, least):
    """Coverage by chains of maximal common runs, by trying every run of every other text."""
    runs = []
    for i in range(len(words)):
        for j in range(len(template)):
            if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                n = 0
                while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                    n += 1
                if n >= licences.MIN_MATCH:
                    runs.append((i, j, n))
    return runs


def test_licence_spans_lie_on_common_runs():
    """Every span that the method adds consists of common runs with a template of its label that cover the share it tells."""
    scanner, rng = licences.LicenceScanner(), random.Random(11)
    texts = []
    for _ in range(60):
        _, t = rng.choice(licences.TEMPLATES)
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["other", "words", "the", "license"])
        texts.append(" ".join(["before", "this", *words, "after", "it"]))
    added = 0
    for text, (_, _, spans) in zip(texts, scanner.scan(*buffers(pa.array(texts)))):
        words = text.split()
        for label, start, end, covered in spans:
            options = []
            for own, t in licences.TEMPLATES:
                if own == label:
                    inside = [r for r in plain_spans(words, t.split(), licences.GAP, licences.COVER) if start <= r[0] and r[0] + r[2] <= end]
                    options.append(len({i for a, _, n in inside for i in range(a, a + n)}) / len(t.split()))
            assert covered >= licences.COVER and max(options, default=1.0) >= min(covered, 1.0) - 1e-6 or covered == 1.0
            added += 1
    assert added > 30


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(2, 12))] for _ in range(5)]
    automaton = licences.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        words = [rng.randint(1, 4) for _ in range(20)]
        for end, (state, size) in enumerate(automaton.stream(words), 1):
            assert size == max((n for n in range(1, end + 1) if tuple(words[end - n : end]) in runs), default=0)
            if size:
                for k, last in automaton.ends[state]:
                    assert sequences[k][last - size + 1 : last + 1] == words[end - size : end]


def test_html_of_the_test_pages(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        text = "\n\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (text, len(text))


PAGE = """<html><body class="with-sidebar"><header><p>Site title, slogan.</p></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, really.</div>
<main><h2>Head &amp; more</h2><p>One   long paragraph, with commas, and more text.<p>Short.<ul><li>first<li>second</ul><script>var x = "<p>no</p>";</script><form><label>Name</label></form>
<aside>Related things, many.</aside><div class="comments"><p>A reader comment, quite long, with commas, and so on.</p></div></main><footer>&copy; 2020</footer></body></html>"""


def test_html_parts():
    assert html_text.main_text(PAGE) == "Head & more\n\nOne long paragraph, with commas, and more text.\n\nShort.\n\nfirst\n\nsecond"
    assert html_text.main_text(PAGE.replace("<main>", "<div>").replace("</main>", "</div>")).startswith("Head & more")
    assert [html_text.main_text(x) for x in (None, "", "<html><nav>x</nav>", "<p")] == ["", "", "", "<p"]
    assert html_text.main_text("plain text, no tags") == "plain text, no tags"


def test_html_body_outside_of_articles():
    body = [f"Paragraph {i} of the body, long enough, with commas, to be told from a card; and so it goes on, sentence after sentence." for i in range(6)]
    cards = "".join(f"<article><h3>Card {i}</h3><p>A teaser.</p></article>" for i in range(3))
    text = "".join(f"<p>{b}</p>" for b in body)
    # Cards stay too where their paths are over the share of the highest value, but never instead of the body.
    assert html_text.main_text(f"<body><div id=content>{text}</div><div class=cards>{cards}</div></body>").startswith("\n\n".join(body))
    # Bodies in several articles of equal weight all stay, and so does one beside an article that isn't most of the page.
    several = html_text.main_text("<body>" + "".join(f"<article><p>{b}</p></article>" for b in body) + "</body>")
    assert several == "\n\n".join(body)
    assert html_text.main_text(f"<body><div id=content>{text}</div><article><p>{body[0]}</p></article></body>") == "\n\n".join([*body, body[0]])
    # An article with most of the page is the node: its short parts stay, a line beside it doesn't.
    assert html_text.main_text(f"<body><p>A line, beside.</p><article><h1>Head</h1>{text}</article></body>") == "\n\n".join(["Head", *body])


def test_html_sources_within_an_article():
    body = "A long paragraph, with commas, so that its path is content; and so it goes on, sentence after sentence. " * 3
    sources = '<ul><li><a href="/a">First source</a></li><li><a href="/b">Second source</a></li></ul>'
    menu = '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="related"><a href="/c">Another page</a></div>'
    for tag in ("article", "main"):
        assert html_text.main_text(f"<body>{sources}<{tag}><p>{body}</p>{sources}{menu}</{tag}></body>") == f"{body.strip()}\n\nFirst source\n\nSecond source"


def test_html_ratios_choose_the_text(monkeypatch):
    """Without lists of names and article elements the values of paths choose; with equal values all blocks are text."""
    body = [f"Paragraph {i} of the body, long enough, with commas, to be told from a menu; and so it goes on, sentence after sentence." for i in range(5)]
    page = "<body><div class=x1>" + "".join(f"<p>Item {i}</p>" for i in range(6)) + "</div><div class=x2><h1>Head</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</div><div class=x3>Made by us</div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Head", *body])
    monkeypatch.setattr(html_text, "path_values", lambda paths: [1.0] * len(paths.parent))
    assert html_text.main_text(page).startswith("Item 0") and html_text.main_text(page).endswith("Made by us")
    assert "Home" in html_text.main_text(PAGE)


def test_html_keeps_what_is_no_other_part():
    body = "A long paragraph, with commas, so that its path is content; and so it goes on, sentence after sentence."
    for piece, text in (
        ('<p class="share-price">The price, of a share, rose.</p>', "The price, of a share, rose."),
        ('<p id="comment-on-policy">A comment, on policy.</p>', "A comment, on policy."),
        ('<div class="search-results-text">What was found.</div>', "What was found."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>", "Let x=1."),
        ("<object data=x>", ""),
        ("<svg>", ""),
        ("<audio>", ""),
        ("<svg><text>drawn</text></svg>", ""),
        ('<div class="cookie-notice">We use cookies.</div>', ""),
        ('<ul class="share-buttons"><li>Send</li></ul>', ""),
    ):
        for tag in ("article", "div"):
            want = "\n\n".join(x for x in (body, text, body) if x)
            assert html_text.main_text(f"<body><{tag}><p>{body}</p>{piece}<p>{body}</p></{tag}></body>") == want, piece


def test_html_time_follows_the_length():
    import time

    shapes = ("<div>x", '<a "', '<a b="', "<object>x", '<a b="x>', "<", '<span class="ad">x', "</b></p>", "<p>a</div>")
    for shape in shapes:
        html_text.main_text(shape * 100)
        times = []
        for n in (4_000, 32_000):
            began = time.process_time()
            html_text.main_text(shape * n)
            times.append(time.process_time() - began)
        assert times[1] < 24 * max(times[0], 0.02), shape


def test_html_edges(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "<p>a</p>", "z")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "a"]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return {(doc_id, len(sets[i]), min(x for x in least[find(i)] if x is not None) if any(x is not None for x in least[find(i)]) else None) for i, (doc_id, _) in enumerate(rows)}


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["", "é"]) + "".join(rng.choice("abcdefg") for _ in range(3))
    rows, n = list(EDGE[:6]) + [(None, "lost id")], 10
    for size in (3, 6, 12, 40, 300):
        base = [word() for _ in range(size)]
        for _ in range(25):  # a chain of edits, so that components are wider than links
            rows.append((n, " ".join(base)))
            n += 1
            if rng.random() < 0.8:
                base = list(base)
                base[rng.randrange(len(base))] = word()
    shared = [word() for _ in range(60)]
    rows += [(n + i, " ".join(shared + [word() for _ in range(rng.randint(5, 40))])) for i in range(40)]
    rng.shuffle(rows)
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == plain_components(rows) and len(got) == len(rows)
    rest = near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert sorted(str(r.doc_id) for r in rest.collect()) == sorted({str(r.doc_id) for r in got if r.kept})


def test_near_dedup_edges(spark):
    """Null ids, repeated rows, and columns with names of helpers: one row of each group stays as it is."""
    copy, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, copy), (None, copy), (None, copy), (2, copy), (2, copy), (None, other), (None, other), (3, None), (3, ""), (4, "w " * 20_000)]
    docs = spark.createDataFrame([(*r, f"mine{i}", i, "x") for i, r in enumerate(rows)], SCHEMA + ", h string, id long, hash string")
    got = near_dedup.near_groups(docs).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(map(str, [(1, 1, True), (None, 1, False), (None, 1, False), (2, 1, False), (2, 1, False), (None, None, True), (None, None, False), (3, 3, True), (3, 3, True), (4, 4, True)]))
    rest = near_dedup.drop_near_copies(docs)
    kept = sorted((r.doc_id or 0, r.text or "", r.h) for r in rest.collect())
    assert rest.columns == docs.columns and [k[:2] for k in kept] == [(0, other), (1, copy), (3, ""), (3, ""), (4, "w " * 20_000)]
    assert all(rows[int(h[4:])][1] in (text, None) for _, text, h in kept)
    assert near_dedup.near_groups(docs.limit(0)).count() == 0 and near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def family(rng, n, edits, words=60):
    """Texts that each change some words of one base, so that their pairs lie around one similarity."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            own[at] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_dedup_of_a_large_family(spark):
    """Pairs on both sides of the threshold: links equal brute force, and a tile's links stay below its members."""
    rng = random.Random(13)
    rows = list(enumerate(family(rng, 700, (0, 1, 1, 2))))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = near_dedup.near_groups(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    assert len({r.component_id for r in got}) > 1


def test_near_dedup_tiles_emit_forests(spark, monkeypatch):
    rng = random.Random(14)
    rows = list(enumerate(family(rng, 400, (1, 1, 2))))
    told = {}
    for name in ("_suspects", "_link_tiles"):
        plain = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *a, f=plain, name=name: told.setdefault(name, f(*a)))
    near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).count()
    if "_link_tiles" in told:
        assert told["_link_tiles"].count() < len(rows) * near_dedup.QUERY.bands


def test_near_dedup_recall_of_bands_and_estimates():
    """Of pairs just over the threshold, over many set sizes, all share a band and pass the estimate."""
    rng = np.random.default_rng(15)
    for cut in (near_dedup.QUERY, near_dedup.Cut(80)):
        lost = pairs = 0
        for size in (10, 20, 40, 64, 65, 100, 200, 500, 1000, 2000):
            for _ in range(60 if size > 400 else 200):
                both = -(-size * cut.percent // 100)  # |A n B| of |A u B| = size
                pool = rng.integers(0, 2**64, size, dtype=np.uint64)
                own = (size - both) // 2
                a, b = np.sort(pool[: both + own]), np.sort(np.concatenate([pool[:both], pool[both + own :]]))
                bands = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), cut)
                codes, n = near_dedup.registers(bands, cut), (np.array([len(a)]), np.array([len(b)]))
                pairs += 1
                lost += not ((bands[0] == bands[1]).any() and near_dedup.worth_verifying(codes[:1], codes[1:], *n, cut)[0])
        assert pairs > 1000 and lost == 0


def test_near_dedup_at_a_given_threshold(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows, near = [], set()
    for i in range(40):  # 104 words: 100 shingles, of which an edit in the middle changes five
        base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(104)]
        edited = list(base)
        for at in (20, 50):  # 90 of 110 shingles: 0.82
            edited[at] += "x"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
        near.add(2 * i)
    both = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert all(0.8 <= x < 0.85 for x in both)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()} == near
    assert near_dedup.drop_near_copies(docs).count() == len(rows)
    assert {r.component_id for r in near_dedup.near_groups(docs, 80).collect()} == near


def test_what_follows_from_the_threshold():
    for percent, band, bands, least in ((85, 6, 32, 0.72), (80, 5, 38, 0.65)):
        cut = near_dedup.Cut(percent)
        assert (cut.band, cut.bands, cut.least_estimate) == (band, bands, least)
        assert (1 - (percent / 100) ** band) ** bands < near_dedup.MISSED


def test_sketch_estimates_are_close():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[100:1100])
    codes = near_dedup.registers(near_dedup.sketches(np.concatenate([a, b]), np.array([0, 1000, 2000])))
    (estimate,) = near_dedup.estimates(codes[:1], codes[1:], np.array([1000]), np.array([1000]))
    assert abs(estimate - 900 / 1100) < 0.16


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[x] for x in (1, 2, 3, 9)} == {1} and got[6] == 5 and {got[100 + i] for i in range(31)} == {100} and 7 not in got


def test_secrets(spark, documents):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    rows = [(i, t) for i, t in documents.items()]
    rows += [(-1, f"x é PassWord: '{key}' AKIA{'Q7' * 8} tokens = short"), (-2, None), (-3, ""), (-4, f"{key}AKIA{'Q' * 11} {key}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs, model)).collect()}
    patterns = [
        ("assign", r"""(?a)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8),
        ("access", r"(AKIA[A-Z0-9]+)", 0, 16),
        ("hex", r"([0-9a-f]+)", 0, 32),
    ]
    for i, text in rows:
        base = []
        for k, (kind, pattern, flags, least) in enumerate(patterns):
            base += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[1]) >= least]
        listed = [x for _, _, x in sorted(base)]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("crf")] == listed
    masked = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert key not in masked[-1] and masked[-1].startswith("x é [SECRET]") and masked[-2] is None and masked[0] == documents[0]


def test_secret_sample_looks_at_all_rows(spark):
    # One text with a secret in 150,000, at the end of the order by hash.
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit("nothing here").alias("text"))
    key = F.xxhash64(F.lit("secrets"), "doc_id")
    last = docs.orderBy(F.pmod(key, F.lit(1_000_000)).desc(), key.desc()).first().doc_id
    hit = "password = hunter2hunter2"
    docs = docs.withColumn("text", F.when(F.col("doc_id") == last, hit).otherwise(F.col("text")))
    assert hit in secrets.sample_texts(docs, 20)
    assert len(secrets.sample_texts(docs, 20)) == 11


def test_field_finds_unlisted_secrets(documents):
    """Keys behind names that no pattern lists are found, look-alikes behind the same names are not; base spans stay as they are."""
    texts = list(documents.values())
    model = secrets.fit(texts)
    assert not any(model.runs(*buffers(pa.array([t], pa.large_string())))[0] for t in texts if not secrets.base_spans(*buffers(pa.array([t], pa.large_string())))[0])
    rng = random.Random(77)
    names = ["pwd", "auth_key", "clientid", "bearer", "credential", "passphrase", "session-key", "tokn"]
    words = [w for t in texts for w in t.split()]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))
    keys = [secrets._key(rng) for _ in range(200)]
    hidden = [f"{prose()} {rng.choice(names)}{rng.choice([' = ', '=', ': '])}'{k}' {prose()}" for k in keys]
    clean = [f"{prose()} {rng.choice(names)} = '{secrets._look_alike(rng, words)}' {prose()}" for _ in range(200)]
    found = [[t[a:b] for kind, a, b in own if kind == "crf" or kind == "hex"] for t, own in zip(hidden, secrets._spans(model, *buffers(pa.array(hidden, pa.large_string()))))]
    assert sum(k in own for k, own in zip(keys, found)) >= 160
    told = sum(kind == "crf" for own in secrets._spans(model, *buffers(pa.array(clean, pa.large_string()))) for kind, _, _ in own)
    assert told <= 10


def test_secrets_of_odd_texts(spark, edge):
    model = secrets.train(edge)
    got = secrets.secret_digest(secrets.scan_secrets(edge, model)).collect()
    assert len(got) == len(EDGE) and not any(r.spans for r in got)
    assert secrets.redact(edge, model).columns == edge.columns and sorted(map(str, secrets.redact(edge, model).collect())) == sorted(map(str, edge.collect()))
    empty = edge.limit(0)
    assert secrets.scan_secrets(empty, secrets.train(empty)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + "password = hunter2hunter2")], SCHEMA)
    (r,) = secrets.secret_digest(secrets.scan_secrets(long, model)).collect()
    assert (r.n_assign, r.spans) == (1, "assign:1000000:1000025")


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    got = packing.pack_documents(edge, public_path("word_bpe_49k.json")).collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in EDGE:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = [r for r in got if r.doc_id == doc_id]
        cut = [(k, at, ids[at : at + 2048]) for k, at in enumerate(range(0, len(ids), 2048))]
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in own} == {(k, at, len(x), zlib.crc32(x.tobytes())) for k, at, x in cut}
    assert packing.pack_documents(edge.limit(0), public_path("word_bpe_49k.json")).count() == 0


def test_packing_of_equal_lengths(spark):
    """Ties: equal pieces fill sequences, wherever each of them lies."""
    frame = spark.createDataFrame([(1, 0, 512)] * 400 + [(None, 0, 2048)] * 3, "doc_id long, piece int, length long")
    got = packing.pack(frame).collect()
    by = Counter((r.sequence_id, r.offset) for r in got)
    assert len(got) == 403 and max(by.values()) == 1 and len({r.sequence_id for r in got}) == 103


def test_packing_is_dense(spark):
    rng = random.Random(9)
    sizes = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    frame = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    n = packing.pack(frame).select("sequence_id").distinct().count()
    assert n <= 1.01 * sum(sizes) / 2048 + 1


def test_sum_of_squares_places_by_the_rule():
    rng = random.Random(10)
    packer, gaps = packing.SumOfSquares(50), Counter()
    used = {}
    for _ in range(300):
        size = rng.randint(1, 50)
        cost = lambda c: sum(v * v for g, v in c.items() if g)
        options = [cost(gaps + Counter([50 - size]))]
        for g in gaps:
            if g >= size and gaps[g]:
                options.append(cost(gaps - Counter([g]) + Counter([g - size])))
        own, offset = packer.place(size)
        if offset:
            gaps = gaps - Counter([50 - offset])
        gaps = gaps + Counter([50 - offset - size])
        assert used.get(own, 0) == offset and cost(gaps) == min(options)
        used[own] = offset + size
