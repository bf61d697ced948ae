"""The pipeline and every registered training-data query run over the small tables."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import blank_free, plain_components, shingles

import __spark_entry__
import corpus_pipeline
from pairloom.llm import registry, secrets, toxicity
from pairloom.llm.tokenizer_files import public_path
from pairloom.session import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    assert docs.select("doc_id").distinct().count() == n > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    """The test documents with cases: copies, near copies at 0.82, secrets, a long text, nulls, ties, and columns with names of helpers."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = [f"word{i}" for i in range(104)]
    edited = [w + "x" if i in (20, 50) else w for i, w in enumerate(base)]
    own = [" ".join(base), " ".join(edited), "a tie  here", "a tie here ", None, "", None, "say password = hunter2hunter2 é and AKIA" + "Q7" * 8, "long " * 30_000, "short one", "short one"]
    rows += [(10**6 + i, t, "xx", "cases", len(t) if t is not None else None) for i, t in enumerate(own)]
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, hash int")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_stages_equal_plain_versions(spark, sf_dir, corpus):
    """Each stage on what its predecessor kept: toxicity by the scores of its model, the others by plain Python."""
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(corpus, "cases")
    out = materialize(stages["toxicity"](spark, docs, sf_dir), "cases")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    before, after = texts_of(docs), texts_of(out)
    assert out.columns == docs.columns and after == {i: t for i, t in before.items() if scores[i] < 0.5} and len(after) < len(before)

    docs, before, out = out, after, materialize(stages["exact dedup"](spark, out, sf_dir), "cases")
    groups = defaultdict(list)
    for i, t in before.items():
        groups[blank_free(t or "")].append((-len(t or ""), i))
    after = texts_of(out)
    assert out.columns == docs.columns and after == {i: before[i] for _, i in (min(g) for g in groups.values())}

    docs, before, out = out, after, materialize(stages["near dedup"](spark, out, sf_dir), "cases")
    component = {i: c for i, _, c in plain_components(list(before.items()), 80)}
    after = texts_of(out)
    assert out.columns == docs.columns and after == {i: t for i, t in before.items() if component[i] == i}
    assert 10**6 in after and 10**6 + 1 not in after and 0.8 <= len(shingles(before[10**6]) & shingles(before[10**6 + 1])) / len(shingles(before[10**6]) | shingles(before[10**6 + 1])) < 0.85

    docs, before, out = out, after, materialize(stages["secrets"](spark, out, sf_dir), "cases")
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(docs, secrets.train(docs)).collect()}
    plain = re.compile(r"""(?a:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})|(?-i:AKIA[A-Z0-9]{12,})|(?-i:[0-9a-f]{32,})""", re.I)
    for r in out.collect():
        text = before[r.doc_id]
        if not any(s.kind == "crf" for s in spans[r.doc_id]):
            assert r.text == (plain.sub("[SECRET]", text) if text is not None else None)
            assert r.n_chars == (len(r.text) if r.text != text else r.n_chars)
    after = texts_of(out)
    assert out.columns == docs.columns and set(after) == set(before) and after[10**6 + 7] == "say [SECRET] é and [SECRET]"

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    packed = stages["packing"](spark, out, sf_dir).collect()
    places, own = defaultdict(list), defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for sequence in places.values():
        ends = [a + n for a, n in sorted(sequence)]
        assert [a for a, _ in sorted(sequence)] == [0, *ends[:-1]] and ends[-1] <= 2048
    for i, text in after.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert sorted(own[i]) == [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]


def test_stages_of_an_empty_table(spark, sf_dir, corpus):
    docs = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == corpus.columns)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    key, table = ("page_id", "pages") if name.startswith("op6_") else ("doc_id", "documents")
    assert got.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert name in __spark_entry__.queries()


def test_oracles(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in registry.ORACLES.items():
        mine, other = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        columns = sorted(other.columns)
        assert mine[columns].astype(str).sort_values(columns).values.tolist() == other.astype(str)[columns].sort_values(columns).values.tolist()
