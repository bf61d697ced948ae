"""Corpus pipeline: stages over documents, each calling one training-data operator.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of documents. run() writes each stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from pairloom.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from pairloom.llm.tables import table
from pairloom.llm.tokenizer_files import public_path
from pairloom.session import materialize


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is 0.5 or more go; labels are those of the corpus."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark, docs, sf_dir):
    """Of texts equal but for white space, the longest original stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each near-duplicate group stays; five-word Jaccard of 0.8 or more links."""
    return near_dedup.drop_near_copies(docs, percent=80)


def redact_secrets(spark, docs, sf_dir):
    """Secrets are masked; no document goes."""
    return secrets.redact(docs, secrets.train(docs))


#: Entries of the packing stage's memo: its workers stand beside a heap that the stages before have filled.
MEMO = 300_000


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), entries=MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, sketches and tokenizers aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
