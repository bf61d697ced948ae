"""The thin queries over the operators: each returns the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, exact_dedup, html_text, licences, media, near_dedup, packing, secrets, token_store, toxicity
from pairloom.llm.tables import table
from pairloom.llm.tokenizer_files import public_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_store.tokenize_to_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, folder, manifest)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), spans=True)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_features(table(spark, sf_dir, "documents"))
    coded = F.array_join(F.transform("fingerprint", lambda x: x.cast("string")), ",")
    return read.withColumn("feature", F.concat_ws(":", F.size("fingerprint").cast("string"), F.md5(coded)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digest(licences.scan_licences(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secret_digest(secrets.scan_secrets(docs, secrets.train(docs)))
