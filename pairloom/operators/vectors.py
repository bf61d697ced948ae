"""Measures on vectors: cosine of given embeddings, and averaged word vectors in place of a per-pair document model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import vector_cosine, words


def embedding_cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (id1, id2) with score; vectors are (id, v)."""
    side = lambda k: vectors.select(F.col("id").alias(f"id{k}"), F.col("v").cast("array<double>").alias(f"v{k}"))
    joined = pairs.join(side(1), "id1").join(side(2), "id2")
    return joined.select(*pairs.columns, vector_cosine(F.col("v1"), F.col("v2")).alias("score"))


def word_vector_scores(pairs: DataFrame, size: int = 30, window: int = 5, seed: int = 1) -> DataFrame:
    """Cosine of the mean word vectors of both texts; the vectors are fitted once on all texts of the pairs."""
    tokens = lambda c: words(F.lower(F.coalesce(F.col(c), F.lit(""))))
    texts = pairs.select(tokens("code1").alias("words")).union(pairs.select(tokens("code2").alias("words")))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol="words", outputCol="v").fit(texts)
    first = model.transform(pairs.withColumn("words", tokens("code1"))).withColumn("v1", vector_to_array("v")).drop("v", "words")
    both = model.transform(first.withColumn("words", tokens("code2"))).withColumn("v2", vector_to_array("v")).drop("v", "words")
    return both.withColumn("score", vector_cosine(F.col("v1"), F.col("v2"))).drop("v1", "v2")


def provided_cosine(pairs: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """pairs with score, the cosine of the vectors that a model gives for code1 and code2.

    provider is called once a Python worker's task and loads the model there (from a local folder, say); what it returns makes a
    matrix of a list of texts. Null texts are empty; a zero vector scores 0.
    """

    def run(batches):
        embed = provider()
        for rows in batches:
            at = [rows.schema.get_field_index(c) for c in ("code1", "code2")]
            for start in range(0, len(rows), batch):
                part = rows.slice(start, batch)
                x, y = (np.asarray(embed(part.column(i).fill_null("").to_pylist()), float) for i in at)
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                score = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*rows.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{schema}, score double")
