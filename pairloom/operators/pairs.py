"""Pair joins and filters. Joins are equi-joins on identifiers, so Catalyst picks broadcast or sort-merge by the sides' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_code(pairs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(id1, id2, ...) with code1 and code2; pairs that lack a snippet, or have an empty one, drop out."""
    side = lambda k: snippets.select(F.col("idx").alias(f"id{k}"), F.col("func").alias(f"code{k}"))
    return with_code(pairs.join(side(1), "id1").join(side(2), "id2"))


def with_code(pairs: DataFrame) -> DataFrame:
    return pairs.filter("code1 <> '' AND code2 <> ''")


def case_pairs(tree: DataFrame) -> DataFrame:
    """Each case's single original with its variants, plagiarized labelled 1; cases without exactly one original drop out."""
    originals = tree.filter("kind = 'original'").groupBy("case_id").agg(F.count("*").alias("n"), F.first("code").alias("code1")).filter("n = 1").drop("n")
    variants = tree.filter("kind <> 'original'").select("case_id", "level", F.col("code").alias("code2"), (F.col("kind") == "plagiarized").cast("int").alias("label"), "path")
    return variants.join(originals, "case_id").select("case_id", "level", "path", "code1", "code2", "label")


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Consecutive turns of a conversation; label 1 where the first is the user's. An equi-join on (conv_id, turn)."""
    a = conversations.select("conv_id", "turn", F.col("text").alias("code1"), (F.col("role") == "user").cast("int").alias("label"))
    b = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("code2"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "code1", "code2", "label")


def by_id(pairs: DataFrame, pair_id: str, column: str = "id") -> DataFrame:
    return pairs.filter(F.col(column) == pair_id)
