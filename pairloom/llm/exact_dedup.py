"""Exact dedup by a tree-merge of sorted digest runs (operator 1).

Each partition of the input is a run: its rows reduced to (digest, length) keys with the
survivor and the count so far. Runs then meet in rounds: in each, 2^fan runs merge into one
(run >> fan), keeping for each verified key the smallest survivor, until one run number is
left. A key therefore arrives at a task at most 2^fan times a round, however many copies there
are, and the merge of a round is dealt out by (run, key), so no task ever holds a whole run.

Keys are the SHA-256 of the normalised text together with its length, which verifies a match.
Null texts are empty; the empty text is a group like any other. The survivor has most code
points in the original, then the smallest doc_id (null last), then the first row. Repeated
rows are members like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.joins import by_keys
from pairloom.llm.tables import BLANKS, NO_ID, free_names, id_and_text, ids_last
from pairloom.session import materialize

FAN = 3
_KEY = ["digest", "size"]


def digest_rows(docs: DataFrame) -> DataFrame:
    """(row, run, digest, size, rank) for each document, written to the shared folder: small rows, read by all later steps."""
    bare = F.regexp_replace("text", BLANKS, "")
    keyed = (
        id_and_text(docs)
        .select("doc_id", F.char_length("text").alias("n_chars"), bare.alias("bare"))
        .select("doc_id", "n_chars", F.sha2(F.col("bare").cast("binary"), 256).alias("digest"), F.octet_length("bare").alias("size"))
        .withColumn("run", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("rank", F.struct((-F.col("n_chars")).alias("less"), ids_last(F.col("doc_id")).alias("id"), "row"))
    )
    return materialize(keyed.select("doc_id", "row", "run", *_KEY, "rank"), "digests")


def merge_runs(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each key: digest, size, best (the survivor's rank), n."""
    last = rows.agg(F.max("run")).first()[0] or 0
    merged = rows.groupBy("run", *_KEY).agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    while last:
        merged = merged.withColumn("run", F.shiftright("run", fan)).groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        last >>= fan
    return merged.drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row, digest, keep_id, keep_row, group_size, kept."""
    rows = digest_rows(docs)
    groups = merge_runs(rows)
    # A run's keys meet the groups first: a group of copies then counts once a run, not once a row.
    per_run = rows.select("run", *_KEY).distinct().join(groups, _KEY)
    own = rows.join(per_run, ["run", *_KEY])
    keep = F.when(F.col("best.id") == NO_ID, None).otherwise(F.col("best.id"))
    return own.select("doc_id", "row", "digest", keep.alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The survivors with all their columns: one row of each group.

    Rows that go are found by doc_id and digest; a survivor that is repeated with its doc_id is
    reduced to one row, which costs a shuffle of such rows alone. Columns may have any names.
    """
    id_col, digest, longest, best_row = free_names(docs, "id", "digest", "longest", "best")
    groups = materialize(exact_groups(docs).select("doc_id", "digest", "kept"), "groups")
    pairs = groups.groupBy(ids_last(F.col("doc_id")).alias(id_col), F.col("digest").alias(digest)).agg(F.max("kept").alias("__stays"), F.count("*").alias("__n"))
    pairs = materialize(pairs.filter("NOT __stays OR __n > 1"), "goners")
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, "")
    on = [id_col, digest]
    keyed = docs.withColumn(id_col, ids_last(F.col("doc_id").cast("long"))).withColumn(digest, F.sha2(bare.cast("binary"), 256))
    rest = by_keys(keyed, pairs.select(*on), on, "left_anti").select(*docs.columns)
    repeated = pairs.filter("__stays AND __n > 1").select(*on)
    if repeated.isEmpty():
        return rest
    own = by_keys(keyed, repeated, on).withColumn(longest, F.char_length(F.coalesce("text", F.lit(""))))
    best = own.groupBy(*on).agg(F.max_by(F.struct(*docs.columns), longest).alias(best_row))
    return rest.union(best.select(f"{best_row}.*"))
