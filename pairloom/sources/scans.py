"""Scans of snippets, pairs, labelled trees and feature files. Paths go through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.order import numbered

SNIPPET = "idx string, func string"
PAIR_JSON = "code1 string, code2 string, score int"
CURATED = "id string, language string, clone_type int, label int, code_a string, code_b string, explanation string"
WIDTH = 22


def snippets(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One JSON object a line. Of a repeated idx the last line counts, of several files that of the last path; strict fails on malformed lines or missing keys."""
    raw = spark.read.schema(SNIPPET).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if strict:
        return raw.withColumn("idx", F.coalesce("idx", F.raise_error(F.lit("snippet without idx")).cast("string"))).withColumn("func", F.coalesce("func", F.raise_error(F.lit("snippet without func")).cast("string")))
    # Blocks of a file may be read in any order; within a block the identifier grows with the lines.
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.withColumn("__at", at).groupBy("idx").agg(F.max_by("func", "__at").alias("func"))


def pair_list(spark: SparkSession, path: str, tabs: bool = False) -> DataFrame:
    """Lines of id1, id2, label between white space (or tabs); a line with other than three fields fails."""
    fields = F.split("value", "\t") if tabs else F.split(F.trim("value"), r"\s+")
    bad = F.raise_error(F.concat(F.lit("pair line without three fields: "), F.col("value")))
    checked = spark.read.text(path).filter(F.trim("value") != "").select(F.when(F.size(fields) == 3, fields).otherwise(bad.cast("array<string>")).alias("f"))
    return checked.select(F.col("f")[0].alias("id1"), F.col("f")[1].alias("id2"), F.col("f")[2].cast("int").alias("label"))


def pair_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON list of {code1, code2, score}."""
    return spark.read.schema(PAIR_JSON).option("multiLine", True).json(path)


def labelled_tree(spark: SparkSession, root: str) -> DataFrame:
    """case-NN/{original,plagiarized/Lx/NN,non-plagiarized/NN}/*.java as (path, case_id, kind, level, code)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java")
    path = F.input_file_name()
    part = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    return files.select(path.alias("path"), F.col("value").alias("code")).select(
        "path", part(r"/(case-[^/]+)/").alias("case_id"), part(r"/case-[^/]+/(original|plagiarized|non-plagiarized)/").alias("kind"), part(r"/plagiarized/(L\d+)/").alias("level"), "code"
    )


def curated_pairs(spark: SparkSession, path: str, language: str | None = None, clone_type: int | None | str = "any") -> DataFrame:
    """Curated pairs; language by containment, clone_type by null-safe equality (None picks the negatives)."""
    pairs = spark.read.schema(CURATED).option("multiLine", True).json(path)
    if language is not None:
        pairs = pairs.filter(F.contains("language", F.lit(language)))
    return pairs if clone_type == "any" else pairs.filter(F.col("clone_type").eqNullSafe(F.lit(clone_type)))


def feature_rows(spark: SparkSession, path: str, mode: str = "skip", max_rows: int | None = None) -> DataFrame:
    """Lines that are JSON arrays of 22 numbers: (line, values). mode: skip drops others, report keeps them in column bad, fail stops.

    max_rows keeps the first valid lines.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.withColumn("values", F.from_json("value", "array<double>", {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.size("values") == WIDTH, F.lit(False)) & ~F.exists(F.coalesce("values", F.array()), lambda v: v.isNull())
    if mode == "fail":
        return parsed.select("line", F.when(good, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("malformed feature line: "), F.col("value"))).cast("array<double>")).alias("values"))
    if mode == "report":
        return parsed.select("line", F.when(good, F.col("values")).alias("values"), F.when(~good, F.col("value")).alias("bad"))
    kept = parsed.filter(good).select("line", "values")
    return kept.orderBy("line").limit(max_rows) if max_rows is not None else kept


def ranked_lines(frame: DataFrame, *keys: str) -> DataFrame:
    """Numbers rows by a stable order, for splits and samples."""
    return numbered(frame, "rank", *map(F.col, keys))


def load_model(path: str):
    """A fitted pipeline that sinks.save_model wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
