"""The scoring plan over a stream of pair files: stateless, appended, restartable by its checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions.registry import score

PAIRS = "pair_id string, code1 string, code2 string, label int"


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, measures: list[str], files_per_trigger: int = 32, available_now: bool = True) -> StreamingQuery:
    """JSON pair files in source become Parquet feature rows in target; a restart doesn't repeat rows."""
    pairs = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_trigger).json(source)
    kept = pairs.filter("code1 <> '' AND code2 <> ''")
    writer = score(kept, measures).drop("code1", "code2").writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
