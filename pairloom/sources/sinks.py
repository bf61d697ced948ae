"""Sinks: feature rows as JSON lines, curated pairs as JSON, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_features(scored: DataFrame, columns: list[str], path: str) -> None:
    """One JSON array of doubles a line, appended; a run that is repeated adds its rows again."""
    row = F.to_json(F.array(*(F.col(c).cast("double") for c in columns)))
    scored.select(row.alias("value")).write.mode("append").text(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
