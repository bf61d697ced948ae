"""Reading the driver tables and shared conventions of the training-data operators.

Conventions for all operators of this subpackage: a null text counts as empty, rows with a
null identifier are kept (their identifier stays null and sorts last), extra columns of an
input are ignored unless an operator says that it carries them, and an empty table gives an
empty result of the same schema.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import ship_package

#: Bytes that delete or split as white space: [\x20\x09-\x0D].
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, null text as empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Stands for a null identifier where rows are ordered or joined.
NO_ID = 2**63 - 1


def ids_last(column: Column) -> Column:
    """Orders null identifiers after all others."""
    return F.coalesce(column, F.lit(NO_ID))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: What a Python worker keeps between its tasks, by name, with the function that drops it.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_in_worker(name: str, drop: Callable[[], None]) -> None:
    """Told by code that keeps something large in the worker: it goes when the worker turns to a map that doesn't use it."""
    _KEPT[name] = drop


def _give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before which the worker drops what other maps keep in it, and after which it gives back the memory it has freed: workers stay for the tasks of other stages."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [n for n in _KEPT if n != uses]
        for name in others:
            _KEPT.pop(name)()
        if others:
            gc.collect()
            _give_back()
        yield from run(batches)
        _give_back()

    return inner
