"""The ordered registry of measures and the scoring plan over pairs."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pairloom.functions import native, sequences
from pairloom.session import materialize, ship_package

# The order of a feature row's columns.
ORDER = ["ast", "bow", "codebert", "comments", "exe", "fcall", "fuzz", "graph", "hashing", "image", "jaccard", "lcs", "lev", "metrics", "ngrams", "pdg", "rk", "semclone", "semdiff", "tdf", "winn"]
TEACHING_ORDER = ["edu_jaccard_tokens", "edu_ngram_cosine", "edu_sequence_ratio", "edu_levenshtein_ratio", "edu_lcs_ratio", "edu_token_kind_cosine", "edu_normalized_jaccard", "edu_metrics_cosine"]


@contextmanager
def time_limit(seconds: float | None):
    """Raises TimeoutError in the block after so many seconds; without effect outside of a process's main thread, where no signal can be caught."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def arrow_measure(score: Callable[[str, str], float], on_error: float | None = None, limit: float | None = None, over: float = 0.0) -> Callable[[Column, Column], Column]:
    """An Arrow-batched measure. A score that raises fails the query, so that no failure looks like a result, unless the caller names a value on_error.

    Pairs take as long as they need, unless the caller sets a limit in seconds; a pair beyond it gets on_error, or over where that is None.
    A pair for which the measure's definition has no score of its own (sequences.Undefined) gets on_error, or the definition's 0.
    """

    def safe(a, b):
        try:
            with time_limit(limit):
                return float(score(a or "", b or ""))
        except sequences.Undefined:
            return 0.0 if on_error is None else on_error
        except Exception as e:
            if on_error is not None:
                return on_error
            if limit and isinstance(e, TimeoutError):
                return over
            raise

    @pandas_udf("double")
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([safe(x, y) for x, y in zip(a, b)], dtype="float64")

    return batch


def measure(name: str, on_error: float | None = None) -> Callable[[Column, Column], Column]:
    """score(code_a, code_b) as a Column function."""
    for table in (native.MEASURES, native.TEACHING):
        if name in table:
            return table[name]
    for table in (sequences.MEASURES, sequences.TEACHING):
        if name in table:
            return arrow_measure(table[name], on_error)
    if name == "exe":
        # The batch path never runs code; captured outputs are compared by sequences.output_ratio.
        return lambda a, b: F.lit(0.0)
    raise KeyError(f"{name}: not a registered text measure")


def names(teaching: bool = False) -> list[str]:
    """Measures of text pairs in column order; codebert and comments come from vectors (see operators.vectors)."""
    return list(TEACHING_ORDER) if teaching else [n for n in ORDER if n not in ("codebert", "comments")]


def score(pairs: DataFrame, wanted: list[str], on_error: float | None = None) -> DataFrame:
    """pairs with a double column for each measure. Needs code1 and code2; null is empty. What fails, fails the query, unless on_error is given."""
    ship_package(pairs.sparkSession)
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in ("code1", "code2"))
    return pairs.withColumns({n: measure(n, on_error)(a, b).cast("double") for n in wanted})


def features(snippets: DataFrame, wanted: list[str], key: list[str], text: str = "func") -> DataFrame:
    """key columns with the native measures' features (f_<measure>), made once a snippet on all cores and written to the shared folder."""
    spark = snippets.sparkSession
    table = native.MEASURES | native.TEACHING
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = snippets.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__text")).repartition(n)
    return materialize(own.select(*key, *(table[m].features(F.col("__text")).alias(f"f_{m}") for m in wanted)), "features")


def combine(joined: DataFrame, wanted: list[str], keep: list[str]) -> DataFrame:
    """keep and a column for each measure from the columns a_<measure> and b_<measure>."""
    table = native.MEASURES | native.TEACHING
    return joined.select(*keep, *(table[m].combine(F.col(f"a_{m}"), F.col(f"b_{m}")).cast("double").alias(m) for m in wanted))


def score_snippets(snippets: DataFrame, pairs: DataFrame, wanted: list[str]) -> DataFrame:
    """As score(), for native measures over (idx, func) and pairs (id1, id2, ...): features are made once a snippet, before the join.

    Pairs that lack a snippet, or have an empty one, drop out. Both joins are dealt out over all cores by the snippet's key.
    """
    ship_package(pairs.sparkSession)
    own = features(snippets.filter("func <> ''"), wanted, ["idx"])
    side = lambda k, i: own.select(F.col("idx").alias(f"id{i}"), *(F.col(f"f_{m}").alias(f"{k}_{m}") for m in wanted))
    return combine(pairs.join(side("a", 1), "id1").join(side("b", 2), "id2"), wanted, pairs.columns)
