"""Probes of robustness: each makes another text of the same meaning from a snippet, as a Column function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import WORD_CHAR

_DEAD = "int unusedValue = 0;"


def doubled_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("  "))


def commented(c: Column) -> Column:
    return F.concat(F.lit("// a remark\n"), c)


def dead_line(c: Column) -> Column:
    return F.concat(c, F.lit("\n" + _DEAD))


def renamed(c: Column) -> Column:
    """Every word of five characters or more gets a suffix, the same for the same word."""
    return F.regexp_replace(c, f"(?<!{WORD_CHAR})({WORD_CHAR}{{5,}})", "$1_x")


def reordered(c: Column) -> Column:
    """Lines in reverse."""
    return F.array_join(F.reverse(F.split(c, "\n", -1)), "\n")


PROBES: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (doubled_spaces, commented, dead_line, renamed, reordered)}
