"""Column builders over snippet text: tokens, n-grams, counts, and ratios of them. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character as in Unicode regular expressions of Python.
WORD_CHAR = r"[\p{L}\p{N}_]"
#: A character that Python's split() and \s take for white space.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column, least: int = 1) -> Column:
    return find_all(text, f"{WORD_CHAR}{{{least},}}")


def blank_split(text: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def char_grams(text: Column, n: int) -> Column:
    """Substrings of n characters in order; none where the text is shorter. One pass: a substring by its place would count characters from the text's start each time."""
    return find_all(text, f"(?s)(?=(.{{{n}}})).", 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def counts(tokens: Column) -> Column:
    """map token -> occurrences: the sorted tokens' runs, from one pass over them."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        sizes = lambda s: F.transform(s, lambda x, k: (F.coalesce(F.get(s, k + 1), F.size(t)) - x).cast("double"))
        return let(starts, lambda s: F.map_from_arrays(F.transform(s, lambda x: F.get(t, x)), sizes(s)))

    return let(F.sort_array(tokens), lambda t: F.when(F.size(t) == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(runs(t)))


def count_of(m: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the keys that both have: a look-up in a map takes its whole length."""
    return F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + count_of(a, k) * count_of(b, k))


def squares(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)


def map_cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(squares(a) * squares(b)))


def vector_cosine(a: Column, b: Column) -> Column:
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: (p * q).cast("double")))
    return ratio(product(a, b), F.sqrt(product(a, a) * product(b, b)))


def set_jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Over distinct elements."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(ratio(F.size(F.array_intersect(a, b)), union))


def count_jaccard(a: Column, b: Column) -> Column:
    """Of two maps of whole counts: the sum of the lesser ones over that of the greater ones. Only shared keys are looked up."""
    shared = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.least(count_of(a, k), count_of(b, k)))
    return let(shared, lambda x: ratio(x, total(F.map_values(a)) + total(F.map_values(b)) - x))


def substring_count(text: Column, part: str) -> Column:
    """Non-overlapping occurrences."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(float(len(part)))


def max_depth(text: Column, opening: str, closing: str) -> Column:
    """Deepest nesting; unbalanced closings count below zero. All other characters are dropped first."""
    kept = F.regexp_replace(text, "[^" + "".join(f"\\{c}" for c in opening + closing) + "]+", "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, c: Column) -> Column:
        d = s["d"] + F.when(c.isin(*opening), 1).when(c.isin(*closing), -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(F.split(kept, ""), start, step)["m"]
