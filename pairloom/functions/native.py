"""Pair measures that are pure expressions. A measure has features of one snippet and combines those of two.

Nulls count as empty text. Where a ratio has no denominator the score is 0 (1 for the teaching
Jaccards of two empty sets).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import text as T


@dataclass(frozen=True)
class Native:
    """features(code) is an array, map or text column; combine(a, b) the score."""

    features: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return T.let(self.features(a), lambda x: T.let(self.features(b), lambda y: self.combine(x, y)))


# Keywords of the Java language whose substrings the metrics count.
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while"
).split()
# Structural keywords of Java and Python that token kinds keep.
SHARED_KEYWORDS = (
    "if else elif for while do switch case default break continue return try catch except finally throw throws raise with yield pass lambda "
    "class interface enum def void int long short byte char boolean bool float double str string public private protected static final abstract new "
    "import package from as extends implements super this self null none true false and or not in is global nonlocal assert del"
).split()
# Patterns.
CALL = rf"({T.WORD_CHAR}+){T.SPACE}*\("
COMMENT = r"(?s)//.*?\n|/\*.*?\*/"
NAMED = rf"[\p{{L}}\p{{N}}_<>\[\]]+{T.SPACE}+"
DECLARATION = rf"(?:public|protected|private|static){T.SPACE}+{NAMED}{T.WORD_CHAR}+{T.SPACE}*\("
METHOD = rf"public{T.SPACE}+(?:{NAMED})+?({T.WORD_CHAR}+){T.SPACE}*\("
TOKEN = r"""[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+\.?\p{Nd}*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^ \t\n\f\r\x0BA-Za-z0-9_]"""
#: No word character before.
APART = rf"(?<!{T.WORD_CHAR})"
WINDOW, GRAM, LONG_GRAM = 10, 5, 15


def _tdf(a: Column, b: Column) -> Column:
    """Cosine of counts times smooth inverse document frequency over the two texts: 1 if shared, else 1 + ln(3/2). Only shared words meet in the product."""
    single = (1 + math.log(1.5)) ** 2

    def square(x: Column, shared: Column) -> Column:
        return T.squares(x) * F.lit(single) + F.aggregate(shared, F.lit(0.0), lambda s, k: s + T.count_of(x, k) * T.count_of(x, k)) * F.lit(1 - single)

    return T.let(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: T.ratio(T.dot(a, b), F.sqrt(square(a, k) * square(b, k))))


def _graph(a: Column, b: Column) -> Column:
    """Positions at which the distinct-token lists, padded to the longer raw list with numbered dummies, agree, over all labels."""
    n = F.greatest(F.size(a), F.size(b))

    def fill(d: Column) -> Column:
        dummies = F.transform(F.sequence(F.size(d), n - 1), lambda k: F.concat(F.lit("DUMMY_NODE_LABEL_"), k.cast("string")))
        return F.when(F.size(d) < n, F.concat(d, dummies)).otherwise(d)

    def agree(x: Column, y: Column) -> Column:
        return T.ratio(F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)), F.size(F.array_union(x, y)))

    return T.let(F.array_distinct(a), lambda d: T.let(fill(d), lambda x: T.let(F.array_distinct(b), lambda e: T.let(fill(e), lambda y: agree(x, y)))))


def fingerprint(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """All k-gram hashes but the w - 1 largest; empty below k + w - 1 characters."""
    hashes = F.sort_array(F.transform(T.char_grams(text, k), lambda g: F.md5(g)))
    return T.let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (w - 1), F.lit(0))))


def _winn(a: Column, b: Column) -> Column:
    """Elements of a, repeats included, that b has, over the smaller size; repeats are counted apart, among those that b has, so that no whole list is searched for each element."""
    repeats = F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1)))
    again = T.let(repeats, lambda r: T.let(F.array_intersect(r, b), lambda both: F.size(F.filter(r, lambda x: F.array_contains(both, x)))))
    return T.ratio(F.size(F.array_intersect(a, b)) + again, F.least(F.size(a), F.size(b)))


def _lev(a: Column, b: Column) -> Column:
    """Where one text holds the other, their distance is what else it has; else it takes the product of the lengths."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    held = F.contains(a, b) | F.contains(b, a)
    return F.when(longest == 0, F.lit(0.0)).when(held, 1 - T.ratio(longest - shortest, longest)).otherwise(1 - T.ratio(F.levenshtein(a, b), longest))


METRIC_NAMES = ("lines", "keywords", "loops", "conditionals", "methods", "depth")


def code_metrics(c: Column) -> Column:
    """Lines, keywords, loops, conditionals, method declarations, brace depth."""
    summed = lambda keys: sum((T.substring_count(c, k) for k in keys), F.lit(0.0))
    parts = [F.size(F.split(c, "\n", -1)), summed(JAVA_KEYWORDS), summed(["for", "while"]), summed(["if", "else", "switch"]), F.regexp_count(c, F.lit(APART + DECLARATION)), T.max_depth(c, "{", "}")]
    return F.array(*(p.cast("double") for p in parts))


def code_tokens(c: Column) -> Column:
    return T.find_all(c, TOKEN)


def token_kind(t: Column) -> Column:
    return (
        F.when(F.lower(t).isin(*SHARED_KEYWORDS), F.concat(F.lit("KW:"), F.lower(t)))
        .when(t.rlike("^[\"']"), F.lit("STR"))
        .when(t.rlike(r"^\p{Nd}"), F.lit("NUM"))
        .when(t.rlike(r"^[A-Za-z_]"), F.lit("ID"))
        .otherwise(F.concat(F.lit("OP:"), t))
    )


def normalized_tokens(c: Column) -> Column:
    return F.transform(code_tokens(c), lambda t: F.when(token_kind(t) == "ID", F.lit("ID")).otherwise(t))


def token_grams(c: Column, n: int = 3) -> Column:
    def grams(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x01"))
        short = F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(t, "\x01")))
        return F.when(F.size(t) < n, short).otherwise(many)

    return T.let(code_tokens(c), grams)


def shape_metrics(c: Column) -> Column:
    """Lines, keywords, loops, conditionals, tokens, depth of braces and parentheses."""
    def vector(t: Column) -> Column:
        among = lambda keys: F.size(F.filter(t, lambda x: x.isin(*keys)))
        parts = [F.size(F.split(c, "\n", -1)), among(SHARED_KEYWORDS), among(["for", "while"]), among(["if", "else", "elif", "switch"]), F.size(t), T.max_depth(c, "{(", "})")]
        return F.array(*(p.cast("double") for p in parts))

    return T.let(F.transform(code_tokens(c), F.lower), vector)


MEASURES: dict[str, Native] = {
    "bow": Native(lambda c: T.counts(T.words(F.lower(c), 2)), T.map_cosine),
    "fcall": Native(lambda c: T.find_all(c, CALL, 1), T.set_jaccard),
    "graph": Native(T.blank_split, _graph),
    "jaccard": Native(lambda c: T.counts(T.words(F.regexp_replace(c, COMMENT, ""))), T.count_jaccard),
    "lev": Native(lambda c: c, _lev),
    "metrics": Native(code_metrics, T.vector_cosine),
    "ngrams": Native(lambda c: F.array_distinct(T.char_grams(c, LONG_GRAM)), T.set_jaccard),
    "tdf": Native(lambda c: T.counts(T.words(F.lower(c), 2)), _tdf),
    "winn": Native(fingerprint, _winn),
}

TEACHING: dict[str, Native] = {
    "edu_jaccard_tokens": Native(lambda c: F.array_distinct(code_tokens(c)), lambda a, b: T.set_jaccard(a, b, 1.0)),
    "edu_ngram_cosine": Native(lambda c: T.counts(token_grams(c)), T.map_cosine),
    "edu_token_kind_cosine": Native(lambda c: T.counts(F.transform(code_tokens(c), token_kind)), T.map_cosine),
    "edu_normalized_jaccard": Native(lambda c: F.array_distinct(normalized_tokens(c)), lambda a, b: T.set_jaccard(a, b, 1.0)),
    "edu_metrics_cosine": Native(shape_metrics, T.vector_cosine),
}
