"""Measures against formulas in plain Python."""

import difflib
import math
import random
import re
import time
from collections import Counter
from hashlib import md5

import pytest

from pyspark.sql import functions as F

from pairloom.functions import native, registry, sequences

FIRST = "static int biggest(List<Integer> xs) {\n  int best = xs.get(0);\n  while (xs.hasNext()) {\n    best = Math.max(best, xs.next());\n  }\n  return best;\n}\n"
SECOND = "static int biggest(List<Integer> xs) {\n  // start with any\n  int best = xs.get(0);\n  while (xs.hasNext()) { /* look on */\n    best = Math.max(best, xs.next());\n  }\n  return best;\n}\n"
EDGES = [("", ""), ("", "x"), ("a", "a a a"), ("abcdefghijklm", "abcdefghijklm"), ("abcdefghijklmn", "abcdefghijklmno"), ("é ü 😀 ñandú", "ñandú é"), ("a//c\nb", "ab"), ("{{}}}{", "((("), ('s = "//x";', "//"), (None, "x y")]
ALL = registry.names() + registry.names(teaching=True)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(0, FIRST, SECOND)] + [(i + 1, a, b) for i, (a, b) in enumerate(EDGES)] + [(100, FIRST, FIRST)]
    frame = spark.createDataFrame(rows, "id int, code1 string, code2 string")
    return {r.id: r.asDict() for r in registry.score(frame, ALL).collect()}


def cosine(p, q):
    dot = lambda x, y: sum(x[k] * y[k] for k in x if k in y)
    return dot(p, q) / math.sqrt(dot(p, p) * dot(q, q)) if p and q else 0.0


def jaccard(p, q, empty=0.0):
    return len(p & q) / len(p | q) if p | q else empty


def tokens(code):
    return re.findall(r"""[A-Za-z_]\w*|\d+\.?\d*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\sA-Za-z0-9_]""", code)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def substring(a, b):
    return max((n for i in range(len(a)) for n in range(len(a) - i, 0, -1) if a[i : i + n] in b), default=0)


def tiles(a, b):
    """The whole matrix of run lengths, searched and cleared again and again."""
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else 0
    total = 0
    while best := max(map(max, m)):
        i = next(i for i, row in enumerate(m) if best in row)
        j = m[i].index(best)
        total += best
        for row in m[i - best + 1 : i + 1]:
            row[j - best + 1 : j + 1] = [0] * best
    return total


def grams(t, n=3):
    return [tuple(t[i : i + n]) for i in range(len(t) - n + 1)] if len(t) >= n else [tuple(t)] if t else []


def plain(a, b):
    """Formulas in plain Python."""
    words = lambda c, least=1: Counter(re.findall(rf"\w{{{least},}}", c))
    bare = lambda c: words(re.sub(r"//.*?\n|/\*.*?\*/", "", c, flags=re.S))
    x, y = bare(a), bare(b)
    p, q = words(a.lower(), 2), words(b.lower(), 2)
    weight = lambda c, d: {k: v * (1 if k in d else 1 + math.log(1.5)) for k, v in c.items()}
    calls = lambda c: set(re.findall(r"\b(\w+)\s*\(", c))
    long = lambda c: {c[i : i + 15] for i in range(len(c) - 14)}
    s, t = tokens(a), tokens(b)
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    changed = sum(line[:2] in ("+ ", "- ") for line in difflib.ndiff(a.splitlines(), b.splitlines()))
    return {
        "bow": cosine(p, q),
        "tdf": cosine(weight(p, q), weight(q, p)),
        "fcall": jaccard(calls(a), calls(b)),
        "jaccard": sum((x & y).values()) / (sum((x | y).values()) or 1),
        "lev": 1 - distance(a, b) / max(len(a), len(b), 1) if a or b else 0.0,
        "ngrams": jaccard(long(a), long(b)),
        "lcs": 2 * substring(a, b) / (len(a) + len(b)) if a or b else 0.0,
        "rk": 2 * tiles(a.split(), b.split()) / len(a.split() + b.split()) if a.split() or b.split() else 0.0,
        "semclone": ratio,
        "semdiff": 1 - changed / (a.count("\n") + b.count("\n") + 2),
        "edu_sequence_ratio": ratio,
        "edu_jaccard_tokens": jaccard(set(s), set(t), 1.0),
        "edu_ngram_cosine": cosine(Counter(grams(s)), Counter(grams(t))),
        "edu_levenshtein_ratio": 1 - distance(s, t) / max(len(s), len(t)) if s or t else 1.0,
        "edu_lcs_ratio": 2 * subsequence(s, t) / (len(s) + len(t)) if s and t else 0.0,
    }


PLAIN = list(plain("", ""))


@pytest.mark.parametrize("name", PLAIN)
def test_plain_value(scored, name):
    rows = {0: (FIRST, SECOND), 100: (FIRST, FIRST)} | {i + 1: pair for i, pair in enumerate(EDGES)}
    for i, (a, b) in rows.items():
        assert scored[i][name] == pytest.approx(plain(a or "", b or "")[name], abs=1e-9), (name, a, b)


def test_edges_have_a_defined_score(scored):
    for row in scored.values():
        assert all(row[n] is not None for n in ALL)
    assert scored[1]["edu_jaccard_tokens"] == 1.0 and scored[1]["jaccard"] == 0.0
    assert scored[3]["rk"] == 1.5


def test_identity_scores_one(scored):
    for name in ("bow", "fcall", "jaccard", "lev", "metrics", "ngrams", "tdf", "winn", "semclone", "lcs", "ast", "image", "semdiff"):
        assert scored[100][name] == pytest.approx(1.0), name


def test_hashing_equals_the_scalar_recurrence():
    def slow(a, b, least=10):
        mod, hits = 1_000_000_007, 0
        for size in range(least, min(len(a), len(b)) + 1):

            def values(x):
                h, power = 0, pow(256, size, mod)
                for c in x[:size]:
                    h = (h * 256 + ord(c)) % mod
                out = []
                for i in range(len(x) - size + 1):
                    h = (h * 256 - ord(x[i]) * power + ord(x[i + size - 1])) % mod
                    out.append(h)
                return out

            known = set(values(a))
            hits += sum(v in known for v in values(b))
        return hits

    rng = random.Random(1)
    for _ in range(20):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(10, 40))) + " w" for _ in range(2))
        words = len(set(a.split())) + len(set(b.split()))
        assert sequences.hashing(a, b) == pytest.approx(slow(a, b) / words)


def test_winnow_and_graph_closed_forms(spark):
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("abc \n") for _ in range(rng.randint(14, 60))) for _ in range(2)) for _ in range(30)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, code1 string, code2 string")
    for row in registry.score(frame, ["winn", "graph"]).collect():
        a, b = pairs[row.id]
        prints = [sorted(md5(x[i : i + 5].encode()).hexdigest() for i in range(len(x) - 4))[: len(x) - 4 - 9] for x in (a, b)]
        hits = sum(h in set(prints[1]) for h in prints[0])
        least = min(map(len, prints))
        assert row.winn == pytest.approx(hits / least if least else 0.0)
        raw = [x.split() for x in (a, b)]
        n = max(map(len, raw))
        lists = []
        for tokens in raw:
            own = list(dict.fromkeys(tokens))
            lists.append(own + [f"DUMMY_NODE_LABEL_{k}" for k in range(len(own), n)])
        union = set(lists[0]) | set(lists[1])
        assert row.graph == pytest.approx(sum(x == y for x, y in zip(*lists)) / len(union) if union else 0.0)


def test_bag_of_words_equals_counters(spark):
    rng = random.Random(3)
    pairs = [tuple(" ".join(rng.choice(["if", "int", "x", "été", "for"]) for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(20)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, code1 string, code2 string")
    for row in registry.score(frame, ["bow"]).collect():
        a, b = (Counter(w for w in x.split() if len(w) > 1) for x in pairs[row.id])
        dot = lambda p, q: sum(p[k] * q[k] for k in p)
        norm = (dot(a, a) * dot(b, b)) ** 0.5
        assert row.bow == pytest.approx(dot(a, b) / norm if norm else 0.0)


def test_features_before_the_join_score_alike(spark):
    snippets = spark.createDataFrame([("x", FIRST), ("y", SECOND), ("z", ""), ("n", None)], "idx string, func string")
    pairs = spark.createDataFrame([("x", "y", 1), ("x", "z", 0), ("n", "y", 0), ("x", "gone", 0)], "id1 string, id2 string, label int")
    (row,) = registry.score_snippets(snippets, pairs, ["bow", "jaccard", "tdf"]).collect()
    want = plain(FIRST, SECOND)
    assert (row.id1, row.id2, row.label) == ("x", "y", 1) and all(row[n] == pytest.approx(want[n]) for n in ("bow", "jaccard", "tdf"))


def test_error_policy(spark):
    frame = spark.createDataFrame([("int x;", "int y;")], "code1 string, code2 string")
    assert registry.score(frame, ["pdg"], on_error=-1.0).first().pdg == -1.0


def test_time_limit(spark):
    with pytest.raises(TimeoutError), registry.time_limit(0.1):
        time.sleep(10)
    with registry.time_limit(0.1):
        pass
    frame = spark.createDataFrame([("a", "b"), ("slow", "b")], "code1 string, code2 string")

    def wait(a, b):
        while a == "slow":
            pass
        return 1.0

    score = registry.arrow_measure(wait, limit=0.5)
    assert [r.s for r in frame.select(score("code1", "code2").alias("s")).collect()] == [1.0, 0.0]


def test_words_of_any_script(spark):
    rows = [("größe(x); naïve (y)", "größe(x); andere (y)"), ("a\u00a0b\u2003c", "a b c"), ("publicity static int x(int y)", "(public int größe (int y) (public static List<Öl> öl(")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, code1 string, code2 string")
    got = {r.id: r for r in registry.score(frame, ["fcall", "graph", "rk"]).collect()}
    assert got[0].fcall == pytest.approx(1 / 3) and got[1].graph == 1.0 and got[1].rk == 1.0
    metrics = frame.select("id", native.code_metrics(F.col("code1")).alias("a"), native.code_metrics(F.col("code2")).alias("b")).orderBy("id").collect()
    # publicity is no keyword, but static is one.
    assert metrics[2].a[4] == 1 and metrics[2].b[4] == 2


def test_polynomial_hash():
    for token in ("", "a", "int", "größe", "😀" * 30):
        assert sequences.polynomial_hash(token) == sum(ord(c) * 101 ** (len(token) - 1 - i) for i, c in enumerate(token))


def test_greedy_tiles_of_long_texts():
    rng = random.Random(5)
    for _ in range(40):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 25))] for _ in range(2))
        if a or b:
            assert sequences.rk(" ".join(a), " ".join(b)) == 2 * tiles(a, b) / len(a + b)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)) for _ in range(2)]
    assert sequences.rk(*long) > 0  # 80,000 equal pairs of 400,000,000


def test_hashing_counts_collisions_and_takes_long_texts():
    rng = random.Random(8)
    for _ in range(60):
        letters = rng.choice(["ab ", "abcdefgh \n", "aé😀 "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) + rng.choice([" w", ""]) for _ in range(2))
        b = rng.choice([b, b, a, a[:40] + "q" + a[40:]])
        mod, want = 1_000_000_007, 0
        for size in range(10, min(len(a), len(b)) + 1):
            found = []
            for x in (a, b):
                h, power, own = 0, pow(256, size, mod), []
                for c in x[:size]:
                    h = (h * 256 + ord(c)) % mod
                for i in range(len(x) - size + 1):
                    h = (h * 256 - ord(x[i]) * power + ord(x[i + size - 1])) % mod
                    own.append(h)
                found.append(own)
            known = set(found[0])
            want += sum(v in known for v in found[1])
        words = len(set(re.findall(r"\w+", a))) + len(set(re.findall(r"\w+", b)))
        assert sequences.hashing(a, b) == (want / words if words else 0.0), (a, b)
    began, texts = time.process_time(), [["".join(rng.choice("etaoin shrdlu") for _ in range(n)) for n in (400, 1200)] for _ in range(40)]
    assert all(sequences.hashing(a, b) >= 0 for a, b in texts)
    assert time.process_time() - began < 1.5


def test_method_heads_equal_the_pattern_and_take_long_prose():
    pattern = re.compile(r"(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w,.\s]+)?\{")
    rng = random.Random(9)
    parts = ["int foo(int a) {", "public static", "x", "(", ")", "foo(", "bar (a b, c<d>)", "{ }", "throws E {", "throws A,b.c {", "new", "return x(", "}", "List<A> q(A[] r)", ";", "é ", "class X {"]
    hits = 0
    for _ in range(5000):
        code = rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(m[0].split("(")[0], m[1], m[2]) for m in pattern.finditer(code)]
        assert sequences.method_heads(code) == want, code
        hits += len(want)
    assert hits > 500
    prose = "word and word, " * 20_000
    began = time.process_time()
    assert sequences.method_heads(prose + "; int f(int a) { }") == [("int f", "f", "int a")]
    with pytest.raises(ValueError):
        sequences.pdg(prose, prose + "f({")
    assert time.process_time() - began < 5


def test_failures_are_no_results(spark, monkeypatch):
    frame = spark.createDataFrame([("int x;", "int y;")], "code1 string, code2 string")
    # A text without a declaration has the definition's 0; no limit stands by default.
    assert registry.score(frame, ["pdg"]).first().pdg == 0.0

    def broken(a, b):
        raise RuntimeError("lost pair")

    with pytest.raises(Exception, match="lost pair"):
        frame.select(registry.arrow_measure(broken)("code1", "code2")).collect()
    monkeypatch.setitem(sequences.MEASURES, "rk", broken)
    with pytest.raises(Exception, match="lost pair"):
        registry.score(frame, ["rk"]).collect()
    assert registry.score(frame, ["rk"], on_error=-1.0).first().rk == -1.0
