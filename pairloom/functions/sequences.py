"""Pair measures that need a sequence algorithm, as scalar functions for Arrow-batched UDFs.

Each takes two texts. Difflib's comparisons keep its default heuristic for popular characters, so
they depend on the order of arguments.
"""

from __future__ import annotations

import difflib
import re

import numpy as np

from pairloom.functions.native import SHARED_KEYWORDS

_LEXER = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<operator>[-+*/%=<>!&|^~?:]+)|(?P<mark>.)""",
    re.DOTALL,
)
# Words that the lexer gives types of their own.
_DECLARING = frozenset("abstract class enum extends final implements import interface native package private protected public static strictfp synchronized throws transient volatile".split())
_TYPES = frozenset("boolean byte char double float int long short void".split())
_CONSTANTS = frozenset("true false null".split())
# Fixed value: the pattern of the teaching measures' tokens.
_TOKEN = re.compile(r"""[A-Za-z_]\w*|\d+\.?\d*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\sA-Za-z0-9_]""")


class Undefined(ValueError):
    """The measure's definition has no score for such a pair and counts it as 0; not a failure."""


def lexer_types(code: str) -> list[str]:
    """Types of the code's lexical tokens, white space included."""
    out = []
    for m in _LEXER.finditer(code):
        kind = m.lastgroup
        if kind == "name":
            word = m[0]
            kind = "declaration" if word in _DECLARING else "type" if word in _TYPES else "constant" if word in _CONSTANTS else "keyword" if word in SHARED_KEYWORDS else "call" if code[m.end() :].lstrip()[:1] == "(" else "name"
        out.append(kind)
    return out


def multiset_dice(a: list, b: list) -> float:
    if not a and not b:
        return 1.0
    kinds = set(a) | set(b)
    return 2 * sum(min(a.count(k), b.count(k)) for k in kinds) / (len(a) + len(b))


def ast(a: str, b: str) -> float:
    return multiset_dice(lexer_types(a), lexer_types(b))


def semclone(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def lcs(a: str, b: str) -> float:
    """Longest common substring."""
    if not a and not b:
        return 0.0
    size = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b)).size
    return 2.0 * size / (len(a) + len(b))


def fuzz(a: str, b: str) -> float:
    """Ratio of sorted words, rounded to hundredths."""
    norm = lambda s: " ".join(sorted(re.sub(r"[\W_]+", " ", s.lower()).split()))
    x, y = norm(a), norm(b)
    if not x or not y:
        return 0.0
    return round(100 * difflib.SequenceMatcher(None, x, y).ratio()) / 100


def line_changes(a: str, b: str) -> tuple[list[str], list[str]]:
    """(added, removed) lines."""
    added, removed = [], []
    for line in difflib.ndiff(a.splitlines(), b.splitlines()):
        if line[:2] == "+ ":
            added.append(line[2:])
        elif line[:2] == "- ":
            removed.append(line[2:])
    return added, removed


def semdiff(a: str, b: str) -> float:
    added, removed = line_changes(a, b)
    return 1 - (len(added) + len(removed)) / (a.count("\n") + b.count("\n") + 2)


def polynomial_hash(token: str, base: int = 101) -> int:
    """The token's code points as the digits of an unbounded number; tiles compare tokens themselves."""
    value = 0
    for c in token:
        value = value * base + ord(c)
    return value


def common_runs(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n) of each pair of equal elements, in row order: n is the length of the common run that ends at a[i], b[j]. Memory follows the equal pairs, not the product of the lengths."""
    places: dict = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    places = {t: np.array(p) for t, p in places.items()}
    none = np.zeros(0, int)
    rows, columns, lengths = [], [], []
    before, runs = none, none
    for i, t in enumerate(a):
        own = places.get(t, none)
        if len(before) and len(own):
            at = np.minimum(np.searchsorted(before, own - 1), len(before) - 1)
            runs = np.where(before[at] == own - 1, runs[at] + 1, 1)
        else:
            runs = np.ones(len(own), int)
        before = own
        rows.append(np.full(len(own), i))
        columns.append(own)
        lengths.append(runs)
    return (np.concatenate(x) if x else none for x in (rows, columns, lengths))


def rk(a: str, b: str) -> float:
    """Greedy tiles: again and again the longest run (first in row order) counts, and the square that ends there is cleared. Repeated tokens may count twice."""
    x, y = a.split(), b.split()
    if not x and not y:
        return 0.0
    i, j, n = common_runs(x, y)
    flat = i * len(y) + j
    free, total = np.ones(len(n), bool), 0
    order = np.lexsort((flat, -n))
    for k in order[: int((n > 1).sum())].tolist():
        if free[k]:
            size = int(n[k])
            total += size
            for row in range(int(i[k]) - size + 1, int(i[k]) + 1):
                low = row * len(y) + int(j[k])
                free[np.searchsorted(flat, low - size + 1) : np.searchsorted(flat, low, "right")] = False
    # A run of one clears only itself.
    total += int((free & (n == 1)).sum())
    return 2 * total / (len(x) + len(y))


_MOD = 1_000_000_007


#: Values that one block of lengths holds of a text, and the bits that its table has beyond them.
_BLOCK, _SPARE = 1 << 16, 3


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), _MOD) % _MOD])
    return out[:n]


class _Windows:
    """A text's values of the recurrence h <- 256 h - x[i] 256^length + x[i + length - 1], from the first window's hash on.

    Unrolled, the value after k steps is 256^(k + length - 2) (A[k + length - 1] - 256 A[k] + 256 A[length] - A[length - 1]) with A[k] the sum
    of x[i] 256^-i over i < k. The power of the length alone is left out: it is the same for both texts.
    """

    def __init__(self, text: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        n = len(text)
        self.size = n
        self.sums = np.concatenate([[0], np.cumsum(text * inverse[:n] % _MOD) % _MOD])
        self.steps = powers[1 : n + 1]
        self.less = _MOD - 256 * self.sums % _MOD
        self.first = np.concatenate([[0], (256 * self.sums[1:] - self.sums[:-1]) % _MOD])

    def block(self, length: int, rows: int) -> np.ndarray:
        """A row for each of so many lengths; column c is the value after c + 1 steps. Places past the text (see valid) hold anything."""
        n = self.size - length + 1
        ends = np.concatenate([self.sums[length:], np.zeros(rows, np.int64)])
        out = np.lib.stride_tricks.sliding_window_view(ends, n)[:rows] + self.first[length : length + rows, None]
        out += self.less[1 : n + 1]
        out *= self.steps[:n]
        out -= (out.view(np.uint64) // np.uint64(_MOD) * np.uint64(_MOD)).view(np.int64)
        return out

    def valid(self, at: np.ndarray, length: int) -> np.ndarray:
        """The places of at, numbered through the block, that lie within the text."""
        n = self.size - length + 1
        return at[at // n + at % n < n]


def _block_hits(a: _Windows, b: _Windows, length: int, rows: int) -> int:
    """Values of b that are among those of a of the same length. A table of hash bits leaves few to compare."""
    x, y = ((w.block(length, rows) * rows + np.arange(rows)[:, None]).ravel() for w in (a, b))
    mask = (1 << (len(x).bit_length() + _SPARE)) - 1

    def among(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        table = np.zeros(mask + 1, bool)
        table[other & mask] = True
        return np.flatnonzero(table[own & mask])

    found = y[b.valid(among(y, x), length)]
    if not len(found):
        return 0
    return int(np.isin(found, x[a.valid(among(x, found), length)]).sum())


def hashing(a: str, b: str, least: int = 10) -> float:
    """Positions of b whose rolling value occurs in a, over all lengths, per distinct word. Unbounded; equal texts score high. Lengths are taken in blocks of bounded memory."""
    words = len(set(re.findall(r"\w+", a))) + len(set(re.findall(r"\w+", b)))
    if not words:
        return 0.0
    if a == b:
        n = max(0, len(a) - least + 1)
        return n * (n + 1) // 2 / words
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for s in (a, b))
    n, longest = max(len(x), len(y)), min(len(x), len(y))
    powers, inverse = _power_table(256, n + 1), _power_table(pow(256, -1, _MOD), n + 1)
    x, y = _Windows(x, powers, inverse), _Windows(y, powers, inverse)
    hits, length = 0, least
    while length <= longest:
        rows = min(longest - length + 1, max(1, _BLOCK // (n - length + 1)))
        hits += _block_hits(x, y, length, rows)
        length += rows
    return hits / words


#: What stands from a method's opening parenthesis on, and its words before it (the last is its name), looked for backwards from there.
_REST = re.compile(r"\(([^()]*)\)\s*(?:throws\s+[\w,.\s]+)?\{")
_HEAD_CHARS = re.compile(r"[^\w<>\[\],.?\s]")
_NAME = re.compile(r"\w+")


def method_heads(code: str) -> list[tuple[str, str, str]]:
    """(words before the parenthesis, name, parameters) of each match, from left to right, of
    (?:[\\w<>\\[\\],.?]+\\s+)+(\\w+)\\s*\\(([^()]*)\\)\\s*(?:throws\\s+[\\w,.\\s]+)?\\{

    None of the words' characters is a parenthesis, so a match belongs to one "(" and starts with the first word of the run before it;
    the pattern itself would start anew at each character of the run.
    """
    if "(" not in code or "{" not in code:
        return []
    found, start = [], 0
    marks = [(m.start(), m[0]) for m in _HEAD_CHARS.finditer(code)]
    for (before, _), (at, mark) in zip([(-1, "")] + marks, marks):
        if mark == "(" and at >= start:
            first = max(before + 1, start)
            words = code[first:at].split()
            if len(words) > 1 and _NAME.fullmatch(words[-1]) and (rest := _REST.match(code, at)):
                found.append((code[first:at].lstrip(), words[-1], rest[1]))
                start = rest.end()
    return found


def method_edges(code: str) -> tuple[set[str], set[tuple[str, str]]]:
    """(nodes, parameter -> method edges) of the code's first member declaration, if it is a method or a type with methods."""
    code = re.sub(r"//[^\n]*|/\*.*?\*/", " ", code, flags=re.DOTALL)
    head = re.match(r"\s*(?:@\w+\s*)*(?:(?:public|private|protected|static|final|abstract)\s+)*(class|interface|enum)\b", code)
    found = [(name, parameters) for words, name, parameters in method_heads(code) if not re.search(r"\b(?:new|return|else)\b", words)]
    if not found:
        raise Undefined("no declaration")
    nodes, edges = set(), set()
    for method, parameters in found if head else found[:1]:
        nodes.add(method)
        for p in filter(None, (p.strip() for p in re.sub(r"<[^<>]*>", "", parameters).split(","))):
            name = p.split()[-1].strip("[].")
            nodes.add(name)
            edges.add((name, method))
    return nodes, edges


def pdg(a: str, b: str) -> float:
    """1 - edit distance / nodes for parameter stars; nodes carry no labels, so stars are matched by degree."""
    degrees, sizes = [], []
    for code in (a, b):
        nodes, edges = method_edges(code)
        sizes.append(len(nodes))
        into: dict[str, int] = {}
        for _, method in edges:
            into[method] = into.get(method, 0) + 1
        degrees.append(sorted(into.values(), reverse=True))
    edges = sum(abs(x - y) for x, y in zip(*(d + [0] * (max(map(len, degrees)) - len(d)) for d in degrees)))
    distance = abs(sizes[0] - sizes[1]) + edges
    return max(0.0, min(1.0, 1 - distance / max(1, sum(sizes))))


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k + 1) / (2 * n))


def picture_hash(code: str, width: int = 48, height: int = 19) -> int:
    """64 bits: the code as a grid of dark and light characters, a cosine transform of it, and which low frequencies are over their median."""
    grid = np.zeros((height, width))
    for y, line in enumerate(code.split("\n")[:height]):
        for x, c in enumerate(line[:width]):
            grid[y, x] = 0.0 if c.isspace() else 1.0 if c.isalnum() else 0.5
    square = grid[np.ix_(np.arange(32) * height // 32, np.arange(32) * width // 32)]
    low = (_dct(32) @ square @ _dct(32).T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">u8")[0])


def image(a: str, b: str) -> float:
    return 1 - (picture_hash(a) ^ picture_hash(b)).bit_count() / 64


def output_ratio(out_a: str, out_b: str) -> float:
    """Ratio of two captured outputs. Nothing is ever compiled or run here."""
    return difflib.SequenceMatcher(None, out_a.strip(), out_b.strip()).ratio()


def _tokens(code: str) -> list[str]:
    return _TOKEN.findall(code)


def edu_levenshtein(a: str, b: str) -> float:
    x, y = _tokens(a), _tokens(b)
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    number = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    row, target = np.arange(len(y) + 1), np.array([number[t] for t in y])
    steps = np.arange(len(y) + 1)
    for i, t in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (target != number[t]))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return 1 - int(row[-1]) / max(len(x), len(y))


def edu_lcs(a: str, b: str) -> float:
    """Longest common subsequence of tokens."""
    x, y = _tokens(a), _tokens(b)
    if not x or not y:
        return 0.0
    number = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    row, target = np.zeros(len(y) + 1, int), np.array([number[t] for t in y])
    for t in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(target == number[t], row[:-1] + 1, 0)))
    return 2.0 * int(row[-1]) / (len(x) + len(y))


def shares_method(a: str, b: str, least: float = 0.8) -> bool:
    """Both declare a public method of one name, and the texts' ratio is high."""
    names = lambda c: set(re.findall(r"\bpublic\b\s+(?:[\w<>\[\]]+\s+)+?(\w+)\s*\(", c))
    return bool(names(a) & names(b)) and semclone(a, b) >= least


MEASURES = {"ast": ast, "fuzz": fuzz, "hashing": hashing, "image": image, "lcs": lcs, "pdg": pdg, "rk": rk, "semclone": semclone, "semdiff": semdiff}
TEACHING = {"edu_sequence_ratio": semclone, "edu_levenshtein_ratio": edu_levenshtein, "edu_lcs_ratio": edu_lcs}
