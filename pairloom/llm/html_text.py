r"""Main text of web pages by tag-path ratios (operator 6).

A page is scanned once into blocks: the text directly in a block element, white space turned into
one space. Blocks with the same root-to-leaf path (tags with their classes) count together. For each path:

1. The text length of its blocks outside of links, and their punctuation, each per block, are its ratios.
2. Both are smoothed over neighbouring paths in page order with weights 1, 2, 1; their product is the fused value. Of
   a path that names another role (navigation, footer, advert, form, comment and so on, by element, class, id or ARIA role) a small part
   counts.
3. Values are summed, by block, up the tree of paths. The content path is the deepest container that holds HELD of the page's sum; where an
   article or main element lies above it, that path. Each path below it is smoothed once more towards its highest value: headings,
   short paragraphs and lists belong to the text around them. Paths elsewhere lose that part.
4. Paths over a share of the highest value are content: their blocks are the text, in page order.

So with equal values for all paths every block would be text; no list of names selects or drops a block by itself.

Null and empty pages, and pages without blocks, give an empty text. Unclosed elements close with
their parent, text after a cut-off tag is kept. Time and memory follow the page's length, however deep or broken it is. Repeated
rows give repeated rows, an empty table an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import tidied
from pairloom.session import ship_package

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Dropped up to their end tag; scripts and styles without one to the page's end, others without one are ignored.
RAW = frozenset("script style template textarea title iframe noembed noframes noscript svg object audio video canvas".split())
TO_END = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split()
)
OTHER = frozenset("nav header footer aside form button select option dialog menu head fieldset".split())
CONTAINERS = frozenset("#root html body div section article main".split())
WHOLE = frozenset("html body article main".split())
# Words of class, id and role names for other parts than the article, and words that go with them.
ROLES = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
BESIDE = frozenset("area bar block bottom box buttons container content form global group inner item items left links list main page panel primary right secondary section site top wrap wrapper".split())
#: Part of a value that counts where a path names another role; share of the sum that the content container holds; share of the highest value that makes content.
ROLE, HELD, SHARE = 0.0001, 0.9, 0.05
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟¿¡]")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count after an equals sign only.
_REST = re.compile(r"""(?>[^>=]+|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"']))(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")


class _Paths:
    """The tree of a page's paths. A path is its parent and the last element's tag, classes and role; parents come before their children."""

    def __init__(self):
        self._number: dict[tuple, int] = {}
        self.parent, self.tag, self.role = [-1], ["#root"], [False]
        self.length, self.linked, self.marks, self.blocks = [0], [0], [0], [0]

    def step(self, parent: int, tag: str, classes: str, role: bool) -> int:
        key = (parent, tag, classes, role)
        if key not in self._number:
            self._number[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.role.append(role or self.role[parent])
            for column in (self.length, self.linked, self.marks, self.blocks):
                column.append(0)
        return self._number[key]

    def add(self, path: int, text: str, linked: int) -> None:
        self.length[path] += len(text)
        self.linked[path] += min(linked, len(text))
        self.marks[path] += len(PUNCTUATION.findall(text))
        self.blocks[path] += 1


def _names_role(words: list[str]) -> bool:
    """A name that consists of role words and words that go with them: share or cookie-notice-box, but not share-price."""
    return not ROLES.isdisjoint(words) and all(w in ROLES or w in BESIDE for w in words)


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """(classes for the path, whether the element names another role)."""
    if not attributes or attributes.isspace():
        return "", tag in OTHER
    classes, role = "", tag in OTHER
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            role = True
        elif name in ("class", "id", "role"):
            if name == "class":
                classes = value
            role |= tag not in WHOLE and any(_names_role(_WORD.findall(x)) for x in value.split())
    return classes, role


def blocks_of_page(page: str) -> tuple[_Paths, list[tuple[int, str]]]:
    """The page's paths, and (path, text) of its blocks in page order."""
    paths, out = _Paths(), []
    stack: list[tuple[str, int]] = [("#root", 0)]
    open_tags: Counter = Counter()
    unclosed: set[str] = set()
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((stack[-1][1], text))
                paths.add(stack[-1][1], text, linked)
            pieces.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece)

    def close(tag: str) -> None:
        """The innermost open element of that tag, with all within it."""
        flush()
        while stack[-1][0] != tag:
            open_tags[stack.pop()[0]] -= 1
        open_tags[stack.pop()[0]] -= 1

    def past(tag: str, at: int) -> int:
        """Behind the tag's next end, or -1; a tag without one is not looked for again."""
        if tag in unclosed:
            return -1
        end = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, at)
        if end:
            return end.end()
        unclosed.add(tag)
        return -1

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if page.startswith("<!--", begin):
            say(page[at:begin])
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        ending = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + ending)
        if not name:
            end = page.find(">", begin) if page[begin + 1 : begin + 2] in ("!", "?", "/") else -1
            say(page[at : begin + (end < 0)])
            at = end + 1 if end >= 0 else begin + 1
            continue
        end = page.find(">", name.end())
        if end < 0:  # cut off: the rest is text
            say(page[at:])
            break
        say(page[at:begin])
        rest = page[name.end() : end]
        if "=" in rest and ('"' in rest or "'" in rest):
            whole = _REST.match(page, name.end())
            end = whole.end() - 1 if whole else end
            rest = page[name.end() : end]
        at, tag = end + 1, name[0].lower()
        if tag in RAW and not ending:
            if not rest.endswith("/"):
                end = past(tag, at)
                at = end if end >= 0 else size if tag in TO_END else at
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if ending else 1
            elif tag in ("br", "img"):
                pieces.append(" ")
            if not ending and rest and tag not in VOID and _described(tag, rest)[1]:
                at = max(at, past(tag, at))
            continue
        if ending:
            if open_tags[tag] > 0:
                close(tag)
                links = 0
            continue
        flush()
        if tag in VOID or tag in RAW:
            continue
        last = stack[-1][0]
        if last == "p" or tag == last == "li" or {tag, last} <= {"td", "th"} or {tag, last} <= {"dt", "dd"}:
            close(last)
        classes, role = _described(tag, rest)
        stack.append((tag, paths.step(stack[-1][1], tag, classes, role)))
        open_tags[tag] += 1
    flush()
    return paths, out


def path_values(paths: _Paths) -> list[float]:
    """The smoothed, fused value of each path that has blocks; 0 for others, and where all have another role."""
    own = [i for i, n in enumerate(paths.blocks) if n]
    if all(paths.role[i] for i in own):
        return [0.0] * len(paths.parent)
    lengths = [(paths.length[i] - paths.linked[i] + 1) / paths.blocks[i] for i in own]
    marks = [(paths.marks[i] + 1) / paths.blocks[i] for i in own]

    def smooth(x: list[float]) -> list[float]:
        return [(2 * v + x[max(0, i - 1)] + x[min(len(x) - 1, i + 1)]) / 4 for i, v in enumerate(x)]

    # A path's own ratio bounds the smoothed one, so that a neighbour can't lift a path of few words.
    fused = [0.0] * len(paths.parent)
    for i, length, near, mark in zip(own, lengths, smooth(lengths), smooth(marks)):
        fused[i] = min(4 * length, near) * mark * (ROLE if paths.role[i] else 1.0)
    held = [v * n for v, n in zip(fused, paths.blocks)]
    for i in range(len(held) - 1, 0, -1):  # children come after their parents
        held[paths.parent[i]] += held[i]
    node = 0
    for i in range(1, len(held)):  # shares over one half lie on one branch
        if held[i] >= HELD * held[0] and paths.tag[i] in CONTAINERS:
            node = i
    for tag in ("main", "article"):  # the outermost article above, else main
        up = node
        while up > 0:
            if paths.tag[up] == tag:
                node = up
            up = paths.parent[up]
    below = [False] * len(held)
    for i in range(len(held)):
        below[i] = i == node or i > 0 and below[paths.parent[i]]
    top = max((fused[i] for i in own if below[i]), default=0.0)
    values = [0.0] * len(held)
    for i in own:
        values[i] = (ROLE if paths.role[i] else 1.0) * max(top, fused[i]) if below[i] else fused[i] * ROLE
    return values


def main_text(page: str | None) -> str:
    paths, blocks = blocks_of_page(page) if page else (None, [])
    if not blocks:
        return ""
    values = path_values(paths)
    least = SHARE * max(values)
    return "\n\n".join(text for path, text in blocks if values[path] >= least > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return chosen.mapInArrow(tidied(run), "page_id long, url string, text string")
