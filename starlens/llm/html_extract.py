"""Operator 9: main text of a page by a minimum cut over its text blocks.

Each block gets a classifier score (log-odds of content). A graph joins the
blocks: a block's terminal capacity is its score, neighbours in page order
and blocks of one parent are joined by smoothness edges that grow with
closeness in the DOM. The minimum cut parts content from boilerplate.

Blocks whose score exceeds all their edges keep their label in every
minimum cut; they are settled first and folded into their neighbours, and a
max-flow runs on what is left. Edges are linear in blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import dropwhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starlens.llm.scratch import others

# Element names of HTML.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul""".split())
SKIPPED = frozenset("script style noscript template title textarea select button svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_SELF = frozenset("p li dd dt tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that mark an element as a whole token of class, id or role, and elements that do so by name. A token of several
# words marks if it names such a part (site-footer, comment-list, cookie-notice), not if it says more (has-sidebar).
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie
cookies consent gdpr notice notices notification alert newsletter subscribe subscription sidebar side widget menu nav
navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies
respond discussion disqus share sharing social related recommended popular trending popup modal overlay login signup
signin search pagination pager copyright disclaimer hidden contentinfo complementary""".split())
HEADER_WORDS = frozenset("header head".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
REPLY_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
WHOSE_WORDS = frozenset("article entry main page post site".split())  # before such a word
PART_WORDS = frozenset("""area bar block body bottom box button buttons container group icon icons inner item items left
link links list more outer panel posts right section text title top wrap wrapper""".split())  # beside such a word
BOILER_TAGS = frozenset("nav footer aside dialog menu".split())
MAIN_TAGS = frozenset("article main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(
    r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")  # one attribute: name, value
WORD = re.compile(r"[a-z]+")

HARD, INSIDE, OUTSIDE = 8.0, 5.0, -0.5
NAMED = 4.0  # cost of a name: the edges of a long paragraph outvote it among content
ADJACENT, SAME_PARENT = 0.3, 0.4
ROOM = 1e-9  # less capacity than this is none


def _named(token: str) -> str | None:
    """``named`` (boilerplate), ``head``, ``content`` or None for a whole token of class, id or role."""
    words = WORD.findall(token.lower())
    known = set(words)
    if known & BOILER_WORDS:
        rest = set(dropwhile(WHOSE_WORDS.__contains__, words))
        return "named" if rest <= BOILER_WORDS | PART_WORDS else None
    if known & HEADER_WORDS:
        return "head" if known <= HEADER_WORDS | PART_WORDS | MAIN_WORDS | WHOSE_WORDS else None
    return "content" if known & MAIN_WORDS else None


def _mark(name: str, attrs: str) -> str | None:
    """What an element says of itself.

    ``boiler``, ``header``, ``form`` and ``main`` are said by the element or
    an attribute, ``named``, ``head`` and ``content`` by a word; ``back`` is a
    main element with a name of boilerplate, ``mixed`` has words of both.
    """
    if name == "body":
        return None
    said: dict[str, str] = {}
    if len(attrs) > 3:
        for key, *values in ATTRIBUTE.findall(attrs):
            said.setdefault(key.lower(), "".join(values))
    if name in BOILER_TAGS or "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true":
        return "boiler"
    if name == "header":
        return name
    tokens = [t for key in ("class", "id", "role") if key in said for t in html.unescape(said[key]).split()]
    words = {_named(t) for t in tokens}
    main = name in MAIN_TAGS or said.get("role", "").strip().lower() in MAIN_TAGS
    if "named" in words:
        if main and (name == "main" or not any(t.lower() in REPLY_WORDS for t in tokens)):
            return "back"
        return "mixed" if "content" in words else "named"
    if "head" in words:
        return "head"
    if name == "form" or name == "fieldset":
        return "form"
    return "main" if main else "content" if "content" in words else None


class Block:
    __slots__ = ("parts", "linked", "tag", "state", "parent", "depth", "text")

    def __init__(self, tag: str, state: str | None, parent: int, depth: int):
        self.parts, self.linked, self.tag, self.state, self.parent, self.depth = [], 0, tag, state, parent, depth
        self.text = ""


def _inside(state: str | None, mark: str | None) -> str | None:
    """State of an element within one of ``state``.

    Boilerplate holds; what is so by name alone holds up to a main element.
    A header in the article keeps its headings.
    """
    if state == "boiler" or mark is None:
        return state
    if state == "named":
        return "boiler" if mark == "boiler" else "back" if mark in ("main", "back") else state
    if mark == "header":
        return "title" if state in ("main", "back") else mark
    if mark == "head":
        return "heading" if state in ("main", "back") else mark
    if mark in ("main", "content"):
        return "back" if state == "back" else "main"
    return "back" if mark == "mixed" else mark


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space and references resolved."""
    found: list[Block] = []
    stack: list[tuple[str, str | None, int]] = [("", None, 0)]
    ids, links, current, at, size = 0, 0, None, 0, len(page)
    open_names: Counter = Counter()
    endless: set[str] = set()  # skipped elements without an end from here on

    def close(first: int) -> None:
        open_names.subtract(name for name, _, _ in stack[first:])
        del stack[first:]

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            tag, state, ident = stack[-1]
            current = Block(tag, state, stack[-2][2] if len(stack) > 1 else 0, len(stack))
            found.append(current)
        if "&" in raw:
            raw = html.unescape(raw)
        current.parts.append(raw)
        if links:
            current.linked += len(raw)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                current = None
                if open_names[name] > 0:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name in SKIPPED:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (size if name in ("script", "style", "title", "textarea") else at)
            continue
        if name == "a":
            links = 1
        elif name == "br":
            if current is not None:
                current.parts.append(" ")
        elif name in BLOCK:
            current, links = None, 0
            if name in VOID:
                continue
            if name in CLOSES_SELF:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] not in CLOSES_SELF:
                        break
            elif stack[-1][0] == "p":
                close(len(stack) - 1)
            ids += 1
            open_names[name] += 1
            stack.append((name, _inside(stack[-1][1], _mark(name, m[3][:-1])), ids))
    out = []
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
    return out


def score(b: Block) -> float:
    """Log-odds that a block is content: its place, then length, links and punctuation."""
    if b.state in ("boiler", "header", "form"):
        return -HARD
    if b.state in ("title", "heading") and b.tag in HEADINGS:
        return INSIDE
    if b.state == "title":
        return -HARD
    n = len(b.text)
    s = INSIDE if b.state in ("main", "back") else OUTSIDE
    if b.state in ("back", "named", "head", "heading"):
        s -= NAMED
    if b.tag == "p" or b.tag in HEADINGS:
        s += 1.0
    elif b.tag == "li":
        s -= 0.5
    s += min(2.0, n / 120)
    if b.text[-1] in ".!?:;\"')" or b.text[-1] in "…»”":
        s += 0.5
    if b.text[0] == "©" or b.text.lower().startswith("copyright"):
        s -= 4.0
    return s - 4.0 * min(1.0, b.linked / n)


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Page-order neighbours, closer in depth the stronger, and the previous block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            out.append((i - 1, i, ADJACENT / (1 + abs(a.depth - b.depth))))
        if b.parent in last:
            out.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return out


def min_cut(scores: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise unpaid scores plus cut edges; ties go to the sink."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in joined:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    s, label = list(scores), [None] * n
    todo = deque(range(n))
    while todo:  # settle what no edge can turn
        i = todo.popleft()
        if label[i] is not None or abs(s[i]) <= sum(near[i].values()):
            continue
        label[i] = s[i] > 0
        for j, w in near[i].items():
            s[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[source], cap[sink] = {}, {}
    for i in rest:
        if s[i] > 0:
            cap[source][i], cap[i][source] = s[i], 0.0
        else:
            cap[i][sink], cap[sink][i] = -s[i], 0.0

    def levels() -> dict[int, int]:
        """Distance from the source over edges with room."""
        far, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > ROOM and j not in far:
                    far[j] = far[i] + 1
                    queue.append(j)
        return far

    while sink in (far := levels()):  # each round fills all shortest paths
        ahead = {i: iter(list(cap[i])) for i in far}
        path = [source]
        while path:
            i = path[-1]
            if i != sink:
                step = next((j for j in ahead[i] if cap[i][j] > ROOM and far.get(j) == far[i] + 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)
                continue
            flow = min(cap[a][b] for a, b in zip(path, path[1:]))
            full = len(path)
            for k in range(len(path) - 1, 0, -1):
                a, b = path[k - 1], path[k]
                cap[a][b] -= flow
                cap[b][a] += flow
                if cap[a][b] <= ROOM:
                    full = k
            del path[full:]
    for i in rest:
        label[i] = i in far
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The content blocks of a page joined by newlines; '' for null, empty or textless pages."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut([score(b) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, plus ``out_col``: one row each, whole pages.

    Null html is an empty page with empty text. Markup that never closes,
    cut-off tags and unknown elements are read as browsers do, roughly.
    Repeated rows each get a row; an input column named ``out_col`` is
    replaced; an empty table stays empty.
    """
    keep = others(pages, html_col, out_col)
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias("__html"))
    schema = StructType([*source.schema.fields[:-1], StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out_col])

    return source.mapInArrow(run, schema)
