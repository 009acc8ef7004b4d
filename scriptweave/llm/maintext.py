"""Main text of HTML pages by a minimum cut.

A page is read once, tolerantly, into blocks: runs of text between block-level tags. A classifier gives
each block a log odds of being content, which becomes the capacity of its edge to the source (content)
or the sink (boilerplate). Blocks that follow each other, and blocks with the same parent, are joined by
edges that make it dear to part them. The maximum flow's cut labels the blocks; content blocks, in page
order, are the text.

A name such as ``sidebar`` speaks against what is in its element, but not on ``html`` or ``body``, not where it
only says what a page has or lacks (``has-sidebar``), and not around the page's first article or nearly
all of its text.

Scripts, styles, comments and the like are no text at all; an embedded element that nothing closes is as if
it were not there. Null and empty pages have an empty text, and so has a page in which nothing is content.
Repeated rows and pages get the same result each. Reading is linear in the page, whatever is left open in it.
Further columns are carried along.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# HTML element names by what they mean for the text.
RAW = set("""script style title textarea noscript iframe template svg object select canvas audio video annotation
annotation-xml""".split())
TO_THE_END = set("script style title textarea".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small
span strike strong sub sup time tt u var wbr br input label math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot
mstyle mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form menu dialog button fieldset".split())
CONTENT = set("article main".split())
CLOSES_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li""".split())
# Words in a class, id or role that name boilerplate, or content.
BAD_NAMES = set("""ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright dialog disclaimer discussion disqus footer footnav gdpr header login masthead menu menubar modal nav
navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related replies
respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget""".split())
GOOD_NAMES = set("article articlebody content entry main post story text".split())
# Words that make a name say what a page has or lacks.
ABOUT = set("has with no without hide show toggle".split())

# The classifier's weights (log odds) and the edges' capacities.
PRIOR, IN_CONTENT, IN_BOILERPLATE, IN_PAGE_HEADER, GOOD_NAME = -0.5, 4.0, -12.0, -6.0, 1.0
PARAGRAPH, HEADING, LIST_ITEM, PER_LENGTH, MOST_LENGTH, LINKS = 1.0, 0.5, 0.4, 0.01, 2.0, -4.0
NEXT, SIBLING = 0.4, 0.6
NEARLY_ALL = 0.9

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    content: bool
    bad: bool
    header: bool
    good: bool
    linked: int


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("open" or "close", name, attributes), in one pass."""
    low = page.translate(_LOWER)
    at, n = 0, len(page)
    no_quote: set[str] = set()
    no_close: set[str] = set()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        found = _NAME.match(page, start + 1)
        if not found:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        end = found.end()
        while True:
            mark = _QUOTE.search(page, end)
            if not mark or mark[0] == ">":
                end = mark.start() if mark else n
                break
            end = mark.end()
            if mark[0] not in no_quote and page[max(0, mark.start() - 40) : mark.start()].rstrip().endswith("="):
                close = page.find(mark[0], end)
                if close < 0:
                    no_quote.add(mark[0])
                else:
                    end = close + 1
        name = low[found.start(1) : found.end()]
        attributes = page[found.end() : end]
        at = end + 1
        if page[start + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = -1 if name in no_close else low.find(f"</{name}", at)
            if end < 0:
                if name in TO_THE_END:
                    return
                no_close.add(name)
                continue
            end = page.find(">", end)
            at = n if end < 0 else end + 1


def _names(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role but for names about the page, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            for one in value.split():
                found = _SPLIT.split(_CAMEL.sub("-", one).lower())
                if ABOUT.isdisjoint(found):
                    words.update(found)
    return words, hidden


_PLAIN: frozenset = frozenset()


def _marks(name: str, attributes: str) -> frozenset:
    """What an element puts its content in: content, bad, named (bad by its name), header, good, hidden."""
    on = {"content"} if name in CONTENT else {"bad"} if name in BOILERPLATE else {"header"} if name == "header" else set()
    if attributes:
        words, hidden = _names(attributes)
        body = "articlebody" in words
        if body:
            on.add("content")
        elif "article" not in words and name not in ("html", "body") and words & BAD_NAMES:
            on.add("named")
        if words & GOOD_NAMES:
            on.add("good")
        if hidden:
            on.add("hidden")
    return frozenset(on) if on else _PLAIN


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    # name, and of the block element it is or is in: number, parent's number, name; what it puts its content in
    stack: list[tuple[str, int, int, str, frozenset]] = [("", 0, 0, "", frozenset())]
    open_tags: Counter = Counter()
    inside: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    ids = 0
    # of each element that is bad by its name: the one it is in, the characters in it, whether the name counts
    outer: list[int] = []
    held: list[int] = []
    counts: list[bool] = []
    of_block: list[int] = []
    within = -1
    seen_content = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, _, parent, tag, _ = stack[-1]
            links = len("".join(linked).strip())
            header = inside["header"] > 0 and not inside["content"]
            out.append(Block(text, tag, parent, inside["content"] > 0, inside["bad"] > 0, header, inside["good"] > 0, links))
            of_block.append(within)
        parts.clear()
        linked.clear()

    def pop(name: str) -> None:
        nonlocal within
        while len(stack) > 1:
            tag, _, _, _, marks = stack.pop()
            open_tags[tag] -= 1
            for mark in marks:
                inside[mark] -= 1
            if "named" in marks:
                within = outer[within]
            if tag == name:
                return

    for kind, name, attributes in _tokens(page):
        if kind == "text":
            if not inside["hidden"]:
                parts.append(name)
                if open_tags["a"]:
                    linked.append(name)
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if kind == "close":
            if open_tags[name] > 0:
                pop(name)
            continue
        if name in RAW or name in VOID:
            continue
        if name in CLOSES_P and open_tags["p"] > 0:
            pop("p")
        on = _marks(name, attributes)
        for mark in on:
            inside[mark] += 1
        if "content" in on and not seen_content:
            seen_content = True
            around = within
            while around >= 0:
                counts[around] = False
                around = outer[around]
        if "named" in on:
            outer.append(within)
            held.append(0)
            counts.append(True)
            within = len(outer) - 1
        open_tags[name] += 1
        ids += 1
        if name in INLINE:  # its text is the block element's
            stack.append((name, *stack[-1][1:4], on))
        else:
            stack.append((name, ids, stack[-1][1], name, on))
    flush()
    for block, one in zip(out, of_block):
        if one >= 0:
            held[one] += len(block.text)
    for one in range(len(outer) - 1, -1, -1):  # an element comes behind the one it is in
        if outer[one] >= 0:
            held[outer[one]] += held[one]
    most = NEARLY_ALL * sum(len(block.text) for block in out)
    bad = [False] * len(outer)
    for one, around in enumerate(outer):
        bad[one] = counts[one] and held[one] < most or around >= 0 and bad[around]
    for block, one in zip(out, of_block):
        block.bad = block.bad or one >= 0 and bad[one]
    return out


def log_odds(block: Block) -> float:
    """The classifier: positive for content."""
    score = PRIOR + IN_CONTENT * block.content + IN_BOILERPLATE * block.bad + IN_PAGE_HEADER * block.header + GOOD_NAME * block.good
    score += PARAGRAPH if block.tag in ("p", "blockquote", "pre") else HEADING if re.fullmatch("h[1-6]", block.tag) else LIST_ITEM if block.tag == "li" else 0
    score += min(MOST_LENGTH, PER_LENGTH * len(block.text))
    return score + LINKS * min(1.0, block.linked / len(block.text))


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side: ``terminal`` is a capacity from the source where positive,
    to the sink where negative; edges hold in both directions. Shortest augmenting levels (Dinic)."""
    n = len(terminal)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    capacity: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        capacity.extend((there, back))

    for i, t in enumerate(terminal):
        if t > 0:
            edge(source, i, t, 0.0)
        elif t < 0:
            edge(i, sink, -t, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if capacity[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if capacity[e] <= 1e-12)
                node = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[node] < len(head[node]):
                e = head[node][at[node]]
                if capacity[e] > 1e-12 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(head[node]):
                e = head[node][at[node]]
                path.append(e)
                node = to[e]
            elif path:
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Content blocks joined by newlines."""
    found = blocks(page) if page else []
    edges = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if block.parent in last:
            edges.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    side = minimum_cut([log_odds(b) for b in found], edges)
    return "\n".join(b.text for b, content in zip(found, side) if content)


def extracted(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars, which replace columns of those names. ``keep`` names the columns to carry
    (default: all). Nothing is shuffled."""
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            arrays = [batch.column(f"_{i}") for i in range(len(keep))]
            arrays += [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    source = pages.select(F.col(f"`{page}`").alias("_html"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return source.mapInArrow(rows, T.StructType([pages.schema[c] for c in keep] + added))
