"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one for each block element. Text inside menus, headers, footers,
asides, forms, notices, adverts, comments and the like gives empty lines, and so do lines that are
mostly links. Wrappers that look like boilerplate but hold the page's only article or main element, and
those named for the layout (sidebar, widget, form) that together hold most of its text, count as text
(``spared``). The lengths of a sliding window of lines form the block distribution; it surges where
text begins and dives to nothing after a gap of empty lines, which cuts the page into regions. Inside
an article, elements whose name only begins with a word of boilerplate (related-work) are text if they hold
some outside links. Article
and main elements, where there are any, say what belongs to the text. Else it reaches from the first
region of ``surge`` characters or with a main heading to the last of ``surge`` characters, and all
between is kept, however long the rest; without such a region the whole page is.

Defined cases: null and empty pages give an empty text; unclosed elements end with the page or their
parent; the text is never shortened; repeated rows are handled alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import map_frames

#: Element names by their part in a page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head select option datalist textarea button title".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset(["article", "main"])
CLOSES_P = BLOCK
#: Fixed value: words that mark an element as boilerplate where they stand alone in its class, id or role.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar"
    r"|comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*"
    r"|pagination|pager|copyright|legal|disclaimer|contentinfo|complementary|navigation|form|skip)(?:$|[\s_-]|\d)",
    re.I,
)
#: Fixed value: words of it that say where an element stands, not what it is; and words that a class only mentions.
LAYOUT = re.compile(r"side(?:bar\w*)?|widget\w*|form|header|masthead|topbar|toolbar|overlay|modal", re.I)
#: Fixed value: words of it that are as often the subject of a text, where they are part of a longer name.
TOPIC = re.compile(r"[^\s]*(?:social|related|share|sharing|search|legal|alert|login|signup|form|copyright|menu|promo)[_-][^\s]+", re.I)
#: Elements that hold a text's words themselves, and characters from which others named by a subject are text.
TEXTUAL, TOPIC_CHARS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote em strong b i span".split()), 100
_MENTION = re.compile(r"(?:^|[\s_-])(?:no|has|with|without|hide)[_-]\S*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: In the page itself: a lower-cased copy can be longer (U+0130).
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_BODY = re.compile("<body", re.I | re.A)


class _Lines:
    """Lines of a page: (text, characters inside links, container depth, main heading), boilerplate as gaps."""

    def __init__(self, gap: int) -> None:
        self.gap = gap
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False

    def end(self, container: int) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.linked, container, self.heading))
            self.parts, self.linked, self.heading = [], 0, False

    def hole(self) -> None:
        self.lines.extend([("", 0, 0, False)] * self.gap)


class _Element:
    """An element that looks like boilerplate: characters of text outside links, and articles, without those of such elements inside."""

    def __init__(self, number: int, layout: bool, topic: int | None = None) -> None:
        self.number, self.layout, self.topic = number, layout, topic  # topic: characters of text it needs to be none
        self.text = self.articles = 0
        self.inside: list[_Element] = []


def spared(page: _Element) -> set[int]:
    """Numbers of the elements that are text after all, from the outermost inwards."""
    held, todo = {}, [page]
    for e in todo:
        todo.extend(e.inside)
    for e in reversed(todo):
        held[e] = (e.text + sum(held[x][0] for x in e.inside), e.articles + sum(held[x][1] for x in e.inside))
    out = {e.number for e in todo if e.topic is not None and held[e][0] >= e.topic}
    articles, outer = page.articles, list(page.inside)
    while True:
        wrappers = [e for e in outer if held[e][1]] if not articles else []
        layout = [e for e in outer if e.layout]
        if wrappers:
            found = [max(wrappers, key=lambda e: held[e][0])]
        elif not articles and 2 * sum(held[e][0] for e in layout) > held[page][0]:
            found = layout
        else:
            return out
        for e in found:
            out.add(e.number)
            articles += e.articles
        outer = [e for e in outer if e not in found] + [x for e in found for x in e.inside]


def page_lines(html: str, gap: int, spare: set[int] | None = None) -> list[tuple[str, int, int, bool]]:
    """Strip markup into lines; ``gap`` empty ones stand for each boilerplate element but those to ``spare``."""
    out, stack = _Lines(gap), []  # stack: (name, boilerplate, container number)
    page = _Element(-1, False)
    within, number = [page], 0
    bad = links = headings = container = containers = at = 0

    def text(raw: str) -> None:
        if raw and not links:
            within[-1].text += len(raw.strip())
        if raw and not bad:
            raw = unescape(raw)
            out.parts.append(raw)
            out.heading |= headings > 0
            if links:
                out.linked += len(raw.strip())

    def close(depth: int) -> None:
        nonlocal bad, links, headings, container
        while len(stack) > depth:
            name, boiler, before = stack.pop()
            if name in BLOCK:
                out.end(container)
            bad -= boiler
            if boiler:
                within.pop()
            links -= name == "a"
            headings -= name == "h1"
            container = before
            if boiler and not bad:
                out.hole()

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in CONTAINER and name not in ("body", "html", "main", "article"):
                    break  # a stray end tag doesn't leave the article
            if name in BLOCK:
                out.end(container)
            continue
        if name in RAW:  # all that stands up to the end tag is no text
            if m[0].endswith("/>"):
                continue
            end = _RAW_END[name].search(html, at)
            if end is None and name == "head":
                body = _BODY.search(html, at)
                at = body.start() if body else at
                continue
            if end is None:
                break
            shut = html.find(">", end.start())
            at = len(html) if shut < 0 else shut + 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            if name == "hr":
                out.end(container)
            continue
        if name in BLOCK:
            out.end(container)
            if stack and name != "html":  # a block ends an open paragraph, an item the open item
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p" or stack[depth][0] == name and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                        close(depth)
                        break
                    if stack[depth][0] in BLOCK:
                        break
        boiler = name in BOILERPLATE
        layout, topic = name in ("form", "fieldset"), None
        if not boiler and name not in ("html", "body") and m[3]:
            words, hidden = [], False
            for key, a, b, c in _ATTRIBUTE.findall(m[3]):
                key, value = key.lower(), a or b or c
                if key in ("class", "id", "role") and name not in CONTAINER and HINT.search(value):
                    words += [w for w in _MENTION.sub(" ", value).split() if HINT.search(w)]
                hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true"
            boiler = hidden or bool(words)
            # inside an article, a longer name that begins with such a word tells the subject of a text
            topic = (0 if name in TEXTUAL else TOPIC_CHARS) if container and words and not hidden and all(TOPIC.fullmatch(w) for w in words) else None
            layout = not hidden and all(LAYOUT.search(w) and not HINT.search(LAYOUT.sub("", w)) for w in words)
        if boiler:
            number += 1
            if spare and number in spare:
                boiler = False
        if boiler:
            within[-1].inside.append(_Element(number, layout, topic))
            within.append(within[-1].inside[-1])
        if name in CONTAINER:
            within[-1].articles += 1
        if boiler and not bad:
            out.end(container)
            out.hole()
        bad += boiler
        links += name == "a"
        headings += name == "h1"
        stack.append((name, boiler, container))
        if name in CONTAINER and not bad:
            containers += not container
            container = container or containers
    close(0)
    out.end(0)
    if spare is None and page.inside and (spare := spared(page)):
        return page_lines(html, gap, spare)
    return out.lines


def main_text(html: str | None, window: int = 3, link_share: float = 0.6, surge: int = 25) -> str:
    """The main text of one page."""
    lines = page_lines(html, window) if html else []
    weight = [0 if not t or linked > link_share * len(t) and not box and not heading else len(t) for t, linked, box, heading in lines]
    regions: list[list[int]] = []
    block = 0  # the window's sum: a surge opens a region, a dive to nothing ends it
    for i, w in enumerate(weight):
        before, block = block, sum(weight[max(0, i - window + 1) : i + 1])
        if block and not before:
            regions.append([])
        if w:
            regions[-1].append(i)
    if not regions:
        return ""
    keep = [i for i, w in enumerate(weight) if w and lines[i][2]]
    if not keep:
        long = [k for k, r in enumerate(regions) if sum(weight[i] for i in r) >= surge]
        first = min([*long[:1], *[k for k, r in enumerate(regions) if any(lines[i][3] for i in r)][:1]], default=0)
        last = max(long, default=len(regions) - 1)
        keep = [i for r in regions[min(first, last) : last + 1] for i in r]
    return "\n".join(lines[i][0] for i in keep)


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", columns: tuple[str, ...] = ("url",)) -> DataFrame:
    """Rows (id, *columns, text, n_chars): the main text of every whole page."""
    pages = df.select(F.col(id_col), *columns, F.col(html_col).alias("html"))
    kept = [id_col, *columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept) + ", text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pdf[kept].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.transform(map_frames, run, schema)
