"""Main text of web pages: paragraphs score their ancestors, the best container is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import make_room

# Tag, comment or declaration. Possessive, so that no page makes it backtrack.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"<]*"|'[^'<]*'|["'])*+)>|<[!?/][^>]*>""",
    re.S)
ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Elements by what they do to the text.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "noembed", "svg", "xmp"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object",
           "canvas", "audio", "video", "map", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
          "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = HEADINGS | {"p", "pre", "li", "dt", "dd", "td", "th", "blockquote", "figcaption", "caption"}
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tr": ({"tr"}, {"table"}), "body": ({"head"}, {"html"})}
LINK_LISTS = {"ul", "ol", "dl", "table", "div", "section"}
START_SCORE = {"article": 25, "main": 25, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3,
               "ol": -3, "ul": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body"}
COMMENT_WORDS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
OTHER_WORDS = COMMENT_WORDS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar",
    "aside", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notification",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "social",
    "share", "sharing", "related", "recommended", "recommendations", "widget", "pagination", "pager",
    "toolbar", "search", "login", "register", "skip", "hidden", "topbar", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert",
         "form", "menu", "menubar", "toolbar"}
LEAST_PARAGRAPH = 25


class _Page:
    """The tree of one page as parallel lists, and its blocks of text in page order."""

    def __init__(self, html: str, by_class: bool):
        self.tag, self.parent, self.out, self.weight = ["html"], [-1], [False], [0]
        self.header = [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.by_class = by_class
        self.article = [False]
        self._open, self._parts = [0], []
        self._held: dict[str, int] = {}  # open elements per tag: a stray end tag costs nothing
        self._link = self._paragraph = None  # how deep an open link or paragraph lies
        self._read(html)

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join(part for part, _ in self._parts).split())
        if text:
            linked = sum(len(part.strip()) for part, link in self._parts if link)
            self.blocks.append((self._open[-1], text, min(linked, len(text))))
        self._parts = []

    def _close(self, depth: int) -> None:
        self._flush()
        for node in self._open[depth:]:
            self._held[self.tag[node]] -= 1
        del self._open[depth:]
        if self._link is not None and self._link >= len(self._open):
            self._link = None
        if self._paragraph is not None and self._paragraph >= len(self._open):
            self._paragraph = None

    def _start(self, tag: str, attributes: str) -> None:
        if self._paragraph is not None:
            self._close(self._paragraph)
        if tag in CLOSES and any(self._held.get(name) for name in CLOSES[tag][0]):
            same, stop = CLOSES[tag]
            for depth in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[depth]] in stop:
                    break
                if self.tag[self._open[depth]] in same:
                    self._close(depth)
                    break
        self._flush()
        above = self._open[-1]
        apart, weight, header = self._judge(tag, attributes, above)
        self.tag.append(tag)
        self.parent.append(above)
        self.out.append(self.out[above] or apart)
        self.header.append(self.header[above] or header)
        self.weight.append(weight)
        self.article.append(self.article[above] or tag in ("article", "main"))
        if tag == "p":
            self._paragraph = len(self._open)
        self._open.append(len(self.tag) - 1)
        self._held[tag] = self._held.get(tag, 0) + 1

    def _judge(self, tag: str, attributes: str, above: int) -> tuple[bool, int, bool]:
        """Whether an element is no part of an article, its start score, and whether it is
        the header of an article, of which only headings count."""
        inside = self.article[above]
        header = tag == "header" and inside
        if tag in DROPPED or (tag == "header" and not inside):
            return True, 0, False
        weight = START_SCORE.get(tag, -5 if tag in HEADINGS else 0)
        words: set[str] = set()
        for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return tag not in ("html", "body"), 0, False
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return tag not in ("html", "body"), 0, False
            if name == "role" and value in ROLES:
                return tag not in ("html", "body"), 0, False
            if name in ("class", "id"):
                for word in value.split():
                    if not word.startswith(("has-", "with-", "no-")):
                        # A paragraph of an article may be named "share-price": there whole names decide.
                        words.update([word] if inside and tag in LEAVES else re.findall(r"[a-z]+", word))
        if self.by_class and words & OTHER_WORDS and tag not in ("html", "body", "main"):
            if "header" in words and inside and not words & (OTHER_WORDS - {"header"}):
                return False, 0, True
            if tag != "article" or words & COMMENT_WORDS:
                return True, 0, False
        return False, weight + (25 if words & CONTENT_WORDS else 0), header

    def _read(self, html: str) -> None:
        at = 0
        while found := MARKUP.search(html, at):
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._end(tag)
            elif tag in RAW:
                ending = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = ending.end() if ending else len(html)
            elif tag == "br":
                self._parts.append((" ", False))
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            elif tag == "a":
                self._link = len(self._open) - 1
            elif tag not in INLINE:
                self._start(tag, found[3])
        self._text(html[at:])
        self._flush()

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = None
        elif tag not in INLINE and self._held.get(tag):
            for depth in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[depth]] == tag:
                    self._close(depth)
                    break

    def _text(self, text: str) -> None:
        if text:
            self._parts.append((unescape(text) if "&" in text else text, self._link is not None))

    def kept_blocks(self) -> list[tuple[int, str, int]]:
        return [
            block for block in self.blocks
            if not self.out[block[0]] and (not self.header[block[0]] or self.tag[block[0]] in HEADINGS)]


def _best(page: _Page, blocks: list[tuple[int, str, int]], chars: list[int], links: list[int]) -> tuple[int, list[float]]:
    """The container whose score, discounted by link density, is highest; and all scores."""
    score = [0.0] * len(page.tag)
    named = set()
    for node, text, _ in blocks:
        if len(text) < LEAST_PARAGRAPH or page.tag[node] in HEADINGS:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        above = page.parent[node] if page.tag[node] in LEAVES and node else node
        for level in range(5):
            if above < 0:
                break
            if above not in named:
                named.add(above)
                score[above] += page.weight[above]
            score[above] += points / (1, 2, 6, 9, 12)[level]
            above = page.parent[above]
    for node in named:
        score[node] *= 1 - links[node] / max(1, chars[node])
    if named:
        return max(sorted(named), key=lambda node: score[node]), score
    marked = [n for n in range(len(page.tag)) if page.tag[n] in ("article", "main") and chars[n]]
    return (marked[0] if marked else 0), score


def _whole(page: _Page, best: int, chars: list[int], links: list[int]) -> int:
    """The article that the best container is a part of: the nearest ``article`` around it, else a
    ``main`` with few links; the container itself if there is none."""
    around, node = best, best
    while node >= 0:
        if page.tag[node] == "article":
            return node
        if page.tag[node] == "main" and links[node] < 0.3 * chars[node]:
            around = node
        node = page.parent[node]
    return around


def _select(page: _Page) -> list[str]:
    blocks = page.kept_blocks()
    size = len(page.tag)
    chars, links = [0] * size, [0] * size
    for node, text, linked in blocks:
        chars[node] += len(text)
        links[node] += linked
    for node in range(size - 1, 0, -1):  # children come after their parents
        chars[page.parent[node]] += chars[node]
        links[page.parent[node]] += links[node]
    best, score = _best(page, blocks, chars, links)
    best = _whole(page, best, chars, links)
    keep, inside = [False] * size, [False] * size
    for node in range(size):
        above = page.parent[node]
        inside[node] = page.tag[node] == "article" or above >= 0 and inside[above]
        if node == best:
            keep[node] = True
        elif above >= 0 and keep[above]:
            # Lists of links are menus, but for those that an article itself holds.
            dense = not inside[node] and page.tag[node] in LINK_LISTS and links[node] > 0.6 * chars[node] > 0
            keep[node] = not dense
        elif above == page.parent[best] and above >= 0:
            plain = links[node] < 0.25 * max(1, chars[node])
            text_like = page.tag[node] == "p" and plain and chars[node] > 80
            title = page.tag[node] == "h1" and node < best and plain
            keep[node] = text_like or title or (plain and score[node] >= max(10, 0.2 * score[best]))
    return [text for node, text, _ in blocks if keep[node]]


def main_text(html: str | None) -> str:
    """Blocks of the main container and its like siblings, in page order, one to a line.

    If the best container is a part of an ``article`` or ``main``, all of that is the main container.
    Elements whose names or classes tell menus, notices and the like are left out first.
    If that leaves nothing, classes are not believed.
    """
    if not html:
        return ""
    found = _select(_Page(html, by_class=True))
    return "\n".join(found or _select(_Page(html, by_class=False)))


def _extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([main_text(html) for html in column.to_pylist()], pa.string())


def extract_text(html: Column) -> Column:
    """Main text of a whole page. Null, empty and pages without text give the empty string;
    markup that is never closed runs to the end of the page."""

    def extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _extract(columns)

    return F.arrow_udf(extract, "string")(html)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every page; other columns are kept,
    but for an earlier ``text`` or ``n_chars``, which are replaced."""
    found = make_room(pages, "text", "n_chars").withColumn("text", extract_text(F.col(html_col)))
    return found.withColumn("n_chars", F.length("text").cast("long"))
