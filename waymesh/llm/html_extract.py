"""Main text of raw web pages by tag-path ratios.

A page is cut into blocks of text, each at the end of a path of block-level tags (with class and id) from
the root.  Per path, text length and punctuation over its blocks give two ratios, which are fused by
multiplication.  The ratios are smoothed down the tree: a path has at least a part of what the paths
beside and above it have, so a short item among long paragraphs counts as these do, and a heading has a
part of what the text under it has.  Text of links counts against its path, but for headings and inside articles.  Paths that reach a part of the
page's length-weighted mean are content.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by their elements or
names, whatever their ratios.  Names of a layout don't take out an element that holds a first heading,
a main element or most of the page's text, nor, but for adverts and comments, what an article holds.

Pages are scanned once, with look-ups that don't depend on how deep or how long they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。、，！？؟،]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPLIT = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup or isn't text of the page.
RAW = frozenset("script style noscript template textarea title svg iframe select noembed noframes annotation annotation-xml xmp".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag closes, and those beyond which it doesn't look.
CLOSES = {
    "li": ("li p", "ul ol menu"),
    "dt": ("dt dd p", "dl"),
    "dd": ("dt dd p", "dl"),
    "tr": ("tr td th p", "table"),
    "td": ("td th p", "tr table"),
    "th": ("td th p", "tr table"),
    "option": ("option", "datalist"),
}
CLOSES = {name: (closed.split(), until.split()) for name, (closed, until) in CLOSES.items()}
#: Block elements that may stand inside a paragraph; all others close it.
_INSIDE_P = frozenset("body html head button caption label legend option summary dialog tbody td tfoot th thead tr li dt dd search frameset".split())
#: Elements whose text isn't the article's.
BOILERPLATE = frozenset("nav footer aside form button dialog menu search head label legend fieldset option".split())
#: The same by names, the parts of class, id or role between blanks, hyphens and underscores: adverts and reader
#: comments anywhere, layout outside of article and main elements.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
LAYOUT = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar cookie cookies consent notice notices alert banner".split())
#: Comments of readers are named so, or by one comment and such parts alone ("code-comment" isn't theirs).
COMMENTS = frozenset("comments commentlist disqus".split())
OF_COMMENT = frozenset("comment list section area thread form respond reply wrapper container box block body item reader user author meta content text post view".split())
#: A path has at least this part of the ratio of its parent's own blocks; content reaches this part of the mean.
LIFT, LEAST = 0.9, 0.5


class Block:
    __slots__ = ("path", "text", "marks", "linked", "bar", "article")

    def __init__(self, path: int, text: str, linked: float, bar: int, article: bool):
        self.path, self.text, self.linked, self.bar, self.article = path, text, linked, bar, article
        self.marks = len(_MARKS.findall(text))


class Page:
    """Blocks in order; paths (``parent``, ``label``) and bars (``above``, ``kind``, ``holds``: whether a first heading or main element is inside) by number, 0 is the root and no bar."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.parent, self.label, self._number = [0], [""], {}
        self.above, self.kind, self.holds = [0], [""], [False]
        self._source = source
        self._parse()

    def _path(self, parent: int, label: str) -> int:
        found = self._number.get((parent, label))
        if found is None:
            found = self._number[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
        return found

    def _bar(self, above: int, kind: str) -> int:
        self.above.append(above)
        self.kind.append(kind)
        self.holds.append(False)
        return len(self.above) - 1

    def _tokens(self) -> Iterator[tuple[str, str, str]]:
        """Kind (text, open, close), name or text, and attributes; each character is looked at a bounded number of times."""
        page, at, quoted = self._source, 0, True
        last = {q: page.rfind(q) for q in "\"'"}
        while m := _START.search(page, at):
            if m.start() > at:
                yield "text", page[at : m.start()], ""
            if page.startswith("<!--", m.start()):
                end = page.find("-->", m.start() + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page[m.start() + 1] in "!?":
                end = page.find(">", m.start())
                at = len(page) if end < 0 else end + 1
                continue
            name = _NAME.match(page, m.end() - 1)
            end = -1
            if quoted:
                i = name.end()
                while e := _END.search(page, i):
                    i = e.end()
                    if e[0] == ">":
                        end = i - 1
                        break
                    if last[e[0][-1]] >= i:
                        i = page.find(e[0][-1], i) + 1
            if end < 0:  # quotes that don't end: from here on they don't count
                quoted = False
                end = page.find(">", name.end())
            if end < 0:  # the page ends in a tag
                return
            at = end + 1
            closing, lower = page[m.start() + 1] == "/", name[0].lower()
            yield "close" if closing else "open", lower, "" if closing else page[name.end() : end]
            if lower in RAW and not closing and page[end - 1] != "/":
                e = _RAW_END[lower].search(page, at)
                if lower == "xmp":  # text as it stands
                    yield "text", html.escape(page[at : e.start() if e else len(page)], quote=False), ""
                    yield "close", lower, ""
                at = e.end() if e else len(page)
        if at < len(page):
            yield "text", page[at:], ""

    def _parse(self) -> None:
        stack: list[tuple[str, int, int, bool]] = []  # element, path, bar, in an article
        places: dict[str, list[int]] = {}  # of each element that is open, where
        others: list[int] = []  # where block elements other than p are open
        parts: list[str] = []
        plain = linked = links = 0

        def top() -> tuple[str, int, int, bool]:
            return stack[-1] if stack else ("", 0, 0, False)

        def push(name: str, path: int, bar: int, article: bool) -> None:
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS and name != "p":
                others.append(len(stack))
            stack.append((name, path, bar, article))

        def cut(n: int) -> None:
            """Closes all elements from place *n* on."""
            while len(stack) > n:
                name = stack.pop()[0]
                places[name].pop()
                if others and others[-1] == len(stack):
                    others.pop()

        def where(names: list[str]) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=-1)

        def flush() -> None:
            nonlocal plain, linked
            if parts:
                text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    _, path, bar, article = top()
                    self.blocks.append(Block(path, text, linked / max(plain + linked, 1), bar, article))
                parts.clear()
                plain = linked = 0

        for kind, name, attributes in self._tokens():
            if kind == "text":
                parts.append(name)
                if links:
                    linked += len(name.strip())
                else:
                    plain += len(name.strip())
                continue
            if name == "br":
                parts.append("\n")
                continue
            if name == "a":
                links = max(0, links + (1 if kind == "open" else -1))
            if name not in BLOCKS:
                # inline elements aren't part of paths, but may be barred
                if kind == "open" and attributes and name not in VOID and attributes[-1] != "/":
                    _, path, bar, article = top()
                    if why := _named(attributes, article, not places.get("pre"), False)[1]:
                        flush()
                        push(name, path, self._bar(bar, why), article)
                elif kind == "close" and places.get(name):
                    flush()
                    cut(places[name][-1])
                continue
            flush()
            links = 0
            if kind == "close":
                if places.get(name):
                    cut(places[name][-1])
                continue
            if name in CLOSES:
                closed, until = CLOSES[name]
                edge = where(until)
                while (n := where(closed)) > edge:
                    cut(n)
            elif name not in _INSIDE_P and where(["p"]) > (others[-1] if others else -1):
                cut(where(["p"]))
            if name in VOID:
                continue
            _, path, bar, article = top()
            label, why = _named(attributes, article, not places.get("pre"), True) if attributes else ("", "")
            if name in ("html", "body", "article", "main"):
                why = "" if why != "hidden" else why
            if name in BOILERPLATE or name == "header" and not article:
                why = "element"
            if name in ("h1", "main"):
                b = bar
                while b and not self.holds[b]:
                    self.holds[b] = True
                    b = self.above[b]
            push(name, self._path(path, name + label), self._bar(bar, why) if why else bar, article or name in ("article", "main"))
        flush()


def _named(attributes: str, article: bool, named: bool = True, block: bool = True) -> tuple[str, str]:
    """What class and id add to a path, and why an element is barred by its attributes, if it is.

    Attributes are read one after the other, and of repeated ones the first counts.  Names don't count in
    preformatted text (*named*), and only a *block* holds comments.
    """
    label, why, seen = "", "", set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if not key or key in seen:
            continue
        seen.add(key)
        if key == "hidden" or key == "style" and _UNSEEN.search(value):
            why = "hidden"
        elif key in ("class", "id", "role"):
            if key != "role":
                label += "." + _DIGITS.sub("", value)
            if not why and named:
                why = _barred_name(value, article, block)
    return label, why


def _barred_name(value: str, article: bool, block: bool) -> str:
    why = ""
    for name in value.split():
        words = {w for w in _SPLIT.split(name.lower()) if w}
        if words & ADVERTS or block and (words & COMMENTS or "comment" in words and words <= OF_COMMENT):
            return "name"
        if not article and (words | {w.lower() for w in _WORDS.findall(name)}) & LAYOUT:
            why = "layout"
    return why


def barred(page: Page) -> list[bool]:
    """Of each bar, whether it holds: by its element or because it is hidden always, by name unless it holds the page's main part."""
    weight = [0] * len(page.above)
    for b in page.blocks:
        weight[b.bar] += len(b.text)
    total = sum(n for n, kind in zip(weight, page.kind, strict=True) if kind not in ("element", "hidden"))
    for n in range(len(weight) - 1, 0, -1):  # a bar comes after the one above it
        weight[page.above[n]] += weight[n] if page.kind[n] not in ("element", "hidden") else 0
    out = [False]
    for n in range(1, len(weight)):
        kind = page.kind[n]
        fast = kind in ("element", "hidden") or not (page.holds[n] or kind == "layout" and 2 * weight[n] > total)
        out.append(out[page.above[n]] or fast)
    return out


def fused(length: float, marks: float, count: int) -> float:
    """Text length and punctuation of a block on average, multiplied."""
    return length / count * (1 + marks / count) if count else 0.0


def path_ratios(page: Page, blocks: list[Block]) -> list[float]:
    """Of each path, the fused and smoothed ratio of *blocks*, less the part that is links."""
    n = len(page.parent)
    own = [[0.0, 0.0, 0.0, 0] for _ in range(n)]  # text, marks, links and blocks of the path
    exempt = [False] * n
    for b in blocks:
        x = own[b.path]
        x[0] += len(b.text)
        x[1] += b.marks
        x[2] += len(b.text) * b.linked
        x[3] += 1
        exempt[b.path] = b.article or page.label[b.path].split(".")[0] in HEADINGS
    ratio = [fused(text, marks, count) for text, marks, _, count in own]
    # of what lies right in or right below each path, or anywhere in an article or main element, the mean ratio of its text
    around = [[ratio[p] * own[p][0], own[p][0]] for p in range(n)]
    whole = [False] * n
    for p in range(1, n):  # a path comes after its parent
        whole[p] = whole[page.parent[p]] or page.label[p].split(".")[0] in ("article", "main")
    for p in range(n - 1, 0, -1):
        x, y = (around[p] if whole[page.parent[p]] else [ratio[p] * own[p][0], own[p][0]]), around[page.parent[p]]
        y[0] += x[0]
        y[1] += x[1]
    level = [x / y if y else 0.0 for x, y in around]
    out = []
    for p in range(n):
        above = LIFT * level[page.parent[p]] if p else 0.0
        level[p] = max(level[p], above)
        value = max(ratio[p], above)
        text, _, links, _ = own[p]
        out.append(value * (1 - links / text) if text and not exempt[p] else value)
    for p, mean in _sections(page, blocks, out).items():
        out[p] = max(out[p], LIFT * mean)
    return out


def _sections(page: Page, blocks: list[Block], ratio: list[float]) -> dict[int, float]:
    """Of each heading's path, the mean ratio of the text that a heading there stands over, at most.

    That is what follows up to a heading as high, within the element that holds the heading.
    """
    n = len(page.parent)
    size = [1] * n  # of subtrees, and so where each path and its last descendant come in depth-first order
    for p in range(n - 1, 0, -1):
        size[page.parent[p]] += size[p]
    begin, free = [0] * n, [1] * n
    for p in range(1, n):
        q = page.parent[p]
        begin[p] = begin[q] + free[q]
        free[q] += size[p]
    most: dict[int, float] = {}
    open_: list[list[float]] = []  # level, path, sum of ratios by text, text

    def close(n: int) -> None:
        while len(open_) > n:
            _, p, total, text = open_.pop()
            if text:
                most[p] = max(most.get(p, 0.0), total / text)

    for b in blocks:
        name = page.label[b.path].split(".")[0]
        level = int(name[1]) if name in HEADINGS else 7
        for k, section in enumerate(open_):
            q = page.parent[section[1]]
            if level <= section[0] or not begin[q] <= begin[b.path] < begin[q] + size[q]:
                close(k)
                break
        if level < 7:
            open_.append([level, b.path, 0.0, 0])
            continue
        for section in open_:  # one for each level at most
            section[2] += ratio[b.path] * len(b.text)
            section[3] += len(b.text)
    close(0)
    return most


def content_paths(page: Page, blocks: list[Block]) -> set[int]:
    """Paths that reach LEAST of the mean ratio of all text."""
    ratio = path_ratios(page, blocks)
    total = sum(len(b.text) for b in blocks)
    mean = sum(ratio[b.path] * len(b.text) for b in blocks) / total if total else 0.0
    return {b.path for b in blocks if ratio[b.path] >= LEAST * mean}


def main_text(source: str | None) -> str:
    """The page's main text: blocks of content paths, in order, joined by an empty line."""
    if not source:
        return ""
    page = Page(source)
    gone = barred(page)
    blocks = [b for b in page.blocks if not gone[b.bar]]
    chosen = content_paths(page, blocks)
    return "\n\n".join(b.text for b in blocks if b.path in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of *pages*.

    A null or empty page, or one without content, gives the empty text.  Ids and urls are handed through as
    they are, null or repeated; other columns aren't read.
    """
    shared.in_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(shared.frugal(run), "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all of ``pages``."""
    return extract(shared.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.col("n_chars"))
