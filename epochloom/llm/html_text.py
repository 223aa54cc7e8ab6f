"""Main text of web pages by tag-path ratios.

1. A page becomes blocks of text in page order. Each block stands on a
   root-to-leaf path of block elements (tag, class, id); equal paths share one
   row of the path table, which sums the text outside links and the punctuation
   of all blocks on it.
2. Both columns are fused to one score a path, 1 for the strongest. Article and
   main elements raise the scores of the paths inside them.
3. Scores are smoothed along the tree: a path gets the best score that reaches
   it from another path by climbing to their common element and down again,
   less a share for every step. Leaving an article costs nearly all of it.
4. Paths that reach the threshold are content, and all blocks on them are
   returned, short ones too. If one element below the body holds nearly all
   text, blocks beside it need a strong path of their own, and link lists
   beside it (or beside an article) count only between content blocks.

Elements that say what they are (navigation, forms, asides, marked classes) have
no part in the table. A marked element that holds an article, a headline or most
of the text (on a page without an article element) is a wrapper, and its mark is
ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, read, slices

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp canvas audio video select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mover munder munderover mstyle semantics mtable mtr mtd svg g text tspan textpath object".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that are never the article, and those that may also wrap it.
LEFT_OUT = frozenset("nav footer aside menu button dialog".split())
MAY_WRAP = frozenset("header form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold text themselves, and those that group such.
TEXTUAL = frozenset("p li dt dd td th pre blockquote figcaption caption summary address".split()) | HEADINGS
GROUPS = frozenset("ul ol dl table thead tbody tfoot tr figure details".split())
#: Words of a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead header topbar toolbar contentinfo complementary "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay notice notices alert pagination pager skip search".split()
)
READERS = frozenset("comment comments commentlist commentform respond disqus reply replies discussion".split())
#: Words that may stand beside a mark in a class name without changing what it says.
BESIDE = frozenset("site main primary secondary global top bottom left right upper lower container wrapper wrap box list area bar block section region inner outer panel links link form thread items item text buttons icons".split())
_SIBLING = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCT = re.compile(r"[,.;:!?，。；：！？、]")

#: Shares that a score keeps: out of an element, and down into one.
OUT_OF_ARTICLE, OUT_OF_TEXT, OUT_OF_OTHER = 0.1, 0.75, 0.6
INTO_GROUP, INTO_OTHER, INSIDE = 0.95, 0.7, 0.97
#: A path's score that makes it content; factors of paths in an article and of headlines.
THRESHOLD, ARTICLE_FACTOR, HEADLINE_FACTOR = 0.5, 3.0, 1.5
#: Share of the text that makes a marked element a wrapper, and an element the content's own.
MOST, OWN = 0.5, 0.85


def _mark(token: str) -> str:
    """What a class token, id or role says as a whole: "part" of the page
    beside the article, "readers" for comments, or nothing. Each of its words
    must be a mark or a word that may stand beside one."""
    words = [w.lower() for w in _PART.findall(token)]
    said = [w for w in words if w in MARKS or w in READERS]
    if not said or any(w not in MARKS and w not in READERS and w not in BESIDE and not w.isdigit() for w in words):
        return ""
    return "readers" if any(w in READERS for w in said) else "part"


class Page:
    """Elements by number (0 is the page) and blocks in order.

    tag, label, parent, kind (0 plain, 1 marked, 2 never content) by element;
    block: (element, text, characters in links).
    """

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.kind = [""], [""], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _element(self, tag: str, attrs: str, parent: int, in_article: bool) -> int:
        kind = 2 if tag in LEFT_OUT else 1 if tag in MAY_WRAP else 0
        name_of = ""
        if attrs and tag not in ("html", "body"):
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role"):
                    if name == "class" or name == "id" and tag not in TEXTUAL:
                        name_of += f".{value}"
                    if tag not in ARTICLE or name == "class":
                        said = {_mark(t) for t in value.split()}
                        kind = max(kind, 2 if "readers" in said else 1 if "part" in said and tag not in ARTICLE else 0)
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display:none|visibility:hidden", value.lower().replace(" ", "")):
                    kind = 2
        if tag in HEADINGS and in_article and self.tag[parent] == "header":
            parent, kind = self.parent[parent], min(kind, 2 * (kind == 2))  # the headline of an article's own header is the article's
        self.tag.append(tag)
        self.label.append(tag + name_of)
        self.parent.append(parent)
        self.kind.append(kind)
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # tag, number of its element (that of its block for inline ones)
        open_: dict[str, int] = {}  # how many of a tag are open
        held: list[str] = []
        links = at = 0

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1][1] if stack else 0, text, min(links, len(text))))
                held.clear()
            links = 0

        def say(raw: str) -> None:
            nonlocal links
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                held.append(text)
                if open_.get("a"):
                    links += len(text.strip())

        def pop_to(i: int) -> None:
            for tag, _ in stack[i:]:
                open_[tag] -= 1
            del stack[i:]

        def end(tag: str) -> None:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    pop_to(i)
                    return
                if tag in INLINE and stack[i][0] not in INLINE:
                    return  # a formatting tag closes nothing outside its block

        n = len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                say(page[at:])
                break
            m = _TOKEN.match(page, lt)
            if m is None:
                nxt = page[lt + 1 : lt + 2]
                if not (nxt.isalpha() and nxt.isascii() or nxt == "/" or not nxt):  # a plain "<"
                    say(page[at : lt + 1])
                    at = lt + 1
                    continue
                say(page[at:lt])
                gt = page.find(">", lt)  # quotes that don't match: up to the next ">"; cut off: nothing more
                at = gt + 1 if gt >= 0 else n
                continue
            say(page[at:lt])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    say(" ")
                elif open_.get(tag):
                    end(tag)
                elif tag == "p":
                    flush()
                continue
            if open_.get("head") and tag not in IN_HEAD:  # the head ends here, said or not
                flush()
                pop_to(next(i for i, s in enumerate(stack) if s[0] == "head"))
            if tag in RAW:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = stop.end() if stop else n
                continue
            if tag in VOID:
                if tag == "br":
                    say(" ")
                elif tag not in ("wbr", "img"):
                    flush()
                continue
            if tag in INLINE:
                stack.append((tag, stack[-1][1] if stack else 0))
                open_[tag] = open_.get(tag, 0) + 1
                continue
            flush()
            closes, stops = _SIBLING.get(tag, ("", ()))
            if closes and any(open_.get(c) for c in closes.split()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in closes.split():
                        pop_to(i)
                        break
            if open_.get("p"):  # a block ends an open paragraph
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
            in_article = any(open_.get(t) for t in ARTICLE)
            stack.append((tag, self._element(tag, m[3], stack[-1][1] if stack else 0, in_article)))
            open_[tag] = open_.get(tag, 0) + 1
        flush()

    def left_out(self) -> list[bool]:
        """For each element whether it has no part in the article."""
        size = len(self.tag)
        chars, blocks, holds = [0] * size, [0] * size, [False] * size
        for e, text, links in self.blocks:
            chars[e] += len(text) - links
            blocks[e] += 1
        for e in range(size - 1, 0, -1):
            p = self.parent[e]
            holds[e] = holds[e] or self.tag[e] in ARTICLE
            if self.kind[e] != 2:  # what is never content says nothing of what holds it
                chars[p] += chars[e]
                blocks[p] += blocks[e]
                holds[p] = holds[p] or holds[e] or self.tag[e] == "h1" and self.tag[p] != "header"
        least = MOST * chars[0] if not any(t in ARTICLE and chars[e] for e, t in enumerate(self.tag)) else chars[0]
        out = [False] * size
        for e in range(1, size):
            wraps = holds[e] and self.tag[e] not in ARTICLE or chars[e] > least and blocks[e] > 2
            out[e] = out[self.parent[e]] or self.kind[e] == 2 or self.kind[e] == 1 and not wraps
        return out

    def own(self, out: list[bool]) -> list[bool]:
        """For each element whether it stands in the smallest element below the
        body that holds nearly all text outside links."""
        size = len(self.tag)
        chars = [0] * size
        for e, text, links in self.blocks:
            if not out[e]:
                chars[e] += len(text) - links
        for e in range(size - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        best = 0
        for e in range(1, size):  # parents come first, and two that hold as much stand in each other
            if chars[0] and chars[e] >= OWN * chars[0] and self.tag[e] not in TEXTUAL and self.tag[e] not in GROUPS and self.tag[e] not in ("html", "body"):
                best = e
        inside = [False] * size
        if best:
            inside[best] = True
            for e in range(best + 1, size):
                inside[e] = inside[self.parent[e]]
        return inside


class PathTable:
    """The paths of a page's blocks that aren't left out, with their sums.

    up, tag by path (0 is the root); inside: whether it goes through an article
    element, near: or through the content's own one; chars (outside links),
    all_chars, puncts: sums over the blocks on a path; of: path of each block,
    None if left out; own: whether a block stands in the content's own element.
    """

    def __init__(self, page: Page):
        self.up, self.tag, self.inside = [0], [""], [False]
        number: dict[tuple[int, str], int] = {}
        path = [0] * len(page.tag)
        for e in range(1, len(page.tag)):
            key = (path[page.parent[e]], page.label[e])
            at = number.get(key)
            if at is None:
                at = number[key] = len(self.up)
                self.up.append(key[0])
                self.tag.append(page.tag[e])
                self.inside.append(self.inside[key[0]] or self.tag[key[0]] in ARTICLE)
            path[e] = at
        out = page.left_out()
        held = page.own(out)
        self.own = [held[e] for e, _, _ in page.blocks]
        self.near = self.inside[:]
        for e in range(1, len(page.tag)):
            if held[e] and held[page.parent[e]]:
                self.near[path[e]] = True
        self.of = [None if out[e] else path[e] for e, _, _ in page.blocks]
        size = len(self.up)
        self.chars, self.all_chars, self.puncts = [0] * size, [0] * size, [0] * size
        for p, (_, text, links) in zip(self.of, page.blocks):
            if p is not None:
                self.all_chars[p] += len(text)
                if links < len(text):
                    self.chars[p] += len(text) - links
                    self.puncts[p] += len(_PUNCT.findall(text))

    def fused(self) -> list[float]:
        """Length and punctuation as one score, 1 for the strongest path."""
        length = self.chars if any(self.chars) else self.all_chars  # a page of links alone
        most, marks = max(length), max(1, max(self.puncts))
        if not most:
            return [0.0] * len(length)
        raw = [n / most * (1 + k / marks) / 2 * (ARTICLE_FACTOR if i or t in ARTICLE else 1.0) for n, k, i, t in zip(length, self.puncts, self.inside, self.tag)]
        top = max(raw)
        return [x / top for x in raw]

    def smoothed(self, scores: list[float]) -> list[float]:
        """The best score that reaches each path along the tree."""
        best = scores[:]
        for p in range(len(best) - 1, 0, -1):
            tag = self.tag[p]
            keeps = OUT_OF_ARTICLE if tag in ARTICLE else INSIDE if self.near[p] else OUT_OF_TEXT if tag in TEXTUAL or tag in GROUPS else OUT_OF_OTHER
            best[self.up[p]] = max(best[self.up[p]], best[p] * keeps)
        for p in range(1, len(best)):
            tag = self.tag[p]
            keeps = INSIDE if self.near[p] else 1.0 if tag in TEXTUAL else INTO_GROUP if tag in GROUPS else INTO_OTHER
            best[p] = max(best[p], best[self.up[p]] * keeps)
        return [b * HEADLINE_FACTOR if t == "h1" else b for b, t in zip(best, self.tag)]


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by newlines. threshold: a path's least
    score, as a share of the strongest one's."""
    page = Page(source or "")
    table = PathTable(page)
    if all(p is None for p in table.of):
        return ""
    alone = table.fused()
    scores = table.smoothed(alone)
    one = any(table.own)
    chosen, firm = [], []
    for i, (p, (_, text, links)) in enumerate(zip(table.of, page.blocks)):
        if p is None:
            chosen.append(0)
            continue
        belongs = table.own[i] or table.inside[p]
        score = scores[p] if belongs or not one or table.tag[p] == "h1" else alone[p]
        linked = 2 * links > len(text)
        chosen.append(0 if score < threshold else 1 if belongs or not linked else 2)  # 2: only between content blocks
        if score >= threshold and not linked:
            firm.append(i)
    first, last = (firm[0], firm[-1]) if firm else (0, len(chosen))
    return "\n".join(text for i, (_, text, _) in enumerate(page.blocks) if chosen[i] == 1 or chosen[i] == 2 and first <= i <= last)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, ``keep`` columns, text, n_chars: one row per row of ``pages``.

    Page by page, no shuffle. Null or empty pages and pages without an article
    give an empty text; null ids and repeated rows keep their row; other
    columns aren't read.
    """
    src = only(pages, id_col, html_col, *keep)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != html_col)

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, *keep, "text", "n_chars"])

    return src.mapInArrow(run, f"{head}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
