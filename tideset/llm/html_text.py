"""Main text of web pages by removal of site templates.

Each page is read into elements, and every block element gets a hash of all that it holds, built bottom-up from those of the elements in it.
Blocks that hold links only, or little text and are no part of an article by their tag, role, class or place, get a second hash, their outline: the same
without the text, runs of equal children counted as one. So menus, adverts and footers that are drawn anew for each page recur too. Spark counts these hashes per host, and subtrees that recur on many pages of a host (`min_pages`, and a share of `min_share` of its pages) are
deleted as its template. Pages are told apart by their longest block, but for blocks that stand on most of the host's pages: copies of one article
count once, though their titles, links or scripts differ, so an article is no template of a host that copies it. Running text of an article (paragraphs, headings, lists)
is never taken for a template, however often it recurs, and a page that is nothing but templates keeps them.

Only what these counts leave undecided is judged by lists: blocks with too much text for an outline, and outlines on too few pages. Of these, elements that are
never part of an article (menus, forms, scripts, comments of readers and so on) go by tag, role or class (`by_name`), and where what is left lies in part in an
`article` or `main` element, that part is taken (`by_article`).

Reading takes time in proportion to the page: nothing is read twice, and elements deeper than 512 levels become siblings, as in browsers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, small
from .urls import split_url

# Tags and class names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hgroup address html body article main".split())
_NEVER = frozenset("head script style title template noscript nav aside footer form button select textarea iframe object svg canvas dialog menu input noembed noframes xmp datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HINTS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside footer ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search pagination pager skip toolbar widget".split())
_TALK = frozenset("comment comments disqus respond reply replies".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_HEAD_HINTS = frozenset("header masthead topbar".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select datalist"), "body": ("head", "html")}
_UNSEEN = frozenset("head script style title template noscript iframe object svg canvas noembed noframes".split())
DEPTH, SALTS = 512, 16
LITTLE = 256  # characters outside of links, below which a block has an outline
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}

_MARKUP = re.compile(r"<(?:!--|[!?]|/[a-zA-Z]|[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


@dataclass
class Page:
    """Elements in page order: parent, tag, class and id, words of these that tell, role, whether hidden, hash (None: no text in it, or no block), outline, length of
    its own text without that of blocks in it, length of all text in it that is in no link.

    `flow` holds (element, text), and None for a block's edge.
    """

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    marks: list[frozenset[str]] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    hash: list[int | None] = field(default_factory=list)
    outline: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    loose: list[int] = field(default_factory=list)
    flow: list[tuple[int, str | None]] = field(default_factory=list)


def _marks(classes: str, id_: str) -> frozenset[str]:
    """The words of a class, and of an id that is made of nothing but words that tell (headings bear ids made of their own words)."""
    own = _NAMES.findall(id_)
    return frozenset(_NAMES.findall(classes)) | (frozenset(own) if own and all(w in _HINTS or w in _HEAD_HINTS for w in own) else frozenset())


def _digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Reader:
    """Reads a page. Missing end tags are implied as browsers do for paragraphs, list items and tables; stray end tags are ignored."""

    def __init__(self, text: str):
        self.text, self.page, self.stack, self.open = text, Page(), [], Counter()
        self.parts: list[list[str]] = []  # of each open element, what its hash is made of
        self.drawn: list[list[str]] = []  # and its outline
        self.full: list[bool] = []  # whether it holds text
        self.plain = False  # after an attribute that does not end, tags end at the next > whatever their quotes
        self.lacking: set[str] = set()  # quotes of which no more follow

    def words(self, text: str) -> None:
        self.page.flow.append((self.stack[-1] if self.stack else -1, text))
        if self.stack:
            inner = " ".join(text.split())
            if inner:
                self.parts[-1].append(inner)
                self.draw("~")
                self.full[-1] = True
                self.page.size[self.stack[-1]] += len(inner)
                if not self.open["a"]:
                    self.page.loose[self.stack[-1]] += len(inner)

    def draw(self, part: str) -> None:
        if not self.drawn[-1] or self.drawn[-1][-1] != part:
            self.drawn[-1].append(part)

    def close(self, depth: int) -> None:
        page, flow = self.page, self.page.flow
        while len(self.stack) > depth:
            x, parts, drawn, full = self.stack.pop(), self.parts.pop(), self.drawn.pop(), self.full.pop()
            tag = page.tag[x]
            self.open[tag] -= 1
            if tag in _BLOCK:
                flow.append((x, None))
            digest = _digest(tag, page.names[x], *parts)
            page.outline[x] = _digest("~", tag, page.names[x], *drawn)
            if full and tag in _BLOCK:
                page.hash[x] = digest
            if self.stack:
                if tag not in _BLOCK and tag not in _UNSEEN:
                    page.size[self.stack[-1]] += page.size[x]
                if tag not in _UNSEEN:
                    page.loose[self.stack[-1]] += page.loose[x]
                    self.draw(f"\x1e{page.outline[x]}")
                self.parts[-1].append(f"\x1e{digest}")
                self.full[-1] = self.full[-1] or full

    def implied(self, ends: frozenset, barrier: frozenset) -> None:
        if any(self.open[e] for e in ends):
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.page.tag[self.stack[depth]]
                if name in ends:
                    self.close(depth)
                    return
                if name in barrier:
                    return

    def ended(self, name: str) -> None:
        if self.open[name]:
            block = name in _BLOCK
            for depth in range(len(self.stack) - 1, -1, -1):
                other = self.page.tag[self.stack[depth]]
                if other == name:
                    self.close(depth)
                    return
                if not block and other in _BLOCK:
                    return

    def tag_end(self, at: int) -> int:
        """Where the tag that goes on at `at` ends, its > included; -1 if it does not."""
        text, begin = self.text, at
        while not self.plain:
            m = _STOP.search(text, at)
            if m is None:
                self.plain = True
            elif m[1] is None:
                return m.end()
            elif m[1] in self.lacking:
                at = m.end()
            else:
                found = text.find(m[1], m.end())
                if found < 0:
                    self.lacking.add(m[1])
                at = found + 1 if found >= 0 else m.end()
        return text.find(">", begin) + 1 or -1

    def element(self, name: str, attributes: str) -> bool:
        """Opens an element; whether it can hold others or text."""
        page = self.page
        if name in _BLOCK:
            self.implied(_PARAGRAPH, _HOLDS)
        if name in _CLOSES:
            self.implied(*_CLOSES[name])
        if len(self.stack) >= DEPTH:
            self.close(DEPTH - 1)
        x, classes, id_, role, hidden = len(page.tag), "", "", "", False
        if attributes and not attributes.isspace():
            for a, b, c, d in _ATTRIBUTE.findall(attributes):
                a, value = a.lower(), (b or c or d).lower()
                if a == "class":
                    classes = f"{classes} {value}"
                elif a == "id":
                    id_ = value
                elif a == "role":
                    role = value.strip()
                elif a == "hidden" or a == "aria-hidden" and value == "true":
                    hidden = True
        page.parent.append(self.stack[-1] if self.stack else -1)
        page.tag.append(name)
        page.names.append(f"{classes} {id_}")
        page.marks.append(_marks(classes, id_) if classes or id_ else frozenset())
        page.role.append(role)
        page.hidden.append(hidden)
        page.hash.append(None)
        page.outline.append(0)
        page.size.append(0)
        page.loose.append(0)
        if name in _BLOCK:
            page.flow.append((x, None))
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK and name not in _RAW and not _ATTRIBUTE.search(attributes):
            if self.stack:
                self.parts[-1].append(f"\x1e{name}")
            return False
        self.stack.append(x)
        self.parts.append([])
        self.drawn.append([])
        self.full.append(False)
        self.open[name] += 1
        return True

    def read(self) -> Page:
        text, at = self.text, 0
        while m := _MARKUP.search(text, at):
            kind = m[0]
            if kind == "<!--":
                end = text.find("-->", m.end()) + 3
                end = end if end > 2 else len(text)
            elif kind in ("<!", "<?"):
                end = text.find(">", m.end()) + 1 or len(text)
            else:
                closing = kind[1] == "/"
                name = _NAME.match(text, m.start() + 1 + closing)
                end = (text.find(">", name.end()) + 1 or -1) if closing else self.tag_end(name.end())
                if end < 0:
                    break  # no > follows any more: the rest is text
            if m.start() > at:
                self.words(text[at : m.start()])
            at = end
            if kind[1] in "!?":
                continue
            tag = name[0].lower()
            if closing:
                self.ended(tag)
            elif tag == "br":
                self.page.flow.append((self.stack[-1] if self.stack else -1, " "))
            elif self.element(tag, text[name.end() : end - 1]) and tag in _RAW:
                m = _END[tag].search(text, at)
                stop = m.start() if m else len(text)
                if stop > at:
                    self.words(text[at:stop])
                at = stop
                self.close(len(self.stack) - 1)
        if at < len(text):
            self.words(text[at:])
        self.close(0)
        return self.page


_PARAGRAPH, _HOLDS = frozenset(("p",)), frozenset("table td th caption button object body article section div".split())


def read(text: str) -> Page:
    return _Reader(text).read()


def roles(page: Page, by_name: bool = True) -> tuple[list[bool], list[bool]]:
    """For each element, whether it lies in the article, and whether it is never part of one. Names don't tell against what holds the page's first article."""
    inside, never, holds = [], [], set()
    for x, tag in enumerate(page.tag):
        if tag in ("article", "main") or page.role[x] == "main":
            chain = []
            while x >= 0:
                chain.append(x)
                x = page.parent[x]
            if all(_TALK.isdisjoint(page.marks[y]) for y in chain):
                holds.update(chain)
                break
    for x, tag in enumerate(page.tag):
        p = page.parent[x]
        own = p >= 0 and inside[p]
        gone = p >= 0 and never[p]
        if not gone:
            found = frozenset() if tag in ("html", "body", "main") or own and tag in _TEXT else page.marks[x]
            gone = tag in _NEVER or page.hidden[x] or page.role[x] in _ROLES or not found.isdisjoint(_HINTS) or not own and (tag == "header" or not found.isdisjoint(_HEAD_HINTS))
            gone = gone and (x not in holds or page.hidden[x]) if by_name else tag in _UNSEEN
        never.append(gone)
        inside.append(own or not gone and (tag in ("article", "main") or page.role[x] in ("main", "article")))
    return inside, never


def subtrees(page: Page, inside: list[bool]) -> dict[int, int]:
    """Hashes of the elements that may belong to a template: tag, class and id, and all tags and text below."""
    return {x: h for x, h in enumerate(page.hash) if h is not None and page.tag[x] not in ("html", "body", "head") and not (inside[x] and page.tag[x] in _PROSE)}


def outlines(page: Page, inside: list[bool], never: list[bool], by_article: bool = True) -> dict[int, int]:
    """Outlines of the elements that may belong to a template drawn anew for each page: all their text is in links, or there is little of it and it is
    beside the page's article or in what is never part of one. What lies in an article or holds one has none."""
    holds: set[int] = set()
    for x, own in enumerate(inside):
        p = page.parent[x]
        if own and (p < 0 or not inside[p]):
            while p >= 0 and p not in holds:
                holds.add(p)
                p = page.parent[p]
    beside = by_article and any(inside)
    return {x: page.outline[x] for x, h in enumerate(page.hash) if h is not None and not inside[x] and x not in holds and page.tag[x] not in ("html", "body", "head") and page.loose[x] < LITTLE and (beside or never[x] or not page.loose[x])}


def _blocks(page: Page, taken) -> list[str]:
    """The text of the blocks, of the elements that `taken` takes (-1: of none)."""
    found, parts = [], []
    for x, text in page.flow:
        if text is None:
            if parts:
                found.append("".join(parts))
                parts = []
        elif taken(x):
            parts.append(html.unescape(text))
    found.append("".join(parts))
    return [b for b in (" ".join(b.split()) for b in found) if b]


def main_text(page: Page, templates: set[int], undecided: set[int] | None = None, by_name: bool = True, by_article: bool = True) -> str:
    """What is left without templates and without what lists tell of the rest: the article's blocks, or without an element for it all of them.

    `templates` holds hashes of subtrees and outlines. Lists judge what has no outline, and outlines in `undecided` (None: all).
    """
    inside, never = roles(page, by_name)
    drawn = outlines(page, inside, never, by_article)

    def left(templates: set[int], undecided: set[int] | None) -> list[str]:
        whole = subtrees(page, inside) if templates else {}
        gone, unseen, decided = [], [], []
        for x, p in enumerate(page.parent):
            unseen.append(page.tag[x] in _UNSEEN or p >= 0 and unseen[p])
            decided.append(p >= 0 and decided[p] or undecided is not None and x in drawn and drawn[x] not in undecided)
            gone.append(p >= 0 and gone[p] or unseen[x] or never[x] and not decided[x] or whole.get(x) in templates or drawn.get(x) in templates)
        own = by_article and _blocks(page, lambda x: x >= 0 and inside[x] and not gone[x])
        return _blocks(page, lambda x: x < 0 and not own or x >= 0 and not gone[x] and (not own or inside[x] or decided[x]))

    return "\n\n".join(left(templates, undecided) or left(set(), None))


def _hashes(by_name: bool, by_article: bool):
    def run(batches):
        import pyarrow as pa

        for part in sliced(batches):
            found = []
            for text in part.column("html").to_pylist():
                page = read(text)
                sizes: dict[int, int] = {}
                inside, never = roles(page, by_name)
                for x, h in subtrees(page, inside).items():
                    sizes[h] = max(sizes.get(h, 0), page.size[x])
                drawn = sorted(set(outlines(page, inside, never, by_article).values()))
                found.append([{"subtree": h, "size": n, "outline": False} for h, n in sorted(sizes.items())] + [{"subtree": h, "size": 0, "outline": True} for h in drawn])
            kinds = pa.list_(pa.struct([("subtree", pa.int64()), ("size", pa.int32()), ("outline", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("h"), pa.array(found, kinds)], ["host", "h", "found"])

    return run


def _texts(by_name: bool, by_article: bool):
    def run(batches):
        import pyarrow as pa

        for part in sliced(batches):
            held = zip(part.column("html").to_pylist(), part.column("templates").to_pylist(), part.column("undecided").to_pylist(), strict=True)
            out = [main_text(read(text), set(t or ()), set(u or ()), by_name, by_article) for text, t, u in held]
            yield pa.RecordBatch.from_arrays([part.column("page"), part.column("url"), pa.array(out, pa.string())], ["page", "url", "text"])

    return run


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.001, by_name: bool = True, by_article: bool = True) -> DataFrame:
    """One row (page_col, url_col, text, n_chars) for each row of `pages`.

    Blocks of the text are joined by two line breaks; within one, white space is a single space and character references are decoded.
    With neither `by_name` nor `by_article` only counts per host tell what is not part of a text, but for scripts and other elements that aren't shown; outlines then
    are those of blocks that hold links only.

    Defined cases: null or empty HTML gives an empty text. Pages with a null URL, or one without `://`, share the empty host. Pages with equal
    host and HTML count once and get equal texts; ids may repeat or be null. Where a tag or comment does not end, the rest of the page is text or comment;
    elements below 512 levels become siblings, their text stays. Other columns are ignored; an empty table gives no rows.
    """
    host = split_url(url_col)[0]
    source = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    source = source.withColumn("h", F.xxhash64("html"))
    read_ = cut(source.select("host", "h", "html").mapInArrow(_hashes(by_name, by_article), "host string, h long, found array<struct<subtree:long,size:int,outline:boolean>>").distinct())
    found = read_.select("host", "h", F.inline("found")).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    often = found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = cut(often.join(small(cut(read_.groupBy("host").agg(F.count("*").alias("pages")))), "host"))

    # a menu that stands on every page of a large host is one key, so both sides of these joins are salted
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    at = ["host", "subtree", "salt"]
    everywhere = cut(often.where("2 * n > pages").select("host", "subtree", salts.alias("salt")))
    told_apart = found.where("size > 0").join(small(everywhere), at, "left_anti").groupBy("host", "h").agg(F.max(F.struct("size", "subtree")).alias("key"))
    met = cut(found.select("h", *at).join(small(cut(often.select("host", "subtree", salts.alias("salt")))), at))
    counts = met.join(cut(told_apart), ["host", "h"], "left").select("host", "subtree", F.coalesce("key.subtree", "h").alias("key")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * min_share))
    templates = (counts.join(often.select("host", "subtree", "pages"), ["host", "subtree"]).where(F.col("n") >= least).select("host", "subtree", salts.alias("salt")))
    judged = found.join(small(cut(templates.withColumn("often", F.lit(True)))), at, "left").where("often OR outline")
    matched = cut(judged.groupBy("host", "h").agg(F.collect_set(F.when(F.col("often"), F.col("subtree"))).alias("templates"), F.collect_set(F.when(F.col("often").isNull(), F.col("subtree"))).alias("undecided")))
    told = source.join(small(matched), ["host", "h"], "left").select("page", "url", "html", "templates", "undecided")
    kinds = pages.schema
    done = told.mapInArrow(_texts(by_name, by_article), f"page {kinds[page_col].dataType.simpleString()}, url {kinds[url_col].dataType.simpleString()}, text string")
    return done.select(F.col("page").alias(page_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
