"""Main text of web pages, without what a site repeats.

A page is read into a tree of elements; every element's subtree has a hash of its tag, names and text. Spark counts, per
host and per section of it (the first folder of the path), on how many different pages a subtree stands (pages of one content count once).
Subtrees that recur on at least ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's or the section's pages are template and are deleted. Independently of that, elements that by
their tag, role or names are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are left out.
A name alone never drops what the page is about: an element that holds most of the articles' prose (on a page without ``article``, of ``main``'s, else of
the page's) stays whatever its class or id says, as ``has-sidebar`` or ``notice-board`` may; one named for comments stays only if it holds all articles.

The whole page is read. Where it marks its article (``article``, else ``main``), headings, paragraphs and quotations inside stay
even if they recur: a sentence that many articles share is text, not template. Outside, recurring ones go like any subtree.

A host or section has at most (subtrees per page / ``LEAST_SHARE``) template hashes. They are broadcast if all hosts' hashes
together are under ``BROADCAST_HASHES``; else they are joined by host and by section, where the adaptive plan splits a large one.

Cases: a null or empty html gives an empty text; a null url has no host and no template; repeated rows count once and repeat their result;
an empty table gives no rows; cut-off and unbalanced markup is closed at the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwalk.llm.common import cut
from blockwalk.ship import ship

LEAST_PAGES = 5
LEAST_SHARE = 0.05
BROADCAST_HASHES = 200_000

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES = {  # an opening tag ends these open elements, up to the elements that hold them
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
SPACED = frozenset({"br", "td", "th"})
RAW = "script style noscript template iframe noembed noframes xmp textarea"

# What is left out.
DROPPED_TAGS = frozenset("head title nav footer aside form button select dialog menu search svg canvas object audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu submenu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar comment comments commentlist disqus respond replies "
    "share sharing social related recommended recommendations trending skip".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies".split())
ROOTS = frozenset({"html", "body", "main"})
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption b i em strong a span u s small code q cite sub sup mark abbr time".split())

_ATTRS = r"""(?:(?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|</([a-z][^\s>/]*)[^>]*>|<([a-z][^\s>/]*)({_ATTRS})>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z|([^<]+|<)", re.I | re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """``dropped`` by its tag, role or hiding, ``named`` for what is left out (twice for comments). ``prose`` counts the characters outside links in what is not
    dropped: all, those inside ``main``, those inside articles; ``articles`` the articles that are not comments."""

    __slots__ = ("articles", "attrs", "digest", "dropped", "kids", "named", "prose", "tag")

    def __init__(self, tag: str, attrs: str = "", article: bool = False):
        self.tag, self.kids, self.digest, self.prose, self.articles, self.named = tag, [], 0, (0, 0, 0), 0, 0
        self.attrs = " ".join(attrs.split())
        self.dropped = self._dropped(attrs, article)

    def _dropped(self, attrs: str, article: bool) -> bool:
        """Also notes whether the element's names speak against it."""
        tag = self.tag
        if tag in DROPPED_TAGS or tag == "header" and not article:
            return True
        if not attrs:
            return False
        names, named = set(), set()
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names.update(_NAME.findall(value.lower()), _NAME.findall(_CAMEL.sub("-", value).lower()))
            elif key == "role":
                named.update(value.lower().split())
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return tag not in ROOTS
        if tag in ROOTS:
            return False
        if tag == "article":
            return bool(named & DROPPED_ROLES or names & COMMENT_NAMES)
        self.named = 2 if names & COMMENT_NAMES else 1 if names & DROPPED_NAMES else 0
        return bool(named & DROPPED_ROLES)

    def close(self) -> None:
        if not self.dropped and self.tag != "a":
            own = sum(len(k) for k in self.kids if isinstance(k, str) and not k.isspace())
            every, main, article = (sum(k.prose[i] for k in self.kids if not isinstance(k, str)) for i in range(3))
            every += own
            self.prose = (every, every if self.tag == "main" else main, every if self.tag == "article" else article)
            self.articles = sum(k.articles for k in self.kids if not isinstance(k, str)) + (self.tag == "article")
        parts = [self.tag, self.attrs] + [k if isinstance(k, str) else f"\0{k.digest:x}" for k in self.kids]
        self.digest = xxhash.xxh3_64_intdigest("\1".join(parts)) - (1 << 63)


def parse(html: str) -> Element:
    """The tree of a page. Text is decoded, its white space not yet."""
    root = Element("#page")
    stack = [root]
    articles = 0

    def leave(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            gone = stack.pop()
            articles -= gone.tag in ("article", "main")
            gone.close()

    for m in _TOKEN.finditer(html):
        _, end, start, attrs, text = m.groups()
        if text is not None:
            kids = stack[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += entities.unescape(text)
            else:
                kids.append(entities.unescape(text))
        elif start is not None:
            tag = start.lower()
            if tag in CLOSES:
                ended, holders = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ended:
                        leave(i)
                    elif stack[i].tag in holders:
                        break
            elif tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        leave(i)
                        break
                    if stack[i].tag in BLOCKS:
                        break
            new = Element(tag, attrs, articles > 0)
            stack[-1].kids.append(new)
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
                new.close()
            else:
                stack.append(new)
                articles += tag in ("article", "main")
        elif end is not None:
            tag = end.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in BLOCKS:
                    break  # a stray end tag inside does not end what holds it
    leave(0)
    return settle(root)


def settle(page: Element) -> Element:
    """Named elements go, but for those that hold most of the prose the page is about, and, if named for comments, all of its articles."""
    kind = 2 if page.prose[2] else 1 if page.prose[1] else 0
    todo = [page]
    while todo:
        at = todo.pop()
        if at.dropped:
            continue
        if at.named:
            most = 2 * at.prose[kind] > page.prose[kind] if kind or at.named == 1 else False
            at.dropped = not (most and (at.named == 1 or at.articles == page.articles))
        todo += [k for k in at.kids if not isinstance(k, str)]
    return page


def subtrees(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        for kid in todo.pop().kids:
            if not isinstance(kid, str):
                yield kid
                todo.append(kid)


def _holder(page: Element) -> str:
    """The element that holds the page's article: ``article`` if any is read, else ``main``."""
    todo = [page]
    while todo:
        at = todo.pop()
        if not at.dropped:
            if at.tag == "article":
                return "article"
            todo += [k for k in at.kids if not isinstance(k, str)]
    return "main"


def main_text(page: Element, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks in page order, joined by an empty line."""
    holder = _holder(page)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    todo: list[tuple[Element | str | None, bool]] = [(page, False)]
    while todo:
        at, inside = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            line.append(at)
        elif at.tag in SPACED:
            line.append(" ")
            todo += [(k, inside) for k in reversed(at.kids)]
        else:
            first = at.tag == holder and not inside
            if at.dropped or at.digest in template and not first and not (inside and at.tag in PROSE):
                continue
            if at.tag in BLOCKS:
                flush()
                todo.append((None, False))
            todo += [(k, inside or first) for k in reversed(at.kids)]
    flush()
    return "\n\n".join(blocks)


def _pages(pages: DataFrame) -> DataFrame:
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    folder = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^/?#]+)/", 1)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.nullif(host, F.lit("")).alias("host"),
                        F.when((host != "") & (folder != ""), F.concat(host, folder)).alias("section"))


def templates(pages: DataFrame) -> DataFrame:
    """(site, hashes): the subtrees that recur on a host or in a section. ``pages`` has the columns of ``_pages``."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, section, html in zip(batch["host"], batch["section"], batch["html"], strict=True):
                page = parse(html)
                found = {e.digest for e in subtrees(page)} | {0}
                out += [(site, page.digest, d) for site in (host, section) if site is not None for d in found]
            yield pd.DataFrame(out, columns=["site", "page", "subtree"])

    rows = pages.where("host IS NOT NULL").mapInPandas(hashes, "site string, page long, subtree long").distinct()
    counts = cut(rows.groupBy("site", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_PAGES) | (F.col("subtree") == 0)))
    total = counts.where("subtree = 0").select("site", F.col("n").alias("pages"))  # 0 stands for the page itself
    return counts.where("subtree <> 0").join(total, "site").where(F.col("n") >= F.col("pages") * LEAST_SHARE) \
        .groupBy("site").agg(F.collect_list("subtree").alias("hashes"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    rows = _pages(pages)
    found = cut(templates(rows))
    size = found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    small = size <= BROADCAST_HASHES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(parse(h), {d for t in both if t is not None for d in t})
                    for h, *both in zip(batch["html"], batch["of_host"], batch["of_section"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    of = lambda column: found.select(F.col("site").alias(column), F.col("hashes").alias(f"of_{column}"))
    return rows.join(F.broadcast(of("host")) if small else of("host"), "host", "left") \
        .join(F.broadcast(of("section")) if small else of("section"), "section", "left").select("page_id", "url", "html", "of_host", "of_section") \
        .mapInPandas(read, "page_id long, url string, text string, n_chars long")
