"""Main text of web pages, by structure and by removing what recurs across a host's pages.

Each page is read once into text blocks and the element subtrees that hold them, as hashes with the first and last block.
Spark counts each subtree hash over the different articles of its host, and blocks inside subtrees
that recur in many of them are deleted; tags and classes judge only what is left. The rest decides where the main text lies: in
articles, else in the main element, else in the body.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import split_join, staged

#: Elements that never hold article text.
DROPPED = frozenset("head script style noscript template nav aside form button select option input textarea label iframe object embed svg canvas audio video map menu dialog footer math".split())
#: Words of class, id and role attributes that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "share sharing social sidebar widget widgets related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar login signup search "
    "comment comments reply replies respond disqus footer copyright contentinfo complementary skip hidden".split()
)
#: Such words that count outside an article only: an article has a header of its own.
OUTSIDE = frozenset("header masthead topbar".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Text blocks of an article are its own words even where they recur; only what groups them may be a template there.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th tr dt dd figcaption caption".split())
#: A start tag ends open elements of these kinds, up to the nearest element of the second kind.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: A subtree is a template where it recurs in so many different articles of a host, however large the host; inside an
#: article also in this share of them.
LEAST_PAGES, LEAST_SHARE = 8, 0.1

TOKEN = re.compile(
    r"""<!--(?>.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^'">])*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")


def marked(attributes: str, in_article: bool) -> bool:
    """Whether attributes mark a part that is no article text."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and not m[2]:
            return True
        if name == "aria-hidden":
            if value == "true":
                return True
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name in ("class", "id", "role"):
            words = set(WORD.findall(value))
            if words & MARKS or not in_article and words & OUTSIDE:
                return True
    return False


class Element:
    __slots__ = ("tag", "dropped", "article", "main", "parts", "template", "first", "quiet")

    def __init__(self, tag: str, dropped: bool, article: bool, main: bool, template: bool, first: int, quiet: bool = False):
        self.tag, self.dropped, self.article, self.main, self.template, self.first, self.quiet = tag, dropped, article, main, template, first, quiet
        self.parts: list[bytes] = []


def blocks(page: str) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int, int]]]:
    """(text, rank, marked) of each text block in page order, and (hash, first block, block after the last) of each subtree that may be a template.

    The rank is 2 in an article, 1 in a main element, else 0; marked are blocks inside elements that tags or attributes set apart. Hashes of
    subtrees inside an article are even, others odd. What is set apart has subtrees of its own but counts in those around it by its tag only, so
    that a token in a form does not make a template look new. Each element is opened and closed once: deep nesting costs no more than its length.
    """
    found: list[tuple[str, int, bool]] = []
    subtrees: list[tuple[int, int, int]] = []
    stack = [Element("", False, False, False, False, 0)]
    opened: Counter[str] = Counter()
    text: list[str] = []
    mark = False

    def start(tag: str, dropped: bool, article: bool, template: bool, quiet: bool = False) -> None:
        stack.append(Element(tag, dropped, article, stack[-1].main or tag == "main", template, len(found), quiet))
        opened[tag] += 1

    def add(piece: str) -> None:
        nonlocal mark
        # what an inline element hides is no block of its own: the text around it stays one
        if not stack[-1].quiet:
            text.append(html.unescape(piece) if "&" in piece else piece)
            mark = stack[-1].dropped

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                at = stack[-1]
                found.append((words, 2 if at.article else int(at.main), mark))
                at.parts.append(words.encode())

    def close() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        above = stack[-1]
        own = xxhash.xxh64_intdigest(element.tag.encode() + b"<" + b"<".join(element.parts))
        own -= (own >> 63) << 64
        above.parts.append(element.tag.encode() if element.dropped and not above.dropped else own.to_bytes(8, "little", signed=True))
        if element.template and len(found) > element.first:
            subtrees.append((own & ~1 if element.article else own | 1, element.first, len(found)))

    at, raw = 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        tag = m[2] or m[5]
        if raw:
            if not (tag and (m[1] or m[4]) and tag.lower() == raw):
                continue
            raw = None
        elif m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE and not ends and tag != "img":
            # inline elements matter only where they are marked as no text
            if attributes and not stack[-1].dropped and marked(attributes, stack[-1].article):
                start(tag, True, stack[-1].article, False, True)
            elif stack[-1].dropped and stack[-1].tag == tag:
                start(tag, True, stack[-1].article, False, stack[-1].quiet)
            continue
        if ends:
            if tag in INLINE:
                if stack[-1].tag == tag:
                    stack.pop()
                    opened[tag] -= 1
                continue
            flush()
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag not in RAW:
            while stack[-1].tag == "p" or stack[-1].tag in INLINE and stack[-1].tag:
                close()
            kinds, limit = IMPLIED.get(tag, ((), ()))
            if any(opened[k] for k in kinds):
                depth = len(stack) - 1
                while depth and stack[depth].tag not in limit and stack[depth].tag not in kinds:
                    depth -= 1
                if depth and stack[depth].tag in kinds:
                    while len(stack) > depth:
                        close()
        above = stack[-1]
        article = above.article or tag == "article"
        dropped = above.dropped or tag in DROPPED or tag == "header" and not above.article or bool(attributes) and marked(attributes, above.article)
        template = tag not in ("html", "body", "main", "article") and not (article and tag in TEXT)
        start(tag, dropped, article and not dropped, template)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            raw = tag
    if not raw and at < len(page):
        add(page[at:])
    flush()
    while len(stack) > 1:
        close()
    return found, subtrees


def best(found: list[tuple[str, int, bool]], gone: list[bool] | None = None, marks: bool = True) -> list[str]:
    """Texts of the highest rank there is among blocks that are not gone, nor marked (with marks)."""
    left = [(words, rank) for n, (words, rank, marked_) in enumerate(found) if not (gone and gone[n]) and not (marks and marked_)]
    top = max((rank for _, rank in left), default=0)
    return [words for words, rank in left if rank == top]


def covered(blocks_: int, subtrees: list[tuple[int, int, int]], removed: set[int]) -> list[bool]:
    """Whether each block lies in a removed subtree: starts and ends are counted once, then summed along the page."""
    steps = [0] * (blocks_ + 1)
    for own, first, last in subtrees:
        if own in removed:
            steps[first] += 1
            steps[last] -= 1
    return [x > 0 for x in accumulate(steps[:blocks_])]


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, marks: bool = True
) -> DataFrame:
    """(id, url, text, n_chars, n_template, n_marked) for each row of pages.

    Subtrees of all elements, whatever their tags and classes, are counted over the different articles of their host; first go those that recur
    in at least least_pages of them (inside an article also in least_share of them): n_template blocks. Of what recurrence left, the
    blocks go that elements or attributes mark as something else: n_marked; this is for hosts with few pages and for what never recurs, such as
    readers' comments, and off with marks=False. Of what is left the text is that of the page's articles, else its main
    element, else its body. Pages with equal text count as one, so that copies of a page are no template. Inside an article, paragraphs,
    headings, list items and cells stay even where they recur.

    Null and empty pages have an empty text. Null URLs are a host of their own. Rows that repeat an id each get a row; an empty
    table gives no rows; other columns are not read.
    """

    def numbered(found: list[tuple[str, int, bool]], around: list[tuple[int, int, int]]) -> tuple[list, list]:
        # subtrees by their place among the page's different ones; of marked blocks that cannot stay only the places are kept
        place = {h: n for n, h in enumerate(dict.fromkeys(h for h, _, _ in around))}
        return [("" if marks and m else t, r, int(m)) for t, r, m in found], [(place[h], a, b) for h, a, b in around]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(9)
        for pdf in batches:
            read = [blocks(page) if page else ([], []) for page in pdf["html"]]
            yield pd.DataFrame({
                "row": pdf["row"], "id": pdf["id"].astype(object), "url": pdf["url"].astype(object), "host": pdf["host"].astype(object),
                "content": [xxhash.xxh64_intdigest("\n".join(best(found))) - (1 << 63) for found, _ in read],
                "subtrees": [list(dict.fromkeys(h for h, _, _ in around)) for _, around in read],
                "packed": [packer.compress(json.dumps(numbered(*page), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")) for page in read],
            })

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for i, url, packed, removed in pdf.itertuples(index=False):
                found, around = json.loads(packer.decompress(packed).decode("utf-8", "surrogatepass"))
                gone = covered(len(found), around, set() if removed is None else set(map(int, removed)))
                text = "\n".join(best(found, gone, marks))
                rows.append((i, url, text, len(text), sum(gone), sum(m and not g for g, (_, _, m) in zip(gone, found)) if marks else 0))
            yield pd.DataFrame(rows, columns=["id", "url", "text", "n_chars", "n_template", "n_marked"]).astype({"id": object, "url": object, "text": object})

    host = F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").cast("string").alias("id"), F.col(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).alias("html"))
    schema = "row long, id string, url string, host string, content long, subtrees array<long>, packed binary"
    read = staged(rows.mapInPandas(run, schema), "page-blocks")
    inside = read.select("row", "host", "content", F.posexplode("subtrees").alias("place", "subtree"))
    inside = inside.withColumn("key", F.xxhash64("host", "subtree"))
    counts = inside.groupBy("host", "key", "content").agg(F.count("*").alias("rows"), F.first(F.col("subtree").bitwiseAND(1)).alias("outside"))
    counts = counts.groupBy("host", "key").agg(F.count("*").alias("articles"), F.sum("rows").alias("rows"), F.max("outside").alias("outside"))
    hosts = read.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_articles"))
    recurring = counts.filter(F.col("articles") >= least_pages).join(hosts, "host").filter((F.col("outside") == 1) | (F.col("articles") >= least_share * F.col("host_articles")))
    recurring = staged(recurring.groupBy("key").agg(F.sum("rows").alias("rows")), "templates")
    found = split_join(inside.select("row", "place", "key"), recurring.select("key", "rows"), "key", "rows", read.count(), F.col("row"))
    removed = staged(found.filter("rows is not null").groupBy("row").agg(F.collect_set("place").alias("removed")), "removed")
    # a page's blocks travel once, packed, and by the same plan at every size
    whole = read.select("row", "id", "url", "packed").join(removed.hint("merge"), "row", "left").select("id", "url", "packed", "removed")
    done = whole.mapInPandas(finish, "id string, url string, text string, n_chars long, n_template long, n_marked long")
    # ids pass pandas as text: as numbers, a null among them would round large ones
    return done.withColumn("id", F.col("id").cast("long")).withColumnsRenamed({"id": id_col, "url": url_col})
