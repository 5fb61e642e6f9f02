"""Main text of web pages: recurring subtrees of a host are counted in Spark and deleted."""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import TEXTS, Scratch, lean, table

#: A subtree is part of a host's template if it stands with so many different articles of the host and with
#: this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.02
#: Inside of a marked article the share must be this: a licence line or a passage that many articles of a
#: host share is their text (in the check tables some stand with an eighth of a host's articles).
SHARE_INSIDE = 0.5
#: A subtree with more than this share of a page's text is a template only from this share of the host's
#: articles on; with more than it of a marked article, never.
MOST, SHARE_OF_MOST = 0.5, 0.5
#: Outside of a marked article, lists and boxes whose text is links by more than this share go.
LINK_SHARE = 0.6
#: Up to so many template hashes go to every worker as arrays (8 MB); more are joined to the pages.
BROADCAST_HASHES = 500_000

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio object math".split()
)
CLOSES_P = BLOCKS - frozenset("button option optgroup select noscript".split())
DROPPED = frozenset("head nav aside footer form noscript template svg math button select dialog menu canvas video audio object search".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist status".split())
# Whole class names and ids, as a second voice beside the counts.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-container ad-banner sponsor sponsored promo promotion banner cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notification popup modal overlay newsletter newsletter-signup subscribe signup share social social-share share-buttons sharing related related-posts recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer site-footer comment comments comment-list comments-area disqus_thread replies respond login toolbar paywall hidden".split()
)
ARTICLE_WORDS = frozenset("hidden ad ads advert sponsored promo comment comments reply replies related recommended teaser".split())
# Words that a compound name may end in after one of them, and begin with so that it tells what a thing is not.
HOLDERS = frozenset("box block bar wrap wrapper container section area list panel unit slot inner outer item items link links button buttons group row".split())
DENIALS = frozenset("has with no without not non is allow".split())
HEADS = frozenset("header masthead topbar site-header".split())
ITEM_PARENTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ITEM_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}

# A quoted value may hold ">"; "<" outside of quotes ends the attempt, so that no stretch is read again and again.
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/><\"']*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


NAME_PARTS = re.compile("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=4096)
def word_of(name: str) -> str | None:
    """The word of ``WORDS`` that a compound class name or id comes to: its last part, as in user-comments or cookieBanner,
    or its first, if the others only hold something, as in promo-box."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if len(parts) < 2 or parts[0] in DENIALS:
        return None
    if parts[-1] in WORDS:
        return parts[-1]
    return parts[0] if parts[0] in WORDS and HOLDERS.issuperset(parts[1:]) else None


class Node:
    """A block element. What depends on its ancestors is told when it is opened, what depends on its subtree
    when it is closed, so no walk up or down is needed later."""

    __slots__ = ("tag", "parent", "marks", "role", "chars", "links", "digest", "hash", "nested", "shut")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.marks: set[str] = set()
        self.role = ""
        self.chars = self.links = self.hash = 0
        self.digest = xxhash.xxh3_64(tag)
        if attrs:
            for m in ATTR.finditer(attrs):
                name, own = m[1].lower(), m[2] or m[3] or m[4] or ""
                value = own.lower()
                if name in ("class", "id"):
                    self.marks.update(value.split())
                    if tag not in ("html", "body", "main", "article"):
                        self.marks.update(filter(None, map(word_of, own.split())))
                elif name == "role":
                    self.role = value.strip()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.marks.add("hidden")
        self.nested = parent is not None and (parent.nested or parent.tag == "article")
        self.shut = is_clutter(self, False) or parent is not None and parent.shut


def is_clutter(n: Node, in_article: bool) -> bool:
    """By what the page itself says of the element."""
    if n.tag in ("html", "body", "main", "#page"):
        return "hidden" in n.marks
    if n.tag == "article":  # of an article, only words that name a kind of article count
        return bool(n.marks & ARTICLE_WORDS)
    if n.tag in DROPPED or n.role in ROLES or n.marks & WORDS:
        return True
    return not in_article and (n.tag == "header" or n.role == "banner" or bool(n.marks & HEADS))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements and text blocks in page order. Inline tags vanish, a line break is white space,
    unclosed elements end where the next one of their kind or their parent does. Time is in proportion to
    the page's length, however deep or broken it is."""
    root = Node("#page", None, "")
    nodes, blocks, stack = [root], [], [root]
    places: dict[str, list[int]] = defaultdict(list)  # per element name, where it is open in the stack
    held: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                node = stack[-1]
                blocks.append((node, text))
                node.digest.update(text.encode("utf-8", "surrogatepass"))
                node.chars += len(text)
                node.links += min(linked, len(text))
        linked = 0

    def close(to: int) -> None:
        while len(stack) > to:
            n = stack.pop()
            n.hash = n.digest.intdigest() >> 1
            if stack:
                places[n.tag].pop()
                up = stack[-1]
                up.digest.update(n.hash.to_bytes(8, "little"))
                up.chars += n.chars
                up.links += n.links

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    at, bracket = 0, -1
    while True:
        if bracket < at:
            bracket = page.find(">", at)
        if bracket < 0:  # no tag ends any more; an open comment takes the rest
            bracket, m = len(page), None
            end = page.find("<!--", at)
            chunk = page[at:end] if end >= 0 else page[at:]
        else:
            m = TAG.search(page, at)
            chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            held.append(chunk)
            if in_link:
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        ending, tag, attrs = bool(m[1] or m[4]), name.lower(), m[3] or m[6] or ""
        if tag == "br" or tag == "hr":
            held.append(" ")
        elif tag in RAW and not ending:
            if tag == "textarea" or tag == "iframe":
                held.append(" ")
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif tag == "a":
            in_link = not ending
        elif tag in BLOCKS:
            flush()
            if ending:
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in ITEM_CLOSES:
                bound = last(ITEM_PARENTS[tag])
                while (k := last(ITEM_CLOSES[tag])) > bound:
                    close(k)
            if tag in CLOSES_P and places.get("p") and places["p"][-1] >= len(stack) - 2:
                close(places["p"][-1])
            if attrs.rstrip().endswith("/") and tag in ("svg", "canvas", "math", "object"):
                continue
            node = Node(tag, stack[-1], attrs)
            nodes.append(node)
            places[tag].append(len(stack))
            stack.append(node)
    flush()
    close(0)
    return nodes, blocks


def find_article(nodes: list[Node]) -> Node | None:
    """The marked article: the only one, or of several the main element, or the one with most text; of
    equals the first."""
    articles = [n for n in nodes if n.tag == "article" and n.chars and not n.nested and not n.marks & ARTICLE_WORDS]
    open_ = [n for n in articles if not n.shut] or articles
    if len(open_) == 1:
        return open_[0]
    mains = [n for n in nodes if (n.tag == "main" or n.role == "main") and n.chars]
    if mains:
        return max(mains, key=lambda n: n.chars)
    if open_:
        return max(open_, key=lambda n: n.chars)
    marked = [n for n in nodes if n.chars and n.tag in ("div", "section", "td") and n.marks & {"article", "content", "main", "post", "entry", "story"} and not n.marks & WORDS]
    best = max(marked, key=lambda n: n.chars, default=None)
    return best if best is not None and best.chars * 2 >= nodes[0].chars else None


def around(top: Node) -> set[int]:
    out = set()
    at: Node | None = top
    while at is not None:
        out.add(id(at))
        at = at.parent
    return out


def candidates(nodes: list[Node], article: Node | None) -> list[Node]:
    """Subtrees that may be a template: every block element with text, paragraphs and inner boxes included,
    but what holds the article or the whole page."""
    above = around(article or nodes[0])
    return [n for n in nodes if n.chars and id(n) not in above and n.tag not in ("html", "body")]


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host) >> 1


def template_key(host: str, node: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\\0{node.hash}") >> 1


def main_text(page: str | None, url: str | None, share_of) -> str:
    """Text of one page. ``share_of``: for a template key the share of the host's articles that it stands
    with, 0 if it is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    article = find_article(nodes)
    host = host_of(url)
    top = article or nodes[0]
    above = around(top)
    out = []
    stays: dict[int, bool] = {}
    inside = {id(top)}
    for n in nodes:  # an element comes after its parent
        if id(n) in above:
            stays[id(n)] = n is top or article is None
            continue
        if id(n.parent) in inside:
            inside.add(id(n))
        if not stays[id(n.parent)]:
            stays[id(n)] = False
            continue
        bad = is_clutter(n, article is not None)
        bad = bad or article is None and n.tag in ("ul", "ol", "div", "td", "section") and n.links > LINK_SHARE * n.chars
        if not bad and n.chars and n.tag not in ("html", "body"):
            share = share_of(template_key(host, n))
            if share:
                most = n.chars > MOST * top.chars
                bad = share >= SHARE_INSIDE and not most if article is not None else not most or share >= SHARE_OF_MOST
        stays[id(n)] = not bad
    for node, text in blocks:
        if stays[id(node)]:
            out.append(text)
    return " ".join(out)


def template_shares(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, share): subtrees that recur on their host, and the share of its different articles (without a
    marked one: pages) that they stand with. Copies of one article count once, so that mirrored pages are no
    template. Null and empty pages and pages without a host count for nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: set[tuple[int, int, int]] = set()
            for page, url in zip(b["html"], b["url"]):
                host = host_of(url)
                if page and host:
                    nodes, _ = parse(page)
                    article = find_article(nodes)
                    h, what = host_key(host), (article or nodes[0]).hash
                    found.add((h, 0, what))
                    found.update((h, template_key(host, x), what) for x in candidates(nodes, article))
            if found:
                yield pd.DataFrame(np.array(list(found), np.int64), columns=["host", "key", "what"])

    seen = pages.select("html", "url").mapInPandas(lean(run), "host bigint, key bigint, what bigint")
    # two steps of partial sums: a hot host's menu is never one task's
    counts = seen.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    many = scratch.put(counts.filter(F.col("n") >= MIN_PAGES), "counts", TEXTS)  # else pages are parsed for both of its uses
    sizes = many.filter(F.col("key") == 0).select("host", F.col("n").alias("articles"))
    share = (F.col("n") / F.col("articles")).alias("share")
    return many.filter(F.col("key") != 0).join(sizes, "host").select("key", share).filter(F.col("share") >= MIN_SHARE)


def extract(pages: DataFrame, scratch: Scratch, limit: int = BROADCAST_HASHES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    First the subtrees of block elements are hashed and counted per host; those that stand with at least
    ``MIN_PAGES`` different articles and ``MIN_SHARE`` of them (``SHARE_INSIDE`` within a marked article) are
    the host's template and are deleted. Of what is left, the marked article stays (without one: the page)
    less what its markup names as menu, header, footer, sidebar, notice, advert, form or comments. A host
    with fewer than ``MIN_PAGES`` articles has no template: there only the markup speaks. Null, empty and
    text-free pages give "". Of equal articles the first is taken. Repeated pages each give a row; extra
    columns are ignored; an empty table gives no rows. Pages are read whole, in time that grows with their
    length only.
    """
    pages = pages.select("page_id", "url", "html")
    keys = scratch.put(template_shares(pages, scratch), "templates")
    n = keys.count()
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"

    def rows(b: pd.DataFrame, share_of) -> pd.DataFrame:
        texts = [main_text(p, u, share_of(i)) for i, (p, u) in enumerate(zip(b["html"], b["url"]))]
        return pd.DataFrame({"page_id": b["page_id"].to_numpy(), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if n <= limit:
        got = keys.toPandas()  # at most ``limit`` rows of two numbers
        known, shares = got["key"].to_numpy(np.int64), got["share"].to_numpy(np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = dict(zip(known.tolist(), shares.tolist()))
            for b in batches:
                yield rows(b, lambda i: lambda key: held.get(key, 0))

        return pages.mapInPandas(lean(run), schema)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for page, url in zip(b["html"], b["url"]):
                host, nodes = host_of(url), parse(page)[0] if page else []
                found.append([template_key(host, x) for x in candidates(nodes, find_article(nodes))] if nodes and host else [])
            yield pd.DataFrame({"page": b["_page"], "keys": found})

    named = pages.withColumn("_page", F.concat_ws(" ", F.xxhash64("page_id", "url", "html").cast("string"), F.crc32("html").cast("string")))
    each = named.select("_page", "html", "url").mapInPandas(lean(find), "page string, keys array<bigint>").select("page", F.explode_outer("keys").alias("key"))
    mine = each.join(keys, "key").groupBy("page").agg(F.map_from_entries(F.collect_set(F.struct("key", "share"))).alias("_shares"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [dict(s) if s is not None else {} for s in b["_shares"]]
            yield rows(b, lambda i, held=held: lambda key: held[i].get(key, 0))

    return named.join(mine, named["_page"] == mine["page"], "left").select("page_id", "url", "html", "_shares").mapInPandas(lean(run_joined), schema)


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), Scratch(spark, "html"))
