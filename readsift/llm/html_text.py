"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template. A page's tokens are its start tags, each with the elements around it, and its
blocks of text, each with the container around it; the occurrence vector of a token is its number in every page of the
host (a block of text counts once a page), and tokens with the same vector form an equivalence class. Classes that
enough pages hold, and whose tokens stand inside those of a class with a vector at least as large, nest into the host's
template. Pages that are equal count once.

The class of the vector of ones has the template's frame: elements that stand once on every page. An article or main
element of the frame, or one that stands once on the page, is the slot of the article, and all its text is kept but what
fixed lists of tags and whole class names mark as surrounding. On a page without one, the template decides: a container
goes if the template holds all its text, so do blocks of the template before the first and after the last other one,
and what remains are the slots. Blocks of the template between other blocks (a heading that every article has) stay.

Hosts with a single page have no vectors to compare; pages of such hosts with the same set of tags are taken together.
Blocks count as template only on sites of at least ``MIN_PAGES`` different pages. A page of template blocks alone is a
copy of its siblings, and there only the lists decide.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from readsift.llm.common import if_small
from readsift.session import stage

SMALL_ROWS = 100_000
#: A class is frequent if this share of the host's pages holds it.
FREQUENT = 0.6
#: Blocks of text are template only on sites of so many different pages.
MIN_PAGES = 3
#: Bytes of template tokens that are sent to every task; beyond these the pages are joined with them.
MAX_BROADCAST_BYTES = 32 << 20

# Kinds of elements, and the words of class, id and role that mark what surrounds an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub "
    "sup time tt u var".split()
)
_SURROUND = frozenset(
    "nav header footer aside form script style noscript head title template button select option textarea iframe svg object dialog menu canvas "
    "map audio video".split()
)
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments disqus replies respond share sharing social related recommended widget login signup search contentinfo complementary "
    "toolbar pagination pager skip".split()
)
# Words that stand beside a mark in the names of what surrounds an article; with any other word a name says something else.
_BESIDE = frozenset(
    "slot box container wrapper wrap block bar list section area unit panel posts articles stories links items buttons icons form "
    "message text policy site page main global top bottom left right primary secondary".split()
)
# An article has such parts of its own.
_OWN_PARTS = frozenset("header notice notices menu alert search".split())
_READERS = frozenset("comment comments disqus replies respond".split())
_MAIN = ("article", "main")
# Elements that hold blocks; the others (paragraphs, headings, list items, cells) are blocks themselves.
_CONTAINERS = frozenset("html body div section ul ol dl table main article nav header footer aside details fieldset center".split())
_CLOSED_BY = {  # an open element of the key ends where one of these begins
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
        "table ul li dt dd tr td th".split()
    ),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}),
    "head": frozenset({"body"}),
}
_LISTS = frozenset("ul ol dl table menu".split())  # beyond these, an element of the same kind is another list's

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_TEXT = ">#[0-9a-f]{16}$"  # the end of a token that is a block of text
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _label(tag: str, attributes: str) -> str:
    """Element name with its class names, id and role."""
    names = [w.lower() for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()]
    return ".".join([tag, *sorted(set(names))])


def _marks(name: str, inside_main: bool) -> bool:
    """Whether a class name, id or role as a whole, not just a word of it, marks what surrounds an article."""
    words = {w for w in re.split(r"[_-]+", name) if w}
    marks = words & _MARKS
    return bool(marks) and words <= _MARKS | _BESIDE and not (inside_main and marks <= _OWN_PARTS)


@lru_cache(100_000)
def _from_readers(label: str) -> bool:
    """Whether a class name, id or role as a whole says that readers wrote what is in the element."""
    tag, *names = label.split(".")
    for name in () if tag in ("html", "body") else names:
        words = {w for w in re.split(r"[_-]+", name) if w}
        if words & _READERS and words <= _MARKS | _BESIDE:
            return True
    return False


@lru_cache(100_000)
def surrounds(label: str, inside_main: bool) -> bool:
    """Whether an element holds what is not the article. A header, notice or menu inside an article is the article's own."""
    tag, *names = label.split(".")
    if tag in ("html", "body", *_MAIN):
        return _from_readers(label)
    if tag == "header" and inside_main:
        return False
    return tag in _SURROUND or any(_marks(name, inside_main) for name in names)


def parse(page: str) -> tuple[list[tuple[tuple[str, ...], int, str]], Counter]:
    """Text nodes (elements around, block number, raw text) and the number of each start tag with the elements around it."""
    stack: list[str] = []
    nodes, tags, block, at = [], Counter(), 0, 0

    def text(end: int) -> None:
        if end > at:
            nodes.append((tuple(stack), block, page[at:end]))

    for found in _TOKEN.finditer(page):
        if found.start() < at:
            continue
        text(found.start())
        at = found.end()
        closing, opening = found[1], found[2]
        if closing:
            tag = closing.lower()
            names = [s.partition(".")[0] for s in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
                block += 1
            elif tag not in _INLINE and tag not in _VOID:
                block += 1
        elif opening:
            tag = opening.lower()
            if tag in _VOID:
                if tag == "br":
                    nodes.append((tuple(stack), block, " "))
                elif tag == "hr":
                    block += 1
                continue
            if tag in _INLINE and not surrounds(_label(tag, found[3]), False):
                continue
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i].partition(".")[0]
                if tag in _CLOSED_BY.get(name, ()):
                    del stack[i:]
                elif name in _LISTS or name in ("div", "section", "article", "body"):
                    break
            stack.append(_label(tag, found[3]))
            tags[">".join(stack)] += 1
            block += tag not in _INLINE
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                stack.pop()
                block += 1
    text(len(page))
    return nodes, tags


def _blocks(nodes: list[tuple[tuple[str, ...], int, str]], mains: set[str]) -> list[tuple[tuple[str, ...], str]]:
    """Blocks of text in page order, each with the elements around it, without what the lists mark as surrounding. Where
    there are ``mains`` (paths), only the blocks inside them."""
    kept: dict[tuple[str, ...], bool] = {}
    blocks: dict[int, tuple[list[tuple[str, ...]], list[str]]] = {}
    for path, block, raw in nodes:
        if path not in kept:
            inside = next((i + 1 for i in range(len(path)) if ">".join(path[: i + 1]) in mains), 0) if mains else 0
            kept[path] = not (mains and not inside) and not any(surrounds(label, inside > 0) for label in path[inside:])
        if kept[path]:
            paths, parts = blocks.setdefault(block, ([], []))
            if not paths and raw.strip():
                paths.append(path)
            parts.append(raw)
    texts = ((paths, " ".join(html.unescape("".join(parts)).split())) for _, (paths, parts) in sorted(blocks.items()))
    return [(paths[0] if paths else (), t) for paths, t in texts if t]


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The elements around a block up to the innermost container."""
    end = len(path)
    while end and path[end - 1].partition(".")[0] not in _CONTAINERS:
        end -= 1
    return path[:end]


def _text_token(container: tuple[str, ...], text: str) -> str:
    """A block of text as a token: the path of its container, then a hash of both."""
    path = ">".join(container)
    return f"{path}>#{hashlib.blake2b(f'{path}\n{text}'.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def _between(blocks: list[tuple[tuple[str, ...], str]], fixed: set[str]) -> list[tuple[tuple[str, ...], str]]:
    """``blocks`` without the template's: those of containers that hold nothing else, and those before the first and after
    the last other block. ``fixed`` has the hashes of the template's blocks. All of them, if there is no other block."""
    placed = [(_container(path), text) for path, text in blocks]
    own = [_text_token(c, text).rpartition("#")[2] not in fixed for c, text in placed]
    if not any(own):
        return blocks
    live = {c[:i] for (c, _), o in zip(placed, own) if o for i in range(len(c) + 1)}
    first, last = own.index(True), len(own) - own[::-1].index(True)
    return [blocks[i] for i in range(first, last) if own[i] or placed[i][0] in live]


def _mains(tags: Counter, frame: set[str]) -> set[str]:
    """Paths of the article and main elements that may be the page's: of the frame, else those that stand once, else all.
    Where readers wrote in one, it is none."""
    found = {p for p in tags if p.rpartition(">")[2].partition(".")[0] in _MAIN and not any(map(_from_readers, p.split(">")))}
    found = found & frame or {p for p in found if tags[p] == 1} or found
    # An article in a sidebar is a teaser, but if no other stands freer it is the page's own, and what holds it is no sidebar.
    held = {p: sum(surrounds(label, False) for label in p.split(">")) for p in found}
    return {p for p in found if held[p] == min(held.values())}


def main_text(page: str, frame: set[str], fixed: set[str] = frozenset(), several: set[str] = frozenset()) -> str:
    """Text of the main slots. ``frame`` has the template's elements (paths) that stand once on every page, ``fixed`` the
    hashes of its blocks of text, ``several`` the article and main elements that some page of the site has more than once."""
    nodes, tags = parse(page)
    mains = _mains(tags, frame)
    if mains and all(tags[p] > 1 or p in several for p in mains):
        # Several of a kind are parts of the page (teasers, readers' comments) if there is text of its own beside them.
        beside = _between(_blocks(nodes, set()), fixed)
        if any(not any(">".join(path[: i + 1]) in mains for i in range(len(path))) for path, _ in beside):
            mains = set()
    blocks = _blocks(nodes, mains) if mains else _between(_blocks(nodes, mains), fixed)
    return "\n\n".join(t for _, t in blocks)


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _page_key(url: str, page: str) -> Column:
    """Pages of a host with equal html are one."""
    return F.xxhash64(_host(F.col(url)), F.coalesce(page, F.lit("")))


def tokens(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Rows (host, page, shape, token, n): number of each token in each different page; ``page`` is a hash of host and html
    and ``shape`` one of the page's set of tags. Blocks of text count once."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, number, text in zip(batch["host"], batch["page"], batch["text"]):
                nodes, tags = parse(text)
                shape = " ".join(sorted(tags))
                rows += [(host, number, shape, t, n) for t, n in tags.items()]
                texts = {_text_token(_container(path), t) for path, t in _blocks(nodes, set())}
                rows += [(host, number, shape, t, 1) for t in texts]
            yield pd.DataFrame(rows, columns=["host", "page", "shape", "token", "n"])

    read = pages.select(_host(F.col(url)).alias("host"), _page_key(url, page).alias("page"), F.coalesce(page, F.lit("")).alias("text"))
    found = read.mapInPandas(counted, "host string, page bigint, shape string, token string, n int")
    return found.withColumn("shape", F.xxhash64("shape")).distinct()


def sited(counts: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``counts`` with ``site``: the host, or for hosts of one page the set of tokens. ``places`` has host and page of all
    pages that are not blank, where they can be had without reading tokens."""
    size = (counts if places is None else places).groupBy("host").agg(F.min("page").alias("_a"), F.max("page").alias("_b"))
    single = stage(size.where("_a = _b").select("host", F.lit(True).alias("_single")), "single-hosts")
    shape = F.concat(F.lit("shape:"), F.col("shape"))
    return counts.join(if_small(single, SMALL_ROWS), "host", "left").select(
        F.when(F.col("_single"), shape).otherwise(F.col("host")).alias("site"), "page", "token", "n"
    )


def templates(counts: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """Nested equivalence classes of sited token counts: rows (site, class, support, share, n_low, n_high, tokens, parent),
    ``tokens`` being the class's tokens and ``parent`` the class around the shortest of them (null at the root).

    A site is only ever a key of sums that are combined before the shuffle: a vector is kept as a sum of one hash
    per page, so equal hashes stand for equal vectors."""
    totals = counts.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("_pages"))
    totals = if_small(stage(totals, "site-sizes"), SMALL_ROWS)
    vectors = counts.groupBy("site", "token").agg(
        F.count(F.lit(1)).alias("support"), F.expr("bit_xor(xxhash64(page, n))").alias("class"),
        F.min("n").alias("n_low"), F.max("n").alias("n_high"),
    )
    # Blocks of too few pages for the smallest site that has template blocks, most of all blocks, go before the join.
    is_text = F.col("token").rlike(_TEXT)
    held = vectors.where(~is_text | (F.col("support") >= frequent * MIN_PAGES)).join(totals, "site")
    held = held.where((F.col("support") >= frequent * F.col("_pages")) & (~is_text | (F.col("_pages") >= MIN_PAGES)))
    # What stands around a token is its path without the last element. It is in every page that the token is in, so
    # support never grows inwards, and a token nests if the one around it is frequent too (or there is none).
    around = F.regexp_replace("token", r">?[^>]*$", "")
    outer = held.select("site", F.col("token").alias("_around"), F.col("class").alias("_outer"))
    placed = held.withColumn("_around", around).join(outer, ["site", "_around"], "left").where("_around = '' OR _outer IS NOT NULL")
    return placed.groupBy("site", "class").agg(
        F.max("support").alias("support"), F.max(F.col("support") / F.col("_pages")).alias("share"),
        F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"), F.array_sort(F.collect_set("token")).alias("tokens"),
        F.min_by("_outer", F.struct(F.length("token"), "token")).alias("parent"),
    )


def extract(pages: DataFrame, url: str = "url", page: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each, blocks joined by an empty line.

    Null and empty pages, and pages of boilerplate alone, have an empty text; a page without markup is text throughout.
    Repeated rows each keep theirs; null urls make one host together. A column already called ``name`` is replaced. An
    empty table gives no rows.
    """
    kept = pages.drop(name)
    places = kept.where(F.length(F.trim(F.col(page))) > 0).select(_host(F.col(url)).alias("host"), _page_key(url, page).alias("page"))
    counts = stage(sited(tokens(kept, url, page), places), "page-tokens")
    found = stage(templates(counts), "templates")
    token = F.col("token")
    parts = found.select("site", F.explode("tokens").alias("token"), F.expr("n_low = 1 AND n_high = 1 AND share = 1").alias("once"))
    several = counts.where((F.col("n") > 1) & token.rlike(rf"(^|>)({'|'.join(_MAIN)})(\.[^>]*)?$")).select("site", token).distinct()
    rows = [
        parts.where(~token.rlike(_TEXT) & F.col("once")).select("site", F.lit("frame").alias("kind"), token),
        parts.where(token.rlike(_TEXT)).select("site", F.lit("fixed"), F.right(token, F.lit(16))),
        several.select("site", F.lit("several"), token),
    ]
    kinds = [F.collect_list(F.when(F.col("kind") == k, token)).alias(k) for k in ("frame", "fixed", "several")]
    known = stage(rows[0].union(rows[1]).union(rows[2]).groupBy("site").agg(*kinds), "known-templates")
    shapes = stage(counts.where("site LIKE 'shape:%'").select("page", F.col("site").alias("shape")).distinct(), "shapes")

    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series, *sets: pd.Series) -> pd.Series:
        given = zip(texts, *sets)
        return pd.Series([main_text(t, *(set(s) if s is not None else set() for s in known)) for t, *known in given], dtype=object)

    # The columns of ``pages`` travel as one struct, whose name alone could clash, and nothing else of them reaches Python.
    row = F.struct(*kept.columns).alias("row")
    placed = kept.select(row, _host(F.col(url)).alias("host"), _page_key(url, page).alias("page"), F.col(page).alias("source"))
    placed = placed.join(if_small(shapes, SMALL_ROWS), "page", "left").withColumn("site", F.coalesce("shape", "host"))
    size = known.agg(F.sum(F.length(F.concat_ws(" ", "site", "frame", "fixed", "several")))).first()[0] or 0
    placed = placed.join(F.broadcast(known) if size <= MAX_BROADCAST_BYTES else known, "site", "left")
    return placed.select("row", read(F.coalesce("source", F.lit("")), "frame", "fixed", "several").alias("text")).select("row.*", F.col("text").alias(name))
