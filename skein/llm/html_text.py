"""Operator 2: main text of web pages by a site style tree: the pages of a host are merged node by node, the entropy of what
stands in a node over the host's pages gives its importance, and branches of low importance are cut out of each page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import short_batches

# Fixed values of HTML: elements that stand on lines of their own, that hold no content, and whose content is raw.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|textarea|iframe|noframes|xmp|svg|math|object|audio|video|canvas"
#: An element that ends an open one of the second set when it begins directly in it.
_ENDS = {**{t: {"p"} for t in _BLOCK}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Words of a class, an id or a role that tell what is not the article, and elements that never are.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside widget widgets nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus respond reply replies form search login copyright pagination pager "
    "contentinfo complementary dialog skip".split()
)
_NEVER = frozenset("nav footer aside form button select menu dialog head title fieldset datalist optgroup option label".split())
#: What these words say does not hold inside an article, whose own head belongs to it.
_OWN = frozenset("header head".split())
_MAIN = frozenset("article main".split())
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")

#: Below this entropy (1: another content on each page) a node seen on so many pages at least is no content of its page.
LOW_IMPORTANCE, LEAST_PAGES = 0.4, 5


class Block(NamedTuple):
    """A block of text: the path of its element, whether its own marks call it noise, whether it stands in an article."""

    text: str
    path: str
    noise: bool
    article: bool


def _marks(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """The node's name in the style tree, whether it is noise by its marks, and whether it holds the article."""
    if not attributes or attributes == "/":
        return tag, tag in _NEVER or (tag == "header" and not inside), tag in _MAIN
    words, name, noise, main = set(), tag, tag in _NEVER or (tag == "header" and not inside), tag in _MAIN
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            noise = True
        elif key == "class":
            name += "." + value.lower()
        if key in ("class", "id", "role"):
            words.update(w.lower() for w in _WORDS.findall(value))
            main |= key == "role" and value.lower() in ("main", "article")
    if tag not in ("html", "body") and not main:
        noise |= bool(words & (_NOISE - _OWN if inside else _NOISE))
    return name, noise, main


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out. Markup, comments and raw elements hold no text."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, noise, article
    inline: list[tuple[str, bool]] = []  # open inline elements that are noise
    pieces: list[str] = []
    at = 0

    def close() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, *stack[-1][1:]))
            pieces.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at and not inline:
            pieces.append(html[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if tag == "br":
                pieces.append(" ")
            elif ends:
                if inline and inline[-1][0] == tag:
                    inline.pop()
            elif tag not in _VOID and (inline or tag in _NEVER or _marks(tag, attributes, stack[-1][3])[1]):
                if inline and inline[-1][0] != tag and tag not in _NEVER:
                    continue
                inline.append((tag, True))
            continue
        close()
        inline.clear()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID:
            while len(stack) > 1 and stack[-1][0] in _ENDS.get(tag, ()):
                stack.pop()
            _, path, noise, article = stack[-1]
            name, own, main = _marks(tag, attributes, article)
            stack.append((tag, f"{path}/{name}", noise or own, article or main))
            if len(stack) > 400:  # deeper elements count as their ancestor's
                stack.pop()
    if at < len(html) and not inline and not html.startswith("<", at):
        pieces.append(html[at:])
    close()
    return out


def host(url: str | None) -> str:
    return m[1].lower() if url and (m := _HOST.match(url)) else ""


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The style tree's entries: for each node of a page its host, the node's path, its content and its presentation there, and the page's content.

    Each ancestor is a node too; its content is that of all blocks below it, and so what stands below counts above. Its presentation is the
    names of the elements directly below it, in order."""
    for b in batches:
        rows = []
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            below: dict[str, int] = {}
            looks: dict[str, int] = {}
            for x in blocks(html):
                content, parts = _key(x.text), x.path.split("/")
                for i in range(2, len(parts) + 1):
                    path = "/".join(parts[:i])
                    below[path] = (below.get(path, 0) * 1_000_003 + content) % 2**63
                    looks[path] = (looks.get(path, 0) * 1_000_003 + (_key(parts[i]) if i < len(parts) else 1)) % 2**63
            site, page = _key(host(url)), _key(html)
            rows += [(site, _key(p), c, looks[p], page) for p, c in below.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["site", "path", "content", "look", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(site, path, pages, importance) of each node of each host's tree: the entropy of its contents or of its presentations over the host's
    different pages, whichever is larger, as a share of the largest there could be. Equal pages count once. Sums only are shuffled beyond the entries."""
    each = pages.mapInArrow(_nodes, "site long, path long, content long, look long, page long").distinct()
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("look").alias("value")))
    values = each.select("site", "path", F.inline(kinds)).groupBy("site", "path", "kind", "value").agg(F.count("*").alias("n"))
    nodes = values.groupBy("site", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return nodes.groupBy("site", "path").agg(F.max("pages").alias("pages"), F.max(entropy).alias("importance"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks that its own marks do not call noise, with the nodes from the body's children down that hold them."""
    block = pa.list_(pa.struct([("text", pa.string()), ("paths", pa.list_(pa.int64())), ("leaf", pa.int64()), ("article", pa.bool_())]))
    kinds, names = [pa.int64(), pa.string(), pa.int64(), pa.int64(), block], ["page_id", "url", "page", "site", "blocks"]
    for b in batches:
        rows = []
        for page, url, html in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True):
            found = []
            for x in blocks(html):
                if not x.noise:
                    p = x.path.split("/")
                    paths = [_key("/".join(p[:i])) for i in range(2, len(p) + 1) if p[i - 1].partition(".")[0] not in ("html", "body")]
                    found.append({"text": x.text, "paths": paths, "leaf": paths[-1] if paths else None, "article": x.article})
            rows.append((page, url, _key(html), _key(host(url)), found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def main_text(pages: DataFrame, low: float = LOW_IMPORTANCE, least: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: (page_id, url, text, n_chars), blocks in page order joined by a line feed.

    Of every page the blocks go whose nodes, from the body's children down, have an importance below `low` in the tree of their host
    and stand on `least` of its pages or more, inside an article or main element too. The marks are hints beside the tree: what they call a
    menu, a head, a foot, a notice, an advert, a form or comments is left out, and on a page with an article or main element a block outside it
    stays only if its node is on `least` pages or more, so that the tree vouches for it. If that leaves none, the article's blocks stay, or all without marks.

    Null pages are empty and have an empty text. Null urls belong to the host ''. Repeated ids and pages keep their rows.
    An empty table gives an empty result. Other columns are ignored."""
    short_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marked = source.mapInArrow(_marked, "page_id long, url string, page long, site long, blocks array<struct<text:string,paths:array<long>,leaf:long,article:boolean>>")
    known = style_tree(source.select("url", "html")).where(F.col("pages") >= least)
    # one row a page and node; what the tree knows of them comes back by page, so no host's tree is held whole
    wanted = marked.select("page", "site", F.explode(F.array_distinct(F.flatten("blocks.paths"))).alias("path")).distinct()
    cut = F.when(F.col("importance") < low, F.col("path"))
    judged = wanted.join(known, ["site", "path"]).groupBy("page", "site").agg(F.collect_set(cut).alias("low"), F.collect_set("path").alias("known"))
    none = F.array().cast("array<long>")
    joined = marked.join(judged, ["page", "site"], "left").withColumns({"low": F.coalesce("low", none), "known": F.coalesce("known", none), "own": F.filter("blocks", lambda x: x["article"])})
    vouched = lambda x: x["article"] | (F.size("own") == 0) | F.coalesce(F.array_contains("known", x["leaf"]), F.lit(False))
    kept = F.filter("blocks", lambda x: ~F.arrays_overlap(x["paths"], "low") & vouched(x))
    kept = F.when(F.size(kept) > 0, kept).when(F.size("own") > 0, F.col("own")).otherwise(F.col("blocks"))
    found = joined.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
