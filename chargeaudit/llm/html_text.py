"""HTML extraction by removal of site templates.

Every page is read as a tree. The hash of each element's subtree (tags, attributes' names
of class and text) is counted per host in Spark, once for each distinct page body. Subtrees
that recur on many pages of their host are templates and are deleted, as are elements that
are never text of the article by their meaning: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Paragraphs, headings and other text
blocks inside an article stay even if several pages share them: a passage quoted often is
still text.

A subtree must be on ``MIN_PAGES`` pages and ``MIN_SHARE`` of its host's pages. So a host
has at most 1 / ``MIN_SHARE`` times as many templates as an average page has subtrees, and
the list that travels with its pages is bounded however large the host is.

Defined results: null or empty html gives an empty text; a null url is a host of its own;
unclosed and wrongly nested tags are closed where HTML would close them; repeated rows each
have a result; columns besides those read are kept unless called like a result column.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.llm.common import beside, table, written

MIN_PAGES = 3
MIN_SHARE = 0.2

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# start tag -> open elements it ends, unless one of the bounds lies between
ENDS_P = BLOCK - {"br", "body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"tr", "td", "th", "tbody", "thead", "tfoot"} for t in ("tbody", "thead", "tfoot")}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

NEVER = {
    "head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object",
    "button", "select", "textarea", "dialog", "menu", "audio", "video", "datalist", "noembed", "noframes", "title", "xmp",
}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NEVER_NAMES = set(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead "
    "comment comments commentlist disqus respond replies reply share sharing social subscribe newsletter signup login related toolbar pagination pager skip".split()
)
WHOLE = {"html", "body", "article", "main"}
MAIN = {"article", "main"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "figure", "figcaption"}
COUNTED = {"div", "section", "ul", "ol", "dl", "table", "p", "header", "footer", "nav", "aside", "form", "details", "h2", "h3", "h4", "blockquote", "figure", "center"}


class _Node:
    __slots__ = ("tag", "parts", "drop", "main", "inside", "names")

    def __init__(self, tag: str, names: str, drop: bool, main: bool, inside: bool):
        self.tag, self.names, self.drop, self.main, self.inside = tag, names, drop, main, inside
        self.parts: list = []  # texts and nodes in page order


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is never text of the article, whether it is the main part, and its names."""
    if tag in NEVER or tag == "header" and not inside:
        return True, False, ""
    if not attributes or not attributes.strip(" /"):
        return False, tag in MAIN, ""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    if tag in WHOLE or role == "main":
        return tag == "article" and bool({"comment", "comments"} & set(SPLIT.split(names))), tag in MAIN or role == "main", names
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    return hidden or role in NEVER_ROLES or not NEVER_NAMES.isdisjoint(SPLIT.split(names)), False, names


def tree_of(page: str) -> _Node:
    """The page's elements; text is decoded."""
    root = _Node("", "", False, False, False)
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        end = found.start() if found else size
        if end > at:
            stack[-1].parts.append(html.unescape(page[at:end]))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            else:
                if tag in BLOCK:
                    stack[-1].parts.append(" ")
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, {"td", "th", "table", "button", "object", "caption", "html"})
        if tag in ENDS:
            _close(stack, ENDS[tag], BOUNDS.get(tag, {"table"}))
        parent = stack[-1]
        drop, main, names = _unwanted(tag, found[3], parent.inside)
        node = _Node(tag, names, drop, main, parent.inside or main)
        parent.parts.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            rest = TAG.search(page, close.start()) if close else None
            at = rest.end() if rest else size
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[_Node], tags: set[str], bounds: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in bounds:
            return


def _hashes(node: _Node, found: dict[int, int]) -> int:
    """Hash of the subtree; fills ``found`` (identity of the node -> hash) with those to be counted."""
    order, at = [node], 0
    while at < len(order):  # all nodes, parents first
        order.extend(p for p in order[at].parts if isinstance(p, _Node))
        at += 1
    own: dict[int, int] = {}
    texts: dict[int, bool] = {}
    for n in reversed(order):
        parts, text = [n.tag, n.names], False
        for p in n.parts:
            if isinstance(p, _Node):
                parts.append(str(own[id(p)]))
                text |= texts[id(p)]
            elif p.strip():
                parts.append(SPACE.sub(" ", p.strip()))
                text = True
        own[id(n)] = value = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        texts[id(n)] = text
        holds_main = n.main or any(isinstance(p, _Node) and texts.get(-id(p), False) for p in n.parts)
        texts[-id(n)] = holds_main
        if text and not holds_main and n.tag in COUNTED and not (n.inside and n.tag in TEXT_BLOCKS):
            found[id(n)] = value
    return own[id(node)]


def _text(nodes: list[_Node], deleted: dict[int, int], templates: frozenset[int]) -> str:
    """Text below the nodes, without unwanted elements and templates; blocks are set apart."""
    pieces: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            pieces.append(part)
        elif part.drop or deleted.get(id(part)) in templates:
            pieces.append(" " if part.tag in BLOCK else "")
        else:
            edge = " " if part.tag in BLOCK else ""
            pieces.append(edge)
            stack.append(edge)
            stack.extend(reversed(part.parts))
    return " ".join("".join(pieces).split())


def _main(root: _Node) -> list[_Node]:
    """The outermost articles, else the outermost main parts, else the whole page."""
    for tag in ("article", None):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.drop:
                continue
            if node.main and (tag is None or node.tag == tag):
                found.append(node)
            else:
                stack.extend(p for p in reversed(node.parts) if isinstance(p, _Node))
        if found:
            return found
    return [root]


def page_subtrees(page: str) -> tuple[int, list[int]]:
    """Hash of the body and the distinct hashes of the subtrees that may be templates."""
    found: dict[int, int] = {}
    whole = _hashes(tree_of(page), found)
    return whole, sorted(set(found.values()))


def page_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Main text of a page."""
    root = tree_of(page)
    deleted: dict[int, int] = {}
    if templates:
        _hashes(root, deleted)
    return _text(_main(root), deleted, templates)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, subtree, pages): on how many distinct page bodies of a host a subtree stands; subtree 0 counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, subtrees, bodies = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                body, found = page_subtrees(page)
                for subtree in (0, *found):
                    hosts.append(host)
                    subtrees.append(subtree)
                    bodies.append(body)
            longs = [np.array(x, np.uint64).view(np.int64) for x in (subtrees, bodies)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *map(pa.array, longs)], ["host", "subtree", "body"])

    seen = pages.where(F.col("html") != "").select("host", "html").mapInArrow(run, "host string, subtree long, body long")
    return seen.distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): hashes of each host's recurring subtrees."""
    counts = written(subtree_counts(pages).where(F.col("pages") >= min_pages), "subtrees")
    whole = counts.where("subtree = 0").select("host", F.col("pages").alias("_all"))
    often = beside(counts.where("subtree != 0"), whole, ["host"]).where(F.col("pages") >= F.col("_all") * min_share)
    return written(often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates")), "templates")


def extract(df: DataFrame) -> DataFrame:
    """``df`` (url, html and others) without ``html``, with ``text`` and ``n_chars``."""
    kept = df.drop("text", "n_chars", "host", "templates").withColumn("host", host_of()).withColumn("html", F.coalesce("html", F.lit("")))
    templates = site_templates(kept.select("host", "html"))
    fields = [f for f in kept.schema.fields if f.name not in ("html", "host")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                pairs = zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)
                texts = [page_text(p, frozenset(t & 0xFFFFFFFFFFFFFFFF for t in own or ())) for p, own in pairs]
                columns = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names
                )

    return beside(kept, templates, ["host"], "left").select(*[f.name for f in fields], "html", "templates").mapInArrow(run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
