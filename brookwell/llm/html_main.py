"""Main text of web pages by site style trees.

Method: the DOMs of one host's distinct pages are merged by style path (tags and
classes from the root). A path's importance joins the entropy of its presentation
(how its child sequences vary over the pages) with that of its content (a text
that stands on few of the path's pages is important, one that stands on all is
not). Branches of low importance are removed from each page.

Elements whose role says that they are no main text (navigation, footers, scripts,
adverts by a whole class and so on) have importance 0 from the start. ``article``
and ``main`` only raise the importance of the paths in them, to its root: what
stands there must be repeated more to go, and text elsewhere is judged by the tree
as on any page. A main element inside one that is off by its class, or in a form,
is on again, unless it is a comment.

A path that fewer than ``LEAST_PAGES`` of the host's distinct pages have is not
judged: two or three pages that agree say nothing about a template, so small sites
keep what the roles leave.

Defined cases: a null or empty page has empty text; a null or odd url belongs to
the host ``""``; copies of a page count once in their host's tree; repeated rows
get equal results; broken markup (unclosed or crossing tags, stray ``<``) is read
as far as it goes; a very long page is parsed by itself, in time proportional to
its length; other columns are not looked at, whatever their names.
"""

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.llm.work import attach, written

LEAST_PAGES, LEAST_IMPORTANCE, GAMMA = 5, 0.1, 0.9
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NO_TEXT = frozenset("head nav footer aside form script style textarea title noscript template iframe xmp svg math button select option input dialog menu object canvas audio video map datalist".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NO_CLASS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer comment comments disqus respond share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay pagination pager toolbar login signup search skip disclaimer".split())
HEADERS = frozenset("header masthead topbar banner".split())
COMMENTS = frozenset("comment comments disqus respond".split())
#: An element is on, off until a main element in it, or off with all that is in it.
ON, OFF, SHUT = 0, 1, 2
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article main section div body html table td th ul ol dl li blockquote figure details".split())


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    __slots__ = ("tag", "path", "off", "main", "children")

    def __init__(self, tag: str, path: int, off: int, main: bool):
        self.tag, self.path, self.off, self.main, self.children = tag, path, off, main, []


def _element(tag: str, attrs: str, parent: Element) -> Element:
    own, label, names, role = ON, tag, frozenset(), ""
    if tag in NO_TEXT:
        own = OFF if tag == "form" else SHUT
    if attrs.strip("/ "):
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
        classes, role = found.get("class", ""), found.get("role", "").lower()
        if classes:
            label += "." + ".".join(sorted(classes.split()))
        if tag not in ("html", "body"):
            names = frozenset(f"{classes} {found.get('id', '')}".lower().split())
            if role in NO_ROLE or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                own = max(own, OFF if role == "form" else SHUT)
    is_main = tag in ("article", "main") or role in ("main", "article")
    if names & COMMENTS:
        own = SHUT
    elif not is_main and (names & NO_CLASS or (not parent.main and (names & HEADERS or tag == "header"))):
        own = max(own, OFF)
    above = ON if is_main and parent.off == OFF else parent.off
    return Element(tag, hash64(f"{parent.path}/{label}") if tag not in INLINE else parent.path, max(above, own), parent.main or is_main)


def blocks(page: str) -> tuple[list[tuple[int, bool, bool, str]], dict[int, list[str]]]:
    """Text blocks in page order as (path, switched off, in a main element, text), and the child tags of each path."""
    root = Element("", 0, ON, False)
    stack, out, parts, styles = [root], [], [], {}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1]
                out.append((top.path, top.off != ON, top.main, text))

    def say(text: str) -> None:
        if text:
            parts.append(entities.unescape(text) if "&" in text else text)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if inline and any(e.tag not in INLINE for e in stack[i + 1 :]):
                        del stack[i]
                    else:
                        del stack[i:]
                    break
                if inline is False and tag == "p" and stack[i].tag in SCOPE:
                    break
            continue
        if not inline:
            shut = CLOSES.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or (shut and t in shut):
                    del stack[i:]
                    if not shut:
                        break
                elif t in SCOPE and not (shut and t in shut):
                    break
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        top = stack[-1]
        if not inline:
            styles.setdefault(top.path, []).append(tag)
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(_element(tag, m[3], top))
    flush()
    return out, styles


def main_text(page: str | None, low: set[int] = frozenset()) -> str:
    """The blocks whose path is not in ``low``, joined by newlines."""
    found, _ = blocks(page or "")
    return "\n".join(b[3] for b in found if not b[1] and b[0] not in low)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Written table (id, url, host, h, blocks, nodes): each page is parsed once, and only what it says is kept.

    ``blocks`` has the page's blocks (path, text) in order, and ``nodes`` an item for each path with text.
    """
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    blocks_type = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string())]))
    nodes_type = pa.list_(pa.struct([("path", pa.int64()), ("main", pa.bool_()), ("style", pa.int64()), ("contents", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                said, nodes = [], []
                for html in part.column(4).to_pylist():
                    found, styles = blocks(html or "")
                    kept = [b for b in found if not b[1]]
                    said.append([{"path": b[0], "text": b[3]} for b in kept])
                    by: dict[int, set[int]] = {}
                    for path, _, _, text in kept:
                        by.setdefault(path, set()).add(hash64(text))
                    inside = {b[0] for b in kept if b[2]}
                    nodes.append([{"path": path, "main": path in inside, "style": hash64(",".join(styles.get(path, ()))), "contents": list(content)} for path, content in by.items()])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(said, blocks_type), pa.array(nodes, nodes_type)], ["id", "url", "host", "h", "blocks", "nodes"])

    kinds = page.schema
    fields = f"id {kinds['id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, host string, h long, blocks array<struct<path:long,text:string>>, nodes array<struct<path:long,main:boolean,style:long,contents:array<long>>>"
    return written(page.mapInArrow(run, fields), "parsed")


def style_nodes(parsed: DataFrame) -> DataFrame:
    """Written table (host, h, path, main, style, contents): the merged DOMs of each host, one row for each distinct page and path with text."""
    distinct = parsed.select("host", "h", "nodes").dropDuplicates(["host", "h"])
    return written(distinct.select("host", "h", F.explode("nodes").alias("n")).select("host", "h", "n.path", "n.main", "n.style", "n.contents"), "style-nodes")


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance): composite of presentation and content entropy, 0 to 1; both with the number of the path's pages as base of the logarithm.

    Of paths in a main element it is the composite's root.
    """
    key = ["host", "path"]
    styles = nodes.groupBy(*key, "style").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    by_style = styles.groupBy(*key).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"), F.max("main").alias("main"))
    texts = nodes.select(*key, F.explode("contents").alias("text")).groupBy(*key, "text").agg(F.count("*").alias("n"))
    by_text = texts.groupBy(*key).agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.ln("n")).alias("tlogt"))
    m = F.ln("pages")
    presentation = F.when(F.col("pages") == 1, 1.0).otherwise((m - F.col("nlogn") / F.col("pages")) / m)
    content = F.when(F.col("pages") == 1, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("tlogt") / F.col("texts") / m))
    composite = F.greatest(F.lit(0.0), (1 - GAMMA) * presentation + GAMMA * content)
    return by_style.join(by_text, key).select(*key, "pages", F.when(F.col("main"), F.sqrt(composite)).otherwise(composite).alias("importance"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text. Every page meets its host's low branches; pages of large hosts stay where they are, and the markup is never shuffled."""
    parsed = parse_pages(pages, id_col, url_col, html_col)
    nodes = style_nodes(parsed)
    low = importance(nodes).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance)).groupBy("host").agg(F.collect_list("path").alias("low"))
    rows = parsed.groupBy("host").agg(F.count("*").alias("rows"))
    hosts = written(rows.join(low, "host", "left").select("host", "rows", F.coalesce("low", F.array().cast("array<bigint>")).alias("low")), "hosts")
    met = attach(parsed, hosts, ["host"], "rows", parsed.count(), merge=False).withColumn("low", F.array_intersect(F.col("nodes.path"), "low"))
    kept = F.filter("blocks", lambda b: ~F.array_contains("low", b["path"]))
    return met.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
