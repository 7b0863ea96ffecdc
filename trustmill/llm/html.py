"""HTML extraction with removal of site templates.

Pages are parsed into trees. Every block element's subtree is hashed (tag, class, id, text, children); Spark counts on how many
different pages of a host each hash stands (equal pages count once). Subtrees that recur on MIN_PAGES pages and on MIN_SHARE of the
host's pages are the site's template. A slot, the path of tags, classes and ids from the root, filled on MIN_PAGES of a host's
pages, is the template's too if most of what stands there also stands on another page: it goes even where it is seen once (menus
and footers that vary from page to page). Furniture by tag, role or class goes as well (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles): all that hosts of few pages have. Text blocks of an article or main
element are its own words and stay, however often they recur, and no slot is made of what holds an article.

The text is that of the article: the article element with most text, else the main element, else an
element whose class or id says content, else the body. Blocks are joined by one space, white space in a block becomes one space.

Defined cases: null, empty and unparsable html give the empty text; a null url has the empty host; when the template would take all
of a page's text, the page keeps what furniture rules leave; repeated pages get a row each; pages cut off in the middle
are closed at their end; elements nested deeper than DEPTH levels keep their text, but no rule is applied to them; an empty table
gives an empty table. Columns that clash with results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A template subtree stands on so many pages of its host at least, and on that share of them. The share bounds the set: pages of
#: so many elements each leave so many / MIN_SHARE hashes at most.
MIN_PAGES, MIN_SHARE = 5, 0.05
#: Share of what stands in a slot that recurs.
SLOT_SHARE = 0.5
#: Hashes that are broadcast (8 bytes each, and 100 a host); beyond it template sets are joined by host, salted.
BROADCAST_HASHES, SALTS = 1_000_000, 32
#: Levels of a tree.
DEPTH = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("head script style noscript template title svg math form button select option textarea iframe nav footer aside dialog menu canvas object embed audio video noembed noframes xmp input label fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text blocks: inside an article they are never taken for template.
WORDS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr caption figcaption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids that name furniture, and content.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners promo promos promotion sponsor sponsored sponsors sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus replies respond popup modal overlay pagination pager login search searchform widget widgets toolbar skip toc copyright legal disclaimer".split()
)
CONTENT = frozenset("article content main post entry story body text maincontent articlebody".split())
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|(?<==)"[^"]*"|(?<==)'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = {r: re.compile(rf"</{r}(?=[\s/>]|\Z)", re.I) for r in RAW}
#: A start tag ends an open element of these tags, up to the nearest of those.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "items", "up", "size", "hash", "slot", "depth", "holds")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.up, self.size, self.hash, self.slot, self.holds = tag, up, 0, 0, 0, False
        self.depth = up.depth + 1 if up else 0
        #: Nodes, strings, and None where a block ends. What lies too deep shares the list of the last that does not.
        self.items: list = up.items if up and self.depth > DEPTH else []
        self.names: frozenset[str] | tuple = ()
        self.role, self.hidden = "", False
        if attributes and "=" in attributes or "hidden" in attributes:
            names = ""
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "itemprop"):
                    names += " " + value
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                    self.hidden = True
            if names:
                self.names = frozenset(_NAME.findall(_HUMP.sub(" ", names).lower())) | frozenset(_NAME.findall(names.lower()))


def parse(html: str) -> Node:
    """A tree of DEPTH levels at most."""
    root = here = Node("#root", "", None)
    at, n = 0, len(html)
    opened: Counter[str] = Counter()  # so that nothing is looked for in vain

    def leave(node: Node) -> Node:
        """Closes all from here up to node."""
        x = here
        while True:
            opened[x.tag] -= 1
            if x.depth > DEPTH and x.tag in BLOCK:
                x.items.append(None)
            if x is node:
                return node.up
            x = x.up

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            here.items.append(html[at:])
            break
        if m.start() > at:
            here.items.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.up
                here = leave(node)
            elif tag == "p":
                here.items.append(Node("p", "", here) if here.depth < DEPTH else None)
            elif tag == "br":
                here.items.append(" ")
            continue
        if tag in BLOCK and opened["p"] > 0:  # ends an open paragraph
            node = here
            while node.tag not in BLOCK:
                node = node.up
            if node.tag == "p":
                here = leave(node)
        if tag in _CLOSES and any(opened[x] > 0 for x in _CLOSES[tag][0]):
            closed, within = _CLOSES[tag]
            node, last = here, None
            while node.up is not None and node.tag not in within:
                if node.tag in closed:
                    last = node
                node = node.up
            if last is not None:
                here = leave(last)
        node = Node(tag, m[3], here)
        if node.depth <= DEPTH:
            here.items.append(node)
        elif tag in BLOCK or tag == "br":
            here.items.append(None if tag in BLOCK else " ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            if end is None:
                at = n
            else:
                close = html.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            here = node
            opened[tag] += 1
    return root


def _furniture(node: Node, inside: bool) -> bool:
    tag = node.tag
    if node.hidden or tag in GONE or node.role in ROLES:
        return True
    if tag == "header" and not inside:
        return True
    if node.names and tag not in ("html", "body", "article", "main") and not node.names.isdisjoint(FURNITURE):
        return not (inside and tag in HEADINGS) and not (not inside and not node.names.isdisjoint({"main", "article", "content"}) and node.names.isdisjoint({"ad", "ads", "sidebar", "comments", "comment", "nav", "footer"}))
    return False


def prune(node: Node, inside: bool = False, template: frozenset[int] | set[int] = frozenset()) -> None:
    """Takes out furniture and template (hashes of subtrees and of slots), and counts the characters of text left under each node."""
    inside = inside or node.tag in ("article", "main")
    kept = []
    for x in node.items:
        if isinstance(x, str):
            node.size += len(x) - x.count(" ")
            kept.append(x)
        elif x is None:
            kept.append(None)
        elif _furniture(x, inside) or (template and (x.hash in template or x.slot in template) and not (inside and x.tag in WORDS)):
            if x.tag in BLOCK:
                kept.append(None)  # still parts blocks
        else:
            prune(x, inside, template)
            node.size += x.size
            kept.append(x)
    node.items = kept


def _digest(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\1".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def hash_subtrees(node: Node, found: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Gives block elements with text a hash of their subtree, and of their slot unless they hold an article; html, body, article and main only pass on.
    found: both, 0 for no slot."""
    found = [] if found is None else found
    names = " ".join(sorted(node.names))
    parts = [node.tag, names]
    node.slot = _digest([str(node.up.slot if node.up else 0), node.tag, names])
    for x in node.items:
        if isinstance(x, str):
            if text := " ".join(x.split()):
                parts.append(text)
        elif x is not None and x.tag not in RAW and x.tag not in VOID:
            hash_subtrees(x, found)
            node.holds |= x.holds or x.tag in ("article", "main")
            parts.append(f"\0{x.hash}")
    if len(parts) > 2 or node.names:
        node.hash = _digest(parts)
        if node.tag in BLOCK and node.tag not in ("html", "body", "head", "article", "main") and len(parts) > 2:
            found.append((node.hash, 0 if node.holds else node.slot))
    return found


def _all(node: Node, out: list[Node]) -> list[Node]:
    for x in node.items:
        if isinstance(x, Node):
            out.append(x)
            _all(x, out)
    return out


def main_node(root: Node) -> Node:
    nodes = [x for x in _all(root, []) if x.size]
    for pick in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.role == "main", lambda x: "articlebody" in x.names, lambda x: x.tag in BLOCK and x.tag not in ("html", "body") and not set(x.names).isdisjoint(CONTENT)):
        some = [x for x in nodes if pick(x)]
        if some:
            return max(some, key=lambda x: x.size)
    return next((x for x in nodes if x.tag == "body"), root)


def blocks(node: Node) -> list[str]:
    """The text of blocks, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (text := " ".join(unescape("".join(line)).split())):
            out.append(text)
        line.clear()

    def walk(x: Node) -> None:
        for i in x.items:
            if i is None:
                end()
            elif isinstance(i, str):
                line.append(i)
            elif i.tag == "br":
                line.append(" ")
            elif i.tag in BLOCK:
                end()
                walk(i)
                end()
            else:
                walk(i)

    walk(node)
    end()
    return out


def extract(html: str | None, template: set[int] = frozenset()) -> str:
    """The main text of a page; template holds hashes of subtrees and of slots that go."""
    if not html:
        return ""

    def once(hashes: set[int]) -> str:
        root = parse(html)
        if hashes:
            hash_subtrees(root)
        prune(root, False, hashes)
        return " ".join(blocks(main_node(root)))

    return once(template) or (once(set()) if template else "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """host, hashes: the subtrees that recur on each host's pages, and the slots where most do. A page's rows are combined before they are dealt out by hash, so a host of
    a large share of all pages is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, keys = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = page or ""
                some = {(0, 0), *hash_subtrees(parse(page))}  # 0 counts pages
                hosts += [host] * len(some)
                found += some
                keys += [_digest([page])] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)), pa.array(keys, pa.int64())], names=["host", "h", "slot", "page"])

    seen = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html")).mapInArrow(run, "host string, h long, slot long, page long")
    # Equal pages count once.
    counts = common.materialise(seen.distinct().groupBy("host", "h", "slot").agg(F.count(F.lit(1)).alias("n")), "subtrees")
    total = counts.where("h = 0").select("host", F.col("n").alias("total")).where(F.col("total") >= min_pages)
    often = counts.where("h != 0").groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    subtrees = often.join(total, "host").where(F.col("n") >= min_share * F.col("total")).select("host", "h")
    slots = counts.where("slot != 0").groupBy("host", F.col("slot").alias("h")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("n")).where((F.col("all") >= min_pages) & (F.col("n") >= slot_share * F.col("all"))).select("host", "h")
    return subtrees.union(slots).groupBy("host").agg(F.collect_set("h").alias("hashes"))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds text and n_chars to pages (without html)."""
    spark = pages.sparkSession
    common.tune(spark)
    with common.scratch(spark):
        sets = common.materialise(templates(pages, url, html), "templates", keep=True)
    new = ("text", "n_chars")
    rest = [c for c in pages.columns if c.lower() not in (*new, html.lower())]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`").cast("string").alias("__html"), host_of(F.col(f"`{url}`")).alias("__host"))
    weight = sets.agg(F.sum(F.size("hashes") + 13)).first()[0] or 0
    if weight <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(sets.withColumnRenamed("host", "__host")), "__host", "left")
    else:
        salted = sets.select(F.col("host").alias("__host"), "hashes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(rest)
            sets, texts = {}, []
            for page, host, hashes in zip(*(batch.column(i).to_pylist() for i in (k, k + 1)), batch.column(k + 2), strict=True):
                if host not in sets:
                    sets[host] = frozenset(hashes.as_py() or ())
                texts.append(extract(page, sets[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, *new])

    return joined.select(*[F.col(f"`{c}`") for c in rest], "__html", "__host", "hashes").mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
