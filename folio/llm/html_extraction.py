"""Main text of web pages by a site style tree.

The DOMs of one host are merged: a node of the tree is a path of element names and classes. For every node two
distributions are gathered over the host's distinct pages: what it says (hashes of its text) and how it is laid out
(the sequence of its child elements). Their entropies, relative to the largest possible ones, make the node's own
importance: what says the same on every page is worth little. A node seen on few pages says little about itself, so its
importance is drawn towards 1.

In each page importance is combined over the branches: a branch has the mean of its texts' importances, weighted by
length, and every node is drawn down by a branch around it that is worth little. Elements and names (menus, adverts, forms,
comments ...) are priors: they multiply their branch's importance, a name of content takes back one of something else,
and a branch below the least importance goes with all that it holds. The header of an article that has a heading and
a form that holds an article or most of the page have no such prior. Where a page has a main element outside cut
branches, or articles that hold at least half of its text, only they count; a node in them goes at a lower importance,
as a paragraph may well repeat across articles, never a heading. Pages of a host with the same main text count once, so
an article doesn't lose importance by its own copies.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_reputation import host_of

#: How many pages' worth of doubt a node's importance starts with, at 1.
DOUBT = 2.0
#: Priors of a branch by what its names say: something else than content, or a compound that may do so.
ELSE, PERHAPS = 0.25, 0.5
#: How far a node's importance is drawn down by the branch around it: the power of that branch's importance.
DRAWN = 0.2
#: Nodes that are broadcast at most (16 bytes each); hosts of more than this share of the pages (as its inverse) are split.
MOST_NODES, HOT_HOSTS = 1_000_000, 200

# Element names.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
SILENT = frozenset("head title script style noscript template svg math iframe object canvas audio video map".split())
BOILERPLATE = frozenset("nav header footer aside form menu button select textarea input fieldset dialog".split())
#: How strongly an element marks the main text.
MAIN = {"article": 1, "main": 2}
#: Whole names in a class, id or role that say a branch is something else than content.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget related recommended share social notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "signup login form search comment comments disqus reply replies pagination pager toolbar skip complementary contentinfo".split()
)
#: Names of content, words that say nothing about a compound's meaning, and words that turn it into a remark.
CONTENT = frozenset("article story post entry prose".split())
HELPERS = frozenset("site page main global top bottom left right inner outer upper lower primary secondary list box bar wrap wrapper block container area section row col item items content body text link links".split())
REMARKS = frozenset("has with no without not".split())
#: Elements that may wrap a whole page.
WRAPPERS = frozenset("form fieldset dialog".split())
#: An open element that a new one of the given kind closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main nav aside body select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|title|textarea)\b(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?](?>[^>]*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(4096)
def _said(token: str) -> tuple[int, bool]:
    """(2 for content, 0 for nothing, -1 for perhaps something else, -2 for something else; whether "header" alone says so)."""
    if token in NAMES or token in CONTENT:
        return (-2, token == "header") if token in NAMES else (2, False)
    parts = set(re.split("[-_]+", token))
    other = parts & NAMES
    if not other or parts & REMARKS:
        return 0, False
    return (-1 if parts - NAMES - HELPERS - CONTENT else -2), other == {"header"}


class Node:
    """An element of a page: the place of its parent, its path in the site's tree, and what its names say."""

    __slots__ = ("up", "name", "path", "silent", "mark", "prior", "header", "children", "size", "worth", "heading", "marks")

    def __init__(self, up: int, name: str, path: int, silent: bool, mark: int, prior: float, header: bool):
        self.up, self.name, self.path, self.silent, self.mark, self.prior, self.header = up, name, path, silent, mark, prior, header
        self.children, self.size, self.worth, self.heading, self.marks = [], 0, 0.0, name in HEADINGS, name in MAIN


def read_page(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The page's elements in their order, and its text blocks as (element, nearest element that is no inline one, text)."""
    nodes = [Node(0, "", 0, False, 0, 1.0, False)]
    stack, blocks, buffer = [0], [], []

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1], next(x for x in reversed(stack) if nodes[x].name not in INLINE), text))

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            buffer.append(page[last : m.start()])
        last = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name not in INLINE:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].name == name:
                    del stack[depth:]
                    break
                if name in INLINE and nodes[stack[depth]].name not in INLINE:
                    break
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name not in INLINE:
            flush()
            shut = CLOSES.get(name, {"p"})
            while len(stack) > 1 and nodes[stack[-1]].name in INLINE and any(nodes[x].name in shut for x in stack[1:]):
                stack.pop()
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].name in shut:
                    del stack[depth:]
                elif nodes[stack[depth]].name in SCOPES:
                    break
        if name in VOID:
            continue
        up = nodes[stack[-1]]
        label, says, header = name, 0, True
        for a in _NAMED.finditer(m[4]):
            value = (a[2] or a[3] or a[4] or "").lower()
            label += f" {a[1].lower()}={_DIGITS.sub('0', value)}"
            if name not in ("html", "body"):
                for token in value.split():
                    how, alone = _said(token)
                    says += how
                    header = header and (how >= 0 or alone)
        if name in BOILERPLATE:
            says, header = -2, header and name == "header"
        prior = ELSE if says <= -2 else PERHAPS if says < 0 else 1.0
        up.children.append(name)
        if not m[4].rstrip().endswith("/") or name in INLINE or name == "p":
            nodes.append(Node(stack[-1], name, xxhash.xxh64_intdigest(label, up.path & 0xFFFFFFFF) >> 1, up.silent or name in SILENT, max(up.mark, MAIN.get(name, 0)), prior, header))
            stack.append(len(nodes) - 1)
    if last < len(page):
        buffer.append(page[last:])
    flush()
    return nodes, blocks


def _own(node: Node) -> int:
    """The node in the site's tree; a heading in a marked branch is none that could be cut."""
    return -1 if node.mark and node.name in HEADINGS else node.path


def _cut_branches(nodes: list[Node], blocks: list, own: dict, least: float) -> tuple[list[bool], list[float]]:
    """Whether each element lies in a branch that goes, and each element's importance combined over its branch."""
    for at, block, text in blocks:
        if not nodes[at].silent:
            n = nodes[at]
            n.size += len(text)
            n.worth += len(text) * own.get(_own(nodes[block]), 1.0)
    for n in reversed(nodes[1:]):
        up = nodes[n.up]
        up.size, up.worth, up.heading, up.marks = up.size + n.size, up.worth + n.worth, up.heading or n.heading, up.marks or n.marks
    gone, combined = [False] * len(nodes), [1.0] * len(nodes)
    for k, n in enumerate(nodes):
        mean = n.worth / n.size if n.size else 1.0
        combined[k] = mean if k == 0 else mean * combined[n.up] ** DRAWN
        prior = n.prior
        if n.header and nodes[n.up].mark and n.heading or n.name in WRAPPERS and (n.marks or 2 * n.size > nodes[0].size):
            prior = 1.0
        gone[k] = n.silent or gone[n.up] or prior < 1 and prior * mean < least
    return gone, combined


def _main_blocks(nodes: list[Node], blocks: list, gone: list[bool]) -> list:
    """The blocks outside cut branches; those of the main element or of the articles alone, where they count."""
    left = [b for b in blocks if not gone[b[0]]]
    most = max((nodes[at].mark for at, _, _ in left), default=0)
    marked = [b for b in left if most and nodes[b[0]].mark == most]
    if most == 1 and 2 * sum(len(b[2]) for b in marked) < sum(len(b[2]) for b in left):
        marked = []
    return marked or left


def main_text(page: str | None, importance: dict | None = None, least_importance: float = 0.3, least_main: float = 0.1) -> str:
    """The page's main text; importance has the own importance of nodes of its host's tree, others have 1."""
    if not page:
        return ""
    nodes, blocks = read_page(page)
    gone, combined = _cut_branches(nodes, blocks, importance or {}, least_importance)
    kept = []
    for at, block, text in _main_blocks(nodes, blocks, gone):
        n = nodes[block]
        if _own(n) == -1 or combined[block] >= (least_main if n.mark else least_importance):
            kept.append(text)
    return "\n".join(kept)


def blocks_of(page: str):
    """(node, lies in a branch that its names cut, lies in a main branch, text) of each text block, and layouts as (node, children)."""
    nodes, blocks = read_page(page)
    gone, _ = _cut_branches(nodes, blocks, {}, 0.3)
    said = [(_own(nodes[block]), gone[at], nodes[at].mark, text) for at, block, text in blocks]
    return said, [(n.path, xxhash.xxh64_intdigest(" ".join(n.children))) for n in reversed(nodes) if n.children]


def _observed(batches):
    """(host, page, path, main, kind, what): what each node says and how it is laid out.

    page is the hash of the page's texts, for text in a main branch that of the texts in such branches.
    """
    for pdf in batches:
        rows, pages = [], set()
        for host, page in zip(pdf["host"], pdf["html"]):
            key = (host, xxhash.xxh64_intdigest(page or ""))
            if not page or key in pages:
                continue
            pages.add(key)
            blocks, layouts = blocks_of(page)
            keys = [xxhash.xxh64_intdigest("\n".join(text for _, _, main, text in blocks if main or not only)) >> 1 for only in (False, True)]
            rows += {(host, keys[main > 0], path, main > 0, 0, xxhash.xxh64_intdigest(text) >> 1) for path, _, main, text in blocks if path >= 0}
            rows += {(host, keys[0], path, False, 1, children >> 1) for path, children in layouts}
        yield pd.DataFrame(rows, columns=["host", "page", "path", "main", "kind", "what"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, main, seen, importance) of the nodes of each host's merged tree; pages has host and html.

    Pages of a host with the same texts count once, wherever they lie.
    """
    seen = pages.select("host", "html").mapInPandas(_observed, "host string, page long, path long, main boolean, kind int, what long").distinct()
    counts = seen.groupBy("host", "path", "kind", "what").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    total, weighed = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    entropy = F.when(total > 1, (F.log(total) - weighed / total) / F.log(total)).otherwise(1.0)
    by_kind = counts.groupBy("host", "path", "kind").agg(total.alias("seen"), entropy.alias("entropy"), F.max("main").alias("main"))
    says, laid = F.max(F.when(F.col("kind") == 0, F.col("entropy"))), F.max(F.when(F.col("kind") == 1, F.col("entropy")))
    n = F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("seen"))), F.lit(0))
    own = 0.9 * F.coalesce(says, F.lit(1.0)) + 0.1 * F.coalesce(laid, says, F.lit(1.0))
    nodes = by_kind.groupBy("host", "path").agg(F.max("main").alias("main"), n.alias("seen"), own.alias("own"))
    return nodes.select("host", "path", "main", "seen", ((F.col("own") * F.col("seen") + DOUBT) / (F.col("seen") + DOUBT)).alias("importance"))


def _with_host_nodes(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """pages with the packed nodes of their host. They go to all executors where they are small enough, and so no
    page is moved; otherwise both are dealt by host, the hosts of many pages (at most HOT_HOSTS) over several tasks."""
    if (tree.agg(F.sum(F.size("paths"))).first()[0] or 0) <= MOST_NODES:
        return pages.join(F.broadcast(tree), "host", "left")
    total = pages.count()
    hot = pages.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_HOSTS > total)
    hot = F.broadcast(hot.select("host", F.ceil(F.col("n") * HOT_HOSTS / total).cast("int").alias("parts")))
    dealt = pages.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("parts", F.lit(1))).cast("int"))
    copies = tree.join(hot, "host", "left").select("host", "paths", "worths", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(copies, ["host", "part"], "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.3, least_main: float = 0.1) -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. A
    null or empty page has an empty text, and so has one that says only what all pages of its host say. A null url
    belongs to the host of pages without one. Branches and nodes of an importance below least_importance go, nodes in an
    article or main below least_main only; equal importances are treated alike. Null and repeated ids are pages like any
    other. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    nodes = F.array_sort(F.collect_list(F.struct("path", "importance")))
    tree = style_tree(p).filter("importance < 1").groupBy("host").agg(nodes.alias("nodes"))
    tree = materialize(tree.select("host", F.col("nodes.path").alias("paths"), F.col("nodes.importance").alias("worths")))

    @F.pandas_udf("string")
    def text_of(page: pd.Series, host: pd.Series, paths: pd.Series, worths: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, h, p, w in zip(page, host, paths, worths):
            if h not in known:
                known[h] = {} if p is None else dict(zip(p.tolist(), w.tolist()))
            out.append(main_text(x, known[h], least_importance, least_main))
        return pd.Series(out, dtype=object)

    found = _with_host_nodes(p, tree).select("id", "url", text_of("html", "host", "paths", "worths").alias("text"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
