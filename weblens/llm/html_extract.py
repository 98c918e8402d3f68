"""Main text of web pages by consensus paths of their hosts.

First, each page's containers are scored by the text of their paragraphs, less links and by what their names say. A container's
path is that of the tags and classes above it, without digits. A page votes for the path of its best container, and tells
which other paths it has. Spark counts both for each host: a path that wins wherever it stands is the host's main text,
one that stands on all pages and wins on a few is not. Then each page is read again, and its text comes from the
containers on the one of its paths that wins most reliably on its host; a page without such a path uses its own best container.

Pages are parsed, scored and read with explicit stacks in one pass each, whatever their depth and however they are broken.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import map_rows, materialize

#: Share of its host's pages on which a path must win to be tried on other pages. So a host has 1 / SUPPORT paths at most, and
#: the pages of a rarer template use their own best containers.
SUPPORT = 0.01
#: Hosts up to which their paths are sent to all tasks; beyond that, pages are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: Steps of a path that are spelled out; those above them are hashed.
STEPS = 24

#: What follows the name of a tag, quoted values with their signs, up to its end.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NAME = re.compile(r"[a-z]+")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template textarea svg iframe canvas object math button select option"
    " input menu dialog head audio video map".split()
)
RAW = frozenset("script style noscript template textarea svg iframe canvas object math".split())
CONTAINERS = frozenset("article main section div td body center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An item is ended by the next one unless one of these stands between them; a cell, by the next cell or row of its table.
SCOPES = BLOCK - {"div", "p", "address"}
TABLE = frozenset("table tr td th".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
# Words in class, id and role that tell what an element is for.
NOT_MAIN = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies"
    " consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup share sharing"
    " social related recommended recommendations comment comments commentlist disqus discussion replies reply respond sidebar aside breadcrumb"
    " breadcrumbs menu nav navbar navigation navigationbar topbar footer foot masthead header pagination pager widget widgets toolbar"
    " skip complementary contentinfo search login tags taglist outbrain taboola paywall".split()
)
MAIN = frozenset("article content main post entry body story text page blog prose".split())


@dataclass(slots=True)
class Node:
    """An element. block, scope, table and container are the nearest such elements, itself included; inline counts open tags in a block."""

    tag: str
    names: frozenset[str] = frozenset()
    label: str = ""
    parent: Node | None = None
    hidden: bool = False
    children: list = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    key: int = 0
    block: Node | None = None
    scope: Node | None = None
    table: Node | None = None
    container: Node | None = None
    inline: Counter | None = None

    def path(self) -> str:
        """The last STEPS blocks down to this one, after a hash of all above them."""
        steps, here = [], self.block
        while here is not None and here.tag and len(steps) < STEPS:
            steps.append(here.label)
            here = here.parent.block if here.parent else None
        above = f"#{here.key:016x}" if here is not None and here.tag else ""
        return above + "".join(reversed(steps))


class _Tree:
    """Builds the tree. No step climbs past elements that it doesn't close."""

    def __init__(self):
        root = Node("", inline=Counter())
        root.block = root.scope = root.container = root
        self.root = self.here = root
        self.open: Counter = Counter()

    def close(self, node: Node) -> None:
        """End `node` and all that is open in it."""
        while True:
            here = self.here
            if here.tag in BLOCK:
                self.open[here.tag] -= 1
            else:
                here.block.inline[here.tag] -= 1
            self.here = here.parent
            if here is node:
                return

    def end(self, tag: str) -> None:
        # A closing tag doesn't reach out of the block that it stands in, unless it is one itself.
        if not (self.open[tag] if tag in BLOCK else self.here.block.inline[tag]):
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self.close(node)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag not in ("html", "body") and self.here.block.tag == "p":
                self.close(self.here.block)
            scope = self.here.scope
            if (tag == "li" and scope.tag == "li") or (tag in ("dt", "dd") and scope.tag in ("dt", "dd")):
                self.close(scope)
            elif tag in ("tr", "td", "th"):
                cell = self.here.table
                if cell is not None and cell.tag in ("td", "th"):
                    self.close(cell)
                    cell = self.here.table
                if tag == "tr" and cell is not None and cell.tag == "tr":
                    self.close(cell)
        node = _element(tag, attributes, self.here)
        self.here.children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            self.here = node
            if tag in BLOCK:
                self.open[tag] += 1
            else:
                node.block.inline[tag] += 1


def parse(source: str) -> Node:
    """A tree of elements and decoded texts. Unclosed and misplaced tags are read as browsers mostly do.

    A tag without an end is text. Where a quoted value has no end, tags from there on end at the next ">".
    """
    tree, at, begun = _Tree(), 0, 0
    last, quoted = source.rfind(">"), True

    def text(upto: int) -> None:
        if upto > begun:
            tree.here.children.append(source[begun:upto])

    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            after = end + 3 if end >= 0 else len(source)
            text(at)
        elif at > last:
            break
        elif source.startswith(("<!", "<?"), at):
            after = source.index(">", at) + 1
            text(at)
        elif (m := _TAG.match(source, at)) is None:
            at += 1
            continue
        else:
            rest = _REST.match(source, m.end()) if quoted else None
            if quoted and rest is None:
                quoted = False
            after = rest.end() if rest else source.find(">", m.end()) + 1
            text(at)
            tag, attributes = m.group(1).lower(), source[m.end() : after - 1]
            if source[at + 1] == "/":
                tree.end(tag)
            elif tag in RAW:
                if not (attributes.endswith("/") and tag in ("svg", "math")):
                    end = _RAW_END[tag].search(source, after)
                    after = end.end() if end else len(source)
                tree.here.children.append("")
            else:
                tree.start(tag, attributes)
        at = begun = after
    text(len(source))
    return tree.root


def _element(tag: str, attributes: str, parent: Node) -> Node:
    names, label, hidden = [], "", False
    if attributes and not attributes.isspace():
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role"):
                value = value.strip("\"'").lower()
                names += _NAME.findall(value)
                if key == "class" or not label:
                    label = re.sub(r"[\d\s]+", " ", value).strip().split(" ")[0]
            elif key == "hidden" or (key == "aria-hidden" and "true" in value):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    node = Node(tag, frozenset(names), "", parent, hidden)
    node.block, node.scope, node.table, node.container = parent.block, parent.scope, parent.table, parent.container
    if tag in BLOCK:
        node.label = f">{tag}{'.' + label if label else ''}"
        node.key = xxhash.xxh3_64_intdigest(node.label, seed=parent.block.key)
        node.block, node.inline = node, Counter()
    if tag in SCOPES:
        node.scope = node
    if tag in TABLE:
        node.table = node
    if tag in CONTAINERS or tag == "html":
        node.container = node
    return node


def _aside(node: Node, inside: bool) -> bool:
    """Whether the element is no part of an article. `inside` a container, a header may hold the heading."""
    if node.hidden or node.tag in DROPPED:
        return True
    if node.tag in ("article", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "p"):
        return node.tag in ("p", "article") and bool(node.names & NOT_MAIN) and not node.names & MAIN
    if node.tag == "header":
        return not inside
    return bool(node.names & NOT_MAIN) and not (node.names & MAIN and not node.names & {"comment", "comments", "sidebar", "ad", "ads"})


def _shown(root: Node) -> list[tuple[Node, bool]]:
    """(element, whether it stands in a link) of all elements that may be part of an article, in page order."""
    out, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        out.append((node, linked))
        todo += [(c, linked or c.tag == "a") for c in reversed(node.children) if not isinstance(c, str) and not _aside(c, False)]
    return out


def _weigh(shown: list[tuple[Node, bool]]) -> None:
    """Characters in each element, those in links, and the score of containers from the paragraphs in them."""
    for node, linked in reversed(shown):
        own = 0
        for child in node.children:
            if isinstance(child, str) and not child.isspace():
                n = len(child) - child.count(" ") if len(child) < 64 else len(child)
                own += len(child)
                node.chars += n
                node.linked += n if linked else 0
        if node.tag in ("p", "pre", "blockquote", "li", "dd", "h1", "h2", "h3") and node.chars > 1:
            worth = (node.chars - node.linked) * (0.5 if node.tag == "li" else 1.0)
            up, share = node.parent.container, 1.0
            while share > 0.1:
                up.score += worth * share
                share *= 0.5
                if up.parent is None:
                    break
                up = up.parent.container
        elif node.tag in CONTAINERS:
            node.score += max(0, own - node.linked)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _ranked(shown: list[tuple[Node, bool]]) -> list[tuple[float, Node]]:
    """Containers that have a score, best first."""
    _weigh(shown)
    out = []
    for node, _ in shown:
        if node.tag in CONTAINERS and node.score > 0:
            factor = 1.0 - node.linked / max(1, node.chars)
            factor *= 1.5 if node.tag in ("article", "main") else 1.25 if node.names & MAIN else 1.0
            out.append((node.score * factor, node))
    return sorted(out, key=lambda x: -x[0])


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    part: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(part)).split())
        if text:
            out.append(text)
        part.clear()

    todo: list = [(c, False) for c in reversed(node.children)]
    while todo:
        child, in_header = todo.pop()
        if child is None:
            end()
        elif isinstance(child, str):
            if not in_header:
                part.append(child)
        elif child.tag == "br":
            part.append(" ")
        elif not _aside(child, True):
            header = child.tag == "header" or (in_header and child.tag not in HEADINGS)
            if child.tag in BLOCK:
                end()
                todo.append((None, False))
            todo += [(c, header) for c in reversed(child.children)]
    end()
    return out


def page_paths(source: str) -> tuple[str | None, set[str]]:
    """(path of the page's best container, paths of all its containers that have a score)."""
    ranked = _ranked(_shown(parse(source)))
    return (ranked[0][1].path() if ranked else None), {node.path() for _, node in ranked}


def extract(source: str, paths: list[str]) -> str:
    """The page's main text, from its containers on the first of `paths` that has text here."""
    root = parse(source)
    shown = _shown(root)
    if paths:
        wanted = set(paths)
        found: dict[str, list[Node]] = {}
        for node, _ in shown:
            if node.tag in CONTAINERS and (path := node.path()) in wanted:
                found.setdefault(path, []).append(node)
        for path in paths:
            blocks = [b for node in found.get(path, ()) for b in _blocks(node)]
            if blocks:
                return " ".join(blocks)
    ranked = _ranked(shown)
    return " ".join(_blocks(ranked[0][1] if ranked else root))


def _host(column: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(column).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, paths): the paths that win on a share of `support` of the host's pages or more, the most reliable first.

    A path's reliability is the share of the pages that have it on which it wins, one more page counted against it.
    """

    def make():
        def step(rows):
            wins, seen = Counter(), Counter()
            for host, source in zip(rows["host"], rows["html"], strict=True):
                best, present = page_paths(source or "")
                wins[host, best] += best is not None
                seen.update((host, path) for path in present)
            keys = list(seen)
            return {
                "host": [h for h, _ in keys],
                "path": [p for _, p in keys],
                "wins": [wins[k] for k in keys],
                "seen": [seen[k] for k in keys],
            }

        return step

    named = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    counted = map_rows(named, ["host", "html"], make, "host string, path string, wins long, seen long", text="html")
    summed = materialize(
        counted.groupBy("host", "path").agg(F.sum("wins").alias("wins"), F.sum("seen").alias("seen")).where("wins > 0"), "host-votes"
    )
    voted = summed.groupBy("host").agg(F.sum("wins").alias("pages"))
    kept = summed.join(voted, "host").where(F.col("wins") >= support * F.col("pages"))
    order = F.struct((-F.col("wins") / (F.col("seen") + 1)).alias("r"), (-F.col("wins")).alias("w"), "path")
    return kept.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    White space inside a block is one blank, and blocks are joined by one blank in page order. A null or empty html has an empty text. A
    null url counts as a host of its own. Repeated rows get equal results; an empty table gives no rows. Only page_id, url and html are read.
    """
    won = materialize(host_paths(pages), "host-paths")
    few = won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        _host().alias("host"),
    )
    joined = named.join(F.broadcast(won) if few else won, "host", "left").select("page_id", "url", "html", "paths")

    def make():
        def step(rows):
            texts = [extract(s or "", p or []) for s, p in zip(rows["html"], rows["paths"], strict=True)]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

        return step

    return map_rows(joined, ["page_id", "url", "html", "paths"], make, "page_id long, url string, text string, n_chars long", text="html")
