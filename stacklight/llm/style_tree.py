"""Main-text extraction by a site style tree.

The DOMs of a host are merged: a node of the tree is a place, that of an element in the sequence of child labels (tag, classes, id
without digits) which its parent's node shows, so equal labels at different places are different nodes; a run of paragraphs, list
items, cells and the like is one place. A node keeps, over the host's pages, how often each presentation (its own sequence of child
labels) and each content (a hash of the branch, the host's own name left out) occurs. Equal pages of a host count once. A node in m
pages has
    presentation importance  p = - sum of q log_m q  over its presentations, q being their shares,
    content importance       c = 1 - mean of log_m n over its different contents, n being the pages that show each,
and importance c + (1 - c) GAMMA p; in one page only it is 1. Every different content counts once, so a text that many pages copy
doesn't lower its node, while a template's few texts do. A host of few pages says little: the importance of a node is its mean, by
pages, with that of the place in the tree of all hosts (ALL_PAGES pages at most; what is missing comes from the nodes with the same
path of labels), and with 1 (PRIOR_PAGES pages).

One rule decides on every branch: importance times a weight, under LEAST, cuts it. Tags, roles and names give the weight: NOISE for
menus, headers, footers, sidebars and the like; MAIN for what lies in <article> or <main> directly, so that it takes a very low
importance to cut it; BESIDE for other branches of a page that has such an element; else 1. Where the tree knows a node, from
KNOWN_PAGES pages or more, the weights only shift its verdict: noise of full importance stays, an unnamed branch of low importance
goes. Where it doesn't, they suffice to cut. What differs from page to page as articles do, no entropy tells: comments, related
links and forms (SURE) and hidden elements are cut by their names at any rate. A branch is never cut where it holds an article, half
of what the article has, or all the text that the page has left. Names count with care: a class must consist of noise words and
words of place ("notice-box", not "related-work" or "with-sidebar") and stand on a container (div, section, list, table), never on a
heading, paragraph or <article>; inside an article only words that are no likely topic count. An id counts outside articles only,
on a div, list or table, by words of a site's frame. If a page without <article> or <main> is left empty by its names, they don't
count on it.

Blocks are flushed at block-level tags; references are decoded, white space in a block (no-break spaces and <br> included)
becomes one space, blocks are joined by an empty line.

Cases: null and empty html give an empty text; null urls are one host; broken markup (unclosed tags and comments, stray end
tags, unquoted attributes) is read leniently, in time linear in the page however deep its elements lie; repeated rows each get their
text; an empty table gives no rows; further columns are ignored. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

GAMMA, LEAST, ALL_PAGES, PRIOR_PAGES, KNOWN_PAGES = 0.1, 0.85, 100, 25, 100
#: Weights of what the tree knows, which shift its verdict, and of what it doesn't know, which are one.
NOISE_WEIGHT, MAIN_WEIGHT, BESIDE_WEIGHT = 0.9, 1.5, 0.95
UNKNOWN_NOISE, UNKNOWN_BESIDE = 0.5, 0.8
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MARKS = re.compile(r"[.#\[]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag ends an open element of these kinds, unless one of the stops lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("nav aside footer form dialog menu button search fieldset head".split())
NOISE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names: of noise whatever it holds, and of noise unless an article stands inside.
HARD = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer comment comments reply replies respond disqus discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login pagination pager copyright cookie cookies consent gdpr advert adverts advertisement ad ads adsbygoogle adslot sponsor sponsored promo promotion form search".split())
SOFT = frozenset("header masthead banner sidebar aside widget notice notices alert popup modal overlay toolbar topbar bottombar disclaimer skip hidden".split())
#: Words that don't change what a class names, those that may be a topic of an article, and those that an id needs.
#: Names and tags of what differs from page to page as articles do, so that no entropy tells it.
SURE = frozenset("comment comments reply replies respond disqus discussion related recommended recommendations form search".split())
SURE_TAGS = frozenset("form dialog button search".split())
PLACE = frozenset("area bar bottom box block buttons col column container content footer group inner item items left links list main outer page panel right section site top wrap wrapper".split())
TOPIC = frozenset("ad ads header form search discussion related recommended recommendations share sharing social promotion copyright cookie cookies consent replies respond alert hidden skip widget subscription login signup notices disclaimer".split())
FRAME = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead banner sidebar disqus pagination pager toolbar topbar bottombar".split())
CONTAINERS = frozenset("div section aside ul ol dl table tbody tr td center details".split())
MAIN = frozenset(("article", "main"))
NONE, IS_MAIN, NOISE = 0, 1, 2
ROOT_PATH = 0
#: Of the polynomial hash of a sequence of texts.
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def named(names: list[str], words: frozenset[str]) -> bool:
    """Whether one of the names consists of these words and words of place."""
    split = [{w.lower() for w in WORD.findall(x)} for x in names]
    return any(w & words and w <= words | PLACE for w in split)


@lru_cache(65_536)
def label(tag: str, attributes: str, inside: bool = False, names: bool = True) -> tuple[str, bool, bool, bool]:
    """The node label, and whether the element is noise whatever it holds, or unless it holds an article, and whether the tree can't
    tell. inside: an article; names: whether class and id count."""
    if not attributes.strip(" /\n\t"):
        return tag, tag in NOISE_TAGS, tag == "header", tag in SURE_TAGS
    a = {k.lower(): unescape(d or s or b) for k, d, s, b in ATTRIBUTE.findall(attributes)}
    classes, ident, role = a.get("class", "").split(), a.get("id", ""), a.get("role", "").lower()
    gone = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)
    hard, soft = tag in NOISE_TAGS or role in NOISE_ROLES or bool(gone), tag == "header" or role == "banner"
    sure = bool(gone) or tag in SURE_TAGS or role in SURE_TAGS
    if names and tag in CONTAINERS:
        topic = TOPIC if inside else frozenset()
        ids = [ident] if ident and not inside and tag != "section" else []
        hard = hard or named(classes, HARD - topic) or named(ids, HARD & FRAME)
        soft = soft or named(classes, SOFT - topic) or named(ids, SOFT & FRAME)
        sure = sure or named(classes, SURE - topic) or named(ids, SURE & FRAME)
    marks = "".join(f".{re.sub('[0-9]+', '', c)}" for c in sorted(classes)) + (f"#{re.sub('[0-9]+', '', ident)}" if ident else "")
    return tag + marks + ("[main]" if role == "main" else ""), hard, soft, sure


def digest(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


@lru_cache(65_536)
def below(trail: int, name: str) -> int:
    """The trail, a path of labels, of a child with this label."""
    return digest(struct.pack("<q", trail) + name.encode("utf-8", "surrogatepass"))


class Node:
    """An element. block: the innermost element at block level, itself included; first, last: its texts in the page's list;
    begin, end: the elements at block level from it to its last descendant."""

    __slots__ = ("begin", "block", "children", "cut", "end", "first", "hard", "kind", "last", "main", "name", "path", "shown", "soft", "sure", "tag", "trail", "up")

    def __init__(self, tag, name, up, hard, soft, sure=False):
        self.tag, self.up = tag, up.block if up else None
        self.name, self.path, self.trail = name, ROOT_PATH, ROOT_PATH
        is_main = tag in MAIN or name.endswith("[main]")
        self.hard, self.sure = hard or bool(up and up.hard), sure or bool(up and up.sure)
        own_main = is_main and not self.hard
        inside = bool(up and up.main)
        # a header inside an article holds its title
        self.soft = False if own_main and not soft else bool(up and up.soft) or (soft and not (inside and tag == "header" and name == "header"))
        self.main = not self.hard and not self.soft and (own_main or inside)
        marked = "." in name or "#" in name
        self.kind = NOISE if self.hard or self.soft else IS_MAIN if self.main and (own_main or not marked and up.kind == IS_MAIN) else NONE
        self.block = self if tag in BLOCK or up is None else up.block
        self.children, self.cut = [], False


def parse(html: str, names: bool = True) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The page's blocks (node, text) in order, and its elements at block level, parents first."""
    root = Node("#root", "", None, False, False)
    stack, nodes, out, buffer = [root], [], [], []
    places: dict[str, list[int]] = {}  # where on the stack each tag is open
    unclosed: set[str] = set()

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            inner = stack[-1]
            node = inner.block
            out.append((node if inner.hard == node.hard and inner.soft == node.soft else inner, text))

    def push(node):
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)
        if node.block is node:
            node.first, node.begin = len(out), len(nodes)
            nodes.append(node)

    def close(i):
        if any(n.block is n for n in stack[i:]):
            flush()
        while len(stack) > i:
            node = stack.pop()
            places[node.tag].pop()
            node.last, node.end = len(out), len(nodes)

    def last(tags):
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    while True:
        m = TOKEN.search(html, at)
        start = m.start() if m else len(html)
        if start > at:
            piece = html[at:start]
            buffer.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if i := last((tag,)):
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not stop:
                unclosed.add(tag)
            at = stop.end() if stop else (len(html) if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in BLOCK:
            i = last(("p",))
            close(i) if i else flush()
        if tag in CLOSES:
            kinds, stops = CLOSES[tag]
            if (i := last(kinds)) > last(stops):
                close(i)
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            continue
        up = stack[-1]
        name, hard, soft, sure = label(tag, attributes, up.main, names)
        if tag in BLOCK:
            up.block.children.append(name)
        push(Node(tag, name, up, hard, soft, sure) if tag in BLOCK or hard or soft or attributes else _inline(tag, up))
    flush()
    close(1)
    root.first, root.begin, root.last, root.end = 0, 0, len(out), len(nodes)
    return out, nodes


def _inline(tag: str, up: Node) -> Node:
    n = Node.__new__(Node)
    n.tag, n.up, n.name, n.hard, n.sure, n.soft, n.main, n.kind, n.block, n.children, n.cut = tag, up.block, tag, up.hard, up.sure, up.soft, up.main, up.kind, up.block, [], False
    return n


#: Elements of a text's own flow, whose number varies with it: a run of one label is one place.
FLOW = frozenset("p li dt dd tr td th blockquote pre h2 h3 h4 h5 h6 option figure".split())


def place(nodes: list[Node]) -> None:
    """Gives each element its style node: its place in the sequence of children that its parent shows."""
    free: dict[int, list[int]] = {}

    def show(n: Node) -> None:
        shown: list[str] = []
        slots = []
        for c in n.children:
            if not shown or c != shown[-1] or MARKS.split(c, 1)[0] not in FLOW:
                shown.append(c)
            slots.append(len(shown) - 1)
        n.shown = digest(",".join(shown).encode("utf-8", "surrogatepass"))
        free[id(n)] = slots[::-1]

    for n in nodes:
        up = n.up
        if id(up) not in free:  # the page itself
            show(up)
        n.path = digest(struct.pack("<qqq", up.path, up.shown, free[id(up)].pop()))
        n.trail = below(up.trail, n.name)
        show(n)


def contents(blocks: list[tuple[Node, str]], nodes: list[Node], own: str = "") -> dict[int, list[int]]:
    """Of each style node: a hash of the texts below it. The host's own name in a text doesn't tell it from that of another host."""
    prefix = [0]
    for _, text in blocks:
        text = text.replace(own, "") if own else text
        prefix.append((prefix[-1] * FACTOR + digest(text.encode("utf-8", "surrogatepass"))) & MASK)
    power = [1]
    for _ in blocks:
        power.append(power[-1] * FACTOR & MASK)
    found: dict[int, list[int]] = {}
    for n in nodes:
        found.setdefault(n.path, []).append((prefix[n.last] - prefix[n.first] * power[n.last - n.first]) & MASK)
    return found


def page_nodes(html: str, own: str = "") -> list[tuple[int, int, int, int, int]]:
    """The page's style nodes: page (the same for equal pages), path (the place), trail (its labels), presentation, content. own: the
    host's name."""
    blocks, nodes = parse(html)
    place(nodes)
    shown: dict[int, dict[int, None]] = {}
    trails: dict[int, int] = {}
    for n in nodes:
        shown.setdefault(n.path, {})[n.shown] = None
        trails[n.path] = n.trail
    texts = contents(blocks, nodes, own)
    rows = [(p, trails[p], digest(repr(list(a)).encode()), digest(repr(texts[p]).encode())) for p, a in shown.items()]
    page = digest(repr((rows, [t for _, t in blocks])).encode("utf-8", "surrogatepass"))
    return [(page, *r) for r in rows]


def page_text(html: str, importance: dict[int, float], least: float = LEAST) -> str:
    """The page's main text; importance: of the nodes that its host's tree knows; what is left out is unknown."""
    blocks, nodes = parse(html)
    place(nodes)
    size, mains = [0], [0]
    for n, t in blocks:
        size.append(size[-1] + len(t) * (n.kind != NOISE))
    for n in nodes:
        mains.append(mains[-1] + n.main)
    article = sum(len(t) for n, t in blocks if n.main)
    noise = lambda n: n.sure or n.block is not n or n.path not in importance
    for n in nodes:
        known = n.path in importance
        if n.kind == NOISE:
            weight = UNKNOWN_NOISE if n.sure or not known else NOISE_WEIGHT
        elif n.kind == IS_MAIN:
            weight = MAIN_WEIGHT
        else:
            weight = (BESIDE_WEIGHT if known else UNKNOWN_BESIDE) if mains[-1] and not n.main else 1.0
        low = importance.get(n.path, 1.0) * weight < least
        holds = mains[n.end] > mains[n.begin] if not n.main else 2 * (size[n.last] - size[n.first]) >= article
        n.cut = bool(n.up and n.up.cut) or (low and (n.kind == NOISE or not holds))
    # text beside an article in what holds both belongs to neither
    apart = lambda n: mains[-1] and not n.main and mains[n.block.end] > mains[n.block.begin]
    chosen = [t for n, t in blocks if not n.block.cut and not apart(n) and not (n.kind == NOISE and noise(n))]
    if not chosen:
        # all is of low importance: what names don't cut stays
        chosen = [t for n, t in blocks if n.kind != NOISE and (n.main or not article)]
    if not chosen and not mains[-1]:
        chosen = [t for n, t in parse(html, names=False)[0] if n.kind != NOISE]
    return "\n\n".join(chosen)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def counted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, path, trail, side, value, n: in how many different pages of the host the node shows each presentation (side 0) and each
    content (side 1)."""

    def run(batches):
        for b in batches:
            rows = [(h, *n) for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) if t for n in page_nodes(t, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 5))], names=["host", "page", "path", "trail", "shown", "content"])

    nodes = pages.select(host(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, page long, path long, trail long, shown long, content long").distinct()
    # two counts by one aggregation
    sides = nodes.select("host", "path", "trail", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("shown").alias("value")), F.struct(F.lit(1).alias("side"), F.col("content").alias("value")))))
    return sides.groupBy("host", "path", "trail", "side", "value").agg(F.count(F.lit(1)).alias("n"))


def merged(counts: DataFrame, *by: str) -> DataFrame:
    """by, pages, importance of each node of the trees that counts (by, side, value, n) give."""
    shown, content, n = F.col("side") == 0, F.col("side") == 1, F.col("n")
    per = counts.groupBy(*by).agg(F.sum(F.when(shown, n)).alias("pages"), F.sum(F.when(shown, n * F.log("n")).otherwise(0.0)).alias("p"), F.avg(F.when(content, F.log("n"))).alias("c"))
    m, lm = F.col("pages"), F.log("pages")
    # - sum q log_m q = 1 - sum n ln n / (m ln m)
    p, c = F.when(m > 1, 1 - F.col("p") / (m * lm)).otherwise(1.0), F.when(m > 1, 1 - F.col("c") / lm).otherwise(1.0)
    return per.select(*by, "pages", (c + (1 - c) * GAMMA * p).alias("importance"))


def style_tree(counts: DataFrame) -> DataFrame:
    """host, path, importance, seen (the pages that it comes from) of each node of each host's tree, from counted(): backed by the place
    in the tree of all hosts, and as far as that has less than ALL_PAGES pages, by the trail of labels in it."""
    own = merged(counts, "host", "path", "trail")

    def every(key):
        per = merged(counts.groupBy(key, "side", "value").agg(F.sum("n").alias("n")), key)
        return materialize(per.select(key, F.col("pages").alias(f"{key}_pages"), F.col("importance").alias(f"{key}_all")), "style-all")

    both = own.join(every("path"), "path").join(every("trail"), "trail")
    m, a = F.col("pages"), F.least(F.lit(ALL_PAGES), F.col("path_pages") - F.col("pages"))
    b = F.least(F.lit(ALL_PAGES) - a, F.col("trail_pages") - F.col("path_pages"))
    mean = (m * F.col("importance") + a * F.col("path_all") + b * F.col("trail_all") + F.lit(PRIOR_PAGES)) / (m + a + b + F.lit(PRIOR_PAGES))
    return both.select("host", "path", mean.alias("importance"), (m + a + b).alias("seen"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    counts = materialize(counted(pages, html, url), "style-counts")
    # nodes that the tree knows, and those of low importance; what is left out is unknown
    known = style_tree(counts).where((F.col("seen") >= KNOWN_PAGES) | (F.col("importance") < least))
    trees = materialize(known.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("tree")), "style-trees")

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("html", "tree")]
            texts = [page_text(t, {x["path"]: x["importance"] for x in c or ()}, least) if t else "" for t, c in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))
    return rows.join(trees, "host", "left").select("page_id", "url", "html", "tree").mapInArrow(run, "page_id long, url string, text string, n_chars long")
