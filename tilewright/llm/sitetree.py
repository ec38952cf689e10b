"""Main text of web pages with a site style tree.

The DOMs of a host are merged: nodes with the same path of tags and classes are one element of the
style tree. An element knows, over the distinct pages of its host, the styles (sequences of child
elements) and the texts that it had. Its importance is the entropy of both, as a part of the largest
possible entropy: a menu that is the same on every page has 0, an article 1. Elements of low importance
are noise and go with their branch. The tree over all hosts counts besides with up to 20 pages, so the fewer
pages a host has, the more the others decide; one rule holds for hosts of any size.

Some elements need no statistics: scripts, styles, menus, headers, footers, sidebars and forms go by
their tag. A class, id or role that names such a thing makes a branch a suspect, which goes unless it
holds the article. Where a page has an ``article`` or ``main``, what lies outside it goes; of several articles
the leading one and those built like it stay, so reader comments marked up as articles go, as does what
follows a heading of comments. Inside an article the tree decides as long as it leaves a paragraph.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import stored
from tilewright.llm.urls import host_and_path, looked_up

#: Pages that the tree of all hosts counts beside a host's own; importance below which a branch goes.
PAGES, IMPORTANCE = 20, 0.35
#: Levels of the style tree; what lies deeper belongs to its ancestor at that level.
DEPTH = 48
#: Paths that never go: the page itself, and what stands in its head.
OUTSIDE = r"^(/html(\.[^/]*)?)?(/(head|title|meta|link|base|script|style|noscript)(\.[^/]*)?(/.*)?)?$"

#: Names of elements.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
NOISE = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
)
BODY = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARAGRAPHS = ("p", "li", "blockquote", "pre", "dd", "td")
#: What a class, id or role may say.
NOISE_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager",
    "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search",
)

#: Parts of a class or id that tell a state of the page, not what the element is.
STATES_BEFORE = ("with", "no", "has", "without", "is", "not", "hide", "show")
STATES_AFTER = ("enabled", "disabled", "open", "closed", "on", "off", "true", "false", "active", "visible", "hidden")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")
_COMMENTS = re.compile(
    r"\W*(\d+\s+)?(reader |user |leave a |post a |add a |your |all )?(comments?|repl(y|ies)|responses|kommentare?|leserkommentare|commentaires?|comentarios?)(\s*\(\d+\))?\W*", re.I
)
_raw, _void, _noise, _inline, _words = map(frozenset, (RAW, VOID, NOISE, INLINE, NOISE_WORDS))
_before, _after, _paragraphs = map(frozenset, (STATES_BEFORE, STATES_AFTER, PARAGRAPHS))
#: An opening tag ends the open elements named behind it, up to the nearest container.
_CLOSES = {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_CONTAINERS = frozenset("body article main div section ul ol dl table nav header footer aside form blockquote td th li".split())


class Node:
    """``noise``: goes; ``named``: a class, id or role names noise; ``letters`` and ``head`` (2 with an h1,
    1 with an h2 or h3) speak of the whole branch."""

    __slots__ = ("tag", "name", "children", "noise", "named", "letters", "head")

    def __init__(self, tag: str, name: str, noise: bool, named: bool = False):
        self.tag, self.name, self.noise, self.named = tag, name, noise, named
        self.children: list[Node | str] = []
        self.letters = self.head = 0


def names_noise(said: str) -> bool:
    """Whether a class, id or role names noise; states such as ``no-comments`` or ``with-sidebar`` do not."""
    for token in _PART.findall(said):
        parts = re.split("[-_]+", token)
        if len(parts) > 1 and (parts[0] in _before or parts[-1] in _after):
            continue
        if not _words.isdisjoint(parts):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree. Unclosed elements end with their container, and unknown end tags are ignored."""
    root = Node("", "", False)
    stack, at = [root], 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return judged(root)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _CONTAINERS and tag not in _CONTAINERS and tag not in ("body", "html"):
                    break
            continue
        ends = _CLOSES.get(tag) or (frozenset({"p"}) if tag in _ENDS_P else None)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in _CONTAINERS:
                    break
        said = " ".join(x for g in _ATTR.findall(m[3]) for x in g[1:] if x).lower() if "=" in m[3] else ""
        words = set(_WORD.findall(said)) if said else ()
        named = bool(said) and tag not in ("body", "html", "main") and names_noise(said)
        node = Node(tag, f"{tag}.{' '.join(sorted(words))}" if words else tag, tag in _noise or tag in _raw, named)
        stack[-1].children.append(node)
        if tag in _raw:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _void and not m[3].rstrip().endswith("/"):
            stack.append(node)


def _plain(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n.children))
    return " ".join(" ".join(out).split())


def _has(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            return True
        todo += [c for c in n.children if not isinstance(c, str)]
    return False


def _without_comments(node: Node) -> None:
    """Drops what follows a heading of comments among its siblings, up to a heading as high or an h1 or ``main``."""
    level, kept = 0, []
    for c in node.children:
        if level and not isinstance(c, str) and _has(c, ("h1", "main")):
            level = 0
        if not isinstance(c, str) and c.tag in HEADINGS:
            here = int(c.tag[1])
            if level and here <= level:
                level = 0
            if not level and here > 1 and _COMMENTS.fullmatch(_plain(c)):
                level = here
        if not level:
            kept.append(c)
    node.children = kept


def judged(root: Node) -> Node:
    """Marks what goes by tag, name or place. A suspect stays if it holds the leading article.

    That is the article with an h1, else the one with fewest suspects around it, else the longest one; in
    ``main``, where there is one. Articles inside an article, and others neither built like the leading one nor
    with a heading as high, are comments or teasers. On a page without such an element a suspect
    stays with an h1 and half of the letters; if nothing is left, the suspects with paragraphs stay.
    """
    found: list[tuple[Node, int, str, int, int, int]] = []  # node, parent, path, suspects, outer article, outer main
    todo: list[tuple[Node, int, str, int, int, int]] = [(root, -1, "", 0, -1, -1)]
    while todo:
        node, up, path, suspects, article, main = row = todo.pop()
        at = len(found)
        found.append(row)
        _without_comments(node)
        suspects += node.named
        article, main = (at if node.tag == "article" else article), (at if node.tag == "main" and main < 0 else main)
        todo += [(c, at, path if len(path) > 4096 else f"{path}/{c.name}", suspects, article, main) for c in reversed(node.children) if not isinstance(c, str) and not c.noise]
    for node, up, *_ in reversed(found):
        node.letters += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.head = max(node.head, {"h1": 2, "h2": 1, "h3": 1}.get(node.tag, 0))
        if up >= 0:
            parent = found[up][0]
            parent.letters, parent.head = parent.letters + node.letters, max(parent.head, node.head)
    mains = {i for i, r in enumerate(found) if r[0].tag == "main" and r[0].letters and r[5] < 0}
    articles = [i for i, r in enumerate(found) if r[0].tag == "article" and r[0].letters and (not mains or r[5] in mains)]
    plain = [i for i in articles if not found[i][0].named] or articles
    rank = lambda i: (found[i][0].head == 2, -found[i][3], found[i][0].letters, -i)
    lead = max(plain or mains, key=rank, default=-1)
    holds, at = set(mains), -1
    for i in {lead, *mains} - {-1}:
        at = i
        while at >= 0 and (at not in holds or at == i):
            holds.add(at)
            at = found[at][1]
    inner: dict[int, int] = {}  # letters of an article that lie in articles inside it
    for i, r in enumerate(found):
        if r[0].tag == "article" and r[4] >= 0:
            inner[r[4]] = inner.get(r[4], 0) + r[0].letters
    for i, (node, _, path, _, outer, main) in enumerate(found):
        if i in holds:
            continue
        if node.named:
            node.noise = lead >= 0 or node.head < 2 or 2 * node.letters < root.letters
        if node.tag == "article" and lead >= 0 and not node.noise:
            first = found[lead]
            if mains and main not in mains:
                node.noise = True
            elif outer >= 0:
                node.noise = node.head < 2 and found[outer][0].letters > inner[outer]
            else:
                node.noise = not (path == first[2] or node.head == 2 or (first[0].head < 2 and node.head == 1 and first[0].tag == "article"))
    if lead < 0 and root.letters:
        left, todo_ = 0, [root]
        while todo_ and not left:
            n = todo_.pop()
            left += sum(len(c.strip()) for c in n.children if isinstance(c, str))
            todo_ += [c for c in n.children if not isinstance(c, str) and not c.noise]
        if not left:
            open_ = set()
            for i in range(len(found) - 1, -1, -1):
                if found[i][0].tag == "p" and found[i][0].letters or i in open_:
                    found[i][0].noise = False
                    open_.add(found[i][1])
    return root


def _below(path: str, depth: int, node: Node) -> str:
    return path if depth > DEPTH else f"{path}/{node.name}"


def elements(root: Node) -> dict[str, tuple[list[str], list[str]]]:
    """Styles and texts by path, without the branches that are noise by name."""
    found: dict[str, tuple[list[str], list[str]]] = {}
    todo = [(root, "", 1)]
    while todo:
        node, path, depth = todo.pop()
        styles, texts = found.setdefault(path, ([], []))
        styles.append(",".join(dict.fromkeys(c.name for c in node.children if not isinstance(c, str))))
        texts.append(" ".join(" ".join(c for c in node.children if isinstance(c, str)).split()))
        todo += [(c, _below(path, depth, c), depth + 1) for c in reversed(node.children) if not isinstance(c, str) and not c.noise and c.tag not in _inline]
    return found


def _body(root: Node) -> list[tuple[Node, str, int]]:
    """The outermost article and main elements that are not noise, or else the whole page."""
    found, todo = [], [(root, "", 1)]
    while todo:
        node, path, depth = todo.pop()
        if node.tag in BODY and node.letters:
            found.append((node, path, depth))
        else:
            todo += [(c, _below(path, depth, c), depth + 1) for c in reversed(node.children) if not isinstance(c, str) and not c.noise]
    return found or [(root, "", 1)]


def _blocks(top: Node, where: str, depth: int, noise: frozenset[str]) -> tuple[list[list[str]], int]:
    """Blocks below ``top`` and the letters of those that are paragraphs."""
    blocks: list[list[str]] = [[]]
    todo: list[tuple[Node | str | None, str, int, bool]] = [(c, where, depth, top.tag in _paragraphs) for c in reversed(top.children)]
    paragraphs = 0
    while todo:
        node, path, level, text = todo.pop()
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            blocks[-1].append(node)
            paragraphs += len(node.strip()) if text else 0
        elif not node.noise:
            flow = node.tag in _inline
            here = _below(path, level, node)
            if not flow and here != path and here in noise:
                continue
            if not flow:
                blocks.append([])
                todo.append((None, path, level, text))
            todo += [(c, here, level + 1, text or node.tag in _paragraphs) for c in reversed(node.children)]
    return blocks, paragraphs


def main_text(page: str | None, noise: frozenset[str] = frozenset()) -> str:
    """The blocks of the main text, one to a line. ``noise``: paths of low importance.

    Where these would take every paragraph of an article, it stays as it is.
    """
    lines = []
    for top, where, depth in _body(parse(page or "")):
        blocks, left = _blocks(top, where, depth, noise)
        if noise and top.tag in BODY and not left:
            whole, paragraphs = _blocks(top, where, depth, frozenset())
            blocks = whole if paragraphs else blocks
        lines += [_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks]
    return "\n".join(x for x in lines if x)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path, n_pages, importance)`` for each element of each host, and of all hosts under a null host.

    Equal pages of a host count once. An element's importance is the mean of the entropies of its
    styles and of its texts, each over the logarithm of the number of pages; 1 on a single page.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _hash(page or "")
                rows += [(host, own, path, _hash("|".join(s)), _hash("|".join(t))) for path, (s, t) in elements(parse(page or "")).items()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "path", "style", "content"])

    rows = pages.select(host_and_path(url)[0], F.col(html)).mapInArrow(walk, "host string, page long, path string, style long, content long")
    once = rows.dropDuplicates(["host", "page", "path"])
    # counts of each value first: a host may hold a third of the pages
    kinds = once.select("host", "path", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("style").alias("value")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("value")))).alias("v"))
    own = kinds.groupBy("host", "path", "v.kind", "v.value").agg(F.count("*").alias("n"))
    own = stored(own, "style-tree")
    everywhere = own.groupBy(F.lit(None).cast("string").alias("host"), "path", "kind", "value").agg(F.sum("n").alias("n"))
    entropy = (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.sum("n"))
    per_kind = own.unionByName(everywhere).groupBy("host", "path", "kind").agg(F.sum("n").alias("n_pages"), F.when(F.sum("n") > 1, entropy).otherwise(1.0).alias("e"))
    return per_kind.groupBy("host", "path").agg(F.max("n_pages").alias("n_pages"), F.max(F.when(F.col("kind") == "c", F.col("e"))).alias("texts"), F.avg("e").alias("importance"))


def noise_paths(tree: DataFrame, pages: int = PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """``(host, path, n_pages)``: the topmost paths that go, one row for each.

    A value is the mean of the host's and of all hosts', weighted by pages, the latter by ``pages`` at
    most. An element is as important as the most important one inside it: each path counts for its
    ancestors, too, before the maximum is taken.
    """
    every = tree.where(F.col("host").isNull()).select(
        "path", F.least("n_pages", F.lit(pages)).alias("m"), F.col("texts").alias("t"), F.col("importance").alias("i"), F.col("n_pages").alias("uses")
    )
    own = looked_up(tree.where(F.col("host").isNotNull()), stored(every, "all-hosts"), "path", "uses")
    mean = lambda mine, all_: (F.col("n_pages") * F.col(mine) + F.col("m") * F.col(all_)) / (F.col("n_pages") + F.col("m"))
    judged_ = F.col("path").contains("/body") | ~F.col("path").rlike(OUTSIDE)  # the tag <body> may be left out
    value = F.greatest(mean("importance", "i"), mean("texts", "t"))
    lineage = F.expr("transform(sequence(2, size(split(path, '/'))), n -> struct(array_join(slice(split(path, '/'), 1, n), '/') AS path, n = size(split(path, '/')) AS own))")
    ways = own.where(judged_).select("host", "n_pages", value.alias("value"), F.explode(lineage).alias("at"))
    best = ways.groupBy("host", "at.path").agg(F.max("value").alias("value"), F.max(F.when(F.col("at.own"), F.col("n_pages"))).alias("n_pages"))
    low = stored(best.where((F.col("value") < importance) & judged_ & F.col("n_pages").isNotNull()), "low-paths")
    parents = low.select("host", F.col("path").alias("parent"))
    return low.withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(parents, ["host", "parent"], "left_anti").select("host", "path", "n_pages")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; a null or empty page has an empty text.

    ``n_chars`` counts code points. Pages without a host share the tree of the empty host. Repeated ids
    and rows are read like any others; equal pages of a host count once in its tree.
    """
    tree = stored(style_tree(pages, url, html), "style-tree")
    hosts = tree.where(F.col("host").isNotNull()).groupBy("host").agg(F.max("n_pages").alias("uses"))
    low = noise_paths(tree).groupBy("host").agg(F.collect_list("path").alias("noise"))
    lists = stored(hosts.join(low, "host", "left").select("host", F.coalesce("noise", F.array().cast("array<string>")).alias("noise"), "uses"), "noise")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host_and_path(url)[0], F.col(html).alias("html"))
    rows = looked_up(read, lists, "host", "uses", F.length(F.array_join("noise", "/"))).select("page_id", "url", "html", "noise")
    schema = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_, lists_ = b.column(2).to_pylist(), b.column(3).to_pylist()
            texts = [main_text(p, frozenset(n)) for p, n in zip(pages_, lists_)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(take, schema)
