"""Main text of web pages, by the paths that a host's pages agree on.

Every page is parsed into a light tree. Its containers are scored by how much
running text they hold; each page votes for the generalised tag-class paths of
its best ones, and Spark adds the votes up per host. Each page is then extracted
again from the container on its host's winning path, or from its own best one
where it has none there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odarel.llm.shared import materialize

# Element names of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object", "select", "canvas")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head".split()
)
JUNK = frozenset("nav footer aside form menu button dialog head input label fieldset legend search video audio map datalist output progress meter".split())
#: An opening tag closes an open one of these, up to a scope.
CLOSES = {
    **{b: ("p",) for b in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()},
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "td", "th", "tr"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody"),
    "option": ("option",),
}
SCOPE = frozenset("article aside section main div table ul ol dl td th body html form nav footer header blockquote figure details".split())
SCOPE_OF = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tbody": frozenset(("table",))}
#: Words of class, id and role that mark what isn't the article.
JUNK_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|adunit|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|"
    r"nav|navbar|navigation|navi|menus?|breadcrumbs?|crumbs?|sidebars?|side|rail|aside|footers?|foot|masthead|topbar|toolbar|header|site-header|page-header|"
    r"comments?|commentlist|discussion|disqus|replies|respond|reactions|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|"
    r"widget-area|pagination|pager|skip|toc|tags|hidden|complementary|contentinfo|search|dialog|alertdialog|outbrain|taboola)(?:$|[\s_-])",
    re.IGNORECASE,
)
GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main|body|text|page|blog)(?:$|[\s_-])", re.IGNORECASE)
POST_WORD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?:$|[\s_-])", re.IGNORECASE)
#: Class names that tell what a page has beside the element.
WITH_WORD = re.compile(r"(?:^|\s)(?:with|has|no|without|is|layout)[-_]\S+", re.IGNORECASE)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: an angle bracket in quotes doesn't end it. Nothing is tried twice.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
QUOTE_OR_END = re.compile("[>\"']")
COMMENT_END = re.compile("--!?>")
RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*>", re.IGNORECASE) for tag in RAW}
ATTR = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: Blocks that are parts of a container.
PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 pre dt dd blockquote figcaption td th tr ul ol tbody table dl".split())
KEPT_IN_HEADER = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("attrs", "children", "junk", "name", "parent", "path_id", "post", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.path_id = self.post = None
        names = [re.sub(r"[\d>]+", "", x).strip("-_").lower() for x in attrs.get("class", "").split()]
        self.name = ".".join([tag.replace(">", ""), *sorted({x for x in names if x})])
        inside = parent is not None and parent.tag != "#"
        self.junk = tag in JUNK or (inside or tag not in ("html", "body")) and is_junk(tag, attrs, parent)

    @property
    def path(self) -> str:
        """Generalised tags and classes from the root down."""
        names, up = [], self
        while up is not None:
            names.append(up.name)
            up = up.parent
        return ">".join(reversed(names))


def known_up(node: Node | None, slot: str) -> list[Node]:
    """``node`` and what is above it, up to the first one that has ``slot`` set, topmost first."""
    chain = []
    while node is not None and getattr(node, slot) is None:
        chain.append(node)
        node = node.parent
    return chain[::-1]


def in_post(node: Node | None) -> bool:
    """Whether a node or one above it is an article; each node is looked at once."""
    for x in known_up(node, "post"):
        x.post = x.parent is not None and x.parent.post or x.tag in ("article", "main") or bool(POST_WORD.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"))
    return node is not None and node.post


def path_id(node: Node, ids: dict[tuple, int]) -> int:
    """A number for the node's path, the same for equal paths of a page."""
    for x in known_up(node, "path_id"):
        x.path_id = ids.setdefault((x.parent and x.parent.path_id, x.name), len(ids))
    return node.path_id


def is_junk(tag: str, attrs: dict[str, str], parent: Node | None) -> bool:
    if tag in ("html", "body", "article", "main"):
        return "comment" in attrs.get("class", "").lower() and tag == "article"
    if tag == "header":
        return not in_post(parent)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.IGNORECASE):
        return True
    if attrs.get("role", "").lower() in ("article", "main"):
        return False
    return any(JUNK_WORD.search(WITH_WORD.sub(" ", attrs.get(x, ""))) for x in ("class", "id", "role"))


def free_article(root: Node) -> None:
    """Where every article or main element lies in what class names call junk, trust the elements."""
    tops, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag in ("article", "main") and not node.junk:
            if not inside:
                return
            tops.append(node)
        stack.extend((x, inside or x.junk) for x in reversed(node.children) if not isinstance(x, str))
    for node in tops[:1]:
        up = node.parent
        chain = []
        while up is not None:
            chain.append(up)
            up = up.parent
        if not any(x.tag in JUNK or x.tag == "header" for x in chain):
            for x in chain:
                x.junk = False


def tags(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Begin, end, whether it closes, name in lower case and attributes of each tag; no name for what isn't an element.

    Comments, declarations and elements that hold no text are one tag each, up to their end or that of the page. A
    tag whose quotes never close ends at the next angle bracket. Every part of the page is looked at a bounded number of
    times: what was seen to lead to an unclosed quote is remembered.
    """
    last = html.rfind(">")
    last_quote = {c: html.rfind(c) for c in "\"'"}
    doomed: set[int] | None = None  # places outside quotes from which a quote is reached that never closes

    def tag_end(at: int) -> int:
        nonlocal doomed
        if doomed is None:
            if m := REST.match(html, at):
                return m.end()
            doomed = set()
        place, seen = at, []
        while place not in doomed:
            seen.append(place)
            m = QUOTE_OR_END.search(html, place)
            if m is None or m[0] != ">" and m.start() == last_quote[m[0]]:
                break
            if m[0] == ">":
                return m.end()
            place = html.find(m[0], m.end()) + 1
        doomed.update(seen)
        return html.find(">", at) + 1

    at = html.find("<")
    while 0 <= at <= last:
        follows = html[at + 1 : at + 2]
        close = follows == "/"
        name = NAME.match(html, at + 1 + close)
        if html.startswith("<!--", at):
            m = COMMENT_END.search(html, at + 4)
            end = m.end() if m else len(html)
            yield at, end, False, None, ""
        elif name:
            end = tag_end(name.end())
            tag, attrs = name[0].lower(), html[name.end() : end - 1]
            if not close and tag in RAW_END and not attrs.endswith("/"):
                m = RAW_END[tag].search(html, end, last + 1)
                end = m.end() if m else len(html)
                tag = None
            yield at, end, close, tag, attrs
        elif follows and follows in "!?/":
            end = html.find(">", at) + 1
            yield at, end, False, None, ""
        else:
            end = at + 1
        at = html.find("<", end)


def parse(html: str) -> Node:
    """The tree; texts are strings among the children, character references decoded."""
    root = node = Node("#", {}, None)
    at = 0
    open_: Counter[str] = Counter()

    def closed_to(up: Node) -> Node:
        """Close all elements from the current one to ``up``."""
        at_ = node
        while at_ is not up:
            open_[at_.tag] -= 1
            at_ = at_.parent
        open_[up.tag] -= 1
        return up.parent

    def text(part: str) -> None:
        if part:
            node.children.append(unescape(part))

    for start, end, close, tag, raw in tags(html):
        text(html[at:start])
        at = end
        if tag is None:
            continue
        if close:
            if open_[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = closed_to(up)
            elif tag == "br":
                node.children.append(" ")
            continue
        for closed in CLOSES.get(tag, ()):
            if open_[closed] <= 0:
                continue
            up, scope = node, SCOPE_OF.get(tag, SCOPE)
            while up is not root and up.tag != closed and up.tag not in scope:
                up = up.parent
            if up is not root and up.tag == closed:
                node = closed_to(up)
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(raw)} if raw.strip(" /") else {}
        child = Node(tag, attrs, node)
        node.children.append(child)
        if tag not in VOID and not (raw.endswith("/") and tag not in BLOCK):
            node = child
            open_[tag] += 1
    text(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", html[at:]) if "<" in html[at:] else html[at:])
    free_article(root)
    return root


def blocks(top: Node) -> list[str]:
    """The text of each block under ``top`` in page order, white space inside made one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            out.append(line)
        run.clear()

    stack: list[tuple[Node, Iterator, bool]] = [(top, iter(top.children), False)]
    while stack:
        node, rest, heads = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if not heads:
                    run.append(child)
                continue
            if child.junk:
                if child.tag in BLOCK:
                    flush()
                continue
            if child.tag == "br":
                run.append(" ")
                continue
            if child.tag in BLOCK:
                flush()
            stack.append((child, iter(child.children), (heads or child.tag == "header") and child.tag not in KEPT_IN_HEADER))
            break
        else:
            stack.pop()
            if node.tag in BLOCK:
                flush()
    flush()
    return out


def scored(root: Node) -> list[tuple[float, Node]]:
    """Containers with running text, best first.

    A block's text counts for its container, less for those further up; text in
    links counts against it.
    """
    score: dict[Node, float] = {}
    order: list[Node] = []
    stack: list[tuple[Node, bool, Node]] = [(root, False, root)]
    while stack:
        node, linked, box = stack.pop()
        if node.junk:
            continue
        order.append(node)
        if node.tag in BLOCK and node.tag not in PARTS:
            box = node
        size = 0
        for child in reversed(node.children):
            if isinstance(child, str):
                size += len(child.strip())
            else:
                stack.append((child, linked or child.tag == "a", box))
        if size:
            up = box
            gain = -size if linked else size
            while up is not None and abs(gain) >= 1e-3:
                score[up] = score.get(up, 0.0) + gain
                gain *= 0.85
                up = up.parent
    found = []
    for i, node in enumerate(order):
        s = score.get(node, 0.0)
        if s > 0 and node.tag != "#":
            bonus = 2.0 if node.tag in ("article", "main") or node.attrs.get("role", "") in ("article", "main") or node.attrs.get("itemprop", "") == "articleBody" else 1.3 if GOOD_WORD.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}") else 1.0
            found.append((s * bonus, -i, node))
    return [(s, node) for s, _, node in sorted(found, key=lambda x: (-x[0], -x[1]))]


def votes(html: str, most: int = 3) -> list[tuple[str, float]]:
    """A page's best container paths, each with its share of the best score."""
    out: dict[int, tuple[str, float]] = {}
    ids: dict[tuple, int] = {}
    ranked = scored(parse(html))
    for s, node in ranked:
        number = path_id(node, ids)
        if number not in out:
            out[number] = (node.path, s / ranked[0][0])
            if len(out) == most:
                break
    return list(out.values())


def at_path(root: Node, path: str) -> list[Node]:
    """The nodes on a path that aren't junk, in page order."""
    names, out = path.split(">"), []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.junk or node.name != names[depth]:
            continue
        if depth + 1 == len(names):
            out.append(node)
        else:
            stack.extend((x, depth + 1) for x in reversed(node.children) if not isinstance(x, str))
    return out


def extract(html: str, path: str | None, others: list[str] | None = None, better: float = 5.0) -> str:
    """Blocks under ``path``, or under the page's own best container, joined by an empty line.

    ``others`` are paths that the host's pages voted for, too. One that neither holds ``path`` nor lies in it is another
    template's: it is taken where it scores ``better`` times as much on this page.
    """
    root = parse(html)
    tops = at_path(root, path) if path else []
    if path and (apart := [x for x in others or () if not f"{x}>".startswith(f"{path}>") and not f"{path}>".startswith(f"{x}>")]):
        score = {node: s for s, node in scored(root)}
        own = sum(score.get(x, 0.0) for x in tops)
        for other in apart:
            nodes = at_path(root, other)
            if (s := sum(score.get(x, 0.0) for x in nodes)) > better * max(own, 1e-9):
                tops, own, better = nodes, s, 1.0
    lines = [x for top in tops for x in blocks(top)]
    if not lines:
        ranked = scored(root)
        lines = blocks(ranked[0][1] if ranked else root)
    return "\n\n".join(lines)


def host_of(url):
    """Host of a URL column in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 2) -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` (code points) and ``path`` (the host's winner) per page.

    A host's path needs votes of ``min_pages`` pages; the votes add up, and of
    equal ones the shorter path wins, then the lesser in code point order. Paths that are the best of
    ``min_pages`` pages and of a hundredth of the host's, so a hundred or so at most, are kept beside the winner, for hosts of several templates. Pages
    with a null or odd URL have no host and use their own best container. Null and
    empty html give an empty text; repeated rows vote and are extracted
    each; an empty table gives an empty table. Other columns are ignored.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, shares = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, share in votes(page.as_py() or ""):
                    hosts.append(host)
                    paths.append(path)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            texts = [extract(page.as_py() or "", path, others) for page, path, others in paths]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], names=["key", "url", "text", "path"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    cast = rows.filter("host is not null").select("host", "html").mapInArrow(vote, "host string, path string, share double")
    total = cast.groupBy("host", "path").agg(F.sum("share").alias("share"), F.count("*").alias("n"), F.sum((F.col("share") >= 1.0).cast("long")).alias("best"))
    total = materialize(total, "html-votes")
    pages_of = total.groupBy("host").agg(F.sum("best").alias("pages"))
    voted = total.filter(F.col("n") >= min_pages).join(pages_of, "host")
    rank = F.struct((-F.round("share", 6)).alias("s"), F.length("path").alias("l"), "path")
    often = F.when((F.col("best") >= min_pages) & (F.col("best") * 100 >= F.col("pages")), rank)
    best = voted.groupBy("host").agg(F.min(rank)["path"].alias("path"), F.transform(F.sort_array(F.collect_list(often)), lambda x: x["path"]).alias("others"))
    best = materialize(best, "html-paths")
    kind = pages.schema[key].dataType.simpleString()
    found = rows.join(best, "host", "left").select("key", "url", "html", "path", "others").mapInArrow(read, f"key {kind}, url string, text string, path string")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "path")
