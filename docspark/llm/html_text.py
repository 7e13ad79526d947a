"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree of nodes that are content or not. A
node's potential comes from its features (tag, class names, amounts of text and
of links), and an edge's from how often children share their parent's label,
depending on whether markup calls either of them a menu, comment and so on.
Sum-product messages go up and then down the tree, which gives the exact
marginals; text of nodes that are more likely content than not is kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import mapped, ship

SAMPLE_PAGES = 2_000  # pages with labels by their markup that a model is fitted on, about
LAYOUT_WEIGHT = 8  # what a labelled layout counts beside a page
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",  # quotes count after = only
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
# elements by what they do to text; fixed values of the HTML standard
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SILENT = frozenset(
    "script style textarea title noscript template svg math head select option button iframe object audio"
    " video canvas noembed noframes datalist".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody"
    " td tfoot th thead tr ul caption legend".split()
)
_BREAKS = frozenset("br hr".split())
_CLOSES_P = _BLOCK - frozenset("html body tbody td tfoot th thead tr caption legend dd dt li".split())
_SCOPE = frozenset("html body article aside div section main td th table li blockquote form header footer nav".split())
_ENDS = {  # an opening tag ends these open elements, up to the given border
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
_GROUPS = [
    ("comment", re.compile(r"comment|disqus|repl(?:y|ies)|discussion")),
    ("advert", re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*)(?:$|[-_ \d])")),
    ("notice", re.compile(r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|paywall|subscri|newsletter|signup")),
    ("menu", re.compile(r"(?:^|[-_ ])nav|menu|breadcrumb|pagination|pager|tabs|toolbar|skip")),
    ("side", re.compile(r"side|widget|related|recommend|popular|trending|share|social|tags|toc|rail|more-")),
    ("foot", re.compile(r"foot|copyright|legal|colophon")),
    ("head", re.compile(r"head(?:er)?(?:$|[-_ ])|masthead|logo|brand|topbar")),
    ("form", re.compile(r"form|search|login|input")),
    ("body", re.compile(r"article|content|entry|post|story|main|text|body|prose")),
]
_NEGATIVE_TAGS = frozenset("nav header footer aside form dialog menu search".split())
_NEGATIVE_GROUPS = frozenset("comment advert notice menu side foot form".split())


class Node:
    __slots__ = ("tag", "parent", "groups", "words", "links", "all_words", "all_links", "label", "stop")

    def __init__(self, tag: str, parent: int, groups: tuple, label: int | None):
        self.tag, self.parent, self.groups, self.label = tag, parent, groups, label
        self.words = self.links = self.all_words = self.all_links = 0
        self.stop = 0


def _groups(attributes: str) -> tuple:
    if "=" not in attributes:
        return ()
    named = [v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role")]
    said = " ".join(named).lower()
    return tuple(g for g, pattern in _GROUPS if pattern.search(said)) or (("other",) if said.strip() else ())


def parse(page: str | None, labels: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and text blocks ``(node, text)``.

    Open elements that the standard closes by themselves are closed; end tags
    without a start are skipped; what is open at the end is closed there.
    """
    page = page or ""
    nodes = [Node("page", -1, (), 0 if labels else None)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the node that holds their text
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag are
    text: list[str] = []
    linked: list[int] = []
    at, silent, here, links = 0, 0, 0, 0

    def flush():
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                blocks.append((here, " ".join(words)))
                node = nodes[here]
                node.words += len(words)
                node.links += min(len(words), sum(linked))
                node.stop = words[-1][-1] in ".!?:;\"'”»…"
            text.clear()
            linked.clear()

    def pop_to(depth):
        nonlocal here, silent, links
        for tag, _ in stack[depth:]:
            places[tag].pop()
            silent -= tag in _SILENT
            links -= tag == "a"
        if any(tag in _BLOCK or tag in _SILENT for tag, _ in stack[depth:]):
            flush()
        del stack[depth:]
        here = stack[-1][1] if stack else 0

    def last_open(tags, border):
        last = max((places[t][-1] for t in tags if places.get(t)), default=-1)
        return last if all(places[t][-1] <= last for t in border if places.get(t)) else -1

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at and not silent:
            piece = page[at:end]
            text.append(piece)
            if links:
                linked.append(len(piece.split()))
        if not found:
            break
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            depth = last_open((tag,), ("table",) if tag not in ("table", "body", "html") and tag not in _BLOCK else ())
            if depth >= 0:
                pop_to(depth)
            continue
        if tag in _BREAKS:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            depth = last_open(("p",), _SCOPE)
            if depth >= 0:
                pop_to(depth)
        if tag in _ENDS:
            tags, border = _ENDS[tag]
            while (depth := last_open(tags, border)) >= 0:
                pop_to(depth)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop_to(len(stack) - 1)
        if tag in _RAW and not found[0].endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in _BLOCK and not silent:
            flush()
            label = None
            if labels:
                label = nodes[here].label
                if given := re.search(r"data-y=\"([01])\"", found["attrs"]):
                    label = int(given[1])
            nodes.append(Node(tag, here, _groups(found["attrs"]), label))
            here = len(nodes) - 1
        elif tag in _SILENT:
            flush()
            silent += 1
        links += tag == "a"
        places[tag].append(len(stack))
        stack.append((tag, here))
    flush()
    for node in reversed(nodes):
        node.all_words += node.words
        node.all_links += node.links
        if node.parent >= 0:
            nodes[node.parent].all_words += node.all_words
            nodes[node.parent].all_links += node.all_links
    return nodes, blocks


def _share(links: int, words: int) -> int:
    return -1 if not words else 0 if not links else 1 + min(2, 3 * links // (words + 1))


def features(node: Node) -> tuple:
    """What a node's potential depends on."""
    own = min(7, node.words.bit_length())
    return (
        ("tag", node.tag, _share(node.all_links, node.all_words)),
        *[("attr", g) for g in node.groups or ("none",)],
        ("own", own, node.stop if own else 0, _share(node.links, node.words)),
        # of a leaf this would say the same a second time
        ("below", min(9, node.all_words.bit_length()) if node.all_words > node.words else 0),
    )


def marked(node: Node) -> bool:
    """Whether tag or names say that an element is no content, as for menus and comments."""
    return node.tag in _NEGATIVE_TAGS or not _NEGATIVE_GROUPS.isdisjoint(node.groups)


def edge_kind(parent: Node, child: Node) -> int:
    return 2 * marked(parent) + marked(child)


def label_by_markup(nodes: list[Node]) -> bool:
    """Label a page by its article or main elements; False if it has none."""
    known = False
    for node in nodes:
        inside = node.parent >= 0 and nodes[node.parent].label == 1
        known |= node.tag in ("article", "main")
        node.label = int((inside or node.tag in ("article", "main")) and not marked(node))
    return known


def _sentences(n: int, seed: int) -> str:
    """Filler of about n words for labelled layouts."""
    said = "the report says that many people in town now read it with some care each day".split()
    words = [said[(seed * 7 + i * i + 3 * i) % len(said)] for i in range(n)]
    return " ".join(w + ("." if i % 9 == 8 or i == n - 1 else "") for i, w in enumerate(words)).capitalize()


# Labelled pages: data-y="1" marks content and what is below it, data-y="0" the rest.
# {n} stands for text of about n words.
LAYOUTS = [
    """<body><header class="site-header"><a href="/">{2}</a></header><nav><ul><li><a href="/a">{1}</a></li>
    <li><a href="/b">{2}</a></li></ul></nav><div class="cookie-notice"><p>{18}</p><button>{1}</button></div>
    <main data-y="1"><article><h1>{7}</h1><p>{60}</p><p>{4}</p><h2>{3}</h2><p>{35}</p><ul><li>{8}</li><li>{5}</li></ul>
    <blockquote><p>{20}</p></blockquote></article></main><aside class="sidebar"><h3>{3}</h3><ul>
    <li><a href="/c">{6}</a></li><li><a href="/d">{5}</a></li></ul><p>{12}</p></aside><footer><p>{9}</p></footer></body>""",
    """<body><div id="header"><div class="logo">{2}</div></div><div id="menu"><ul><li><a href="/a">{1}</a></li><li>
    <a href="/b">{1}</a></li><li><a href="/c">{2}</a></li></ul></div><div id="content" data-y="1"><h1>{6}</h1><div class="post-body">
    <p>{45}</p><p>{80}</p><p>{3}</p></div></div><div id="sidebar"><div class="widget"><h4>{2}</h4><p>{10}</p></div>
    <div class="ad">{14}</div></div><div id="comments"><h3>{2}</h3><div class="comment"><p>{22}</p></div><div class="comment">
    <p>{31}</p></div></div><div id="footer">{11}</div></body>""",
    """<body><div class="wrapper"><div class="topbar"><a href="/">{1}</a> <a href="/x">{1}</a></div><div class="story" data-y="1">
    <h1>{8}</h1><div class="byline">{4}</div><p>{30}</p><figure><figcaption>{9}</figcaption></figure><p>{50}</p><table><tr><th>{1}</th>
    <th>{2}</th></tr><tr><td>{1}</td><td>{3}</td></tr></table><p>{15}</p><div class="advert" data-y="0"><p>{12}</p></div><p>{40}</p>
    </div><div class="related"><h3>{2}</h3><ul><li><a href="/r">{7}</a></li><li><a href="/s">{8}</a></li></ul></div>
    <form class="newsletter"><label>{6}</label><input></form><div class="copyright">{7}</div></div></body>""",
    """<body><nav><a href="/">{1}</a></nav><div class="ad">{9}</div><article data-y="1"><h1>{5}</h1><p>{2}</p><p>{25}</p><p>{1}</p>
    <section><h2>{2}</h2><p>{33}</p><pre>{12}</pre></section><section class="comments" data-y="0"><h2>{2}</h2><article class="comment">
    <p>{19}</p></article><form><p>{4}</p></form></section></article><footer>{12}<p>{2}</p></footer></body>""",
    """<body><div class="banner"><p>{10}</p></div><article data-y="1"><header><h1>{9}</h1><p>{6}</p></header><p>{55}</p><ol><li>{12}</li>
    <li>{9}</li></ol><dl><dt>{1}</dt><dd>{10}</dd></dl><aside class="promo" data-y="0"><p>{16}</p></aside><p>{70}</p><div class="share" data-y="0">
    <a href="/f">{1}</a><a href="/g">{1}</a></div><footer data-y="0"><p>{6}</p></footer></article><div class="popup"><p>{20}</p></div>
    <div id="respond"><h3>{3}</h3><form><p>{5}</p></form></div></body>""",
    """<body><table><tr><td class="menu"><a href="/a">{1}</a><br><a href="/b">{2}</a></td><td class="main-text" data-y="1"><h2>{4}</h2>
    <p>{48}</p><p>{60}</p></td></tr></table><p class="legal">{14}</p></body>""",
    """<body><div><p><a href="/a">{2}</a> <a href="/b">{2}</a> <a href="/c">{2}</a></p></div><div data-y="1"><h1>{5}</h1><p>{90}</p>
    <p>{44}</p><p>{62}</p></div><div><ul><li><a href="/1">{4}</a></li><li><a href="/2">{5}</a></li></ul></div><div class="foot"><p>{5}</p></div></body>""",
    """<body><article data-y="1"><h1>{4}</h1><p>{120}</p></article><section id="discussion"><ol class="replies"><li>{25}</li><li>{14}</li></ol>
    </section><aside><p>{30}</p></aside><dialog><p>{13}</p></dialog></body>""",
]


def layout_page(layout: str, seed: int) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: _sentences(int(m[1]), seed + m.start()), layout)


def _count(nodes: list[Node], weight: int, into: Counter) -> None:
    for node in nodes:
        for f in features(node):
            into["f", repr(f), node.label] += weight
        into["n", "", node.label] += weight
        if node.parent >= 0:
            above = nodes[node.parent]
            into["e", f"{edge_kind(above, node)} {above.label}", node.label] += weight


def _sampled(batches):
    counts: Counter = Counter()
    for batch in batches:
        for page in batch["html"]:
            nodes, _ = parse(page)
            if label_by_markup(nodes):
                _count(nodes, 1, counts)
    rows = [(kind, name, label, n) for (kind, name, label), n in counts.items()]
    yield pd.DataFrame(rows, columns=["kind", "name", "label", "n"])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict:
    """Potentials from the labelled layouts and from pages labelled by their markup.

    About ``sample_pages`` pages are taken by the hash of their id. A page without
    an article or main element has no label and is not learned from. The model is
    counts of features, of which there are some hundred.
    """
    total = pages.count()
    limit = int(min(1.0, sample_pages / max(1, total)) * (1 << 30))
    taken = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < limit).select("html")
    counts: Counter = Counter()
    schema = "kind string, name string, label int, n long"
    found = mapped(taken, _sampled, schema).groupBy("kind", "name", "label").agg(F.sum("n").alias("n")).collect()
    pages_seen = max(1, min(sample_pages, total))
    for seed, layout in enumerate(LAYOUTS):
        nodes, _ = parse(layout_page(layout, seed), labels=True)
        _count(nodes, LAYOUT_WEIGHT * max(1, pages_seen // (10 * len(LAYOUTS))), counts)
    for r in found:
        counts[r["kind"], r["name"], r["label"]] += r["n"]
    n = [counts["n", "", y] + 1 for y in (0, 1)]
    odds = {}
    for name in {k[1] for k in counts if k[0] == "f"}:
        a, b = (counts["f", name, y] + 1 for y in (1, 0))
        odds[name] = math.log(a / n[1]) - math.log(b / n[0])
    edge = []
    for kind in range(4):
        e = [[counts["e", f"{kind} {p}", y] + 1 for y in (0, 1)] for p in (0, 1)]
        edge.append([x / sum(row) for row in e for x in row])
    return {"odds": odds, "edge": edge, "root": math.log(n[1] / n[0])}


def marginals(nodes: list[Node], model: dict, cache: dict | None = None) -> list[float]:
    """Log-odds of content of every node, by messages up to the root and back down."""
    odds, edges = model["odds"], model["edge"]
    cache = {} if cache is None else cache
    belief = []
    for node in nodes:
        key = features(node)
        if key not in cache:
            cache[key] = sum(odds.get(repr(f), 0.0) for f in key)
        belief.append(cache[key])
    up = [0.0] * len(nodes)
    own = [edges[0], *[edges[edge_kind(nodes[n.parent], n)] for n in nodes[1:]]]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        p00, p01, p10, p11 = own[i]
        x = math.exp(max(-300.0, min(300.0, belief[i])))
        up[i] = math.log((p11 * x + p10) / (p01 * x + p00))
        belief[nodes[i].parent] += up[i]
    belief[0] += model["root"]
    for i in range(1, len(nodes)):
        p00, p01, p10, p11 = own[i]
        x = math.exp(max(-300.0, min(300.0, belief[nodes[i].parent] - up[i])))
        belief[i] += math.log((p11 * x + p01) / (p10 * x + p00))
    return belief


def main_text(page: str | None, model: dict, cache: dict | None = None) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    belief = marginals(nodes, model, cache)
    return "\n".join(text for node, text in blocks if belief[node] > 0)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` of each row's whole html.

    Null, empty and markup-only pages have an empty text. Rows without an id are
    extracted but not learned from; repeated rows stay repeated; columns of these
    two names in ``pages`` are replaced. An empty table gives an empty result.
    """
    ship()
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    @F.pandas_udf("string")
    def column(html_text: pd.Series) -> pd.Series:
        cache: dict = {}
        whole = html_text.astype(object).where(html_text.notna(), None)
        return pd.Series([main_text(x, shared.value, cache) for x in whole])

    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    found = pages.select(*rest, column("html").alias("text"))
    return found.select(*rest, "text", F.length("text").cast("long").alias("n_chars"))
