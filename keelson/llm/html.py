"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text in page order, each with its place in the DOM. A classifier gives every block a score: the sum
of its text evidence (length, link density, closing mark, tag, repetition of its tag path, place in the page) and of its zones. A positive score is the
capacity from the source (the cost of calling the block boilerplate), a negative one the capacity to the sink (the cost of calling
it content). Smoothness edges join a block to the one before it and to the last block with the same parent. The maximum flow's
cut separates content, the source's side, from boilerplate; a block without any evidence stays out.

Text evidence and smoothness are fitted: blocks inside article zones and blocks inside boilerplate zones of at most ``SAMPLE`` distinct pages
(those with the smallest hash) are the labelled rows. Evidence is the log-odds of each feature's bins, a smoothness edge weighs half the log-odds that two
such neighbours share their label, so both are on one scale; counts start from the stated log-odds with the weight of ``PRIOR_ROWS`` rows, which
alone decide where no page has zones. Only counts per bin reach the driver.

Zones have finite costs. A main element, or an article inside a form or dialog, clears what is around it, and a form or dialog
that holds nearly all words of the page is the page. Words of classes and ids cost less, and least where a good zone is nearer the text.
Text outside the article zones costs by the share of the page's words inside them. Where the cut leaves nothing, the page's blocks outside
any boilerplate zone are its text, so a short item is not lost.

One page is handled at a time; a page's graph has two edges a block and blocks are found in linear time, whatever the depth. The
labels of a page are a function of the page and the fitted counts; the extraction has no shuffle.

Defined results: a null or empty page has an empty text; character references are decoded; white space inside a block becomes
one space; a tag that never closes ends with its parent, one that the page's end cuts off in its name is no text; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is not markup, and no text of the page.
RAW_TAGS = frozenset("iframe noembed noframes plaintext script style textarea title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("audio canvas datalist head math noscript object svg template video".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
BAD_TAGS = frozenset("aside button footer menu nav search select".split())
#: They may hold a field, a notice or the whole page.
FRAME_TAGS = frozenset("dialog form".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo menu menubar navigation search toolbar".split())
FRAME_ROLES = frozenset("dialog form".split())
#: Words of a class or id that name boilerplate.
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial adverts banner breadcrumb breadcrumbs byline comentarios comment comments commentaires commenti consent "
    "cookie cookies copyright disclaimer discussion discussions disqus feedback footer gdpr kommentar kommentare login masthead menu meta modal nav navbar navigation newsletter notice "
    "pagination pager paywall popup privacy promo promotion recommended reacties related replies reply respond responses reviews share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags talkback teaser toolbar topbar widget".split()
)
GOOD_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
#: Parts of a class that make it a state of the page or its subject (no-sidebar, comments-open, tag-privacy), not the name of a zone.
STATE_WORDS = frozenset(
    "category closed disabled enabled format has have layout no not off open opened status supports tag term with without".split()
)
#: Zone evidence: a good zone, boilerplate by definition, a form or dialog, and text outside the page's good zones.
W_GOOD, W_BAD, W_FRAME, W_OUTSIDE = 8.0, -12.0, -9.0, -8.0
#: Cost of an element named by a bad word: inside a good zone, by a whole class, by a part of one (or an article or main element itself).
C_INSIDE, C_WHOLE, C_PART = 18.0, 7.0, 4.0
#: The share of a page's words from which a form or dialog is the page.
WHOLE_PAGE = 0.8
TEXT_TAGS = frozenset("p blockquote pre figcaption".split())
#: Bins of a block's text and their log-odds before any page is seen.
PRIOR = {
    ("words", 0): -1.2, ("words", 1): -0.8, ("words", 2): -0.2, ("words", 3): 0.6, ("words", 4): 1.4, ("words", 5): 2.0,
    ("links", 0): 0.5, ("links", 1): 0.5, ("links", 2): -1.0, ("links", 3): -2.0,
    ("mark", 0): -0.5, ("mark", 1): 0.8,
    ("tag", 0): -0.3, ("tag", 1): 0.8, ("tag", 2): 0.5, ("tag", 3): -0.4,
    ("path", 0): 0.2, ("path", 1): 0.0, ("path", 2): -0.8,
    ("place", 0): 0.0, ("place", 1): 0.0, ("place", 2): 0.0,
}
#: Shares of neighbours with equal labels before any page is seen: in page order, across zones, and with the same parent.
AGREE = {"next": 0.95, "zone": 0.6, "parent": 0.93}
#: Weight of the above in rows, bound of one bin's log-odds, share of the summed evidence that counts (the features are not
#: independent), and bound of an edge.
PRIOR_ROWS, MOST_ODDS, EVIDENCE, MOST_EDGE = 50.0, 2.0, 0.5, 2.0
#: Pages that the counts are taken from.
SAMPLE = 2000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S
)
_PIECE = re.compile("[^>\"']++|\"[^\"]*+\"|'[^']*+'")
_PLAIN = re.compile("<[a-zA-Z][^\\s/>\"']*[\\s/]")
_LESS = re.compile("(?:(>)(>)(>))?<")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
#: A tag that the page's end cuts off within its name.
_CUT = re.compile(r"</?[a-zA-Z][^<>\s]*\Z")
#: What an opening tag ends, if it is open inside the nearest of the listed borders.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SECTIONS = BAD_TAGS | FRAME_TAGS | GOOD_TAGS | {"header", "section", "body", "div"}
_BORDERS = frozenset("ul ol menu dl table select article section div main body html".split())


@dataclass(slots=True)
class Node:
    tag: str
    number: int
    bad: bool
    good: bool
    hidden: bool
    cost: float
    frame: int


@dataclass(slots=True)
class Block:
    text: str
    links: int
    parent: int
    zone: int
    tag: str
    good: bool
    bad: bool
    cost: float
    frame: int
    path: tuple[str, ...]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(raw)}


def _node(tag: str, raw: str, parent: Node, number: int) -> Node:
    role = ""
    bad, good, hidden = tag in BAD_TAGS, tag in GOOD_TAGS, tag in HIDDEN_TAGS
    cost, frame = 0.0, tag in FRAME_TAGS
    if tag == "header":
        bad = not parent.good  # a page's header; an article's own header holds its title
    if raw and not raw.isspace() and tag not in ("html", "body"):
        a = _attributes(raw)
        role = a.get("role", "").lower()
        bad, frame = bad or role in BAD_ROLES, frame or role in FRAME_ROLES
        good = good or role in ("main", "article") or a.get("itemprop", "") == "articleBody"
        tokens = [t for k in ("class", "id") if k in a for t in map(_NAME.findall, a[k].lower().split()) if STATE_WORDS.isdisjoint(t)]
        words = BAD_WORDS if parent.good or tag == "article" else BAD_WORDS | {"header"}
        named = [t for t in tokens if not words.isdisjoint(t)]
        if named:
            cost = C_PART if good else C_INSIDE if parent.good else C_WHOLE if any(len(t) == 1 for t in named) else C_PART
        good = good or any(words.isdisjoint(t) and not GOOD_WORDS.isdisjoint(t) for t in tokens)
        style = a.get("style", "").lower().replace(" ", "")
        hidden = hidden or "hidden" in a or "display:none" in style or a.get("aria-hidden", "") == "true" and tag != "body"
    main = tag == "main" or raw and good and role == "main"
    around = Node("", 0, False, parent.good, parent.hidden, 0.0, 0) if main else parent
    framed = 0 if good else around.frame
    return Node(
        tag, number, around.bad or bad, around.good or good, around.hidden or hidden, around.cost + cost, framed or (number if frame else 0)
    )


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order, scripts, styles and hidden parts left out."""
    stack = [Node("", 0, False, False, False, 0.0, 0)]
    out: list[Block] = []
    text: list[str] = []
    linked, count, at = 0, 0, 0
    last = page.rfind("<")
    end = last if last >= 0 and _CUT.match(page, last) else len(page)
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements on the stack, by tag
    borders: list[int] = []
    owners = [stack[0]]  # open block elements: the last one holds the running text
    zones = [0]
    paths: list[tuple[str, ...]] = [()]
    unclosed: set[int] = set()

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                o = owners[-1]
                out.append(Block(joined, linked, o.number, zones[-1], o.tag, o.good, o.bad, o.cost, o.frame, paths[-1]))
        text, linked = [], 0

    def leave(k: int) -> None:
        """Pop the stack down to ``k`` elements."""
        if any(n.tag in BLOCK_TAGS for n in stack[k:]):
            close()
        for n in reversed(stack[k:]):
            where[n.tag].pop()
            if n.tag in BLOCK_TAGS:
                owners.pop()
                paths.pop()
            if n.tag in SECTIONS:
                zones.pop()
            if n.tag in _BORDERS:
                borders.pop()
        del stack[k:]

    while at < end:
        m = (_LESS if at in unclosed else _TOKEN).match(page, at)
        if m.end() == at + 1 and at not in unclosed and _PLAIN.match(page, at):
            # A start tag that never closes; neither do those outside its quotes, which need no look of their own.
            piece = _PIECE.match(page, at + 1)
            while piece:
                if piece[0][0] not in "\"'":
                    unclosed.update(k.start() for k in _PLAIN.finditer(page, piece.start(), piece.end()))
                piece = _PIECE.match(page, piece.end())
        at = m.end()
        if m[2] is not None:
            tag, raw = m[2].lower(), m[3]
            if tag in RAW_TAGS:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    text.append(" ")
                continue
            # What this tag ends: the nearest of these inside the nearest border.
            ends = [*_ENDS.get(tag, ()), *(("head",) if tag not in HEAD_TAGS else ()), *(("p",) if tag in BLOCK_TAGS else ()), *(("a",) if tag == "a" else ())]
            k = max((where[t][-1] for t in ends if where[t]), default=0)
            if k > (borders[-1] if borders else 0):
                leave(k)
            if tag in BLOCK_TAGS:
                close()
            if tag in VOID_TAGS or raw.endswith("/") and tag not in BLOCK_TAGS:
                continue
            count += 1
            where[tag].append(len(stack))
            if tag in _BORDERS:
                borders.append(len(stack))
            stack.append(_node(tag, raw, stack[-1], count))
            if tag in BLOCK_TAGS:
                owners.append(stack[-1])
                paths.append((*paths[-1][-2:], tag))
            if tag in SECTIONS:
                zones.append(count)
        elif m[1] is not None:
            tag = m[1].lower()
            if where[tag]:
                leave(where[tag][-1])
        elif not page.startswith(("<!", "<?"), m.start()):
            if not stack[-1].hidden:
                piece = unescape(m[0])
                text.append(piece)
                linked += len(piece) if where["a"] else 0
    close()
    return out


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value > e for e in edges)


def features(found: list[Block]) -> list[list[tuple[str, int]]]:
    """The bins of each block's text."""
    words = [b.text.count(" ") + 1 for b in found]
    short = Counter(b.path for b, n in zip(found, words) if n <= 5)
    before, total, out = 0, sum(words), []
    for b, n in zip(found, words):
        tag = 1 if b.tag in TEXT_TAGS else 2 if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 3 if b.tag in ("li", "dt", "dd", "td", "th") else 0
        out.append(
            [
                ("words", _bin(n, (2, 5, 10, 20, 40))),
                ("links", _bin(b.links / len(b.text), (0, 0.25, 0.6))),
                ("mark", int(b.text.rstrip("\"')\u201d\u2019\u00bb")[-1:] in (".", "!", "?", "\u2026", "\u3002"))),
                ("tag", tag),
                ("path", _bin(short[b.path] if n <= 5 else 0, (0, 2))),
                ("place", _bin((before + n / 2) / total, (0.05, 0.95))),
            ]
        )
        before += n
    return out


def neighbours(found: list[Block]) -> list[tuple[int, int, str]]:
    """Edges and their kinds: the block before, and the last one with the same parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, "next" if found[i - 1].zone == b.zone else "zone"))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, "parent"))
        last[b.parent] = i
    return edges


def silver(b: Block) -> int | None:
    """1 in a good zone, 0 in a boilerplate zone, else none."""
    if b.bad or b.frame or b.cost >= C_WHOLE:
        return 0
    return 1 if b.good and not b.cost else None


def page_counts(page: str) -> Counter:
    """(kind, bin or agreement, label) of the labelled blocks and edges of a page that has both labels."""
    found = blocks(page)
    labels = [silver(b) for b in found]
    counts: Counter = Counter()
    if 0 in labels and 1 in labels:
        for label, own in zip(labels, features(found)):
            if label is not None:
                counts.update((*f, label) for f in own)
        for i, j, kind in neighbours(found):
            if labels[i] is not None and labels[j] is not None:
                counts[kind, int(labels[i] == labels[j]), 0] += 1
    return counts


def weights(counts: dict[tuple[str, int, int], int]) -> dict:
    """Evidence by (feature, bin) and smoothness by kind of edge, on the scale of log-odds."""
    ones, zeros = (sum(counts.get(("mark", v, label), 0) for v in (0, 1)) for label in (1, 0))
    even = ones / zeros if zeros else 0.0
    made: dict = {}
    for key, odds in PRIOR.items():
        share = 1 / (1 + math.exp(-odds))
        one, zero = counts.get((*key, 1), 0) + PRIOR_ROWS * share, counts.get((*key, 0), 0) * even + PRIOR_ROWS * (1 - share)
        made[key] = EVIDENCE * max(-MOST_ODDS, min(MOST_ODDS, math.log(one / zero)))
    for kind, share in AGREE.items():
        same, other = counts.get((kind, 1, 0), 0) + PRIOR_ROWS * share, counts.get((kind, 0, 0), 0) + PRIOR_ROWS * (1 - share)
        made[kind] = max(0.0, min(MOST_EDGE, 0.5 * math.log(same / other)))
    return made


def scores(found: list[Block], fitted: dict) -> list[float]:
    """Positive: evidence for content."""
    words = [b.text.count(" ") + 1 for b in found]
    open_ = sum(n for b, n in zip(found, words) if not b.bad)
    inside = sum(n for b, n in zip(found, words) if b.good and not b.bad and not b.frame and not b.cost)
    framed: Counter[int] = Counter()
    for b, n in zip(found, words):
        framed[b.frame] += n if not b.bad else 0
    outside = W_OUTSIDE * inside / open_ if open_ else 0.0
    out = []
    for b, own in zip(found, features(found)):
        s = sum(fitted[f] for f in own) - b.cost + (W_GOOD if b.good else outside)
        if b.bad:
            s += W_BAD - (W_GOOD if b.good else 0.0)
        elif b.frame and framed[b.frame] < WHOLE_PAGE * open_:
            s += W_FRAME - (W_GOOD if b.good else 0.0)
        out.append(s)
    return out


def content(values: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut.

    Maximum flow by blocking flows on breadth-first layers, from nodes with supply to nodes with demand.
    """
    n = len(values)
    supply, demand = [max(0.0, s) for s in values], [max(0.0, -s) for s in values]
    to: list[list[int]] = [[] for _ in range(n)]  # edge numbers; edge e and its reverse are e and e ^ 1
    head, left = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += (b, a)
        left += (c, c)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        goal = False
        while queue:
            i = queue.popleft()
            goal = goal or demand[i] > tiny
            for e in to[i]:
                if left[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not goal:
            return [v >= 0 for v in level]
        turn = [0] * n
        for source in range(n):
            path: list[int] = []
            i = source
            while supply[source] > tiny and level[source] == 0:
                if demand[i] > tiny:
                    flow = min([supply[source], demand[i], *[left[e] for e in path]])
                    supply[source] -= flow
                    demand[i] -= flow
                    for e in path:
                        left[e] -= flow
                        left[e ^ 1] += flow
                    path, i = [], source
                    continue
                while turn[i] < len(to[i]):
                    e = to[i][turn[i]]
                    if left[e] > tiny and level[head[e]] == level[i] + 1:
                        break
                    turn[i] += 1
                if turn[i] < len(to[i]):
                    path.append(e)
                    i = head[e]
                elif path:
                    i = head[path.pop() ^ 1]
                    turn[i] += 1
                else:
                    break


def main_blocks(found: list[Block], fitted: dict) -> list[bool]:
    edges = [(i, j, fitted[kind]) for i, j, kind in neighbours(found)]
    values = scores(found, fitted)
    keep = content(values, edges)
    if not any(keep):
        own = [not b.bad and not b.frame and not b.cost and 2 * b.links < len(b.text) for b in found]
        lift = max((-v for v, o in zip(values, own) if o), default=0.0) + 1.0
        keep = content([v + lift if o else v for v, o in zip(values, own)], edges)
    return keep


def main_text(page: str, fitted: dict | None = None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, k in zip(found, main_blocks(found, fitted or weights({}))) if k)


def fit(df: DataFrame, html: str = "html", sample: int = SAMPLE) -> dict:
    """:func:`weights` from the ``sample`` distinct pages with the smallest hash."""
    page = df.select(F.col(html).cast("string").alias("page")).where("page IS NOT NULL").withColumn("h", F.xxhash64("page"))
    edge = page.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return weights({})

    def count(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in iterator:
            for p in batch.column(0):
                counts.update(page_counts(p.as_py()))
        if counts:
            kinds, bins, labels = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(bins, pa.int64()), pa.array(labels, pa.int64()), pa.array(counts.values(), pa.int64())],
                names=["kind", "bin", "label", "n"],
            )

    once = page.where(F.col("h") <= edge).groupBy("h").agg(F.first("page").alias("page")).select("page")
    rows = once.mapInArrow(count, "kind string, bin long, label long, n long").groupBy("kind", "bin", "label").agg(F.sum("n").alias("n"))
    return weights({(r.kind, r.bin, r.label): r.n for r in rows.collect()})


def extract_text(df: DataFrame, html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``df`` without ``html``, with ``text`` and ``n_chars``, its code points (long)."""
    keep = [c for c in df.columns if c not in (html, "text", "n_chars")]
    fitted = fit(df, html, sample)

    def extract(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            texts = [main_text(h.as_py() or "", fitted) for h in batch.column("_h_html")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    rows = df.select(*keep, F.col(html).cast("string").alias("_h_html"))
    schema = rows.drop("_h_html").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(extract, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
