"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A classifier gives each block a cost of calling it boilerplate or content, the
capacity of its edge to the source or the sink. Neighbours in page order and siblings in the tree are joined by smoothness
edges, the stronger the nearer they stand in the tree. Maximum flow gives the labelling of least total cost. A page is
one row: pages are independent of each other, and nothing is shuffled.

The classifier is a naive Bayes model. Its prior are points for what a block stands in, for names of classes and identifiers around it, for
length and for the share of link text; what the pages at hand say is added to it: the tags and names around blocks are
counted for both classes over a sample of at most SAMPLE pages of at most LARGEST bytes each (`learned`), and each moves the cost by its log-odds, bounded by
STEP points each and REACH together. An element that is surely furniture (a tag or a whole name that says so, and nothing on it that speaks for content)
is a unit of its own: no smoothness edge leaves it, length is no evidence in it, and what it holds gains no points for content, a main element excepted. So
long furniture goes like short one. There are no labelled pages. Blocks that repeat on several pages of the sample, unless the
prior is sure of them, and those it is sure to be furniture, count as boilerplate; blocks of WORDS words or more that stand on one page only and that the prior calls content
count as content; others are not counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayleave.llm.shared import save, text_or_empty

# HTML's element classes, and names that page furniture goes by.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("template svg canvas object audio video select datalist head".split())
# Points of furniture tags: for all that they hold they stand above what is around them, like whole names below.
FURNITURE = {"nav": -60, "footer": -60, "aside": -60, "menu": -60, "dialog": -60, "header": -60, "form": -40}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div table ul ol dl td th li blockquote nav footer aside form header".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|"
    r"nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|sidebar|side-?bar|widget|related|recommended|footer|masthead|site-?header|page-?header|comments?|comment-?list|replies|reply|disqus|respond|toolbar|skip-?link|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
# Names that only say what a page has or lacks elsewhere.
ABOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no|is|show|hide)[-_]+\S+", re.I)
# Words beside which a name still is the whole of what a token says.
SHAPE = frozenset("site page main top bottom left right primary secondary global local sub list item items link links box block bar wrapper wrap container inner outer area section group header title heading body content icon icons button buttons btn text form row col column columns post posts article articles entry story stories mobile desktop sticky fixed".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:article(?:-?(?:body|content|text))?|post(?:-?(?:body|content))?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content)?|content)(?=$|[\s_-])", re.I)
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
SAYING = frozenset("class id role hidden aria-hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 summary legend".split())
WHITE = re.compile(r"[\x09-\x0D\x20]+")
NEVER = -1000
#: A button's text counts where it stands in a heading or among other text.
BUTTON = -500
#: What a furniture name costs as a whole token of a class or id, and as part of one; points around a whole one count up to AT_MOST.
WHOLE, PART, AT_MOST = -40, -8, 10
#: Names that may as well stand for what a text is about; their whole tokens cost UNSURE, against all points around them.
DOUBTFUL = frozenset("legal notice alert disclaimer copyright".split())
UNSURE = -50
LEAST, MOST = -80, 60
#: A name on an element with this share of the text that can be seen does not tell parts of the page apart.
NEARLY_ALL = 0.9
#: The sample that the classifier learns from, and how far it goes from its prior.
SAMPLE, LARGEST, PAGES, WORDS, SURE = 1000, 1 << 20, 3, 20, -20
BUCKETS, MANY, DOUBT, STEP, REACH = 1 << 14, 256, 20, 6, 12


class Block:
    """A block of text: the innermost block-level element it stands in, that one's parent, how many there are, how many of them the block before stands in too, and pieces (text, element around it, in a link)."""

    __slots__ = ("common", "depth", "element", "furniture", "linked", "name", "parent", "pieces", "score", "seen", "text")

    def __init__(self, around: list[tuple[str, int]], common: int):
        self.name, self.element = around[-1] if around else ("", 0)
        self.parent = around[-2][1] if len(around) > 1 else 0 if around else -1
        self.depth, self.common, self.pieces, self.score, self.linked, self.text, self.seen = len(around), common, [], 0, 0, "", []
        self.furniture = 0  # the innermost element around it that is surely furniture, 0 if none is


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _names(value: str) -> tuple[int, int]:
    """What a class or id says: points for content, and the cost of its worst furniture name."""
    points = cost = 0
    for token in ABOUT.sub("", value).split():
        if NAMES.search(token):
            rest = re.split(r"[\s_-]+", NAMES.sub(" ", token).lower())
            whole = all(not x or x.isdigit() or x in SHAPE for x in rest)
            unsure = all(x[0].strip("-_ \t\n").lower() in DOUBTFUL for x in NAMES.finditer(token))
            cost = min(cost, PART if not whole else UNSURE if unsure else WHOLE)
        elif CONTENT.search(token):
            points = 20
    return points, cost


def _evidence(name: str, attributes: str, inside: int) -> tuple[int, int, list[int]]:
    """What an element says about all that it holds: NEVER, BUTTON, or points for content; what its tag, class and id cost; and its features."""
    if name in UNSEEN:
        return NEVER, 0, []
    points, cost = 40 if name in ("article", "main") else BUTTON if name == "button" else 0, 0
    features = [_bucket(f"<{name}")]
    if name in FURNITURE and not (name == "header" and inside > 0):
        cost = FURNITURE[name]
    if attributes:
        said_before = set()
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key not in SAYING or key in said_before:
                continue
            said_before.add(key)
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return NEVER, 0, []
            if key == "role":
                said = ROLES.get(value.lower(), 0)
                if said < 0:
                    cost = min(cost, -60)
                points += 30 * max(said, 0)
            elif key in ("class", "id") and name not in ("html", "body"):
                more, less = _names(value)
                points, cost = points + more, min(cost, less)
                features += [_bucket(f".{x}") for x in value.lower().split()]
    if name == "article" and points == 40 and _surely(cost):
        points = 0  # a comment, say
    return points, cost, features


def _surely(cost: int) -> bool:
    return cost <= WHOLE and cost != UNSURE


def _totals(parents: list[int], said: list[tuple[int, int, list[int]]], first: list[int], out: list[Block], mains: set[int]) -> tuple[list[int], list[int]]:
    """Points of each element and all around it with the cost of tags and names (`first` has them without), and the innermost sure furniture that each stands in or is."""
    size = [0] * len(parents)
    for b in out:
        for text, element, _ in b.pieces:
            if first[element] > BUTTON:
                size[element] += len(text)
    for n in range(len(parents) - 1, 0, -1):
        size[parents[n]] += size[n]
    total, within = [0], [0]
    for n in range(1, len(parents)):
        inside = 0 if n in mains else within[parents[n]]
        if first[n] <= BUTTON:
            total.append(first[n])
            within.append(inside)
            continue
        around, (points, cost, _) = total[parents[n]], said[n]
        if size[n] >= NEARLY_ALL * size[0]:
            cost = 0
        if _surely(cost):
            around = min(around, AT_MOST)
            inside = inside if points > 0 else n
        if inside:
            points = min(points, 0)
        total.append(max(LEAST, min(MOST, around + points + cost)))
        within.append(inside)
    return total, within


def _weigh(b: Block, total: list[int]) -> None:
    """Text and score of a block: the points of its block-level surroundings, and of inline elements by their share of the text.

    Hidden inline pieces are left out and say nothing about the rest; blocks in hidden surroundings are NEVER content.
    """
    base = total[b.element]
    pieces = b.pieces
    if base > BUTTON:
        shown = [x for x in pieces if total[x[1]] > NEVER]
        if b.name not in HEADINGS and not any(total[x[1]] > BUTTON and x[0].strip(" \t\n\r\x0b\x0c") for x in shown):
            shown = []
        pieces = shown
    b.text = WHITE.sub(" ", "".join(x[0] for x in pieces)).strip(" ")
    if base <= BUTTON:
        b.score = NEVER
        return
    b.linked = sum(len(x[0]) for x in pieces if x[2])
    inline = sum((total[x[1]] - base) * len(x[0]) for x in pieces if total[x[1]] > BUTTON)
    b.score = base + round(inline / max(1, sum(len(x[0]) for x in pieces)))


def _around(parents: list[int], said: list[tuple[int, int, list[int]]], steps: list[int] | None, wanted: set[int]) -> tuple[list[int], dict[int, list[int]]]:
    """What the classifier has learned of the features of each element and all around it, each feature counted once; and, for the wanted ones, the features (MANY at most).

    Elements are numbered as they open, so one walk with the counts of the way down to the current one does.
    """
    total, seen, way, met, now = [0] * len(parents), {}, [0], Counter(), 0
    for n in range(1, len(parents)):
        while way[-1] != parents[n]:
            for f in said[way.pop()][2]:
                met[f] -= 1
                if not met[f]:
                    now -= steps[f] if steps else 0
                    del met[f]
        way.append(n)
        for f in said[n][2]:
            if f not in met:
                now += steps[f] if steps else 0
            met[f] += 1
        total[n] = now
        if n in wanted:
            seen[n] = list(islice(met, MANY))
    return total, seen


def blocks(html: str, steps: list[int] | None = None, features: bool = False) -> list[Block]:
    """Blocks of text in page order, with the points of the elements they stand in; with `features`, also the features around them (`seen`)."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # name, number
    around_now: list[tuple[str, int]] = []  # those of block level
    mains: set[int] = set()
    parents, said, first = [0], [(0, 0, [])], [0]  # of each element; points of it and all around it without tags and names
    number = at = links = common = 0
    open_ = Counter()  # how many elements of a name are open
    now: Block | None = None
    end = len(html)

    def shut_from(i: int) -> None:
        """Close the elements from the i-th on."""
        nonlocal links, common
        for name, _ in stack[i:]:
            open_[name] -= 1
            links -= name == "a"
            if name in BLOCK:
                around_now.pop()
        del stack[i:]
        common = min(common, len(around_now))

    def add(raw: str) -> None:
        nonlocal now, common
        text = unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip(" \t\n\r\x0b\x0c"):
                return
            now = Block(around_now, common)
            common = len(around_now)
            out.append(now)
        now.pieces.append((text, stack[-1][1] if stack else 0, links > 0))

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            close = html.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        tag = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not tag and re.match(r"/?[a-zA-Z]", html[lt + 1 : lt + 3]):
            break
        if not tag:
            add("<")
            at = lt + 1
            continue
        at, name, closing = tag.end(), tag[2].lower(), bool(tag[1])
        if name in BLOCK:
            now = None
        elif name == "br":
            add(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[i][0] == name:
                    shut_from(i)
                    break
                if name not in BLOCK and stack[i][0] in SCOPE:
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end if close is None else close.end()
            continue
        if name in VOID or tag[3].endswith("/") and name not in BLOCK:
            continue
        shut = {"p"} if name in BLOCK else set()
        shut |= CLOSES.get(name, set())
        if any(open_[x] for x in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    shut_from(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        number += 1
        parents.append(stack[-1][1] if stack else 0)
        around = first[parents[-1]]
        said.append((NEVER, 0, []) if around <= NEVER else _evidence(name, tag[3], around))
        own = said[-1][0]
        if name == "main":
            mains.add(number)
        first.append(NEVER if own <= NEVER else BUTTON if around == BUTTON or own < LEAST else around + own)
        stack.append((name, number))
        open_[name] += 1
        if name in BLOCK:
            around_now.append((name, number))
        links += name == "a"
    total, within = _totals(parents, said, first, out, mains)
    for b in out:
        _weigh(b, total)
        b.furniture = within[b.element]
    if steps is not None or features:
        more, seen = _around(parents, said, steps, {b.element for b in out} if features else set())
        for b in out:
            b.seen = seen.get(b.element, [])
            if b.score > BUTTON:
                b.score += max(-REACH, min(REACH, more[b.element]))
    kept, common = [], 1 << 30
    for b in out:  # blocks without text to show give way; what the others share is what all between them share
        common = min(common, b.common)
        if b.text:
            b.common, common = common, 1 << 30
            kept.append(b)
    return kept


def terminal(b: Block) -> int:
    """Cost of calling a block boilerplate (positive), or of calling it content (negative).

    Only evidence of furniture makes it negative: points of what the block stands in, or much of its text in links.
    Shortness alone does not, and a heading has a cost of its own. Length speaks for content, but not within sure furniture.
    """
    if b.score <= NEVER:
        return NEVER
    words = b.text.count(" ") + 1
    share = min(1.0, b.linked / max(1, len(b.text)))
    heading = b.name in HEADINGS
    length = 0 if b.furniture else min(30, words // 4)
    return b.score + 4 + (8 if heading else 0) + length - round((10 if heading else 30) * share * share)


def smoothness(a: Block, b: Block) -> int:
    """Strength of the edge between two blocks in a row: less the further apart they stand in the tree, none across the border of sure furniture."""
    return 12 // (1 + max(a.depth, b.depth) - b.common) if b.common and a.furniture == b.furniture else 0


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side (content) of a minimum cut; Dinic's algorithm."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    graph: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: int, back: int) -> None:
        graph[u].append(len(to))
        to.append(v)
        room.append(there)
        graph[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(source, i, c, 0)
        elif c < 0:
            join(i, sink, -c, 0)
    for u, v, w in edges:
        if w:
            join(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        wait = deque([source])
        while wait:
            u = wait.popleft()
            for e in graph[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    wait.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                path, u = [], source
                continue
            while next_[u] < len(graph[u]):
                e = graph[u][next_[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                next_[u] += 1
            if next_[u] < len(graph[u]):
                path.append(graph[u][next_[u]])
                u = to[path[-1]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                next_[u] += 1
            else:
                break


def main_text(html: str, steps: list[int] | None = None) -> str:
    """The content blocks of a page; steps are the classifier's learned points for each feature, None for its prior alone."""
    found = blocks(html, steps)
    edges = [(i, i + 1, smoothness(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last and last[b.parent] != i - 1 and found[last[b.parent]].furniture == b.furniture:
            edges.append((last[b.parent], i, 4))
        last[b.parent] = i
    content = minimum_cut([terminal(b) for b in found], edges)
    return "\n\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, block, words, prior, features) of the blocks of sample pages; page and block are hashes of the html and the text."""
    for batch in batches:
        rows = []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for b in blocks(html, features=True):
                rows.append((page, zlib.crc32(b.text.encode()) | len(b.text) << 32, b.text.count(" ") + 1, terminal(b), sorted(b.seen)))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int32()))], ["page", "block", "words", "prior", "features"])


def learned(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> list[int]:
    """The classifier's points for each feature bucket, from at most `sample` pages with the least hashes of their html; equal pages count once.

    Without pages, or without blocks of both classes, all are 0: the prior stands alone.
    """
    rows = pages.select(text_or_empty(f"`{html}`").alias("t")).where(F.octet_length("t").between(1, LARGEST)).select(F.xxhash64("t").alias("page"), "t")
    chosen = rows.select("page").distinct().orderBy("page").limit(sample)
    some = rows.join(F.broadcast(chosen), "page").groupBy("page").agg(F.min("t").alias("t"))
    told = save(some.mapInArrow(_told, "page long, block long, words long, prior long, features array<int>"), "blocks")
    spread = told.groupBy("block").agg(F.countDistinct("page").alias("pages"))
    marked = told.join(spread, "block").select("features", F.when((F.col("pages") >= PAGES) & (F.col("prior") <= -SURE) | (F.col("prior") <= SURE), F.lit(0)).when((F.col("pages") == 1) & (F.col("words") >= WORDS) & (F.col("prior") > 0), F.lit(1)).alias("label")).where("label is not null")
    one = F.array(F.lit(-1))  # counts the blocks themselves
    counts = marked.select("label", F.explode(F.concat("features", one)).alias("f")).groupBy("f").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    by = {r["f"]: (r["good"], r["bad"]) for r in counts.collect()}  # BUCKETS + 1 rows at most
    good, bad = by.pop(-1, (0, 0))
    steps = [0] * BUCKETS
    if good and bad:
        for f, (g, b) in by.items():
            doubt = DOUBT * (g + b) / (good + bad)  # as many blocks that have it as often as all do
            odds = math.log((g + doubt) / (good + DOUBT)) - math.log((b + doubt) / (bad + DOUBT))
            steps[f] = max(-STEP, min(STEP, round(4 * odds)))
    return steps


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars (code points).

    Character references are decoded, ASCII white space inside a block becomes one space, blocks are joined by two
    newlines. A null or empty page, or one without content, has an empty text. Unclosed tags and comments end with the
    page. Pages may be long and nested deeply: the time for blocks grows with their length. Repeated rows each get their result, equal pages of
    one table equal texts; an empty table gives an empty result. Only the three named columns are read, so others may have any name.
    """
    model = pages.sparkSession.sparkContext.broadcast(learned(pages, html, sample))
    rows = pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`"), text_or_empty(f"`{html}`"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
