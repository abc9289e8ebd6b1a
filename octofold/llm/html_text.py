"""Main text of web pages by a tree-structured graphical model (operator 2).

A page becomes a tree of block elements, and of inline elements with a class, id or role. Each
node has one of three labels: ``AROUND`` (holds the article, or nothing of interest), ``CONTENT``
(the article) and ``BESIDE`` (menus, adverts, notices, comments and the like). Potentials are

* on the edge to its parent: P(label | parent's label, group of the node's tag),
* on the node: P(observation | label) for its tag, each word of its class, id and role, its place
  in the page, and the form of its own text: length, share of links, and whether a sentence ends.

Sum-product messages pass upward and then downward, which gives every node's marginals; texts of
nodes that are CONTENT with 0.5 or more are the result. Only elements that browsers don't show
as text (scripts, styles, form controls, pictures) are left out beforehand.

The potentials are counted on labelled pages: of a bounded sample, the pages that mark their
article (one ``article``, or else one ``main``). What holds it is AROUND, it is CONTENT, all else
is BESIDE, also elements inside with a mark of ``BESIDE_TAGS`` or ``BESIDE_WORDS``. Each page
counts three times: as it is, with the article as a plain ``div`` without class words, and without
the element, so that text tells its label by its form too. Pseudo-counts for common tags and words
stand for pages not seen; with no labelled page they alone decide.

Text rules: character references are decoded, white space inside a block becomes one space, each
block is trimmed and blocks are joined by one newline in page order. A ``br`` is white space.

Defined cases: null or empty html gives the empty text; unclosed and stray tags are repaired; a
tag that never ends is dropped with what follows; repeated rows give repeated results; an empty
table gives none; other columns are ignored, whatever their names. Nothing is dropped or capped
by length. Time is linear in a page's length, and no step recurses.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import table

START = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
SIGNS = re.compile("<+")
REST = re.compile(r"""(?:[^<>"']|"[^"]*"|'[^']*')*+>""")
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
#: Attributes whose words tell the label; no other attribute does, whatever its name or value holds.
TELLING = frozenset("class id role".split())
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Class names that deny a word: they count as one word.
DENIES = re.compile(r"(?:has|no|not|with|without|hide|hidden)[-_]")
SKIPPED = frozenset("script style noscript template iframe textarea title svg object select button canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Tags whose start ends an open one of the first list, up to one of the second.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
#: Common marks of what is beside the article, and of the article: label rules inside of marked
#: articles, and pseudo-counts.
BESIDE_TAGS = frozenset("nav aside footer form dialog menu".split())
BESIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager widget login signup signin search toolbar masthead copyright topbar hidden contentinfo complementary alert".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose".split())
WHOLE = frozenset("html body article main".split())
GROUPS = {t: g for g, tags in {"article": "article main", "text": "p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption", "list": "ul ol dl table tbody thead tr figure", "part": "div section"}.items() for t in tags.split()}
GROUPS |= {t: "inline" for t in INLINE}
AROUND, CONTENT, BESIDE = LABELS = (0, 1, 2)
SAMPLE_PAGES = 2_000
#: Different observations that a model keeps, the most frequent first: its size is bounded, as all
#: tasks get it. Rarer ones count as never seen.
VOCABULARY = 20_000
#: Pseudo-counts: of an observation that tells nothing, of the marks above, of forms of text.
SEEN, MARKED, FORMED = 0.25, 3_000.0, 10.0
#: Share of an observation's probability that is the same for all labels: common tags, forms of
#: text and places say little by themselves, marks much.
MIXED = {"tag": 0.5, "text": 0.35, "place": 0.7}
#: Neighbours are alike: children with text of one parent show as much as so many of them.
BUDGET = 3
#: Pseudo-counts of forms that wrap a page.
WRAPPING = 75.0
#: Pages count for so many edges of a kind at most, so that a change never gets impossible.
EDGES = 90.0
#: Pseudo-counts of a child's label (columns) by the parent's (rows), by group.
STAY = {
    "article": ((0.2, 8, 0.5), (0.01, 8, 1), (0.3, 4, 4)),
    "part": ((4, 3, 3), (0.01, 10, 3), (0.1, 0.3, 12)),
    "list": ((1, 3, 4), (0.01, 15, 0.4), (0.05, 0.1, 12)),
    "text": ((0.1, 5, 3), (0.01, 15, 0.5), (0.05, 0.1, 12)),
    "inline": ((0.1, 5, 3), (0.01, 12, 3), (0.01, 0.05, 15)),
    "other": ((6, 0.5, 4), (0.01, 8, 2), (0.5, 0.1, 12)),
}
ROOT = (0.9, 0.05, 0.05)


def group(tag: str) -> str:
    return GROUPS.get(tag, "other")


class Page:
    """The tree of a page: parents come before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.place = ["#root"], [-1], [()], [0]
        self.chars, self.linked, self.ends, self.inside = [0], [0], [False], [False]
        self.blocks: list[list[tuple[int, str]]] = []
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their nodes
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.walls = [0]  # places in the stack of elements that are not inline
        self.link = 0  # size of the stack where the open link began; 0: none
        self.parts: list[tuple[int, str]] = []
        at, end, last, gone = 0, len(source), source.rfind(">"), set()
        while at < end:
            begin = source.find("<", at)
            self.say(source[at:begin] if begin >= 0 else source[at:])
            if begin < 0:
                break
            if source.startswith("<!--", begin):
                at = source.find("-->", begin + 2) + 3
                if at == 2:
                    break
                continue
            if source.startswith("<<", begin):
                at = SIGNS.match(source, begin).end() - 1
                self.say(source[begin:at])
                continue
            m = START.match(source, begin)
            if not m and source[begin + 1 : begin + 2] not in ("!", "?", "/"):
                self.say("<")
                at = begin + 1
                continue
            if begin > last:
                break
            head = m.end() if m else begin + 1
            rest = REST.match(source, head) if m else None
            at = rest.end() if rest else source.find(">", head) + 1
            if not m:
                continue
            name = m[2].lower()
            if m[1]:
                self.end_tag(name)
            elif name in SKIPPED:
                self.parts.append((self.stack[-1][1], " "))
                ending = None if name in gone else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                close = source.find(">", ending.end()) if ending else -1
                if close >= 0:
                    at = close + 1
                else:
                    gone.add(name)
                    at = end if name in ("script", "style", "textarea", "title") else at
            elif name in VOID:
                if name == "hr":
                    self.flush()
                self.parts.append((self.stack[-1][1], " "))
            else:
                self.start_tag(name, source[head : at - 1], 5 * begin // end)
        self.flush()

    def say(self, text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            node, n = self.stack[-1][1], len(text.strip())
            self.parts.append((node, text))
            self.chars[node] += n
            if self.link:
                self.linked[node] += n

    def flush(self) -> None:
        """Ends a block: its text, in parts by node."""
        if self.parts:
            for node, text in reversed(self.parts):
                if text and not text.isspace():
                    self.ends[node] |= text.rstrip()[-1] in ".!?…:;\"”»"
                    self.blocks.append(self.parts)
                    break
            self.parts = []

    def close(self, down_to: int) -> None:
        if self.walls[-1] >= down_to:
            self.flush()
        for name, _ in self.stack[down_to:]:
            self.open[name].pop()
        del self.stack[down_to:]
        while self.walls[-1] >= down_to:
            self.walls.pop()
        if self.link > len(self.stack):
            self.link = 0

    def top(self, names: tuple[str, ...]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def end_tag(self, name: str) -> None:
        if name == "a":
            self.link = 0
        k = self.top((name,))
        if k and not (name in INLINE and k < self.walls[-1]):
            self.close(k)

    def start_tag(self, name: str, attrs: str, place: int) -> None:
        words = self.named(attrs) if attrs else ()
        if name == "a":
            self.link = len(self.stack)
        if name in INLINE:
            if not words:
                return
        else:
            if name in CLOSES:
                k, bound = map(self.top, CLOSES[name])
                if k > bound:
                    self.close(k)
            elif self.stack[self.walls[-1]][0] == "p":
                self.close(self.walls[-1])
            self.flush()
            self.walls.append(len(self.stack))
        above, node = self.stack[-1][1], len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.words.append(words)
        self.place.append(place)
        self.chars.append(0)
        self.linked.append(0)
        self.ends.append(False)
        self.inside.append(self.inside[above] or name in ("article", "main"))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, node))

    @staticmethod
    def named(attrs: str) -> tuple[str, ...]:
        """The different words of class, id and role, and "hidden" for the attribute of that name."""
        found = {}
        for a in ATTR.finditer(attrs):
            kind = a[1].lower()
            if kind == "hidden":
                found["hidden"] = None
            if kind not in TELLING:
                continue
            for name in (a[2] or a[3] or a[4] or "").lower().split():
                found.update(dict.fromkeys([name] if DENIES.match(name) else WORD.findall(name)))
        return tuple(found)

    def tag_of(self, i: int) -> str:
        """The tag; a header inside an article is another thing than the page's."""
        return "inner header" if self.tag[i] == "header" and self.inside[i] else self.tag[i]

    def observations(self, i: int) -> list[tuple[str, str]]:
        """(kind, value) of what a node shows."""
        tag = self.tag_of(i)
        out = [("tag" if tag in GROUPS else "mark", tag), ("place", str(self.place[i]))]
        out += [("word", w) for w in self.words[i]]
        n = self.chars[i]
        if n:
            size = "short" if n < 25 else "line" if n < 80 else "long" if n < 250 else "very long"
            share = "no" if not self.linked[i] else "some" if 2 * self.linked[i] < n else "most"
            out.append(("text", f"{size}, {share} links, {'a' if self.ends[i] else 'no'} sentence"))
        return out

    def marked(self, i: int) -> bool:
        """Whether a common mark says that the node is beside the article."""
        return self.tag[i] not in WHOLE and (self.tag_of(i) in BESIDE_TAGS or self.tag_of(i) == "header" or not BESIDE_WORDS.isdisjoint(self.words[i]))

    def labels(self) -> tuple[list[int], int] | None:
        """Labels by the page's own marks, and its article's node; None if it has none."""
        mark = next((t for t in ("article", "main") if self.tag.count(t)), None)
        if mark is None or self.tag.count(mark) > 1:
            return None
        at = self.tag.index(mark)
        out = [BESIDE] * len(self.tag)
        up = self.parent[at]
        while up >= 0:
            out[up] = AROUND
            up = self.parent[up]
        out[at] = CONTENT
        for i in range(at + 1, len(out)):
            if out[self.parent[i]] == CONTENT and not self.marked(i):
                out[i] = CONTENT
        return out, at

    def cases(self) -> Iterator[tuple[str, str, int]]:
        """(kind, value, label) to count: of the page, of the page with its article as a plain
        div, and of the page without the element."""
        found = self.labels()
        if found is None:
            return
        labels, at = found
        for turn in ("whole", "plain", "bare"):
            for i in range(1, len(labels)):
                if turn == "bare" and i == at:
                    continue
                plain = turn == "plain" and i == at
                up = labels[self.parent[at if turn == "bare" and self.parent[i] == at else i]]
                yield f"edge {group('div' if plain else self.tag[i])}", str(up), labels[i]
                if plain:
                    yield "tag", "div", CONTENT
                    continue
                for kind, value in self.observations(i):
                    yield kind, value, labels[i]


def prior() -> dict[tuple[str, str, int], float]:
    """Pseudo-counts of common marks, and of forms of text."""
    out = {("tag", "p", CONTENT): FORMED, ("tag", "h1", CONTENT): FORMED, ("tag", "h2", CONTENT): FORMED, ("mark", "form", AROUND): WRAPPING, ("mark", "html", AROUND): MARKED, ("mark", "body", AROUND): MARKED} | {("mark", t, BESIDE): MARKED for t in (*BESIDE_TAGS, "header")}
    out |= {("word", w, BESIDE): MARKED for w in BESIDE_WORDS} | {("word", w, CONTENT): MARKED for w in CONTENT_WORDS}
    for size, share, stop, label in (("long", "no", "a", CONTENT), ("very long", "no", "a", CONTENT), ("line", "no", "a", CONTENT), ("short", "most", "no", BESIDE), ("line", "most", "no", BESIDE)):
        out["text", f"{size}, {share} links, {stop} sentence", label] = FORMED
    return out


class TreeModel:
    """Counts {(kind, value, label): n} turned into potentials."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        self.edge: dict[str, list[tuple[float, float, float]]] = {}
        for g, rows in STAY.items():
            self.edge[g] = []
            for up, pseudo in zip(LABELS, rows):
                n = [counts.get((f"edge {g}", str(up), label), 0) for label in LABELS]
                share = min(1.0, EDGES / max(1.0, sum(n)))
                total = sum(pseudo) + share * sum(n)
                self.edge[g].append(tuple((p + share * x) / total for p, x in zip(pseudo, n)))
        seen: dict[tuple[str, str], list[float]] = {}
        for source in (prior(), counts):
            for (kind, value, label), n in source.items():
                if not kind.startswith("edge "):
                    seen.setdefault((kind, value), [0.0, 0.0, 0.0])[label] += n
        totals: dict[str, list[float]] = {}
        for (kind, _), n in seen.items():
            have = totals.setdefault(kind, [1.0, 1.0, 1.0])
            for label in LABELS:
                have[label] += n[label]
        self.seen: dict[tuple[str, str], tuple[float, float, float]] = {}
        for (kind, value), n in seen.items():
            # smoothed in proportion to the labels' totals: a value never seen favours none
            share = [(x + SEEN * t / sum(totals[kind])) / t for x, t in zip(n, totals[kind])]
            whole, mixed = sum(n) / sum(totals[kind]), MIXED.get(kind, 0.0)
            share = [(1 - mixed) * x + mixed * whole for x in share]
            self.seen[kind, value] = tuple(x / max(share) for x in share)

    def own(self, page: Page, i: int, share: float = 1.0) -> list[float]:
        """The product of a node's observations, for each label; ``share`` is the power of those
        that are no marks."""
        a = b = c = 1.0
        for o in page.observations(i):
            p = self.seen.get(o)
            if p:
                if share < 1 and o[0] in MIXED:
                    p = [x**share for x in p]
                a, b, c = a * p[0], b * p[1], c * p[2]
                if a + b + c < 1e-200:
                    a, b, c = a * 1e200, b * 1e200, c * 1e200
        return [a, b, c]

    def marginals(self, page: Page) -> list[float]:
        """P(CONTENT) of every node: messages to the parents, last node first, then back down.
        Messages are products of positive numbers, scaled to a largest one of 1."""
        n = len(page.tag)
        edges = [self.edge[group(t)] for t in page.tag]
        beside = Counter(p for p, chars in zip(page.parent, page.chars) if chars)
        below = [self.own(page, i, min(1.0, BUDGET / max(1, beside[page.parent[i]]))) for i in range(n)]
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            x, y, z = below[i]
            m = [e[0] * x + e[1] * y + e[2] * z for e in edges[i]]
            top = max(m)
            up[i] = u = (m[0] / top, m[1] / top, m[2] / top)
            p = below[page.parent[i]]
            p[0], p[1], p[2] = p[0] * u[0], p[1] * u[1], p[2] * u[2]
            top = max(p)
            if top < 1e-50:
                p[0], p[1], p[2] = p[0] / top, p[1] / top, p[2] / top
        down: list[tuple[float, ...]] = [ROOT] * n
        out = []
        for i in range(n):
            if i:
                p, u, q = down[page.parent[i]], up[i], below[page.parent[i]]
                x, y, z = p[0] * q[0] / u[0], p[1] * q[1] / u[1], p[2] * q[2] / u[2]
                e = edges[i]
                d = [e[0][v] * x + e[1][v] * y + e[2][v] * z for v in LABELS]
                top = max(d)
                down[i] = (d[0] / top, d[1] / top, d[2] / top)
            a, b, c = (s * t for s, t in zip(down[i], below[i]))
            out.append(b / (a + b + c))
        return out

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        if not page.blocks:
            return ""
        good = [p >= 0.5 for p in self.marginals(page)]
        texts = (" ".join("".join(t for node, t in block if good[node]).split()) for block in page.blocks)
        return "\n".join(t for t in texts if t)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Counts of edges and observations over the labelled pages of a bounded sample."""
    n = pages.count()
    if not n:
        return TreeModel({})
    scale = 1 << 30
    drawn = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(scale)) < min(scale, sample_pages * scale // n + 1)).where("html is not null").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                counts.update(Page(source).cases())
        keys = list(counts)
        cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "value", "label", "n"])

    rows = drawn.mapInArrow(run, "kind string, value string, label int, n long").groupBy("kind", "value", "label").agg(F.sum("n").alias("n"))
    kept = rows.orderBy(F.desc("n"), "kind", "value", "label").limit(VOCABULARY).collect()
    return TreeModel({(r["kind"], r["value"], r["label"]): r["n"] for r in kept})


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text and n_chars of every page, where it was read."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))


QUERIES = {"op2_html_text": op2_html_text}
