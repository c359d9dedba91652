"""Main text of web pages by minimum cut: blocks are labelled content or boilerplate.

All weights are fitted: those of the classifier, whose log odds are the capacities from the terminals, and those of the edges between blocks.
The labels are weak ones, from elements and names that tell content or boilerplate. Two thirds of what the classifier sees have these cues
hidden, and the edges are chosen where they are hidden, so pages without them are labelled by their text and by what stands beside it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, trimmed

# Elements by what they do in a page.
#: Elements whose text is no text of the page.
SILENT = set("script style template head title svg iframe select textarea button canvas audio video datalist xmp noembed noframes".split())
#: Elements whose content is plain characters up to the end tag.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold something other than the article, and those that hold it.
AROUND, MAIN = set("nav header footer aside form menu dialog fieldset".split()), {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block; all others are part of one.
BLOCK = set("address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: An element that ends open ones, and the elements that such an end does not cross.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = set("ul ol dl table div section article blockquote".split())
#: Words of class, id and role names that tell boilerplate, that tell content, and that tell nothing beside another.
BOILER = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies share sharing social related recommended recommendations recommendation toolbar pagination pager login signup copyright complementary contentinfo menu skyscraper teaser teasers".split())
GOOD = set("article post entry story content main body text".split())
NEUTRAL = GOOD | set("site page top bottom left right center box bar list item items links link buttons button wrapper wrap container area block section slot unit inner outer widget header head global primary secondary mobile desktop sticky fixed reader readers user users form the and me on us google sense policy".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_KEY = re.compile(r"[^\s=/>]+|=[^\s=/>]*")
_VALUE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_SPACE = re.compile(r"\s*")
#: Stock phrases of what stands around articles (fixed values): one feature, whose weight is fitted.
STOCK = re.compile(r"©|copyright|all rights reserved|imprint|impressum|privacy|cookie|terms of|subscribe|newsletter|sign (?:in|up)|log ?in|follow us|share (?:this|on)|advert|sponsored|read more|\bwrote:|\brepl(?:y|ied)\b|\bcomments?\b", re.I)
_PARTS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
IN_SILENT, IN_AROUND, IN_BOILER, IN_MAIN, IN_GOOD, IN_LINK, IN_MATH = (1 << k for k in range(7))
#: Weights of edges between neighbours, and between neighbours of one parent, that are tried; scaled capacities are whole numbers.
EDGES, SCALE = [(x, y) for x in (0.0, 0.5, 1.0, 2.0, 3.0) for y in (0.0, 0.5, 1.0, 2.0)], 1000
#: The model is fitted on the blocks of at most PAGES pages (those of smallest hash), by ROUNDS Newton steps with a ridge penalty. Words are
#: counted in WORDS buckets. A terminal's log odds are MOST at most.
PAGES, ROUNDS, RIDGE, WORDS, PRIOR, MOST = 400, 20, 0.1, 4096, 20.0, 8.0
#: Features of a block's text and place, and what tags and names say of it.
TEXT = ("bias", "links", "length", "sentence", "stock", "words", "heading", "paragraph", "item", "before", "after")
#: How many of TEXT are left when tags and place are hidden too.
BARE = 6
CUES = ("around", "boiler", "main", "good", "outside")


class Model(NamedTuple):
    """Weights of TEXT and CUES, log odds of the buckets of words, weights of the two kinds of edges."""

    weights: tuple[float, ...]
    words: tuple[float, ...]
    edges: tuple[float, float]


#: The model where no page of the sample has an article.
DEFAULT = Model((-0.5, -5.0, 2.0, 0.6, -2.0, 1.0, 0.5, 0.8, -1.0, -0.5, -0.5, -8.0, -8.0, 6.0, 1.0, -4.0), (), (1.0, 0.5))


class Block:
    __slots__ = ("text", "linked", "tag", "node", "flags")

    def __init__(self, text, linked, tag, node, flags):
        self.text, self.linked, self.tag, self.node, self.flags = text, linked, tag, node, flags


def attributes(html: str, at: int, missing: set[str]) -> tuple[dict[str, str], int]:
    """The attributes from html[at], inside a tag, and the place after its '>'. A value without its closing quote ends as an unquoted one;
    missing holds the quotes that the rest of the page lacks, so that no end is looked for twice."""
    out: dict[str, str] = {}
    n = len(html)
    while True:
        at = _GAP.match(html, at).end()
        if at >= n:
            return out, n
        if html[at] == ">":
            return out, at + 1
        m = _KEY.match(html, at)
        key, at = m[0].lower(), m.end()
        after = _SPACE.match(html, at).end()
        value = ""
        if after < n and html[after] == "=":
            at = _SPACE.match(html, after + 1).end()
            quote = html[at : at + 1]
            end = -1
            if quote in ("'", '"') and quote and quote not in missing:
                end = html.find(quote, at + 1)
                if end < 0:
                    missing.add(quote)
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                m = _VALUE.match(html, at)
                value, at = m[0], m.end()
        out.setdefault(key, value)


def names_say(names: str) -> int:
    """What class, id and role names say of an element. A name counts as a whole: all of its words must be known, and one must tell."""
    found = 0
    for name in names.split():
        words = _PARTS.findall(_HUMPS.sub("-", name).lower())
        if not words or any(w not in BOILER and w not in NEUTRAL for w in words):
            continue
        if any(w in BOILER for w in words):
            return IN_BOILER
        if any(w in GOOD for w in words):
            found = IN_GOOD
    return found


def blocks(html: str) -> tuple[list[Block], list[int], list[int]]:
    """The page's text blocks in order, and the parents and depths of the elements that begin blocks.

    One scan from start to end: what is left of an unfinished construct is text, and nothing is looked for twice, so time grows with the
    page's length however its tags are nested or broken.
    """
    out: list[Block] = []
    parent, depth = [0], [0]
    # name, what holds inside, place in the stack of the innermost element that begins a block, that element's number
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    is_open: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    missing: set[str] = set()

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                in_links = sum(map(len, unescape("".join(linked)).split()))
                top = stack[-1]
                holder = stack[top[2]]
                out.append(Block(text, in_links / max(1, len(text) - text.count(" ")), holder[0], holder[3], top[1]))
            parts.clear()
            linked.clear()

    def text(t: str):
        flags = stack[-1][1]
        if t and not flags & IN_SILENT:
            parts.append(t)
            if flags & IN_LINK:
                linked.append(t)

    def cut(to: int):
        for e in stack[to:]:
            is_open[e[0]] -= 1
        del stack[to:]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        c = html[lt + 1 : lt + 2]
        if c in ("!", "?") and c:
            comment = html.startswith("<!--", lt)
            end = -1 if (mark := "-->" if comment else ">") in missing else html.find(mark, lt + (4 if comment else 2))
            if end < 0:
                missing.add(mark)
                at = n if comment else lt + 2
            else:
                at = end + len(mark)
            continue
        closing = c == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            text("<")
            at = lt + 1
            continue
        name = m[0].lower()
        named, at = attributes(html, m.end(), missing)
        if closing:
            if name in BLOCK:
                flush()
            if is_open.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            continue
        if name == "br":
            text(" ")
            continue
        block = name in BLOCK and not stack[-1][1] & IN_MATH
        if block:
            flush()
        if name in VOID:
            continue
        if block:
            closes = CLOSES.get(name, ())
            if any(is_open.get(x) for x in closes):
                k = stack[-1][2]
                while k and stack[k][0] not in closes and stack[k][0] not in BARRIER:
                    k = stack[k - 1][2]
                if k and stack[k][0] in closes:
                    if name == "tr":  # a row's cell, and the row
                        up = stack[k - 1][2]
                        k = up if stack[up][0] == "tr" and stack[k][0] != "tr" else k
                    cut(k)
            elif stack[stack[-1][2]][0] == "p":  # a block element ends an open paragraph
                cut(stack[-1][2])
        flags = stack[-1][1]
        if name in SILENT:
            flags |= IN_SILENT
        if name == "a":
            flags |= IN_LINK
        if name == "math":
            flags |= IN_MATH
        if name in AROUND and not (name == "header" and flags & IN_MAIN):
            flags |= IN_AROUND
        if name in MAIN:
            flags = (flags | IN_MAIN) & ~IN_GOOD
        if named:
            if name not in ("body", "html"):
                flags |= names_say(" ".join(named.get(k, "") for k in ("class", "id", "role")))
            if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").lower().replace(" ", ""):
                flags |= IN_SILENT
        if block:
            number = len(parent)
            parent.append(stack[-1][3])
            depth.append(depth[stack[-1][3]] + 1)
            stack.append((name, flags, len(stack), number))
        else:
            stack.append((name, flags, stack[-1][2], stack[-1][3]))
        is_open[name] = is_open.get(name, 0) + 1
        if name in RAW and not (end := re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)):
            break  # the rest of the page is its content
        if name in RAW:
            at = end.start()
    flush()
    return out, parent, depth


def weak_label(b: Block) -> int | None:
    """1 in an article, 0 in what is around one; None where tags and names don't tell."""
    if b.flags & (IN_AROUND | IN_BOILER):
        return 0
    return 1 if b.flags & IN_MAIN else None


def word_buckets(text: str) -> list[int]:
    return [zlib.crc32(w.encode()) % WORDS for w in set(text.lower().split())]


def features(found: list[Block], words: tuple[float, ...] = ()) -> list[tuple[float, ...]]:
    """TEXT and CUES of each block of a page, in steps, so that equal blocks can be counted."""
    heads = [i for i, b in enumerate(found) if b.tag in ("h1", "h2")]
    paragraphs = [i for i, b in enumerate(found) if b.tag == "p"]
    first, last = heads[0] if heads else 0, paragraphs[-1] if paragraphs else len(found)
    article = any(weak_label(b) == 1 for b in found)
    out = []
    for i, b in enumerate(found):
        odds = 0.0
        if words:
            odds = sum(words[k] for k in word_buckets(b.text)) / max(1, b.text.count(" ") + 1)
        text = (
            1.0, round(5 * max(0.0, b.linked - 0.2)) / 5, round(6 * min(1.0, math.log1p(len(b.text)) / 6)) / 6, float(b.text[-1] in ".!?…\"”»"),
            float(len(b.text) < 400 and STOCK.search(b.text) is not None), round(2 * max(-3.0, min(3.0, odds))) / 2,
            float(b.tag in ("h1", "h2", "h3")), float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("li", "dt", "dd", "td", "th", "option")), float(i < first), float(i > last),
        )
        cues = (b.flags & IN_AROUND, b.flags & IN_BOILER, weak_label(b) == 1, b.flags & IN_GOOD, article and not b.flags & IN_MAIN)
        out.append((*text, *(float(bool(c)) for c in cues)))
    return out


def _masked(x: tuple[float, ...], shown: int = len(TEXT)) -> tuple[float, ...]:
    return (*x[:shown], *[0.0] * (len(TEXT) + len(CUES) - shown))


def fit(rows: list[tuple]) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a ridge penalty; rows: features, label, count. Both labels weigh the same, and each row
    stands whole, without its cues, without its tags and place as well, and with each single cue beside the mean text of the other label. So
    the text must tell by itself, and where a cue speaks against it, the cue wins, as it is cues that label."""
    if len({r[-2] for r in rows}) < 2:
        return DEFAULT.weights
    mean = {y: [sum(r[k] * r[-1] for r in rows if r[-2] == y) / sum(r[-1] for r in rows if r[-2] == y) for k in range(len(TEXT))] for y in (0.0, 1.0)}
    rows = [r for x in rows for r in (x, *((*_masked(x[:-2], k), *x[-2:]) for k in (len(TEXT), BARE)), *((*mean[1 - x[-2]], *(float(k == c) for c in range(len(CUES))), *x[-2:]) for k in range(len(CUES)) if x[len(TEXT) + k]))]
    x, y, n = (np.array(v, float) for v in ([r[:-2] for r in rows], [r[-2] for r in rows], [r[-1] for r in rows]))
    for label in (0, 1):
        n[y == label] *= 100 / n[y == label].sum()
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (n * p * (1 - p))) @ x + RIDGE * np.eye(len(w)), x.T @ (n * (y - p)) - RIDGE * w)
    return tuple(np.round(w, 6).tolist())


def word_odds(counts: np.ndarray) -> tuple[float, ...]:
    """Log odds of each bucket from its counts by label, drawn to nothing by PRIOR words that are dealt as all are."""
    share = counts.sum(0) / max(1.0, counts.sum())
    if not share.all():
        return ()
    return tuple(np.round(np.log((counts[:, 1] + PRIOR * share[1]) / (counts[:, 0] + PRIOR * share[0])) - np.log(share[1] / share[0]), 3).tolist())


def _labelled(batches):
    """The blocks of each page, and their weak labels."""
    for batch in batches:
        for part in slices(batch, "html"):
            for html in part.column("html").to_pylist():
                found, parent, depth = blocks(html or "")
                yield found, parent, depth, [weak_label(b) for b in found]


def _counted(seen: dict[tuple, int], names: list[str]) -> pa.RecordBatch:
    rows = [[*k, n] for k, n in seen.items()]
    return pa.RecordBatch.from_arrays([pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(names))], names=names)


def _word_counts(batches):
    seen: dict[tuple, int] = {}
    for found, _, _, labels in _labelled(batches):
        for b, y in zip(found, labels, strict=True):
            for k in word_buckets(b.text) if y is not None else ():
                seen[k, y] = seen.get((k, y), 0) + 1
    yield _counted(seen, ["bucket", "y", "n"])


def _observe(words):
    def run(batches):
        seen: dict[tuple, int] = {}
        for found, _, _, labels in _labelled(batches):
            for x, y in zip(features(found, words), labels, strict=True):
                if y is not None:
                    seen[*x, y] = seen.get((*x, y), 0) + 1
        yield _counted(seen, _NAMES)

    return run


def _tried(weights, words):
    """Edge weights -> blocks rightly kept, wrongly kept, wrongly left, when cues, tags and place are hidden."""

    def run(batches):
        seen = {k: [0, 0, 0] for k in range(len(EDGES))}
        for found, parent, depth, labels in _labelled(batches):
            if not any(y is not None for y in labels):
                continue
            score = [sum(w * v for w, v in zip(weights, _masked(x, BARE), strict=True)) for x in features(found, words)]
            for k, e in enumerate(EDGES):
                for kept, y in zip(min_cut(score, smoothness(found, parent, depth, e)), labels, strict=True):
                    if y is not None and (kept or y):
                        seen[k][0 if kept and y else 1 if kept else 2] += 1
        rows = [(k, *v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["k", "right", "wrong", "left"])

    return run


_NAMES = [f"x{k}" for k in range(len(TEXT) + len(CUES))] + ["y", "n"]


def fitted(pages: DataFrame) -> Model:
    """The model, from the blocks of PAGES pages that tags and names label. Words are counted on one half of these pages, weights and edges
    are fitted on the other, where words were not learned by heart. What comes to the driver are counts: by bucket and label, by equal
    features of the sample's blocks, and by edge weights."""
    hashed = pages.where("html is not null").select("html", F.xxhash64("page_id", "url").alias("h"))
    # the bound comes from the hashes alone, so no task gathers pages of all others; rows of one id and url count once
    last = hashed.select("h").orderBy("h").limit(PAGES).agg(F.max("h")).first()[0]
    few = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("html").alias("html"))
    half = lambda k: few.where(F.pmod("h", F.lit(2)) == k).select("html")
    counts = np.zeros((WORDS, 2))
    for r in half(0).mapInArrow(_word_counts, "bucket double, y double, n double").groupBy("bucket", "y").agg(F.sum("n").alias("n")).collect():
        counts[int(r["bucket"]), int(r["y"])] += r["n"]
    words = word_odds(counts)
    seen = half(1).mapInArrow(_observe(words), ", ".join(f"{c} double" for c in _NAMES)).groupBy(*_NAMES[:-1]).agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in seen.collect())
    if len({r[-2] for r in rows}) < 2:
        return DEFAULT
    weights = fit(rows)
    best, edges = -1.0, EDGES[0]
    tried = half(1).mapInArrow(_tried(weights, words), "k long, right long, wrong long, left long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("right", "wrong", "left")))
    for r in sorted(tried.collect()):
        f1 = 2 * r["right"] / max(1, 2 * r["right"] + r["wrong"] + r["left"])
        if f1 > best - 1e-9:  # of equals the smoothest
            best, edges = f1, EDGES[r["k"]]
    return Model(weights, words, edges)


def scores(found: list[Block], model: Model = DEFAULT) -> list[float]:
    """Log odds that each block is content."""
    return [max(-MOST, min(MOST, sum(w * v for w, v in zip(model.weights, x, strict=True)))) for x in features(found, model.words)]


def min_cut(score_of: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a block is on the source's side of a minimum cut: content. Dinic's algorithm with whole-number capacities."""
    n = len(score_of)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a, b, c, back):
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, s in enumerate(score_of):
        c = round(abs(s) * SCALE)
        if c:
            add(source, i, c, 0) if s > 0 else add(i, sink, c, 0)
    for a, b, w in edges:
        c = round(w * SCALE)
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                keep = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while used[a] < len(head[a]):
                e = head[a][used[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                used[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                used[a] += 1
                continue
            path.append(e)
            a = to[e]


def smoothness(found: list[Block], parent: list[int], depth: list[int], weights: tuple[float, float] = DEFAULT.edges) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, weaker with their distance in the DOM, and between neighbours of one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            x, y, far = found[i - 1].node, b.node, 0
            while x != y:  # no longer than the tags that lie between the two
                if depth[x] >= depth[y]:
                    x, far = parent[x], far + 1
                else:
                    y, far = parent[y], far + 1
            edges.append((i - 1, i, weights[0] / (1 + far)))
        if parent[b.node] in last:
            edges.append((last[parent[b.node]], i, weights[1]))
        last[parent[b.node]] = i
    return edges


def labelled(html: str | None, model: Model = DEFAULT) -> tuple[list[Block], list[bool]]:
    """A page's blocks, and which of them the cut keeps."""
    found, parent, depth = blocks(html or "")
    return found, min_cut(scores(found, model), smoothness(found, parent, depth, model.edges))


def main_text(html: str | None, model: Model = DEFAULT) -> str:
    return "\n\n".join(b.text for b, k in zip(*labelled(html, model), strict=True) if k)


def _extract(model):
    @trimmed
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html).

    Blocks that the cut leaves with the source are joined by an empty line. A page's whole html is read, in time that grows with its length;
    tags may be unclosed, the end may be missing. Null or empty html, or html without text: empty text, 0. Repeated rows and null ids: a row
    each, as given; other columns are not read. Ties of the cut go to boilerplate. An empty table gives an empty result.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract(fitted(pages)), "page_id long, url string, text string, n_chars long")


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; see extracted."""
    return extracted(table(spark, sf_dir, "pages"))
