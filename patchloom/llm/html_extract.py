"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A logistic classifier of each block's words,
links, ancestors and their class, id and role names gives the costs of calling it content or
boilerplate; they are the capacities from the source and to the sink. Blocks next to each other
in page order, and blocks under one parent, are joined by smoothness edges. The minimum cut keeps
the blocks on the source's side, so a doubtful block goes with its neighbours.

The classifier is fitted once a run, on the driver, on TRAIN_PAGES generated pages of known
layout (training_pages); nothing is taken from the input, so all pages are judged alike.

Blocks are joined in page order by line breaks. Inside a block character references are decoded,
runs of white space (Unicode) become one space, and both ends are trimmed; empty blocks vanish.

Defined cases: null or empty html, or html without content, gives the empty text; tags left open,
stray end tags, unquoted attributes and cut pages are read on, and an embedded element (svg, button,
iframe, ...) that is empty or has no end tag drops nothing; bare text counts as a block; null
url stays null; repeated rows have equal results; an empty table gives no rows; no block or page
is dropped or cut for its length.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

TRAIN_PAGES = 400
ADJACENT, SIBLING = 0.6, 0.4
# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg title select button object canvas".split())
# Of these, the text up to the next end tag is no markup; in the others elements can stand in each other.
PLAIN = frozenset("script style textarea title".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_NAMES = frozenset("nav navbar navigation navigationbar menu menubar header masthead topbar banner footer sidebar side aside rail ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form share sharing social related recommended breadcrumb breadcrumbs widget toolbar pagination pager tags legal copyright contentinfo complementary skip".split())
GOOD_NAMES = frozenset("article content post entry main body story text articlebody maincontent".split())
TALK_NAMES = frozenset("comment comments reply replies respond discussion disqus responses feedback commentlist".split())
TAG_RE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
EMPTY_RE = re.compile(r"(?:\A|[\s\"']|(?:\A|\s)[^\s=\"']+)/\Z")  # a slash that is not in an unquoted value
NAME_RE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT_RE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TERMINAL = tuple(".!?…。！？:;\"”’»)")
N_FEATURES = 13


class Block:
    __slots__ = ("text", "linked", "path", "parent", "tag")

    def __init__(self, text: str, linked: int, path: tuple, parent: int, tag: str) -> None:
        self.text, self.linked, self.path, self.parent, self.tag = text, linked, path, parent, tag


def names_of(attrs: str) -> frozenset[str]:
    found = set()
    for m in NAME_RE.finditer(attrs):
        for part in SPLIT_RE.findall(m[1] or m[2] or m[3] or ""):
            found.add(part.lower())
    return frozenset(found)


def ends_of(page: str) -> dict[int, int]:
    """For each RAW element that can hold others and has an end tag: where its tags end. An end tag
    belongs to the last open tag of its name."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    pos = 0
    while m := TAG_RE.search(page, pos):
        pos, tag = m.end(), (m[2] or "").lower()
        if tag not in RAW:
            continue
        own = opened.setdefault(tag, [])
        if m[1]:
            if own:
                out[own.pop()] = pos
        elif EMPTY_RE.search(m[3]):
            continue
        elif tag not in PLAIN:
            own.append(pos)
        else:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = close.end() if close else len(page)
    return out


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, int]] = []  # tag, names, serial
    run: list[str] = []
    linked: list[str] = []
    links = serial = 0
    pos, end = 0, len(page)
    ends: dict[int, int] | None = None

    def cut() -> None:
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            own = [x for x in stack if x[0] not in INLINE]
            out.append(Block(text, len(" ".join(entities.unescape("".join(linked)).split())), tuple(stack), own[-1][2] if own else 0, own[-1][0] if own else ""))
        run.clear()
        linked.clear()

    while pos < end:
        m = TAG_RE.search(page, pos)
        piece = page[pos : m.start() if m else end]
        if piece:
            run.append(piece)
            if links:
                linked.append(piece)
        if not m:
            break
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            cut()
        elif tag == "br":
            run.append(" ")
        if tag == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if m[1]:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in RAW and EMPTY_RE.search(m[3]):
            continue
        elif tag in RAW and tag not in PLAIN:
            ends = ends_of(page) if ends is None else ends
            pos = ends.get(pos, pos)
        elif tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = close.end() if close else end
        elif tag not in VOID and not (tag in MATH and EMPTY_RE.search(m[3])):
            shut = CLOSES.get(tag)
            if shut:
                while (at := open_above(stack)) >= 0 and stack[at][0] in shut:
                    del stack[at:]
            serial += 1
            stack.append((tag, names_of(m[3]) if "=" in m[3] else frozenset(), serial))
    cut()
    return out


def open_above(stack: list[tuple[str, frozenset, int]]) -> int:
    """The last open element that is not an inline one; -1 without any."""
    at = len(stack) - 1
    while at >= 0 and stack[at][0] in INLINE:
        at -= 1
    return at


def features(b: Block) -> list[float]:
    tags = [x[0] for x in b.path]
    names = frozenset().union(*(x[1] for x in b.path)) if b.path else frozenset()
    inside = "article" in tags or "main" in tags
    words = b.text.count(" ") + 1
    low = b.text.lower()
    return [
        math.log1p(words), b.linked / len(b.text), float(b.text.endswith(TERMINAL)), float(any(t in BAD_TAGS for t in tags) or ("header" in tags and not inside)),
        float(bool(names & BAD_NAMES)), float(inside), float(bool(names & GOOD_NAMES)), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float("li" in tags or "td" in tags), float(bool(names & TALK_NAMES)), float(words <= 3), float("©" in low or "copyright" in low or "all rights reserved" in low), 1.0,
    ]


def training_pages(pages: int = TRAIN_PAGES, seed: int = 7) -> Iterator[tuple[str, dict[str, bool]]]:
    """Generated pages and, by block text, whether it is content. Texts are unique by a serial word."""
    r = random.Random(seed)
    serial = 0

    def text(lo: int, hi: int, stop: str = ".") -> str:
        nonlocal serial
        serial += 1
        w = ["".join(r.choice("bcdlmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join([f"w{serial}", *w]) + stop

    for _ in range(pages):
        y: dict[str, bool] = {}

        def put(good: bool, form: str, lo: int, hi: int, stop: str = ".", y: dict = y) -> str:
            t = text(lo, hi, stop)
            y[t] = good
            return form.format(t)

        def box(names: str, tag: str, inner: str) -> str:
            how = r.random()
            if how < 0.4 and tag != "div":
                return f"<{tag}>{inner}</{tag}>"
            return f'<div {r.choice(("class", "id"))}="{r.choice(names.split())}">{inner}</div>' if how < 0.9 else f"<div>{inner}</div>"

        menu = "".join(put(False, '<li><a href="/x">{}</a></li>', 0, 2, "") for _ in range(r.randint(3, 9)))
        top = box("nav menu navbar", "nav", f"<ul>{menu}</ul>") + (box("header masthead", "header", put(False, "<p>{}</p>", 1, 8, r.choice(["", "."]))) if r.random() < 0.5 else "")
        extra = [box("ad ads advert sponsor", "div", put(False, "{}", 3, 15)), box("cookie-notice notice consent", "div", put(False, "<p>{}</p>", 8, 25)), box("sidebar related widget", "aside", "".join(put(False, "<p>{}</p>", 3, 20, r.choice(["", "."])) for _ in range(r.randint(1, 3)))), box("newsletter login search", "form", put(False, "<p>{}</p>", 3, 12))]
        body = put(True, "<h1>{}</h1>", 2, 10, r.choice(["", "."]))
        for _ in range(r.randint(2, 12)):
            kind = r.random()
            body += put(True, "<p>{}</p>", 0, 90, r.choice((".", ".", ".", "", " ***"))) if kind < 0.75 else put(True, "<h2>{}</h2>", 1, 6, "") if kind < 0.85 else "<ul>" + "".join(put(True, "<li>{}</li>", 3, 20) for _ in range(3)) + "</ul>" if kind < 0.95 else put(True, '<p><a href="/y">{}</a></p>', 3, 10)
            if r.random() < 0.06:
                body += f'<div class="{r.choice(("ad", "advert", "promo", "share"))}">{put(False, "<p>{}</p>", 3, 15)}</div>'
        talk = "".join(put(False, "<p>{}</p>", 3, 40) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else ""
        talk = talk and f'<div {r.choice(("class", "id"))}="{r.choice(("comments", "comment", "replies", "discussion"))}">{talk}</div>'
        how, late = r.random(), r.random() < 0.5
        body += talk if late else ""
        main = f"<article>{body}</article>" if how < 0.6 else f"<main>{body}</main>" if how < 0.7 else f'<div class="{r.choice(("content", "post", "entry", "story"))}">{body}</div>' if how < 0.95 else f"<div>{body}</div>"
        mid = [x for x in extra if r.random() < 0.6]
        cut = r.randint(0, len(mid))
        foot = box("footer legal copyright", "footer", put(False, r.choice(("<p>{}</p>", "&copy; <b></b>{}")), 3, 15))
        yield f"<html><body>{top}{''.join(mid[:cut])}{main}{'' if late else talk}{''.join(mid[cut:])}{foot}</body></html>", y


def train(pages: int = TRAIN_PAGES) -> list[float]:
    """Weights of the block classifier, by Newton steps with a small ridge."""
    xs, ys = [], []
    for page, y in training_pages(pages):
        for b in blocks_of(page):
            key = b.text.lstrip("© ")
            if key in y:
                xs.append(features(b))
                ys.append(float(y[key]))
    x, y = np.array(xs), np.array(ys)
    w = np.zeros(N_FEATURES)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(N_FEATURES)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
    return w.tolist()


def min_cut(logits: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut. A positive logit is the capacity from
    the source, a negative one that to the sink; edges hold in both directions. Blocking flows over
    the levels of a breadth-first search, so all shortest paths of a length cost one pass."""
    n, eps = len(logits), 1e-9
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in edges:  # an edge and its reverse are neighbours in the lists
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    give, take = [max(0.0, z) for z in logits], [max(0.0, -z) for z in logits]
    while True:
        level, depth, goals = [-1] * n, 0, False
        front = [i for i in range(n) if give[i] > eps]
        for i in front:
            level[i] = 0
            goals = goals or take[i] > eps
        while front and not goals:
            depth += 1
            ahead = []
            for i in front:
                for e in out[i]:
                    j = to[e]
                    if level[j] < 0 and room[e] > eps:
                        level[j] = depth
                        ahead.append(j)
                        goals = goals or take[j] > eps
            front = ahead
        if not goals:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in range(n):
            path: list[int] = []  # edges from the source to where the search stands
            i = source
            while level[source] == 0 and give[source] > eps:
                if level[i] == depth and take[i] > eps:
                    flow = min(give[source], take[i], *(room[e] for e in path))
                    give[source] -= flow
                    take[i] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], source
                    continue
                while tried[i] < len(out[i]) and not (room[out[i][tried[i]]] > eps and level[to[out[i][tried[i]]]] == level[i] + 1):
                    tried[i] += 1
                if tried[i] < len(out[i]) and level[i] < depth:
                    path.append(out[i][tried[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


def extract(page: str | None, weights: list[float]) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    logits = [sum(map(float.__mul__, weights, features(b))) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.path:  # the element that holds the block's own element
            parent = next((x[2] for x in reversed(b.path[:-1]) if x[0] not in INLINE), 0)
            if parent in last:
                edges.append((last[parent], i, SIBLING))
            last[parent] = i
    keep = min_cut(logits, edges)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def main_text(pages: DataFrame, weights: list[float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    w = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), w) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
