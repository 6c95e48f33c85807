"""The main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: runs of text between the tags of block elements. A logistic model over a block's containers, names,
links, length and punctuation gives its cost for either label: the log-odds. It is learned on a fixed number of labelled pages
(`PAGES`, see `html_layouts`), as is how much smoothness weighs. Blocks next to each other, and
blocks with the same parent, pay for different labels, the more the closer they stand in the tree. The
cheapest labelling is a minimum cut: costs are the capacities of edges to the two terminals, smoothness that of
edges between blocks, and a maximum flow separates content from boilerplate. Blocks whose own cost outweighs all
their edges can be labelled without a flow; the rest is solved by augmenting paths.

Scripts, styles, forms' controls and other elements without prose are never blocks. Raw text (a script, a title) ends at its end
tag or with the page; the others are left out from start tag to end tag, and where no end tag is, only the tag is.

Defined cases: null and empty pages have an empty text and 0 characters; unclosed, misnested and unknown tags, and a lone "<",
are read as browsers roughly do; pages of any length are read whole; repeated rows and null ids stay rows of their own; further
columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_layouts
from .common import bounded_batches, column, slices, texts

_raw = "script|style|noscript|textarea|title|iframe"
_token = re.compile(
    rf"<!--(?:.*?-->|.*)|<(?P<raw>{_raw})(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^<>]*+>|\Z))|<[!?][^<>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
#: Elements with markup of their own but without prose.
DROPPED = frozenset("template svg object canvas select audio video".split())
_drops = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_hidden = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_camel = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose tags part blocks; those of the second set close an open element of the same kind.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label option".split())
ONCE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl article section aside nav main body div form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADER = -90
#: What containers say of their text; negative for boilerplate.
TAGS = {"article": 80, "main": 60, "nav": -160, "footer": -160, "aside": -160, "header": HEADER, "form": -160, "menu": -120, "dialog": -160, "button": -160, "label": -120, "fieldset": -120, "legend": -120, "option": -160, "head": -400}
BAD = frozenset("ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs toc footer foot header masthead topbar toolbar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget search form copyright legal pagination pager tags skip hidden".split())
#: A header is boilerplate at the top of a page; inside an article it holds the article's own heading.
HEADERS = frozenset("header head masthead topbar".split())
GOOD = frozenset("article content post entry story main text body prose page maincontent".split())
#: Capacity of one unit of log-odds; what neighbours and children of a parent pay at most, before the learned weight.
UNIT, NEAR, SAME = 64, 1.0, 0.5
#: Labelled pages that costs are learned on, as many for the weight of smoothness, and the weights tried; strength of the prior.
PAGES, WEIGHTS, PRIOR = 400, (0.5, 1.0, 2.0, 4.0, 6.0), 0.3


@lru_cache(8192)
def _hint(name: str, attrs: str) -> int:
    """What a container's tag and names say: the names outweigh the tag, bad names good ones."""
    hint = TAGS.get(name, 0)
    if attrs and name not in ("html", "body"):
        if _hidden.search(attrs):
            return -200
        found = {w.lower() for m in _named.finditer(attrs) for w in _camel.findall(" ".join(filter(None, m.groups())))}
        if found & BAD:
            return min(hint, -120 if found & BAD - HEADERS else HEADER)
        if found & GOOD:
            return max(hint, 50) if hint >= 0 else hint
    return hint


class _Block:
    __slots__ = ("linked", "path", "tag", "text")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path
        self.tag = path[-1][1] if path else ""


def _hints(path: tuple, wrappers: set[int]) -> tuple[int, bool]:
    """What the innermost container that says something of a block says, and whether boilerplate is around that one."""
    found = 0
    for k in range(len(path) - 1, -1, -1):
        number, _, hint = path[k]
        if hint == HEADER and any(tag == "article" for _, tag, _ in path[:k]):
            continue
        if hint and not (hint < 0 and number in wrappers):
            if found and hint <= -120:
                return found, True
            found = found or hint
    return found, False


def _wrappers(found: list[_Block]) -> set[int]:
    """Containers around both a heading of the first level and an article or main element: layout, whatever their name."""
    titled, storied = set(), set()
    for b in found:
        inner = False
        for number, tag, _ in reversed(b.path):
            if inner:
                storied.add(number)
            inner = inner or tag in ("article", "main")
        if b.tag == "h1":
            titled.update(number for number, tag, _ in b.path if tag not in TAGS)
    return titled & storied


def _dropped(html: str) -> dict[int, int]:
    """Where elements without prose start and end; one that its own end tag does not close, before that of an element around
    it, is none."""
    spans: dict[int, int] = {}
    if not _drops.search(html):
        return spans
    stack: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    for m in _token.finditer(html):
        name = (m["name"] or "").lower()
        if name not in DROPPED and (name not in BLOCKS or name in VOID):
            continue
        if m["end"]:
            found = ""
            while count[name] and found != name:
                found, start = stack.pop()
                count[found] -= 1
            if found and name in DROPPED:
                spans[start] = m.end()
        elif name != "svg" or not m["attrs"].endswith("/"):
            stack.append((name, m.start()))
            count[name] += 1
    return spans


def blocks(html: str) -> list[_Block]:
    """The page's blocks in order."""
    out: list[_Block] = []
    # open block elements: (number, tag, hint)
    stack: list[tuple[int, str, int]] = []
    parts: list[str] = []
    linked = number = done = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(_Block(text, min(linked, len(text)), tuple(stack)))
            parts.clear()
        linked = 0

    dropped = _dropped(html)
    for m in _token.finditer(html):
        if m.start() < done:
            continue
        if m.start() > done:
            piece = html[done : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        done = dropped.get(m.start(), m.end())
        name = m["name"]
        if not name or m.start() in dropped:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            parts.append(" ")
        elif name == "head":
            flush()
            if m["end"]:
                while stack and stack.pop()[1] != "head":
                    pass
            else:
                number += 1
                stack.append((number, "head", TAGS["head"]))
        elif name in BLOCKS:
            flush()
            if name == "body" and not m["end"]:
                stack[:] = [x for x in stack if x[1] != "head"]
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
                    if stack[k][1] in FENCES and name in ("p", "li", "td", "tr", "dt", "dd"):
                        break
            elif name not in VOID:
                if name in ONCE or (stack and stack[-1][1] == "p"):
                    gone = ONCE.get(name, {"p"}) | {"p"}
                    while stack and stack[-1][1] in gone:
                        stack.pop()
                number += 1
                stack.append((number, name, _hint(name, m["attrs"])))
    if done < len(html):
        parts.append(html[done:])
    flush()
    return out


FEATURES = 16


def features(found: list[_Block]) -> np.ndarray:
    """What the model reads of each block."""
    out, wrappers = np.zeros((len(found), FEATURES)), _wrappers(found)
    for row, b in zip(out, found, strict=True):
        hint, inside = _hints(b.path, wrappers)
        words, linked = b.text.count(" ") + 1, b.linked / len(b.text)
        heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
        end = b.text[-1] in ".!?…:;\"')”»"
        row[:] = (
            1, hint >= 80, 50 <= hint < 80, 0 < hint < 50, hint == HEADER, -160 < hint <= -120, -400 < hint <= -160, hint <= -400, inside, not hint and end and words > 8,
            math.log2(min(words, 64)) / 3, linked, linked > 0.8 and hint <= 0, end, b.tag in ("p", "blockquote", "pre"), heading,
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, *, prior: float = PRIOR, steps: int = 25) -> np.ndarray:
    """Weights of the penalised logistic model, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - prior * w
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + prior * np.eye(len(w)), slope)
    return w


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    smooth: float

    def costs(self, found: list[_Block]) -> list[int]:
        """For each block how much dearer the label boilerplate is than content."""
        return np.rint(UNIT * (features(found) @ np.array(self.weights))).astype(int).tolist()

    def labels(self, found: list[_Block]) -> list[bool]:
        return cut(self.costs(found), edges(found, self.smooth))


@lru_cache(1)
def model(pages: int = PAGES) -> Model:
    """Costs learned on labelled pages, the weight of smoothness on as many others."""
    learn, tune = ([(found := blocks(html), np.array([b.text in content for b in found], float)) for html, content in html_layouts.labelled(pages, seed)] for seed in (1, 2))
    weights = tuple(fit(np.concatenate([features(found) for found, _ in learn]), np.concatenate([y for _, y in learn])).tolist())
    wrong = {w: sum(int((np.array(Model(weights, w).labels(found)) != y).sum()) for found, y in tune) for w in WEIGHTS}
    return Model(weights, min(WEIGHTS, key=lambda w: (wrong[w], w)))


def edges(found: list[_Block], smooth: float) -> list[tuple[int, int, int]]:
    """Smoothness between neighbours, by the depth that they share, and between a parent's children."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = len(a.path) + len(b.path)
            for x, y in zip(a.path, b.path, strict=False):
                if x[0] != y[0]:
                    break
                apart -= 2
            out.append((i - 1, i, round(UNIT * smooth * NEAR / (1 + apart / 2))))
        holder = b.path[-2][0] if len(b.path) > 1 else 0
        if holder in last and last[holder] != i - 1:
            out.append((last[holder], i, round(UNIT * smooth * SAME)))
        last[holder] = i
    return [e for e in out if e[2]]


def cut(cost: list[int], smooth: list[tuple[int, int, int]]) -> list[bool]:
    """The labels (True: content) that minimise the sum of costs and of smoothness between unlike blocks."""
    n = len(cost)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in smooth:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    cost, label = list(cost), [None] * n
    queue = deque(range(n))
    while queue:  # a cost that outweighs all edges decides its block
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _flow(rest, cost, near)
        for i in rest:
            label[i] = i in side
    return label


def _flow(rest: list[int], cost: list[int], near: list[dict[int, int]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the blocks that the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {i: dict(near[i]) for i in rest}
    room[source], room[sink] = {}, {}
    for i in rest:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0
        elif cost[i] < 0:
            room[i][sink], room[sink][i] = -cost[i], 0
    while True:
        back = {source: source}
        queue = deque([source])
        while queue and sink not in back:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 0 and v not in back:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            return set(back)
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        least = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= least
            room[v][u] = room[v].get(u, 0) + least


def main_text(html: str, learned: Model | None = None) -> str:
    found = blocks(html)
    if not found:
        return ""
    label = (learned or model()).labels(found)
    return " ".join(b.text for b, keep in zip(found, label, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    learned = model()  # on the driver, once; a few numbers go to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = [main_text(x, learned) for x in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
