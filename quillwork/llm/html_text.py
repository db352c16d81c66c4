"""HTML extraction by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier (trained here, on generated pages)
prices each block as content and as boilerplate: these prices are the terminal capacities. Blocks
that are neighbours in the page, and blocks that follow each other below one parent element, are
joined by smoothness capacities. The minimum cut of that network, by maximum flow, separates
content from boilerplate.

Most blocks are decided without flow: where a block's own price difference outweighs all its
edges, no cut labels it otherwise, and its edges pass to its neighbours' terminals.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import table, text_of

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br wbr img input hr".split())
FRINGE = frozenset("nav header footer aside form menu button select option label fieldset dialog search head".split())
BODY = frozenset("article main".split())
#: An open element of these names ends at the next of the same kind.
ENDED_BY = {"p": BLOCK, "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "option": frozenset(("option",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
#: The open elements that each block element ends, within the nearest of BOUNDS.
ENDS = {name: tuple(x for x, by in ENDED_BY.items() if name in by) for name in BLOCK}
BOUNDS = ("ul", "ol", "table", "dl", "div", "article", "section", "td", "select")

#: A tag to its end. A > inside a quoted value does not end it; a quote that is never closed is a character.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)(?>[^>=]+|=\s*+(?:"[^"]*"|'[^']*')?)*+>""")
_HINT = re.compile(r"""[\s"'/](?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", re.I)
_OUT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscri\w+|signup|login|search|share|sharing|social|related|recommend\w*|widget|toolbar|tags?|pagination|pager|legal|copyright|disclaimer|form|contentinfo|complementary|navigation)(?:$|[\s_-])", re.I)
#: An element that a browser does not show.
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|\sstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s>]*)display\s*:\s*none""", re.I)
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|discussion|disqus|responses?|respond)(?:$|[\s_-])", re.I)
_IN = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|text|body|main|page|prose)(?:$|[\s_-])", re.I)
_ENDING = re.compile(r"[.!?…。](?:\s|$)")
_LEGAL = re.compile(r"©|\(c\)\s|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bsubscribe\b|\bsign (?:in|up)\b|\badvertis", re.I)
#: Signs that stand between links, and white space.
_BETWEEN = dict.fromkeys(map(ord, " \t\n\r\f\xa0|/>»›·•-–"))
N_FEATURES = 18


class Block:
    """linked: share of the text in links, without spaces and separators; node: the block element that holds
    the text, as (parent node, depth); flags: what lies around it."""

    __slots__ = ("text", "linked", "node", "tag", "flags")

    def __init__(self, text: str, linked: float, node: tuple, tag: str, flags: tuple):
        self.text, self.linked, self.node, self.tag, self.flags = text, linked, node, tag, flags


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is read as browsers do in the common cases:
    unclosed elements end with their parent, a stray end tag is ignored, an unclosed comment or
    script runs to the end, a tag that the page ends in is no text. Character references are decoded
    within a run of text, never across markup. Time is proportional to the page: open elements are
    found by their names' places, not by search."""
    found: list[Block] = []
    # Open elements: (name, node, fringe, out, talk, body, inn)
    stack: list[tuple] = [("", (None, 0), 0, 0, 0, 0, 0)]
    places: dict[str, list[int]] = {}
    holders = [0]
    pieces: list[str] = []
    linked = 0

    def place(name: str) -> int:
        return places[name][-1] if places.get(name) else 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                holder = stack[holders[-1]]
                found.append(Block(text, linked / max(len(text.translate(_BETWEEN)), 1), holder[1], holder[0], stack[-1][2:]))
            pieces.clear()
        linked = 0

    def text_piece(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(html.unescape(piece) if "&" in piece else piece)
            if places.get("a"):
                linked += len(pieces[-1].translate(_BETWEEN))

    def close(to: int) -> None:
        if holders[-1] >= to:
            flush()
        for i in range(len(stack) - 1, to - 1, -1):
            places[stack[i][0]].pop()
            if holders[-1] == i:
                holders.pop()
        del stack[to:]

    pos, last = 0, page.rfind(">")
    while True:
        lt = page.find("<", pos)
        if lt < 0:
            text_piece(page[pos:])
            break
        following = page[lt + 1 : lt + 2]
        if not (following.isascii() and following.isalpha() or following in ("/", "!", "?")) or not following:
            text_piece(page[pos : lt + 1])
            pos = lt + 1
            continue
        text_piece(page[pos:lt])
        if lt > last:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            pos = len(page) if end < 0 else end + 3
            continue
        match = _TAG.match(page, lt)
        if not match:
            if following.isalpha() or page[lt + 2 : lt + 3].isalpha() and following == "/":
                break
            pos = page.find(">", lt) + 1
            continue
        pos = match.end()
        inside, name = page[lt + 1 : pos - 1], match.group(1).lower()
        if following == "/":
            if name == "p" and not places.get("p"):
                flush()
            at = place(name)
            if at and (name in BLOCK or at > holders[-1]):
                close(at)
            continue
        if name in RAW:
            # Elements of HTML are open in spite of a slash at the end; those of other languages are not.
            if name not in FOREIGN or not inside.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
            at = max(place(x) for x in ENDS[name])
            if at and at >= max(map(place, BOUNDS)):
                close(at)
        if name in SPACED:
            pieces.append(" ")
        if name in VOID:
            continue
        _, above, fringe, out, talk, body, inn = stack[-1]
        out = out or bool(_HIDDEN.search(inside))
        if "=" in inside:
            for hint in map("".join, _HINT.findall(inside)):
                out, talk, inn = out or bool(_OUT.search(hint)), talk or bool(_TALK.search(hint)), inn or bool(_IN.search(hint))
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            holders.append(len(stack))
        stack.append((name, (above, above[1] + 1), fringe or name in FRINGE, out, talk, body or name in BODY, inn))
    flush()
    return found


def block_features(page: list[Block]) -> np.ndarray:
    rows = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        fringe, out, talk, body, inn = b.flags
        rows.append((
            1.0, math.log(words), min(b.linked, 1.0), fringe, out, talk, body, inn, fringe and not body, b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag == "li", b.tag in ("blockquote", "pre", "td", "dd"), bool(_ENDING.search(b.text)), words < 4, words > 25, bool(_LEGAL.search(b.text)) and words < 40,
            (i + 1) / len(page),
        ))
    return np.asarray(rows, dtype=np.float64).reshape(len(rows), N_FEATURES)


# --- the cut ---------------------------------------------------------------------------------

ADJACENT, SIBLING, STRONGEST = 0.8, 0.6, 8.0


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness capacities: neighbours in the page by their DOM distance, and blocks below one parent in turn."""
    out, seen = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + _apart(page[i - 1].node, b.node)) * 2))
        parent = id(b.node[0])
        j = seen.get(parent)
        if j is not None:
            out.append((j, i, SIBLING))
        seen[parent] = i
    return out


def _apart(a: tuple, b: tuple) -> int:
    """Steps between two nodes through their nearest common ancestor."""
    steps = 0
    while a is not b:
        if a[1] >= b[1]:
            a = a[0]
        else:
            b = b[0]
        steps += 1
    return steps


def min_cut(gain: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least energy: a node labelled True earns its gain, each pair of unlike labels costs its
    capacity. Ties are False."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()) and not (gain[i] == 0 and near[i]):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        inside = _source_side(gain, near, rest)
        for i in rest:
            label[i] = i in inside
    return [bool(x) for x in label]


def _source_side(gain: list[float], near: list[dict[int, float]], nodes: list[int]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic's algorithm)."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if gain[i] > 0:
            left[source][i], left[i][source] = gain[i], 0.0
        elif gain[i] < 0:
            left[i][sink], left[sink][i] = -gain[i], 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        turn = {i: iter(list(left[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if left[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for j in turn[i]:
                if left[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    gain = np.clip(block_features(found) @ weights, -STRONGEST, STRONGEST).tolist()
    keep = min_cut(gain, edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


# --- training --------------------------------------------------------------------------------


def _generated(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the words that open its content blocks."""
    content: set[str] = set()
    opened = 0

    def words(a: int, b: int, keep: bool = False) -> str:
        nonlocal opened
        opened += 1
        first = f"q{opened}x"
        if keep:
            content.add(first)
        out, n = [first], rng.randint(a, b)
        for i in range(n):
            out.append("".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 8))) + (". " if rng.random() < 0.12 and i < n - 1 else " "))
        return " ".join(x.strip() for x in out) + rng.choice([".", ".", ".", ""] if keep else ["", "", "."])

    links = lambda n, tag: "".join(f'<{tag}><a href="/x">{words(1, 2)}</a></{tag}>' for _ in range(n))
    bar = lambda: " | ".join(f'<a href="/b">{words(1, 2)}</a>' for _ in range(rng.randint(2, 7)))
    kind = lambda *x: rng.choice(x)
    nav = kind(f"<nav><ul>{links(rng.randint(3, 8), 'li')}</ul></nav>", f'<div class="menu">{links(rng.randint(3, 8), "span")}</div>', f'<ul id="main-nav">{links(5, "li")}</ul>', f"<div>{bar()}</div>", f"<p>{bar()}</p>", f"<ul>{links(rng.randint(3, 8), 'li')}</ul>")
    ad = lambda: kind(f'<div class="ad">{words(4, 20)}.</div>', f'<aside class="sponsored">{words(5, 25)}</aside>', f'<div id="ad-banner"><p>{words(3, 15)}.</p></div>', f'<div class="cookie-notice">{words(6, 20)} <button>{words(1, 1)}</button></div>')
    head = kind("", f"<header><p>{words(1, 5)}</p></header>", f'<div class="header"><a href="/">{words(1, 3)}</a></div>')
    foot = kind(f"<footer>&copy; {words(2, 14)}.</footer>", f'<div class="footer"><p>{words(3, 20)}</p>{links(3, "span")}</div>', f"<footer><p>{words(2, 12)}.</p></footer>", f"<div>{bar()}</div>")
    side = kind("", f'<aside><h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 6), "li")}</ul></aside>', f'<div class="sidebar"><p>{words(3, 20)}.</p></div>')
    form = kind("", f"<form><label>{words(1, 3)}</label><input><button>{words(1, 1)}</button></form>", f'<div class="newsletter"><p>{words(4, 14)}.</p></div>')
    talk = kind("", "", f'<div class="comments"><h3>{words(1, 2)}</h3>' + "".join(f"<p>{words(3, 50)}.</p>" for _ in range(rng.randint(1, 5))) + "</div>", f'<section id="comments"><div class="comment"><p>{words(5, 40)}.</p></div></section>')

    def paragraph() -> str:
        return kind(
            f"<p>{words(1, 80, True)}</p>", f"<p>{words(5, 120, True)}</p>", f"<p><b>{words(3, 40, True)}<br></p>", f"<p>{words(1, 3, True)}</p>",
            f"<h2>{words(1, 8, True)}</h2>", f"<ul><li>{words(2, 12, True)}</li><li>{words(2, 15, True)}</li></ul>", f"<blockquote>{words(5, 30, True)}</blockquote>",
            f'<p>{words(5, 60, True)} <a href="/y">link</a> more.</p>',
        )

    body = "".join(paragraph() + (ad() if rng.random() < 0.08 else "") for _ in range(rng.randint(1, 14)))
    title = f"<h1>{words(2, 12, True)}</h1>"
    article = kind(f"<article>{title}{body}</article>", f"<article>{title}{body}</article>", f"<main>{title}{body}</main>", f'<div class="content">{title}{body}</div>', f'<div id="post">{title}{body}</div>', f"<div>{title}{body}</div>")
    if rng.random() < 0.1:
        return f"<table><tr><td>{nav}</td></tr><tr><td>{title}{body}</td></tr></table>{foot}", content
    return f"<html><head><title>t</title></head><body>{head}{nav}{ad() if rng.random() < 0.7 else ''}{article}{form}{talk}{side}{foot}</body></html>", content


@lru_cache(maxsize=2)
def trained(seed: int = 11, pages: int = 400, steps: int = 400, decay: float = 0.02) -> np.ndarray:
    """Weights of the classifier by gradient descent (Newton-scaled) on generated pages."""
    rng = random.Random(seed)
    rows, truth = [], []
    for _ in range(pages):
        page, content = _generated(rng)
        found = blocks(page)
        rows.append(block_features(found))
        truth += [any(w in content for w in b.text.split()[:2]) for b in found]
    x, y = np.concatenate(rows), np.asarray(truth, dtype=np.float64)
    w = np.zeros(N_FEATURES)
    for _ in range(steps // 20):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + decay * len(x) / 100 * np.eye(N_FEATURES)
        w += np.linalg.solve(hessian, x.T @ (y - p) - decay * len(x) / 100 * w)
    return w


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html, and html without content, gives an empty text. Null ids and urls stay null;
    repeated rows get a row each; pages are read whole. Other columns are never read."""
    weights = trained()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch["h"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("h")).mapInPandas(scan, SCHEMA)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
