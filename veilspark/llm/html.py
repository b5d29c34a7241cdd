"""Operator 7: main text of web pages by boosted trees over DOM nodes and a decoding that respects the tree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting, html_samples
from .sampling import slices

# Fixed lists of HTML element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video select textarea head title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt tr td th".split())
# What a start tag ends: the nearest open element of the first kind that has none of the second kind around it within.
ENDS = [
    (frozenset({"p"}), frozenset({"article", "div", "section", "td", "li", "button"}), CLOSES_P),
    (frozenset({"li"}), frozenset({"ul", "ol", "menu"}), frozenset({"li"})),
    (frozenset({"dt", "dd"}), frozenset({"dl"}), frozenset({"dt", "dd"})),
    (frozenset({"td", "th"}), frozenset({"table", "tr"}), frozenset({"td", "th", "tr"})),
    (frozenset({"tr"}), frozenset({"table"}), frozenset({"tr"})),
    (frozenset({"option"}), frozenset(), frozenset({"option"})),
]
KINDS = [{"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "dialog"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"div", "section"}, {"table", "tr", "td", "th", "tbody"}, {"figure", "figcaption"}]

# As HTML says: quotes count only after an equals sign; a tag that never ends takes the rest of the page.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>?)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I | re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "textarea", "title")}
LEAST_SEEN = 8  # nodes that must have an attribute token, for it to count
TOKEN_PAGES, TOKEN_SEED = 400, 11  # made-up pages that the tokens' weights are learned from, apart from those of the trees
KEEP_COST, MIX_COST = 3.0, 0.5  # of a dropped part within a kept one; of a mixed node


class Page:
    """Block elements of a page in order, and the runs of text that lie in them directly."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["body"], [("", "", "", False)]
        self.runs: list[tuple[int, list[tuple[str, bool]]]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, link, open_run, at, end = [0], False, False, 0, len(source)
        scopes, opened, endless = [(-1,) * len(ENDS)], Counter(), set()

        def drop(to: int) -> None:
            for node in stack[to:]:
                opened[self.tag[node]] -= 1
            del stack[to:], scopes[to:]

        def say(text: str) -> None:
            nonlocal open_run
            if not open_run or self.runs[-1][0] != stack[-1]:
                self.runs.append((stack[-1], []))
                open_run = True
            self.runs[-1][1].append((text, link))

        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                say(source[at:])
                break
            if m.start() > at:
                say(source[at : m.start()])
            at, close, tag = m.end(), m[1], (m[2] or "").lower()
            if not tag:
                continue
            if not m[4]:
                break
            if tag in INLINE:
                link = not close if tag == "a" else link
                continue
            if tag == "br":
                say("\n")
                continue
            if not close and tag in _END and tag not in endless and not m[3].endswith("/"):
                stop = _END[tag].search(source, at)
                if stop is None:
                    endless.add(tag)
                at = stop.end() if stop else (end if tag in ("script", "style") else at)
                continue
            open_run = False
            if tag in VOID or tag in ("html", "body"):
                continue
            if close:
                if opened[tag]:
                    i = len(stack) - 1
                    while self.tag[stack[i]] != tag:
                        i -= 1
                    drop(i)
                    link = False
                continue
            for k, (_, _, starts) in enumerate(ENDS):
                if tag in starts and scopes[-1][k] > 0:
                    drop(scopes[-1][k])
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.attrs.append(_attributes(m[3]))
            if not m[3].endswith("/"):
                scopes.append(tuple(len(stack) if tag in kinds else -1 if tag in bars else old for old, (kinds, bars, _) in zip(scopes[-1], ENDS)))
                stack.append(len(self.tag) - 1)
                opened[tag] += 1

    def texts(self) -> list[tuple[int, str, int]]:
        """(node, text, characters in links) of each run: references decoded, white space made one space."""
        out = []
        for node, parts in self.runs:
            plain = [(entities.unescape(t) if "&" in t else t, link) for t, link in parts]
            text = " ".join("".join(t for t, _ in plain).split())
            if text:
                out.append((node, text, min(len(text), sum(len(t.strip()) for t, link in plain if link))))
        return out


def _attributes(raw: str) -> tuple[str, str, str, bool]:
    if not raw or raw.isspace():
        return "", "", "", False
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", raw))
    return got.get("class", ""), got.get("id", ""), f"{got.get('role', '')} {got.get('itemprop', '')}", hidden


@lru_cache(1 << 14)
def _tokens(attrs: tuple[str, str, str, bool]) -> tuple[str, ...]:
    return tuple({w.lower() for part in attrs[:3] for w in _PART.findall(part)})


def node_features(page: Page, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str, int]]]:
    """A row of features for each node, the characters that lie in it directly, and the runs."""
    runs, n = page.texts(), len(page.tag)
    own, links, stops, begin = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    total = 0
    for node, text, linked in runs:
        if not own[node]:
            begin[node] = total
        own[node] += len(text)
        links[node] += linked
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        total += len(text)
    parent = page.parent
    kind = np.zeros((n, len(KINDS)))
    bad, good, hidden = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (tag, attrs) in enumerate(zip(page.tag, page.attrs)):
        for j, names in enumerate(KINDS):
            if tag in names:
                kind[i, j] = 1
        for w in map(weights.get, _tokens(attrs)):
            if w:
                good[i] += max(w, 0.0)
                bad[i] += max(-w, 0.0)
        hidden[i] = attrs[3] or tag in UNSEEN
    sub = np.stack([own, links, stops, np.ones(n), kind[:, 6], kind[:, 8], (own > 0).astype(float)])
    for i in range(n - 1, 0, -1):
        sub[:, parent[i]] += sub[:, i]
    depth, up_bad, up_good = np.zeros(n), bad.copy(), good.copy()
    up = np.zeros((n, 7))  # article or main, navigation, header, footer, aside, form, list, among the ancestors
    mine = np.column_stack([kind[:, 0], kind[:, 1], kind[:, 2], kind[:, 3], kind[:, 4], kind[:, 5], kind[:, 9]])
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        up_bad[i] += up_bad[p]
        up_good[i] += up_good[p]
        hidden[i] = max(hidden[i], hidden[p])
        up[i] = np.maximum(up[p], mine[p])
        kids[p].append(i)
    rank, many, size, alike = np.zeros(n), np.ones(n), sub[0].copy(), np.ones(n)
    for group in kids:
        if group:
            mean, tags = sub[0][group].mean(), Counter(page.tag[j] for j in group)
            for k, i in enumerate(group):
                rank[i], many[i], size[i] = k / len(group), len(group), mean
                alike[i] = tags[page.tag[i]] / len(group)
    chars = np.maximum(sub[0], 1)
    x = np.column_stack(
        [kind, up, bad, good, up_bad, up_good, hidden, depth, np.log1p(own), np.log1p(sub[0]), links / np.maximum(own, 1), sub[1] / chars, sub[0] / sub[3], 50 * stops / np.maximum(own, 1), 50 * sub[2] / chars]
        + [np.log1p(sub[4]), np.log1p(sub[5]), sub[0] / np.maximum(sub[6], 1), rank, np.log1p(many), np.log1p(size), alike, begin / max(total, 1), sub[0] / max(total, 1)]
    )
    return x, own, runs


def decode(parent: list[int], own: np.ndarray, logit: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Whether each node's own text is kept, by the best consistent labelling of the whole tree: below a dropped
    node all is dropped, below a kept one parts may be dropped at a cost, and nodes above both are mixed, whose
    own text is dropped. Exact, bottom up and then top down."""
    n = len(parent)
    gain = np.clip(logit, -4, 4) * np.where(own > 0, np.log1p(own), 0.7)
    gain[hidden > 0] = -50.0
    best = np.stack([gain, -gain, np.where(own > 0, -gain, 0.0) - MIX_COST], axis=1)  # kept, dropped, mixed
    for i in range(n - 1, 0, -1):
        k, d, m = best[i]
        p = parent[i]
        best[p, 0] += max(k, d - KEEP_COST)
        best[p, 1] += d
        best[p, 2] += max(k, d, m)
    state = np.zeros(n, np.int8)
    state[0] = int(best[0].argmax())
    for i in range(1, n):
        k, d, m = best[i]
        s = state[parent[i]]
        state[i] = (1 if d - KEEP_COST > k else 0) if s == 0 else 1 if s == 1 else int(np.argmax((k, d, m)))
    return state == 0


def _labelled(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Of a made-up page the nodes with text below, and whether most of it is main text."""
    kept, total = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for node, text, _ in page.texts():
        total[node] += len(text)
        kept[node] += len(text) * (html_samples.MARK in text)
    for i in range(len(page.tag) - 1, 0, -1):
        kept[page.parent[i]] += kept[i]
        total[page.parent[i]] += total[i]
    use = np.flatnonzero(total > 0)
    return use, (kept[use] > 0.5 * total[use]).astype(float)


def token_weights() -> dict[str, float]:
    """What each attribute token (of class, id, role, itemprop) says of a node, as the logarithm of its odds."""
    seen, main, n, hits = Counter(), Counter(), 0, 0.0
    for source in html_samples.pages(TOKEN_PAGES, TOKEN_SEED):
        page = Page(source)
        for i, y in zip(*_labelled(page)):
            n, hits = n + 1, hits + y
            for w in _tokens(page.attrs[i]):
                seen[w] += 1
                main[w] += y
    base = np.log(hits / (n - hits))
    return {w: float(np.log((main[w] + 1) / (k - main[w] + 1)) - base) for w, k in seen.items() if k >= LEAST_SEEN}


@dataclass(frozen=True)
class Extractor:
    weights: dict[str, float]
    trees: boosting.Boosted


@lru_cache(1)
def model() -> Extractor:
    """Trees learned from pages that html_samples makes, whose main text is known."""
    weights = token_weights()
    xs, ys, ws = [], [], []
    for source in html_samples.pages():
        page = Page(source)
        x, own, _ = node_features(page, weights)
        use, y = _labelled(page)
        xs.append(x[use])
        ys.append(y)
        ws.append(np.where(own[use] > 0, 1.0, 0.3))
    return Extractor(weights, boosting.fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)))


def extract(sources: list[str | None], how: Extractor) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    rows = [node_features(p, how.weights) for p in pages]
    cuts = np.cumsum([len(r[0]) for r in rows])[:-1]
    logits = np.split(how.trees.logit(np.concatenate([r[0] for r in rows])), cuts) if rows else []
    out = []
    for page, (x, own, runs), logit in zip(pages, rows, logits):
        keep = decode(page.parent, own, logit, x[:, len(KINDS) + 7 + 4])
        out.append(" ".join(text for node, text, _ in runs if keep[node]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html, one without text and one whose text is all chrome give an empty text and 0. Markup may
    be broken: elements end as HTML says they do, or with the page. Repeated rows stay; pages may be of any
    length and depth (the work grows in proportion); an empty table gives an empty result; other columns are left alone.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(parts):
            texts = extract(p.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([p.column("page_id"), p.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
