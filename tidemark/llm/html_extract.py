"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each in a tree of
containers.  A bidirectional LSTM reads the page's blocks in order (hashed names of the tag path,
hashed words, a few measures of the block and of its container within the page) and labels each
one as article text or not, so a block is judged by the whole page around it.

The labeller is trained in numpy on the driver, on a bounded sample of the pages themselves: where
a page names its parts (article, main, nav, footer, advert classes ...), those names are the
labels.  Every sampled page is also learned from in disguise (its parts renamed) and as the article
of invented layouts (``layouts.py``), whose containers mostly have invented names, so that no single
name or word decides.  Where no page names its parts, invented layouts alone are learned from.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import chain
from operator import or_
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layouts
from .training import Adam, sigmoid

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
#: Elements whose content isn't markup: it ends at the end tag only, or with the page.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>|\Z", re.I) for tag in ("script", "style", "title", "textarea", "iframe")}
#: Elements whose content isn't shown as text; those of svg and math only inside these.
UNSHOWN, FOREIGN_UNSHOWN = frozenset(("template", "select")), frozenset(("desc", "metadata", "defs", "symbol", "annotation", "annotation-xml"))
#: Elements of other vocabularies, in which a tag may close itself, and those of theirs that stand apart from their neighbours.
FOREIGN, APART = frozenset(("svg", "math")), frozenset(("text", "mtd"))
UNQUOTED_END = re.compile(r"=\s*[^\s\"']+/\Z")
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
#: Elements that open a block of their own.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same name, or of any block for p, closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A tag that begins in a text without another end of one.
LONE = re.compile(r"<(?!!--)")
#: Elements that make a part of a page.
SCOPES = frozenset("address article aside body blockquote details dialog div fieldset figure footer form header html main menu nav ol section table td ul".split())

PATHS, WORDS, MEASURES = 192, 32, 6 + 13
INPUTS, HIDDEN = PATHS + WORDS + MEASURES, 16
#: A sigmoid is half a tanh of half its argument: three gates, then the value.
GATES = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), HIDDEN)
#: Pages to learn from (about), the most blocks that one of them may have, and invented layouts (half as many at least).
TRAIN_PAGES, MOST_BLOCKS, LAYOUTS, EPOCHS = 240, 4_000, 1_500, 10
#: What a step keeps of the running mean of the weights.
AVERAGED = np.float32(0.99)
#: Blocks that are learned from in one run; longer pages are dealt to several runs.
RUN = 400
#: Words at the start of a block, and of all pages, that invented blocks are made of.
HEAD, VOCABULARY = 20, 50_000
#: Blocks (with padding) that go through the network at once, rows of inputs made at once, characters of pages read at once.
GROUP_BLOCKS, PART, GROUP_CHARS = 1 << 14, 1 << 12, 1 << 22

Block = tuple[tuple[str, ...], str, float]


@dataclass(slots=True)
class Page:
    """The containers of a page (an element's parent comes before it) and its leaf blocks, in order."""

    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    #: Of each block: its container (-1: none), its text, the share of its characters in links.
    at: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[float] = field(default_factory=list)


def read(html_text: str | None) -> Page:
    """The containers and leaf blocks of a page, in time proportional to its length.

    Text of svg, math, object and noscript counts as the inline text that it is.  Not read are
    scripts, styles, titles, form fields, frames and templates (to the end of the page where they
    have no end tag, as browsers do), closed lists of options, and descriptions and annotations
    inside svg and math.
    """
    page, found = html_text or "", Page()
    last = page.rfind(">") + 1
    page = page[:last] + LONE.sub("&lt;", page[last:])  # no tag begins where none can end
    stack: list[int] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.at.append(stack[-1] if stack else -1)
                found.texts.append(text)
                found.links.append(min(1.0, linked / len(text)))
            parts.clear()
        linked = 0

    ends: dict[str, int] = {}

    def closed(tag: str, at: int) -> bool:
        """Whether an end tag of ``tag`` follows."""
        if tag not in ends:
            ends[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return ends[tag] >= at

    foreign, unshown, depth, tokens = 0, "", 0, TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        text = m["text"]
        if text is not None:
            if unshown:
                continue
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ending, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        empty = attrs.endswith("/") and not UNQUOTED_END.search(attrs) and bool(foreign or tag in FOREIGN)
        if tag in RAW and not ending and not empty:
            tokens = TOKEN.finditer(page, RAW[tag].search(page, m.end()).end())
            continue
        if tag in FOREIGN and not empty:
            foreign = max(0, foreign + (-1 if ending else 1))
        if unshown:
            if tag == unshown and not empty:
                depth += -1 if ending else 1
            if not depth or unshown in FOREIGN_UNSHOWN and not foreign:
                unshown, depth = "", 0
            continue
        if not ending and not empty and (tag in UNSHOWN or foreign and tag in FOREIGN_UNSHOWN) and (tag == "template" or closed(tag, m.end())):
            unshown, depth = tag, 1
            continue
        if tag in BLOCK:
            foreign = 0
        elif foreign and tag in APART:
            parts.append(" ")
        if tag == "a":
            in_link = not ending
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
            in_link = False
            if ending:
                while open_tags[tag]:
                    top = found.names[stack.pop()][0]
                    open_tags[top] -= 1
                    if top == tag:
                        break
                continue
            while stack and ((top := found.names[stack[-1]][0]) == "p" or top in CLOSES.get(tag, ())):
                open_tags[top] -= 1
                stack.pop()
            if tag != "hr":
                names = [tag]
                for kind, *values in ATTR.findall(attrs):
                    prefix = "#" if kind.lower() == "id" else "."
                    names += [prefix + n for n in NAME.findall(next(filter(None, values), "").lower())]
                found.parents.append(stack[-1] if stack else -1)
                found.names.append(tuple(names))
                stack.append(len(found.names) - 1)
                open_tags[tag] += 1
    close()
    return found


def blocks(html_text: str | None) -> list[Block]:
    """(names of the whole tag path, text, share of its characters in links) of each leaf block, in order."""
    page = read(html_text)
    paths: list[tuple[str, ...]] = []
    for parent, own in zip(page.parents, page.names, strict=True):
        paths.append((paths[parent] if parent >= 0 else ()) + own)
    return [(paths[at] if at >= 0 else (), text, link) for at, text, link in zip(page.at, page.texts, page.links, strict=True)]


#: Names (tags, or words of class, id and role) that say what a part of a page is.
MAIN_NAMES = frozenset(("article", "main", ".articlebody"))
OTHER_NAMES = frozenset(
    ("nav", "footer", "aside", "form", "menu", "button", "dialog", "label", "legend")
    + tuple(
        p + n
        for p in ".#"
        for n in (
            "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
            "disclaimer", "footer", "login", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply",
            "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
        )
    )
)


def named_label(names: Iterable[str]) -> int | None:
    """1 or 0 where the path names say what the block is, else None."""
    own = set(names)
    if own & OTHER_NAMES or ("header" in own or ".header" in own or "#header" in own) and not own & MAIN_NAMES:
        return 0
    return 1 if own & MAIN_NAMES else None


#: The names that :func:`named_label` reads.
TELLING = MAIN_NAMES | OTHER_NAMES | {"header", ".header", "#header"}


def named_labels(page: Page) -> list[int | None]:
    """:func:`named_label` of each block."""
    told: list[frozenset[str]] = []
    for parent, own in zip(page.parents, page.names, strict=True):
        above = told[parent] if parent >= 0 else frozenset()
        told.append(above | TELLING.intersection(own) if not TELLING.isdisjoint(own) else above)
    return [named_label(told[at]) if at >= 0 else None for at in page.at]


def put_in(page: Page) -> list[bool]:
    """Whether each block stands in a part that is named for something else (comments, adverts, menus ...) inside a named article.

    Names of elements around the article, and of the article's own, don't count: they say what a page has, not what a block is.
    """
    state: list[int] = []  # 1: in an article, 2: in something else inside it
    for parent, own in zip(page.parents, page.names, strict=True):
        up = state[parent] if parent >= 0 else 0
        state.append(2 if up == 2 or up == 1 and not OTHER_NAMES.isdisjoint(own) else 1 if not MAIN_NAMES.isdisjoint(own) else up)
    return [at >= 0 and state[at] == 2 for at in page.at]


def measures(texts: Sequence[str]) -> np.ndarray:
    """What the whole texts of blocks say, a row each: the bag of hashed words, their number (as a logarithm) and the share of stops."""
    words = [t.encode().split(b" ") for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    cells = np.fromiter(map(crc32, chain.from_iterable(words)), np.int64, n.sum()) % WORDS
    x = np.zeros((len(texts), WORDS + 2), np.float32)
    x[:, :WORDS] = np.bincount(np.repeat(np.arange(len(n)), n) * WORDS + cells, minlength=x[:, :WORDS].size).reshape(-1, WORDS)
    # a long block's bag is the mean of bags of 64 words
    x[:, :WORDS] /= (np.sqrt(np.minimum(n, 64)) * np.maximum(1, n / 64))[:, None]
    x[:, WORDS] = np.log1p(n) / 4
    x[:, WORDS + 1] = np.minimum(1, np.array([sum(map(t.count, ".,;:!?")) for t in texts], np.int64) / n)
    return x


@lru_cache(1 << 16)
def _cells(names: tuple[str, ...]) -> int:
    """The names as set bits of a number."""
    return reduce(or_, (1 << crc32(n.encode()) % PATHS for n in names), 0)


def _within(page: Page | layouts.Layout, words: np.ndarray) -> np.ndarray:
    """What the containers say of each block, from the whole page; ``words``: words of each block.

    A block's scope is the nearest container that makes a part of a page.  The largest scope is the
    one with most words outside links.
    """
    n, nodes = len(page.at), len(page.names)
    scope, up, depth = [nodes] * (nodes + 1), [nodes] * (nodes + 1), [0] * (nodes + 1)  # the last stands for no container
    for k, parent in enumerate(page.parents):
        up[k], depth[k] = scope[parent], depth[parent] + 1  # those of -1 are the last
        scope[k] = k if page.names[k][0] in SCOPES else up[k]
    at, link = np.array(scope)[np.array(page.at, np.int64)], np.array(page.links, np.float64)
    direct, linked, count = (np.bincount(at, x, nodes + 1) for x in (words, words * link, None))
    below = direct.tolist()
    for k in range(nodes - 1, -1, -1):
        if scope[k] == k:
            below[up[k]] += below[k]
    below[nodes], total = float(words.sum()), max(1.0, float(words.sum()))
    best = int(np.argmax(direct - linked))
    inside, beside = [False] * nodes + [best == nodes], [False] * nodes + [up[best] == nodes]
    for k, parent in enumerate(page.parents):
        inside[k], beside[k] = k == best or inside[parent], k == up[best] or beside[parent]
    own, k, below, up = np.flatnonzero(at == best), np.arange(n), np.array(below), np.array(up)
    first, last = (own[0], own[-1]) if len(own) else (0, n)
    return np.stack(
        [
            direct[at] / total, below[at] / total, linked[at] / np.maximum(1, direct[at]), np.log1p(count[at]) / 4,
            at == best, np.array(inside)[at], np.array(beside)[at], k < first, k > last, np.concatenate([[0], at[1:] == at[:-1]])[:n],
            np.minimum(np.array(depth)[at], 32) / 8, below[at] / np.maximum(1, below[up[at]]), words / total,
        ],
        axis=1,
    )


class Inputs:
    """The network's inputs for a page's blocks, made a few thousand rows at a time."""

    def __init__(self, page: Page | layouts.Layout, measured: np.ndarray):
        """``measured``: :func:`measures` of each block."""
        n = len(page.at)
        self.measured, self.at = measured, np.array(page.at, np.int64)
        on, listed = [0] * (len(page.names) + 1), [False] * (len(page.names) + 1)  # the last: no container
        for k, parent in enumerate(page.parents):
            on[k], listed[k] = on[parent] | _cells(page.names[k]), listed[parent] or page.names[k][0] == "li"
        self.on = np.frombuffer(b"".join(x.to_bytes(PATHS // 8, "little") for x in on), np.uint8).reshape(-1, PATHS // 8)
        words = np.expm1(4 * measured[:, WORDS].astype(np.float64))
        para = np.array([k >= 0 and page.names[k][0] == "p" for k in page.at], bool)
        own = [measured[:, WORDS], np.array(page.links, np.float32), measured[:, WORDS + 1], np.arange(n) / max(n, 1), np.array(listed)[self.at], para]
        self.measures = np.concatenate([np.stack(own, axis=1), _within(page, words)], axis=1).astype(np.float32)

    def __len__(self) -> int:
        return len(self.at)

    def rows(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.unpackbits(self.on[self.at[start:stop]], axis=1, bitorder="little"), self.measured[start:stop, :WORDS], self.measures[start:stop]], axis=1, dtype=np.float32)

    def parts(self) -> Iterator[np.ndarray]:
        for k in range(0, len(self), PART):
            yield self.rows(k, k + PART)


class BiLSTM:
    """Two LSTMs over a page's blocks, one from each end, and a logistic output for each block.

    Arrays of both have a leading axis of two; the second LSTM's run against time.
    """

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # remember, to begin with
        self.params = {
            "out": init(2, HIDDEN, 1) / np.float32(np.sqrt(2)), "out_bias": np.zeros(1, np.float32),
            "in": 0.5 * init(2, INPUTS, 4 * HIDDEN), "rec": init(2, HIDDEN, 4 * HIDDEN), "bias": bias,
        }

    def _project(self, x: np.ndarray) -> np.ndarray:
        """Blocks (block, INPUTS) to (2, block, 4 * HIDDEN)."""
        return x @ self.params["in"] + self.params["bias"]

    def _run(self, pre: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (2, time, page, HIDDEN) from projected inputs (2, time, page, 4 * HIDDEN) and,
        if asked to ``keep`` it, what the way back needs; padding keeps the state."""
        (_, steps, n, _), rec = pre.shape, self.params["rec"]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out, kept = np.zeros((2, steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            u = steps - 1 - t
            a = np.stack([pre[0, t], pre[1, u]]) + h @ rec
            a = np.tanh(a * GATES)
            s = 0.5 * a[..., : 3 * HIDDEN] + np.float32(0.5)  # sigmoids
            i, f, o, g = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], a[..., 3 * HIDDEN :]
            m = np.stack([mask[t], mask[u]])[:, :, None]
            new_c = c + m * (f * c + i * g - c)
            tc = np.tanh(new_c)
            new_h = h + m * (o * tc - h)
            if keep:
                kept.append((t, u, h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            out[0, t], out[1, u] = h
        return out, kept

    def _back(self, x: np.ndarray, dout: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        rec = self.params["rec"]
        da_all, drec = np.zeros((2, *x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(rec)
        dh_next = dc_next = np.zeros((2, x.shape[1], HIDDEN), np.float32)
        for t, u, h, c, i, f, o, g, tc, m in reversed(kept):
            dh = np.stack([dout[0, t], dout[1, u]]) + dh_next
            dc = dc_next + m * dh * o * (1 - tc**2)
            own = m * dc
            da = np.concatenate([own * g * i * (1 - i), own * c * f * (1 - f), m * dh * tc * o * (1 - o), own * i * (1 - g**2)], axis=2)
            da_all[0, t], da_all[1, u] = da
            drec += h.transpose(0, 2, 1) @ da
            dh_next = da @ rec.transpose(0, 2, 1) + (1 - m) * dh
            dc_next = own * f + (1 - m) * dc
        flat = da_all.reshape(2, -1, 4 * HIDDEN)
        return {"in": x.reshape(-1, INPUTS).T @ flat, "rec": drec, "bias": flat.sum(axis=1, keepdims=True)}

    def _score(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (time, page) from the states of both."""
        return sigmoid((states @ self.params["out"][:, None]).sum(axis=0)[..., 0] + self.params["out_bias"])

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (..., block, values) of pages as (..., block, page, values), and which blocks there are."""
        longest = max(p.shape[-2] for p in pages)
        x = np.zeros((*pages[0].shape[:-2], longest, len(pages), pages[0].shape[-1]), np.float32)
        mask = np.zeros((longest, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[..., : page.shape[-2], k, :], mask[: page.shape[-2], k] = page, 1
        return x, mask

    def probabilities(self, pages: list[Inputs]) -> list[np.ndarray]:
        """Each page's block probabilities; pages of like length go together."""
        found: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order, group = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), []
        for place, k in enumerate(order):
            group.append(k)
            longest = len(pages[order[place + 1]]) if place + 1 < len(order) else None
            if longest is None or longest * (len(group) + 1) > GROUP_BLOCKS:
                pre, mask = self._pad([np.concatenate([self._project(x) for x in pages[k2].parts()], axis=1) for k2 in group])
                prob = self._score(self._run(pre, mask)[0])
                for place_in, k2 in enumerate(group):
                    found[k2] = prob[: len(pages[k2]), place_in]
                group = []
        return found

    def train(self, runs: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24, rate: float = 5e-3, seed: int = 19) -> None:
        """``runs``: inputs of consecutive blocks; ``labels`` of each: 1, 0, or NaN where unknown."""
        rng, p, adam = np.random.default_rng(seed), self.params, Adam(self.params, rate)
        sizes = np.array([len(r) for r in runs])
        mean = {name: value.copy() for name, value in p.items()}  # of late steps: what the last of them happened to learn weighs little
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) ** 0.5
            order = np.argsort(sizes * rng.uniform(0.7, 1.4, len(runs)))  # runs of like length go together
            groups = [order[k : k + batch] for k in range(0, len(runs), batch)]
            for k in rng.permutation(len(groups)):
                x, mask = self._pad([runs[d] for d in groups[k]])
                y = np.full(mask.shape, np.nan, np.float32)
                for place, d in enumerate(groups[k]):
                    y[: len(labels[d]), place] = labels[d]
                pre = self._project(x.reshape(-1, INPUTS)).reshape(2, *mask.shape, 4 * HIDDEN)
                states, kept = self._run(pre, mask, keep=True)
                known = ~np.isnan(y)
                d = (np.where(known, self._score(states) - np.nan_to_num(y), 0) / max(1, known.sum())).astype(np.float32)
                grads = {"out": np.einsum("wtnh,tn->wh", states, d)[..., None], "out_bias": d.sum(keepdims=True)[0]}
                adam.step(grads | self._back(x, d[:, :, None] * p["out"].transpose(0, 2, 1)[:, None], kept))
                for name, value in p.items():
                    mean[name] += (value - mean[name]) * (1 - AVERAGED)
        for name, value in mean.items():
            p[name][...] = value


def disguised(page: Page, rng: Random) -> Page:
    """The page with its telling names changed for others."""
    to: dict[str, str] = {}

    def other(name: str, tag: bool) -> str:
        if name not in to:
            invented = "".join(rng.choice(layouts.SYLLABLES) for _ in range(rng.randint(1, 4)))
            to[name] = rng.choice(("div", "div", "section")) if tag else name[0] + invented
        return to[name]

    names = [tuple(other(n, k == 0) if n in TELLING or k and rng.random() < 0.3 else n for k, n in enumerate(own)) for own in page.names]
    return Page(page.parents, names, page.at, page.texts, page.links)


def _training_pages(batches: Iterator[pa.RecordBatch], most_blocks: int, head: int) -> Iterator[pa.RecordBatch]:
    kind = pa.schema(
        [("order", pa.int64()), ("parents", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("at", pa.list_(pa.int32())),
         ("heads", pa.list_(pa.string())), ("measured", pa.list_(pa.float32())), ("links", pa.list_(pa.float32()))]
    )
    for batch in batches:
        for order, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = read(whole)
            if not 0 < len(page.at) <= most_blocks or len(page.names) > 4 * most_blocks:
                continue
            heads = [" ".join(t.split(" ", head)[:head]) for t in page.texts]
            measured = measures(page.texts).ravel()
            row = {"order": order, "parents": page.parents, "names": [" ".join(n) for n in page.names], "at": page.at, "heads": heads, "measured": measured, "links": page.links}
            yield pa.RecordBatch.from_pylist([row], kind)


SAMPLE = "order long, parents array<int>, names array<string>, at array<int>, heads array<string>, measured array<float>, links array<float>"


def fit(pages: DataFrame, key: str = "page_id", source: str = "html", train_pages: int = TRAIN_PAGES, most_blocks: int = MOST_BLOCKS, head: int = HEAD, vocabulary: int = VOCABULARY, invented: int = LAYOUTS) -> BiLSTM:
    """A labeller learned from about ``train_pages`` pages of at most ``most_blocks`` blocks, and from ``invented`` layouts.

    Executors measure the blocks; of their text only the first ``head`` words reach the driver, and
    invented blocks are made of ``vocabulary`` of these.  All bounds are of learning alone.
    Repeated pages are learned from once.
    Pages that don't name their parts lend their words to invented layouts; of a table without any
    text, invented words are learned from.
    """
    n = pages.count()
    order = F.pmod(F.xxhash64(F.lit(23), F.col(key), F.col(source)), F.lit(1_000_000))
    sample = pages.where(F.col(source).isNotNull() & (order < int(2 * train_pages / max(n, 1) * 1_000_000) + 1))
    rows = sample.select(order.cast("long").alias("order"), F.col(source)).distinct().mapInArrow(lambda batches: _training_pages(batches, most_blocks, head), SAMPLE)
    first = rows.orderBy("order").limit(2 * train_pages).collect()
    return learned(sorted(first, key=lambda r: (r["order"], r["heads"], r["measured"]))[:train_pages], vocabulary, invented)


def learned(sample: Sequence[Mapping], vocabulary: int = VOCABULARY, invented: int = LAYOUTS) -> BiLSTM:
    """A labeller of the sampled pages, as :func:`_training_pages` measures them."""
    named, words = [], []
    for r in sample:
        page = Page(r["parents"], [tuple(n.split(" ")) for n in r["names"]], r["at"], [], r["links"])
        measured, labels = np.array(r["measured"], np.float32).reshape(-1, WORDS + 2), named_labels(page)
        words += [w for head in r["heads"] for w in head.split(" ")]
        if {0, 1} <= set(labels):
            named.append((page, measured, labels))
    rng = Random(29)
    words = rng.sample(words, min(len(words), vocabulary)) or ["".join(rng.choice(layouts.SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(1_000)]
    runs, ys = [], []

    def learn(page: Page | layouts.Layout, measured: np.ndarray, labels: list[float | None]) -> None:
        x, y = Inputs(page, measured).rows(0, len(labels)), np.array([np.nan if label is None else label for label in labels], np.float32)
        for start in range(0, len(y), RUN):
            runs.append(x[start : start + RUN])
            ys.append(y[start : start + RUN])

    def invent(body: list[tuple[str, np.ndarray]] | None) -> None:
        made = layouts.layout(rng, measures, words, body)
        learn(made, made.measures(), made.labels)

    for page, measured, labels in named:
        learn(page, measured, labels)
        learn(disguised(page, rng), measured, labels)
        body = [(own if (own := page.names[at][0] if at >= 0 else "p") in ("h1", "h2", "h3", "p") else "p", m) for at, m, label in zip(page.at, measured, labels, strict=True) if label == 1]
        invent(body)
    for _ in range(max(invented - len(named), invented // 2)):
        invent(None)
    net = BiLSTM()
    net.train(runs, ys)
    return net


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Pages in groups of at most 128, and of about ``GROUP_CHARS`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if len(group) == 128 or size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def main_text(pages: DataFrame, net: BiLSTM, source: str = "html", name: str = "text") -> DataFrame:
    """The rows of ``pages`` with a string ``name``: the blocks labelled as article text, joined by newlines.

    Of a part that is named for something else inside a named article, no block is kept, however
    much it reads like the article.

    Null and empty pages, and pages of which no block is kept, give the empty string.  Pages are
    read whole and one by one, in time and memory proportional to their length: repeated rows
    alike, an empty table gives an empty table, other columns stay as they are; a column ``name``
    is replaced.  No shuffle.
    """
    pages = pages.drop(name)
    place, shared = pages.columns.index(source), pages.sparkSession.sparkContext.broadcast(net)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts: list[str] = []
            for group in _grouped(batch.column(place).to_pylist()):
                seen = [read(p) for p in group]
                kept = own.probabilities([Inputs(p, measures(p.texts)) for p in seen])
                texts += ["\n".join(t for t, q, out in zip(page.texts, prob, put_in(page), strict=True) if q >= 0.5 and not out) for page, prob in zip(seen, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return pages.mapInArrow(add, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))
