"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between the edges of block elements, in page
order, each with its path of open elements (tags, class and id words). A bidirectional LSTM in
numpy reads the blocks of a whole page, each as the sum of hashed path vectors, the mean of
hashed word vectors and a few measures, and labels every block as main text or not with the
page on both sides as context. It is trained here on pages made by a grammar whose labels are
known, so that no labelled corpus is needed; the fitted numbers go to every task (0.1 MB).
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

PATH_BUCKETS, WORD_BUCKETS, WIDTH, HIDDEN = 1024, 1024, 16, 12
MEASURES = 5

#: Elements that don't end a block, have no content, or hold no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no markup, up to their end tag or the page's end.
RAW_TEXT = frozenset("script style".split())
#: Elements that the opening of one of the others ends.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}

_MARKUP = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/><]*+)(?P<rest>(?>"[^"]*"|'[^']*'|[^'"<>]++)*+|[^<>]*+)>|[!?][^>]*+(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_WORDS = re.compile(r"[a-z]+")


def _label(tag: str, rest: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role, from all of its attributes."""
    named = " ".join(a or b or c for name, a, b, c in _ATTRIBUTE.findall(rest) if name.lower() in ("class", "id", "role")) if "=" in rest else ""
    return _label_words(tag, named)


@lru_cache(maxsize=1 << 14)
def _label_words(tag: str, named: str) -> tuple[str, ...]:
    return (tag, *(f".{w}" for w in dict.fromkeys(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()))))


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int  # characters inside links
    inline: int  # inline elements opened


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; character references decoded, white space made single spaces."""
    out: list[Block] = []
    stack: list[str] = []
    labels: list[tuple[str, ...]] = []
    parts: list[str] = []
    in_link, linked, inline, at, n = 0, 0, 0, 0, len(page)

    def close():
        nonlocal linked, inline
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append(Block(tuple(labels), text, min(linked, len(text)), inline))
            parts.clear()
        linked = inline = 0

    while at < n:
        m = _MARKUP.search(page, at)
        if (to := m.start() if m else n) > at:
            parts.append(page[at:to])
            linked += (to - at) * (in_link > 0)
        if not m:
            break
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in RAW_TEXT:
            if not m["end"] and not m["rest"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if m["end"] else 1
            inline += not m["end"]
            continue
        close()
        if m["end"]:
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                del stack[k:], labels[k:]
                in_link = 0
        else:
            while stack and tag in ENDED_BY.get(stack[-1], ()):
                stack.pop(), labels.pop()
            if tag not in VOID and not m["rest"].endswith("/"):
                stack.append(tag), labels.append(_label(tag, m["rest"]))
    close()
    return out


@lru_cache(maxsize=1 << 16)
def _path_buckets(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    return tuple(dict.fromkeys(zlib.crc32(x.encode()) % PATH_BUCKETS for part in path for x in part))


@dataclass
class Labeller:
    """``path``, ``word`` (buckets, WIDTH) vectors; ``wx`` (2, WIDTH + MEASURES + 1, 4H) and ``wh``
    (2, H, 4H) of the two directions; ``out`` (2H + 1,)."""

    path: np.ndarray
    word: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    out: np.ndarray


@dataclass
class Features:
    paths: np.ndarray  # bucket of each (block, path word)
    path_block: np.ndarray
    words: np.ndarray
    word_block: np.ndarray
    measures: np.ndarray  # (blocks, MEASURES)


def features(blocks: list[Block]) -> Features:
    paths = [_path_buckets(b.path) for b in blocks]
    low, off = C.text_bytes(pa.array([b.text for b in blocks], pa.string()))
    low = C.LOWER[low]
    starts, ends, first = C.word_spans(low != 32, off)
    counts = np.diff(first)
    size = np.array([len(b.text) for b in blocks], np.float32)
    measures = np.stack([np.log1p(size) / 4, np.log1p(counts) / 3, np.array([b.linked for b in blocks]) / np.maximum(size, 1), np.log1p([b.inline for b in blocks]), [len(b.path) / 8 for b in blocks]], 1)
    return Features(
        np.array([x for p in paths for x in p], np.int64), np.repeat(np.arange(len(blocks)), [len(p) for p in paths]),
        (C.span_hashes(low, starts, ends) >> np.uint64(20)).astype(np.int64) % WORD_BUCKETS, np.repeat(np.arange(len(blocks)), counts), measures.astype(np.float32),
    )


def _pooled(table: np.ndarray, buckets: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, table.shape[1]), np.float32)
    for a in range(0, len(buckets), 1 << 18):
        b, k = block[a : a + (1 << 18)], buckets[a : a + (1 << 18)]
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        out[b[edge]] += np.add.reduceat(table[k], edge, axis=0)
    return out


def _inputs(net: Labeller, f: Features) -> tuple[np.ndarray, np.ndarray]:
    n = len(f.measures)
    count = np.maximum(np.bincount(f.word_block, minlength=n), 1).astype(np.float32)
    x = _pooled(net.path, f.paths, f.path_block, n) + _pooled(net.word, f.words, f.word_block, n) / count[:, None]
    return np.concatenate([np.tanh(x), f.measures, np.ones((n, 1), np.float32)], 1), count


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(wx, wh, x, order, sizes, keep=None):
    """One direction: step t of every sequence is row ``order[t]`` of x; sequences sorted by length,
    longest first, so that step t runs the ``sizes[t]`` first ones. States of all rows."""
    hidden = wh.shape[0]
    out = np.zeros((len(x), hidden), np.float32)
    h = c = np.zeros((sizes[0] if len(sizes) else 0, hidden), np.float32)
    projected = x @ wx
    for t, k in enumerate(sizes):
        h, c = h[:k], c[:k]
        rows = order[t]
        a = projected[rows] + h @ wh
        i, f, o = (_sigmoid(a[:, j * hidden : (j + 1) * hidden] + (j == 1)) for j in range(3))
        g = np.tanh(a[:, 3 * hidden :])
        new = f * c + i * g
        tc = np.tanh(new)
        if keep is not None:
            keep.append((rows, h, c, i, f, o, g, tc))
        h, c = o * tc, new
        out[rows] = h
    return out


def _steps(lengths: np.ndarray):
    """Row numbers for every step, forward and backward, and how many sequences each step has."""
    start = np.cumsum(lengths) - lengths
    by = np.argsort(-lengths, kind="stable")
    by = by[lengths[by] > 0]
    s, n = start[by], lengths[by]
    sizes = [int((n > t).sum()) for t in range(int(n.max()) if len(n) else 0)]
    return [s[:k] + t for t, k in enumerate(sizes)], [s[:k] + n[:k] - 1 - t for t, k in enumerate(sizes)], sizes


def _scores(net: Labeller, x: np.ndarray, lengths: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
    ahead, back, sizes = _steps(lengths)
    both = [_lstm(net.wx[d], net.wh[d], x, (ahead, back)[d], sizes, None if keep is None else keep[d]) for d in (0, 1)]
    h = np.concatenate([*both, np.ones((len(x), 1), np.float32)], 1)
    return h @ net.out, h


def label_blocks(net: Labeller, pages: list[list[Block]]) -> np.ndarray:
    """For all blocks of all pages, end to end: is it main text?"""
    blocks = [b for p in pages for b in p]
    if not blocks:
        return np.zeros(0, bool)
    x, _ = _inputs(net, features(blocks))
    return _scores(net, x, np.array([len(p) for p in pages]))[0] > 0


def _gradients(net: Labeller, f: Features, lengths: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    x, count = _inputs(net, f)
    keep: tuple[list, list] = ([], [])
    s, h = _scores(net, x, lengths, keep)
    p = _sigmoid(s)
    loss = -float(np.mean(np.log(np.where(y, p, 1 - p) + 1e-9)))
    ds = ((p - y) / len(y)).astype(np.float32)
    g_out, dh_all = h.T @ ds, ds[:, None] * net.out
    dx, g_wx, g_wh = np.zeros_like(x), np.zeros_like(net.wx), np.zeros_like(net.wh)
    hidden = net.wh.shape[1]
    for d in (0, 1):
        dproj = np.zeros((len(x), 4 * hidden), np.float32)
        dh_next = dc_next = np.zeros((0, hidden), np.float32)
        for rows, before, c_before, i, fg, o, g, tc in reversed(keep[d]):
            dh, dc = np.zeros((len(rows), hidden), np.float32), np.zeros((len(rows), hidden), np.float32)
            dh[: len(dh_next)], dc[: len(dc_next)] = dh_next, dc_next
            dh += dh_all[rows, d * hidden : (d + 1) * hidden]
            dc += dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * c_before * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dproj[rows] = da
            g_wh[d] += before.T @ da
            dh_next, dc_next = da @ net.wh[d].T, dc * fg
        g_wx[d] = x.T @ dproj
        dx += dproj @ net.wx[d].T
    de = dx[:, :WIDTH] * (1 - x[:, :WIDTH] ** 2)
    g_path, g_word = np.zeros_like(net.path), np.zeros_like(net.word)
    np.add.at(g_path, f.paths, de[f.path_block])
    np.add.at(g_word, f.words, (de / count[:, None])[f.word_block])
    return loss, [g_path, g_word, g_wx, g_wh, g_out]


class Grammar:
    """Made pages with a label for every block."""

    MAIN = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="text"']
    ADVERT = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="ad"', 'div class="sponsored"', 'div class="promo"', 'div id="ad-top"', 'section class="banner"']
    SIDE = ["aside", 'div class="sidebar"', 'div class="related"', 'div id="sidebar"', 'aside class="widget"', 'section class="related-posts"', 'div class="recommended"', 'div class="trending"']
    NOTICE = ['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="consent"', 'div class="gdpr"', 'div role="alert"', 'div class="newsletter"', 'div class="popup modal"']
    COMMENTS = ['section class="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="disqus"', 'section id="responses"', 'div class="reader-comments"']
    MENU = ["nav", 'div class="menu"', 'ul class="nav"', 'div class="breadcrumbs"', 'nav class="navbar"', 'div id="navigation"', 'div class="share social"', 'div class="toolbar"']
    HEAD = ["header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"']
    FALLBACK = ["noscript", 'template id="card"', "svg", 'iframe src="/frame"', 'object type="x"']
    FOOT = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div class="legal"']
    SAID = {
        "notice": "we use cookies to improve this site accept decline privacy policy subscribe to our newsletter sign up",
        "foot": "© copyright all rights reserved terms of use privacy contact imprint",
        "comment": "reply posted by comment great article thanks login to comment report",
        "form": "email name password submit search send your message sign in",
        "ad": "sponsored advertisement buy now offer",
    }
    SYLLABLES = "the an er in on re ti es or en at ed nd ha to ou ea sch ein ung lich ver keit tion eau aux que ch ment ez ado ar la ci ón os ra lo ga mi te ka su vo pra".split()

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, among):
        return among[int(self.rng.integers(len(among)))]

    def prose(self, most: int) -> str:
        n = 1 + int(most * self.rng.random() ** 2)
        words = ["".join(self.pick(self.SYLLABLES) for _ in range(1 + int(self.rng.integers(4)))) for _ in range(n)]
        words[0] = words[0].capitalize()
        if self.rng.random() < 0.1:
            words = [w.upper() + "!!" for w in words] if self.rng.random() < 0.5 else [w + self.pick(["***", "$$$", "&amp;&amp;&amp;", "%%%"]) for w in words]
        return " ".join(words) + self.pick([".", ".", "", "!"])

    def said(self, kind: str, most: int) -> str:
        own = self.SAID[kind].split()
        return " ".join(self.pick(own) for _ in range(1 + int(self.rng.integers(6)))) if self.rng.random() < 0.4 else self.prose(most)

    def inside(self, open_: str, inner: list) -> list:
        return [f"<{open_}>", *inner, f"</{open_.split()[0]}>"]

    def leaf(self, open_: str, text: str, main: bool) -> list:
        return self.inside(open_, [(text, main)])

    def links(self, n: int) -> list:
        return self.inside("ul", [x for _ in range(n) for x in self.inside("li", [(f'<a href="/{self.rng.integers(99)}">{self.prose(3)}</a>', False)])])

    def boiler(self) -> list:
        kind = int(self.rng.integers(15))
        if kind == 14:
            return self.leaf(self.pick(self.FALLBACK), self.said("notice", 12), False)
        kind %= 7
        r = lambda n: 1 + int(self.rng.integers(n))
        if kind == 0:
            return self.inside(self.pick(self.MENU), self.links(r(7)))
        if kind == 1:
            return self.inside(self.pick(self.ADVERT), [(self.said("ad", 40), False)] if self.rng.random() < 0.6 else self.leaf("p", self.said("ad", 40), False))
        if kind == 2:
            return self.inside(self.pick(self.SIDE), [x for _ in range(r(3)) for x in self.leaf(self.pick(["h3", "p", "div"]), self.prose(30), False)] + (self.links(r(5)) if self.rng.random() < 0.5 else []))
        if kind == 3:
            return self.inside(self.pick(self.NOTICE), [x for _ in range(r(2)) for x in self.leaf("p", self.said("notice", 30), False)])
        if kind == 4:
            return self.inside(self.pick(self.COMMENTS), [x for _ in range(r(5)) for x in self.inside(self.pick(["li", "div", 'div class="comment"', "article"]), self.leaf("p", self.said("comment", 60), False))])
        if kind == 5:
            return self.inside(self.pick(["form", 'form class="search"', 'div class="login"']), [(f"<label>{self.said('form', 4)}</label><input>", False), *self.leaf("button", self.said("form", 2), False)])
        return self.inside(self.pick(self.HEAD), self.leaf(self.pick(["h1", "p", "div"]), self.prose(8), False) + (self.links(r(4)) if self.rng.random() < 0.5 else []))

    def article(self) -> list:
        rng, out = self.rng, []
        if rng.random() < 0.8:
            out += self.leaf("h1", self.prose(12), True)
        for _ in range(1 + int(12 * rng.random() ** 2)):
            k = rng.random()
            text = self.prose(120 if rng.random() < 0.7 else 6)
            if k < 0.7:
                text = f"<b>{text}<br>" if rng.random() < 0.1 else text.replace(" ", f' <a href="/x">{self.prose(2)}</a> ', 1) if rng.random() < 0.15 else text
                out += ["<p>", (text, True), *(["</p>"] if rng.random() < 0.9 else [])]
            elif k < 0.8:
                out += self.leaf(self.pick(["h2", "h3", "blockquote", "pre", "figcaption"]), text, True)
            elif k < 0.88:
                out += self.inside("ul", [x for _ in range(1 + int(rng.integers(4))) for x in self.leaf("li", self.prose(20), True)])
            elif k < 0.92:
                out += self.inside("table", self.inside("tr", [x for _ in range(3) for x in self.leaf("td", self.prose(4), True)]))
            else:
                out += self.boiler() if rng.random() < 0.5 else self.leaf("div", text, True)
        main = self.inside(self.pick(self.MAIN), out)
        return self.inside(self.pick(["div", 'div class="wrapper"', 'div id="page"', "section"]), main) if rng.random() < 0.4 else main

    def page(self) -> tuple[list[Block], list[bool]]:
        rng = self.rng
        body = [x for _ in range(int(rng.integers(4))) for x in self.boiler()] + self.article() + [x for _ in range(int(rng.integers(4))) for x in self.boiler()]
        if rng.random() < 0.7:
            body += self.inside(self.pick(self.FOOT), [(self.said("foot", 15), False)])
        items = ["<html><head>", *self.leaf("title", self.prose(8), False), "</head><body>", *body, "</body></html>"]
        # A mark at each leaf tells which labels its block has; it goes before the block is used.
        source, labels = [], []
        for x in items:
            if isinstance(x, tuple):
                source.append(f"\x01{x[0]}")
                labels.append(x[1])
            else:
                source.append(x)
        blocks, own, at = leaf_blocks("".join(source)), [], 0
        for b in blocks:
            n = b.text.count("\x01")
            own.append(labels[at] if n else own[-1] if own else False)
            at += n
            b.text = b.text.replace("\x01", "").strip() or "."
        return blocks, own


def train_labeller(pages: int = 2000, rounds: int = 500, batch: int = 48, seed: int = 5, rate: float = 0.02) -> Labeller:
    grammar, rng = Grammar(seed), np.random.default_rng(seed + 1)
    made = [grammar.page() for _ in range(pages)]
    wide = WIDTH + MEASURES + 1
    r = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
    net = Labeller(r(PATH_BUCKETS, WIDTH), r(WORD_BUCKETS, WIDTH) * np.float32(0.2), r(2, wide, 4 * HIDDEN), r(2, HIDDEN, 4 * HIDDEN), r(2 * HIDDEN + 1))
    params = [net.path, net.word, net.wx, net.wh, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        some = [made[k] for k in rng.integers(0, len(made), batch)]
        f = features([b for blocks, _ in some for b in blocks])
        drop = rng.random(len(f.paths)) < 0.9  # a page should be read with some of its names missing
        f.paths, f.path_block = f.paths[drop], f.path_block[drop]
        _, grads = _gradients(net, f, np.array([len(b) for b, _ in some]), np.array([x for _, y in some for x in y]))
        for k, (p, g, m, v) in enumerate(zip(params, grads, first, second, strict=True)):
            if k == 1:
                g = g + 1e-4 * p  # words weigh little unless they say much
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (1 - 0.9 * step / rounds) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


@cache
def default_labeller() -> Labeller:
    """The labeller of the production parameters, trained once in a process."""
    return train_labeller()


def extract(pages: DataFrame, net: Labeller, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` (replaced if it is there) for ``html_col``'s main text.

    Null, empty or textless html gives an empty text; html is read whole, however long; every row
    is read alone and every other column stays; an empty table gives an empty one."""
    held = pages.sparkSession.sparkContext.broadcast(net)

    def run(source: pa.Array) -> list[pa.Array]:
        read = [leaf_blocks(x) if x else [] for x in source.to_pylist()]
        main = label_blocks(held.value, read)
        texts, at = [], 0
        for blocks in read:
            texts.append("\n\n".join(b.text for b, ok in zip(blocks, main[at : at + len(blocks)], strict=True) if ok))
            at += len(blocks)
        return [pa.array(texts, pa.string())]

    return C.map_docs(pages, html_col, run, f"`{text_col}` string", most=1 << 20)
