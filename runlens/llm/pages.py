"""Main text of web pages: a recurrent labeller reads a page's blocks in order, in both directions, and keeps or drops each.

A block is a run of text between block-level tags. It is described by a hashed vector of the tags, classes, ids and roles
above it, a hashed vector of its words, and a few measures. A bidirectional LSTM in numpy goes over all blocks of the page,
so each decision knows the whole document. It is trained here on a bounded sample of the table's own pages, labelled by the
meaning of their containers, and on the same texts set anew in varied layouts.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile("<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile("(class|id|role|data-y)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))", re.I)

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg math title iframe object canvas audio video head select option datalist".split())
RAW = set("script style noscript template svg math title iframe object canvas audio video textarea select".split())
IN_HEAD = set("html head title base link meta style script noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr br img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = set("ul ol dl table tr body html article section div main aside nav header footer form blockquote td th tbody thead".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Words in names of containers that hold no main text, and that hold it.
ASIDE = set("nav menu navbar navigation breadcrumb breadcrumbs header masthead footer foot sidebar aside widget ad ads advert advertisement adsbygoogle banner "
            "sponsor sponsored promo promotion notice notices alert cookie consent gdpr newsletter subscribe signup login search form share social comment "
            "comments commentlist respond disqus reply replies related recommended tags meta pagination pager popup modal toolbar copyright contentinfo "
            "complementary dialog".split())
MAIN = set("article main content post entry story body text".split())
NAME_PART = re.compile("[^a-z0-9]+")


def _names(tag: str, attributes: str, labelled: bool) -> list[str]:
    names = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "data-y":
            names += [f"={value}"] if labelled else []  # a layout's label; no tag or class name starts with this sign
        else:
            names += [f".{p}" for v in value.split() for p in {v, *NAME_PART.split(v)} if p]
    return names


def blocks(html: str, labelled: bool = False) -> list[tuple[str, list[str], float]]:
    """(text, names above it from the outside in, share of its characters in links) of every block with text, in page order."""
    stack: list[tuple[str, list[str]]] = []
    out, held, linked, path, at, size = [], [], 0, None, 0, len(html)

    def flush() -> None:
        nonlocal held, linked, path
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, path, min(1.0, linked / max(1, sum(map(len, held))))))
        held, linked, path = [], 0, None

    def close(names: set, stop: set) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while at < size:
        m = TOKEN.match(html, at)
        if not m:  # an open tag without end: the rest is text
            at += 1
            continue
        at, piece = m.end(), m[0]
        if m[2] is None:
            if piece[:2] in ("<!", "<?") and len(piece) > 1:
                continue
            if stack and stack[-1][0] == "head" and not piece.isspace():
                stack.pop()
            if path is None and not piece.isspace():
                path = [n for _, names in stack for n in names]
            held.append(piece)
            if any(t == "a" for t, _ in stack):
                linked += len(piece)
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if m[1]:
            if any(t == tag for t, _ in stack):
                close({tag}, set())
            continue
        if tag not in IN_HEAD:  # </head> may be left out
            close({"head"}, set())
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_P:
            close({"p"}, HOLDS)
        if tag in CLOSES:
            close(CLOSES[tag], HOLDS - CLOSES[tag])
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, _names(tag, m[3], labelled)))
    flush()
    return [b for b in out if not UNSEEN.intersection(b[1])]


def container_label(path: list[str]) -> int:
    """1 for main text, 0 for the rest, by the meaning of the containers' names; -1 where they say nothing."""
    said = [n for n in path if n.startswith("=")]
    if said:
        return int(said[-1][1:])
    words = [n.lstrip(".") for n in path]
    if any(w in ASIDE for w in words):
        return 0
    return 1 if any(w in MAIN for n, w in zip(path, words) if n != "body") else -1


PATH_DIMS, WORD_DIMS, MEASURES = 96, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES


def _hashed(items: list[str], dims: int, known: dict) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    for w in items:
        at = known.get(w)
        if at is None:
            at = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            if len(known) < 100_000:
                known[w] = at
        v[at % dims] += 1 if at >> 16 & 1 else -1
        v[(at >> 8) % dims] += 1 if at >> 17 & 1 else -1
    return v


def vectors(page: list[tuple[str, list[str], float]], known: dict) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(page), DIMS), np.float32)
    last = max(1, len(page) - 1)
    for i, (text, path, links) in enumerate(page):
        names = [n for n in path if not n.startswith("=")]
        words = text.lower().split()
        out[i, :PATH_DIMS] = _hashed(names, PATH_DIMS, known)
        out[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = _hashed(words, WORD_DIMS, known) / (2 * math.sqrt(len(words) + 1))
        stops = sum(text.count(c) for c in ".,;!?")
        out[i, -MEASURES:] = (math.log1p(len(words)) / 4, links, min(1.0, 10 * stops / (len(text) + 1)), i / last, (last - i) / last,
                              len(names) / 10, float(names[-1][:1] == "h" if names else 0), 1.0)
    return out


class Lstm:
    """One direction; padded steps leave the state as it is. Arrays are (steps, pages, values)."""

    def __init__(self, dims: int, hidden: int, draw: np.random.Generator):
        self.h = hidden
        self.p = {"x": draw.normal(0, 1 / math.sqrt(dims), (dims, 4 * hidden)).astype(np.float32),
                  "h": draw.normal(0, 1 / math.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32), "b": np.zeros(4 * hidden, np.float32)}
        self.p["b"][hidden:2 * hidden] = 1  # remember at first

    def forward(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        steps, pages, _ = x.shape
        n, h, c = self.h, np.zeros((pages, self.h), np.float32), np.zeros((pages, self.h), np.float32)
        z0, out, memo = x @ self.p["x"] + self.p["b"], np.zeros((steps, pages, n), np.float32), []
        for t in range(steps):
            z = z0[t] + h @ self.p["h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, :3 * n], -15, 15)))
            g = np.tanh(z[:, 3 * n:])
            new_c = s[:, n:2 * n] * c + s[:, :n] * g
            th = np.tanh(new_c)
            new_h = s[:, 2 * n:] * th
            if keep:
                memo.append((h, c, s, g, th))
            m = on[t][:, None]
            h, c = np.where(m, new_h, h), np.where(m, new_c, c)
            out[t] = h
        return out, memo

    def backward(self, x: np.ndarray, on: np.ndarray, memo: list, grad: np.ndarray) -> dict:
        n = self.h
        dh, dc = np.zeros_like(memo[0][0]), np.zeros_like(memo[0][1])
        dz_all = np.zeros((len(memo), x.shape[1], 4 * n), np.float32)
        dwh = np.zeros_like(self.p["h"])
        for t in range(len(memo) - 1, -1, -1):
            h, c, s, g, th = memo[t]
            m = on[t][:, None]
            dh = dh + grad[t]
            now_h, now_c = np.where(m, dh, 0), np.where(m, dc, 0)
            i, f, o = s[:, :n], s[:, n:2 * n], s[:, 2 * n:]
            now_c = now_c + now_h * o * (1 - th * th)
            dz = np.concatenate([now_c * g * i * (1 - i), now_c * c * f * (1 - f), now_h * th * o * (1 - o), now_c * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh, dc = np.where(m, dz @ self.p["h"].T, dh), np.where(m, now_c * f, dc)
        flat = dz_all.reshape(-1, 4 * n)
        return {"x": x.reshape(-1, x.shape[2]).T @ flat, "h": dwh, "b": flat.sum(0)}


class Labeller:
    """Two directions and a logistic output."""

    def __init__(self, hidden: int = 16, seed: int = 10):
        draw = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(DIMS, hidden, draw), Lstm(DIMS, hidden, draw)
        self.out = {"w": draw.normal(0, 0.2, 2 * hidden).astype(np.float32), "b": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        a, ma = self.ahead.forward(x, on, keep)
        b, mb = self.back.forward(x[::-1], on[::-1], keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return both, ma, mb, 1 / (1 + np.exp(-np.clip(both @ self.out["w"] + self.out["b"], -30, 30)))

    def __call__(self, pages: list[np.ndarray], cells: int = 16384) -> list[np.ndarray]:
        """P(main text) of every block of every page; pages of like length run together."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        found: list = [np.zeros(0)] * len(pages)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
                end += 1
            these = [i for i in order[at:end] if len(pages[i])]
            if these:
                x, on = stack([pages[i] for i in these])
                p = self._run(x, on)[3]
                for j, i in enumerate(these):
                    found[i] = p[:len(pages[i]), j]
            at = end
        return found

    def step(self, x: np.ndarray, on: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(parameter, gradient) of the mean logistic loss."""
        both, ma, mb, p = self._run(x, on, True)
        d = ((p - y) * weight / max(1.0, weight.sum())).astype(np.float32)
        g = d[..., None] * self.out["w"]
        n = self.ahead.h
        ga, gb = self.ahead.backward(x, on, ma, g[..., :n]), self.back.backward(x[::-1], on[::-1], mb, g[::-1, :, n:])
        pairs = [(self.out["w"], (both * d[..., None]).sum((0, 1))), (self.out["b"], np.array([d.sum()], np.float32))]
        return pairs + [(net.p[k], gr[k]) for net, gr in ((self.ahead, ga), (self.back, gb)) for k in gr]


def stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, on = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[:len(p), j], on[:len(p), j] = p, True
    return x, on


#: Layouts that the sampled texts are set in for training: openings of containers, with the closing tag after.
MAIN_IN = ['<article>', '<main>', '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<div class="entry-content">',
           '<section class="article-body">', '<div role="main">', '<main><article class="post">', '<div class="story"><div class="text">', '<div class="page">', '<td>', '<div>']
ASIDE_IN = {"top": ['<header>', '<div class="header">', '<div id="masthead">', '<nav>', '<nav class="menu">', '<div class="navbar">', '<ul class="menu">', '<div id="nav">',
                    '<div class="breadcrumbs">', '<div class="ad">', '<div class="advert">', '<div class="cookie-notice">', '<div class="alert">', '<div class="banner">', '<form class="search">'],
            "amid": ['<div class="ad">', '<div class="advertisement">', '<aside>', '<div class="share">', '<div class="newsletter">', '<div class="sponsored">', '<div class="promo">', '<form>',
                     '<ins class="adsbygoogle">', '<div class="notice">', '<div class="related">', '<nav>'],
            "end": ['<footer>', '<div class="footer">', '<div id="footer">', '<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<section class="comments">',
                    '<div id="comments"><div class="comment">', '<ol class="commentlist">', '<div class="comments-area">', '<div class="related">', '<div class="widget">', '<form class="signup">',
                    '<div class="social">', '<div class="copyright">', '<div id="respond">', '<div class="ad">', '<div class="user-comments">', '<article class="comment">']}


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall("<([a-z]+)", opening)))


def layouts(main: list[str], rest: list[str], draw: np.random.Generator) -> str:
    """A page of the given texts in a random layout; data-y holds each block's label."""
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    esc = entities.escape

    def aside(kind: str) -> str:
        opening, many = pick(ASIDE_IN[kind]), int(draw.integers(1, 6))
        part = pick(["li", "p", "a", "div", "span", "h2", "h3"])
        words = [" ".join(pick(rest + main).split()[:int(draw.integers(1, 40))]) for _ in range(many)]
        cell = {"li": '<li data-y="0"><a href="#">{}</a></li>', "a": '<div data-y="0"><a href="#">{}</a></div>'}.get(part, f'<{part} data-y="0">{{}}</{part}>')
        return opening + "".join(cell.replace("{}", esc(w)) for w in words) + _closing(opening)

    inside = [f'<h1 data-y="1">{esc(" ".join(main[0].split()[:10]))}</h1>'] if draw.random() < 0.7 else []
    part = pick(["p", "p", "p", "div", "li", "blockquote"])
    for t in main:
        inside.append(f'<{part} data-y="1">{esc(t)}</{part}>' if draw.random() < 0.85 else f'<{pick(["h2", "h3", "blockquote", "pre", "li"])} data-y="1">{esc(t)}</x>')
        if draw.random() < 0.12:
            inside.append(aside("amid"))
    opening = pick(MAIN_IN)
    body = [aside("top") for _ in range(int(draw.integers(0, 4)))] + [opening, *inside, _closing(opening)] + [aside("end") for _ in range(int(draw.integers(0, 4)))]
    return "<html><body>" + "".join(body) + "</body></html>"


def train(htmls: list[str], steps: int = 220, batch: int = 48, seed: int = 10, most_blocks: int = 80) -> Labeller:
    """The labeller, from sampled pages as they are and each in two new layouts. Of a longer page a window of most_blocks counts."""
    draw = np.random.default_rng(seed)
    known: dict = {}
    made = [blocks(h) for h in htmls]
    texts = [([t for t, p, _ in page if container_label(p) == 1], [t for t, p, _ in page if container_label(p) == 0]) for page in made]
    spare = [t for _, r in texts for t in r] or ["menu"]
    for main, rest in texts:
        if main:
            made += [blocks(layouts(main[:12], rest or spare[:20], draw), labelled=True) for _ in range(2)]
    pages = []
    for page in made:
        if page:
            at = int(draw.integers(0, max(1, len(page) - most_blocks + 1)))
            y = np.array([container_label(p) for _, p, _ in page], np.float32)
            pages.append((vectors(page, known)[at:at + most_blocks], y[at:at + most_blocks]))
    net = Labeller(seed=seed)
    if not pages:
        return net
    m1, m2 = {}, {}
    for k in range(1, steps + 1):
        chosen = [pages[i] for i in draw.integers(0, len(pages), batch)]
        x, on = stack([c[0] for c in chosen])
        y = np.zeros(on.shape, np.float32)
        for j, (_, labels) in enumerate(chosen):
            y[:len(labels), j] = labels
        for i, (p, g) in enumerate(net.step(x, on, np.maximum(y, 0), (on & (y >= 0)).astype(np.float32))):
            g = g / max(1.0, float(np.abs(g).max()) / 0.5)
            m1[i] = 0.9 * m1.get(i, 0) + 0.1 * g
            m2[i] = 0.99 * m2.get(i, 0) + 0.01 * g * g
            p -= 0.01 * (m1[i] / (1 - 0.9 ** k)) / (np.sqrt(m2[i] / (1 - 0.99 ** k)) + 1e-7)
    return net


def fit(pages: DataFrame, sample: int = 500) -> Labeller:
    """The labeller from about sample pages at most, those with the smallest hash of their html, equal pages once."""
    rows = pages.select(F.col("html").cast("string").alias("html"), F.lit(1).alias("one")).filter(F.col("html").isNotNull())
    known = common.sample_by_label(rows, "html", "one", sample).groupBy(F.xxhash64("html").alias("h")).agg(F.first("html").alias("html")).orderBy("h")
    return train([r["html"] for r in known.collect()])


def extract(pages: DataFrame, net: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the kept blocks in page order, a line each.

    Null and empty html, and pages without main text, give the empty string; repeated rows are done each; extra columns are
    left behind; an empty table gives no rows.
    """
    net = net or fit(pages)

    def run(batches):
        known: dict = {}
        for b in batches:
            htmls = b["html"].fillna("").tolist()
            texts: list[str] = []
            for lo, hi in common.groups(htmls, 256):
                found = [blocks(h) for h in htmls[lo:hi]]
                chances = net([vectors(p, known) for p in found])
                texts += ["\n".join(t for (t, _, _), c in zip(p, chance) if c >= threshold) for p, chance in zip(found, chances)]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
