"""Languages word by word: a linear-chain conditional random field labels every word of a text, so code-switched text gets a
language per word, and a document the language that most of its words are in.

A word's features are hashed: its beginnings and ends of up to four letters, its letter n-grams of one to three, the word
itself, and which languages' lexicons hold it. Transitions are learned too. Forward-backward gives each word's probabilities;
chains are a line's words, a long line being cut into chains of equal length. Many chains are run at once in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONGEST = 48
WORDS = re.compile(f"[^\\W\\d_]{{1,{LONGEST}}}")
LETTERS = regex.compile(r"\p{L}+")
CHAIN = 96
SPACE = 1 << 16


def words_in(line: str) -> list[str]:
    """The runs of letters of a line; one over LONGEST letters is several consecutive words. Number signs such as a half or a
    superscript two are no letters."""
    found = WORDS.findall(line)
    return found if all(map(str.isalpha, found)) else [x for w in found for x in LETTERS.findall(w)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature ids, 1 where used) of each word."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    width = int(size.max(initial=1))
    letters = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
    x = np.zeros((len(words), width + 2), np.int64)  # 1 marks both edges
    x[:, 0], x[:, 1:-1] = 1, letters
    x[np.arange(len(words)), size + 1] = 1
    ids, used = [], []

    def add(h: np.ndarray, kind: int, on: np.ndarray) -> None:
        h = (h + kind * 7919) * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF
        ids.append((h >> 32) % SPACE)
        used.append(on)

    at = np.arange(width + 2)
    pos = x.copy()
    for n in (1, 2, 3):
        if n > 1:
            pos = pos[:, :-1] * 1_000_003 + x[:, n - 1:]
        start = at[:pos.shape[1]]
        add(pos, n, (start[None, :] + n <= size[:, None] + 2))
    row = np.arange(len(words))
    head, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for k in range(1, 5):
        head = head * 1_000_003 + np.where(k <= size, x[:, min(k, width + 1)], 0)
        tail = tail * 1_000_003 + np.where(k <= size, x[row, np.maximum(size + 1 - k, 0)], 0)
        add(head[:, None], 10 + k, (k <= size)[:, None])
        add(tail[:, None], 20 + k, (k <= size)[:, None])
    whole = np.zeros(len(words), np.int64)
    for k in range(width):
        whole = np.where(k < size, whole * 1_000_003 + letters[:, k], whole)
    add(whole[:, None], 30, np.ones((len(words), 1), bool))
    return np.concatenate(ids, axis=1), np.concatenate(used, axis=1)


def marginals(scores: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of chains of one padded width: (P(label) per word, expected transitions, expected first labels)."""
    b, t, k = scores.shape
    e, a = np.exp(scores - scores.max(-1, keepdims=True)), np.exp(trans)
    on = np.arange(t)[None, :] < length[:, None]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(-1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] /= alpha[:, i].sum(-1, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = e[:, i + 1] * beta[:, i + 1]
        back = ahead @ a.T
        beta[:, i] = np.where(on[:, i + 1, None], back / back.sum(-1, keepdims=True), 1.0)
        both = alpha[:, i, :, None] * a[None] * ahead[:, None, :]
        pair += (both / both.sum((1, 2), keepdims=True) * on[:, i + 1, None, None]).sum(0)
    p = alpha * beta
    p /= p.sum(-1, keepdims=True)
    return p * on[..., None], pair, p[:, 0].sum(0)


class Model:
    """Languages, feature weights, lexicon weights, transitions, first labels."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.w, self.lex = np.zeros((SPACE, k), np.float32), np.zeros((k, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def held(self, words: list[str]) -> np.ndarray:
        """Which languages' lexicons hold each word."""
        bits = np.array([self.lexicon.get(w, 0) for w in words], dtype=np.int64)
        return (bits[:, None] >> np.arange(len(self.langs)) & 1).astype(np.float32)

    def scores(self, words: list[str], block: int = 8192) -> np.ndarray:
        out = []
        for i in range(0, len(words), block):
            ids, used = word_features(words[i:i + block])
            s = np.zeros((len(ids), len(self.langs)), np.float32)
            for j in range(ids.shape[1]):
                s += self.w[ids[:, j]] * used[:, j, None]
            out.append(s + self.held(words[i:i + block]) @ self.lex)
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def pad(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), int(length.max())), np.int64)
    on = np.arange(out.shape[1])[None, :] < length[:, None]
    out[on] = np.concatenate(chains)
    return out, length


def train(texts: list[str], langs: list[str], rounds: int = 60, seed: int = 9, words_each: int = 240) -> Model:
    """The field, from a window of each text's words. Chains are pieces of 4 to 40 words, the next piece of another text, so
    that changes of language are seen; full-batch steps of Adam on the likelihood with a weak pull to zero."""
    draw = np.random.default_rng(seed)
    names = sorted(set(langs))
    index: dict[str, int] = {}
    pieces, counts = [], {}
    for t, lang in zip(texts, langs):
        words, y = words_in(t.lower()), names.index(lang)
        at = int(draw.integers(0, max(1, len(words) - words_each + 1)))
        for w in words:
            counts.setdefault(w, [0] * len(names))[y] += 1
        words = words[at:at + words_each]
        i = 0
        while i < len(words):
            n = int(draw.integers(4, 41))
            pieces.append((np.array([index.setdefault(w, len(index)) for w in words[i:i + n]]), y))
            i += n
    lexicon = {w: sum(1 << k for k, n in enumerate(c) if n >= 3 and n >= 0.2 * sum(c)) for w, c in counts.items() if max(c) >= 3}
    model = Model(names, lexicon)
    if not pieces:
        return model
    order = draw.permutation(len(pieces))
    chains = [np.concatenate([pieces[i][0] for i in order[j:j + 3]]) for j in range(0, len(order), 3)]
    truths = [np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order[j:j + 3]]) for j in range(0, len(order), 3)]
    words = list(index)
    ids, used = word_features(words)
    flat_row, flat_id = np.nonzero(used)[0], ids[used]
    held, k = model.held(words), len(names)
    x, length = pad(chains)
    y, _ = pad(truths)
    on = np.arange(x.shape[1])[None, :] < length[:, None]
    want = np.zeros((len(words), k))
    np.add.at(want, (x[on], y[on]), 1)
    want_pair, want_start = np.zeros((k, k)), np.bincount(y[:, 0], minlength=k).astype(float)
    follows = on[:, 1:]
    np.add.at(want_pair, (y[:, :-1][follows], y[:, 1:][follows]), 1)
    params = [model.w, model.lex, model.trans, model.start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = on.sum()
    for step in range(1, rounds + 1):
        s = np.stack([np.bincount(flat_row, weights=model.w[flat_id, c], minlength=len(words)) for c in range(k)], axis=1) + held @ model.lex
        got, got_pair, got_start = np.zeros((len(words), k)), np.zeros((k, k)), np.zeros(k)
        for a in range(0, len(x), 2048):
            p, pair, first = marginals(s[x[a:a + 2048]], length[a:a + 2048], model.trans, model.start)
            o = on[a:a + 2048]
            for c in range(k):
                got[:, c] += np.bincount(x[a:a + 2048][o], weights=p[..., c][o], minlength=len(words))
            got_pair, got_start = got_pair + pair, got_start + first
        lack = (want - got) / total
        grads = [np.stack([np.bincount(flat_id, weights=lack[flat_row, c], minlength=SPACE) for c in range(k)], axis=1),
                 held.T @ lack, (want_pair - got_pair) / total, (want_start - got_start) / total]
        for i, (p, g) in enumerate(zip(params, grads)):
            g = g - 1e-6 * p
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            p += 0.1 * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.99 ** step)) + 1e-8)
    return model


def label_words(model: Model, texts: list) -> list[tuple[list[str], np.ndarray]]:
    """(words, P(language) of each) of every text."""
    index: dict[str, int] = {}
    chains, owner, words_of = [], [], []
    for n, t in enumerate(texts):
        mine = []
        for line in (t or "").lower().split("\n"):
            words = words_in(line)
            if words:
                at = np.array([index.setdefault(w, len(index)) for w in words])
                parts = np.array_split(at, -(-len(at) // CHAIN))
                chains += parts
                owner += [n] * len(parts)
                mine += words
        words_of.append(mine)
    k = len(model.langs)
    if not chains:
        return [([], np.zeros((0, k)))] * len(texts)
    s = model.scores(list(index))
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    found: list = [None] * len(chains)
    for a in range(0, len(order), 1024):
        these = order[a:a + 1024]
        x, length = pad([chains[i] for i in these])
        p, _, _ = marginals(s[x].astype(np.float64), length, model.trans, model.start)
        for i, row, n in zip(these, p, length.tolist()):
            found[i] = row[:n]
    out: list = [[] for _ in texts]
    for n, p in zip(owner, found):
        out[n].append(p)
    return [(w, np.concatenate(p) if p else np.zeros((0, k))) for w, p in zip(words_of, out)]


def fit(docs: DataFrame, per_lang: int = 250) -> Model:
    """The model from about per_lang texts of each language at most, of all rows outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    sample = common.sample_by_label(rows, "text", "lang", per_lang).groupBy(F.xxhash64("text").alias("h"), "lang").agg(F.first("text").alias("text"))
    known = sample.orderBy("lang", "h").toPandas()
    return train(known["text"].tolist(), known["lang"].tolist())


def held_out(doc_id: Column) -> Column:
    return common.fold(doc_id, 5) == 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, switches): the language with the largest share of word probability, that share, and how
    often the likeliest language changes from word to word. A text without letters is `und`, score 0."""
    def run(batches):
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"].tolist()
            sizes = [t or "" for t in texts]
            for lo, hi in common.groups(sizes):
                rows = []
                for doc, (_, p) in zip(ids[lo:hi], label_words(model, texts[lo:hi])):
                    if len(p) and model.langs:
                        share, best = p.mean(0), p.argmax(1)
                        rows.append((doc, model.langs[int(share.argmax())], float(min(1.0, share.max())), int((best[1:] != best[:-1]).sum())))
                    else:
                        rows.append((doc, "und", 0.0, 0))
                yield pd.DataFrame(rows, columns=["doc_id", "lang_pred", "score", "switches"]).astype({"doc_id": "Int64"})
    return common.texts(docs).mapInPandas(run, "doc_id long, lang_pred string, score double, switches long")


def identify(docs: DataFrame, per_lang: int = 250) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Repeated rows are labelled each, extra columns left behind;
    without a text of known language all are `und`; an empty table gives no rows."""
    return predict(docs, fit(docs, per_lang)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "switches")
