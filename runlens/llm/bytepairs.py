"""Byte-level BPE by a public vocabulary: encoding and decoding of whole texts.

A text is cut into chunks (white space and what follows it) that the vocabulary's pattern never crosses. Chunks and the
pre-tokens in them are encoded once and remembered, up to a bound. A pre-token's bytes are merged through a segment tree over
its pairs of neighbours. A leaf holds its pair's rank and place, a node the least of its two halves, so the root is the
leftmost pair of the lowest rank; a merge changes three leaves and the nodes above them, until no pair has a rank. The new
pre-tokens of a batch go together: row k of one array holds node k of the trees of all words.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token never goes on from other characters into white space.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
NONE = 1 << 62


def letters_of_bytes() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file of kind byte-level BPE."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        model, letters = said["model"], letters_of_bytes()
        if model.get("type", "BPE") != "BPE" or (said.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")
        ids, byte_of = model["vocab"], {c: b for b, c in enumerate(letters)}
        self.single = [ids[c] for c in letters]
        self.ranks: dict[int, int] = {}  # pair of ids a << 32 | b -> rank << 32
        self.made: list[int] = []  # merged id of each rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank << 32)
            self.made.append(ids[a + b])
        self.pairs = np.array(sorted(self.ranks) + [NONE], np.int64)
        self.rank_of = np.array([self.ranks[p] for p in sorted(self.ranks)] + [NONE], np.int64)
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.pieces.update({i: t.encode() for t, i in self.special.items()})
        names = sorted(self.special, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 of the pairs, NONE of those without."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.rank_of[at], NONE)


def merged(symbols: list[int], v: Vocabulary) -> list[int]:
    """The ids that are left when the leftmost of the lowest-ranked pairs is merged again and again. A leaf of the tree is
    rank << 32 | place, or NONE | place."""
    n, rank, made = len(symbols), v.ranks.get, v.made
    if n < 2:
        return symbols
    leaves = 1 << (n - 2).bit_length()
    tree = [NONE] * leaves + [rank(a << 32 | b, NONE) | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    tree += [NONE] * (2 * leaves - len(tree))
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < NONE:
        i = tree[1] & 0xFFFFFFFF
        own = symbols[i] = made[tree[1] >> 32]
        gone, first = after[i], before[i]
        symbols[gone] = -1
        after[i] = last = after[gone]
        changed = [(i, NONE)]
        if last < n:
            before[last] = i
            changed = [(gone, NONE), (i, rank(own << 32 | symbols[last], NONE) | i)]
        if first >= 0:
            changed.append((first, rank(symbols[first] << 32 | own, NONE) | first))
        for at, value in changed:
            k = leaves + at
            tree[k] = value
            while k > 1:
                value = min(value, tree[k ^ 1])
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [s for s in symbols if s >= 0]


def merged_together(words: list[bytes], leaves: int, v: Vocabulary) -> list[bytes]:
    """merged() of many words of 2 to leaves + 1 bytes, one merge of every word at a time; ids as little-endian bytes."""
    n = np.array([len(w) for w in words])
    wide, count = leaves + 2, len(words)  # a place before the first symbol and one after the last take what has no neighbour
    flat = np.frombuffer(b"".join(words), np.uint8)
    column = np.repeat(np.arange(count), n)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    symbols = np.full((wide, count), -1, np.int64)
    symbols[row, column] = np.array(v.single, np.int64)[flat]
    tree = np.full((2 * leaves, count), NONE, np.int64)
    for i in range(leaves):
        there = symbols[i + 1] >= 0
        tree[leaves + i] = np.where(there, v.ranked(symbols[i], np.maximum(symbols[i + 1], 0)) | i, NONE)
    for k in range(leaves - 1, 0, -1):
        np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    after = np.repeat(np.arange(1, wide + 1)[:, None], count, 1)
    before = np.repeat(np.arange(-1, wide - 1)[:, None], count, 1)
    made, depth = np.array(v.made, np.int64), leaves.bit_length() - 1
    t, s, af, be = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    active = np.flatnonzero(tree[1] < NONE)
    while len(active):
        top = t[count + active]
        i, own = top & 0xFFFFFFFF, made[top >> 32]
        gone, first = af[i * count + active], be[i * count + active]
        last = af[gone * count + active]
        s[i * count + active] = own
        s[gone * count + active] = -1
        af[i * count + active] = last
        end = last >= n[active]
        be[last * count + active] = i
        value = np.where(end, NONE, v.ranked(own, np.where(end, 0, s[last * count + active]))) | i
        start = first < 0
        t[np.minimum(leaves + gone, 2 * leaves - 1) * count + active] = NONE
        t[(leaves + i) * count + active] = value
        inner = np.flatnonzero(~start)
        f = first[inner]
        t[(leaves + f) * count + active[inner]] = v.ranked(s[f * count + active[inner]], own[inner]) | f
        # where the word ends, gone is a place without a pair, and where it starts, first is as good as i: both change nothing
        spots = [leaves + np.minimum(gone, leaves - 1), leaves + i, leaves + np.where(start, i, first)]
        for _ in range(depth):
            spots = [k >> 1 for k in spots]
            for k in spots:
                at = 2 * k * count + active
                t[k * count + active] = np.minimum(t[at], t[at + count])
        active = active[t[count + active] < NONE]
    symbols = symbols.T
    left = symbols[symbols >= 0].astype("<u4").tobytes()
    ends = (4 * np.cumsum((symbols >= 0).sum(1))).tolist()
    return [left[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Ids of texts as little-endian unsigned 32-bit bytes, and back. remember bounds the chunks and the pre-tokens that are kept
    from one call to the next, longest the characters of each; longer ones are encoded anew each time."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 300_000, longest: int = 200):
        self.v, self.cut = vocabulary, regex.compile(PATTERN).findall
        self.tokens = common.Memory(self._tokens, remember, longest)
        self.chunks = common.Memory(self._chunks, remember, longest)

    def _tokens(self, tokens: list[str], few: int = 24, wide: int = 64) -> list[bytes]:
        data, single = [t.encode() for t in tokens], self.v.single
        sizes, out = defaultdict(list), [b""] * len(data)
        for at, word in enumerate(data):
            sizes[(len(word) - 2).bit_length() if len(word) > 1 else -1].append(at)
        for size, those in sizes.items():
            if 0 <= size and 1 << size <= wide and len(those) >= few:
                for at, ids in zip(those, merged_together([data[k] for k in those], 1 << size, self.v)):
                    out[at] = ids
            else:
                for at in those:
                    out[at] = array("I", merged([single[b] for b in data[at]], self.v)).tobytes()
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = list(map(self.cut, chunks))
        get = self.tokens.fill(chain.from_iterable(parts))
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]

    def plain(self, texts: list[str]) -> list[bytes]:
        cut = list(map(CHUNK.findall, texts))
        get = self.chunks.fill(chain.from_iterable(cut))
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. The name of a special token in a text is that token, as the library has it."""
        names, special = self.v.names, self.v.special
        odd = {k for k, t in enumerate(texts) if names is not None and names.search(t)}
        out = self.plain(["" if k in odd else t for k, t in enumerate(texts)])
        for k in odd:
            parts = names.split(texts[k])
            ids = self.plain(["" if p in special else p for p in parts])
            out[k] = b"".join(array("I", [special[p]]).tobytes() if p in special else i for p, i in zip(parts, ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids, special tokens by name; bytes that are no UTF-8 become replacement characters.
        Unknown ids have no text."""
        get = self.v.pieces.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _codec(file: str) -> Codec:
    return common.held(("bytepairs", file), lambda: Codec(Vocabulary(file)))


def encode_table(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, ids as little-endian unsigned 32-bit bytes. A null text is empty and has no ids.
    Repeated rows and null ids are each one row; extra columns are left behind; an empty table gives no rows."""
    def run(batches):
        codec = _codec(file)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in common.groups(texts, most=1000):
                ids = codec.encode(texts[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None), "n_tokens": [len(i) // 4 for i in ids], "ids": ids})
    return common.texts(docs, key, text).mapInPandas(run, "doc_id long, n_tokens long, ids binary")


def decode_table(encoded: DataFrame, file: str) -> DataFrame:
    """The rows of encode_table (doc_id, n_tokens, ids) with text, decoded from the ids alone."""
    def run(batches):
        codec = _codec(file)
        for batch in batches:
            ids = batch["ids"].tolist()
            for a, b in common.groups([i or b"" for i in ids], chars=1 << 21):
                part = batch.iloc[a:b].assign(text=[codec.decode(i or b"") for i in ids[a:b]])
                yield part.astype({"doc_id": "Int64", "n_tokens": "Int64"})
    return encoded.select("doc_id", "n_tokens", "ids").mapInPandas(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids and of the text decoded from them."""
    return decode_table(encode_table(docs, file), file).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
