"""Periodic runs of words: every maximal stretch whose words repeat with a period, found exactly.

The texts of a batch are numbered word by word and set one after another with a different separator between any two. A run of
period p and at least 2p words covers two neighbouring points of the grid 0, p, 2p, ... of its text, so every grid of every
period is walked (harmonically many points in all), and at each pair of neighbours the common extension to the right and to the
left tells the run. An extension (LCE) compares a few words until both places lie on the difference cover; the rest is one
range minimum over the sorted cover-sampled suffixes. The suffixes are sorted only for texts in which some pair gets that far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A perfect difference set; any two residues modulo the period are joined by exactly one shift onto it.
PERIOD, COVER = 13, (0, 1, 3, 9)
RUN = "array<struct<start: long, length: long, period: long>>"


def _shifts() -> np.ndarray:
    """shift[a, b]: the smallest d with (a + d) and (b + d) both in the cover, modulo its period."""
    on = np.isin(np.arange(PERIOD), COVER)
    at = np.arange(PERIOD)
    return np.array([[next(d for d in range(PERIOD) if on[(a + d) % PERIOD] and on[(b + d) % PERIOD]) for b in at] for a in at])


SHIFT = _shifts()


class Suffixes:
    """Longest common extensions to the right within x, an array of word numbers whose last element occurs once."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.x = np.concatenate([x, np.full(PERIOD, -1, x.dtype)])
        self.rank = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling (a place on the cover plus the period is on the cover again), then the
        common lengths of neighbours in that order and their sparse table of minima."""
        n, x = self.n, self.x
        at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
        place = np.full(n + 1, -1, np.int64)  # of a position among the samples
        place[at] = np.arange(len(at))
        bits = max(1, int(x.max() + 2).bit_length())
        each = 62 // bits  # words in one sort key
        keys = []
        for first in range(0, PERIOD, each):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + each, PERIOD)):
                key = (key << bits) + x[at + k] + 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.concatenate([[False], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        levels, h = [(PERIOD, rank)], PERIOD
        while rank.max() < len(at) - 1:
            later = place[np.minimum(at + h, n)]
            key = rank * (len(at) + 1) + np.where(later >= 0, rank[later] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
            h *= 2
            levels.append((h, rank))
        a, b = at[order][:-1], at[order][1:]
        length = np.zeros(len(a), np.int64)
        for h, r in reversed(levels):
            i, j = place[np.minimum(a + length, n)], place[np.minimum(b + length, n)]
            length += h * ((i >= 0) & (j >= 0) & (r[i] == r[j]))
        alive = np.arange(len(a))
        while len(alive):
            alive = alive[x[a[alive] + length[alive]] == x[b[alive] + length[alive]]]
            length[alive] += 1
        table = [length.astype(np.int32)]
        while 2 ** len(table) <= len(length):
            low, half = table[-1], 2 ** (len(table) - 1)
            table.append(np.minimum(low[:-half], low[half:]))
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[at] = rank
        self.table = table

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common lengths of pairs of different places on the cover."""
        if self.rank is None:
            self._sort()
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - 2 ** int(k)])
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, i and j different places."""
        shift = SHIFT[i % PERIOD, j % PERIOD]
        out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(PERIOD):
            there = shift[alive] == t
            if there.any():
                done = alive[there]
                out[done] = t + self._sampled(i[done] + t, j[done] + t)
                alive = alive[~there]
            alive = alive[self.x[i[alive] + t] == self.x[j[alive] + t]]
            if not len(alive):
                break
            out[alive] = t + 1
        return out


def grid(n: int, most: int = 1 << 19):
    """(i, p) of all pairs i, i + p of neighbouring grid points below n, for p up to n / 2: in parts of about most pairs."""
    counts = (n - 1) // np.arange(1, n // 2 + 1)
    first = 0
    while first < len(counts):
        total = np.cumsum(counts[first:first + most])
        last = first + max(1, int(np.searchsorted(total, most, "right")))
        c = counts[first:last]
        p = np.repeat(np.arange(first + 1, last + 1), c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield k * p, p
        first = last


def find_runs(texts: list[np.ndarray], least: int = 12, most: int = 1 << 19) -> list[np.ndarray]:
    """For each array of word numbers (0 and up) its runs as rows (start, length, period), by start, then period: all stretches of
    at least max(least, 2 * period) words with that smallest period which no neighbouring word extends."""
    waiting, held, found = [], 0, []
    top = 1 + max([int(t.max()) for t in texts if len(t)], default=0)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    x = np.empty(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    x[0] = top
    for k, (t, s, e) in enumerate(zip(texts, starts, ends)):
        x[s:e], x[e] = t, top + 1 + k  # a different separator each
    right, left = Suffixes(x), Suffixes(x[::-1].copy())

    def flush():
        i, p = (np.concatenate(c) for c in zip(*waiting))
        more = right.lce(i, i + p)
        back = left.lce(len(x) - i, len(x) - i - p)
        ok = back + p + more >= np.maximum(least, 2 * p)
        if ok.any():
            found.append(np.unique(np.stack([i - back, i + p + more, p], axis=1)[ok], axis=0))
        waiting.clear()

    for t, s in zip(texts, starts.tolist()):
        if len(t) < max(least, 2):
            continue
        for i, p in grid(len(t), most):
            same = t[i] == t[i + p]
            if same.any():
                waiting.append((i[same] + s, p[same]))
                held += len(waiting[-1][0])
                if held > most:
                    flush()
                    held = 0
    if waiting:
        flush()
    if not found:
        return [np.empty((0, 3), np.int64) for _ in texts]
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])]  # a stretch counts with its smallest period
    rows[:, 1] -= rows[:, 0]
    rows = rows[np.lexsort([rows[:, 2], rows[:, 0]])]
    cut = np.searchsorted(rows[:, 0], starts)
    out = np.split(rows, cut[1:])
    return [r - np.array([s, 0, 0]) for r, s in zip(out, starts)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces, tabs and line ends, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def detect(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed, the
    text with each run cut to its first period and single spaces between words.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are each one row; two
    runs may share a start. Extra columns are left behind; an empty table gives no rows. A text is read whole, in one task;
    memory is in proportion to the batch's words.
    """
    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["doc_id"]
            for a, b in common.groups(texts):
                numbers: dict[bytes, int] = {}
                cut = [words_of(t) for t in texts[a:b]]
                for words in cut:
                    for w in set(words) - numbers.keys():
                        numbers[w] = len(numbers)
                get = numbers.__getitem__
                arrays = [np.fromiter(map(get, words), np.int64, len(words)) for words in cut]
                runs, collapsed = find_runs(arrays, least), []
                for words, found in zip(cut, runs):
                    stay = words if not len(found) else [w for w, k in zip(words, kept(len(words), found).tolist()) if k]
                    collapsed.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
                yield pd.DataFrame({
                    "doc_id": ids.iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None), "n_words": [len(w) for w in cut],
                    "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in runs], "collapsed": collapsed})
    return common.texts(docs, key, text).mapInPandas(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def replanted(docs: DataFrame, tenth: int = 10) -> DataFrame:
    """(doc_id, text): in every tenth document by the checksum h of its id (a null id counts as empty text), the words from
    a = g % n on repeat the first p = 1 + (n - a) // (3 + g % 8) of them, g being h // 10 and n the number of words; its words
    then have single spaces between them. Other texts are as they were."""
    def run(batches):
        for batch in batches:
            out = batch["text"].tolist()
            for k in np.flatnonzero(batch["h"].to_numpy() % tenth == 0):
                words, g = words_of(out[k]), int(batch["h"].iloc[k]) // 10
                if words:
                    a = g % len(words)
                    rest = len(words) - a
                    p = 1 + rest // (3 + g % 8)
                    words[a:] = (words[a:a + p] * (rest // p + 1))[:rest]
                    out[k] = b" ".join(words).decode("utf-8", "surrogatepass")
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": out})
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return common.texts(docs).select("doc_id", "text", h.alias("h")).mapInPandas(run, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """Of detect()'s rows: doc_id, n_runs, the longest run (ties: smaller start, then smaller period) and sha256 digests."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("from_start"), (-r["period"]).alias("by_period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("top.length"), -F.col("top.from_start"), -F.col("top.by_period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
