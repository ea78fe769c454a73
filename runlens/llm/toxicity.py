"""Toxicity behind disguises. A noisy-channel decoder restores disguised words (digits and signs for letters, letters set
apart, letters repeated), then the restored text is scored by its words.

Each disguised stretch becomes a lattice: every character may stand for itself, for the letters it resembles, or, between
letters, for nothing; a run of one letter may be that letter once or twice (of two, where words hardly have that letter twice). Viterbi finds the cheapest reading under a
character trigram model counted over the whole corpus plus the cost of each disguise; no reading is cut. Text without disguise has one reading
and is not decoded.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters that a sign is written for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ı": "i",
}
APART = " .-_'~,/"
SIGNS = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]")
JOINED = re.compile("[^\\W\\d_][._*'~\\-/,]+[^\\W\\d_]")
RUN = re.compile("([^\\W\\d_])\\1\\1")
PAIR = re.compile("([^\\W\\d_])\\1")
#: Single letters set apart by any gaps; the first does not follow an apostrophe within a word.
SPACED = re.compile("(?<![^\\W_]['’])(?<![^\\W_])(?:[^\\W_]|[@$!])(?:[\\s._*-]+(?:[^\\W_]|[@$!])){2,}(?![^\\W_])")
#: A letter that stands alone, as all of the above do, or a gap without any letter.
LOOSE = re.compile("(?<![^\\W_])(?:[^\\W_]|[@$!])(?![^\\W_])|^[._*-]+$")
LETTER = re.compile("[^\\W\\d_]")
LOOKALIKE = re.compile("[" + "".join(c for c in STANDS_FOR if c.isalpha()) + "]")
EDGES = ".,;:!?\"'()[]{}<>«»„“”…*#%&$|~^=+-_/\\"

#: Costs of the channel, in nats.
LITERAL, SIGN, DROP, ONCE = 9.0, 0.7, 0.7, 0.3
#: Nats from which a letter twice in a row, and a whole short word, is rare.
RARE_PAIR, RARE_PIECE = 4.5, 6.5


def _codes() -> bytes:
    """Latin-1 to 1..26 for a letter whatever its accents, 0 for all else."""
    out = bytearray(256)
    for i in range(256):
        base = unicodedata.normalize("NFD", chr(i).lower())[0]
        out[i] = ord(base) - 96 if "a" <= base <= "z" else 0
    return bytes(out)


CODES = _codes()


CODE = {chr(i): c for i, c in enumerate(CODES)}


def code(c: str) -> int:
    return CODE.get(c, 0)


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams, 27 x 27 x 27 (0: a word's edge), over every whole text. A task sends at most 27^3 rows."""
    def run(batches):
        total = np.zeros(27 ** 3, np.int64)
        for b in batches:
            for t in b["text"].dropna():
                x = np.frombuffer(b"\0" + t.encode("latin-1", "replace").translate(CODES) + b"\0", np.uint8).astype(np.int32)
                x = x[np.flatnonzero((x[1:] > 0) | (x[:-1] > 0))] if len(x) > 1 else x  # one edge between words
                total += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27 ** 3) if len(x) > 2 else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = common.texts(docs).mapInPandas(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(27 ** 3)
    for r in rows.collect():  # one row per trigram of a fixed alphabet
        out[r["gram"]] = r["n"]
    return out.reshape(27, 27, 27)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(letter | two before), interpolated with pairs, single letters and the uniform."""
    def rates(c, below, weight):
        return (c + weight * below) / (c.sum(-1, keepdims=True) + weight)
    one = rates(counts.sum((0, 1)), np.full(27, 1 / 27), 27.0)
    two = rates(counts.sum(0), one, 20.0)
    return -np.log(rates(counts, two, 20.0))


_NOTHING: frozenset[str] = frozenset()


class Decoder:
    """Cheapest readings of disguised stretches. What a word gives is decided once and remembered, up to a bound.

    make turns the restored words of one place into what is collected from a text (by default themselves)."""

    def __init__(self, costs: np.ndarray, make: Callable[[set[str]], set[str]] = set, remember: int = 160_000, longest: int = 200):
        self.costs, self.make = costs.tolist(), make
        self.known = common.Remembered(self._read, remember // 2, longest)
        self.words = common.Remembered(self._word, remember, longest)

    def arcs(self, s: str, start: int = 0) -> Iterator[list[tuple[int, str, float]]]:
        """From each position: (next position, letters read, cost of the channel)."""
        j, doubled = 0, self.doubled(s)
        for i in range(start, len(s)):
            c, arcs = s[i], []
            if c.isalpha() and c not in STANDS_FOR:
                j = max(j, i + 1)  # where the run of this letter ends
                while j < len(s) and s[j] == c:
                    j += 1
                run = j - i
                arcs.append((i + 1, c, 0.0))
                if run >= 3:  # written out by force: once, or twice as many words have it
                    arcs = [(j, c, ONCE), (j, c + c, ONCE)]
                elif run == 2 and doubled:
                    arcs.append((j, c, SIGN))
            else:
                arcs += [(i + 1, letter, SIGN) for letter in STANDS_FOR.get(c, "")]
                if c in APART:
                    arcs.append((i + 1, "", DROP))
                arcs.append((i + 1, " ", LITERAL if c != " " else 2.0))
            yield arcs

    def doubled(self, s: str) -> bool:
        """Whether a letter comes twice where words hardly have it twice, or oftener than words have any."""
        for m in PAIR.finditer(s):
            k, at = code(m[1]), m.start()
            if k and self.costs[code(s[at - 1]) if at else 0][k][k] > RARE_PAIR:
                return True
        return RUN.search(s) is not None

    def piece(self, w: str) -> tuple[str, bool, bool] | None:
        """A word of at most three letters that is hardly one, by its cost from edge to edge, and whether signs stand before
        and after it."""
        core = w.strip(EDGES)
        if not 0 < len(core) < 4 or not core.isalpha():
            return None
        p, q, total = 0, 0, 0.0
        for k in [*map(code, core), 0]:
            total += self.costs[p][q][k]
            p, q = q, k
        return (core, not w.startswith(core), not w.endswith(core)) if total > RARE_PIECE else None

    def read(self, s: str) -> str:
        """The stretch as restored words, spaces between."""
        return self.known[s]

    def _read(self, s: str, every: int = 256) -> str:
        """Viterbi over the lattice. Every few characters the paths that are left are followed back to where they meet; what lies
        before is settled, and its cells are let go, so that a long stretch takes no more memory than a short one."""
        costs, start, p, q, total, get = self.costs, 0, 0, 0, 0.0, CODE.get
        for c, follows in zip(s, s[1:] + " "):  # the plain letters that it begins with have one reading
            if c == follows or c in STANDS_FOR or not c.isalpha():
                break
            k = get(c, 0)
            if k or q:
                total += costs[p][q][k]
                p, q = q, k
            start += 1
        layers, out = {start: {(p, q): (total, None, "")}}, [s[:start]]
        for i, arcs in enumerate(self.arcs(s, start) if start < len(s) else (), start):
            states = layers.get(i)
            if states is None:
                continue
            for (a, b), (cost, _, _) in states.items():
                for j, letters, more in arcs:
                    p, q, total = a, b, cost + more
                    for x in letters:
                        k = get(x, 0)
                        if k or q:
                            total += costs[p][q][k]
                            p, q = q, k
                    layer = layers.get(j)
                    if layer is None:
                        layer = layers[j] = {}
                    old = layer.get((p, q))
                    if old is None or total < old[0]:
                        layer[p, q] = (total, (i, a, b), letters)
            if i % every == every - 1:
                self._settle(layers, i, out)
        end = min(layers[len(s)].items(), key=lambda x: x[1][0] + (costs[x[0][0]][x[0][1]][0] if x[0][1] else 0.0))
        out.append(self._back(layers, (len(s), *end[0])))
        return " ".join("".join(out).split())

    @staticmethod
    def _back(layers: dict, cell: tuple[int, int, int]) -> str:
        """Letters read from the first cell that is kept up to this one."""
        out = []
        while True:
            _, back, letters = layers[cell[0]][cell[1:]]
            if back is None:
                return "".join(reversed(out))
            out.append(letters)
            cell = back

    def _settle(self, layers: dict, i: int, out: list[str]) -> None:
        """Where all paths into places after i meet, what is read up to there goes to out, and earlier places are let go."""
        cells = {(j, *state) for j, layer in layers.items() if j > i for state in layer}
        while len(cells) > 1:
            last = max(c[0] for c in cells)
            here = {c for c in cells if c[0] == last}
            backs = {layers[last][c[1:]][1] for c in here}
            if None in backs:
                return
            cells = cells - here | backs
        meet = cells.pop()
        if meet[0] > i:
            return
        out.append(self._back(layers, meet))
        cost = layers[meet[0]][meet[1:]][0]
        for j in [j for j in layers if j <= meet[0]]:
            del layers[j]
        layers[meet[0]] = {meet[1:]: (cost, None, "")}

    @staticmethod
    def mixed(w: str) -> bool:
        """Whether a word has letters of other scripts that look like a-z beside such letters."""
        return LOOKALIKE.search(w) is not None and any("a" <= c <= "z" for c in w)

    def forms(self, w: str) -> set[str]:
        """What a word in lower case may be: itself, if it is plain, and its reading, if it seems disguised."""
        twice = PAIR.search(w) and self.doubled(w)
        if w.isalpha() and not twice and (w.isascii() or not self.mixed(w)):
            return {w}
        core, out = w.strip(EDGES), set()
        if core.isalpha() and not RUN.search(core):
            out.add(core)
        if (SIGNS.search(w) or JOINED.search(w) or twice) and LETTER.search(w):
            for form in {core, w.strip(".,;:?\"'()[]{}")}:
                out.update(self.read(form).split())
        return out

    def _word(self, w: str) -> tuple[set[str], bool, tuple[str, bool, bool] | None] | None:
        """(what it gives, whether letters set apart may go on in it, its piece()); None if all are empty."""
        gives, loose, piece = self.make(self.forms(w)) or _NOTHING, LOOSE.search(w) is not None, self.piece(w)
        return (gives, loose, piece) if gives or loose or piece else None

    def restored(self, text: str) -> set[str]:
        """What the words of the restored text give, in lower case."""
        words = text.lower().split()
        found, out, apart, spaced = list(map(self.words.__getitem__, words)), set(), [], []
        last_piece = last_loose = -2
        for i, (gives, loose, piece) in [(i, x) for i, x in enumerate(found) if x is not None]:
            out |= gives
            if loose:  # single letters, any gaps between
                if last_loose != i - 1:
                    spaced.append([])
                spaced[-1].append(words[i])
                last_loose = i
            if piece:  # neighbouring rare pieces of at most three letters: a word may have been cut into them
                if last_piece != i - 1 or piece[1]:
                    apart.append([])
                apart[-1].append(piece[0])
                last_piece = -2 if piece[2] else i
        read = [" ".join(x) for x in apart if len(x) > 1]
        for stretch in map(" ".join, spaced):
            if len(stretch) > 4:  # three letters, two gaps
                read += [" ".join(m[0].split()) for m in SPACED.finditer(stretch)]
        if read:
            out |= self.make({w for s in read for w in self.read(s).split()})
        return out


def marks(words: set[str]) -> set[str]:
    """What a text is scored by: its words, and the beginnings of longer ones."""
    return words | {f"^{w[:k]}" for w in words for k in (4, 5, 6) if len(w) > k}


def boost(doc: np.ndarray, mark: np.ndarray, y: np.ndarray, weight: np.ndarray, marks_n: int, rounds: int = 600, least: float = 2.0, rate: float = 0.4) -> tuple[float, np.ndarray]:
    """(log odds without marks, weight of each mark). Marks are chosen one at a time by the gain of a damped Newton step of an
    additive logistic model, so words that only keep company with a chosen one are left out; a chosen mark then weighs what
    it says when it stands alone, its own log odds, up to 8."""
    base = float(np.log((weight[y == 1].sum() + 0.5) / (weight[y == 0].sum() + 0.5)))
    coef, f = np.zeros(marks_n), np.full(len(y), base)
    if not marks_n:
        return base, coef
    order = np.argsort(mark, kind="stable")
    docs_of = np.split(doc[order], np.searchsorted(mark[order], np.arange(1, marks_n)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g = np.bincount(mark, weights=(weight * (y - p))[doc], minlength=marks_n)
        h = np.bincount(mark, weights=(weight * p * (1 - p))[doc], minlength=marks_n) + 0.3
        gain = np.where((g > 0) & (coef < 6), g * g / h, 0.0)
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        step = min(1.0, rate * g[best] / h[best])
        coef[best] += step
        f[docs_of[best]] += step
    pos = np.bincount(mark, weights=(weight * y)[doc], minlength=marks_n)
    neg = np.bincount(mark, weights=(weight * (1 - y))[doc], minlength=marks_n)
    alone = np.log((pos + 0.5 * np.exp(base)) / (neg + 5)) - base  # a few lucky texts do not condemn
    return base, np.where(coef > 0, np.clip(alone, np.minimum(coef, 1.5), 8.0), 0.0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = 6000, marks_most: int = 3000) -> dict:
    """The model: trigram counts of all texts, and the weights of at most marks_most marks, from about per_label labelled
    texts of each class at most."""
    costs = language_model(trigrams(docs))
    sample = common.labelled_sample(docs, labels, "toxic", train, per_label)

    def run(batches):
        decoder = Decoder(costs, marks)
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "marks": [sorted(decoder.restored(t)) for t in b["text"]]})
        del decoder
        common.tidy()

    marked = common.cut(sample.select("h", "y", "text").mapInPandas(run, "h long, y int, marks array<string>"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return {"key": uuid.uuid4().hex, "costs": costs, "base": -3.0, "weights": {}}
    each = marked.select("h", "y", F.explode("marks").alias("mark"))
    lift = (F.col("pos") / sizes[1]) / ((F.col("n") - F.col("pos") + 0.5) / (sizes.get(0, 0) + 1))
    best = each.groupBy("mark").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).filter((F.col("pos") >= 3) & (lift > 4)) \
        .orderBy(F.desc(F.col("pos") * F.log(lift)), F.col("mark").startswith("^"), F.desc(F.length("mark")), "mark").limit(marks_most)
    names = [r["mark"] for r in best.select("mark").collect()]
    at = common.cut(each.join(F.broadcast(best.select("mark")), "mark")).toPandas()  # best: at most marks_most rows
    known = marked.select("h", "y").toPandas()
    index, row = {m: i for i, m in enumerate(names)}, {h: i for i, h in enumerate(known["h"])}
    y = known["y"].to_numpy(dtype=float)
    all_ = {r["y"]: r["n"] for r in labels.filter(train & F.col("toxic").isNotNull()).groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).limit(10).collect()}
    weight = np.array([all_[int(v)] / sum(all_.values()) * len(y) / max(1, (y == v).sum()) for v in y])
    base, coef = boost(np.array([row[h] for h in at["h"]], dtype=int), np.array([index[m] for m in at["mark"]], dtype=int), y, weight, len(names))
    return {"key": uuid.uuid4().hex, "costs": costs, "base": base, "weights": {m: float(w) for m, w in zip(names, coef) if w}}


def scorer(model: dict):
    """A function from a column of texts to scores; null and empty texts have no words, and the score of none."""
    @F.pandas_udf("double")
    def toxicity_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, base = model["weights"], model["base"]
        decoder = common.held_latest("words", ("toxicity", model["key"]), lambda: Decoder(model["costs"], lambda words: marks(words) & weights.keys()))
        for texts in batches:
            f = np.array([base + sum(weights[m] for m in decoder.restored(t or "")) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -30, 30))))
    return toxicity_score


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    return common.texts(docs).select("doc_id", scorer(model)("text").alias("score"))


def keep(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""
    return docs.filter(scorer(model)(F.col("text").cast("string")) < threshold)


def held_out(doc_id: Column) -> Column:
    return common.fold(doc_id, 5) == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_label: int = 6000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows are scored each, extra columns left behind;
    without toxic examples every score is low; an empty table gives no rows."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), per_label)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
