"""Quality by compression: a dictionary is built from good texts and one from bad texts, and a text is good as far as the
good dictionary compresses it better. The difference of compressed sizes over their sum, with the share of its bytes that
the good dictionary leaves, is calibrated to a probability.

Both are measured twice: on the bytes of the text, and on its shape, where every letter is one of two (upper or lower case)
and every digit one, so that how a text is written counts apart from what words it uses. A text is compressed in parts of
nearly equal length, so that the dictionaries count in long texts as much as in short ones; the whole text is used.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PART = 1024


def parts(data: bytes) -> list[bytes]:
    count = max(1, -(-len(data) // PART))
    step = -(-len(data) // count) or 1
    return [data[i:i + step] for i in range(0, len(data), step)]


def _shapes() -> bytes:
    kinds = [chr(i) for i in range(256)]
    return bytes(ord("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c) for c in kinds)


SHAPES = _shapes()


def views(text: str) -> tuple[bytes, bytes]:
    """The text's bytes and its shape; a character beyond Latin-1 is a letter there."""
    codecs.register_error("letter", lambda e: ("a" * (e.end - e.start), e.end))
    return text.encode("utf-8", "surrogatepass"), text.encode("latin-1", "letter").translate(SHAPES)


class Pair:
    """A good and a bad dictionary at work."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        self.coders = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in raw]

    def measure(self, data: bytes) -> tuple[float, float]:
        """((bad size - good size) / (bad size + good size), log of the share left by the good dictionary); zeros if empty."""
        if not data:
            return 0.0, 0.0
        blocks = parts(data)
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.coders)
        return (bad - good) / (bad + good), math.log((good + 20) / (len(data) + 20))


def features(dictionaries: list[tuple[bytes, bytes]], texts: list) -> np.ndarray:
    """Four measures of each text and their squares."""
    pairs = [Pair(*d) for d in dictionaries]
    x = np.array([[m for p, v in zip(pairs, views(t or "")) for m in p.measure(v)] for t in texts]).reshape(len(texts), 4)
    return np.column_stack([x, x * x])


def content(datas: list[bytes], size: int, seed: int) -> bytes:
    """Dictionary bytes: a slice of every text, each at a random place, in equal shares."""
    draw = np.random.default_rng(seed)
    datas = [d for d in datas if d]
    share = max(64, size // max(1, len(datas)))
    at = [int(draw.integers(0, max(1, len(d) - share + 1))) for d in datas]
    return b"".join(d[i:i + share] for d, i in zip(datas, at))[:size].ljust(8, b"\0")


class Calibration:
    """Logistic regression on standardised measures; the weights of the classes are those of all labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, pull: float = 0.01):
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(8), np.ones(8))
        m, self.w = self._rows(x), np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            p = self._sigmoid(m @ self.w)
            hess = (m.T * (weight * p * (1 - p))) @ m + pull * np.eye(len(self.w))
            self.w = self.w + np.linalg.solve(hess, m.T @ (weight * (y - p)) - pull * self.w)

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -10, 10), np.ones(len(x))])

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._rows(x) @ self.w)


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = 3000, size: int = 110_000, seed: int = 4) -> dict:
    """The model, from about per_label labelled texts of each class at most. Half of them fill the dictionaries, the other
    half, which the dictionaries have not seen, calibrates the score."""
    sample = common.cut(common.labelled_sample(docs, labels, "quality", train, per_label)
                        .withColumn("first", F.pmod(F.shiftright("h", 17), F.lit(2)) == 0))
    chosen = sample.filter("first").select("y", "text").toPandas()
    both = [views(t) for t in chosen["text"]]
    dictionaries = [tuple(content([v[k] for v, c in zip(both, chosen["y"]) if c == y], size, seed) for y in (1, 0)) for k in (0, 1)]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"x": list(features(dictionaries, b["text"].tolist())), "y": b["y"]})

    rest = sample.filter(~F.col("first")).select("text", "y").mapInPandas(run, "x array<double>, y int").toPandas()
    x, y = np.array(rest["x"].tolist()).reshape(len(rest), 8), rest["y"].to_numpy(dtype=float)
    all_ = {r["y"]: r["n"] for r in labels.filter(train & F.col("quality").isNotNull()).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).limit(10).collect()}
    share = {v: all_.get(v, 0) / sum(all_.values()) * len(y) / max(1, (y == v).sum()) for v in (0, 1)} if all_ else {}
    return {"dictionaries": dictionaries, "calibration": Calibration(x, y, np.array([share.get(int(v), 1.0) for v in y]))}


def scorer(model: dict):
    """A function from a column of texts to (difference, score). Null and empty texts measure zero throughout, and have the
    score that calibration gives to that."""
    dictionaries, calibration = model["dictionaries"], model["calibration"]

    @F.pandas_udf("difference double, score double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.forget("words")  # of an earlier stage
        for texts in batches:
            x = features(dictionaries, texts.tolist())
            yield pd.DataFrame({"difference": x[:, 0], "score": calibration(x)})
    return quality_score


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, difference, score) of every row's whole text."""
    return common.texts(docs).select("doc_id", scorer(model)("text").alias("q")).select("doc_id", "q.difference", "q.score")


def keep(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns, whose text scores at least the threshold."""
    return docs.filter(scorer(model)(F.col("text").cast("string"))["score"] >= threshold)


def held_out(doc_id: Column) -> Column:
    return common.fold(doc_id, 4) == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_label: int = 3000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows are scored each, extra columns left behind;
    without any labelled text every score is 0.5; an empty table gives no rows."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), per_label)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
