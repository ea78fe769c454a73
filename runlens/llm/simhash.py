"""SimHash near-duplicates through pivot distance tables.

A fingerprint's Hamming distances to many fixed reference fingerprints are its coordinates. Two fingerprints within r bits
differ by at most r in every coordinate, so a pair with a larger difference is discarded unseen and only survivors are
compared bit by bit.

To find candidates without meeting every row with every other, the references are also read on segments of the bits: of
three segments, one carries none of at most two differences, and there all coordinates agree. A row is dealt to one bucket
per segment, keyed by its reference distances on that segment. A bucket that stays large (a big group of near copies) is
dealt again by the same rule over the bits its key leaves free, until buckets are small or so few bits are free that a
bucket cannot be large. No link is lost at any depth and equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALL = (1 << 64) - 1


def references(count: int) -> list[int]:
    """Fixed pseudo-random 64-bit reference fingerprints."""
    return [xxhash.xxh64_intdigest(f"reference {i}", 7) for i in range(count)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles. A text of fewer words is one shingle; of none, zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text has no words, and fingerprint zero."""
    def run(batches):
        for batch in batches:
            out = batch[["doc_id"]].copy()
            out["fp"] = np.array([signed(fingerprint(t, shingle)) for t in batch["text"]], dtype=np.int64)
            yield out
    return common.texts(docs).mapInPandas(run, "doc_id long, fp long")


def _segments(free: int, parts: int = 3) -> list[int]:
    """A mask's bits, dealt to parts masks of nearly equal size."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for b in bits[k::parts]) for k in range(parts)]


def buckets(fps: DataFrame, depth: int, keys: list[int], large: int, cut=common.cut) -> DataFrame:
    """(fp, key): rows of distinct fingerprints within two bits share a key. Buckets of one row are left out."""
    rows, done, frees = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), None, [ALL]
    for level in range(1, depth + 1):
        parts = [_segments(f) for f in frees]
        masks = [m for p in parts for m in p]
        frees = [f & ~m for f, p in zip(frees, parts) for m in p]
        dealt = rows.select("fp", F.explode(F.array([F.col("path") * 3 + j for j in range(3)])).alias("path"), "key")
        mask = F.element_at(F.array([F.lit(signed(m)) for m in masks]), F.col("path") + 1)
        dealt = dealt.withColumn("mask", mask)
        near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p))).bitwiseAND(F.col("mask"))) for p in keys]
        dealt = cut(dealt.select("fp", "path", F.xxhash64("key", "path", *near).alias("key")))
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = dealt.join(sizes, "key")
        last = level == depth
        small = sized.select("fp", "key") if last else sized.filter(F.col("n") <= large).select("fp", "key")
        done = small if done is None else done.unionByName(small)
        if last:
            break
        rows = cut(sized.filter(F.col("n") > large).select("fp", "path", "key"))
        if rows.isEmpty():
            break
    return done


def links(fps: DataFrame, radius: int = 2, pivots: int = 24, keys: int = 16, large: int = 256, depth: int = 5) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most radius (0 to 2) bits.

    large only decides when a bucket is dealt again, never what is compared.
    """
    if not 0 <= radius <= 2:
        raise ValueError("three segments find differences of at most two bits")
    refs = references(max(pivots, keys))
    dealt = buckets(fps, depth, refs[:keys], large)
    tables = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte").alias(f"d{i}") for i, p in enumerate(refs[:pivots])]
    coordinates = dealt.select("key", "fp", *tables)
    left = coordinates.select("key", F.col("fp").alias("a"), *[F.col(f"d{i}").alias(f"l{i}") for i in range(pivots)])
    right = coordinates.select("key", F.col("fp").alias("b"), *[F.col(f"d{i}").alias(f"r{i}") for i in range(pivots)])
    near = common.all_of([F.abs(F.col(f"l{i}") - F.col(f"r{i}")) <= radius for i in range(pivots)])
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    joined = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("a") < F.col("b")) & near & verified)
    return joined.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay, each with its component; a null
    doc_id is kept and takes part, but is no component's id unless the component has no other. An empty table gives none.
    """
    known = common.cut(fingerprints(docs, shingle))
    class_of = _classes(_rooted(known.groupBy("fp").agg(F.min("doc_id").alias("head")), radius))
    return known.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows, all columns, of one document of each component: that with the smallest doc_id (a null one last), and among
    repeated ids the text with the smallest hash; of equal rows one stays."""
    text, mark = F.col("text").cast("string"), "__text_hash"
    marked = docs.withColumn(mark, F.xxhash64(text))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("mark"))

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    known = marked.select(simhash(text).alias("fp"), first.alias("first")).groupBy("fp").agg(F.min("first").alias("head"))
    kept = _rooted(known, radius).groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("__id"), F.col("head.mark").alias("__mark"))
    return marked.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__mark"))) \
        .drop("__id", "__mark").dropDuplicates(["doc_id", mark]).drop(mark)


def _rooted(heads: DataFrame, radius: int) -> DataFrame:
    """(fp, head, root) of distinct fingerprints: root names the component."""
    heads = common.cut(heads)
    roots = common.components(links(heads, radius)).select(F.col("node").alias("fp"), "root")
    return heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _classes(placed: DataFrame) -> DataFrame:
    """(fp, component_id) from (fp, head, root)."""
    least = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id")
