"""Near copies by resemblance: two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: each set has a fingerprint, fingerprints within two bits are found through simhash's pivot distance tables,
and the texts behind them are measured whole. Edited copies differ in more bits than a search of 64 bits can reach, so further
candidates come from min-hashes in bands and are measured too. With 32 bands of six, a pair at exactly 0.8 shares no band, and is
missed, with probability 0.738 ** 32, about 6 in 100,000; a pair at 0.9 never in practice.

A large bucket never makes all its pairs. Its members are measured against one of them, its head, in the same pass as SimHash's pairs,
and texts that these links hold together need no further measuring. Texts of buckets that are still in parts go through an exact filter
instead: their shingles are ordered by rarity, and two texts of the wanted similarity share a shingle among the first ninth of the
smaller and the first fifth of the larger one, at places that leave enough shingles after them. They also differ in at most a ninth of
their shingles, which the parities of 512 classes of shingles bound from below, so texts just short of the similarity seldom become a
pair. Only pairs of different parts that pass are measured.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: 64-bit words that say of a set which classes of shingles it has an odd number of, and their columns.
WORDS = 8
ODD = [f"odd{w}" for w in range(WORDS)]
SLACK = 1e-9


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of a text's different word shingles, in order. A text of fewer words is one shingle; so is one of none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    return np.unique(np.array([digest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)], dtype=np.uint64))


def name(found: np.ndarray) -> int:
    """What a set of shingles is called by."""
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 42), dtype=np.uint64).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def min_hashes(found: np.ndarray, count: int) -> np.ndarray:
    draw = np.random.default_rng(11)
    a, b = (draw.integers(1, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at:at + 1024, None] ^ b) * a).min(axis=0))
    return least


def sketches(rows: DataFrame, size: int, bands: int, deep: int) -> DataFrame:
    """(set, n, fp, bands, doc_id, mark) of rows (doc_id, text, mark): a name of the shingle set, its size, its SimHash, a hash for
    each band."""
    def run(batches):
        common.forget("words")  # of an earlier stage
        for batch in batches:
            names, sizes, fps, keys = [], [], [], []
            for t in batch["text"]:
                found = shingles(t, size)
                names.append(name(found))
                sizes.append(len(found))
                fps.append(simhash.signed(simhash.majority(found)))
                hashes = min_hashes(found, bands * deep).reshape(bands, deep)
                keys.append(np.array([xxhash.xxh64_intdigest(h.tobytes(), i) for i, h in enumerate(hashes)], dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"set": np.array(names, dtype=np.int64), "n": sizes, "fp": np.array(fps, dtype=np.int64), "bands": keys, "doc_id": batch["doc_id"].astype("Int64"), "mark": batch["mark"]})
    return rows.mapInPandas(run, "set long, n int, fp long, bands array<long>, doc_id long, mark long")


def measured(pairs: DataFrame, texts: DataFrame, size: int, least: float, per_task: int = 1000) -> DataFrame:
    """(a, b): the pairs whose whole texts are that similar.

    Sets are dealt to blocks by hash, and a task measures the pairs of two blocks, about per_task of them: it gets each text once,
    however many of its pairs hold it, and a set with very many pairs goes to as many tasks as there are blocks."""
    with common.passing(pairs.sparkSession):
        blocks = math.ceil(math.sqrt(pairs.count() / per_task)) or 1

    def run(these: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known = {k: shingles(t, size) for k, t in zip(held["set"].tolist(), held["text"].tolist())}
        keep = [similarity(known[a], known[b]) >= least for a, b in zip(these["a"].tolist(), these["b"].tolist())]
        return these.loc[keep, ["a", "b"]]

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(name, F.lit("block")), F.lit(blocks))
    dealt = pairs.withColumn("deal", block("a") * blocks + block("b"))
    wanted = dealt.select(F.col("deal").alias("to"), F.col("a").alias("set")).union(dealt.select("deal", "b")).distinct().join(texts, "set")
    return dealt.groupBy("deal").cogroup(wanted.groupBy("to")).applyInPandas(run, "a long, b long")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def close(known: DataFrame, least: float, radius: int = 2) -> DataFrame:
    """(a, b): pairs of sets (set, n, fp) that SimHash puts together and whose sizes allow that similarity: the heads of any two
    fingerprints within radius bits, and each set with the head of its own fingerprint. A fingerprint has at most 2,080 others within
    two bits, so these grow with the sets, however large a group is."""
    heads = common.cut(known.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("head")))
    between = simhash.links(heads, radius)
    x, y = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head")) for k in "ab")
    pairs = between.join(x, "a").join(y, "b").select("a_head", "b_head") \
        .union(known.join(heads, "fp").select(F.struct("set", "n"), "head")).toDF("a", "b").filter("a.set <> b.set")
    sizes = F.least("a.n", "b.n") / F.greatest("a.n", "b.n")
    return pairs.filter(sizes >= least).select(*_pair(F.col("a.set"), F.col("b.set"))).distinct()


def rare_first(apart: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(set, n, root, alone, odd0.., s, at) of the sets (set, n, root): their shingles that another of them has, and each one's place
    when a set's shingles are ordered from the rarest among these sets to the commonest; how many shingles no other set has, and for
    each of 512 classes of the others if the set has an odd number of them, in WORDS words."""
    def run(batches):
        for batch in batches:
            found = [shingles(t, size).view(np.int64) for t in batch["text"]]
            for at in range(0, len(found), 256):
                some = found[at:at + 256]
                yield pd.DataFrame({"set": np.repeat(batch["set"].to_numpy()[at:at + 256], [len(x) for x in some]), "s": np.concatenate(some)})
    each = common.cut(texts.join(apart.select("set"), "set").mapInPandas(run, "set long, s long"))
    counts = each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    odd = [F.bit_xor(F.expr(f"if(pmod(s, {64 * WORDS}) div 64 = {w}, shiftleft(1L, cast(pmod(s, 64) as int)), 0L)")).alias(f"odd{w}") for w in range(WORDS)]
    order = each.join(counts, "s").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("order"), *odd)
    places = order.join(apart, "set").withColumn("alone", F.col("n") - F.size("order"))
    kept = ["set", "n", "root", "alone", *ODD]
    return places.select(*kept, F.posexplode("order").alias("k", "x")).select(*kept, F.col("x.s").alias("s"), (F.col("alone") + F.col("k")).alias("at"))


def leading(places: DataFrame, least: float) -> DataFrame:
    """The places of rare_first() at which a pair of that similarity may have its first common shingle."""
    return places.filter(F.col("n") - F.col("at") >= least * F.col("n") - SLACK)


def likely(places: DataFrame, least: float) -> DataFrame:
    """(a, b): every pair of sets with different roots and that similarity, and some more, from rare_first()'s rows. A pair's common
    shingles number share * (n + m) at least, and no fewer than that are left from its first common one on. So at most
    (1 - 2 * share) * (n + m) are in one set only: those no other set has, and at least one in each class that differs in odd and even."""
    share = least / (1 + least)
    small = places.filter(F.col("n") - F.col("at") >= 2 * share * F.col("n") - SLACK)
    large = leading(places, least).select("s", F.col("set").alias("other"), F.col("n").alias("m"), F.col("root").alias("its"), F.col("at").alias("there"),
                                          F.col("alone").alias("lone"), *[F.col(c).alias(f"its_{c}") for c in ODD])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"its_{c}"))) for c in ODD), F.col("alone") + F.col("lone"))
    fit = (F.col("root") != F.col("its")) & ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("set") < F.col("other"))) \
        & (F.col("n") >= least * F.col("m") - SLACK) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there")) >= share * (F.col("n") + F.col("m")) - SLACK) \
        & (differ <= (1 - 2 * share) * (F.col("n") + F.col("m")) + SLACK)
    return small.join(large, "s").filter(fit).select(*_pair(F.col("set"), F.col("other"))).distinct()


def roots(together: DataFrame, members: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(node, root) of the sets with a link, from SimHash's pairs (a, b) and (key, set, n): these pairs and those of each bucket's
    members with its head are measured, then come those of the exact filter over the texts of the buckets that are still in parts."""
    heads = members.groupBy("key").agg(F.min_by(F.struct("set", "n"), F.xxhash64("set", F.lit(0))).alias("head")).select("key", F.col("head.set").alias("other"), F.col("head.n").alias("m"))
    headed = members.join(heads, "key").filter((F.col("set") != F.col("other")) & (F.least("n", "m") / F.greatest("n", "m") >= least)).select(*_pair(F.col("set"), F.col("other")))
    found = common.components(measured(common.cut(together.union(headed).distinct()), texts, size, least))
    placed = common.cut(members.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    parted = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    apart = common.cut(placed.join(parted.select("key"), "key", "left_semi").select("set", "n", "root").distinct())
    pairs = common.cut(likely(common.cut(leading(rare_first(apart, texts, size), least)), least))
    return common.components(found.toDF("a", "b").unionByName(measured(pairs, texts, size, least)))


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8, bands: int = 32, deep: int = 6) -> DataFrame:
    """The rows, all columns, of one document of each group of texts that hang together by links: that with the smallest doc_id
    (a null one last), and among repeated ids the text with the smallest hash; of equal rows one stays. Null and empty texts
    have no words and are one group. An empty table gives no rows."""
    text, mark = F.col("text").cast("string"), "__text_hash"
    marked = docs.withColumn(mark, F.xxhash64(text))
    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(mark).alias("mark"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    known = common.cut(sketches(rows, size, bands, deep).groupBy("set").agg(F.min(first).alias("head"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    dealt = known.select("set", "n", F.explode("bands").alias("key"))
    members = common.cut(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "key").select("key", "set", "n"))
    together = common.cut(close(known.select("set", "n", "fp"), least))
    named = members.select("set").union(together.select("a")).union(together.select("b")).distinct()
    wanted = known.join(named, "set").select("set", F.col("head.doc_id").alias("id"), F.col("head.mark").alias("at"))
    texts = common.cut(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("at"))).select("set", "text").dropDuplicates(["set"]))
    placed = known.select("set", "head").join(roots(together, members, texts, size, least).withColumnRenamed("node", "set"), "set", "left")
    kept = placed.groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("__id"), F.col("head.mark").alias("__mark"))
    return marked.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__mark"))) \
        .drop("__id", "__mark").dropDuplicates(["doc_id", mark]).drop(mark)
