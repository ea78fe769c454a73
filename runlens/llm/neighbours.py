"""Nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and cut into slots of one width; the slots of a few directions
together are a table's bucket. On unit vectors the Euclidean distance that the hash preserves orders as the cosine does. A
query visits its own bucket and then perturbed ones, one slot up or down in some directions, in the order of the estimated
chance that a neighbour fell there (the sum of squared distances to the crossed borders). Candidates of all tables are
measured exactly in double precision and merged.

Equal vectors are one row of the index, with its smallest ids, so a common vector costs no more than a rare one. A bucket
is cut into blocks of bounded size, and so are its queries; what leaves a block is each query's best few.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Tables:
    """The hash functions: tables x functions directions for vectors of one size, the same wherever they are made."""

    def __init__(self, tables: int, functions: int, width: float, seed: int = 7):
        self.tables, self.functions, self.width, self.seed, self.made = tables, functions, width, seed, {}

    def _draw(self, dim: int):
        if dim not in self.made:
            draw = np.random.default_rng([self.seed, dim])
            size = self.tables * self.functions
            self.made[dim] = draw.standard_normal((dim, size)), draw.uniform(0, self.width, size)
        return self.made[dim]

    def places(self, x: np.ndarray) -> np.ndarray:
        """Real-valued places of unit vectors, (rows, tables, functions); the slot is the floor."""
        a, b = self._draw(x.shape[1])
        return ((x @ a + b) / self.width).reshape(len(x), self.tables, self.functions)

    @staticmethod
    def key(slots: np.ndarray) -> np.ndarray:
        """One number per row of slots."""
        out = np.zeros(slots.shape[:-1], np.int64)
        for i in range(slots.shape[-1]):
            out = out * 64 + (slots[..., i] + 32)
        return out


def perturbations(place: np.ndarray, probes: int) -> list[np.ndarray]:
    """Offsets of the buckets to visit from one place, the own one first, then by rising score. An offset moves each direction
    by one slot at most; sets are enumerated from a heap by replacing or adding the next cheapest move."""
    frac = place - np.floor(place)
    moves = sorted([(f * f, i, -1) for i, f in enumerate(frac)] + [((1 - f) ** 2, i, 1) for i, f in enumerate(frac)])
    out = [np.zeros(len(place), np.int64)]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            more = moves[last + 1][0]
            heapq.heappush(heap, (cost + more, (*chosen, last + 1)))
            heapq.heappush(heap, (cost - moves[last][0] + more, (*chosen[:-1], last + 1)))
        if len({moves[c][1] for c in chosen}) == len(chosen):
            step = np.zeros(len(place), np.int64)
            for c in chosen:
                step[moves[c][1]] += moves[c][2]
            out.append(step)
    return out


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(batch: pd.DataFrame):
    for _, part in batch.groupby(batch["v"].map(len)):
        yield part


def search(rows: DataFrame, is_query: Column, k: int = 5, tables: int = 2, functions: int = 4, width: float = 2.0, probes: int = 60,
           block: int = 4096, query_block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query holds, ties to smaller ids.

    A row is never its own neighbour; vectors of another length are none either. Null, zero and non-finite vectors, and null
    ids, take no part. Equal rows count once. Extra columns are left behind; an empty table gives no rows. block and
    query_block bound what one task holds, not what is compared.
    """
    hashes = Tables(tables, functions, width)
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    own = common.cut(own.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "q", F.xxhash64("v").alias("h"), "v"))
    # One row per distinct vector: its k + 1 smallest ids. The window keeps k + 1 rows of a vector per task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = own.select("id", "h", "v").distinct().withColumn("n", rank).filter(F.col("n") <= k + 1)
    index = common.cut(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                       .select(F.col("ids")[0].alias("rep"), "h", "v", "ids"))
    asked = common.cut(own.filter("q").groupBy("h", "v").agg(F.min("id").alias("query")))

    def place(batches):
        for b in batches:
            for part in _by_size(b):
                at = Tables.key(np.floor(hashes.places(_unit(part["v"]))).astype(np.int64))
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "size": part["v"].map(len), "bucket": at[:, t], "rep": part["rep"], "v": part["v"]})

    def visit(batches):
        for b in batches:
            for part in _by_size(b):
                places = hashes.places(_unit(part["v"]))
                for q, v, where in zip(part["query"], part["v"], places):
                    for t in range(tables):
                        slots = np.floor(where[t]).astype(np.int64) + np.array(perturbations(where[t], probes))
                        yield pd.DataFrame({"t": t, "size": len(v), "bucket": Tables.key(slots), "query": q})

    placed = common.cut(index.select("rep", "v").mapInPandas(place, "t int, size int, bucket long, rep long, v array<float>"))
    sizes = placed.groupBy("t", "size", "bucket").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    chunks = -(-max(1, asked.count()) // query_block)
    visits = asked.select("query", "v").mapInPandas(visit, "t int, size int, bucket long, query long").join(sizes, ["t", "size", "bucket"])
    visits = visits.join(asked.select("query", "v"), "query").select(
        "t", "size", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.lit(chunks)).alias("chunk"), "query", "v")
    cells = placed.join(sizes, ["t", "size", "bucket"]).select(
        "t", "size", "bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "rep", "v")

    def nearest(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(queries):
            return pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64"})
        cell = cell.sort_values("rep")
        reps, x = cell["rep"].to_numpy(), _unit(cell["v"])
        few = min(k + 1, len(reps))
        out = []
        for a in range(0, len(queries), 256):
            part = queries[a:a + 256]
            s = _unit(part["v"]) @ x.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :few] if len(reps) <= 64 else _top(s, few)
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), few), "rep": reps[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    keys = ["t", "size", "bucket", "part", "chunk"]
    found = cells.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(nearest, "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    merged = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    measured = _exact(merged, asked, index)
    each = measured.select("query", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    # Every querying row takes its vector's list without itself.
    wanted = own.filter("q").select("id", "h", "v").distinct().join(asked, ["h", "v"]).select(F.col("id").alias("query_id"), "query")
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    mine = wanted.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _top(s: np.ndarray, few: int) -> np.ndarray:
    """Columns of each row's largest values, largest first, ties to smaller columns."""
    edge = -np.partition(-s, few - 1, axis=1)[:, few - 1]
    out = np.empty((len(s), few), np.int64)
    for i, (row, e) in enumerate(zip(s, edge)):
        at = np.flatnonzero(row >= e)
        out[i] = at[np.argsort(-row[at], kind="stable")][:few]
    return out


def _exact(pairs: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """The few merged pairs measured again on the original vectors, in double precision."""
    both = pairs.select("query", "rep").join(asked.select("query", F.col("v").alias("a")), "query").join(index.select("rep", F.col("v").alias("b"), "ids"), "rep")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    a, b = F.col("a"), F.col("b")
    return both.select("query", "ids", (dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))).alias("score"))
