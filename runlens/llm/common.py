"""What several operators share: checkpoints, folds, bounded training samples, connected components."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SCALE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="runlens-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: A setting of Spark 4.1; earlier ones ignore it and keep shuffle files until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Queries written and run inside drop their shuffle files as soon as they end: for those whose rows are kept elsewhere or are a
    few numbers. Where many follow each other, the files of all of them would else stay on the disks together."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


#: A setting of Spark 4.1; earlier ones ignore it and send 10,000 rows at once, however long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 1 << 22) -> None:
    """From now on the session hands Python at most about so many bytes of rows at once: a task holds a batch several times over, in
    the JVM, in Arrow and as Python strings. A bound that somebody has set stays. It is not put back, as a query is planned only when
    its caller runs it."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(most))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's shared checkpoint folder, so a lost executor loses none of them. The
    shuffles behind them are not read again and go."""
    shared_folder(df.sparkSession)
    with passing(df.sparkSession):
        return df.select("*").checkpoint()  # the setting holds for queries written under it


def held(key, make: Callable):
    """What make() gives, kept in this Python worker for its later tasks (functions sent with a job have no lasting globals)."""
    store = sys.modules.setdefault("runlens_held", types.ModuleType("runlens_held")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def tidy() -> None:
    """Gives back the memory of what nobody refers to. Objects that refer to each other, as a decoder and its memories do, would
    else stay until Python happens to look for them, and Arrow keeps what it has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def held_latest(name: str, key, make: Callable):
    """As held(), but a worker keeps only the latest key's value of a name: what stages remember of words does not add up."""
    slot = held(("latest", name), lambda: [None, None])
    if slot[0] != key:
        forget(name)
        slot[:] = key, make()
    return slot[1]


def forget(name: str) -> None:
    """Lets go what held_latest() keeps under a name, in a worker that goes on with other work."""
    slot = held(("latest", name), lambda: [None, None])
    if slot[0] is not None:
        slot[:] = None, None
        tidy()


class Remembered(dict):
    """What make gives for each short text, the newest and those asked for since: two halves, of which the older goes when the
    newer is full."""

    def __init__(self, make: Callable, remember: int, longest: int):
        super().__init__()
        self.make, self.half, self.longest, self.older = make, max(1, remember // 2), longest, {}

    def __missing__(self, text: str):
        made = self.older.get(text, self)
        if made is self:
            made = self.make(text)
        if len(text) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[text] = made
        return made


class Memory:
    """Remembers what make() gives for short texts, the newest and those wanted since: two halves, of which the older goes when the
    newer is full. The newer holds all that the last fill() asked for."""

    def __init__(self, make, remember: int, longest: int):
        self.make, self.half, self.longest, self.now, self.older, self.long = make, max(1, remember // 2), longest, {}, {}, []

    def fill(self, wanted: Iterable[str]):
        """A function from each of the wanted texts to what is remembered of it."""
        for text in self.long:
            del self.now[text]
        if len(self.now) >= self.half:
            self.now, self.older = {}, self.now
        missing = set(filterfalse(self.now.__contains__, wanted))
        known = list(filter(self.older.__contains__, missing))
        self.now.update(zip(known, map(self.older.__getitem__, known)))
        new = list(filterfalse(self.older.__contains__, missing)) if known else list(missing)
        self.long = [text for text in new if len(text) > self.longest]
        if new:
            self.now.update(zip(new, self.make(new)))
        return self.now.__getitem__


def groups(texts: list, most: int = 128, chars: int = 1 << 19):
    """Ranges of a batch, bounded in rows and, but for a single long text, in characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or held + len(t) > chars):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads; others, whatever their names, stay behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sample_by_label(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label: those with the smallest hash of the key, and at most 1.2 * per_label.

    Rows that share a key are all in or all out. One count by label, one filter; nothing is sorted.
    """
    counts = rows.groupBy(label).count().limit(1000).collect()
    share = [F.when(F.col(label) == F.lit(r[label]), F.lit(int(SCALE * min(1.0, per_label / r["count"])))) for r in counts if r[label] is not None]
    if not share:
        return rows.filter(F.lit(False))
    limit = F.coalesce(*share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(SCALE)) < limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: int) -> DataFrame:
    """(text, y) of a bounded sample of labelled training rows, equal texts once.

    The ids are drawn from the small label table first (at most a few times per_label of them), so the documents are read
    once and never shuffled: the ids are broadcast, their number is bounded by the parameter.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & train).dropDuplicates(["doc_id"])
    ids = sample_by_label(known, "doc_id", "y", per_label)
    hit = texts(docs).filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    return hit.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.min("y").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), root the smallest node reachable. Star contraction: alternate
    hooking every larger neighbour, then every smaller one, to the least neighbour, until nothing moves. Each round
    is an aggregation with map-side combining and one join."""
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        with passing(e.sparkSession):
            return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        pairs = both(edges)
        edges = pairs.filter("v > u").join(least(pairs), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        near = low.groupBy("u").agg(F.min("v").alias("m"))
        edges = low.join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b") \
            .union(near.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = cut(edges)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
