"""Folded call stacks: flame paths, hotspots, the dominant path, and the hot-function finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.topk import top_k

c = F.col

# How deep and how fine a flame tree is kept, and what a hot function is.
MAX_DEPTH, PRUNE_SHARE, MAX_HOTSPOTS, PATH_DEPTH = 64, 0.004, 60, 12
HOT_MEDIUM, HOT_HIGH = 30.0, 50.0


def folded(stacks: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct stacks with their summed weight. Profiles repeat a few stacks very often, so this comes first."""
    return (stacks.where((F.size("frames") > 0) & (c("weight") > 0)).groupBy(*keys, "frames")
            .agg(F.sum("weight").alias("weight")))


def samples(stacks: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """Total weight per profile; a profile without any is unsupported."""
    return stacks.groupBy(*keys).agg(F.sum(F.when((F.size("frames") > 0) & (c("weight") > 0), c("weight")).otherwise(0))
                                     .alias("samples")).withColumn("supported", c("samples") > 0)


def flame_paths(stacks: DataFrame, keys: list[str] = ["run_id"], *, folded_in: bool = False) -> DataFrame:
    """F1 / F8: one row per tree node - its path from the root, depth and weight - without nodes too small to draw."""
    f = stacks if folded_in else folded(stacks, keys)
    depth = F.explode(F.sequence(F.lit(1), F.least(F.size("frames"), F.lit(MAX_DEPTH)))).alias("depth")
    nodes = (f.select(*keys, "frames", "weight", depth)
             .groupBy(*keys, F.slice("frames", 1, c("depth")).alias("path"), "depth").agg(F.sum("weight").alias("value")))
    total = f.groupBy(*keys).agg(F.sum("weight").alias("samples"))
    least = F.greatest(F.lit(1), F.bround(c("samples") * PRUNE_SHARE))
    # A node never outweighs its parent, so cutting by weight alone keeps the tree connected.
    return nodes.join(total, keys).where(c("value") >= least).select(
        *keys, "path", "depth", F.element_at("path", -1).alias("name"), "value")


def all_hotspots(stacks: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    f = folded(stacks, keys)
    leaf = F.element_at("frames", -1)
    per = f.select(*keys, "weight", leaf.alias("leaf"), F.explode(F.array_distinct("frames")).alias("function"))
    rows = per.groupBy(*keys, "function").agg(
        F.sum(F.when(c("function") == c("leaf"), c("weight")).otherwise(0)).alias("self"), F.sum("weight").alias("total"))
    n = f.groupBy(*keys).agg(F.sum("weight").alias("samples"))
    return rows.join(n, keys).select(*keys, "function", "self", "total", (c("self") * 100 / c("samples")).alias("self_pct"),
                                     (c("total") * 100 / c("samples")).alias("total_pct"))


def hotspots(stacks: DataFrame, keys: list[str] = ["run_id"], k: int = MAX_HOTSPOTS) -> DataFrame:
    """F1 / K6: functions by the weight they had at the leaf, then anywhere in the stack."""
    return top_k(all_hotspots(stacks, keys), keys, [F.desc("self"), F.desc("total"), F.asc("function")], k, rank="rank")


def dominant_path(stacks: DataFrame, keys: list[str] = ["run_id"], depth: int = PATH_DEPTH) -> DataFrame:
    """from the root always to the heaviest child. Each node keeps its heaviest child, then the chain is followed
    one level at a time; a level has one row per profile."""
    nodes = flame_paths(stacks, keys).where(c("depth") <= depth)
    parent = F.slice("path", 1, c("depth") - 1)
    best = nodes.groupBy(*keys, parent.alias("parent")).agg(
        F.min_by(c("path"), F.struct((-c("value")).alias("v"), c("name"))).alias("path"))
    # A path is dominant when each of its prefixes is its parent's heaviest child: count the prefixes that are.
    steps = best.select(*keys, c("path").alias("step"))
    cand = best.select(*keys, "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("d"))
    ok = (cand.select(*keys, "path", F.slice("path", 1, c("d")).alias("step")).join(steps, [*keys, "step"])
          .groupBy(*keys, "path").agg(F.count("*").alias("hits")).where(c("hits") == F.size("path")))
    return ok.groupBy(*keys).agg(F.max_by("path", F.size("path")).alias("stack"))


def hot_context(stacks: DataFrame, keys: list[str] = ["run_id"], k: int = 5) -> DataFrame:
    """what a profile says at a glance - its top functions, dominant path and sample count."""
    top = hotspots(stacks, keys, k).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "function"))), lambda s: s["function"]).alias("functions"))
    return samples(stacks, keys).join(top, keys, "left").join(dominant_path(stacks, keys), keys, "left").select(
        *keys, "functions", "stack", "samples")


def thread_flame(spans: DataFrame, thread_stacks: DataFrame, summary: dict[str, Column] | None = None) -> DataFrame:
    """The off-CPU flame of each request's own thread, or of the whole process where that thread has none.

    One row per request and node. With `summary`, aggregates over the nodes of a flame, there is one row per request (and its
    number of `copies`) with these instead: they are taken once a flame, and requests are never multiplied by nodes.
    """
    own = flame_paths(thread_stacks, ["run_id", "tid"])
    whole = flame_paths(thread_stacks, ["run_id"])
    s = spans.select("run_id", "span_id", "tid")
    if summary is None:
        have = own.select("run_id", "tid").distinct()
        mine = s.join(own, ["run_id", "tid"]).withColumn("tid_unavailable", F.lit(False))
        fallback = s.join(have, ["run_id", "tid"], "left_anti").join(whole, "run_id").withColumn("tid_unavailable", F.lit(True))
        return mine.unionByName(fallback)
    flame = F.struct(*[v.alias(k) for k, v in summary.items()])
    # Requests are dealt by their id, so what the caller sums up by request needs no further shuffle where flames are broadcast.
    one = s.repartition("run_id", "span_id").groupBy("run_id", "span_id", "tid").agg(F.count("*").alias("copies"))
    both = one.join(own.groupBy("run_id", "tid").agg(flame.alias("own")), ["run_id", "tid"], "left").join(
        whole.groupBy("run_id").agg(flame.alias("whole")), "run_id", "left")
    return both.where(c("own").isNotNull() | c("whole").isNotNull()).select(
        "run_id", "span_id", "tid", "copies", F.coalesce("own", "whole").alias("flame"), c("own").isNull().alias("tid_unavailable")).select(
        "run_id", "span_id", "tid", "copies", "flame.*", "tid_unavailable")


def hot_function_findings(stacks: DataFrame, medium: float = HOT_MEDIUM, high: float = HOT_HIGH) -> DataFrame:
    """The top function by self weight, when it is resolved and takes at least `medium` percent of the samples."""
    # The first resolved row is judged; rows before it that are unresolved are passed over.
    first = top_k(all_hotspots(stacks).where(c("function") != "[unknown]"), ["run_id"],
                  [F.desc("self"), F.desc("total"), F.asc("function")], 1)
    severe = F.round(c("self_pct"), 2) >= high
    pct = F.format_string("%.0f", "self_pct")
    return first.where(F.round("self_pct", 2) >= medium).select(
        "run_id", F.lit("hot_function").alias("rule_id"), F.when(severe, "high").otherwise("medium").alias("severity"),
        F.when(severe, 0.6).otherwise(0.45).alias("severity_score"),
        F.concat(F.lit("Hot function: "), c("function"), F.lit(" is "), pct, F.lit("% of the samples")).alias("title"),
        F.concat(c("function"), F.lit(" takes "), pct, F.lit("% of the CPU samples itself")).alias("description"),
        F.lit(1).cast("long").alias("occurrence_count"))


def frames_of(text: Column) -> Column:
    return F.filter(F.split(text, ";"), lambda s: s != "")
