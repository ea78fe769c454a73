"""Run A against run B (D1-D4, D6): every function takes a table of pairs (run_a, run_b) and compares all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series

c = F.col
PAIR = ["run_a", "run_b"]

# What is compared; less is better for each.
MEASURES = ["duration_ms", "peak_cpu_pct", "peak_rss_mb", "peak_open_fds", "peak_threads", "syscall_events", "errors", "findings"]


def run_summary(runs: DataFrame, peaks: DataFrame, totals: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per run with the eight compared measures."""
    n = findings.groupBy("run_id").agg(F.count("*").alias("findings"))
    zero = F.lit(0).cast("long")
    return (runs.select("run_id", "duration_ms").join(peaks, "run_id", "left").join(totals, "run_id", "left")
            .join(n, "run_id", "left").select("run_id", *[
                F.coalesce(c(m), zero).alias(m) if m in ("syscall_events", "errors", "findings") else c(m) for m in MEASURES]))


def _sides(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both runs of each pair, marked A or B. `df` is read once however many pairs a run is in."""
    ends = F.explode(F.array(F.struct(c("run_a").alias("run_id"), F.lit("A").alias("side")),
                             F.struct(c("run_b").alias("run_id"), F.lit("B").alias("side")))).alias("e")
    return df.join(pairs.select(*PAIR, ends).select(*PAIR, "e.*"), "run_id").drop("run_id")


def _of(side: str, value: str) -> Column:
    return F.max(F.when(c("side") == side, c(value)))


def overview_delta(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and measure - both values, difference, percent of |A|, and whether B improved."""
    long = summary.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), c(m).cast("double").alias("v")) for m in MEASURES])).alias("m")).select("run_id", "m.*")
    both = _sides(long, pairs).groupBy(*PAIR, "measure").agg(_of("A", "v").alias("a"), _of("B", "v").alias("b"))
    delta = c("b") - c("a")
    return both.select(*PAIR, "measure", "a", "b", delta.alias("delta"),
                       F.when(c("a") != 0, delta / F.abs("a") * 100).alias("pct"),
                       F.when(delta != 0, delta < 0).alias("improved"))


def series_overlay(metrics: DataFrame, pairs: DataFrame, col: str) -> DataFrame:
    """Both runs' samples on one clock that starts with each run's first sample."""
    e = series.elapsed(metrics).where(c(col).isNotNull()).select("run_id", "elapsed_us", c(col).alias("v"))
    return _sides(e, pairs).select(*PAIR, "side", "elapsed_us", "v")


def peak_delta(metrics: DataFrame, pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Peak of each series in A and B and their difference; one aggregation per run, then the pairs."""
    p = metrics.groupBy("run_id").agg(*[F.max(k).cast("double").alias(k) for k in cols])
    long = p.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c(k).alias("v")) for k in cols])).alias("m"))
    both = _sides(long.select("run_id", "m.*"), pairs).groupBy(*PAIR, "measure").agg(
        _of("A", "v").alias("peak_a"), _of("B", "v").alias("peak_b"))
    return both.withColumn("delta", c("peak_b") - c("peak_a"))


def call_delta(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts and averages per call; a call missing on one side counts 0 there."""
    g = _sides(stats.select("run_id", "syscall", "count", "avg_ms"), pairs).groupBy(*PAIR, "syscall").agg(
        _of("A", "count").alias("na"), _of("B", "count").alias("nb"), _of("A", "avg_ms").alias("avg_a"), _of("B", "avg_ms").alias("avg_b"))
    zero = F.lit(0).cast("long")
    ca, cb = F.coalesce("na", zero), F.coalesce("nb", zero)
    return g.select(*PAIR, "syscall", ca.alias("count_a"), cb.alias("count_b"), (cb - ca).alias("delta"), "avg_a", "avg_b")


def by_change(delta: DataFrame) -> DataFrame:
    return delta.orderBy(*PAIR, F.desc(F.abs("delta")), "syscall")


def finding_delta(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """A's findings that B lacks, those of A that B has too, and B's that A lacks."""
    rows = _sides(findings.select("run_id", "rule_id", "severity", "title"), pairs)
    same = Window.partitionBy(*PAIR, "rule_id")  # the findings one rule has in two runs: a handful of rows
    in_a = F.max(c("side") == "A").over(same)
    in_b = F.max(c("side") == "B").over(same)
    where = (F.when((c("side") == "A") & ~c("in_b"), "only_a").when(c("side") == "A", "both").when(~c("in_a"), "only_b"))
    return rows.withColumns({"in_a": in_a, "in_b": in_b}).withColumn("where", where).where(c("where").isNotNull()).drop(
        "side", "in_a", "in_b")


def diff_digest(overview: DataFrame, findings: DataFrame) -> DataFrame:
    """The comparison as text - key differences, findings gained and lost."""
    shown = ["duration_ms", "peak_rss_mb", "peak_cpu_pct", "syscall_events", "errors"]
    line = F.concat(c("measure"), F.lit(": A="), F.coalesce(c("a").cast("string"), F.lit("none")), F.lit(" B="),
                    F.coalesce(c("b").cast("string"), F.lit("none")),
                    F.coalesce(F.concat(F.lit(" (change "), c("delta").cast("string"), F.lit(")")), F.lit("")))
    pos = F.array_position(F.array(*[F.lit(s) for s in shown]), c("measure"))
    deltas = overview.where(c("measure").isin(shown)).groupBy(*PAIR).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), line.alias("t")))), lambda s: s["t"]), "\n")
        .alias("deltas"))

    def listed(side: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(c("where") == side, c("title")))), "; ")

    # Findings per pair are at most the rules of two runs.
    changes = findings.groupBy(*PAIR).agg(listed("only_b").alias("gained"), listed("only_a").alias("lost"))
    none = F.lit("none")
    return deltas.join(changes, PAIR, "left").select(*PAIR, F.concat_ws(
        "\n", "deltas", F.concat(F.lit("findings gained in B: "), F.coalesce(F.nullif("gained", F.lit("")), none)),
        F.concat(F.lit("findings gone in B: "), F.coalesce(F.nullif("lost", F.lit("")), none))).alias("digest"))
