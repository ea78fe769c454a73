"""Live alerts and incidents, in batch form: what the stateful streams compute, over a finished table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import live_rank, severity_name, severity_rank
from ..plans.intervals import contain_join
from ..plans.topk import top_k
from . import series

c = F.col
CONTEXT_US = 30_000_000
WINDOW_BASE_BITS = 24  # 2**24 us, 17 s: context windows are a minute long: about four bins each


@dataclass(frozen=True)
class LiveLimits:
    """The live thresholds. A fired alert re-arms after `rearm` quiet samples in a row."""

    fds: int = 200
    rss_step_mb: float = 100.0
    cpu_pct: float = 90.0
    cpu_streak: int = 8
    rearm: int = 8
    publish_every_us: int = 10_000_000


def alerts(metrics: DataFrame, lim: LiveLimits = LiveLimits(), block: Column | None = None) -> DataFrame:
    """Descriptor, memory and CPU alerts of every run, with hysteresis."""
    fd = series.alerts_with_rearm(metrics.where(c("open_fds").isNotNull()), c("open_fds") > lim.fds, lim.rearm, block)
    cpu = series.alerts_with_rearm(metrics.where(c("cpu_pct").isNotNull()), c("cpu_pct") > lim.cpu_pct, lim.rearm, block,
                                   need=lim.cpu_streak)
    mem = series.steps_over(series.series(metrics, "rss_mb"), lim.rss_step_mb, block).select("run_id", "ts_us")

    def tag(df: DataFrame, rule: str, severity: str, title: str) -> DataFrame:
        return df.select("run_id", "ts_us", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"))

    return (tag(fd, "fd_leak_live", "high", "Too many open descriptors")
            .unionByName(tag(mem, "mem_spike", "medium", "Memory jumped"))
            .unionByName(tag(cpu, "cpu_hot_live", "medium", "CPU pegged")))


def collapse(alert_rows: DataFrame) -> DataFrame:
    """T4: one incident per run and rule - count, first and last time, the first alert's severity and title."""
    first = F.min_by(F.struct("severity", "title"), "ts_us").alias("f")
    g = alert_rows.groupBy("run_id", "rule_id").agg(F.count("*").alias("count"), F.min("ts_us").alias("first_us"),
                                                    F.max("ts_us").alias("last_us"), first)
    return g.select(F.concat_ws(":", "run_id", "rule_id").alias("incident_id"), "run_id", "rule_id", "f.severity", "f.title",
                    c("first_us").alias("ts_us"), "first_us", "last_us", "count")


def context(incidents: DataFrame, metrics: DataFrame, around_us: int = CONTEXT_US) -> DataFrame:
    """Each incident's samples within `around_us` of its time."""
    w = incidents.select("run_id", "incident_id", (c("ts_us") - around_us).alias("w_start"), F.lit(2 * around_us).cast("long").alias("w_len"))
    return contain_join(metrics, "ts_us", w, "w_start", "w_len", ["run_id"], base_bits=WINDOW_BASE_BITS).drop("w_start", "w_len")


def context_peaks(ctx: DataFrame) -> DataFrame:
    """Peaks and sample count of each incident's context."""
    return ctx.groupBy("run_id", "incident_id").agg(
        F.count("*").alias("samples"), *[F.max(m).alias(f"peak_{m}") for m in ("cpu_pct", "rss_mb", "open_fds")])


def with_context(incidents: DataFrame, metrics: DataFrame, points: int = 30) -> DataFrame:
    """Incidents with their thinned context embedded (W14); a context is at most a minute of samples."""
    thin = series.keep_peaks(context(incidents, metrics), ["run_id", "incident_id"], points)
    cols = [n for n in thin.columns if n not in ("run_id", "incident_id")]
    packed = thin.groupBy("run_id", "incident_id").agg(
        F.array_sort(F.collect_list(F.struct("ts_us", *[n for n in cols if n != "ts_us"]))).alias("metrics"))
    return incidents.join(packed, ["run_id", "incident_id"], "left")


def to_findings(incidents: DataFrame) -> DataFrame:
    """A monitored run's findings are its incidents - per rule the most severe, the later one of equals."""
    rank = live_rank(c("severity"))
    has_hot = "hot_stack" in incidents.columns
    stack = c("hot_stack") if has_hot else F.lit(None).cast("array<string>")
    row = F.struct("severity", "title", "count", stack.alias("stack"), rank.alias("rank"))
    best = incidents.groupBy("run_id", "rule_id").agg(F.max_by(row, F.struct(rank.alias("r"), "ts_us")).alias("b"))
    n = c("b.count")
    where = F.when(F.size("b.stack") > 0, F.array_join(F.slice("b.stack", F.greatest(F.lit(1), F.size("b.stack") - 3), 4), " > ")
                   ).otherwise("off the CPU")
    return best.select("run_id", "rule_id", "b.severity", (F.lit(0.4) + F.greatest(c("b.rank"), F.lit(1)) * 0.1).alias("severity_score"),
                       F.concat(c("b.title"), F.when(n > 1, F.concat(F.lit(" (x"), n.cast("string"), F.lit(")"))).otherwise(""))
                       .alias("title"),
                       F.concat(F.lit("Live incident. Where: "), where).alias("description"), n.alias("occurrence_count"))


def compact_legacy(rows: DataFrame) -> DataFrame:
    """Old one-row-per-firing incidents become one row per rule; rows without a rule or with a count stay as they are.

    Expects seq (file order), rule_id, severity, title, ts_us, count and optional detail columns, of which the last
    non-null value is kept.
    """
    detail = [n for n in rows.columns if n not in ("run_id", "rule_id", "seq", "severity", "title", "ts_us", "count", "first_us",
                                                    "last_us", "incident_id")]
    old = (F.coalesce(c("rule_id"), F.lit("")) != "") & c("count").isNull()
    keep = rows.where(~old)
    ids = ["incident_id"] if "incident_id" in rows.columns else []
    g = rows.where(old).groupBy("run_id", "rule_id").agg(
        F.min("seq").alias("seq"), F.count("*").alias("count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        severity_name(F.min(severity_rank(c("severity")))).alias("severity"), F.min_by("title", "seq").alias("title"),
        *[F.min_by(i, "seq").alias(i) for i in ids],
        *[F.max_by(d, F.when(c(d).isNotNull(), c("seq"))).alias(d) for d in detail]).withColumn("ts_us", c("first_us"))
    return keep.unionByName(g, allowMissingColumns=True)


def merge_live(live: DataFrame, stored: DataFrame, keep: int | None = None) -> DataFrame:
    """Live and stored incidents by id, live wins; newest activity first (optionally the newest `keep` per run, K8)."""
    both = live.withColumn("__src", F.lit(0)).unionByName(stored.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    first = both.withColumn("__rn", F.row_number().over(Window.partitionBy("run_id", "incident_id").orderBy("__src"))).where(
        c("__rn") == 1).drop("__rn", "__src")
    out = first.withColumn("activity_us", F.coalesce("last_us", "ts_us"))
    return out if keep is None else top_k(out, ["run_id"], [F.desc("activity_us"), F.asc("incident_id")], keep)


def with_hot(incidents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """T4, back-fill: incidents (run_id, incident_id, first_us, ...) with hot_us, hot_functions, hot_stack and hot_samples of the
    profile snapshot (run_id, ts_us, functions, stack, samples) that stood when the incident began: the latest until then or, for
    one that began before any, the first after it. Without a snapshot in its run they are null.

    A run has few incidents (one for each live rule); they meet its snapshots by time alone, and the one chosen is then fetched."""
    shots = snapshots.groupBy("run_id", "ts_us").agg(F.max(F.struct("functions", "stack", "samples")).alias("hot")).withColumnRenamed("ts_us", "hot_us")
    before = c("hot_us") <= c("first_us")
    met = incidents.select("run_id", "incident_id", "first_us").join(shots.select("run_id", "hot_us"), "run_id")
    chosen = met.groupBy("run_id", "incident_id").agg(
        F.coalesce(F.max(F.when(before, c("hot_us"))), F.min(F.when(~before, c("hot_us")))).alias("hot_us"))
    hot = chosen.join(shots, ["run_id", "hot_us"]).select(
        "run_id", "incident_id", "hot_us", c("hot.functions").alias("hot_functions"), c("hot.stack").alias("hot_stack"), c("hot.samples").alias("hot_samples"))
    return incidents.join(hot, ["run_id", "incident_id"], "left")


def finding_view(incidents: DataFrame) -> DataFrame:
    """Incidents in the shape of findings, for a run that is still live."""
    return incidents.select("run_id", c("incident_id").alias("id"), "rule_id", "severity", "title",
                            F.lit("").alias("description"), c("first_us").alias("first_seen_us"), c("last_us").alias("last_seen_us"),
                            c("count").alias("occurrence_count"))


def digest(incidents: DataFrame, hot: DataFrame, ctx: DataFrame) -> DataFrame:
    """An incident as text - hot path (10), functions (5), the last measured values of its context."""
    last = ctx.groupBy("run_id", "incident_id").agg(F.count("*").alias("samples"), *[
        F.max_by(m, F.when(c(m).isNotNull(), c("ts_us"))).alias(m) for m in ("cpu_pct", "rss_mb", "open_fds", "threads")])

    def shown(col: str) -> Column:
        return F.coalesce(c(col).cast("string"), F.lit("none"))

    j = incidents.join(hot.select("run_id", "functions", "stack"), "run_id", "left").join(last, ["run_id", "incident_id"], "left")
    path = F.coalesce(F.nullif(F.array_join(F.slice("stack", 1, 10), " -> "), F.lit("")), F.lit("none"))
    funcs = F.coalesce(F.nullif(F.array_join(F.slice("functions", 1, 5), ", "), F.lit("")), F.lit("none"))
    return j.select("run_id", "incident_id", F.concat_ws(
        "\n", F.concat(F.lit("finding: "), c("title")), F.concat(F.lit("severity: "), c("severity")),
        F.concat(F.lit("hot path: "), path), F.concat(F.lit("top functions: "), funcs),
        F.concat(F.lit("cpu="), shown("cpu_pct"), F.lit("% rss="), shown("rss_mb"), F.lit("MB fds="), shown("open_fds"),
                 F.lit(" threads="), shown("threads")),
        F.concat(F.lit("samples in context: "), F.coalesce(c("samples"), F.lit(0)).cast("string"))).alias("digest"))


