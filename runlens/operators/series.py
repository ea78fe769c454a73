"""Metric samples: series, trends, streaks, thinning, roll-ups of process counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantile import at_ranks
from ..plans.scan import TIME_BLOCK_US, last_known, last_known_incl, ordered_scan, prev, row_index, running, width_block
from ..plans.topk import top_k

c = F.col
RUN, TIME = ["run_id"], ["ts_us"]

# Trend gating.
TREND_TAIL, TREND_MAX_MS = 360, 600_000


def time_block() -> Column:
    return width_block("ts_us", TIME_BLOCK_US)


def series(metrics: DataFrame, col: str) -> DataFrame:
    """(run_id, ts_us, v) of the samples that measured `col`."""
    return metrics.where(c(col).isNotNull()).select("run_id", "ts_us", c(col).cast("double").alias("v"))


def ring(metrics: DataFrame, n: int) -> DataFrame:
    """The newest n samples of each run."""
    return top_k(metrics, RUN, [F.desc("ts_us")], n, salt_on=TIME)


def trend_series(metrics: DataFrame, col: str, runs: DataFrame, tail: int = TREND_TAIL,
                 max_ms: int = TREND_MAX_MS) -> DataFrame:
    """The whole series of a short run, the newest `tail` points of a run longer than `max_ms`."""
    s = series(metrics, col)
    long_runs = runs.where(c("duration_ms") > max_ms).select("run_id")
    return s.join(long_runs, "run_id", "left_anti").unionByName(ring(s.join(long_runs, "run_id", "left_semi"), tail))


def trend(s: DataFrame, tolerance: float, block: Column | None = None) -> DataFrame:
    """W3 / W4 base: first, last, peak, and how often the value fell by more than `tolerance`."""
    stepped = ordered_scan(s, RUN, TIME, block if block is not None else time_block(), before=prev("v"))
    return stepped.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min_by("v", "ts_us").alias("first"), F.max_by("v", "ts_us").alias("last"),
        F.max("v").alias("peak"), F.min("v").alias("low"), F.count_if(c("v") < c("before.v") - tolerance).alias("decreases"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def steps_over(s: DataFrame, threshold: float, block: Column | None = None) -> DataFrame:
    """Consecutive rises above `threshold`."""
    stepped = ordered_scan(s, RUN, TIME, block if block is not None else time_block(), before=prev("v"))
    return stepped.withColumn("step", c("v") - c("before.v")).where(c("step") > threshold).select("run_id", "ts_us", "step")


def streaks(samples: DataFrame, hit: Column, block: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Maximal runs of consecutive samples on which `hit` holds: one row per streak (W5, W6 base)."""
    keys = keys or RUN
    block = block if block is not None else time_block()
    flagged = samples.select(*keys, "ts_us", F.coalesce(hit, F.lit(False)).alias("hit"))
    numbered = ordered_scan(flagged, keys, TIME, block, misses=running(F.when(c("hit"), 0).otherwise(1).cast("long")))
    return numbered.where("hit").groupBy(*keys, "misses").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")).drop("misses")


def longest_streak(samples: DataFrame, hit: Column, block: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """The streak that spans the most time; the later of equals."""
    keys = keys or RUN
    s = streaks(samples, hit, block, keys)
    best = F.max(F.struct((c("last_us") - c("first_us")).alias("span_us"), "last_us", "first_us", "n")).alias("b")
    return s.groupBy(*keys).agg(best).select(*keys, "b.first_us", "b.last_us", "b.span_us", "b.n")


def alerts_with_rearm(samples: DataFrame, active: Column, quiet: int = 8, block: Column | None = None,
                      need: int = 1) -> DataFrame:
    """W6 + W7: fire when `active` has held for exactly `need` samples, then stay silent until `quiet` misses in a row.

    Quiet gaps of `quiet` or more samples cut the samples into phases; only the first firing of a phase is an alert.
    """
    block = block if block is not None else time_block()
    flagged = samples.select("run_id", "ts_us", F.coalesce(active, F.lit(False)).alias("on"))
    if need == 1:
        # The misses between two hits are consecutive, so their number alone says whether the latch opened in between.
        counted = ordered_scan(flagged, RUN, TIME, block, misses=running(F.when(c("on"), 0).otherwise(1).cast("long")))
        seen = ordered_scan(counted, RUN, TIME, block, shared=True, before=last_known(F.when(c("on"), c("misses"))))
        return seen.where(c("on") & (c("before").isNull() | (c("misses") - c("before") >= quiet))).select("run_id", "ts_us")
    # Position in the current hot or quiet streak: the run's row number minus that of the streak's start.
    pos = ordered_scan(flagged, RUN, TIME, block, rn=running(F.lit(1).cast("long")),
                       before=prev("on"))
    start = F.when(c("before.on").isNull() | (c("before.on") != c("on")), c("rn"))
    placed = ordered_scan(pos.select("run_id", "ts_us", "on", "rn", start.alias("start")), RUN, TIME, block,
                          from_rn=last_known_incl(c("start")))
    at = c("rn") - c("from_rn") + 1
    # The latch opens once per `quiet` misses, so only the first opening of a quiet streak matters.
    marked = placed.select("run_id", "ts_us", (c("on") & (at == need)).alias("fires"),
                           F.when(~c("on") & (at == quiet), 1).otherwise(0).cast("long").alias("opens"))
    phased = ordered_scan(marked, RUN, TIME, block, phase=running(c("opens")))
    return phased.where("fires").groupBy("run_id", "phase").agg(F.min("ts_us").alias("ts_us")).select("run_id", "ts_us")


def slow_growth(s: DataFrame, tolerance: float = 0.5, block: Column | None = None) -> DataFrame:
    """Opening-tenth floor and median, closing-tenth median, growth, growth per minute, share of non-falling steps.

    Values are compared as integers of a thousandth so that order statistics are exact.
    """
    block = block if block is not None else time_block()
    n = s.groupBy("run_id").agg(F.count("*").alias("n"))
    idx = row_index(s, RUN, TIME, block).join(n, "run_id")
    tenth = F.greatest(F.lit(2), F.floor(c("n") / 10))
    part = F.when(c("idx") < tenth, "head")
    tail = F.when(c("idx") >= c("n") - tenth, "tail")
    ends = (idx.select("run_id", F.explode(F.array_compact(F.array(part, tail))).alias("part"),
                       F.round(c("v") * 1000).cast("long").alias("milli")))
    med = at_ranks(ends, ["run_id", "part"], "milli", {"floor": F.lit(0).cast("long"),
                                                      "median": F.floor(F.col("__total") / 2).cast("long")})
    both = med.groupBy("run_id").agg(
        F.max(F.when(c("part") == "head", c("floor"))).alias("head_min"),
        F.max(F.when(c("part") == "head", c("median"))).alias("head_med"),
        F.max(F.when(c("part") == "tail", c("median"))).alias("tail_med"))
    steps = ordered_scan(s, RUN, TIME, block, before=prev("v")).groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(c("v") >= c("before.v") - tolerance).alias("non_falling"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    base = F.least("head_min", "head_med") / 1000.0
    minutes = (c("last_us") - c("first_us")) / 60_000_000.0
    growth = c("tail_med") / 1000.0 - base
    return steps.join(both, "run_id").select(
        "run_id", "n", "first_us", "last_us", base.alias("baseline"), (c("tail_med") / 1000.0).alias("current"),
        growth.alias("growth"), F.try_divide(growth, minutes).alias("per_minute"),
        (c("non_falling") / c("n")).alias("non_falling_share"))


def elapsed(metrics: DataFrame) -> DataFrame:
    """Samples with their time since the run's first sample."""
    first = metrics.groupBy("run_id").agg(F.min("ts_us").alias("t0"))
    return metrics.join(first, "run_id").withColumn("elapsed_us", c("ts_us") - c("t0")).drop("t0")


def stride(metrics: DataFrame, max_points: int, block: Column | None = None) -> DataFrame:
    """Every ceil(n / max)-th sample of each run, real rows only."""
    n = metrics.groupBy("run_id").agg(F.ceil(F.count("*") / max_points).alias("step"))
    idx = row_index(metrics, RUN, TIME, block if block is not None else time_block())
    return idx.join(n, "run_id").where(c("idx") % c("step") == 0).drop("idx", "step")


def decimate(s: DataFrame, budget: int, block: Column | None = None) -> DataFrame:
    """The first lowest and first highest point of each of budget/2 buckets; series within budget stay whole."""
    n = s.groupBy("run_id").agg(F.count("*").alias("n"))
    idx = row_index(s, RUN, TIME, block if block is not None else time_block()).join(n, "run_id")
    buckets = max(1, budget // 2)
    # Bucket b covers floor(b*n/buckets) <= i < floor((b+1)*n/buckets).
    bucket = F.floor(((c("idx") + 1) * buckets - 1) / c("n")).cast("long")
    whole = idx.where(c("n") <= budget).select("run_id", "ts_us", "v")
    ends = idx.where(c("n") > budget).groupBy("run_id", bucket.alias("bucket")).agg(
        F.min(F.struct("v", "ts_us")).alias("lo"), F.min(F.struct((-c("v")).alias("v"), "ts_us")).alias("hi"))
    lo = F.struct(c("lo.ts_us").alias("ts_us"), c("lo.v").alias("v"))
    hi = F.struct(c("hi.ts_us").alias("ts_us"), (-c("hi.v")).alias("v"))
    points = ends.select("run_id", F.explode(F.array_distinct(F.array(lo, hi))).alias("p")).select("run_id", "p.*")
    return whole.unionByName(points)


def keep_peaks(rows: DataFrame, keys: list[str], points: int = 30) -> DataFrame:
    """Thin each context window by a stride, always keeping the last row and the (last) cpu, rss and fd peaks.

    A window is a few hundred samples around one incident, so it is one small group.
    """
    n = Window.partitionBy(*keys)
    asc = n.orderBy("ts_us")
    size, i = F.count("*").over(n), F.row_number().over(asc) - 1
    idx = rows.withColumns({"__n": size, "__i": i})
    peaks = {f"__p_{m}": F.max(F.when(c(m).isNotNull(), F.struct(m, "__i"))).over(n) for m in ("cpu_pct", "rss_mb", "open_fds")}
    step = F.greatest(F.lit(1), F.floor(c("__n") / points))
    keep = (c("__i") % step == 0) | (c("__i") == c("__n") - 1)
    for p in peaks:
        keep = keep | F.coalesce(c("__i") == c(p)["__i"], F.lit(False))
    return idx.withColumns(peaks).where(keep).drop("__n", "__i", *peaks)


def time_domain(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Earliest and latest moment per run over several tables, each given as (table, start column, end column)."""
    parts = [t.groupBy("run_id").agg(F.min(a).alias("lo"), F.max(b).alias("hi")) for t, a, b in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("run_id").agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"))


def peaks(metrics: DataFrame) -> DataFrame:
    """Peaks and means per run; unmeasured samples do not count."""
    return metrics.groupBy("run_id").agg(
        F.count("*").alias("samples"), *[F.max(m).alias(f"peak_{m}") for m in ("rss_mb", "vms_mb", "cpu_pct", "open_fds", "threads")
                                         if m in metrics.columns],
        F.avg("cpu_pct").alias("avg_cpu_pct"), F.avg("rss_mb").alias("avg_rss_mb"))


def trajectory(metrics: DataFrame) -> DataFrame:
    """First, last, peak and trend label of memory; mean and peak CPU; descriptor range."""
    def at(f, m: str) -> Column:
        return f(m, F.when(c(m).isNotNull(), c("ts_us")))

    t = metrics.groupBy("run_id").agg(
        at(F.min_by, "rss_mb").alias("rss_first"), at(F.max_by, "rss_mb").alias("rss_last"), F.max("rss_mb").alias("rss_peak"),
        F.avg("cpu_pct").alias("cpu_avg"), F.max("cpu_pct").alias("cpu_peak"),
        at(F.min_by, "open_fds").alias("fds_first"), at(F.max_by, "open_fds").alias("fds_last"),
        F.max("open_fds").alias("fds_peak"), F.min("open_fds").alias("fds_low"))
    label = (F.when(c("rss_last") > c("rss_first") * 1.2 + 1, "rising").when(c("rss_last") < c("rss_first") * 0.8, "falling")
             .when(c("rss_last").isNotNull(), "steady"))
    return t.withColumn("rss_trend", label)


def tree_samples(proc: DataFrame) -> DataFrame:
    """Per tick the sum over the live processes of a run; null where none was measured."""
    mb = 1024.0 * 1024.0
    return proc.groupBy("run_id", "ts_us").agg(
        F.sum("cpu_pct").alias("cpu_pct"), (F.sum("rss_bytes") / mb).alias("rss_mb"), (F.sum("vms_bytes") / mb).alias("vms_mb"),
        F.sum("fds").cast("int").alias("open_fds"), F.sum("threads").cast("int").alias("threads"))


def io_rate(proc: DataFrame, block: Column | None = None) -> DataFrame:
    """Bytes per second of a whole tree, from the sum of every process's last counters; one that ended keeps its last.

    Per process the plain step from its counter before is what the tree gains at that tick. A counter that falls, as when a
    process id is used again, lowers that tick's sum; a tree's rate is never below 0, and the next step starts from the fallen value.
    """
    block = block if block is not None else time_block()
    rows = proc.where(c("read_bytes").isNotNull() & c("write_bytes").isNotNull()).select(
        "run_id", "pid", "ts_us", "read_bytes", "write_bytes")
    seen = ordered_scan(rows, ["run_id", "pid"], TIME, block, before=prev("read_bytes", "write_bytes"))
    zero = F.lit(0).cast("long")
    gain = [(c(m) - F.coalesce(c(f"before.{m}"), zero)).alias(m) for m in ("read_bytes", "write_bytes")]
    gained = seen.select("run_id", "ts_us", *gain)
    ticks = proc.select("run_id", "ts_us", zero.alias("read_bytes"), zero.alias("write_bytes"))
    tick = gained.unionByName(ticks).groupBy("run_id", "ts_us").agg(
        F.sum("read_bytes").alias("r"), F.sum("write_bytes").alias("w"))
    paced = ordered_scan(tick, RUN, TIME, block, before=prev("ts_us"))
    dt = (c("ts_us") - c("before.ts_us")) / 1_000_000.0
    return paced.select("run_id", "ts_us", *[F.when(dt > 0, F.greatest(F.lit(0.0), c(k) / dt)).alias(f"io_{n}_bps")
                                             for k, n in (("r", "read"), ("w", "write"))])


def exhausted_runs(ticks: DataFrame, empties: int = 12, block: Column | None = None) -> DataFrame:
    """T8 batch twin: the moment a run that was alive had `empties` consecutive ticks without any process."""
    alive_first = ticks.where(c("rss_mb").isNotNull()).groupBy("run_id").agg(F.min("ts_us").alias("born"))
    late = ticks.join(alive_first, "run_id").where(c("ts_us") >= c("born"))
    block = block if block is not None else time_block()
    flagged = late.select("run_id", "ts_us", c("rss_mb").isNull().alias("gone"))
    pos = ordered_scan(flagged, RUN, TIME, block, rn=running(F.lit(1).cast("long")))
    last_alive = ordered_scan(pos, RUN, TIME, block, at=last_known_incl(F.when(~c("gone"), c("rn"))))
    return last_alive.where(c("rn") - c("at") == empties).groupBy("run_id").agg(F.min("ts_us").alias("ended_us"))

