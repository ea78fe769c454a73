"""Metric samples: trends, streaks, thinning, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..operators import series as ops
from . import register

c = F.col


def _m(spark, d):
    return view(spark, d, "metrics")


@register("metric_peaks", with_views("metrics", sql="""
SELECT run_id, count(*) AS samples, max(rss_mb) AS peak_rss_mb, max(cpu_pct) AS peak_cpu_pct, max(open_fds) AS peak_open_fds,
 max(threads) AS peak_threads, round(avg(cpu_pct), 6) AS avg_cpu_pct, round(avg(rss_mb), 6) AS avg_rss_mb FROM metrics GROUP BY 1"""))
def metric_peaks(spark, d):
    p = ops.peaks(_m(spark, d))
    return p.select("run_id", "samples", "peak_rss_mb", "peak_cpu_pct", "peak_open_fds", "peak_threads",
                    F.round("avg_cpu_pct", 6).alias("avg_cpu_pct"), F.round("avg_rss_mb", 6).alias("avg_rss_mb"))


@register("metric_trend", with_views("metrics", sql="""
, l AS (SELECT *, lag(io_read_bps) OVER (PARTITION BY run_id ORDER BY ts_us) AS pv FROM metrics WHERE io_read_bps IS NOT NULL)
SELECT run_id, count(*) AS n, arg_min(io_read_bps, ts_us) AS first, arg_max(io_read_bps, ts_us) AS last, max(io_read_bps) AS peak,
 count(*) FILTER (WHERE io_read_bps < pv - 0.5) AS decreases FROM l GROUP BY 1"""))
def metric_trend(spark, d):
    t = ops.trend(ops.series(_m(spark, d), "io_read_bps"), 0.5)
    return t.select("run_id", "n", "first", "last", "peak", "decreases")


@register("trailing_series", with_views("metrics", sql="""
, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC) AS back, max(ts_us) OVER (PARTITION BY run_id) -
  min(ts_us) OVER (PARTITION BY run_id) AS span FROM metrics)
SELECT run_id, ts_us, rss_mb AS v FROM n WHERE back <= 360 OR span <= 2500000000000"""))
def trailing_series(spark, d):
    m = _m(spark, d)
    runs = m.groupBy("run_id").agg(((F.max("ts_us") - F.min("ts_us")) / 1000.0).alias("duration_ms"))
    return ops.trend_series(m, "rss_mb", runs, max_ms=2_500_000_000)


@register("memory_steps", with_views("metrics", sql="""
, l AS (SELECT run_id, ts_us, rss_mb - lag(rss_mb) OVER (PARTITION BY run_id ORDER BY ts_us) AS step FROM metrics)
SELECT run_id, ts_us, step FROM l WHERE step > 0.5"""))
def memory_steps(spark, d):
    return ops.steps_over(ops.series(_m(spark, d), "rss_mb"), 0.5)


STREAK = """
, g AS (SELECT run_id, ts_us, cpu_pct > 30 AS hit, sum(CASE WHEN cpu_pct > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ts_us) AS isl FROM metrics),
 s AS (SELECT run_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM g WHERE hit GROUP BY run_id, isl)
"""


@register("metric_streaks", with_views("metrics", sql=STREAK + "SELECT * FROM s"))
def metric_streaks(spark, d):
    return ops.streaks(_m(spark, d), c("cpu_pct") > 30)


@register("longest_streak", with_views("metrics", sql=STREAK + """
, b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY last_us - first_us DESC, last_us DESC) AS rn FROM s)
SELECT run_id, first_us, last_us, last_us - first_us AS span_us, n FROM b WHERE rn = 1"""))
def longest_streak(spark, d):
    return ops.longest_streak(_m(spark, d), c("cpu_pct") > 30)


@register("rearming_alerts", with_views("metrics", sql="""
, a AS (SELECT run_id, ts_us, open_fds > 95 AS on_, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) AS rn FROM metrics),
 h AS (SELECT *, lag(rn) OVER (PARTITION BY run_id ORDER BY ts_us) AS prev_on FROM a WHERE on_)
SELECT run_id, ts_us FROM h WHERE prev_on IS NULL OR rn - prev_on - 1 >= 8"""))
def rearming_alerts(spark, d):
    return ops.alerts_with_rearm(_m(spark, d), c("open_fds") > 95)


@register("elapsed_series", with_views("metrics", sql="""
SELECT run_id, ts_us, rss_mb, ts_us - min(ts_us) OVER (PARTITION BY run_id) AS elapsed_us FROM metrics"""))
def elapsed_series(spark, d):
    return ops.elapsed(_m(spark, d)).select("run_id", "ts_us", "rss_mb", "elapsed_us")


@register("stride_series", with_views("metrics", sql="""
, n AS (SELECT run_id, ts_us, cpu_pct, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM metrics)
SELECT run_id, ts_us, cpu_pct FROM n WHERE i % CAST(ceil(n / 150.0) AS BIGINT) = 0"""))
def stride_series(spark, d):
    return ops.stride(_m(spark, d), 150).select("run_id", "ts_us", "cpu_pct")


@register("decimated_series", with_views("metrics", sql="""
, n AS (SELECT run_id, ts_us, cpu_pct AS v, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM metrics),
 b AS (SELECT *, (SELECT max(k) FROM range(100) t(k) WHERE floor(k * n / 100.0) <= i) AS b FROM n),
 p AS (SELECT run_id, b, arg_min(ts_us, (v, ts_us)) AS lo, arg_min(ts_us, (-v, ts_us)) AS hi FROM b GROUP BY 1, 2)
SELECT DISTINCT n.run_id, n.ts_us, n.v FROM n JOIN p ON p.run_id = n.run_id AND n.ts_us IN (p.lo, p.hi) WHERE n.n > 200
UNION ALL SELECT run_id, ts_us, v FROM n WHERE n <= 200"""))
def decimated_series(spark, d):
    return ops.decimate(ops.series(_m(spark, d), "cpu_pct"), 200)


@register("metric_trajectory", with_views("metrics", sql="""
SELECT run_id, arg_min(rss_mb, ts_us) AS rss_first, arg_max(rss_mb, ts_us) AS rss_last, max(rss_mb) AS rss_peak, max(cpu_pct) AS cpu_peak,
 arg_min(open_fds, ts_us) AS fds_first, arg_max(open_fds, ts_us) AS fds_last, max(open_fds) AS fds_peak,
 CASE WHEN arg_max(rss_mb, ts_us) > arg_min(rss_mb, ts_us) * 1.2 + 1 THEN 'rising' WHEN arg_max(rss_mb, ts_us) < arg_min(rss_mb, ts_us) * 0.8 THEN 'falling'
 ELSE 'steady' END AS rss_trend FROM metrics GROUP BY 1"""))
def metric_trajectory(spark, d):
    return ops.trajectory(_m(spark, d)).select("run_id", "rss_first", "rss_last", "rss_peak", "cpu_peak", "fds_first",
                                               "fds_last", "fds_peak", "rss_trend")


@register("metric_ring", with_views("metrics", sql="""
, n AS (SELECT run_id, ts_us, cpu_pct, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC) AS back FROM metrics)
SELECT run_id, ts_us, cpu_pct FROM n WHERE back <= 1500"""))
def metric_ring(spark, d):
    return ops.ring(_m(spark, d), 1500).select("run_id", "ts_us", "cpu_pct")


def _proc(spark, d):
    """Per-process counters at hourly ticks: the events of one user in one hour, counters summed over time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    us = F.unix_micros(c("ts").cast("timestamp"))
    tick = (F.floor(us / 3_600_000_000) * 3_600_000_000).cast("long")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return e.groupBy(F.concat(F.lit("run-"), (c("user_id") % 5).cast("string")).alias("run_id"), tick.alias("ts_us"),
                     c("user_id").alias("pid")).agg(
        F.count("*").cast("double").alias("cpu_pct"), F.sum(k * 1048576).alias("rss_bytes"), F.sum(k * 2097152).alias("vms_bytes"),
        F.sum(k).cast("int").alias("threads"), F.max(k).cast("int").alias("fds"),
        (F.max("event_id") * 1000).alias("read_bytes"), F.max("event_id").alias("write_bytes"))


PROC = """WITH proc AS (SELECT 'run-' || CAST(user_id % 5 AS VARCHAR) AS run_id, CAST(epoch_us(ts) // 3600000000 * 3600000000 AS BIGINT) AS ts_us, user_id AS pid,
 CAST(count(*) AS DOUBLE) AS cpu_pct, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 1048576) AS BIGINT) AS rss,
 CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS INT) AS threads, max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS fds,
 max(event_id) * 1000 AS rb, max(event_id) AS wb FROM events GROUP BY 1, 2, 3)
"""


@register("tree_samples", PROC + """SELECT run_id, ts_us, sum(cpu_pct) AS cpu_pct, CAST(sum(rss) AS BIGINT) / 1048576.0 AS rss_mb, CAST(sum(threads) AS INT) AS threads,
 CAST(sum(fds) AS INT) AS open_fds FROM proc GROUP BY 1, 2""")
def tree_samples(spark, d):
    return ops.tree_samples(_proc(spark, d)).select("run_id", "ts_us", "cpu_pct", "rss_mb", "threads", "open_fds")


@register("tree_io_rate", PROC + """
, g AS (SELECT run_id, ts_us, rb - coalesce(lag(rb) OVER w, 0) AS r, wb - coalesce(lag(wb) OVER w, 0) AS w FROM proc WINDOW w AS (PARTITION BY run_id, pid ORDER BY ts_us)),
 t AS (SELECT run_id, ts_us, CAST(sum(r) AS BIGINT) AS r, CAST(sum(w) AS BIGINT) AS w FROM g GROUP BY 1, 2)
, p AS (SELECT *, lag(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us) AS t0 FROM t)
SELECT run_id, ts_us, CASE WHEN t0 IS NOT NULL THEN greatest(0.0::DOUBLE, r / ((ts_us - t0) / 1000000.0)) END AS io_read_bps,
 CASE WHEN t0 IS NOT NULL THEN greatest(0.0::DOUBLE, w / ((ts_us - t0) / 1000000.0)) END AS io_write_bps FROM p""")
def tree_io_rate(spark, d):
    return ops.io_rate(_proc(spark, d))
