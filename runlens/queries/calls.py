"""Calls, files, processes and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..operators import calls as ops
from . import register

c = F.col


def ms5(name: str):
    """Quantiles of integer microseconds have at most five decimals in ms: rounding there is exact, never a tie."""
    return F.round(name, 5).alias(name)


@register("syscall_stats", with_views("trace_events", sql="""
, per AS (SELECT run_id, syscall, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL AND error <> '') AS errors,
  CAST(sum(lat_us) AS BIGINT) AS lat, count(lat_us) AS n_lat, quantile_cont(lat_us, 0.5) AS p50,
  quantile_cont(lat_us, 0.95) AS p95, quantile_cont(lat_us, 0.99) AS p99
  FROM trace_events WHERE event_type = 'syscall' AND syscall <> '' GROUP BY 1, 2)
SELECT run_id, syscall, n AS "count", lat / 1000.0 AS total_ms, lat / n_lat / 1000.0 AS avg_ms, round(p50 / 1000.0, 5) AS p50_ms,
  round(p95 / 1000.0, 5) AS p95_ms, round(p99 / 1000.0, 5) AS p99_ms, errors,
  lat / CAST(sum(lat) OVER (PARTITION BY run_id) AS BIGINT) * 100.0 AS pct_runtime FROM per"""))
def syscall_stats(spark, d):
    out = ops.call_stats(view(spark, d, "trace_events"))
    return out.select("run_id", "syscall", "count", "total_ms", "avg_ms", ms5("p50_ms"), ms5("p95_ms"), ms5("p99_ms"),
                      "errors", "pct_runtime")


IO_CTES = """
, r AS (SELECT run_id, pid, seq, syscall, TRY_CAST(retval AS BIGINT) AS ret, path,
   CASE WHEN syscall = 'openat' THEN TRY_CAST(retval AS BIGINT) ELSE fd END AS fd FROM trace_events
   WHERE event_type = 'syscall' AND error IS NULL AND syscall IN ('openat', 'close', 'read', 'write')),
 k AS (SELECT * FROM r WHERE fd IS NOT NULL AND (syscall = 'close' OR ret >= 0)),
 h AS (SELECT *, last_value(CASE WHEN syscall = 'openat' THEN path WHEN syscall = 'close' THEN '' END IGNORE NULLS) OVER (
   PARTITION BY run_id, pid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM k),
 u AS (SELECT run_id, CASE WHEN syscall = 'openat' THEN path ELSE nullif(held, '') END AS path, syscall, ret, 0 AS leak FROM h),
 z AS (SELECT run_id, pid, fd, arg_max(CASE WHEN syscall = 'openat' THEN path ELSE '' END, seq) AS path FROM k
   WHERE syscall IN ('openat', 'close') GROUP BY 1, 2, 3),
 io AS (SELECT run_id, path, count(*) FILTER (WHERE syscall = 'openat') AS opens, count(*) FILTER (WHERE syscall = 'close') AS closes,
  count(*) FILTER (WHERE syscall = 'read') AS reads, count(*) FILTER (WHERE syscall = 'write') AS writes,
  CAST(sum(CASE WHEN syscall = 'read' THEN ret ELSE 0 END) AS BIGINT) AS read_bytes,
  CAST(sum(CASE WHEN syscall = 'write' THEN ret ELSE 0 END) AS BIGINT) AS write_bytes, CAST(sum(leak) AS BIGINT) AS leaked
 FROM (SELECT * FROM u WHERE path IS NOT NULL UNION ALL SELECT run_id, path, 'end', 0, 1 FROM z WHERE path <> '') GROUP BY 1, 2)
"""


@register("io_stats", with_views("trace_events", sql=IO_CTES + "SELECT * FROM io"))
def io_stats(spark, d):
    return ops.file_io(view(spark, d, "trace_events"))


@register("io_rollup", with_views("trace_events", sql=IO_CTES + """
SELECT run_id, path, opens + reads + writes AS accesses, count(*) OVER (PARTITION BY run_id) AS files,
 count(*) FILTER (WHERE leaked > 0) OVER (PARTITION BY run_id) AS leaky_files,
 (opens + reads + writes) / greatest(max(opens + reads + writes) OVER (PARTITION BY run_id), 1) AS share_of_top FROM io"""))
def io_rollup(spark, d):
    return ops.file_io_summary(ops.file_io(view(spark, d, "trace_events")))


@register("process_stats", with_views("trace_events", sql="""
, own AS (SELECT run_id, pid, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) FILTER (WHERE event_type = 'syscall') AS syscalls,
   arg_max(path, seq) FILTER (WHERE syscall IN ('execve', 'execveat')) AS command, bool_or(event_type = 'exit') AS exited
   FROM trace_events GROUP BY 1, 2),
 kid AS (SELECT run_id, CAST(retval AS BIGINT) AS pid, arg_max(pid, seq) AS parent_pid FROM trace_events
   WHERE syscall = 'clone' AND TRY_CAST(retval AS BIGINT) > 0 GROUP BY 1, 2)
SELECT coalesce(own.run_id, kid.run_id) AS run_id, coalesce(own.pid, kid.pid) AS pid, parent_pid, command, coalesce(syscalls, 0) AS syscalls,
 first_us, last_us, coalesce(exited, false) AS exited, (last_us - first_us) / 1000.0 AS duration_ms,
 coalesce(last_us - first_us <= 250000, false) AS ephemeral
FROM own FULL OUTER JOIN kid ON own.run_id = kid.run_id AND own.pid = kid.pid"""))
def process_stats(spark, d):
    return ops.process_table(view(spark, d, "trace_events"))


NET_CTES = """
, r AS (SELECT *, lead(syscall) OVER w AS nx, lead(lat_us) OVER w AS nlat, lead(retval) OVER w AS nret FROM trace_events
   WHERE syscall IN ('connect', 'poll') WINDOW w AS (PARTITION BY run_id, pid ORDER BY seq)),
 net AS (SELECT run_id, seq, pid, regexp_extract(args, 'sa_family=(AF_[A-Z]+)', 1) AS family,
   regexp_extract(args, 'inet_addr\\("([^"]+)"', 1) AS address, CAST(regexp_extract(args, 'htons\\(([0-9]+)\\)', 1) AS INT) AS port,
   CASE WHEN error = 'EINPROGRESS' THEN CASE WHEN nx = 'poll' THEN CASE WHEN CAST(nret AS BIGINT) = 0 THEN 'timed out' ELSE 'ok' END
     ELSE 'connecting' END ELSE coalesce(error, 'ok') END AS result,
   (lat_us + CASE WHEN error = 'EINPROGRESS' AND nx = 'poll' THEN coalesce(nlat, 0) ELSE 0 END) / 1000.0 AS latency_ms
  FROM r WHERE syscall = 'connect')
"""


@register("network_stats", with_views("trace_events", sql=NET_CTES + "SELECT * FROM net"))
def network_stats(spark, d):
    return ops.connections(view(spark, d, "trace_events"))


@register("network_rollup", with_views("trace_events", sql=NET_CTES + """
SELECT run_id, count(*) AS connections, count(DISTINCT address) AS hosts,
 count(*) FILTER (WHERE result NOT IN ('ok', 'connecting')) AS failures FROM net GROUP BY 1"""))
def network_rollup(spark, d):
    return ops.connection_summary(ops.connections(view(spark, d, "trace_events")))


@register("peer_waits", with_views("trace_events", sql="""
, r AS (SELECT *, coalesce(fd, CAST(nullif(regexp_extract(args, '^([0-9]+)', 1), '') AS INT)) AS held_fd FROM trace_events
   WHERE syscall IN ('connect', 'close') OR (syscall = 'read' AND lat_us > 100000)),
 h AS (SELECT *, last_value(CASE WHEN syscall = 'close' THEN '' WHEN syscall = 'connect' THEN regexp_extract(args, 'inet_addr\\("([^"]+)"', 1)
   || ':' || regexp_extract(args, 'htons\\(([0-9]+)\\)', 1) END IGNORE NULLS) OVER (PARTITION BY run_id, pid, held_fd ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peer FROM r WHERE held_fd IS NOT NULL)
SELECT run_id, peer, count(*) AS reads, CAST(sum(lat_us) AS BIGINT) AS wait_us, max(lat_us) AS worst_us
FROM h WHERE syscall = 'read' AND peer <> '' GROUP BY 1, 2"""))
def peer_waits(spark, d):
    rows = ops.peer_waits(view(spark, d, "trace_events"), 100_000)
    return rows.groupBy("run_id", "peer").agg(F.count("*").alias("reads"), F.sum("lat_us").alias("wait_us"),
                                              F.max("lat_us").alias("worst_us"))


@register("run_totals", with_views("trace_events", sql="""
SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'signal') AS signals,
 count(*) FILTER (WHERE event_type NOT IN ('signal', 'exit', 'libcall')) AS syscall_events,
 count(*) FILTER (WHERE event_type NOT IN ('signal', 'exit', 'libcall') AND error IS NOT NULL) AS errors
FROM trace_events GROUP BY 1"""))
def run_totals(spark, d):
    return ops.run_totals(view(spark, d, "trace_events"))


@register("top_syscalls", with_views("trace_events", sql="""
, n AS (SELECT run_id, syscall, count(*) AS cnt, min(seq) AS first_seq FROM trace_events GROUP BY 1, 2)
SELECT run_id, syscall, cnt AS "count", rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, first_seq) AS INT) AS rank FROM n)
WHERE rank <= 10"""))
def top_syscalls(spark, d):
    return ops.top_calls(view(spark, d, "trace_events"))


RATE_CTES = """
, s AS (SELECT DISTINCT run_id, ts_us FROM metrics), b AS (SELECT run_id, ts_us,
   coalesce(lag(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us), ts_us - 250000) AS t0 FROM s),
 n AS (SELECT b.run_id, b.ts_us, b.t0, count(e.seq) AS calls FROM b LEFT JOIN (SELECT * FROM trace_events
   WHERE event_type NOT IN ('signal', 'exit', 'libcall')) e ON e.run_id = b.run_id AND e.ts_us > b.t0 AND e.ts_us <= b.ts_us
   GROUP BY 1, 2, 3),
 rate AS (SELECT run_id, ts_us, calls, calls / ((ts_us - t0) / 1000000.0) AS syscall_rate FROM n
   WHERE run_id IN (SELECT run_id FROM trace_events))
"""


@register("syscall_rate", with_views("trace_events", "metrics", sql=RATE_CTES.replace(
    "SELECT DISTINCT run_id, ts_us FROM metrics", "SELECT DISTINCT run_id, (ts_us // 3600000000 + 1) * 3600000000 AS ts_us FROM metrics")
    + "SELECT run_id, ts_us, calls, syscall_rate FROM rate"))
def syscall_rate(spark, d):
    # A sample at each full hour after an event: bins of different length that hold different counts.
    hour = ((F.floor(c("ts_us") / 3_600_000_000) + 1) * 3_600_000_000).cast("long")
    samples = view(spark, d, "metrics").select("run_id", hour.alias("ts_us"))
    return ops.call_rate(view(spark, d, "trace_events"), samples)


@register("metrics_with_rate", with_views("trace_events", "metrics", sql=RATE_CTES + """
SELECT m.run_id, m.ts_us, m.cpu_pct, rate.syscall_rate FROM metrics m LEFT JOIN rate ON m.run_id = rate.run_id AND m.ts_us = rate.ts_us"""))
def metrics_with_rate(spark, d):
    m = view(spark, d, "metrics")
    return ops.with_call_rate(m, ops.call_rate(view(spark, d, "trace_events"), m)).select(
        "run_id", "ts_us", "cpu_pct", "syscall_rate")
