"""Findings: built-in and user-written rules, evidence, severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..operators import catalog, custom, rules, series
from . import register

c = F.col

# The test tables have few events per second, so the limits are scaled to make every rule meet both outcomes.
LIMITS = rules.Thresholds.with_overrides({
    "slow_net_ms": 100, "slow_syscall_ms": 100, "downstream_read_min_ms": 50, "downstream_wait_ms": 100, "conn_reuse_min": 2,
    "io_retry_min": 2, "small_read_min": 1, "write_storm_min": 5, "spin_loop_min": 2, "mem_growth_ratio": 1.1,
    "mem_growth_min_mb": 5, "fd_growth_min": 5, "memory_spike_mb": 0.5, "infinite_loop_max_syscalls": 2005})


def run_table(spark, d):
    m = view(spark, d, "metrics")
    return m.groupBy("run_id").agg(F.floor((F.max("ts_us") - F.min("ts_us")) / 1000).alias("duration_ms")).withColumns({
        "cgroup_cpu_quota_cores": F.when(c("run_id") == "run-1", 0.5).when(c("run_id") == "run-3", 64.0),
        "cgroup_mem_limit_bytes": F.when(c("run_id") == "run-2", 110 * 1024 * 1024).cast("long")})


def rated_metrics(spark, d):
    """Runs 0-2 know their call rate, runs 3 and 4 do not."""
    return view(spark, d, "metrics").withColumn("syscall_rate", F.when(
        c("run_id").isin("run-0", "run-1", "run-2"), c("open_fds").cast("double")))


RUNS = """, runs AS (SELECT run_id, (max(ts_us) - min(ts_us)) // 1000 AS duration_ms,
   CASE run_id WHEN 'run-1' THEN 0.5 WHEN 'run-3' THEN 64.0 END AS quota, CASE run_id WHEN 'run-2' THEN 115343360 END AS lim FROM metrics GROUP BY 1),
 rm AS (SELECT *, CASE WHEN run_id IN ('run-0', 'run-1', 'run-2') THEN CAST(open_fds AS DOUBLE) END AS syscall_rate FROM metrics)
"""
PEER = """regexp_extract(args, 'inet_addr\\("([^"]+)"', 1) || ':' || regexp_extract(args, 'htons\\(([0-9]+)\\)', 1)"""
EVENT_RULES = f"""
, dial AS (SELECT *, lead(syscall) OVER w AS nx, lead(lat_us) OVER w AS nlat FROM trace_events WHERE syscall IN ('connect', 'poll')
   WINDOW w AS (PARTITION BY run_id, pid ORDER BY seq)),
 held AS (SELECT *, last_value(CASE WHEN syscall = 'close' THEN '' WHEN syscall = 'connect' THEN {PEER} END IGNORE NULLS) OVER (
   PARTITION BY run_id, pid, hfd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peer FROM (SELECT *,
   coalesce(fd, CAST(nullif(regexp_extract(args, '^([0-9]+)', 1), '') AS INT)) AS hfd FROM trace_events) WHERE hfd IS NOT NULL),
 mt AS (
  SELECT 'repeated_open_same_file' AS rule_id, path AS grp, * EXCLUDE (path), path FROM trace_events WHERE syscall = 'openat' AND error IS NULL
  UNION ALL SELECT 'failed_file_opens', '', * EXCLUDE (path), path FROM trace_events WHERE syscall = 'openat' AND error IN ('EACCES', 'ENOENT')
  UNION ALL SELECT 'slow_network_connect', '', * EXCLUDE (path, nx, nlat), path FROM dial WHERE syscall = 'connect' AND (lat_us > 100000
    OR (error = 'EINPROGRESS' AND nx = 'poll' AND nlat > 100000))
  UNION ALL SELECT 'slow_downstream_peer', peer, * EXCLUDE (path, hfd, peer), path FROM held WHERE syscall = 'read' AND lat_us > 50000 AND peer <> ''
  UNION ALL SELECT 'slow_syscall', '', * EXCLUDE (path), path FROM trace_events WHERE lat_us > 100000 AND syscall NOT IN ('poll', 'futex', 'read')
  UNION ALL SELECT 'slow_file_io', '', * EXCLUDE (path), path FROM trace_events WHERE lat_us > 100000 AND syscall IN ('openat', 'write') AND error IS NULL
  UNION ALL SELECT 'connection_error', '', * EXCLUDE (path), path FROM trace_events WHERE error = 'ECONNREFUSED' AND syscall = 'connect'
  UNION ALL SELECT 'no_connection_reuse', {PEER}, * EXCLUDE (path), path FROM trace_events WHERE syscall = 'connect' AND (error IS NULL OR error = 'EINPROGRESS')
  UNION ALL SELECT 'mutex_contention', '', * EXCLUDE (path), path FROM trace_events WHERE syscall = 'futex' AND lat_us > 10000
  UNION ALL SELECT 'io_retry_loop', pid || ':' || syscall || ':' || fd, * EXCLUDE (path), path FROM trace_events WHERE error = 'EAGAIN' AND fd IS NOT NULL
  UNION ALL SELECT 'small_read_storm', pid || ':' || fd, * EXCLUDE (path), path FROM trace_events WHERE syscall = 'read' AND error IS NULL
    AND CAST(retval AS BIGINT) BETWEEN 1 AND 511
  UNION ALL SELECT 'write_storm', pid || ':' || fd, * EXCLUDE (path), path FROM trace_events WHERE syscall = 'write' AND error IS NULL AND fd > 2
  UNION ALL SELECT 'spin_loop', '', * EXCLUDE (path), path FROM trace_events WHERE syscall = 'poll' AND lat_us < 1000),
 gr AS (SELECT run_id, rule_id, grp, count(*) AS n, sum(lat_us) AS lat_sum, max(lat_us) AS lat_max, min(seq) AS first_seq, arg_min(ts_us, seq) AS a,
   arg_max(ts_us, seq) AS z, min(ts_us) AS mn, max(ts_us) AS mx FROM mt GROUP BY 1, 2, 3),
 bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id ORDER BY CASE WHEN rule_id = 'slow_downstream_peer' THEN lat_sum
   ELSE n END DESC, first_seq) AS rn FROM gr) WHERE rn = 1),
 ef AS (SELECT run_id, rule_id, grp, n, CASE WHEN rule_id IN ('no_connection_reuse', 'io_retry_loop', 'spin_loop') THEN NULL
   WHEN rule_id IN ('slow_network_connect', 'slow_syscall', 'slow_file_io', 'slow_downstream_peer') THEN mn ELSE a END AS first_us,
   CASE WHEN rule_id IN ('no_connection_reuse', 'io_retry_loop', 'spin_loop') THEN NULL
   WHEN rule_id IN ('slow_network_connect', 'slow_syscall', 'slow_file_io', 'slow_downstream_peer') THEN mx ELSE z END AS last_us FROM bg
  WHERE CASE rule_id WHEN 'repeated_open_same_file' THEN n > 10 WHEN 'failed_file_opens' THEN n > 5 WHEN 'slow_downstream_peer' THEN
   lat_sum >= 100000 OR lat_max >= 100000 WHEN 'no_connection_reuse' THEN n > 2 WHEN 'mutex_contention' THEN n > 20 WHEN 'io_retry_loop' THEN n > 2
   WHEN 'small_read_storm' THEN n > 1 WHEN 'write_storm' THEN n > 5 WHEN 'spin_loop' THEN n > 2 AND EXISTS (SELECT 1 FROM metrics m
   WHERE m.run_id = bg.run_id AND cpu_pct > 80) ELSE n > 0 END
  UNION ALL SELECT e.run_id, 'infinite_loop_no_progress', '', 1, NULL, NULL FROM (SELECT run_id, count(*) AS n FROM trace_events GROUP BY 1) e
   JOIN runs USING (run_id) WHERE duration_ms >= 30000 AND n <= 2005)
"""
TREND = """
, tp AS (SELECT run_id, ts_us, rule_id, v, row_number() OVER (PARTITION BY run_id, rule_id ORDER BY ts_us DESC) AS back FROM (
   SELECT run_id, ts_us, 'monotonic_memory_growth' AS rule_id, rss_mb AS v FROM metrics UNION ALL SELECT run_id, ts_us, 'fd_count_growing', open_fds FROM metrics)),
 tl AS (SELECT tp.*, lag(v) OVER (PARTITION BY tp.run_id, rule_id ORDER BY ts_us) AS pv FROM tp JOIN runs USING (run_id)
   WHERE duration_ms <= 600000 OR back <= 360),
 tg AS (SELECT run_id, rule_id, count(*) AS n, arg_min(v, ts_us) AS f, arg_max(v, ts_us) AS l, min(ts_us) AS a, max(ts_us) AS z,
   count(*) FILTER (WHERE v < pv - CASE rule_id WHEN 'fd_count_growing' THEN 0 ELSE 0.5 END) AS dec FROM tl GROUP BY 1, 2),
 gf AS (SELECT run_id, rule_id, CAST(floor(l - f) AS BIGINT) AS n, a, z FROM tg WHERE n >= 8 AND CASE rule_id WHEN 'fd_count_growing' THEN l - f >= 5
   AND dec <= n * 0.25 ELSE l - f > 5 AND l > f * 1.1 AND dec < n * 0.25 END)
"""
METRIC_RULES = RUNS + TREND + """
, ld AS (SELECT rm.*, quota, lim FROM rm LEFT JOIN runs USING (run_id)),
 hot AS (SELECT run_id, ts_us, 'cpu_bound_no_syscalls' AS rule_id FROM ld WHERE cpu_pct > 90 AND syscall_rate < 50
  UNION ALL SELECT run_id, ts_us, 'cpu_bound_metric' FROM ld WHERE cpu_pct > 90 AND coalesce(io_read_bps, 0) < 262144 AND run_id IN ('run-3', 'run-4')
  UNION ALL SELECT run_id, ts_us, 'io_wait_metric' FROM ld WHERE cpu_pct < 40 AND coalesce(io_read_bps, 0) > 65536 AND run_id IN ('run-3', 'run-4')
  UNION ALL SELECT run_id, ts_us, 'cpu_throttled' FROM ld WHERE quota > 0 AND cpu_pct >= quota * 100.0 * 0.9),
 sp AS (SELECT run_id, ts_us, rss_mb - lag(rss_mb) OVER (PARTITION BY run_id ORDER BY ts_us) AS step FROM metrics),
 mf AS (SELECT * FROM gf UNION ALL SELECT run_id, rule_id, count(*), min(ts_us), max(ts_us) FROM hot GROUP BY 1, 2 HAVING count(*) >= 8
  UNION ALL SELECT run_id, 'rss_near_cgroup_limit', CAST(floor(max(rss_mb)) AS BIGINT), min(ts_us), arg_max(ts_us, rss_mb) FROM ld
   WHERE lim > 0 GROUP BY run_id HAVING max(rss_mb) >= max(lim) / 1048576.0 * 0.9
  UNION ALL SELECT run_id, 'memory_spike', count(*), min(ts_us), max(ts_us) FROM sp WHERE step > 0.5 GROUP BY 1)
"""
SEV = ", sv(rule_id, severity, base) AS (VALUES " + ", ".join(
    f"('{r[0]}', '{r[2]}', {dict(critical=90.0, high=70.0, medium=45.0)[r[2]]})" for r in rules.CATALOG) + ")"
ALL = METRIC_RULES + EVENT_RULES.lstrip() + SEV + """
, f AS (SELECT run_id, rule_id, n, first_us, last_us FROM ef UNION ALL SELECT * FROM mf),
 ff AS (SELECT run_id, rule_id, severity, round(CAST(base AS DOUBLE) + least(n, 1000) / 1000 * CAST(9.99 AS DOUBLE), 3) AS severity_score, n AS occurrence_count,
  CAST(first_us AS BIGINT) AS first_seen_us, CAST(last_us AS BIGINT) AS last_seen_us FROM f JOIN sv USING (rule_id))
"""
SHOWN = ["run_id", "rule_id", "severity", "severity_score", "occurrence_count", "first_seen_us", "last_seen_us"]


def all_findings(spark, d):
    return rules.run_rules(view(spark, d, "trace_events"), rated_metrics(spark, d), run_table(spark, d), LIMITS)


@register("rule_findings", with_views("trace_events", "metrics", sql=ALL + f"SELECT {', '.join(SHOWN)} FROM ff"))
def rule_findings(spark, d):
    return all_findings(spark, d).select(*SHOWN)


@register("metric_rule_findings", with_views("trace_events", "metrics", sql=ALL + f"""SELECT {', '.join(SHOWN)} FROM ff
WHERE rule_id IN (SELECT rule_id FROM mf)"""))
def metric_rule_findings(spark, d):
    return rules.metric_findings(rated_metrics(spark, d), run_table(spark, d), LIMITS).select(*SHOWN)


@register("stored_findings", with_views("trace_events", "metrics", sql=ALL + f"SELECT {', '.join(SHOWN)} FROM ff WHERE run_id = 'run-2'"))
def stored_findings(spark, d):
    return catalog.read_findings(all_findings(spark, d), "run-2").select(*SHOWN)


@register("finding_labels", with_views("trace_events", "metrics", sql=ALL + """
SELECT run_id, rule_id, upper(rule_id[1]) || replace(rule_id[2:], '_', ' ') AS label, severity FROM ff"""))
def finding_labels(spark, d):
    found = all_findings(spark, d).select("run_id", "rule_id")
    return found.join(rules.metadata(spark), "rule_id").select("run_id", "rule_id", "label", "severity")


@register("rule_evidence", with_views("trace_events", "metrics", sql=RUNS + EVENT_RULES.lstrip() + """
, s AS (SELECT m.run_id, m.rule_id, m.seq, CAST(row_number() OVER (PARTITION BY m.run_id, m.rule_id ORDER BY CASE WHEN m.rule_id IN ('slow_syscall', 'slow_file_io')
  THEN lat_us END DESC NULLS LAST, CASE WHEN m.rule_id = 'slow_downstream_peer' THEN ts_us END, seq) AS INT) AS rank FROM mt m JOIN ef
  ON ef.run_id = m.run_id AND ef.rule_id = m.rule_id AND ef.grp = m.grp WHERE m.rule_id <> 'no_connection_reuse')
SELECT run_id, rule_id, seq, rank FROM s WHERE rank <= 20"""))
def rule_evidence(spark, d):
    ev = view(spark, d, "trace_events")
    found = rules.event_findings(ev, LIMITS, rated_metrics(spark, d), run_table(spark, d))
    return rules.evidence(ev, found, LIMITS).select("run_id", "rule_id", "seq", "rank")


@register("run_max_severity", with_views("trace_events", "metrics", sql=ALL + """
SELECT run_id, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium')
 THEN 'medium' ELSE 'clean' END AS max_severity FROM runs LEFT JOIN ff USING (run_id) GROUP BY 1"""))
def run_max_severity(spark, d):
    return rules.max_severity(all_findings(spark, d), run_table(spark, d))


CUSTOM = [
    dict(id="1", name="slow reads", description="", signal="events", severity="high", min_count=10, created_at=1,
         expression="syscall in ('read', 'pread64') and latency_ms > 100 and retval_int >= 0"),
    dict(id="2", name="refused", description="", signal="events", severity="low", min_count=5, created_at=2,
         expression="error == 'ECONNREFUSED' or ('f3' in path and not retval_int > 3)"),
    dict(id="3", name="busy", description="", signal="metrics", severity="medium", duration_ms=1_000, created_at=3,
         expression="cpu_pct > 20 and open_fds % 7 != 0"),
    dict(id="4", name="never", description="", signal="metrics", severity="medium", duration_ms=1_000, created_at=4,
         expression="syscall_rate > 0"),
    dict(id="5", name="broken", description="", signal="events", severity="medium", min_count=1, created_at=5,
         expression="open('x')"),
]


@register("custom_rule_findings", with_views("trace_events", "metrics", sql="""
, h AS (SELECT run_id, seq, ts_us, 'custom:1' AS rule_id, 'high' AS severity, 70.0 AS base, 10 AS need FROM trace_events
   WHERE syscall = 'read' AND lat_us > 100000 AND CAST(retval AS BIGINT) >= 0
  UNION ALL SELECT run_id, seq, ts_us, 'custom:2', 'low', 20.0, 5 FROM trace_events WHERE error = 'ECONNREFUSED'
   OR (contains(coalesce(path, ''), 'f3') AND NOT CAST(retval AS BIGINT) > 3)),
 e AS (SELECT run_id, rule_id, severity, round(CAST(base AS DOUBLE) + least(count(*), 1000) / 1000 * CAST(9.99 AS DOUBLE), 3) AS severity_score, count(*) AS occurrence_count,
   arg_min(ts_us, seq) AS first_seen_us, arg_max(ts_us, seq) AS last_seen_us FROM h GROUP BY 1, 2, 3, base, need HAVING count(*) >= need),
 i AS (SELECT run_id, ts_us, cpu_pct > 20 AND open_fds % 7 <> 0 AS hit FROM metrics),
 g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ts_us) AS isl FROM i),
 s AS (SELECT run_id, isl, min(ts_us) AS a, max(ts_us) AS z FROM g WHERE hit GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY z - a DESC, z DESC) AS rn FROM s)
SELECT * FROM e UNION ALL SELECT run_id, 'custom:3', 'medium', round(45.0::DOUBLE + least((z - a) // 1000, 1000) / 1000 * CAST(9.99 AS DOUBLE), 3), 1, a, z
FROM b WHERE rn = 1 AND z - a >= 1000000"""))
def custom_rule_findings(spark, d):
    found = custom.custom_findings(spark, view(spark, d, "trace_events"), view(spark, d, "metrics"), CUSTOM)
    return found.select("run_id", "rule_id", "severity", "severity_score", "occurrence_count", "first_seen_us", "last_seen_us")


@register("slow_leak_findings", with_views("metrics", sql="""
, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n,
   lag(rss_mb) OVER (PARTITION BY run_id ORDER BY ts_us) AS pv FROM metrics),
 hd AS (SELECT run_id, list_sort(list(round(rss_mb * 1000))) AS l FROM n WHERE i < greatest(2, n // 10) GROUP BY 1),
 tl AS (SELECT run_id, list_sort(list(round(rss_mb * 1000))) AS l FROM n WHERE i >= n - greatest(2, n // 10) GROUP BY 1),
 st AS (SELECT run_id, count(*) AS n, min(ts_us) AS a, max(ts_us) AS z, count(*) FILTER (WHERE rss_mb >= pv - 0.5) / count(*) AS share FROM n GROUP BY 1)
SELECT run_id, st.n, a AS first_us, z AS last_us, least(hd.l[1], hd.l[len(hd.l) // 2 + 1]) / 1000.0 AS baseline, tl.l[len(tl.l) // 2 + 1] / 1000.0 AS current,
 share AS non_falling_share FROM st JOIN hd USING (run_id) JOIN tl USING (run_id)"""))
def slow_leak(spark, d):
    g = series.slow_growth(series.series(view(spark, d, "metrics"), "rss_mb"))
    return g.select("run_id", "n", "first_us", "last_us", "baseline", "current", "non_falling_share")
