"""Run comparison, timelines, incidents, digests, the run catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..functions.scalars import bytes_text, command_name, run_class, run_label
from ..operators import calls, catalog, compare, digest, incidents, profiles, rules, series, timeline
from ..sources import archive
from . import register
from .rules import ALL, LIMITS, all_findings, rated_metrics, run_table
from .profiles import _stacks

c = F.col


def _ev(spark, d):
    return view(spark, d, "trace_events")


def _pairs(spark, d):
    """Every run against the one whose name follows: run-0/run-1 ... run-3/run-4."""
    r = _ev(spark, d).select(c("run_id").alias("run_a")).distinct()
    n = F.regexp_extract("run_a", "([0-9]+)", 1).cast("int")
    return r.withColumn("run_b", F.concat(F.lit("run-"), (n + 1).cast("string"))).where(n < 4)


PAIRS = ", pairs(run_a, run_b) AS (VALUES ('run-0', 'run-1'), ('run-1', 'run-2'), ('run-2', 'run-3'), ('run-3', 'run-4'))"


@register("run_diff", with_views("trace_events", sql=PAIRS + """
, s AS (SELECT run_id, syscall, count(*) AS n, CAST(sum(lat_us) AS BIGINT) / count(lat_us) / 1000.0 AS avg_ms FROM trace_events GROUP BY 1, 2),
 a AS (SELECT pairs.*, syscall, n, avg_ms FROM s JOIN pairs ON run_id = run_a), b AS (SELECT pairs.*, syscall, n, avg_ms FROM s JOIN pairs ON run_id = run_b)
SELECT run_a, run_b, syscall, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta,
 a.avg_ms AS avg_a, b.avg_ms AS avg_b FROM a FULL OUTER JOIN b USING (run_a, run_b, syscall)"""))
def run_diff(spark, d):
    # A few syscalls are taken out of the even runs, so that both sides miss some.
    return compare.call_delta(calls.call_stats(_ev(spark, d)), _pairs(spark, d))


@register("finding_diff", with_views("trace_events", "metrics", sql=ALL + PAIRS + """
, fa AS (SELECT run_a, run_b, rule_id, severity FROM ff JOIN pairs ON run_id = run_a), fb AS (SELECT run_a, run_b, rule_id, severity FROM ff JOIN pairs ON run_id = run_b)
SELECT coalesce(fa.run_a, fb.run_a) AS run_a, coalesce(fa.run_b, fb.run_b) AS run_b, coalesce(fa.rule_id, fb.rule_id) AS rule_id,
 CASE WHEN fb.rule_id IS NULL THEN 'only_a' WHEN fa.rule_id IS NULL THEN 'only_b' ELSE 'both' END AS "where"
FROM fa FULL OUTER JOIN fb ON fa.run_a = fb.run_a AND fa.rule_id = fb.rule_id"""))
def finding_diff(spark, d):
    return compare.finding_delta(all_findings(spark, d), _pairs(spark, d)).select("run_a", "run_b", "rule_id", "where")


SUMMARY = """
, fc AS (SELECT run_id, count(*) AS findings FROM ff GROUP BY 1),
 pk AS (SELECT run_id, max(cpu_pct) AS peak_cpu_pct, max(rss_mb) AS peak_rss_mb, max(open_fds) AS peak_open_fds, max(threads) AS peak_threads FROM metrics GROUP BY 1),
 tt AS (SELECT run_id, count(*) AS syscall_events, count(error) AS errors FROM trace_events GROUP BY 1),
 rs AS (SELECT * FROM (SELECT run_id, duration_ms FROM runs) JOIN pk USING (run_id) JOIN tt USING (run_id) LEFT JOIN fc USING (run_id)),
 lg AS (SELECT run_id, unnest(['duration_ms', 'peak_cpu_pct', 'peak_rss_mb', 'peak_open_fds', 'peak_threads', 'syscall_events', 'errors', 'findings']) AS measure,
  unnest([duration_ms::DOUBLE, peak_cpu_pct, peak_rss_mb, peak_open_fds::DOUBLE, peak_threads::DOUBLE, syscall_events::DOUBLE, errors::DOUBLE, coalesce(findings, 0)::DOUBLE]) AS v FROM rs),
 od AS (SELECT run_a, run_b, a.measure, a.v AS a, b.v AS b, b.v - a.v AS delta FROM pairs JOIN lg a ON a.run_id = run_a JOIN lg b ON b.run_id = run_b AND b.measure = a.measure)
"""


@register("overview_diff", with_views("trace_events", "metrics", sql=ALL + PAIRS + SUMMARY + """
SELECT *, CASE WHEN a <> 0 THEN delta / abs(a) * 100 END AS pct, CASE WHEN delta <> 0 THEN delta < 0 END AS improved FROM od"""))
def overview_diff(spark, d):
    m = view(spark, d, "metrics")
    s = compare.run_summary(run_table(spark, d), series.peaks(m), calls.run_totals(_ev(spark, d)), all_findings(spark, d))
    return compare.overview_delta(s, _pairs(spark, d))


@register("diff_digest")
def diff_digest(spark, d):
    f = all_findings(spark, d)
    m = view(spark, d, "metrics")
    s = compare.run_summary(run_table(spark, d), series.peaks(m), calls.run_totals(_ev(spark, d)), f)
    pairs = _pairs(spark, d)
    return compare.diff_digest(compare.overview_delta(s, pairs), compare.finding_delta(f, pairs))


@register("series_overlay", with_views("metrics", sql=PAIRS + """
, e AS (SELECT run_id, ts_us - min(ts_us) OVER (PARTITION BY run_id) AS elapsed_us, io_read_bps AS v FROM metrics)
SELECT run_a, run_b, 'A' AS side, elapsed_us, v FROM e JOIN pairs ON run_id = run_a WHERE v IS NOT NULL UNION ALL
SELECT run_a, run_b, 'B', elapsed_us, v FROM e JOIN pairs ON run_id = run_b WHERE v IS NOT NULL"""))
def series_overlay(spark, d):
    return compare.series_overlay(view(spark, d, "metrics"), _pairs(spark, d), "io_read_bps")


@register("peak_diff", with_views("metrics", sql=PAIRS + """
, p AS (SELECT run_id, unnest(['rss_mb', 'cpu_pct']) AS measure, unnest([max(rss_mb), max(cpu_pct)]) AS v FROM metrics GROUP BY 1)
SELECT run_a, run_b, a.measure, a.v AS peak_a, b.v AS peak_b, b.v - a.v AS delta FROM pairs JOIN p a ON a.run_id = run_a JOIN p b ON b.run_id = run_b AND b.measure = a.measure"""))
def peak_diff(spark, d):
    return compare.peak_delta(view(spark, d, "metrics"), _pairs(spark, d), ["rss_mb", "cpu_pct"])


# --- timelines -------------------------------------------------------------------------------------------------------

@register("timeline_marks", with_views("trace_events", sql="""
, k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN lat_us > 100000 THEN 'slow' WHEN event_type = 'signal' THEN 'signal'
  WHEN starts_with(syscall, 'exec') THEN 'exec' END AS kind FROM trace_events),
 n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, seq) AS rn FROM k WHERE kind IS NOT NULL)
SELECT run_id, seq, ts_us, kind, CASE kind WHEN 'error' THEN syscall || ' -> ' || error WHEN 'slow' THEN syscall || ' took ' ||
 CAST(CAST(round(lat_us / 1000.0) AS BIGINT) AS VARCHAR) || 'ms' ELSE syscall END AS label FROM n WHERE rn <= 800"""))
def timeline_marks(spark, d):
    return timeline.marks(_ev(spark, d))


COLLAPSED = """
, k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN lat_us > 100000 THEN 'slow' END AS kind FROM trace_events),
 o AS (SELECT *, CASE WHEN kind = 'error' AND lag(kind) OVER w = 'error' AND lag(syscall) OVER w = syscall AND lag(error) OVER w = error THEN 0 ELSE 1 END AS op
   FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY ts_us, seq)),
 i AS (SELECT *, CAST(sum(op) OVER (PARTITION BY run_id ORDER BY ts_us, seq) AS BIGINT) AS island FROM o),
 g AS (SELECT run_id, island, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n, any_value(kind) AS kind, any_value(syscall) AS syscall,
   any_value(error) AS error, arg_min(lat_us, seq) AS lat_us FROM i GROUP BY 1, 2)
"""


@register("timeline_digest", with_views("trace_events", sql=COLLAPSED + "SELECT run_id, island, first_us, last_us, n, kind, syscall, error, lat_us FROM g"))
def timeline_digest(spark, d):
    return timeline.collapsed_errors(_ev(spark, d)).select("run_id", "island", "first_us", "last_us", "n", "kind", "syscall",
                                                           "error", "lat_us")


LINES = COLLAPSED + """
, st AS (SELECT run_id, min(ts_us) AS t0 FROM trace_events GROUP BY 1),
 r AS (SELECT g.*, t0, CAST(row_number() OVER (PARTITION BY run_id ORDER BY island) AS INT) AS line, count(*) OVER (PARTITION BY run_id) AS lines FROM g JOIN st USING (run_id)),
 x AS (SELECT *, (first_us - t0 + 5000) // 10000 AS c1, (last_us - t0 + 5000) // 10000 AS c2 FROM r WHERE line <= 22),
 tx AS (SELECT run_id, line, CASE WHEN line = 22 AND lines > 22 THEN '... (' || (lines - 21) || ' more)' ELSE '+' || c1 // 100 || '.' || lpad(CAST(c1 % 100 AS VARCHAR), 2, '0') ||
  CASE WHEN kind = 'error' AND n > 1 THEN '-' || c2 // 100 || '.' || lpad(CAST(c2 % 100 AS VARCHAR), 2, '0') || 's ' || syscall || ' -> ' || error || ' x' || n
   WHEN kind = 'error' THEN 's ' || syscall || ' -> ' || error ELSE 's ' || syscall || ' took ' || (lat_us + 500) // 1000 || 'ms' END END AS text FROM x)
"""


def _starts(ev):
    return ev.groupBy("run_id").agg(F.min("ts_us").alias("started_us"))


@register("timeline_lines", with_views("trace_events", sql=LINES + "SELECT * FROM tx"))
def timeline_lines(spark, d):
    ev = _ev(spark, d)
    return timeline.timeline_lines(ev, _starts(ev))


@register("curated_events", with_views("trace_events", "metrics", sql=ALL + """
, s AS (SELECT m.run_id, m.seq, row_number() OVER (PARTITION BY m.run_id, m.rule_id ORDER BY CASE WHEN m.rule_id IN ('slow_syscall', 'slow_file_io')
  THEN lat_us END DESC NULLS LAST, CASE WHEN m.rule_id = 'slow_downstream_peer' THEN ts_us END, seq) AS rank FROM mt m JOIN ef
  ON ef.run_id = m.run_id AND ef.rule_id = m.rule_id AND ef.grp = m.grp WHERE m.rule_id <> 'no_connection_reuse'),
 u AS (SELECT run_id, seq, 0 AS prio FROM s WHERE rank <= 20 UNION ALL SELECT run_id, seq, 1 FROM trace_events WHERE lat_us > 100000 OR error IS NOT NULL),
 o AS (SELECT run_id, seq, min(prio) AS prio FROM u GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY prio, seq) AS rn FROM o)
SELECT run_id, seq FROM n WHERE rn <= 400"""))
def curated_events(spark, d):
    ev = _ev(spark, d)
    found = rules.event_findings(ev, LIMITS, rated_metrics(spark, d), run_table(spark, d))
    return timeline.curated_events(ev, rules.evidence(ev, found, LIMITS), 400).select("run_id", "seq")


@register("evidence_links", with_views("trace_events", "metrics", sql=ALL + """
, s AS (SELECT m.run_id, m.rule_id, m.seq, row_number() OVER (PARTITION BY m.run_id, m.rule_id ORDER BY CASE WHEN m.rule_id IN ('slow_syscall', 'slow_file_io')
  THEN lat_us END DESC NULLS LAST, CASE WHEN m.rule_id = 'slow_downstream_peer' THEN ts_us END, seq) AS rank FROM mt m JOIN ef
  ON ef.run_id = m.run_id AND ef.rule_id = m.rule_id AND ef.grp = m.grp WHERE m.rule_id <> 'no_connection_reuse')
SELECT ef.run_id, ef.rule_id, coalesce((SELECT string_agg(CAST(seq AS VARCHAR), ',' ORDER BY rank) FROM s WHERE s.run_id = ef.run_id AND s.rule_id = ef.rule_id
 AND rank <= 20 AND seq IN (SELECT seq FROM trace_events WHERE error IS NOT NULL)), '') AS ids FROM ef"""))
def evidence_links(spark, d):
    # Only failed calls are stored here, so some evidence stays without an id.
    ev = _ev(spark, d)
    found = rules.event_findings(ev, LIMITS, rated_metrics(spark, d), run_table(spark, d))
    stored = ev.where("error IS NOT NULL").withColumn("event_id", c("seq").cast("string"))
    linked = timeline.link_evidence(found, rules.evidence(ev, found, LIMITS), stored)
    return linked.select("run_id", "rule_id", F.array_join("evidence_ids", ",").alias("ids"))


@register("output_in_findings", with_views("trace_events", sql="""
, w AS (SELECT run_id, ts_us AS a, ts_us + lat_us * 3000 AS z FROM trace_events WHERE lat_us > 250000)
SELECT run_id, seq, ts_us FROM trace_events e WHERE syscall = 'write' AND EXISTS (SELECT 1 FROM w WHERE w.run_id = e.run_id AND e.ts_us BETWEEN a AND z)"""))
def output_in_findings(spark, d):
    ev = _ev(spark, d)
    w = ev.where("lat_us > 250000").select("run_id", c("ts_us").alias("a"), (c("ts_us") + c("lat_us") * 3000).alias("z"))
    return timeline.inside_windows(ev.where("syscall = 'write'").select("run_id", "seq", "ts_us"), w, "a", "z")


# --- incidents -------------------------------------------------------------------------------------------------------

LIVE = incidents.LiveLimits(fds=100, rss_step_mb=0.9, cpu_pct=40.0, cpu_streak=3, rearm=8)
ALERTS = """
, fa AS (SELECT run_id, ts_us, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) AS rn, open_fds > 100 AS on_ FROM metrics),
 fh AS (SELECT *, lag(rn) OVER (PARTITION BY run_id ORDER BY ts_us) AS p FROM fa WHERE on_),
 ca AS (SELECT run_id, ts_us, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) AS rn, cpu_pct > 40 AS on_ FROM metrics),
 cg AS (SELECT *, rn - row_number() OVER (PARTITION BY run_id, on_ ORDER BY ts_us) AS g FROM ca),
 cs AS (SELECT *, row_number() OVER (PARTITION BY run_id, on_, g ORDER BY ts_us) AS pos FROM cg),
 cp AS (SELECT *, sum(CASE WHEN NOT on_ AND pos = 8 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts_us) AS phase FROM cs),
 cf AS (SELECT run_id, min(ts_us) AS ts_us FROM cp WHERE on_ AND pos = 3 GROUP BY run_id, phase),
 ms AS (SELECT run_id, ts_us, rss_mb - lag(rss_mb) OVER (PARTITION BY run_id ORDER BY ts_us) AS step FROM metrics),
 al AS (SELECT run_id, ts_us, 'fd_leak_live' AS rule_id, 'high' AS severity FROM fh WHERE p IS NULL OR rn - p - 1 >= 8 UNION ALL
  SELECT run_id, ts_us, 'mem_spike', 'medium' FROM ms WHERE step > 0.9 UNION ALL SELECT run_id, ts_us, 'cpu_hot_live', 'medium' FROM cf),
 inc AS (SELECT run_id || ':' || rule_id AS incident_id, run_id, rule_id, any_value(severity) AS severity, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS cnt FROM al GROUP BY run_id, rule_id),
 ctx AS (SELECT i.run_id, i.incident_id, m.ts_us, m.cpu_pct, m.rss_mb, m.open_fds FROM inc i JOIN metrics m ON m.run_id = i.run_id AND abs(m.ts_us - i.first_us) <= 36000000000)
"""


def _alerts(spark, d):
    return incidents.alerts(view(spark, d, "metrics"), LIVE)


def _incidents(spark, d):
    return incidents.collapse(_alerts(spark, d))


@register("live_alerts", with_views("metrics", sql=ALERTS + "SELECT * FROM al"))
def live_alerts(spark, d):
    return _alerts(spark, d).select("run_id", "ts_us", "rule_id", "severity")


@register("incident_collapse", with_views("metrics", sql=ALERTS + 'SELECT incident_id, run_id, rule_id, severity, first_us, last_us, cnt AS "count" FROM inc'))
def incident_collapse(spark, d):
    return _incidents(spark, d).select("incident_id", "run_id", "rule_id", "severity", "first_us", "last_us", "count")


# The samples are minutes apart here: the context is ten hours instead of thirty seconds.
WIDE = 36_000_000_000


@register("incident_hot_context", with_views("metrics", "trace_events", sql=ALERTS + """
, ev AS (SELECT run_id, (ts_us // 86400000000 + 1) * 86400000000 AS at_us, syscall AS fn, count(*) AS n FROM trace_events WHERE syscall IS NOT NULL GROUP BY 1, 2, 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, at_us ORDER BY n DESC, fn) AS r FROM ev),
 sh AS (SELECT run_id, at_us, string_agg(fn, ',' ORDER BY r) FILTER (WHERE r <= 5) AS functions, max(fn) FILTER (WHERE r = 1) AS stack, CAST(sum(n) AS BIGINT) AS samples FROM rk GROUP BY 1, 2),
 ch AS (SELECT i.incident_id, coalesce(max(at_us) FILTER (WHERE at_us <= first_us), min(at_us) FILTER (WHERE at_us > first_us)) AS at_us FROM inc i JOIN sh USING (run_id) GROUP BY 1)
SELECT i.run_id, i.incident_id, i.first_us, ch.at_us AS hot_us, sh.functions, sh.stack, sh.samples FROM inc i LEFT JOIN ch USING (incident_id) LEFT JOIN sh ON sh.run_id = i.run_id AND sh.at_us = ch.at_us"""))
def incident_hot_context(spark, d):
    """A snapshot at each day's end; the calls of that day stand for its stacks."""
    day = 86_400_000_000
    calls = _ev(spark, d).where("syscall IS NOT NULL").groupBy("run_id", ((F.floor(c("ts_us") / day) + 1) * day).alias("ts_us"), "syscall").agg(F.count("*").alias("weight"))
    shots = profiles.hot_context(calls.select("run_id", "ts_us", F.array("syscall").alias("frames"), "weight"), ["run_id", "ts_us"])
    return incidents.with_hot(_incidents(spark, d), shots).select(
        "run_id", "incident_id", "first_us", "hot_us", F.array_join("hot_functions", ",").alias("functions"), F.array_join("hot_stack", ";").alias("stack"), c("hot_samples").alias("samples"))


@register("incident_context", with_views("metrics", sql=ALERTS + "SELECT * FROM ctx"))
def incident_context(spark, d):
    return incidents.context(_incidents(spark, d), view(spark, d, "metrics"), WIDE).select(
        "run_id", "incident_id", "ts_us", "cpu_pct", "rss_mb", "open_fds")


@register("incident_peaks", with_views("metrics", sql=ALERTS + """
SELECT run_id, incident_id, count(*) AS samples, max(cpu_pct) AS peak_cpu_pct, max(rss_mb) AS peak_rss_mb, max(open_fds) AS peak_open_fds FROM ctx GROUP BY 1, 2"""))
def incident_peaks(spark, d):
    return incidents.context_peaks(incidents.context(_incidents(spark, d), view(spark, d, "metrics"), WIDE))


@register("incident_thinned", with_views("metrics", sql=ALERTS + """
, n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, incident_id) AS n FROM ctx WINDOW w AS (PARTITION BY run_id, incident_id ORDER BY ts_us)),
 p AS (SELECT run_id, incident_id, arg_max(i, (cpu_pct, i)) AS p1, arg_max(i, (rss_mb, i)) AS p2, arg_max(i, (open_fds, i)) AS p3 FROM n GROUP BY 1, 2)
SELECT n.run_id, n.incident_id, n.ts_us FROM n JOIN p USING (run_id, incident_id) WHERE i % greatest(1, n // 12) = 0 OR i = n - 1 OR i IN (p1, p2, p3)"""))
def incident_thinned(spark, d):
    ctx = incidents.context(_incidents(spark, d), view(spark, d, "metrics"), WIDE)
    return series.keep_peaks(ctx, ["run_id", "incident_id"], 12).select("run_id", "incident_id", "ts_us")


@register("incident_findings", with_views("metrics", sql=ALERTS + """
SELECT run_id, rule_id, severity, CASE severity WHEN 'high' THEN 0.4::DOUBLE + 3 * 0.1::DOUBLE ELSE 0.4::DOUBLE + 2 * 0.1::DOUBLE END AS severity_score, cnt AS occurrence_count FROM inc"""))
def incident_findings(spark, d):
    return incidents.to_findings(_incidents(spark, d)).select("run_id", "rule_id", "severity", "severity_score", "occurrence_count")


@register("legacy_incidents", with_views("metrics", sql=ALERTS + """
, r AS (SELECT *, CASE WHEN rule_id = 'mem_spike' THEN 5 END AS cnt0, CASE WHEN ts_us % 3 = 0 THEN 'note ' || ts_us END AS ai FROM al)
SELECT run_id, rule_id, severity, ts_us, cnt0 AS "count", ai FROM r WHERE cnt0 IS NOT NULL UNION ALL
SELECT run_id, rule_id, any_value(severity), min(ts_us), count(*), arg_max(ai, ts_us) FROM r WHERE cnt0 IS NULL GROUP BY 1, 2"""))
def legacy_incidents(spark, d):
    a = _alerts(spark, d)
    rows = a.select("run_id", "rule_id", "severity", "title", "ts_us", c("ts_us").alias("seq"),
                    F.when(c("rule_id") == "mem_spike", 5).cast("long").alias("count"),
                    F.when(c("ts_us") % 3 == 0, F.concat(F.lit("note "), c("ts_us").cast("string"))).alias("ai"))
    return incidents.compact_legacy(rows).select("run_id", "rule_id", "severity", "ts_us", "count", "ai")


@register("incident_feed", with_views("metrics", sql=ALERTS + """
, b AS (SELECT incident_id, run_id, first_us, last_us + 7 AS last_us, cnt FROM inc WHERE rule_id <> 'mem_spike' UNION ALL
  SELECT incident_id, run_id, first_us, last_us, cnt FROM inc WHERE rule_id = 'mem_spike')
SELECT incident_id, run_id, last_us AS activity_us, cnt AS "count" FROM b"""))
def incident_feed(spark, d):
    stored = _incidents(spark, d)
    live = stored.where("rule_id <> 'mem_spike'").withColumn("last_us", c("last_us") + 7)
    return incidents.merge_live(live, stored, 100).select("incident_id", "run_id", "activity_us", "count")


@register("live_findings", with_views("metrics", sql=ALERTS + "SELECT incident_id AS id, rule_id, first_us AS first_seen_us, last_us AS last_seen_us, cnt AS occurrence_count FROM inc"))
def live_findings(spark, d):
    return incidents.finding_view(_incidents(spark, d)).select("id", "rule_id", "first_seen_us", "last_seen_us", "occurrence_count")


@register("incident_patches", with_views("metrics", sql=ALERTS + """
, p AS (SELECT i.incident_id, max(a.ts_us) AS last_us, arg_max(a.severity, a.ts_us) FILTER (WHERE a.ts_us % 2 = 0) AS severity FROM inc i JOIN al a ON a.run_id = i.run_id
  AND a.rule_id = i.rule_id GROUP BY 1)
SELECT i.incident_id, coalesce(upper(p.severity), i.severity) AS severity, coalesce(p.last_us, i.first_us) AS last_us FROM inc i LEFT JOIN p USING (incident_id)"""))
def incident_patches(spark, d):
    # The stored row is an incident's first firing; later firings patch it, some of them in one field only.
    first = _incidents(spark, d).select("incident_id", "severity", c("first_us").alias("last_us"))
    a = _alerts(spark, d)
    patch = a.select(F.concat_ws(":", "run_id", "rule_id").alias("incident_id"),
                                             F.when(c("ts_us") % 2 == 0, F.upper("severity")).alias("severity"), c("ts_us").alias("last_us"), "ts_us")
    return catalog.patch_by_id(first, patch, ["incident_id"], "ts_us")


@register("run_summaries", with_views("trace_events", "metrics", sql=ALL + """
, t AS (SELECT run_id, syscall, count(*) AS n, min(seq) AS f FROM trace_events GROUP BY 1, 2),
 tc AS (SELECT run_id, string_agg(syscall || 'x' || n, ',' ORDER BY n DESC, f) AS top_calls FROM t GROUP BY 1),
 fl AS (SELECT run_id, string_agg(rule_id, ',' ORDER BY rule_id) AS findings FROM ff GROUP BY 1),
 m AS (SELECT run_id, count(*) AS samples, max(rss_mb) AS peak_rss_mb FROM metrics GROUP BY 1)
SELECT run_id, (SELECT count(*) FROM trace_events e WHERE e.run_id = runs.run_id) AS syscall_events, samples, peak_rss_mb, top_calls, findings
FROM runs JOIN tc USING (run_id) JOIN m USING (run_id) LEFT JOIN fl USING (run_id)"""))
def run_summaries(spark, d):
    s = archive.run_summaries(run_table(spark, d), _ev(spark, d), view(spark, d, "metrics"), all_findings(spark, d))
    top = F.array_join(F.transform("top_calls", lambda x: F.concat(x["syscall"], F.lit("x"), x["count"].cast("string"))), ",")
    return s.select("run_id", "syscall_events", "samples", "peak_rss_mb", top.alias("top_calls"),
                    F.array_join(F.transform("findings", lambda x: x["rule_id"]), ",").alias("findings"))


@register("incident_digest")
def incident_digest(spark, d):
    inc = _incidents(spark, d)
    return incidents.digest(inc, profiles.hot_context(_stacks(spark, d)), incidents.context(inc, view(spark, d, "metrics"), WIDE))


# --- digests and the catalog -----------------------------------------------------------------------------------------

def _digest_lines(spark, d):
    ev, m = _ev(spark, d), view(spark, d, "metrics")
    return digest.digest_lines(
        totals=calls.run_totals(ev), peaks=series.peaks(m), top=calls.top_calls(ev), trajectory=series.trajectory(m),
        timeline=timeline.timeline_lines(ev, _starts(ev)), io=calls.file_io(ev), conns=calls.connections(ev),
        findings=all_findings(spark, d), hotspots=profiles.hotspots(_stacks(spark, d)))


@register("digest_sections", with_views("trace_events", sql=LINES + """
SELECT run_id, 'timeline' AS section, line, text FROM tx UNION ALL
SELECT run_id, 'totals', 1, 'calls ' || count(*) || ', errors ' || count(error) || ', signals 0' FROM trace_events GROUP BY 1 UNION ALL
SELECT run_id, 'calls', CAST(rn AS INT), syscall || ' x' || cnt FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, f) AS rn FROM
 (SELECT run_id, syscall, count(*) AS cnt, min(seq) AS f FROM trace_events GROUP BY 1, 2)) WHERE rn <= 10"""))
def digest_sections(spark, d):
    return _digest_lines(spark, d).where(c("section").isin("timeline", "totals", "calls"))


@register("run_digest")
def run_digest(spark, d):
    return digest.run_digest(_digest_lines(spark, d))


def _runs(spark, d):
    """Orders as runs: the customer is the session, the key the run."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    us = F.unix_micros(c("o_orderdate").cast("timestamp"))
    status = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "running").otherwise("analyzing")
    return o.select(c("o_orderkey").cast("string").alias("run_id"), c("o_custkey").cast("string").alias("session_id"),
                    F.concat(F.lit("/usr/bin/job"), (c("o_orderkey") % 7).cast("string"), F.lit(" --x")).alias("command"),
                    us.alias("started_us"), F.lit(None).cast("long").alias("ended_us"), F.lit(None).cast("long").alias("duration_ms"),
                    status.alias("status"), (c("o_orderkey") % 3).cast("int").alias("exit_code"),
                    F.when(c("o_orderkey") % 11 == 0, "SIGKILL").alias("exit_signal"), (c("o_orderkey") % 5 == 0).alias("attach"))


RUNS = """WITH runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS session_id, '/usr/bin/job' || (o_orderkey % 7) || ' --x' AS command,
 epoch_us(o_orderdate) AS started_us, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'analyzing' END AS status,
 CAST(o_orderkey % 3 AS INT) AS exit_code, CASE WHEN o_orderkey % 11 = 0 THEN 'SIGKILL' END AS exit_signal, o_orderkey % 5 = 0 AS attach FROM orders)
"""


@register("run_labels", RUNS + """SELECT run_id, regexp_extract(command, 'job[0-9]', 0) AS name, CASE WHEN status <> 'completed' THEN status WHEN attach THEN 'target exited'
 WHEN exit_signal IS NOT NULL THEN exit_signal WHEN exit_code = 0 THEN 'ok' ELSE 'exit ' || exit_code END AS label,
 CASE WHEN status <> 'completed' THEN 'running' WHEN attach THEN 'ok' WHEN exit_code = 0 THEN 'ok' ELSE 'fail' END AS label_class FROM runs""")
def run_labels(spark, d):
    r = _runs(spark, d)
    return r.select("run_id", command_name("command").alias("name"),
                    run_label(c("status"), c("attach"), c("exit_code"), c("exit_signal")).alias("label"),
                    run_class(c("status"), c("attach"), c("exit_code")).alias("label_class"))


@register("recent_runs", RUNS + "SELECT run_id, session_id, started_us FROM runs ORDER BY started_us DESC, run_id DESC LIMIT 200 OFFSET 40")
def recent_runs(spark, d):
    return catalog.recent_runs(_runs(spark, d), 200, 40).select("run_id", "session_id", "started_us")


@register("runs_by_session", RUNS + """SELECT session_id, run_id, row_number() OVER (PARTITION BY session_id ORDER BY started_us DESC, run_id DESC) AS rank,
 count(*) OVER (PARTITION BY session_id) AS runs FROM runs""")
def runs_by_session(spark, d):
    return catalog.run_places(_runs(spark, d))


@register("reconciled_runs", RUNS + "SELECT run_id, CASE WHEN status = 'completed' THEN status ELSE 'error' END AS status FROM runs")
def reconciled_runs(spark, d):
    return catalog.reconcile(_runs(spark, d)).select("run_id", "status")


@register("stale_runs", RUNS + """SELECT run_id FROM runs WHERE status = 'running' AND started_us < (SELECT max(started_us) FROM runs) - 86400000000
 AND run_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)""")
def stale_runs(spark, d):
    r = _runs(spark, d)
    seen = spark.read.parquet(f"{d}/lineitem.parquet").select(c("l_orderkey").cast("string").alias("run_id"))
    now = r.agg(F.max("started_us")).first()[0]
    return catalog.stale_runs(r, seen, now, 86_400_000_000).select("run_id")


@register("finalised_runs", RUNS + """
, e AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, max(epoch_us(l_shipdate)) AS ended_us FROM lineitem GROUP BY 1),
 s AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'high' WHEN bool_or(l_returnflag = 'A') THEN 'low' ELSE 'clean' END AS sev FROM lineitem GROUP BY 1)
SELECT run_id, e.ended_us, greatest(0, (e.ended_us - started_us) // 1000) AS duration_ms, 'completed' AS status, sev AS max_severity FROM runs JOIN e USING (run_id) JOIN s USING (run_id)""")
def finalised_runs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("run_id", c("l_orderkey").cast("string"))
    ends = li.groupBy("run_id").agg(F.max(F.unix_micros(c("l_shipdate").cast("timestamp"))).alias("ended_us")).withColumns({
        "exit_code": F.lit(0), "exit_signal": F.lit(None).cast("string")})
    found = li.select("run_id", F.when(c("l_returnflag") == "R", "high").when(c("l_returnflag") == "A", "low").otherwise("clean").alias("severity"))
    done = catalog.finalise(_runs(spark, d), ends, rules.max_severity(found, li.select("run_id")))
    return done.where("ended_us IS NOT NULL").select("run_id", "ended_us", "duration_ms", "status", "max_severity")


@register("retention", RUNS + """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS rows_left FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN
 (SELECT run_id FROM runs WHERE session_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')) GROUP BY 1""")
def retention(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(c("l_orderkey").cast("string").alias("run_id"))
    gone = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").cast("string").alias("session_id"))
    left = catalog.without_runs(li, catalog.runs_of_sessions(_runs(spark, d), gone))
    return left.groupBy("run_id").agg(F.count("*").alias("rows_left"))


@register("metric_upsert", """WITH m AS (SELECT 'run-' || CAST(user_id % 5 AS VARCHAR) AS run_id, epoch_us(ts) // 3600000000 AS hour, value, event_id FROM events)
SELECT run_id, hour * 3600000000 AS ts_us, arg_max(value, event_id) AS cpu_pct FROM m GROUP BY 1, 2""")
def metric_upsert(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    hour = (F.floor(F.unix_micros(c("ts").cast("timestamp")) / 3_600_000_000) * 3_600_000_000).cast("long")
    m = e.select(F.concat(F.lit("run-"), (c("user_id") % 5).cast("string")).alias("run_id"), hour.alias("ts_us"),
                 c("value").alias("cpu_pct"), c("event_id").alias("ingest_seq"))
    return catalog.latest_samples(m)


@register("stored_events", with_views("trace_events", sql="""
SELECT run_id, seq, ts_us, syscall FROM trace_events WHERE run_id = 'run-2' ORDER BY ts_us, seq LIMIT 5000"""))
def stored_events(spark, d):
    return catalog.read_events(_ev(spark, d), "run-2").select("run_id", "seq", "ts_us", "syscall")


@register("stored_metrics", with_views("metrics", sql="""
, n AS (SELECT run_id, ts_us, cpu_pct, row_number() OVER (ORDER BY ts_us) - 1 AS i, count(*) OVER () AS n FROM metrics WHERE run_id = 'run-2')
SELECT run_id, ts_us, cpu_pct FROM n WHERE i % CAST(ceil(n / 300.0) AS BIGINT) = 0"""))
def stored_metrics(spark, d):
    return catalog.read_metrics(view(spark, d, "metrics"), "run-2", 300).select("run_id", "ts_us", "cpu_pct")


@register("stored_spans", with_views("http_spans", sql="""
SELECT run_id, span_id, start_ns // 1000 AS ts_us FROM http_spans WHERE run_id = 'run-1' AND start_ns // 1000 BETWEEN 1000000 AND 90000000 ORDER BY ts_us DESC, span_id DESC LIMIT 500"""))
def stored_spans(spark, d):
    h = view(spark, d, "http_spans").withColumn("ts_us", F.floor(c("start_ns") / 1000))
    return catalog.read_spans(h, "run-1", 1_000_000, 90_000_000).select("run_id", "span_id", "ts_us")


@register("byte_texts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0) ELSE
 printf('%.1fMB', b / 1048576.0) END AS size FROM (SELECT *, CAST(round(l_extendedprice) AS BIGINT) * 37 + 1 AS b FROM lineitem)""")
def byte_texts(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     bytes_text(F.round("l_extendedprice").cast("long") * 37 + 1).alias("size"))
