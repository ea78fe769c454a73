"""Stacks, allocations, library calls, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import duck, view, with_views
from ..operators import latency, ledger, profiles
from ..operators import calls as call_ops
from . import register

c = F.col


def _stacks(spark, d):
    return view(spark, d, "stacks").select("run_id", profiles.frames_of(c("folded")).alias("frames"), "weight")


PATHS = """
, s AS (SELECT run_id, string_split(folded, ';') AS fr, weight FROM stacks WHERE weight > 0),
 n AS (SELECT run_id, CAST(sum(weight) AS BIGINT) AS samples FROM s GROUP BY 1),
 nd AS (SELECT run_id, array_to_string(fr[1:k], ';') AS path, k AS depth, CAST(sum(weight) AS BIGINT) AS value
   FROM (SELECT *, unnest(range(1, len(fr) + 1)) AS k FROM s) GROUP BY 1, 2, 3),
 hs AS (SELECT run_id, fn AS function, CAST(sum(CASE WHEN fn = fr[-1] THEN weight ELSE 0 END) AS BIGINT) AS self, CAST(sum(weight) AS BIGINT) AS total
   FROM (SELECT run_id, fr, weight, unnest(list_distinct(fr)) AS fn FROM s) GROUP BY 1, 2),
 hp AS (SELECT hs.*, CAST(row_number() OVER (PARTITION BY run_id ORDER BY self DESC, total DESC, function) AS INT) AS rank FROM hs),
 kept AS (SELECT nd.* FROM nd JOIN n USING (run_id) WHERE value >= greatest(1, round_even(samples * 0.004::DOUBLE, 0)))
"""


@register("flame_paths", with_views("stacks", sql=PATHS + "SELECT run_id, path, CAST(depth AS INT) AS depth, value FROM kept"))
def flame_paths(spark, d):
    return profiles.flame_paths(_stacks(spark, d)).select("run_id", F.array_join("path", ";").alias("path"), "depth", "value")


@register("thread_flames", with_views("stacks", sql=PATHS.replace("FROM stacks", "FROM (SELECT run_id || ':' || CAST(weight % 3 AS VARCHAR) AS run_id, folded, weight FROM stacks)")
          + "SELECT run_id AS thread, path, CAST(depth AS INT) AS depth, value FROM kept"))
def thread_flames(spark, d):
    s = _stacks(spark, d).withColumn("tid", c("weight") % 3)
    f = profiles.flame_paths(s, ["run_id", "tid"])
    return f.select(F.concat_ws(":", "run_id", c("tid").cast("string")).alias("thread"), F.array_join("path", ";").alias("path"),
                    "depth", "value")


@register("hotspots", with_views("stacks", sql=PATHS + """
SELECT run_id, function, self, total, self * 100 / samples AS self_pct, total * 100 / samples AS total_pct, rank FROM hp JOIN n USING (run_id) WHERE rank <= 60"""))
def hotspots(spark, d):
    return profiles.hotspots(_stacks(spark, d))


@register("dominant_path", with_views("stacks", sql=PATHS + """
, ch AS (SELECT *, regexp_replace(path, ';?[^;]*$', '') AS parent FROM kept),
 b AS (SELECT run_id, parent, path FROM (SELECT *, row_number() OVER (PARTITION BY run_id, parent ORDER BY value DESC, path) AS rn FROM ch) WHERE rn = 1)
SELECT a.run_id, coalesce(e.path, f.path, a.path) AS stack FROM b a LEFT JOIN b f ON f.run_id = a.run_id AND f.parent = a.path
 LEFT JOIN b e ON e.run_id = f.run_id AND e.parent = f.path WHERE a.parent = ''"""))
def dominant_path(spark, d):
    return profiles.dominant_path(_stacks(spark, d)).select("run_id", F.array_join("stack", ";").alias("stack"))


@register("hot_context", with_views("stacks", sql=PATHS + """
SELECT n.run_id, samples, (SELECT string_agg(function, ',' ORDER BY rank) FROM hp WHERE hp.run_id = n.run_id AND rank <= 5) AS functions FROM n"""))
def hot_context(spark, d):
    h = profiles.hot_context(_stacks(spark, d))
    return h.select("run_id", "samples", F.array_join("functions", ",").alias("functions"))


@register("hot_function", with_views("stacks", sql=PATHS.replace("string_split(folded, ';')", "string_split(regexp_replace(folded, '^[^;]*;[^;]*;', ''), ';')") + """
SELECT run_id, 'hot_function' AS rule_id, CASE WHEN self * 100.0 / samples >= 50 THEN 'high' ELSE 'medium' END AS severity, function
FROM hp JOIN n USING (run_id) WHERE rank = 1 AND self * 100.0 / samples >= 20"""))
def hot_function(spark, d):
    # Leaves only, and the medium limit lowered to 20 %: five leaf names share the weight.
    s = _stacks(spark, d).withColumn("frames", F.slice("frames", 3, 1))
    found = profiles.hot_function_findings(s, medium=20.0)
    return found.select("run_id", "rule_id", "severity", F.regexp_extract("description", "^(.*) takes ", 1).alias("function"))


ORDER = ["seq", "seq2", "seq3"]


def _alloc(spark, d):
    v = view(spark, d, "lib_calls")
    fn, is_free = c("fn"), c("fn") == "free"
    return v.select("run_id", *ORDER, "fn", is_free.alias("is_free"), F.when(fn.isin("free", "realloc"), c("ptr")).alias("old"),
                    F.when(fn == "malloc", c("ptr")).when(fn == "realloc", c("ptr") + 200).alias("ptr"),
                    F.when(~is_free, c("size")).alias("size"))


# The oracle numbers the rows of the whole table, which is the same order.
NUMBERED = "lib_calls AS (SELECT * REPLACE (row_number() OVER (ORDER BY seq, seq2, seq3) AS seq) FROM (" + duck("lib_calls") + "))"
STEPS = f"""WITH {NUMBERED},
 st AS (SELECT run_id, seq, 0 AS sub, ptr, CAST(NULL AS BIGINT) AS size, fn FROM lib_calls WHERE fn IN ('free', 'realloc')
  UNION ALL SELECT run_id, seq, 1, CASE WHEN fn = 'realloc' THEN ptr + 200 ELSE ptr END, size, fn FROM lib_calls WHERE fn IN ('malloc', 'realloc')),
 hd AS (SELECT *, CASE WHEN lag(sub) OVER w = 1 THEN lag(size) OVER w END AS held FROM st WINDOW w AS (PARTITION BY run_id, ptr ORDER BY seq, sub)),
 lv AS (SELECT *, sum(CASE WHEN sub = 1 THEN size ELSE -coalesce(held, 0) END) OVER (PARTITION BY run_id ORDER BY seq, sub ROWS UNBOUNDED PRECEDING) AS live FROM hd),
 tt AS (SELECT run_id, CAST(sum(CASE WHEN sub = 1 THEN size ELSE 0 END) AS BIGINT) AS bytes_allocated, CAST(sum(CASE WHEN sub = 0 THEN coalesce(held, 0) ELSE 0 END) AS BIGINT) AS bytes_freed,
   CAST(greatest(0, max(live) FILTER (WHERE sub = 1)) AS BIGINT) AS peak_live_bytes, count(*) FILTER (WHERE fn = 'free' AND held IS NULL) AS free_unmatched FROM lv GROUP BY 1),
 ls AS (SELECT run_id, ptr, arg_max(sub, seq * 2 + sub) AS sub, arg_max(coalesce(size, -1), seq * 2 + sub) AS size FROM st GROUP BY 1, 2),
 ll AS (SELECT run_id, ptr, size FROM ls WHERE sub = 1),
 lg AS (SELECT n.run_id, n_alloc, n_free, bytes_allocated, bytes_freed, peak_live_bytes, outstanding_bytes, outstanding_blocks, free_unmatched
   FROM (SELECT run_id, count(*) FILTER (WHERE fn <> 'free') AS n_alloc, count(*) FILTER (WHERE fn = 'free') AS n_free FROM lib_calls GROUP BY 1) n
   JOIN tt USING (run_id) JOIN (SELECT run_id, CAST(sum(size) AS BIGINT) AS outstanding_bytes, count(*) AS outstanding_blocks FROM ll GROUP BY 1) USING (run_id))
"""


@register("malloc_profile", STEPS + "SELECT * FROM lg")
def malloc_profile(spark, d):
    return ledger.ledger(_alloc(spark, d), ORDER)


@register("malloc_calls", STEPS + "SELECT run_id, fn AS function, count(*) AS calls FROM lib_calls GROUP BY 1, 2")
def malloc_calls(spark, d):
    return ledger.calls_by_function(_alloc(spark, d))


@register("malloc_top_sizes", STEPS + """
, n AS (SELECT run_id, size, count(*) AS cnt, min(seq) AS f FROM st WHERE sub = 1 GROUP BY 1, 2)
SELECT run_id, size, cnt AS "count", rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, f) AS INT) AS rank FROM n) WHERE rank <= 8""")
def malloc_top_sizes(spark, d):
    return ledger.top_sizes(_alloc(spark, d), ORDER)


@register("malloc_largest_live", STEPS + """
SELECT run_id, ptr, size, addr, rank FROM (SELECT *, '0x' || lower(hex(ptr)) AS addr, CAST(row_number() OVER (PARTITION BY run_id ORDER BY size DESC, ptr) AS INT) AS rank FROM ll) WHERE rank <= 10""")
def malloc_largest_live(spark, d):
    return ledger.largest_live(_alloc(spark, d), ORDER)


@register("malloc_findings", STEPS + """
SELECT run_id, 'allocation_storm' AS rule_id, 'medium' AS severity, 0.5::DOUBLE AS severity_score FROM lg WHERE n_alloc + n_free >= 20000
UNION ALL SELECT run_id, 'heap_leak', 'high', 0.7::DOUBLE FROM lg WHERE outstanding_bytes >= 262144 OR outstanding_blocks >= 64
UNION ALL SELECT run_id, 'alloc_free_imbalance', 'medium', 0.5::DOUBLE FROM lg WHERE n_alloc >= 200 AND n_free > 0 AND n_alloc >= 4 * n_free
UNION ALL SELECT run_id, 'free_unmatched', 'medium', 0.45::DOUBLE FROM lg WHERE free_unmatched >= 16""")
def malloc_findings(spark, d):
    f = ledger.ledger_findings(ledger.ledger(_alloc(spark, d), ORDER))
    return f.select("run_id", "rule_id", "severity", "severity_score")


@register("libcall_stats", with_views("lib_calls", sql="""
SELECT run_id, fn AS function, count(*) AS calls, CAST(sum(lat_us) AS BIGINT) / 1000.0 AS total_ms,
 CAST(sum(lat_us) AS BIGINT) / count(*) / 1000.0 AS avg_ms, 0 AS errors FROM lib_calls GROUP BY 1, 2"""))
def libcall_stats(spark, d):
    v = view(spark, d, "lib_calls").withColumn("syscall", c("fn")).withColumn("error", F.lit(None).cast("string"))
    return call_ops.library_calls(v)


HIST = """
, h AS (SELECT run_id, CASE WHEN lat_us < 2 THEN 0 ELSE CAST(floor(log2(lat_us)) AS INT) END AS e, count(*) AS n FROM trace_events GROUP BY 1, 2),
 b AS (SELECT run_id, CASE WHEN e = 0 THEN 0 ELSE CAST(1 << e AS BIGINT) END AS lo, CAST((2 << e) - 1 AS BIGINT) AS hi, n AS "count" FROM h)
"""


@register("latency_histogram", with_views("trace_events", sql=HIST + "SELECT * FROM b"))
def latency_histogram(spark, d):
    return latency.log2_histogram(view(spark, d, "trace_events"), "lat_us", "runqueue").select("run_id", "lo", "hi", "count")


SUMMARY = HIST + """
, u AS (SELECT *, sum("count") OVER (PARTITION BY run_id) AS total, sum("count") OVER (PARTITION BY run_id ORDER BY lo) AS upto FROM b),
 sm AS (SELECT run_id, CAST(max(total) AS BIGINT) AS total, min(hi) FILTER (WHERE upto >= 0.5 * total) AS p50, min(hi) FILTER (WHERE upto >= 0.9 * total) AS p90,
   min(hi) FILTER (WHERE upto >= 0.99 * total) AS p99, max(hi) AS max FROM u GROUP BY 1)
"""


@register("histogram_summary", with_views("trace_events", sql=SUMMARY + "SELECT run_id, total, p50, p90, p99, max FROM sm"))
def histogram_summary(spark, d):
    s = latency.histogram_summary(latency.log2_histogram(view(spark, d, "trace_events"), "lat_us", "runqueue"))
    return s.select("run_id", "total", "p50", "p90", "p99", "max")


@register("latency_findings", with_views("trace_events", sql=SUMMARY + """
SELECT run_id, 'high_runqueue_latency' AS rule_id, CASE WHEN p99 / 1000.0 >= 50 THEN 'high' ELSE 'medium' END AS severity FROM sm WHERE round_even(p99 / 1000.0, 0) >= 10"""))
def latency_findings(spark, d):
    s = latency.histogram_summary(latency.log2_histogram(view(spark, d, "trace_events"), "lat_us", "runqueue"))
    return latency.latency_findings(s).select("run_id", "rule_id", "severity")


@register("block_io_stats", with_views("trace_events", sql="""
, r AS (SELECT run_id, lat_us * 1000 AS ns, syscall, TRY_CAST(retval AS BIGINT) AS b, row_number() OVER (PARTITION BY run_id ORDER BY lat_us) - 1 AS i,
   count(*) OVER (PARTITION BY run_id) AS n FROM trace_events WHERE syscall IN ('read', 'write'))
SELECT run_id, count(*) AS "count", CAST(sum(ns) AS BIGINT) / 1000000.0 AS total_ms, max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN ns END) / 1000000.0 AS p50_ms,
 max(CASE WHEN i = round_even(0.99 * (n - 1), 0) THEN ns END) / 1000000.0 AS p99_ms, max(ns) / 1000000.0 AS max_ms, count(*) FILTER (WHERE syscall = 'read') AS read_count,
 count(*) FILTER (WHERE syscall = 'write') AS write_count, CAST(sum(b) AS BIGINT) AS bytes_total FROM r GROUP BY 1"""))
def block_io_stats(spark, d):
    e = view(spark, d, "trace_events").where(c("syscall").isin("read", "write"))
    return latency.block_io_stats(e.select("run_id", (c("lat_us") * 1000).alias("lat_ns"), F.upper("syscall").alias("rw"),
                                           c("retval").cast("long").alias("bytes")))


@register("pause_stats", with_views("trace_events", sql="""
SELECT run_id, count(*) AS "count", CAST(sum(lat_us) AS BIGINT) / 1000.0 AS total_ms, max(lat_us) / 1000.0 AS max_ms,
 CAST(sum(lat_us) AS BIGINT) / count(*) / 1000.0 AS avg_ms FROM trace_events WHERE syscall = 'futex' GROUP BY 1"""))
def pause_stats(spark, d):
    e = view(spark, d, "trace_events").where("syscall = 'futex'")
    return latency.pause_stats(e.select("run_id", c("lat_us").alias("dur_us")))
