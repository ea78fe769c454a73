"""Queries over findings of every source. Their SQL is put together from that of the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..operators import rules
from ..operators import series as ops
from . import ORACLES, QUERIES, register
from .rules import SHOWN, all_findings

c = F.col

# The samples are taken as a hundred times as dense: memory then grows by about a megabyte a minute.
DENSE = ", metrics_ AS (SELECT * REPLACE (ts_us // 100 AS ts_us) FROM metrics)"
LEAKS = DENSE + """
, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n,
   lag(rss_mb) OVER (PARTITION BY run_id ORDER BY ts_us) AS pv FROM metrics_),
 hd AS (SELECT run_id, list_sort(list(round(rss_mb * 1000))) AS l FROM n WHERE i < greatest(2, n // 10) GROUP BY 1),
 tl AS (SELECT run_id, list_sort(list(round(rss_mb * 1000))) AS l FROM n WHERE i >= n - greatest(2, n // 10) GROUP BY 1),
 st AS (SELECT run_id, count(*) AS n, min(ts_us) AS a, max(ts_us) AS z, count(*) FILTER (WHERE rss_mb >= pv - 0.5) / count(*) AS share FROM n GROUP BY 1),
 g AS (SELECT st.*, least(hd.l[1], hd.l[len(hd.l) // 2 + 1]) / 1000.0 AS low, tl.l[len(tl.l) // 2 + 1] / 1000.0 AS high FROM st JOIN hd USING (run_id) JOIN tl USING (run_id))
SELECT run_id, 'slow_memory_leak' AS rule_id, 'high' AS severity, 0.7::DOUBLE AS severity_score, printf('Slow memory leak: %.0f to %.0f MB, %.1f MB/min', low, high,
 (high - low) / ((z - a) / 60000000.0)) AS title, z AS last_seen_us FROM g WHERE n >= 20 AND z - a >= 180000000 AND high - low >= 50 AND (high - low) / ((z - a) / 60000000.0) >= 0.5 AND share >= 0.7"""


@register("slow_memory_leaks", with_views("metrics", sql=LEAKS))
def slow_memory_leaks(spark, d):
    dense = view(spark, d, "metrics").withColumn("ts_us", F.floor(c("ts_us") / 100))
    return rules.slow_leak_findings(dense)


SOURCES = ["rule_findings", "slow_memory_leaks", "custom_rule_findings", "malloc_findings", "endpoint_findings"]
UNION = " UNION ALL ".join(f"SELECT run_id, rule_id, severity, severity_score, '{s}' AS source FROM ({ORACLES[s]}) AS {s}" for s in SOURCES)


@register("finding_union", f"SELECT *, CAST(rank() OVER (PARTITION BY run_id ORDER BY severity_score DESC, rule_id) AS INT) AS place FROM ({UNION}) AS u")
def finding_union(spark, d):
    """The findings of all sources, with their place in the order by score within the run."""
    parts = [QUERIES[s](spark, d).select("run_id", "rule_id", "severity", c("severity_score").cast("double").alias("severity_score"), F.lit(s).alias("source")) for s in SOURCES]
    return rules.placed(rules.union_findings(*parts))


@register("time_domain", f"""SELECT run_id, min(a) AS first_us, max(z) AS last_us FROM (
 SELECT run_id, ts_us AS a, ts_us AS z FROM ({with_views("metrics", sql="SELECT * FROM metrics")}) AS m
 UNION ALL SELECT run_id, ts_us, ts_us FROM ({with_views("trace_events", sql="SELECT * FROM trace_events")}) AS e
 UNION ALL SELECT run_id, first_seen_us, last_seen_us FROM ({ORACLES["rule_findings"]}) AS f) GROUP BY 1""")
def time_domain(spark, d):
    return ops.time_domain((view(spark, d, "metrics"), "ts_us", "ts_us"), (view(spark, d, "trace_events"), "ts_us", "ts_us"),
                           (all_findings(spark, d), "first_seen_us", "last_seen_us"))
