"""Requests, queries, thread intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import view, with_views
from ..functions.scalars import route_template, scrub_sql, sql_name
from ..operators import spans as ops
from . import register

c = F.col
DB_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

OWNED = """
, pr AS (SELECT d.*, h.span_id AS owner_id, h.start_ns AS owner_start, h.dur_ns AS owner_dur,
   row_number() OVER (PARTITION BY d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey ORDER BY h.start_ns DESC, h.span_id DESC) AS rn
   FROM db_spans d JOIN http_spans h ON d.run_id = h.run_id AND d.tid = h.tid AND h.start_ns <= d.start_ns
   AND d.start_ns <= h.start_ns + h.dur_ns),
 owned AS (SELECT * FROM pr WHERE rn = 1),
 t AS (SELECT h.*, least(coalesce(s.q, 0), h.dur_ns) AS db_ns, coalesce(s.n, 0) AS db_count,
   '/orders/{id}/' || regexp_extract(route, '([a-z]+)$', 1) AS tpl
   FROM http_spans h LEFT JOIN (SELECT run_id, owner_id, CAST(sum(dur_ns) AS BIGINT) AS q, count(*) AS n FROM owned GROUP BY 1, 2) s
   ON s.run_id = h.run_id AND s.owner_id = h.span_id)
"""
EP = """
, ep AS (SELECT run_id, method, tpl AS route, count(*) AS cnt, quantile_cont(dur_ns, 0.5) AS p50, quantile_cont(dur_ns, 0.95) AS p95,
   quantile_cont(dur_ns, 0.99) AS p99, count(*) FILTER (WHERE status >= 500) AS errs, CAST(sum(dur_ns) AS BIGINT) AS total,
   CAST(sum(db_ns) AS BIGINT) AS db FROM t GROUP BY 1, 2, 3)
"""
BREAK = OWNED + """
, iv AS (SELECT *, row_number() OVER () AS iv_id FROM thread_intervals WHERE dur_ns > 0),
 ov AS (SELECT h.run_id, h.tid, h.span_id, h.dur_ns AS h_dur, i.kind, i.reason, i.iv_id, i.start_ns AS i0, i.start_ns + i.dur_ns AS i1,
   least(i.start_ns + i.dur_ns, h.start_ns + h.dur_ns) - greatest(i.start_ns, h.start_ns) AS ov
   FROM http_spans h JOIN iv i ON h.run_id = i.run_id AND h.tid = i.tid AND i.start_ns < h.start_ns + h.dur_ns
   AND h.start_ns < i.start_ns + i.dur_ns),
 dbo AS (SELECT ov.span_id, ov.iv_id, CAST(sum(greatest(0, least(i1, o.start_ns + o.dur_ns) - greatest(i0, o.start_ns))) AS BIGINT) AS s
   FROM ov JOIN owned o ON o.owner_id = ov.span_id AND o.start_ns < i1 AND i0 < o.start_ns + o.dur_ns WHERE ov.kind = 'off' GROUP BY 1, 2),
 p AS (SELECT ov.*, CASE WHEN kind = 'off' THEN least(coalesce(s, 0), ov) ELSE 0 END AS dbov FROM ov LEFT JOIN dbo
   ON dbo.span_id = ov.span_id AND dbo.iv_id = ov.iv_id),
 g AS (SELECT span_id, CAST(sum(CASE WHEN kind = 'off' THEN ov ELSE 0 END) AS BIGINT) AS off_raw,
   CAST(sum(CASE WHEN kind = 'rq' THEN ov ELSE 0 END) AS BIGINT) AS rq_raw, CAST(sum(dbov) AS BIGINT) AS db_wait,
   CAST(sum(CASE WHEN kind = 'off' AND reason = 'net' THEN ov - dbov ELSE 0 END) AS BIGINT) AS r_net,
   CAST(sum(CASE WHEN kind = 'off' AND reason = 'lock' THEN ov - dbov ELSE 0 END) AS BIGINT) AS r_lock,
   CAST(sum(CASE WHEN kind = 'off' AND reason = 'sleep' THEN ov - dbov ELSE 0 END) AS BIGINT) AS r_sleep,
   CAST(sum(CASE WHEN kind = 'off' AND reason = 'disk' THEN ov - dbov ELSE 0 END) AS BIGINT) AS r_disk,
   CAST(sum(CASE WHEN kind = 'off' AND reason = 'other' THEN ov - dbov ELSE 0 END) AS BIGINT) AS r_other FROM p GROUP BY 1),
 m AS (SELECT h.run_id, h.span_id, h.method, h.tpl, h.dur_ns, least(coalesce(off_raw, 0), h.dur_ns) AS off_ns, coalesce(rq_raw, 0) AS rq_raw,
   coalesce(db_wait, 0) AS db_wait_ns, coalesce(r_net, 0) AS r_net, coalesce(r_lock, 0) AS r_lock, coalesce(r_sleep, 0) AS r_sleep,
   coalesce(r_disk, 0) AS r_disk, coalesce(r_other, 0) AS r_other FROM t h LEFT JOIN g USING (span_id)),
 bd AS (SELECT *, least(rq_raw, greatest(0, dur_ns - off_ns)) AS runq_ns, greatest(0, off_ns - db_wait_ns) AS other_off_ns,
   greatest(0, dur_ns - off_ns - least(rq_raw, greatest(0, dur_ns - off_ns))) AS on_cpu_ns FROM m)
"""


def _http(spark, d):
    return view(spark, d, "http_spans")


def _timed(spark, d):
    h, q = _http(spark, d), view(spark, d, "db_spans")
    return ops.with_db_time(h, ops.own_queries(h, q, DB_KEY))


@register("query_owner", with_views("http_spans", "db_spans", sql=OWNED + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, start_ns, owner_id FROM owned"""))
def query_owner(spark, d):
    return ops.own_queries(_http(spark, d), view(spark, d, "db_spans"), DB_KEY).select(*DB_KEY, "start_ns", "owner_id")


@register("request_db_time", with_views("http_spans", "db_spans", sql=OWNED + """
SELECT run_id, span_id, dur_ns, db_ns, db_count FROM t"""))
def request_db_time(spark, d):
    return _timed(spark, d).select("run_id", "span_id", "dur_ns", "db_ns", "db_count")


@register("endpoint_red", with_views("http_spans", "db_spans", sql=OWNED + EP + """
SELECT run_id, method, route, cnt AS "count", round(p50 / 1000000.0, 6) AS p50_ms, round(p95 / 1000000.0, 6) AS p95_ms,
 round(p99 / 1000000.0, 6) AS p99_ms, errs * 100.0 / cnt AS err_pct, least(1.0, db / total) AS db_ms_share FROM ep"""))
def endpoint_red(spark, d):
    e = ops.endpoints(_timed(spark, d))
    return e.select("run_id", "method", "route", "count", *[F.round(q, 6).alias(q) for q in ("p50_ms", "p95_ms", "p99_ms")],
                    "err_pct", "db_ms_share")


@register("request_breakdown", with_views("http_spans", "db_spans", "thread_intervals", sql=BREAK + """
SELECT run_id, span_id, on_cpu_ns, runq_ns, db_wait_ns, other_off_ns, nullif(greatest(r_net, 0), 0) AS net_ns, nullif(greatest(r_lock, 0), 0) AS lock_ns,
 nullif(greatest(r_sleep, 0), 0) AS sleep_ns, nullif(greatest(r_disk, 0), 0) AS disk_ns, nullif(greatest(r_other, 0), 0) AS other_ns FROM bd"""))
def request_breakdown(spark, d):
    h, q = _http(spark, d), view(spark, d, "db_spans")
    b = ops.breakdown(h, ops.own_queries(h, q, DB_KEY), view(spark, d, "thread_intervals"))
    return b.select("run_id", "span_id", "on_cpu_ns", "runq_ns", "db_wait_ns", "other_off_ns",
                    *[F.element_at("off_reasons", r).alias(f"{r}_ns") for r in ("net", "lock", "sleep", "disk", "other")])


@register("endpoint_breakdown", with_views("http_spans", "db_spans", "thread_intervals", sql=BREAK + """
, s AS (SELECT run_id, method, tpl AS route, CAST(sum(on_cpu_ns) AS BIGINT) AS a, CAST(sum(runq_ns) AS BIGINT) AS b, CAST(sum(db_wait_ns) AS BIGINT) AS d,
  CAST(sum(other_off_ns) AS BIGINT) AS o, sum(r_net) AS rn, sum(r_lock) AS rl, sum(r_sleep) AS rs, sum(r_disk) AS rd, sum(r_other) AS ro FROM bd GROUP BY 1, 2, 3)
SELECT run_id, method, route, a / 1000000.0 AS on_cpu_ms, b / 1000000.0 AS runq_ms, d / 1000000.0 AS db_wait_ms, o / 1000000.0 AS other_off_ms,
 a * 100.0 / (a + b + d + o) AS on_cpu_pct, b * 100.0 / (a + b + d + o) AS runq_pct, d * 100.0 / (a + b + d + o) AS db_wait_pct,
 o * 100.0 / (a + b + d + o) AS other_off_pct, CASE greatest(rn, rl, rs, rd, ro) WHEN 0 THEN NULL WHEN rn THEN 'net' WHEN rl THEN 'lock'
 WHEN rs THEN 'sleep' WHEN rd THEN 'disk' ELSE 'other' END AS top_off_reason FROM s"""))
def endpoint_breakdown(spark, d):
    h, q = _http(spark, d), view(spark, d, "db_spans")
    return ops.endpoint_breakdown(ops.breakdown(h, ops.own_queries(h, q, DB_KEY), view(spark, d, "thread_intervals")))


@register("over_p95_requests", with_views("http_spans", "db_spans", sql=OWNED + EP + """
SELECT t.run_id, t.span_id, t.dur_ns FROM t JOIN ep ON ep.run_id = t.run_id AND ep.method = t.method AND ep.route = t.tpl
WHERE status >= 500 OR dur_ns / 1000000.0 >= ep.p95 / 1000000.0"""))
def over_p95_requests(spark, d):
    h = _timed(spark, d)
    return ops.over_threshold(h, ops.endpoints(h)).select("run_id", "span_id", "dur_ns")


@register("curated_spans", with_views("http_spans", "db_spans", sql=OWNED + EP + """
, x AS (SELECT t.run_id, t.span_id, t.dur_ns, t.db_ns, CAST(row_number() OVER (PARTITION BY t.run_id ORDER BY dur_ns DESC, span_id) AS INT) AS rank,
  t.start_ns FROM t JOIN ep ON ep.run_id = t.run_id AND ep.method = t.method AND ep.route = t.tpl
  WHERE status >= 500 OR dur_ns / 1000000.0 >= ep.p95 / 1000000.0)
SELECT run_id, span_id, dur_ns, db_ns, rank, round(1700000000.0 * 1000.0 + (start_ns * 1e-9 - 12.5) * 1000.0, 1) AS timestamp_ms FROM x WHERE rank <= 200"""))
def curated_spans(spark, d):
    h = _timed(spark, d)
    anchors = h.select("run_id").distinct().select("run_id", F.lit(12.5).alias("mono0"), F.lit(1_700_000_000.0).alias("wall0"))
    kept = ops.curated(h, ops.endpoints(h))
    return ops.epoch_time(kept, anchors).select("run_id", "span_id", "dur_ns", "db_ns", "rank", "timestamp_ms")


@register("slowest_requests", with_views("http_spans", "db_spans", sql=OWNED + """
, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY dur_ns DESC, span_id) AS INT) AS rank FROM t)
SELECT x.run_id, x.span_id, x.rank, x.dur_ns, x.db_ns, (SELECT string_agg(o.start_ns || ':' || o.dur_ns, ',' ORDER BY o.start_ns, o.l_orderkey,
 o.l_linenumber, o.l_partkey, o.l_suppkey) FROM owned o WHERE o.owner_id = x.span_id) AS queries FROM x WHERE rank <= 50"""))
def slowest_requests(spark, d):
    h, q = _http(spark, d), view(spark, d, "db_spans")
    owned = ops.own_queries(h, q, DB_KEY)
    s = ops.slowest_requests(ops.with_db_time(h, owned), owned, q, DB_KEY)
    text = F.array_join(F.transform("queries", lambda x: F.concat_ws(":", x["start_ns"].cast("string"),
                                                                     x["dur_ns"].cast("string"))), ",")
    return s.select("run_id", "span_id", "rank", "dur_ns", "db_ns", text.alias("queries"))


@register("waterfall", with_views("http_spans", "db_spans", sql=OWNED + """
, x AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dur_ns DESC, span_id) AS rank FROM t)
SELECT o.run_id, o.owner_id AS span_id, o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey,
 (o.start_ns - o.owner_start) * 100.0 / greatest(o.owner_dur, 1) AS offset_pct, o.dur_ns * 100.0 / greatest(o.owner_dur, 1) AS width_pct
FROM owned o JOIN x ON x.span_id = o.owner_id WHERE x.rank <= 50"""))
def waterfall(spark, d):
    h, q = _http(spark, d), view(spark, d, "db_spans")
    owned = ops.own_queries(h, q, DB_KEY)
    s = ops.slowest_requests(ops.with_db_time(h, owned), owned, q, DB_KEY).select("run_id", "span_id", F.explode("queries").alias("q"))
    return s.select("run_id", "span_id", *[f"q.{k}" for k in DB_KEY], "q.offset_pct", "q.width_pct")


@register("request_counts", with_views("http_spans", "db_spans", "thread_intervals", sql="""
SELECT run_id, (SELECT count(*) FROM http_spans h WHERE h.run_id = r.run_id) AS request_count,
 (SELECT count(*) FROM db_spans d WHERE d.run_id = r.run_id) AS db_span_count,
 EXISTS (SELECT 1 FROM thread_intervals i WHERE i.run_id = r.run_id) AS has_breakdown FROM (SELECT DISTINCT run_id FROM http_spans) r"""))
def request_counts(spark, d):
    return ops.request_counts(_http(spark, d), view(spark, d, "db_spans"), view(spark, d, "thread_intervals"))


@register("endpoint_findings", with_views("http_spans", "db_spans", sql=OWNED + EP + """
, f AS (SELECT run_id, method || ' ' || route AS e, p95 / 1000000.0 AS p95, errs * 100.0 / cnt AS err FROM ep)
SELECT run_id, 'slow_endpoint:' || e AS rule_id, CASE WHEN p95 >= 2000 THEN 'high' ELSE 'medium' END AS severity,
 CASE WHEN p95 >= 2000 THEN 0.55 ELSE 0.4 END::DOUBLE AS severity_score FROM f WHERE p95 >= 500
UNION ALL SELECT run_id, 'errored_endpoint:' || e, 'high', 0.5::DOUBLE FROM f WHERE err >= 5.0"""))
def endpoint_findings(spark, d):
    return ops.endpoint_findings(ops.endpoints(_timed(spark, d))).select("run_id", "rule_id", "severity", "severity_score")


@register("span_stream", with_views("http_spans", "db_spans", "thread_intervals", sql="""
, a AS (SELECT run_id, 'http' AS record, start_ns, dur_ns FROM http_spans UNION ALL SELECT run_id, 'db', start_ns, dur_ns FROM db_spans
 UNION ALL SELECT run_id, kind, start_ns, dur_ns FROM thread_intervals)
SELECT run_id, record, count(*) AS n, min(start_ns) AS first_ns, CAST(sum(dur_ns) AS BIGINT) AS total_ns FROM a GROUP BY 1, 2"""))
def span_stream(spark, d):
    s = ops.span_stream(_http(spark, d), view(spark, d, "db_spans"), view(spark, d, "thread_intervals"))
    return s.groupBy("run_id", "record").agg(F.count("*").alias("n"), F.min("start_ns").alias("first_ns"),
                                             F.sum("dur_ns").alias("total_ns"))


@register("route_templates", with_views("routes", sql="""
, s AS (SELECT page_id, route, list_filter(string_split(route, '/'), lambda x: x <> '') AS seg FROM routes)
SELECT page_id, '/' || array_to_string(list_transform(seg, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{id}'
 WHEN regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') THEN '{uuid}'
 WHEN regexp_full_match(x, '[0-9a-fA-F]{16,}') THEN '{hex}' ELSE x END), '/') AS template FROM s"""))
def route_templates(spark, d):
    return view(spark, d, "routes").select("page_id", route_template("route").alias("template"))


@register("sql_scrub", with_views("statements", sql="""
, s AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''?', '''?''', 'g'), '\\b[0-9]+\\b', '?', 'g'), '\\s+', ' ', 'g')) AS statement FROM statements)
SELECT c_custkey, statement, substring(statement, 1, 60) AS name FROM s"""))
def sql_scrub(spark, d):
    s = scrub_sql("sql")
    return view(spark, d, "statements").select("c_custkey", s.alias("statement"), sql_name(s).alias("name"))
