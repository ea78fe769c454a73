"""Request spans: which query belongs to which request, where a request's time went, endpoint tables, curation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import overlap, route_template
from ..plans.intervals import coverage, latest_open, overlap_join
from ..plans.quantile import interpolated
from ..plans.topk import top_k

c = F.col
THREAD = ["run_id", "tid"]
CURATE_CAP = 200
SLOWEST = 50

# Endpoint finding thresholds.
SLOW_ENDPOINT_MS, SLOW_ENDPOINT_HIGH_MS, ERRORED_PCT, DB_NOTE_SHARE = 500.0, 2000.0, 5.0, 0.3


def own_queries(http: DataFrame, db: DataFrame, db_key: list[str]) -> DataFrame:
    """Each query with the one request that owns it - the latest-started one on its thread that was then open."""
    h = http.select(*THREAD, c("span_id").alias("owner_id"), c("start_ns").alias("owner_start"),
                    c("dur_ns").alias("owner_dur"))
    d = db.select(*THREAD, *db_key, "start_ns", "dur_ns")
    owned = latest_open(d, "start_ns", h, "owner_start", "owner_dur", THREAD, ["owner_start", "owner_id", "owner_dur"])
    return owned.select(*THREAD, *db_key, "start_ns", "dur_ns", "o.owner_id", "o.owner_start", "o.owner_dur")


def with_db_time(http: DataFrame, owned: DataFrame) -> DataFrame:
    """Query time of each request, never more than the request itself."""
    spent = owned.groupBy("run_id", "tid", c("owner_id").alias("span_id")).agg(
        F.sum("dur_ns").alias("db_sum"), F.count("*").alias("db_count"))
    return http.join(spent, [*THREAD, "span_id"], "left").withColumn(
        "db_ns", F.least(F.coalesce("db_sum", F.lit(0).cast("long")), c("dur_ns"))).withColumn(
        "db_count", F.coalesce("db_count", F.lit(0).cast("long"))).drop("db_sum")


def _reason() -> Column:
    return F.when(c("reason").isin(names.OFF_REASONS), c("reason")).otherwise("other")


def breakdown(http: DataFrame, owned: DataFrame, intervals: DataFrame) -> DataFrame:
    """E10 over J8-J10: per request the time on the CPU, waiting for one, waiting for a query, and off it otherwise.

    Time off the CPU and in the run queue is swept, not joined. Only intervals that meet a query are paired, because
    there the part due to the query is capped per interval.
    """
    iv = intervals.select(*THREAD, "kind", "start_ns", "dur_ns", _reason().alias("reason"))
    off = c("kind") == "off"
    by_reason = {f"off_{r}": off & (c("reason") == r) for r in names.OFF_REASONS}
    swept = coverage(http.select(*THREAD, "span_id", "start_ns", "dur_ns"), "span_id", "start_ns", "dur_ns",
                     iv, "start_ns", "dur_ns", THREAD, {"rq": ~off, **by_reason})

    # Identical intervals stay distinct in the sums through their copy count.
    iv_key = ["i_start", "i_dur", "i_reason"]
    off_iv = iv.where(off & (c("dur_ns") > 0)).select(
        *THREAD, c("start_ns").alias("i_start"), c("dur_ns").alias("i_dur"), c("reason").alias("i_reason"))
    q = owned.where(c("dur_ns") > 0).select(*THREAD, "owner_id", "owner_start", "owner_dur",
                                            c("start_ns").alias("q_start"), c("dur_ns").alias("q_dur"))
    met = overlap_join(q, "q_start", "q_dur", off_iv, "i_start", "i_dur", THREAD, copies="copies")
    i_end, o_end = c("i_start") + c("i_dur"), c("owner_start") + c("owner_dur")
    per = met.groupBy(*THREAD, "owner_id", "owner_start", "owner_dur", *iv_key, "copies").agg(
        F.sum(overlap(c("i_start"), i_end, c("q_start"), c("q_start") + c("q_dur"))).alias("shared"))
    due = F.least(c("shared"), overlap(c("i_start"), i_end, c("owner_start"), o_end)) * c("copies")
    waits = per.groupBy(*THREAD, c("owner_id").alias("span_id")).agg(
        F.sum(due).alias("db_wait"),
        *[F.sum(F.when(c("i_reason") == r, due).otherwise(0)).alias(f"w_{r}") for r in names.OFF_REASONS])

    zero = F.lit(0).cast("long")
    full = http.join(swept, [*THREAD, "span_id"], "left").join(waits, [*THREAD, "span_id"], "left").select(
        *[c(n) for n in http.columns], *[F.coalesce(n, zero).alias(n) for n in
                                         ["rq", *by_reason, "db_wait", *[f"w_{r}" for r in names.OFF_REASONS]]])
    off_ns = F.least(reduce(add, [c(n) for n in by_reason]), c("dur_ns"))
    rq_ns = F.least(c("rq"), F.greatest(zero, c("dur_ns") - off_ns))
    reasons = F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(r) for r in names.OFF_REASONS]),
        F.array(*[c(f"off_{r}") - c(f"w_{r}") for r in names.OFF_REASONS])), lambda _, v: v > 0)
    return full.select(
        *http.columns, F.greatest(zero, c("dur_ns") - off_ns - rq_ns).alias("on_cpu_ns"), rq_ns.alias("runq_ns"),
        c("db_wait").alias("db_wait_ns"), F.greatest(zero, off_ns - c("db_wait")).alias("other_off_ns"),
        reasons.alias("off_reasons"))


def _endpoint() -> list[Column]:
    return [c("run_id"), F.coalesce(F.nullif(c("method"), F.lit("")), F.lit("?")).alias("method"),
            route_template("route").alias("route")]


ENDPOINT = ["run_id", "method", "route"]


def _templated(http: DataFrame) -> DataFrame:
    return http.select(*_endpoint(), *[n for n in http.columns if n not in ENDPOINT])


def endpoints(http: DataFrame) -> DataFrame:
    """Per (method, route template) - count, duration quantiles, error and query share. Needs `db_ns`."""
    t = _templated(http)
    base = t.groupBy(*ENDPOINT).agg(
        F.count("*").alias("count"), F.count_if(c("status") >= 500).alias("errs"), F.sum("dur_ns").alias("total"),
        F.sum("db_ns").alias("db"))
    q = interpolated(t, ENDPOINT, "dur_ns", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    share = F.when(c("total") > 0, F.least(F.lit(1.0), c("db") / c("total"))).otherwise(0.0)
    return base.join(q, ENDPOINT).select(
        *ENDPOINT, "count", *[(c(p) / 1_000_000.0).alias(f"{p}_ms") for p in ("p50", "p95", "p99")],
        (c("errs") * 100.0 / c("count")).alias("err_pct"), share.alias("db_ms_share"))


def endpoint_breakdown(broken: DataFrame) -> DataFrame:
    """The four time classes per endpoint with their shares, and the reason most off-CPU time had."""
    t = _templated(broken)
    parts = ["on_cpu", "runq", "db_wait", "other_off"]
    sums = t.groupBy(*ENDPOINT).agg(
        *[F.sum(f"{p}_ns").alias(p) for p in parts],
        *[F.sum(F.coalesce(F.element_at("off_reasons", r), F.lit(0))).alias(f"r_{r}") for r in names.OFF_REASONS])
    total = c("on_cpu") + c("runq") + c("db_wait") + c("other_off")
    top = F.greatest(*[c(f"r_{r}") for r in names.OFF_REASONS])
    reason = F.lit(None).cast("string")
    for r in reversed(names.OFF_REASONS):
        reason = F.when((top > 0) & (c(f"r_{r}") == top), r).otherwise(reason)
    return sums.select(*ENDPOINT, *[(c(p) / 1_000_000.0).alias(f"{p}_ms") for p in parts],
                       *[F.when(total > 0, c(p) * 100.0 / total).otherwise(0.0).alias(f"{p}_pct") for p in parts],
                       reason.alias("top_off_reason"))


def slowest_requests(http: DataFrame, owned: DataFrame, db: DataFrame, db_key: list[str], k: int = SLOWEST,
                     with_statement: bool = True) -> DataFrame:
    """The k slowest requests per run, each with its queries in time order and their place in the request."""
    top = top_k(http, ["run_id"], [F.desc("dur_ns"), F.asc("span_id")], k, rank="rank")
    child = owned.join(top.select(*THREAD, c("span_id").alias("owner_id")), [*THREAD, "owner_id"], "left_semi")
    extra = [n for n in ("name", "statement") if with_statement and n in db.columns]
    if extra:
        child = child.join(db.select(*THREAD, *db_key, *extra), [*THREAD, *db_key], "left")
    offset = (c("start_ns") - c("owner_start")) * 100.0 / F.greatest(c("owner_dur"), F.lit(1))
    width = c("dur_ns") * 100.0 / F.greatest(c("owner_dur"), F.lit(1))
    kids = child.groupBy(*THREAD, c("owner_id").alias("span_id")).agg(F.array_sort(F.collect_list(F.struct(
        "start_ns", *db_key, "dur_ns", offset.alias("offset_pct"), width.alias("width_pct"), *extra))).alias("queries"))
    return top.join(kids, [*THREAD, "span_id"], "left")


def request_counts(http: DataFrame, db: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """E25 head: requests and queries per run, and whether their time could be broken down."""
    n = http.groupBy("run_id").agg(F.count("*").alias("request_count"))
    q = db.groupBy("run_id").agg(F.count("*").alias("db_span_count"))
    out = n.join(q, "run_id", "full_outer")
    has = F.lit(False)
    if intervals is not None:
        seen = intervals.groupBy("run_id").agg(F.count("*").alias("n_iv"))
        out, has = out.join(seen, "run_id", "left"), F.coalesce(c("n_iv") > 0, F.lit(False))
    zero = F.lit(0).cast("long")
    return out.select("run_id", F.coalesce("request_count", zero).alias("request_count"),
                      F.coalesce("db_span_count", zero).alias("db_span_count"), has.alias("has_breakdown"))


def over_threshold(http: DataFrame, table: DataFrame) -> DataFrame:
    """Requests that failed or took at least their endpoint's p95."""
    t = http.withColumns({"e_method": F.coalesce(F.nullif(c("method"), F.lit("")), F.lit("?")),
                          "e_route": route_template("route")})
    thr = table.select("run_id", c("method").alias("e_method"), c("route").alias("e_route"), "p95_ms")
    joined = t.join(thr, ["run_id", "e_method", "e_route"], "left")
    slow = c("dur_ns") / 1_000_000.0 >= F.coalesce("p95_ms", F.lit(0.0))
    return joined.where(F.coalesce(c("status") >= 500, F.lit(False)) | slow).select(
        *http.columns, c("e_route").alias("route_template"), "p95_ms")


def curated(http: DataFrame, table: DataFrame, cap: int = CURATE_CAP) -> DataFrame:
    """K4: the slow or failed requests of each run, longest first, at most `cap`."""
    return top_k(over_threshold(http, table), ["run_id"], [F.desc("dur_ns"), F.asc("span_id")], cap, rank="rank",
                 salt_on=["span_id"])


def epoch_time(df: DataFrame, anchors: DataFrame, mono: str = "start_ns") -> DataFrame:
    """Monotonic to epoch milliseconds with one (run_id, mono0, wall0) anchor in seconds per capture."""
    at = c("wall0") * 1000.0 + (c(mono) * 1e-9 - c("mono0")) * 1000.0
    return df.join(anchors, "run_id", "left").withColumn("timestamp_ms", F.round(at, 1)).drop("mono0", "wall0")


def span_stream(http: DataFrame, db: DataFrame, intervals: DataFrame) -> DataFrame:
    """Requests, queries and thread intervals as one table; sort it within partitions when writing."""
    h = http.withColumn("record", F.lit("http"))
    d = db.withColumn("record", F.lit("db"))
    i = intervals.withColumn("record", c("kind")).drop("kind")
    return h.unionByName(d, allowMissingColumns=True).unionByName(i, allowMissingColumns=True)


def endpoint_findings(table: DataFrame) -> DataFrame:
    """Slow and failing endpoints; the endpoint is part of the rule id, so each keeps its own finding."""
    ep = F.concat_ws(" ", "method", "route")
    p95, err, share = c("p95_ms"), c("err_pct"), c("db_ms_share")
    severe = p95 >= SLOW_ENDPOINT_HIGH_MS
    pct = F.format_string("%.0f", share * 100)
    slow = table.where(p95 >= SLOW_ENDPOINT_MS).select(
        "run_id", F.concat(F.lit("slow_endpoint:"), ep).alias("rule_id"),
        F.when(severe, "high").otherwise("medium").alias("severity"),
        F.when(severe, 0.55).otherwise(0.4).alias("severity_score"),
        F.concat(F.lit("Slow endpoint "), ep, F.lit(": p95 "), F.format_string("%.0f", p95), F.lit(" ms"),
                 F.when(share >= DB_NOTE_SHARE, F.concat(F.lit(", "), pct, F.lit("% of it in queries"))).otherwise(""))
        .alias("title"),
        F.concat(F.lit("p50 "), F.format_string("%.0f", "p50_ms"), F.lit(" ms, p99 "),
                 F.format_string("%.0f", "p99_ms"), F.lit(" ms over "), c("count").cast("string"),
                 F.lit(" requests")).alias("description"), F.lit(1).cast("long").alias("occurrence_count"))
    failing = table.where(err >= ERRORED_PCT).select(
        "run_id", F.concat(F.lit("errored_endpoint:"), ep).alias("rule_id"), F.lit("high").alias("severity"),
        F.lit(0.5).alias("severity_score"),
        F.concat(F.lit("Endpoint errors on "), ep, F.lit(": "), F.format_string("%.1f", err), F.lit("% 5xx"))
        .alias("title"),
        F.concat(F.format_string("%.1f", err), F.lit("% of "), c("count").cast("string"),
                 F.lit(" requests answered with a server error")).alias("description"),
        F.lit(1).cast("long").alias("occurrence_count"))
    return slow.unionByName(failing)
