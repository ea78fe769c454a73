"""The run catalog and the stored tables: listing, finalising, reconciling, retention, reads with their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import run_class, run_label
from ..plans.scan import TIME_BLOCK_US, ordered_scan, remaining, running, width_block
from ..plans.topk import top_k
from .series import stride

c = F.col

# Page sizes of the stored-table readers.
EVENT_PAGE, SPAN_PAGE, RUN_PAGE_MAX = 5000, 500, 500
TEXT_SUFFIXES = ["json", "log", "md", "txt", "ndjson", "pid"]


def latest_samples(metrics: DataFrame, ingest_order: str = "ingest_seq") -> DataFrame:
    """A5: one sample per run and time, the last one written. An aggregation, so equal keys combine before the shuffle."""
    rest = [n for n in metrics.columns if n not in ("run_id", "ts_us", ingest_order)]
    return metrics.groupBy("run_id", "ts_us").agg(F.max_by(F.struct(*rest), ingest_order).alias("m")).select(
        "run_id", "ts_us", "m.*")


def read_events(events: DataFrame, run_id: str, limit: int = EVENT_PAGE) -> DataFrame:
    """A run's stored events in time order without request rows."""
    return (events.where((c("run_id") == run_id) & (c("event_type") != "request")).orderBy("ts_us", "seq").limit(limit))


def read_spans(spans: DataFrame, run_id: str, since_us: int | None = None, until_us: int | None = None,
               limit: int = SPAN_PAGE) -> DataFrame:
    """A run's stored request spans, newest first, in an optional closed time range."""
    out = spans.where(c("run_id") == run_id)
    if since_us is not None:
        out = out.where(c("ts_us") >= since_us)
    if until_us is not None:
        out = out.where(c("ts_us") <= until_us)
    return out.orderBy(F.desc("ts_us"), F.desc("span_id")).limit(limit)


def read_findings(findings: DataFrame, run_id: str) -> DataFrame:
    """A run's findings, most pressing first."""
    return findings.where(c("run_id") == run_id).orderBy(F.desc("severity_score"), "rule_id")


def read_metrics(metrics: DataFrame, run_id: str, max_points: int | None = None) -> DataFrame:
    """A run's samples in time order, thinned to about `max_points` real rows when asked."""
    one = metrics.where(c("run_id") == run_id)
    return (one if not max_points else stride(one, max_points)).orderBy("ts_us")


def session_runs(runs: DataFrame, session_id: str) -> DataFrame:
    """A session's runs, newest first."""
    return runs.where(c("session_id") == session_id).orderBy(F.desc("started_us"), F.desc("run_id"))


def recent_runs(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest runs over all sessions; the page size is clamped to 1..500, the offset to 0 or more."""
    return runs.orderBy(F.desc("started_us"), F.desc("run_id")).offset(max(0, offset)).limit(min(max(1, limit), RUN_PAGE_MAX))


def run_places(runs: DataFrame, block: Column | None = None) -> DataFrame:
    """Every run with its place among its session's runs, newest first, and their count; no session is one row or one task.

    Runs without a start are the oldest ones; runs without a session count as one session.
    """
    none = c("session_id").isNull()
    at = block if block is not None else width_block("started_us", TIME_BLOCK_US)
    rows = runs.select(F.coalesce("session_id", F.lit("")).alias("__s"), none.alias("__none"), "started_us", "run_id")
    one = F.lit(1).cast("long")
    ranked = ordered_scan(rows, ["__s", "__none"], ["started_us", "run_id"], F.coalesce(at, F.lit(-(1 << 62))), shared=True,
                          rank=remaining(one), older=running(one))
    return ranked.select(F.when(~c("__none"), c("__s")).alias("session_id"), "run_id", "rank", (c("rank") + c("older") - 1).alias("runs"))


def runs_by_session(runs: DataFrame, k: int) -> DataFrame:
    """A page per session - its k newest runs as a list, and its run count."""
    n = runs.groupBy("session_id").agg(F.count("*").alias("runs"))
    newest = top_k(runs.select("session_id", "run_id", "started_us"), ["session_id"], [F.desc("started_us"), F.desc("run_id")], k,
                   rank="rank")
    ids = newest.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "run_id"))),
                                                       lambda s: s["run_id"]).alias("run_ids"))
    return n.join(ids, "session_id")


def finalise(runs: DataFrame, ends: DataFrame, severities: DataFrame, status: str = "completed") -> DataFrame:
    """Runs that ended get end, duration (never negative), exit and worst severity."""
    j = runs.drop("max_severity").join(ends.select("run_id", c("ended_us").alias("__end"), c("exit_code").alias("__code"),
                                                   c("exit_signal").alias("__sig")), "run_id", "left")
    j = j.join(severities.select("run_id", c("max_severity").alias("__sev")), "run_id", "left")
    done = c("__end").isNotNull()
    dur = F.greatest(F.lit(0).cast("long"), F.floor((c("__end") - c("started_us")) / 1000).cast("long"))
    out = j.withColumns({
        "ended_us": F.coalesce("__end", "ended_us"), "duration_ms": F.when(done, dur).otherwise(c("duration_ms")),
        "exit_code": F.when(done, c("__code")).otherwise(c("exit_code")),
        "exit_signal": F.when(done, c("__sig")).otherwise(c("exit_signal")),
        "status": F.when(done, status).otherwise(c("status")), "max_severity": F.when(done, F.coalesce("__sev", F.lit("clean")))})
    return out.drop("__end", "__code", "__sig", "__sev")


def reconcile(runs: DataFrame) -> DataFrame:
    """Runs a stopped service left behind become errors."""
    return runs.withColumn("status", F.when(c("status").isin("running", "analyzing"), "error").otherwise(c("status")))


def stale_runs(runs: DataFrame, metrics: DataFrame, now_us: int, max_age_us: int) -> DataFrame:
    """Live runs that never delivered a sample and are older than `max_age_us`."""
    old = runs.where((c("status") == "running") & (c("started_us") < now_us - max_age_us))
    return old.join(metrics.select("run_id").distinct(), "run_id", "left_anti")


def without_runs(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """A fact table without the rows of deleted runs."""
    return table.join(doomed.select("run_id").distinct(), "run_id", "left_anti")


def runs_of_sessions(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The runs that go when these sessions go."""
    return runs.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("run_id")


def patch_by_id(base: DataFrame, patches: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows with their later partial updates applied; in a patch null means unchanged, the last non-null wins."""
    cols = [n for n in base.columns if n not in key]
    have = [n for n in cols if n in patches.columns]
    last = patches.groupBy(*key).agg(*[F.max_by(n, F.when(c(n).isNotNull(), c(order))).alias(f"__{n}") for n in have])
    return base.join(last, key, "left").select(*key, *[F.coalesce(f"__{n}", n).alias(n) if n in have else c(n) for n in cols])


def artifacts(files: DataFrame) -> DataFrame:
    """A10: binary files -> name, size, digest, and whether a viewer may show them as text. Spark's file source passes over
    empty files, so those are not listed."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), F.length("content").cast("long").alias("size_bytes"),
                        F.sha2("content", 256).alias("sha256"), suffix.isin(TEXT_SUFFIXES).alias("is_text"))


def labelled(runs: DataFrame) -> DataFrame:
    """Status text and class of each run."""
    return runs.withColumns({"label": run_label(c("status"), c("attach"), c("exit_code"), c("exit_signal")),
                             "label_class": run_class(c("status"), c("attach"), c("exit_code"))})


def ordered_by(table: DataFrame, col: str, ascending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """K9: sort by a column a user picked; missing values count as -1."""
    key: Column = F.coalesce(c(col), F.lit(-1))
    return table.orderBy(key.asc() if ascending else key.desc(), *(ties or []))


def host_pids(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Container-local pids to host pids. Inventory has (run_id, pid, ns_pids, id); a wanted row may name a container."""
    inner = inventory.where(F.size("ns_pids") >= 2).select(
        "run_id", c("pid").alias("host_pid"), F.element_at("ns_pids", -1).alias("local_pid"), c("id").alias("inv_id"))
    j = wanted.join(inner, ["run_id", "local_pid"], "left")
    ok = c("container_id").isNull() | (c("container_id") == c("inv_id"))
    return j.groupBy(*wanted.columns).agg(F.min(F.when(ok, c("host_pid"))).alias("host_pid"))
