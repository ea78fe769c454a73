"""The anomaly rules.

Event rules share one pass: each event is tagged with the rules it matches and the group it counts for (a path, a peer, a
descriptor), tags are counted per group with map-side combining, and per run and rule the largest group is judged. Metric
rules share one aggregation per series. A rule is silent for a run that lacks its signal.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import is_library_path, is_probe_path, peer_key, retval_int, severity_name, severity_rank
from ..plans.rows import fan_out
from ..plans.scan import ordered_scan, prev, remaining
from ..plans.topk import top_k
from . import calls, series

c = F.col
EVIDENCE = 20


@dataclass(frozen=True)
class Thresholds:
    """The default limits. Overrides are sparse."""

    repeated_open_min_opens: int = 10
    failed_open_min: int = 5
    slow_syscall_ms: float = 1000.0
    slow_net_ms: float = 1000.0
    slow_file_io_ms: float = 100.0
    mutex_ms: float = 10.0
    mutex_min: int = 20
    mem_growth_min_mb: float = 50.0
    mem_growth_ratio: float = 1.4
    fd_growth_min: int = 30
    memory_spike_mb: float = 100.0
    cpu_bound_pct: float = 90.0
    cpu_bound_syscall_rate: float = 50.0
    cpu_bound_min_samples: int = 8
    excessive_subprocess_min: int = 50
    conn_reuse_min: int = 5
    io_retry_min: int = 100
    small_read_min: int = 2000
    write_storm_min: int = 1000
    spin_loop_min: int = 2000
    spin_cpu_pct: float = 80.0
    infinite_loop_min_ms: int = 30_000
    infinite_loop_max_syscalls: int = 200
    io_idle_bps: float = 262_144.0
    io_active_bps: float = 65_536.0
    io_wait_cpu_pct: float = 40.0
    metric_min_samples: int = 8
    downstream_read_min_ms: float = 100.0
    downstream_wait_ms: float = 1000.0
    cpu_throttled_ratio: float = 0.9
    rss_cgroup_ratio: float = 0.9
    trend_max_duration_ms: int = 600_000

    @classmethod
    def with_overrides(cls, overrides: dict | None) -> "Thresholds":
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in (overrides or {}).items() if k in known and v is not None})


# Every built-in rule with its signal, severity, and the limits it reads.
CATALOG: list[tuple[str, str, str, str, list[str]]] = [
    ("repeated_open_same_file", "events", "high", "One file opened over and over", ["repeated_open_min_opens"]),
    ("failed_file_opens", "events", "medium", "Files the program expects are missing or forbidden", ["failed_open_min"]),
    ("slow_network_connect", "events", "high", "A connection took long to open", ["slow_net_ms"]),
    ("slow_downstream_peer", "events", "high", "A peer answers slowly", ["downstream_read_min_ms", "downstream_wait_ms"]),
    ("slow_syscall", "events", "high", "A call that should not block took long", ["slow_syscall_ms"]),
    ("monotonic_memory_growth", "metrics", "high", "Memory climbs and stays up", ["mem_growth_min_mb", "mem_growth_ratio"]),
    ("fd_count_growing", "metrics", "critical", "Open descriptors climb and stay up", ["fd_growth_min"]),
    ("cpu_bound_no_syscalls", "metrics", "medium", "Busy CPU with hardly any calls",
     ["cpu_bound_pct", "cpu_bound_syscall_rate", "cpu_bound_min_samples"]),
    ("cpu_bound_metric", "metrics", "medium", "Busy CPU with hardly any I/O",
     ["cpu_bound_pct", "io_idle_bps", "metric_min_samples"]),
    ("io_wait_metric", "metrics", "medium", "Idle CPU with steady I/O",
     ["io_wait_cpu_pct", "io_active_bps", "metric_min_samples"]),
    ("cpu_throttled", "metrics", "high", "CPU held at the container's quota", ["cpu_throttled_ratio", "metric_min_samples"]),
    ("rss_near_cgroup_limit", "metrics", "critical", "Memory close to the container's limit", ["rss_cgroup_ratio"]),
    ("infinite_loop_no_progress", "events", "critical", "Long run with hardly any calls",
     ["infinite_loop_min_ms", "infinite_loop_max_syscalls"]),
    ("memory_spike", "metrics", "medium", "Memory jumped between two samples", ["memory_spike_mb"]),
    ("slow_file_io", "events", "high", "A file call took long", ["slow_file_io_ms"]),
    ("excessive_subprocess", "events", "medium", "Many programs started", ["excessive_subprocess_min"]),
    ("connection_error", "events", "high", "Network calls refused, reset or unreachable", []),
    ("no_connection_reuse", "events", "high", "Many connections to one peer", ["conn_reuse_min"]),
    ("mutex_contention", "events", "high", "Many slow lock waits", ["mutex_ms", "mutex_min"]),
    ("io_retry_loop", "events", "high", "One call retried on one descriptor", ["io_retry_min"]),
    ("small_read_storm", "events", "medium", "Very many tiny reads on one descriptor", ["small_read_min"]),
    ("write_storm", "events", "medium", "Very many writes to one descriptor", ["write_storm_min"]),
    ("spin_loop", "events", "high", "Very many polls that return at once on a busy CPU", ["spin_loop_min", "spin_cpu_pct"]),
]
SEVERITY = {r[0]: r[2] for r in CATALOG}


def _by_rule(values: dict[str, str]) -> str:
    """SQL text of a lookup by rule id: one expression instead of hundreds of Column calls on the driver."""
    return "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in values.items()) + " END"


_SEVERITY_SQL = _by_rule({r: f"'{v}'" for r, v in SEVERITY.items()})
_BASE_SQL = _by_rule({r: f"{names.SEVERITY_BASE[v]}D" for r, v in SEVERITY.items()})

# Call sets of the rules.
_OPENISH = names.OPEN_CALLS + ["access", "stat", "newfstatat"]
_BLOCKING = [
    "epoll_wait", "epoll_pwait", "poll", "ppoll", "select", "pselect6", "futex", "wait4", "waitid", "accept", "accept4",
    "nanosleep", "clock_nanosleep", "pause", "sigtimedwait", "rt_sigtimedwait", "io_getevents", "recvmsg", "recvfrom",
    "read", "readv", "recv", "msgrcv", "semop", "flock", "fcntl",
]
_SLOW_IO = ["write", "pwrite64", "writev", "fsync", "fdatasync", "openat", "open", "creat", "rename", "unlink", "truncate",
            "ftruncate"]
_CONN_ERRORS = ["ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "EHOSTUNREACH", "ENETUNREACH"]
_NET_CALLS = ["connect", "sendto", "recvfrom", "send", "recv", "read", "write", "sendmsg", "recvmsg"]
_RETRY_ERRORS = ["EAGAIN", "EWOULDBLOCK", "EINTR"]
_TINY_READS = ["read", "pread64", "recv", "recvfrom"]
_STORM_WRITES = ["write", "pwrite64", "writev"]


def metadata(spark: SparkSession) -> DataFrame:
    """One row per rule - id, signal, label, description and the limits it reads."""
    rows = [(rid, sig, rid.replace("_", " ").capitalize(), sev, text, lim) for rid, sig, sev, text, lim in CATALOG]
    return spark.createDataFrame(rows, "rule_id string, signal string, label string, severity string, "
                                       "description string, thresholds array<string>")


def threshold_table(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Each limit's default and the value in force. `overrides` has (name, value)."""
    base = spark.createDataFrame([(f.name, float(f.default)) for f in fields(Thresholds)], "name string, default double")
    if overrides is None:
        return base.withColumn("value", c("default"))
    o = overrides.select("name", c("value").cast("double").alias("__o"))
    return base.join(o, "name", "left").select("name", "default", F.coalesce("__o", "default").alias("value"))


def enabled_rules(meta: DataFrame, disabled: DataFrame) -> DataFrame:
    """The rules left after the disabled ones."""
    return meta.join(disabled.select("rule_id"), "rule_id", "left_anti")


# --- event rules -----------------------------------------------------------------------------------------------------

_EVENT_COLS = ["run_id", "seq", "ts_us", "pid", "syscall", "args", "retval", "error", "lat_us", "fd", "path"]


def _tags(t: Thresholds) -> dict[str, tuple[Column, Column]]:
    """rule -> (condition on one event, group it counts for)."""
    call, err, path, lat = c("syscall"), c("error"), c("path"), c("lat_us")
    one = F.lit("")
    ret = retval_int("retval")
    fd = c("fd").cast("string")
    on_fd = F.concat_ws(":", c("pid").cast("string"), fd)
    return {
        "repeated_open_same_file": (call.isin(names.OPEN_CALLS) & err.isNull() & (path != "") & ~is_library_path("path"), path),
        "failed_file_opens": (call.isin(_OPENISH) & (((err == "EACCES") & ~is_library_path("path"))
                                                     | ((err == "ENOENT") & ~is_probe_path("path"))), one),
        "slow_syscall": ((lat > t.slow_syscall_ms * 1000) & ~F.coalesce(call.isin(_BLOCKING), F.lit(False)), one),
        "slow_file_io": ((lat > t.slow_file_io_ms * 1000) & call.isin(_SLOW_IO) & err.isNull(), one),
        "excessive_subprocess": (call.isin(names.EXEC_CALLS) & err.isNull(), one),
        "connection_error": (err.isin(_CONN_ERRORS) & call.isin(_NET_CALLS), one),
        "no_connection_reuse": ((call == "connect") & (err.isNull() | (err == "EINPROGRESS")), peer_key("args")),
        "mutex_contention": ((call == "futex") & (lat > t.mutex_ms * 1000), one),
        "io_retry_loop": (err.isin(_RETRY_ERRORS) & c("fd").isNotNull() & (call != ""),
                          F.concat_ws(":", c("pid").cast("string"), call, fd)),
        "small_read_storm": (call.isin(_TINY_READS) & err.isNull() & c("fd").isNotNull() & (ret > 0) & (ret < 512), on_fd),
        "write_storm": (call.isin(_STORM_WRITES) & err.isNull() & (c("fd") > 2), on_fd),
        "spin_loop": (call.isin(names.POLL_CALLS) & (lat < 1000), one),
    }


def matches(events: DataFrame, t: Thresholds, block: Column | None = None, tags: dict | None = None) -> DataFrame:
    """Every (event, rule) match with its group: one narrow pass, and one scan for the two rules that need an as-of state."""
    ev = events.where(c("event_type") != "libcall").select(*_EVENT_COLS)
    variants = [F.when(cond & key.isNotNull(), F.struct(F.lit(rid).alias("rule_id"), key.alias("grp")))
                for rid, (cond, key) in (tags or _tags(t)).items()]
    plain = fan_out(ev, _EVENT_COLS, variants, "m").select(*_EVENT_COLS, "m.rule_id", "m.grp")
    peer = c("peer")
    waits = calls.network_waits(ev, _EVENT_COLS, int(t.slow_net_ms * 1000), int(t.downstream_read_min_ms * 1000), block).select(
        *_EVENT_COLS, F.when(peer.isNull(), "slow_network_connect").otherwise("slow_downstream_peer").alias("rule_id"),
        F.coalesce(peer, F.lit("")).alias("grp"))
    return plain.unionByName(waits)


def _worst_groups(m: DataFrame) -> DataFrame:
    """Per run and rule the group that counts most; ties go to the group seen first."""
    lat_at = F.when(c("lat_us").isNotNull(), F.struct("lat_us", (-c("seq")).alias("s")))
    g = m.groupBy("run_id", "rule_id", "grp").agg(
        F.count("*").alias("n"), F.sum("lat_us").alias("lat_sum"), F.min("seq").alias("first_seq"),
        F.min_by("ts_us", "seq").alias("first_us"), F.max_by("ts_us", "seq").alias("last_us"),
        F.min("ts_us").alias("min_us"), F.max("ts_us").alias("max_us"),
        F.max_by(F.struct("syscall", "path", "lat_us"), lat_at).alias("slowest"), F.max("fd").alias("fd"),
        F.max("syscall").alias("call"),
        F.collect_set(F.when(c("rule_id") == "connection_error", c("error"))).alias("errors"))  # five at most
    measure = F.when(c("rule_id") == "slow_downstream_peer", c("lat_sum")).otherwise(c("n"))
    everything = F.struct(*[x for x in g.columns if x not in ("run_id", "rule_id")])
    best = F.max_by(everything, F.struct(measure, (-c("first_seq")).alias("s"))).alias("b")
    return g.groupBy("run_id", "rule_id").agg(best).select("run_id", "rule_id", "b.*")


def _first_names(events: DataFrame, tags: dict, rule: str, value: str, k: int) -> DataFrame:
    """The first k distinct values of one rule's matches, sorted and joined into a text. A narrow scan of its own."""
    cond = tags[rule][0]
    d = events.where(cond & (F.coalesce(c(value), F.lit("")) != "")).select("run_id", c(value).alias("v")).distinct()
    d = top_k(d, ["run_id"], [F.asc("v")], k)
    return d.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("listed")).withColumn(
        "rule_id", F.lit(rule))


def event_findings(events: DataFrame, t: Thresholds, metrics: DataFrame | None = None, runs: DataFrame | None = None,
                   block: Column | None = None) -> DataFrame:
    """R1-R5, R13, R15-R23."""
    tags = _tags(t)
    w = _worst_groups(matches(events, t, block, tags))
    rid, n = c("rule_id"), c("n")
    limit = {
        "repeated_open_same_file": n > t.repeated_open_min_opens, "failed_file_opens": n > t.failed_open_min,
        "slow_network_connect": n > 0, "slow_syscall": n > 0, "slow_file_io": n > 0, "connection_error": n > 0,
        "slow_downstream_peer": (c("lat_sum") >= t.downstream_wait_ms * 1000)
        | (c("slowest.lat_us") >= t.downstream_wait_ms * 1000),
        "excessive_subprocess": n > t.excessive_subprocess_min, "no_connection_reuse": n > t.conn_reuse_min,
        "mutex_contention": n > t.mutex_min, "io_retry_loop": n > t.io_retry_min, "small_read_storm": n > t.small_read_min,
        "write_storm": n > t.write_storm_min, "spin_loop": n > t.spin_loop_min,
    }
    fires = F.lit(False)
    for r, cond in limit.items():
        fires = F.when(rid == r, cond).otherwise(fires)
    hit = w.where(fires)
    busy_cpu = (metrics.where(c("cpu_pct") > t.spin_cpu_pct).select("run_id").distinct() if metrics is not None else None)
    others = hit.where(rid != "spin_loop")
    if busy_cpu is not None:
        others = others.unionByName(hit.where(rid == "spin_loop").join(busy_cpu, "run_id", "left_semi"))
    calls_only = events.where(c("event_type") != "libcall")
    listed = _first_names(calls_only, tags, "failed_file_opens", "path", 5)
    full = others.join(listed, ["run_id", "rule_id"], "left").withColumn(
        "listed", F.when(rid == "connection_error", F.array_join(F.array_sort("errors"), ", ")).otherwise(c("listed")))

    s = n.cast("string")
    slow = F.concat(c("slowest.syscall"), F.lit("() took "), F.format_string("%.2f", c("slowest.lat_us") / 1e6), F.lit(" s"))
    title = {
        "repeated_open_same_file": F.concat(c("grp"), F.lit(" opened "), s, F.lit(" times")),
        "failed_file_opens": F.concat(s, F.lit(" failed file opens")),
        "slow_network_connect": F.concat(s, F.lit(" slow connections")),
        "slow_downstream_peer": F.concat(F.lit("Slow peer "), c("grp"), F.lit(": "),
                                         F.format_string("%.1f", c("lat_sum") / 1e6), F.lit(" s waiting")),
        "slow_syscall": F.concat(F.lit("Slow call: "), slow), "slow_file_io": F.concat(F.lit("Slow file call: "), slow),
        "excessive_subprocess": F.concat(s, F.lit(" programs started")),
        "connection_error": F.concat(F.lit("Network errors: "), c("listed")),
        "no_connection_reuse": F.concat(s, F.lit(" connections to "), c("grp")),
        "mutex_contention": F.concat(s, F.lit(" slow lock waits")),
        "io_retry_loop": F.concat(c("call"), F.lit("() retried "), s, F.lit(" times on descriptor "), c("fd").cast("string")),
        "small_read_storm": F.concat(s, F.lit(" tiny reads on one descriptor")),
        "write_storm": F.concat(s, F.lit(" writes to one descriptor")),
        "spin_loop": F.concat(s, F.lit(" polls that returned at once")),
    }
    detail = F.concat_ws("; ", F.concat(s, F.lit(" events")),
                         F.when(rid == "failed_file_opens", F.concat(F.lit("e.g. "), c("listed"))),
                         F.when(rid.isin("slow_syscall", "slow_file_io") & c("slowest.path").isNotNull(),
                                F.concat(F.lit("slowest on "), c("slowest.path"))),
                         F.when(rid.isin("mutex_contention", "slow_downstream_peer"),
                                F.concat(F.format_string("%.1f", c("lat_sum") / 1e6), F.lit(" s in total"))))
    # Two rules leave the time span open; three take the earliest and latest time rather than the first and last event.
    untimed = rid.isin("no_connection_reuse", "io_retry_loop", "spin_loop")
    by_time = rid.isin("slow_network_connect", "slow_syscall", "slow_file_io", "slow_downstream_peer")
    first = F.when(untimed, None).when(by_time, c("min_us")).otherwise(c("first_us"))
    last = F.when(untimed, None).when(by_time, c("max_us")).otherwise(c("last_us"))
    found = _findings(full, title, detail, n, first, last)
    if runs is not None:
        found = found.unionByName(stuck_runs(events, runs, t))
    return found


def _findings(df: DataFrame, title: dict[str, Column | str], detail: Column, n: Column, first: Column, last: Column) -> DataFrame:
    head = F.lit(None).cast("string")
    for r, v in title.items():
        head = F.when(c("rule_id") == r, v).otherwise(head)
    group = [c("grp")] if "grp" in df.columns else [F.lit("").alias("grp")]
    score = F.round(F.expr(_BASE_SQL) + F.least(n, F.lit(1000)) / 1000 * 9.99, 3)
    return df.select("run_id", "rule_id", F.expr(_SEVERITY_SQL).alias("severity"), score.alias("severity_score"),
                     head.alias("title"), detail.alias("description"), first.alias("first_seen_us"),
                     last.alias("last_seen_us"), n.cast("long").alias("occurrence_count"), *group)


def stuck_runs(events: DataFrame, runs: DataFrame, t: Thresholds) -> DataFrame:
    """A long run with events but hardly any calls."""
    n = events.where(c("event_type") != "libcall").groupBy("run_id").agg(
        F.count_if(c("event_type") == "syscall").alias("syscalls"))
    hit = (n.join(runs.select("run_id", "duration_ms"), "run_id")
           .where((c("duration_ms") >= t.infinite_loop_min_ms) & (c("syscalls") <= t.infinite_loop_max_syscalls))
           .withColumn("rule_id", F.lit("infinite_loop_no_progress")))
    secs = F.format_string("%.0f", c("duration_ms") / 1000)
    none = F.lit(None).cast("long")
    return _findings(hit, {"infinite_loop_no_progress": F.concat(F.lit("No progress for "), secs, F.lit(" s"))},
                     F.concat(c("syscalls").cast("string"), F.lit(" calls in "), secs, F.lit(" s")), F.lit(1), none, none)


def evidence(events: DataFrame, findings: DataFrame, t: Thresholds, k: int = EVIDENCE, block: Column | None = None) -> DataFrame:
    """K2: the first k events of each finding (the slowest k for the two slow-call rules), by (run, rule, rank)."""
    m = matches(events, t, block)
    won = findings.select("run_id", "rule_id", "grp")
    shown = m.where(c("rule_id") != "no_connection_reuse").join(won, ["run_id", "rule_id", "grp"], "left_semi")
    slow = c("rule_id").isin("slow_syscall", "slow_file_io")
    order = [F.desc(F.when(slow, c("lat_us"))), F.asc(F.when(c("rule_id") == "slow_downstream_peer", c("ts_us"))), F.asc("seq")]
    return top_k(shown, ["run_id", "rule_id"], order, k, rank="rank")


# --- metric rules ----------------------------------------------------------------------------------------------------

def metric_findings(metrics: DataFrame, runs: DataFrame, t: Thresholds, block: Column | None = None) -> DataFrame:
    """R6-R12, R14."""
    return series_findings(metrics, runs, t, block).unionByName(load_findings(metrics, runs, t))


def series_findings(metrics: DataFrame, runs: DataFrame, t: Thresholds, block: Column | None = None) -> DataFrame:
    """Both trends and the jumps by one scan, the series being part of the key.

    A run that lasted longer than `trend_max_duration_ms` is judged by its newest points, and how long it lasted is joined to
    the counts, not to the samples: each series is summed up whole and from its tail.
    """
    grows, fds = "monotonic_memory_growth", "fd_count_growing"
    points = fan_out(metrics.select("run_id", "ts_us", "rss_mb", "open_fds"), ["run_id", "ts_us"], [
        F.when(c(col).isNotNull(), F.struct(F.lit(rid).alias("rule_id"), c(col).cast("double").alias("v")))
        for col, rid in (("rss_mb", grows), ("open_fds", fds))], "p").select("run_id", "ts_us", "p.rule_id", "p.v")
    s = ordered_scan(points, ["run_id", "rule_id"], ["ts_us"], block if block is not None else series.time_block(), shared=True,
                     before=prev("v"), left=remaining(F.lit(1).cast("long")))
    step = c("v") - c("before.v")
    fell = c("v") < c("before.v") - F.when(c("rule_id") == fds, 0.0).otherwise(0.5)
    jump = step > t.memory_spike_mb

    def summed(within: Column, judged: Column) -> Column:
        at = F.when(within, c("ts_us"))
        return F.struct(F.count_if(within).alias("points"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"),
                        F.max(F.when(within, c("v"))).alias("peak"), F.count_if(fell & judged).alias("decreases"),
                        F.min(at).alias("a"), F.max(at).alias("z"))

    tail = c("left") <= series.TREND_TAIL
    g = s.groupBy("run_id", "rule_id").agg(
        summed(F.lit(True), F.lit(True)).alias("whole"), summed(tail, c("left") < series.TREND_TAIL).alias("tail"),
        F.count_if(jump).alias("jumps"), F.max(F.when(jump, step)).alias("biggest"), F.min(F.when(jump, c("ts_us"))).alias("jump_a"),
        F.max(F.when(jump, c("ts_us"))).alias("jump_z"))
    long_run = F.coalesce(c("duration_ms") > t.trend_max_duration_ms, F.lit(False))
    g = g.join(runs.select("run_id", "duration_ms"), "run_id", "left").withColumn(
        "g", F.when(long_run, c("tail")).otherwise(c("whole")))
    rise, few = c("g.last") - c("g.first"), c("g.points") * 0.25
    mem = (rise > t.mem_growth_min_mb) & (c("g.last") > c("g.first") * t.mem_growth_ratio) & (c("g.decreases") < few)
    held = (rise >= t.fd_growth_min) & (c("g.decreases") <= few)
    climbs = (c("g.points") >= 8) & F.when(c("rule_id") == fds, held).otherwise(mem)
    shape = ["rule_id", "n", "low", "high", "peak", "a", "z"]
    rows = [F.when(climbs, F.struct(*[v.alias(k) for k, v in zip(shape, (
                c("rule_id"), F.floor(rise).cast("long"), c("g.first"), c("g.last"), c("g.peak"), c("g.a"), c("g.z")))])),
            F.when((c("rule_id") == grows) & (c("jumps") > 0), F.struct(*[v.alias(k) for k, v in zip(shape, (
                F.lit("memory_spike"), c("jumps"), F.lit(0.0), F.lit(0.0), c("biggest"), c("jump_a"), c("jump_z")))]))]
    hit = g.select("run_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("run_id", "f.*")
    span = F.concat(F.format_string("%.0f", "low"), F.lit(" to "), F.format_string("%.0f", "high"))
    peak = F.format_string("%.0f", "peak")
    return _findings(hit, {grows: F.concat(F.lit("Memory grew from "), span, F.lit(" MB")),
                           fds: F.concat(F.lit("Open descriptors grew from "), span),
                           "memory_spike": F.concat(F.lit("Memory jumped by "), peak, F.lit(" MB"))},
                     F.when(c("rule_id") == "memory_spike", F.concat(c("n").cast("string"), F.lit(" jumps")))
                     .otherwise(F.concat(F.lit("peak "), peak, F.lit(", rarely fell"))), c("n"), c("a"), c("z"))


def load_findings(metrics: DataFrame, runs: DataFrame, t: Thresholds) -> DataFrame:
    """One aggregation with conditional counts per run, then judged in long form."""
    limits = runs.select("run_id", "cgroup_cpu_quota_cores", "cgroup_mem_limit_bytes").where(
        "cgroup_cpu_quota_cores > 0 OR cgroup_mem_limit_bytes > 0")
    none = F.lit(None).cast("double")
    m = metrics.select("run_id", "ts_us", *[(c(k) if k in metrics.columns else none.alias(k)) for k in (
        "cpu_pct", "rss_mb", "syscall_rate", "io_read_bps", "io_write_bps")])
    m = m.join(limits, "run_id", "left")
    cpu, rate = c("cpu_pct"), c("syscall_rate")
    rd, wr = F.coalesce("io_read_bps", F.lit(0.0)), F.coalesce("io_write_bps", F.lit(0.0))
    quota = c("cgroup_cpu_quota_cores")
    hot = {
        "cpu_bound_no_syscalls": (cpu > t.cpu_bound_pct) & (rate < t.cpu_bound_syscall_rate),
        "cpu_bound_metric": (cpu > t.cpu_bound_pct) & (rd < t.io_idle_bps) & (wr < t.io_idle_bps),
        "io_wait_metric": (cpu < t.io_wait_cpu_pct) & ((rd > t.io_active_bps) | (wr > t.io_active_bps)),
        "cpu_throttled": (quota > 0) & (cpu >= quota * 100.0 * t.cpu_throttled_ratio),
    }
    aggs = [F.count("cpu_pct").alias("n_cpu"), F.count_if(cpu.isNotNull() & rate.isNotNull()).alias("n_rate"),
            F.max("rss_mb").alias("rss_peak"), F.min(F.when(c("rss_mb").isNotNull(), c("ts_us"))).alias("rss_first"),
            F.max_by("ts_us", F.when(c("rss_mb").isNotNull(), F.struct("rss_mb", "ts_us"))).alias("rss_peak_at"),
            F.max("cgroup_mem_limit_bytes").alias("limit"), F.max(quota).alias("quota")]
    for rid, cond in hot.items():
        aggs += [F.count_if(cond).alias(f"n_{rid}"), F.min(F.when(cond, c("ts_us"))).alias(f"a_{rid}"),
                 F.max(F.when(cond, c("ts_us"))).alias(f"z_{rid}"), F.max(F.when(cond, cpu)).alias(f"p_{rid}")]
    g = m.groupBy("run_id").agg(*aggs)
    gate = {
        "cpu_bound_no_syscalls": (c("n_rate") >= t.cpu_bound_min_samples)
        & (c("n_cpu_bound_no_syscalls") >= t.cpu_bound_min_samples),
        "cpu_bound_metric": (c("n_rate") == 0) & (c("n_cpu") >= t.metric_min_samples)
        & (c("n_cpu_bound_metric") >= t.metric_min_samples),
        "io_wait_metric": (c("n_rate") == 0) & (c("n_cpu") >= t.metric_min_samples)
        & (c("n_io_wait_metric") >= t.metric_min_samples),
        "cpu_throttled": (c("n_cpu") >= t.metric_min_samples) & (c("n_cpu_throttled") >= t.metric_min_samples),
    }
    limit_mb = c("limit") / (1024.0 * 1024.0)
    rows = [F.when(gate[r], F.struct(F.lit(r).alias("rule_id"), c(f"n_{r}").alias("n"), c(f"a_{r}").alias("a"),
                                     c(f"z_{r}").alias("z"), c(f"p_{r}").alias("p"))) for r in hot]
    rows.append(F.when((c("limit") > 0) & (c("rss_peak") >= limit_mb * t.rss_cgroup_ratio),
                       F.struct(F.lit("rss_near_cgroup_limit").alias("rule_id"), F.floor("rss_peak").cast("long").alias("n"),
                                c("rss_first").alias("a"), c("rss_peak_at").alias("z"), c("rss_peak").cast("double").alias("p"))))
    hit = g.select("run_id", "limit", "quota", F.explode(F.array_compact(F.array(*rows))).alias("f")).select(
        "run_id", "limit", "quota", "f.*")
    n, s = c("n"), c("n").cast("string")
    lim = F.format_string("%.0f", c("limit") / (1024.0 * 1024.0))
    return _findings(hit, {
        "cpu_bound_no_syscalls": "CPU-bound: high CPU, hardly any calls",
        "cpu_bound_metric": "CPU-bound: high CPU, hardly any I/O",
        "io_wait_metric": "I/O-bound: low CPU, steady I/O",
        "cpu_throttled": F.concat(F.lit("CPU held at its quota of "), F.format_string("%.2f", "quota"), F.lit(" cores")),
        "rss_near_cgroup_limit": F.concat(F.lit("Memory "), F.format_string("%.0f", "p"), F.lit(" MB near the limit of "),
                                          lim, F.lit(" MB"))},
        F.when(c("rule_id") == "rss_near_cgroup_limit", F.concat(F.lit("limit "), lim, F.lit(" MB")))
        .otherwise(F.concat(s, F.lit(" samples"))), n, c("a"), c("z"))


def slow_leak_findings(metrics: DataFrame, block: Column | None = None) -> DataFrame:
    """A creep too slow for the short windows. 20 points, 180 s, 50 MB, 0.5 MB/min, 70 % non-falling."""
    g = series.slow_growth(series.series(metrics, "rss_mb"), block=block)
    hit = g.where((c("n") >= 20) & (c("last_us") - c("first_us") >= 180_000_000) & (c("growth") >= 50.0)
                  & (c("per_minute") >= 0.5) & (c("non_falling_share") >= 0.7))
    return hit.select("run_id", F.lit("slow_memory_leak").alias("rule_id"), F.lit("high").alias("severity"),
                      F.lit(0.7).alias("severity_score"),
                      F.concat(F.lit("Slow memory leak: "), F.format_string("%.0f", "baseline"), F.lit(" to "),
                               F.format_string("%.0f", "current"), F.lit(" MB, "), F.format_string("%.1f", "per_minute"),
                               F.lit(" MB/min")).alias("title"),
                      c("last_us").alias("last_seen_us"))


# --- the runner ------------------------------------------------------------------------------------------------------

def run_rules(events: DataFrame, metrics: DataFrame, runs: DataFrame, t: Thresholds = Thresholds(),
              disabled: list[str] | None = None, block: Column | None = None,
              metric_block: Column | None = None) -> DataFrame:
    """All findings of all runs. Runs without a signal have no rows in it, so its rules find nothing for them."""
    found = event_findings(events, t, metrics, runs, block).unionByName(metric_findings(metrics, runs, t, metric_block))
    if disabled:
        found = found.where(~c("rule_id").isin(disabled))
    return found.withColumn("severity_rank", severity_rank(c("severity")))


def by_score(findings: DataFrame) -> DataFrame:
    """Most pressing first within each run."""
    return findings.orderBy("run_id", F.desc("severity_score"), "rule_id")


def placed(findings: DataFrame) -> DataFrame:
    """K12 as a column: each finding's place in by_score's order within its run, equal ones sharing it."""
    return findings.withColumn("place", F.rank().over(Window.partitionBy("run_id").orderBy(F.desc("severity_score"), "rule_id")))


def max_severity(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """The worst severity of each run, `clean` where nothing was found."""
    worst = findings.groupBy("run_id").agg(F.min(severity_rank(c("severity"))).alias("r"))
    clean = len(names.SEVERITIES) - 1
    return runs.select("run_id").distinct().join(worst, "run_id", "left").select(
        "run_id", severity_name(F.coalesce("r", F.lit(clean))).alias("max_severity"))


def union_findings(*sources: DataFrame) -> DataFrame:
    """Rule, profile, histogram, ledger and span findings as one table."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
