"""Per-call, per-file, per-process and per-connection tables over trace_events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import connect_result, fd_or_first_arg, peer_key, retval_int, socket_address
from ..plans.quantile import interpolated
from ..plans.rows import fan_out
from ..plans.scan import TIME_UNITS_US, even_blocks, following, last_known, ordered_scan, prev, running, seq_block
from ..plans.topk import top_k

c = F.col
FIRST_BIN_US = 250_000
EPHEMERAL_US = 250_000


def _filled(col: str) -> Column:
    return F.coalesce(c(col), F.lit("")) != ""


def call_stats(events: DataFrame) -> DataFrame:
    """Per syscall - count, errors, total and average latency, exact quantiles, share of the run's call time."""
    calls = events.where((c("event_type") == "syscall") & _filled("syscall")).select(
        "run_id", "syscall", "lat_us", "error")
    keys = ["run_id", "syscall"]
    base = calls.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_if(_filled("error")).alias("errors"),
        F.sum("lat_us").alias("lat"), F.count("lat_us").alias("n_lat"))
    whole = F.sum("lat").over(Window.partitionBy("run_id"))  # one row per distinct call name
    base = base.withColumn("whole", whole)
    q = interpolated(calls, keys, "lat_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    total = F.coalesce(c("lat"), F.lit(0))
    return base.join(q, keys, "left").select(
        *keys, "count", (total / 1000.0).alias("total_ms"), (c("lat") / c("n_lat") / 1000.0).alias("avg_ms"),
        *[(c(p) / 1000.0).alias(f"{p}_ms") for p in ("p50", "p95", "p99")], "errors",
        (F.when(F.coalesce(c("whole"), F.lit(0)) == 0, total / 1000.0).otherwise(total / c("whole")) * 100.0)
        .alias("pct_runtime"))


def file_io(events: DataFrame, block: Column | None = None) -> DataFrame:
    """E3 over J2: reads and writes go to the path the descriptor was last opened on; unclosed descriptors leak."""
    block = block if block is not None else seq_block()
    call = c("syscall")
    used = names.OPEN_CALLS + ["close"] + names.READ_CALLS + names.WRITE_CALLS
    rows = (events.where((c("event_type") == "syscall") & c("error").isNull() & c("pid").isNotNull() & call.isin(used))
            .select("run_id", "pid", "seq", "syscall", "path", "fd", retval_int("retval").alias("ret")))
    opened = call.isin(names.OPEN_CALLS)
    # A descriptor is known where it was returned (open) or named (the rest); -1 stands for none and never holds a path.
    fd = F.when(~opened, c("fd").cast("long")).when((c("ret") >= 0) & _filled("path"), c("ret"))
    fd = F.coalesce(fd, F.lit(-1).cast("long"))
    kind = F.when(opened, "open").when(call == "close", "close").when(call.isin(names.READ_CALLS), "read").otherwise("write")
    rows = rows.select("run_id", "pid", "seq", "path", "ret", fd.alias("fd"), kind.alias("kind"))
    state = F.when((c("kind") == "open") & (c("fd") >= 0), c("path")).when(c("kind") == "close", "")
    keys = ["run_id", "pid", "fd"]
    seen = ordered_scan(rows, keys, ["seq"], block, held=last_known(state))
    path = F.when(c("fd") < 0, None).when(c("kind") == "open", c("path")).otherwise(F.nullif("held", F.lit("")))
    zero = F.lit(0).cast("long")
    failed = c("kind").isin("read", "write") & ~F.coalesce(c("ret") >= 0, F.lit(False))
    used = (seen.select("run_id", path.alias("path"), "kind", "ret", zero.alias("leak"))
            .where(c("path").isNotNull() & ~failed))
    last = (rows.where(c("kind").isin("open", "close")).groupBy(*keys)
            .agg(F.max_by(state, "seq").alias("path")).where(c("path") != "")
            .select("run_id", "path", F.lit("end").alias("kind"), zero.alias("ret"), F.lit(1).cast("long").alias("leak")))

    def n(kind: str) -> Column:
        return F.count_if(c("kind") == kind)

    def volume(kind: str) -> Column:
        return F.sum(F.when(c("kind") == kind, c("ret")).otherwise(0))

    return used.unionByName(last).groupBy("run_id", "path").agg(
        n("open").alias("opens"), n("close").alias("closes"), n("read").alias("reads"), n("write").alias("writes"),
        volume("read").alias("read_bytes"), volume("write").alias("write_bytes"), F.sum("leak").alias("leaked"))


def file_io_summary(io: DataFrame) -> DataFrame:
    """Each file's share of the busiest file's accesses, and the run's file and leak counts."""
    access = c("opens") + c("reads") + c("writes")
    run = io.groupBy("run_id").agg(F.count("*").alias("files"), F.count_if(c("leaked") > 0).alias("leaky_files"),
                                   F.max(access).alias("top"))
    return io.join(run, "run_id").select("run_id", "path", access.alias("accesses"), "files", "leaky_files",
                                         (access / F.greatest(c("top"), F.lit(1))).alias("share_of_top"))


def fork_edges(events: DataFrame) -> DataFrame:
    """(run_id, pid, parent_pid) from the return values of process-creating calls; the latest creator wins."""
    child = retval_int("retval")
    return (events.where(c("syscall").isin(names.FORK_CALLS) & (child > 0) & c("pid").isNotNull())
            .groupBy("run_id", child.alias("pid")).agg(F.max_by("pid", "seq").alias("parent_pid")))


def process_table(events: DataFrame) -> DataFrame:
    """E5: one row per process, also for children that never made a call of their own."""
    exec_path = F.when(c("syscall").isin(names.EXEC_CALLS) & _filled("path"), c("path"))
    own = events.where(c("pid").isNotNull()).groupBy("run_id", "pid").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count_if(c("event_type") == "syscall").alias("syscalls"),
        F.max_by(exec_path, F.when(exec_path.isNotNull(), c("seq"))).alias("command"),
        F.bool_or(c("event_type") == "exit").alias("exited"))
    life = c("last_us") - c("first_us")
    return own.join(fork_edges(events), ["run_id", "pid"], "full_outer").select(
        "run_id", "pid", "parent_pid", "command", F.coalesce("syscalls", F.lit(0).cast("long")).alias("syscalls"),
        "first_us", "last_us", F.coalesce("exited", F.lit(False)).alias("exited"),
        (life / 1000.0).alias("duration_ms"), F.coalesce(life <= EPHEMERAL_US, F.lit(False)).alias("ephemeral"))


def _dials(events: DataFrame, block: Column) -> DataFrame:
    """Connects with the row that follows them among the same process's connects and polls."""
    call = c("syscall")
    poll = call.isin(names.POLL_CALLS)
    rows = events.where((c("event_type") == "syscall") & ((call == "connect") | poll) & c("pid").isNotNull()).select(
        "run_id", "pid", "seq", "ts_us", "syscall", "args", "retval", "error", "lat_us", "fd", "path",
        poll.alias("is_poll"))
    nxt = ordered_scan(rows, ["run_id", "pid"], ["seq"], block, nxt=following("is_poll", "lat_us", "retval"))
    return nxt.where(~c("is_poll"))


def connections(events: DataFrame, block: Column | None = None) -> DataFrame:
    """Every connect with its address, outcome and, for non-blocking ones, the wait of the poll after it."""
    dial = _dials(events, block if block is not None else seq_block())
    result = connect_result("error")
    waited = (result == "connecting") & c("nxt.is_poll")
    outcome = F.when(waited, F.when(F.coalesce(retval_int("nxt.retval") == 0, F.lit(False)), "timed out").otherwise("ok"))
    lat = F.when(waited & c("nxt.lat_us").isNotNull(), F.coalesce("lat_us", F.lit(0)) + c("nxt.lat_us")).otherwise(
        c("lat_us"))
    a = socket_address("args")
    return dial.select("run_id", "seq", "pid", a["family"].alias("family"), a["address"].alias("address"),
                       a["port"].alias("port"), F.coalesce(outcome, result).alias("result"),
                       (lat / 1000.0).alias("latency_ms"))


def connection_summary(conns: DataFrame) -> DataFrame:
    """Connections, distinct addresses and failures per run."""
    failed = ~c("result").isin("ok", "connecting")
    return conns.groupBy("run_id").agg(F.count("*").alias("connections"), F.countDistinct("address").alias("hosts"),
                                       F.count_if(failed).alias("failures"))


# Reads that wait for the other side of a socket.
SOCKET_READS = ["read", "recv", "recvfrom", "recvmsg", "readv"]


def peer_waits(events: DataFrame, min_us: int, block: Column | None = None) -> DataFrame:
    """Long reads with the peer their descriptor was last connected to (connects count even when they failed)."""
    call = c("syscall")
    rows = (events.where((call == "connect") | (call == "close")
                         | (call.isin(SOCKET_READS) & (c("lat_us") > min_us)))
            .withColumn("held_fd", fd_or_first_arg("fd", "args")).where(c("held_fd").isNotNull() & c("pid").isNotNull()))
    state = F.when(call == "connect", peer_key("args")).when(call == "close", "")
    seen = ordered_scan(rows, ["run_id", "pid", "held_fd"], ["seq"], block if block is not None else seq_block(),
                        peer=last_known(state))
    return seen.where(call.isin(SOCKET_READS) & (F.coalesce("peer", F.lit("")) != "")).drop("held_fd")


def network_waits(events: DataFrame, cols: list[str], dial_us: int, read_us: int, block: Column | None = None) -> DataFrame:
    """R3 and R4 rows (`cols` and `peer`) by one scan: slow connects, whose peer is null, and long reads with their peer.

    A connect is slow by itself, or non-blocking with a slow poll right after it among its process's connects and polls.
    Each row takes its place on the lane of its process's dials, of its descriptor, or on both; a lane is a key of the scan.
    """
    call = c("syscall")
    poll, read = call.isin(names.POLL_CALLS), call.isin(SOCKET_READS) & (c("lat_us") > read_us)
    held = fd_or_first_arg("fd", "args")
    connects = call == "connect"
    lanes = [F.when(connects | poll, F.struct(F.lit("dial").alias("kind"), F.lit(0).alias("of"))),
             F.when((connects | (call == "close") | read) & held.isNotNull(), F.struct(F.lit("held").alias("kind"), held.alias("of")))]
    rows = fan_out(events.where(c("pid").isNotNull() & (connects | poll | (call == "close") | read)), cols, lanes, "lane")
    rows = rows.select(*cols, c("lane.kind").alias("lane"), c("lane.of").alias("lane_of"))
    dial = c("lane") == "dial"
    state = F.when(call == "connect", peer_key("args")).when(call == "close", "")
    seen = ordered_scan(rows, ["run_id", "pid", "lane", "lane_of"], ["seq"], block if block is not None else seq_block(), shared=True,
                        nxt=following("syscall", "lat_us"), peer=last_known(F.when(~dial, state)))
    waited = c("error").isin(names.IN_PROGRESS) & c("nxt.syscall").isin(names.POLL_CALLS) & (c("nxt.lat_us") > dial_us)
    slow = dial & (call == "connect") & (F.coalesce(c("lat_us") > dial_us, F.lit(False)) | F.coalesce(waited, F.lit(False)))
    answered = ~dial & call.isin(SOCKET_READS) & (F.coalesce("peer", F.lit("")) != "")
    return seen.where(slow | answered).select(*cols, F.when(~dial, c("peer")).alias("peer"))


def library_calls(events: DataFrame, limit: int = 50) -> DataFrame:
    """The most expensive library functions; the average is over all calls, timed or not."""
    rows = (events.where((c("event_type") == "libcall") & _filled("syscall")).groupBy("run_id", c("syscall").alias("function"))
            .agg(F.count("*").alias("calls"), F.coalesce(F.sum("lat_us"), F.lit(0)).alias("total"),
                 F.count_if(_filled("error")).alias("errors"), F.min("seq").alias("first_seq")))
    top = top_k(rows, ["run_id"], [F.desc("total"), F.desc("calls"), F.asc("first_seq")], limit)
    return top.select("run_id", "function", "calls", (c("total") / 1000.0).alias("total_ms"),
                      (c("total") / c("calls") / 1000.0).alias("avg_ms"), "errors")


def run_totals(events: DataFrame) -> DataFrame:
    """Event, call, error and signal counts per run. Library calls and process ends are not calls."""
    call = ~c("event_type").isin("signal", "exit", "libcall")
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if(c("event_type") == "signal").alias("signals"),
        F.count_if(call).alias("syscall_events"), F.count_if(call & c("error").isNotNull()).alias("errors"))


def top_calls(events: DataFrame, k: int = 10) -> DataFrame:
    """K1: the k most frequent calls per run; ties go to the one seen first."""
    n = (events.where(~c("event_type").isin("signal", "exit", "libcall") & _filled("syscall"))
         .groupBy("run_id", "syscall").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")))
    return top_k(n, ["run_id"], [F.desc("count"), F.asc("first_seq")], k, rank="rank").drop("first_seq")


def call_rate(events: DataFrame, metrics: DataFrame, block: Column | None = None) -> DataFrame:
    """Calls per second in (previous sample, sample]; the first bin is 250 ms wide.

    The count up to each sample is a running sum over events and samples together; a bin is the difference of two.
    Blocks are hours, cut finer where an hour of a run is dense.
    """
    zero = F.lit(0).cast("long")
    calls = (events.where(~c("event_type").isin("signal", "exit", "libcall")).groupBy("run_id", "ts_us")
             .agg(F.count("*").alias("n")).withColumn("kind", F.lit(0)))
    live = calls.select("run_id").distinct()
    ticks = metrics.select("run_id", "ts_us").distinct().join(live, "run_id", "left_semi")
    starts = ticks.groupBy("run_id").agg((F.min("ts_us") - FIRST_BIN_US).alias("ts_us"))
    marks = (ticks.withColumn("kind", F.lit(2)).unionByName(starts.withColumn("kind", F.lit(1))).withColumn("n", zero))
    both, order = calls.unionByName(marks), ["ts_us", "kind"]
    both = both.withColumn("at", block) if block is not None else even_blocks(both, ["run_id"], "ts_us", "at", TIME_UNITS_US)
    line = ordered_scan(both, ["run_id"], order, c("at"), shared=True, upto=running(c("n")))
    bins = ordered_scan(line.where("kind > 0").select("run_id", *order, "at", "upto"), ["run_id"], order, c("at"),
                        last=prev("ts_us", "upto"))
    gap = c("ts_us") - c("last.ts_us")
    return bins.where((c("kind") == 2) & (gap > 0)).select(
        "run_id", "ts_us", (c("upto") - c("last.upto")).alias("calls"),
        ((c("upto") - c("last.upto")) / (gap / 1_000_000.0)).alias("syscall_rate"))


def with_call_rate(metrics: DataFrame, rates: DataFrame) -> DataFrame:
    """Samples with their rate filled in; samples without one keep what they had."""
    had = c("m.syscall_rate") if "syscall_rate" in metrics.columns else F.lit(None).cast("double")
    rest = [c(f"m.{n}") for n in metrics.columns if n != "syscall_rate"]
    m, r = metrics.alias("m"), rates.select("run_id", "ts_us", "syscall_rate").alias("r")
    on = (c("m.run_id") == c("r.run_id")) & (c("m.ts_us") == c("r.ts_us"))
    return m.join(r, on, "left").select(*rest, F.coalesce(c("r.syscall_rate"), had).alias("syscall_rate"))
