"""What happened when: timeline marks, collapsed errors, curated events, output inside findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import is_curation_noise, timeline_kind
from ..plans.scan import TIME_UNITS_US, even_blocks, ordered_scan, prev, running
from ..plans.topk import top_k

c = F.col
MARKS, CURATED, DIGEST_LINES = 800, 3000, 22
SLOW_US = 100_000
EXEC_TEXT = 50  # characters of a started program that a printed line shows


def marks(events: DataFrame, cap: int = MARKS) -> DataFrame:
    """The first `cap` errors, slow calls, signals and program starts of each run with a label."""
    kind = timeline_kind(c("error"), c("lat_us"), c("event_type"), c("syscall"))
    call = F.coalesce("syscall", F.lit(""))
    label = (F.when(c("kind") == "error", F.concat(call, F.lit(" -> "), c("error")))
             .when(c("kind") == "slow", F.concat(call, F.lit(" took "), F.round(c("lat_us") / 1000).cast("long").cast("string"),
                                                 F.lit("ms"))).otherwise(call))
    rows = events.select("run_id", "seq", "ts_us", "syscall", "error", "lat_us", kind.alias("kind")).where(c("kind").isNotNull())
    first = top_k(rows, ["run_id"], [F.asc("ts_us"), F.asc("seq")], cap)
    return first.select("run_id", "seq", "ts_us", "kind", label.alias("label"))


def notable(events: DataFrame) -> DataFrame:
    """Signals, exits, errors, slow calls, program starts - the rows a digest is made from."""
    err = F.coalesce(c("error"), F.lit("")) != ""
    kind = (F.when(c("event_type").isin("signal", "exit"), c("event_type")).when(err, "error")
            .when(c("lat_us") > SLOW_US, "slow").when(c("syscall").isin(names.EXEC_CALLS), "exec"))
    extra = (F.when(c("event_type").isin("signal", "exit"), c("retval"))
             .when(~err & ~F.coalesce(c("lat_us") > SLOW_US, F.lit(False)),
                   F.coalesce(F.nullif(c("path"), F.lit("")), c("args"))))
    return events.where(c("ts_us").isNotNull()).select(
        "run_id", "seq", "ts_us", kind.alias("kind"), "syscall", "error", "lat_us", extra.alias("extra")).where(
        c("kind").isNotNull())


def collapsed_errors(events: DataFrame, block: Column | None = None) -> DataFrame:
    """Consecutive errors of the same call and code become one row with a count and a time range. Blocks are hours, cut finer
    where an hour of a run is dense."""
    order, at = ["ts_us", "seq"], c("block_at")
    rows = notable(events)
    rows = rows.withColumn("block_at", block) if block is not None else even_blocks(rows, ["run_id"], "ts_us", "block_at", TIME_UNITS_US)
    seen = ordered_scan(rows, ["run_id"], order, at, shared=True, before=prev("kind", "syscall", "error"))
    same = ((c("kind") == "error") & (c("before.kind") == "error") & c("before.syscall").eqNullSafe(c("syscall"))
            & (c("before.error") == c("error")))
    flat = seen.select(*rows.columns, F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1).cast("long").alias("opens"))
    cut = ordered_scan(flat, ["run_id"], order, at, shared=True, island=running(c("opens")))
    first = F.min_by(F.struct("kind", "syscall", "error", "lat_us", "extra"), F.struct(*order))
    return cut.groupBy("run_id", "island").agg(
        first.alias("f"), F.min(F.struct(*order)).alias("at"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"),
        F.sum("opens").alias("opens")).select(
        "run_id", "island", c("at.ts_us").alias("first_us"), "last_us", "n", "f.*")


def centis(us: Column) -> Column:
    """Microseconds as seconds with two decimals, in integer arithmetic."""
    cs = F.floor((us + 5000) / 10_000).cast("long")
    return F.concat(F.floor(cs / 100).cast("string"), F.lit("."), F.lpad((F.abs(cs) % 100).cast("string"), 2, "0"))


def timeline_lines(events: DataFrame, starts: DataFrame, limit: int = DIGEST_LINES, block: Column | None = None) -> DataFrame:
    """K7: at most `limit` digest lines per run; the last one says how many more there are. `starts` has (run_id, started_us)."""
    rows = collapsed_errors(events, block)
    n = rows.groupBy("run_id").agg(F.count("*").alias("lines"))
    first = top_k(rows, ["run_id"], [F.asc("island")], limit, rank="line")
    t = first.join(n, "run_id").join(starts, "run_id")
    plus = F.concat(F.lit("+"), centis(c("first_us") - c("started_us")))
    call = F.coalesce("syscall", F.lit(""))
    text = (F.when((c("kind") == "error") & (c("n") > 1), F.concat(
                plus, F.lit("-"), centis(c("last_us") - c("started_us")), F.lit("s "), call, F.lit(" -> "), c("error"), F.lit(" x"),
                c("n").cast("string")))
            .when(c("kind") == "error", F.concat(plus, F.lit("s "), call, F.lit(" -> "), c("error")))
            .when(c("kind") == "slow", F.concat(plus, F.lit("s "), call, F.lit(" took "),
                                                F.floor((c("lat_us") + 500) / 1000).cast("string"), F.lit("ms")))
            .when(c("kind") == "exec", F.rtrim(F.concat(plus, F.lit("s exec "), F.trim(F.substring(F.coalesce("extra", F.lit("")), 1, EXEC_TEXT)))))
            .when(c("kind") == "signal", F.concat(plus, F.lit("s signal "), call))
            .otherwise(F.rtrim(F.concat(plus, F.lit("s exited "), F.coalesce("extra", "error", F.lit(""))))))
    more = F.concat(F.lit("... ("), (c("lines") - (limit - 1)).cast("string"), F.lit(" more)"))
    return t.select("run_id", "line", F.when((c("lines") > limit) & (c("line") == limit), more).otherwise(text).alias("text"))


def curated_events(events: DataFrame, evidence: DataFrame, cap: int = CURATED) -> DataFrame:
    """K3: the events worth keeping - evidence first, then signals, exits, program starts, slow calls, errors - in time order."""
    worth = (c("event_type").isin("signal", "exit") | F.coalesce(c("syscall").isin(names.EXEC_CALLS), F.lit(False))
             | F.coalesce(c("lat_us") > SLOW_US, F.lit(False)) | (c("error").isNotNull() & ~is_curation_noise("path")))
    proof = evidence.select("run_id", "seq").distinct().withColumn("prio", F.lit(0))
    rest = events.where(worth).select("run_id", "seq").withColumn("prio", F.lit(1))
    once = proof.unionByName(rest).groupBy("run_id", "seq").agg(F.min("prio").alias("prio"))
    kept = top_k(once, ["run_id"], [F.asc("prio"), F.asc("seq")], cap, salt_on=["seq"]).drop("prio")
    return events.join(kept, ["run_id", "seq"], "left_semi")


def link_evidence(findings: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings with the ids of their evidence among the stored events (run_id, seq, event_id), in evidence order."""
    ids = (evidence.select("run_id", "rule_id", "seq", "rank").join(stored.select("run_id", "seq", "event_id"), ["run_id", "seq"])
           .groupBy("run_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))),
                                                         lambda s: s["event_id"]).alias("evidence_ids")))
    none = F.array().cast("array<string>")
    return findings.join(ids, ["run_id", "rule_id"], "left").withColumn("evidence_ids", F.coalesce(
        F.transform("evidence_ids", lambda x: x.cast("string")), none))


def inside_windows(points: DataFrame, windows: DataFrame, start: str, end: str, at: str = "ts_us",
                   block: Column | None = None) -> DataFrame:
    """The points that lie in at least one closed window of their run. A sweep: windows open and close, points look;
    blocks are hours, cut finer where an hour of a run is dense."""
    opened = windows.where(c(start).isNotNull() & c(end).isNotNull())
    edges = opened.select("run_id", F.explode(F.array(
        F.struct(c(start).alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("step")),
        F.struct(c(end).alias("at"), F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("step")))).alias("e"))
    edges = edges.select("run_id", "e.*").groupBy("run_id", "at", "kind").agg(F.sum("step").alias("step"))
    row = F.struct(*[c(n) for n in points.columns])
    looks = points.select("run_id", c(at).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step"), row.alias("p"))
    line = looks.unionByName(edges, allowMissingColumns=True)
    line = line.withColumn("block_at", block) if block is not None else even_blocks(line, ["run_id"], "at", "block_at", TIME_UNITS_US)
    swept = ordered_scan(line, ["run_id"], ["at", "kind"], c("block_at"), shared=True, open=running(c("step")))
    return swept.where((c("kind") == 1) & (c("open") > 0)).select("p.*")
