"""Probe-output ingest: request, query, off-CPU and histogram text of many runs -> spans, intervals, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import scrub_sql, sql_name, try_long
from ..plans.scan import last_known_incl, ordered_scan, prev
from ..plans.topk import top_k
from .lines import in_order, line_block, sections

# The sizes of the live views (newest spans, intervals, pauses); the ingest jobs keep everything.
KEEP_SPANS, KEEP_INTERVALS, KEEP_GC = 4000, 32000, 2000


def keep_last(df: DataFrame, keys: list[str], n: int | None, order: str = "seq") -> DataFrame:
    """The newest n rows of each key (K8)."""
    return df if n is None else top_k(df, keys, [F.desc(order)], n, salt_on=[order])


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _int(words: Column, i: int) -> Column:
    w = F.get(words, F.lit(i))
    return F.when(w.rlike("^[+-]?[0-9]+$"), try_long(w))


def http_spans(lines: DataFrame, keep: int | None = None) -> DataFrame:
    """REQ and RSP lines, matched on the start time (J6): each answer takes the latest open request of its key."""
    f = _words(F.col("line"))
    req = (lines.where(F.col("line").startswith("REQ ") & (F.size(f) >= 6))
           .select("run_id", "seq", _int(f, 1).alias("start_ns"), _int(f, 2).alias("pid"), _int(f, 3).alias("tid"),
                   F.get(f, F.lit(4)).alias("method"), F.get(F.split(F.get(f, F.lit(5)), r"\?"), F.lit(0)).alias("route"),
                   F.lit("q").alias("side"), F.lit(None).cast("long").alias("end_ns"),
                   F.lit(None).cast("int").alias("status"))
           .where("start_ns IS NOT NULL AND pid IS NOT NULL AND tid IS NOT NULL"))
    none = F.lit(None)
    rsp = (lines.where(F.col("line").startswith("RSP ") & (F.size(f) >= 4))
           .select("run_id", "seq", _int(f, 1).alias("start_ns"), none.cast("long").alias("pid"),
                   none.cast("long").alias("tid"), none.cast("string").alias("method"),
                   none.cast("string").alias("route"), F.lit("r").alias("side"), _int(f, 2).alias("end_ns"),
                   _int(f, 3).cast("int").alias("status"))
           .where("start_ns IS NOT NULL AND end_ns IS NOT NULL"))
    # A key is answered once: an answer directly after a request takes it, a second answer in a row finds none.
    both = ordered_scan(req.unionByName(rsp), ["run_id", "start_ns"], ["seq"], line_block(),
                        q=prev("side", "pid", "tid", "method", "route"))
    out = (both.where((F.col("side") == "r") & (F.col("q.side") == "q"))
           .select("run_id", "seq", F.col("seq").alias("span_id"), "q.tid", "q.pid", "start_ns",
                   F.greatest(F.lit(0).cast("long"), F.col("end_ns") - F.col("start_ns")).alias("dur_ns"),
                   "q.method", "q.route", "status"))
    return keep_last(out, ["run_id"], keep)


def db_spans(lines: DataFrame, keep: int | None = None) -> DataFrame:
    f = F.split(F.ltrim(F.col("line")), r"\s+", 6)
    stmt = scrub_sql(F.coalesce(F.get(f, F.lit(5)), F.lit("")))
    out = (lines.where(F.col("line").startswith("SQL "))
           .select("run_id", "seq", F.col("seq").alias("db_id"), _int(f, 3).alias("tid"), _int(f, 2).alias("pid"),
                   _int(f, 1).alias("start_ns"), _int(f, 4).alias("dur_ns"), sql_name(stmt).alias("name"),
                   F.substring(stmt, 1, 200).alias("statement"))
           .where("start_ns IS NOT NULL AND pid IS NOT NULL AND tid IS NOT NULL AND dur_ns IS NOT NULL"))
    return keep_last(out, ["run_id"], keep)


def thread_intervals(lines: DataFrame, keep: int | None = None) -> DataFrame:
    f = _words(F.col("line"))
    off = F.col("line").startswith("OFF ")
    code = _int(f, 4)
    reason = F.lit("other")
    for n, name in names.OFF_REASON_CODES.items():
        reason = F.when(code == n, name).otherwise(reason)
    out = (lines.where(off | F.col("line").startswith("RQ "))
           .select("run_id", "seq", F.when(off, "off").otherwise("rq").alias("kind"), _int(f, 1).alias("tid"),
                   _int(f, 2).alias("start_ns"), _int(f, 3).alias("dur_ns"), code.alias("code"),
                   F.when(off, reason).alias("reason"))
           .where("tid IS NOT NULL AND start_ns IS NOT NULL AND dur_ns IS NOT NULL")
           .where((F.col("kind") == "rq") | F.col("code").isNotNull()).drop("code"))
    return keep_last(out, ["run_id"], keep)


# Histogram rows in the two printed layouts, and the suffixes of large bounds.
_LOG2_HEAD = r"(?i)^\s*(nsecs|usecs|msecs|secs)\s*:\s*count"
_LOG2_ROW = r"^\s*(\d+)\s*->\s*(\d+)\s*:\s*(\d+)"
_MAP_ROW = r"\[(\d+[KMGT]?)(?:,\s*(\d+[KMGT]?))?[\])]\s+(\d+)\s*\|"
_SUFFIX = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def _bound(text: Column) -> Column:
    n = F.regexp_extract(text, r"^(\d+)", 1).try_cast("long")
    factor = F.lit(1).cast("long")
    for s, v in _SUFFIX.items():
        factor = F.when(text.endswith(s), F.lit(v).cast("long")).otherwise(factor)
    return n * factor


def log2_histograms(lines: DataFrame, hist: str = "latency") -> DataFrame:
    """`lo -> hi : n` rows; the unit comes from the nearest header above, microseconds when there is none."""
    line = F.col("line")
    unit = F.when(line.rlike(_LOG2_HEAD), F.lower(F.regexp_extract(line, _LOG2_HEAD, 1)))
    named = ordered_scan(lines.where(line.rlike(_LOG2_HEAD) | line.rlike(_LOG2_ROW)), ["run_id"], ["seq"], line_block(),
                         unit=last_known_incl(unit))
    return (named.where(line.rlike(_LOG2_ROW))
            .select("run_id", F.lit(hist).alias("hist"), F.coalesce("unit", F.lit("usecs")).alias("unit"), "seq",
                    *[F.regexp_extract("line", _LOG2_ROW, i).cast("long").alias(n)
                      for i, n in ((1, "lo"), (2, "hi"), (3, "count"))]))


def map_histograms(lines: DataFrame, units: dict[str, str]) -> DataFrame:
    """`[lo, hi) n |` rows of a dump with several named maps; `units` says which maps to keep and their unit."""
    trimmed = F.trim("line")
    name = F.when(trimmed.startswith("@"), F.regexp_extract(trimmed, r"^@([^:]*):?", 1))
    named = ordered_scan(lines.where(trimmed.startswith("@") | F.col("line").rlike(_MAP_ROW)), ["run_id"], ["seq"],
                         line_block(), hist=last_known_incl(name))
    unit = F.lit(None).cast("string")
    for n, u in units.items():
        unit = F.when(F.col("hist") == n, u).otherwise(unit)
    lo = F.regexp_extract("line", _MAP_ROW, 1)
    hi = F.nullif(F.regexp_extract("line", _MAP_ROW, 2), F.lit(""))
    return (named.where(F.col("hist").isin(list(units)) & F.col("line").rlike(_MAP_ROW) & ~trimmed.startswith("@"))
            .select("run_id", "hist", unit.alias("unit"), "seq", _bound(lo).alias("lo"),
                    _bound(F.coalesce(hi, lo)).alias("hi"),
                    F.regexp_extract("line", _MAP_ROW, 3).cast("long").alias("count")))


def block_io(lines: DataFrame, pids: DataFrame) -> DataFrame:
    """Block-I/O rows of the wanted processes. `pids` has (run_id, pid). Latency is kept in integer nanoseconds."""
    f = _words(F.col("line"))
    rows = (lines.select("run_id", "seq", f.alias("f"))
            .where((F.size("f") >= 8) & (F.get("f", F.lit(0)) != "TIME(s)") & F.get("f", F.lit(2)).rlike("^[0-9]+$"))
            .select("run_id", "seq", F.get("f", F.lit(2)).cast("long").alias("pid"),
                    F.element_at("f", -1).try_cast("double").alias("lat_ms"), F.get("f", F.lit(4)).alias("rw"),
                    F.get("f", F.lit(6)).try_cast("long").alias("bytes")))
    return (rows.where(F.col("lat_ms").isNotNull()).join(pids.select("run_id", "pid").distinct(), ["run_id", "pid"],
                                                         "left_semi")
            .withColumn("lat_ns", F.round(F.col("lat_ms") * 1_000_000).cast("long")))


def gc_pauses(lines: DataFrame, keep: int | None = None) -> DataFrame:
    """`GC <abs ns> <dur us>` lines -> (run_id, seq, start_ns since the run's first, dur_us)."""
    f = _words(F.col("line"))
    rows = (lines.where((F.size(f) == 3) & (F.get(f, F.lit(0)) == "GC") & F.get(f, F.lit(1)).rlike("^[0-9]+$")
                        & F.get(f, F.lit(2)).rlike("^[0-9]+$"))
            .select("run_id", "seq", _int(f, 1).alias("at_ns"), _int(f, 2).alias("dur_us")))
    first = rows.groupBy("run_id").agg(F.min_by("at_ns", "seq").alias("t0"))
    out = rows.join(first, "run_id").select("run_id", "seq", (F.col("at_ns") - F.col("t0")).alias("start_ns"),
                                            "dur_us")
    return keep_last(out, ["run_id"], keep)


def gc_table(lines: DataFrame, keep: int | None = None) -> DataFrame:
    """`start duration ...` rows; the unit (ms unless the header says us) comes from the header above."""
    s = F.trim("line")
    low = F.lower(s)
    header = low.startswith("tracing") | low.startswith("start")
    f = _words(F.col("line"))
    scale = F.when(header & (low.contains("(us)") | low.contains("usec")), F.lit(0.001))
    scaled = ordered_scan(lines.where(s != ""), ["run_id"], ["seq"], line_block(), scale=last_known_incl(scale))
    start, dur = F.get(f, F.lit(0)).try_cast("double"), F.get(f, F.lit(1)).try_cast("double")
    out = (scaled.where(~header & (F.size(f) >= 2) & start.isNotNull() & dur.isNotNull())
           .select("run_id", "seq", F.round(start, 3).alias("start_s"),
                   F.round(dur * F.coalesce("scale", F.lit(1.0)), 3).alias("duration_ms")))
    return keep_last(out, ["run_id"], keep)


# The layout of an off-CPU stack dump, and the scheduler frames that end every such stack.
_OSTK_HEAD = r"^@ostk\[(\d+),\s*$"
_OSTK_END = r"^\]:\s*(\d+)\s*$"
_KERNEL_FRAME = r"^\s*(.+?)(?:\+(?:0x[0-9a-fA-F]+|\d+))?\s*$"
SCHED_EPILOGUE = ["perf_trace_sched_switch", "__traceiter_sched_switch", "__schedule", "schedule", "schedule_idle"]


def offcpu_stacks(lines: DataFrame) -> DataFrame:
    """Stack-dump blocks -> (run_id, tid, frames root to leaf, weight in microseconds)."""
    line = F.col("line")
    head, end = line.rlike(_OSTK_HEAD), line.rlike(_OSTK_END)
    # A section is a header and what follows; lines after its first end line belong to no block.
    cut = sections(lines, head).where(F.col("section") > 0)
    ended = ordered_scan(cut, ["run_id", "section"], ["seq"], line_block(),
                         done=last_known_incl(F.when(end, F.col("seq"))))
    inner = ended.where(F.col("done").isNull() | (end & (F.col("done") == F.col("seq"))))
    first_end = inner.groupBy("run_id", "section").agg(
        F.max(F.when(head, F.regexp_extract("line", _OSTK_HEAD, 1))).alias("tid"),
        F.min_by(F.when(end, F.regexp_extract("line", _OSTK_END, 1)), F.when(end, F.col("seq"))).alias("ns"),
        in_order(F.when(~head & ~end, F.trim(F.regexp_extract("line", _KERNEL_FRAME, 1)))).alias("raw"))
    frames = F.filter("raw", lambda x: x.isNotNull() & (x != ""))
    real = F.aggregate(frames, F.array().cast("array<string>"),
                       lambda acc, x: F.when((F.size(acc) == 0) & x.isin(SCHED_EPILOGUE), acc)
                       .otherwise(F.concat(acc, F.array(x))))
    return (first_end.where(F.col("ns").isNotNull()).withColumn("frames", F.reverse(real))
            .where(F.size("frames") > 0)
            .select("run_id", F.col("tid").cast("long").alias("tid"), "frames",
                    F.greatest(F.lit(1).cast("long"), F.floor(F.col("ns").cast("long") / 1000)).alias("weight")))
