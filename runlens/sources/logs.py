"""Call-log ingest: raw lines of many runs -> trace_events (A1, A2, J1) and program output (A3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import call_fd, call_path
from ..plans.rows import project_where
from ..plans.scan import ordered_scan, prev
from .lines import in_order, line_block, sections


@dataclass(frozen=True)
class Dialect:
    """The line patterns of one kind of log."""

    source: str
    lead: str         # everything before the body: pid, seconds, microsecond digits
    name: str
    ret: str
    signal: str
    exited: str
    path_calls: list[str]
    fd_calls: list[str]
    library: bool     # a split call keeps the name of its first half; @SYS marks a real call


_ERR = r"(?:\s+(E[A-Z][A-Z0-9]*))?(?:\s+\([^)]*\))?\s*$"

SYSCALL_LOG = Dialect(
    source="strace", lead=r"^\s*(?:\d+\s+)?\d+\.\d+\s+", name=r"[A-Za-z_]\w*",
    ret=r"=\s*(-?\d+|0x[0-9a-fA-F]+|\?)" + _ERR, signal=r"---\s+([A-Z][A-Z0-9+]*)\b",
    exited=r"\+\+\+\s+(?:exited with (\d+)|killed by ([A-Z0-9]+))",
    path_calls=names.SYSCALL_LOG_PATH_CALLS, fd_calls=names.SYSCALL_LOG_FD_CALLS, library=False)

LIBRARY_LOG = Dialect(
    source="ltrace", lead=r"^\s*(?:\[pid\s+\d+\]\s+)?(?:\d+\s+)?\d+\.\d+\s+", name=r"[A-Za-z_][\w@]*",
    ret=r'=\s*(0x[0-9a-fA-F]+|-?\d+|<[^>]*>|"(?:[^"\\]|\\.)*"|[^\s=]+)' + _ERR, signal=r"---\s+([A-Z][A-Z0-9]*)\b",
    exited=r"\+\+\+\s+(?:exited \(status (\d+)\)|killed by ([A-Z0-9]+))",
    path_calls=names.LIBRARY_LOG_PATH_CALLS, fd_calls=names.LIBRARY_LOG_FD_CALLS, library=True)

_DUR = r"<(\d+)\.(\d+)>\s*$"
_CUT = r"<unfinished \.\.\.>\s*$"
_RESUMED = r"<\.\.\.\s+([\w@]+)\s+resumed>"


def _micros(seconds: Column, digits: Column) -> Column:
    return seconds.cast("long") * 1_000_000 + F.rpad(F.substring(digits, 1, 6), 6, "0").cast("long")


def _without_tail(text: Column, tail: Column) -> Column:
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(tail)))


def parse_log(lines: DataFrame, dialect: Dialect = SYSCALL_LOG, block: Column | None = None) -> DataFrame:
    """(run_id, seq, line) -> trace_events. Lines that are no event are skipped.

    Only the rows of the two split shapes go through a shuffle; whole calls, signals and exits are a plain projection.
    Which is which is decided on the raw line, so these filters run right at the scan.
    """
    d, line = dialect, F.col("line")
    mark = line.rlike(f"{d.lead}(?:{d.signal}|{d.exited})")
    resumed = line.rlike(d.lead + _RESUMED)
    cut = line.rlike(_CUT) & ~mark
    first_half = cut & line.rlike(rf"{d.lead}{d.name}\(")
    whole = _located(lines.where(line.rlike(d.lead) & ~resumed & ~cut), d)
    halves = _located(lines.where(resumed | first_half), d)
    return _events(whole, d).unionByName(_events(_joined(halves, d, block if block is not None else line_block()), d))


def _located(lines: DataFrame, d: Dialect) -> DataFrame:
    """Split off the prefix; a line without a pid belongs to pid 0."""
    lead = lines.select("run_id", "seq", "line", F.regexp_extract("line", d.lead, 0).alias("_lead"))
    stamp = F.regexp_extract("_lead", r"(\d+)\.(\d+)\s+$", 0)
    pid = F.coalesce(*[F.nullif(F.regexp_extract("_lead", p, 1), F.lit("")) for p in
                       (r"(\d+)\s+\d+\.\d+\s+$", r"\[pid\s+(\d+)\]")], F.lit("0"))
    dot = F.split(F.trim(stamp), r"\.")
    return lead.select("run_id", "seq", pid.cast("long").alias("pid"), _micros(F.get(dot, F.lit(0)), F.get(dot, F.lit(1))).alias("ts_us"),
                       F.regexp_replace(F.substring(F.col("line"), F.length("_lead") + 1, F.lit(2 ** 31 - 1)), r"\s+$", "").alias("body"))


def _joined(halves: DataFrame, d: Dialect, block: Column) -> DataFrame:
    """A resumed line belongs to the split line right before it among its thread's split and resumed lines."""
    body = F.col("body")
    part = F.regexp_replace(body, _CUT, "")
    if d.library:
        part = F.rtrim(part)
    is_open = ~body.rlike("^" + _RESUMED)
    shaped = halves.select("run_id", "seq", "pid", "ts_us", "body", is_open.alias("is_open"),
                           F.when(is_open, F.regexp_extract(part, rf"^({d.name})\(", 1)).alias("_name"),
                           F.when(is_open, F.regexp_replace(part, rf"^{d.name}\(", "")).alias("_args"))
    paired = ordered_scan(shaped, ["run_id", "pid"], ["seq"], block, before=prev("is_open", "_name", "_args", "ts_us"))
    pending = F.when(F.col("before.is_open"), F.col("before"))
    own = F.regexp_extract(body, "^" + _RESUMED, 1)
    name = F.coalesce(pending["_name"], own) if d.library else own
    merged = F.concat(name, F.lit("("), F.coalesce(pending["_args"], F.lit("")), F.regexp_replace(body, "^" + _RESUMED, ""))
    return paired.where(~F.col("is_open")).select(
        "run_id", "seq", "pid", F.coalesce(pending["ts_us"], F.col("ts_us")).alias("ts_us"), merged.alias("body"))


def _events(rows: DataFrame, d: Dialect) -> DataFrame:
    body = F.col("body")
    shape = F.when(body.rlike("^" + d.signal), "signal").when(body.rlike("^" + d.exited), "exit").otherwise("call")
    at = ["run_id", "seq", "pid", "ts_us", "body", "shape"]
    s = rows.select("run_id", "seq", "pid", "ts_us", "body", shape.alias("shape"), F.regexp_extract("body", _DUR, 0).alias("_d"))
    s = s.select(*at, "_d", _without_tail(body, F.col("_d")).alias("_t"))
    s = s.select(*at, "_d", "_t", F.regexp_extract("_t", d.ret, 0).alias("_r"))
    s = s.select(*at, "_d", "_r", _without_tail(F.col("_t"), F.col("_r")).alias("_h"))
    s = s.select(*at, "_d", "_r", "_h", F.nullif(F.regexp_extract("_h", rf"(?s)^({d.name})\(.*\)\s*$", 1), F.lit("")).alias("_n"))
    is_call, sh = F.col("shape") == "call", F.col("shape")
    args = F.trim(F.regexp_replace("_h", rf"(?s)^{d.name}\(|\)\s*$", ""))
    if d.library:
        etype, bare = F.when(F.endswith("_n", F.lit("@SYS")), "syscall").otherwise("libcall"), F.regexp_replace("_n", "@SYS$", "")
    else:
        etype, bare = F.lit("syscall"), F.col("_n")
    found = F.col("_r") != ""
    empty = F.lit("")
    ret = F.when(found, F.regexp_extract("_r", d.ret, 1))
    err = F.when(found, F.nullif(F.regexp_extract("_r", d.ret, 2), empty))
    lat = F.when(F.col("_d") != "", _micros(F.regexp_extract("_d", _DUR, 1), F.regexp_extract("_d", _DUR, 2)))
    out = s.select("run_id", "seq", "ts_us", "pid", F.when(is_call, etype).otherwise(sh).alias("event_type"),
                   F.when(is_call, bare).when(sh == "exit", "exit").otherwise(F.regexp_extract("body", d.signal, 1)).alias("syscall"),
                   F.when(is_call, args).otherwise(body).alias("args"),
                   F.when(is_call, ret).when(sh == "exit", F.nullif(F.regexp_extract("body", d.exited, 1), empty)).alias("retval"),
                   F.when(is_call, err).when(sh == "exit", F.nullif(F.regexp_extract("body", d.exited, 2), empty)).alias("error"),
                   F.when(is_call, lat).alias("lat_us"))
    real = F.col("event_type") == "syscall"
    c = F.col
    return project_where(
        out, c("syscall").isNotNull(), c("run_id"), c("seq"), c("ts_us"), c("pid"), c("event_type"), F.lit(d.source).alias("source"),
        c("syscall"), c("args"), c("retval"), c("error"), c("lat_us"),
        F.when(real, call_fd(c("syscall"), c("args"), d.fd_calls)).alias("fd"),
        F.when(real, call_path(c("syscall"), c("args"), d.path_calls)).alias("path"))


# An output write, and one line of its hex dump (at most 16 bytes: 49 characters).
_WRITE = r"^\s*(\d+)\s+(\d+)\.(\d+)\s+write\((1|2),"
_DUMP = r"^\s*\|\s+[0-9a-fA-F]+ {2}(.{1,49})"


def program_output(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """(run_id, seq, ts_us, stream, text): what a run printed, rebuilt from the hex dumps after its writes."""
    line = F.col("line")
    is_write, is_dump = line.rlike(_WRITE), line.rlike(_DUMP)
    # Dump lines directly after a write belong to it; any other line ends the chunk, so every non-dump line opens one.
    cut = sections(lines, ~is_dump | is_write, block)
    hexes = F.array_join(F.regexp_extract_all(F.regexp_extract("line", _DUMP, 1), F.lit("([0-9a-fA-F]{2})"), 1), "")
    marked = cut.where(is_write | is_dump).select("run_id", "section", "seq", "line", is_write.alias("w"),
                                                 F.when(~is_write, hexes).alias("h"))
    w = F.col("w")
    chunk = marked.groupBy("run_id", "section").agg(
        F.min(F.when(w, F.col("seq"))).alias("seq"), F.max(F.when(w, F.col("line"))).alias("head"),
        F.array_join(in_order(F.coalesce("h", F.lit(""))), "").alias("hex"))
    text = F.make_valid_utf8(F.unhex("hex").cast("string"))
    return (chunk.where(F.col("head").isNotNull())
            .select("run_id", "seq", _micros(F.regexp_extract("head", _WRITE, 2),
                                             F.regexp_extract("head", _WRITE, 3)).alias("ts_us"),
                    F.when(F.regexp_extract("head", _WRITE, 4) == "1", "stdout").otherwise("stderr").alias("stream"),
                    text.alias("text"))
            .where(F.col("text") != ""))
