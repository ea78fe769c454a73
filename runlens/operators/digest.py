"""A run as a few dozen lines of text, section by section, out of the other operators' tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bytes_text
from ..plans.topk import top_k

c = F.col

# The sections in order and how many rows of each are shown.
SECTIONS = ["totals", "peaks", "calls", "trajectory", "timeline", "files", "connections", "allocations", "library", "hotspots",
            "findings"]
FILES, CONNECTIONS, LIBRARY, HOTSPOTS = 6, 6, 5, 8


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("none")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _lines(df: DataFrame, section: str, text: Column, line: Column | None = None) -> DataFrame:
    return df.select("run_id", F.lit(section).alias("section"), (line if line is not None else F.lit(1)).cast("int").alias("line"),
                     text.alias("text"))


def digest_lines(*, totals: DataFrame, peaks: DataFrame, top: DataFrame, trajectory: DataFrame, timeline: DataFrame, io: DataFrame,
                 conns: DataFrame, findings: DataFrame, ledger: DataFrame | None = None, library: DataFrame | None = None,
                 hotspots: DataFrame | None = None) -> DataFrame:
    """(run_id, section, line, text); every input is already one row or a short top-k per run, or is cut to one here."""
    def whole(col: str) -> Column:
        return F.format_string("%.0f", c(col))

    parts = [
        _lines(totals, "totals", _text("calls ", c("syscall_events"), ", errors ", c("errors"), ", signals ", c("signals"))),
        _lines(peaks, "peaks", _text("peak CPU ", c("peak_cpu_pct"), "%, memory ", c("peak_rss_mb"), " MB, descriptors ",
                                     c("peak_open_fds"), ", threads ", c("peak_threads"), ", samples ", c("samples"))),
        _lines(top, "calls", _text(c("syscall"), " x", c("count")), c("rank")),
        _lines(trajectory.where("rss_last IS NOT NULL"), "trajectory", _text(
            "memory ", whole("rss_first"), " to ", whole("rss_last"), " MB, peak ", whole("rss_peak"), " MB (", c("rss_trend"), ")")),
        _lines(trajectory.where("cpu_peak IS NOT NULL"), "trajectory", _text("CPU mean ", whole("cpu_avg"), "%, peak ",
                                                                             whole("cpu_peak"), "%"), F.lit(2)),
        _lines(trajectory.where("fds_peak > fds_low"), "trajectory", _text(
            "descriptors ", c("fds_first"), " to ", c("fds_last"), ", peak ", c("fds_peak")), F.lit(3)),
        _lines(timeline, "timeline", c("text"), c("line")),
    ]
    files = top_k(io, ["run_id"], [F.desc(c("read_bytes") + c("write_bytes")), F.asc("path")], FILES, rank="rank")
    parts.append(_lines(files, "files", F.concat(_text(
        c("path"), ": ", c("reads"), "r/", c("writes"), "w, ", bytes_text(c("read_bytes")), " read, ",
        bytes_text(c("write_bytes")), " written"), F.when(c("leaked") > 0, ", not closed").otherwise("")), c("rank")))
    net = top_k(conns, ["run_id"], [F.asc("seq")], CONNECTIONS, rank="rank")
    parts.append(_lines(net, "connections", F.concat(_text(c("address"), ":", c("port"), " (", c("family"), ") ", c("result")),
                                                     F.when(c("latency_ms") > 0, F.concat(F.lit(" "), whole("latency_ms"), F.lit(" ms")))
                                                     .otherwise("")), c("rank")))
    if ledger is not None:
        parts.append(_lines(ledger, "allocations", F.concat(_text(
            c("n_alloc"), " allocations, ", c("n_free"), " frees, ", bytes_text(c("bytes_allocated")), " allocated, peak ",
            bytes_text(c("peak_live_bytes"))), F.when(c("outstanding_bytes") > 0, _text(
                "; not freed: ", bytes_text(c("outstanding_bytes")), " in ", c("outstanding_blocks"), " blocks")).otherwise(""))))
    if library is not None:
        lib = top_k(library, ["run_id"], [F.desc("total_ms"), F.desc("calls"), F.asc("function")], LIBRARY, rank="rank")
        parts.append(_lines(lib, "library", _text(c("function"), " x", c("calls"), " (", whole("total_ms"), " ms)"), c("rank")))
    if hotspots is not None:
        parts.append(_lines(hotspots.where(c("rank") <= HOTSPOTS), "hotspots", _text(c("function"), " ", whole("self_pct"), "%"),
                            c("rank")))
    # All findings: at most one per rule and run, plus the user's own rules.
    ranked = findings.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("severity_score"), F.asc("rule_id"))))
    parts.append(_lines(ranked, "findings", _text("[", F.upper("severity"), "] ", c("title"), " (x", c("occurrence_count"), ")"),
                        c("rank")))
    return reduce(DataFrame.unionByName, parts)


def run_digest(lines: DataFrame) -> DataFrame:
    """One text per run: sections in order, their lines in order. A run has at most a few dozen lines."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), c("section"))
    return lines.groupBy("run_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(pos.alias("p"), "line", F.concat(c("section"), F.lit(": "), c("text")).alias("t")))),
        lambda s: s["t"]), "\n").alias("digest"))
