"""The archive: model tables as Parquet by run, JSON-lines interchange, summaries, compressed archives of other writers."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calls import run_totals, top_calls
from ..operators.series import peaks


def write_table(df: DataFrame, path: str, order: list[str], *, mode: str = "append", buckets: int = 1,
                spread: str | None = None) -> None:
    """Append a model table, one folder per run, rows in `order` inside each file so that range filters skip row groups.

    A run is written by `buckets` tasks, split by ranges of `spread` (its sequence or time), so one huge run is not one task.
    """
    by = ["run_id"] + ([spread] if spread else [])
    parts = df.repartitionByRange(buckets, *by) if buckets > 1 else df.repartitionByRange(*by)
    (parts.sortWithinPartitions("run_id", *order).write.mode(mode).partitionBy("run_id").parquet(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A filter on run_id prunes folders; the schema is given, never inferred."""
    return spark.read.schema(schema).parquet(path)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Plain or gzip JSON lines."""
    return spark.read.schema(schema).json(path)


# Field names of archived events and samples, as the collectors write them.
EVENT_RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("timestamp_ms", T.DoubleType()), ("pid", T.LongType()), ("event_type", T.StringType()), ("source", T.StringType()),
    ("syscall", T.StringType()), ("args", T.StringType()), ("retval", T.StringType()), ("error", T.StringType()),
    ("latency_ms", T.DoubleType()), ("fd", T.IntegerType()), ("path", T.StringType()))])
METRIC_RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("timestamp_ms", T.DoubleType()), ("cpu_pct", T.DoubleType()), ("rss_mb", T.DoubleType()), ("vms_mb", T.DoubleType()),
    ("open_fds", T.IntegerType()), ("threads", T.IntegerType()), ("syscall_rate", T.DoubleType()),
    ("io_read_bps", T.DoubleType()), ("io_write_bps", T.DoubleType()))])


_CHUNK = 1 << 20


def _decode(batches):
    """Compressed files to lines, a bounded number at a time; the codec's stream is read incrementally."""
    import zstandard
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True),
                                      encoding="utf-8", errors="replace")
            lines, first, size = [], 0, 0
            for n, line in enumerate(reader):
                lines.append(line.rstrip("\n"))
                size += len(line)
                if size >= _CHUNK:
                    yield pd.DataFrame({"path": path, "seq": range(first, n + 1), "line": lines})
                    lines, first, size = [], n + 1, 0
            if lines:
                yield pd.DataFrame({"path": path, "seq": range(first, first + len(lines)), "line": lines})


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, seq, line) from zstd-compressed line files, which the text source cannot read. One file is one task."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = raw.mapInPandas(_decode, "path string, seq long, line string")
    run = F.coalesce(F.nullif(F.regexp_extract("path", r"run_id=([^/]+)/", 1), F.lit("")),
                     F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return lines.select(run.alias("run_id"), "seq", "line")


def events_from_json(lines: DataFrame) -> DataFrame:
    """Archived event lines -> trace_events."""
    r = lines.select("run_id", "seq", F.from_json("line", EVENT_RECORD).alias("r")).where(F.col("r.event_type").isNotNull())
    return r.select("run_id", "seq", F.round(F.col("r.timestamp_ms") * 1000).cast("long").alias("ts_us"), "r.pid", "r.event_type",
                    "r.source", "r.syscall", "r.args", "r.retval", "r.error",
                    F.round(F.col("r.latency_ms") * 1000).cast("long").alias("lat_us"), "r.fd", "r.path")


def metrics_from_json(lines: DataFrame) -> DataFrame:
    r = lines.select("run_id", F.from_json("line", METRIC_RECORD).alias("r")).where(F.col("r.timestamp_ms").isNotNull())
    return r.select("run_id", F.round(F.col("r.timestamp_ms") * 1000).cast("long").alias("ts_us"),
                    *[f"r.{f.name}" for f in METRIC_RECORD if f.name != "timestamp_ms"])


def events_to_json(events: DataFrame) -> DataFrame:
    """trace_events -> (run_id, seq, value) in the archived form."""
    src = F.col("source") if "source" in events.columns else F.lit(None).cast("string").alias("source")
    rec = F.struct((F.col("ts_us") / 1000.0).alias("timestamp_ms"), "pid", "event_type", src, "syscall", "args", "retval", "error",
                   (F.col("lat_us") / 1000.0).alias("latency_ms"), "fd", "path")
    return events.select("run_id", "seq", F.to_json(rec, {"ignoreNullFields": "false"}).alias("value"))


def run_summaries(runs: DataFrame, events: DataFrame, metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """One summary document per run, ready for `write_json`."""
    top = top_calls(events).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "syscall", "count"))).alias("top_calls"))
    # One finding per rule and run.
    found = findings.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "severity", "title"))).alias("findings"))
    out = runs.join(run_totals(events), "run_id", "left").join(peaks(metrics), "run_id", "left")
    return out.join(top, "run_id", "left").join(found, "run_id", "left")

