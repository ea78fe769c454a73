"""The live jobs (T1-T9): sources with a watermark, stateful queries, and per-batch sinks that can be run again safely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import rules, series, spans
from ..operators.catalog import latest_samples
from ..operators.incidents import LiveLimits
from ..schemas import METRICS
from ..session import checkpoint_dir
from . import state

c = F.col

# How live scans look back.
SLIDING, MIN_POINTS, LEAK_EVERY = 360, 8, 4

def timed(rows: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Rows with `ts`, their event time, and a watermark: what comes later than `lateness` after the newest row is dropped."""
    return rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)


def metric_stream(spark: SparkSession, path: str, *, fmt: str = "parquet", lateness: str = "1 minute",
                  files_per_batch: int = 1000) -> DataFrame:
    """Samples as they arrive, as files, with event time and watermark."""
    raw = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
    return timed(raw, lateness)


def _stateful(rows: DataFrame, keys: list[str], cols: list[str], processor, out) -> DataFrame:
    """The processor over rows of `timed`; their state needs the RocksDB store that `session.DEFAULTS` names."""
    grouped = rows.select(*keys, "ts_us", *cols, "ts").groupBy(*keys)
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")


def alert_stream(metrics: DataFrame, limits: LiveLimits = LiveLimits(), keep_us: int = state.KEEP_US) -> DataFrame:
    """T3. An alert comes out once the watermark has passed its sample; a run silent for `keep_us` starts anew."""
    return _stateful(metrics, ["run_id"], ["cpu_pct", "rss_mb", "open_fds"], state.LiveAlerts(limits, keep_us), state.ALERT)


def incident_stream(alerts: DataFrame, limits: LiveLimits = LiveLimits(), keep_us: int = state.KEEP_US) -> DataFrame:
    """T4: incidents and their throttled updates, from an alert stream that was written as a table and read with `timed`."""
    return _stateful(alerts, ["run_id", "rule_id"], ["severity", "title"], state.IncidentCollapse(limits, keep_us), state.INCIDENT_UPDATE)


def hot_incident_stream(alerts: DataFrame, snapshots: DataFrame, limits: LiveLimits = LiveLimits(), keep_us: int = state.KEEP_US) -> DataFrame:
    """T4 with the "where": incident_stream's updates with functions, stack and samples of a profile snapshot, from alerts and from
    snapshots (run_id, ts_us, functions, stack, samples), both read with `timed`. The first row of an incident has the snapshot that
    stands by then; if there is none, the incident comes again with the next one. An incident keeps its snapshot; throttled updates say
    nothing of it (null)."""
    none = F.lit(None).cast("string")
    shots = snapshots.select("run_id", "ts_us", none.alias("rule_id"), none.alias("severity"), none.alias("title"),
                             F.to_json(F.struct("functions", "stack", "samples")).alias("hot"), "ts")
    both = alerts.select("run_id", "ts_us", "rule_id", "severity", "title", none.alias("hot"), "ts").unionByName(shots)
    told = _stateful(both, ["run_id"], ["rule_id", "severity", "title", "hot"], state.HotIncidents(limits, keep_us), state.HOT_UPDATE)
    hot = F.from_json("hot", "functions array<string>, stack array<string>, samples long")
    return told.withColumn("hot", hot).select(*[f.name for f in state.INCIDENT_UPDATE], "hot.functions", "hot.stack", "hot.samples")


def ring_stream(metrics: DataFrame, size: int = 2400, keep_us: int = state.KEEP_US) -> DataFrame:
    """T2."""
    return _stateful(metrics, ["run_id"], ["cpu_pct", "rss_mb", "open_fds"], state.Ring(size, keep_us), state.RING_ROW)


def ended_runs(ticks: DataFrame, empties: int = 12, keep_us: int = state.KEEP_US) -> DataFrame:
    """T8, from ticks read with `timed`."""
    return _stateful(ticks, ["run_id"], ["rss_mb"], state.Liveness(empties, keep_us), state.ENDED)


def sliding_load(metrics: DataFrame, size: str = "90 seconds", step: str = "20 seconds",
                 t: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """T5 as a windowed aggregation: per run and 90-second window the counts the load rules judge."""
    cpu = c("cpu_pct")
    rd, wr = F.coalesce("io_read_bps", F.lit(0.0)), F.coalesce("io_write_bps", F.lit(0.0))
    return metrics.groupBy("run_id", F.window("ts", size, step).alias("w")).agg(
        F.count("cpu_pct").alias("points"), F.max("rss_mb").alias("peak_rss_mb"), F.max("cpu_pct").alias("peak_cpu_pct"),
        F.count_if((cpu > t.cpu_bound_pct) & (rd < t.io_idle_bps) & (wr < t.io_idle_bps)).alias("cpu_bound"),
        F.count_if((cpu < t.io_wait_cpu_pct) & ((rd > t.io_active_bps) | (wr > t.io_active_bps))).alias("io_wait")).select(
        "run_id", F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("until_us"), "points", "peak_rss_mb",
        "peak_cpu_pct", "cpu_bound", "io_wait")


# --- per-batch sinks -------------------------------------------------------------------------------------------------

def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch goes to a folder of its own that a retry overwrites, so nothing is written twice."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return sink


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The samples written so far, the newest batch winning for a time written twice."""
    raw = spark.read.option("basePath", path).parquet(path)
    cols = [n for n in METRICS.names if n in raw.columns]
    return latest_samples(raw.select(*cols, c("batch_id").alias("ingest_seq")))


def sliding_findings(metrics: DataFrame, limits: DataFrame | None = None, t: rules.Thresholds = rules.Thresholds(),
                     n: int = SLIDING, least: int = MIN_POINTS) -> DataFrame:
    """T5, exact: the metric rules over each run's newest `n` samples, for runs with at least `least`."""
    window = series.ring(metrics, n)
    span = window.groupBy("run_id").agg(F.count("*").alias("points"), F.floor((F.max("ts_us") - F.min("ts_us")) / 1000).alias("duration_ms"))
    span = span.where(c("points") >= least)
    if limits is not None:
        span = span.join(limits.select("run_id", "cgroup_cpu_quota_cores", "cgroup_mem_limit_bytes"), "run_id", "left")
    else:
        span = span.withColumns({"cgroup_cpu_quota_cores": F.lit(None).cast("double"), "cgroup_mem_limit_bytes": F.lit(None).cast("long")})
    return rules.metric_findings(window.join(span.select("run_id"), "run_id", "left_semi"), span, t)


def scan_batch(metric_path: str, finding_path: str, t: rules.Thresholds = rules.Thresholds(),
               leak_every: int = LEAK_EVERY) -> Callable[[DataFrame, int], None]:
    """T1 + T5 + T6: store the samples, judge the trailing window of the runs that got some, and on every fourth batch look
    for slow leaks in their whole history."""
    store = write_batch(metric_path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store(batch.select(*METRICS.names), batch_id)
        live = spark.read.parquet(f"{metric_path}/batch_id={batch_id}").select("run_id").distinct()
        history = stored_metrics(spark, metric_path).join(live, "run_id", "left_semi")
        found = sliding_findings(history, t=t).select("run_id", "rule_id", "severity", "severity_score", "title", "last_seen_us")
        if (batch_id + 1) % leak_every == 0:
            found = found.unionByName(rules.slow_leak_findings(history))
        found.write.mode("overwrite").parquet(f"{finding_path}/batch_id={batch_id}")
    return sink


def rollup_batch(path: str, db_key: list[str]) -> Callable[[DataFrame, int], None]:
    """The endpoint table of a run's latest snapshot replaces that run's before; runs that the batch has no requests of
    keep theirs. A batch holds `record` http and db rows, and all of a snapshot."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        http, db = kept.where("record = 'http'"), kept.where("record = 'db'")
        owned = spans.own_queries(http, db, db_key)
        table = spans.endpoints(spans.with_db_time(http, owned))
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        kept.unpersist()
    return sink


def start(writer: DataStreamWriter, name: str, spark: SparkSession, *, once: bool = True, every: str = "2 seconds"):
    """Start a query with its checkpoint in the cluster's shared folder; `once` works off what is there and stops."""
    w = writer.queryName(name).option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
