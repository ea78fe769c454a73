"""The stateful streams give what their batch twins give, also when the input comes unsorted and in many small batches."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from runlens.adapters import view
from runlens.operators import incidents, rules, series
from runlens.schemas import METRICS
from runlens.streaming import live

SF = "/root/testdata/sf0.001"
LIVE = incidents.LiveLimits(fds=100, rss_step_mb=0.9, cpu_pct=40.0, cpu_streak=3, rearm=8, publish_every_us=3_600_000_000)
DAY = 86_400_000_000
FOREVER = 10_000 * DAY


def as_samples(df):
    for name in METRICS.names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in METRICS])


def clock_row(spark, ts_us):
    """A sample of a run of its own: by its time the watermark passes the rows before it."""
    return as_samples(spark.createDataFrame([("~clock", ts_us)], "run_id string, ts_us long"))


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("metrics") / "in")
    m = as_samples(view(spark, SF, "metrics"))
    # Five files in time order: the file source reads them oldest first.
    lo, hi = m.agg(F.min("ts_us"), F.max("ts_us")).first()
    for i in range(5):
        a, z = lo + (hi - lo + 1) * i // 5, lo + (hi - lo + 1) * (i + 1) // 5
        m.where((F.col("ts_us") >= a) & (F.col("ts_us") < z)).coalesce(1).write.mode("append").parquet(path)
    return path, m


@pytest.fixture(scope="module")
def clocked(spark, samples, tmp_path_factory):
    """The same files, and one more that closes the stream."""
    _, m = samples
    path = str(tmp_path_factory.mktemp("clocked") / "in")
    lo, hi = m.agg(F.min("ts_us"), F.max("ts_us")).first()
    for i in range(5):
        a, z = lo + (hi - lo + 1) * i // 5, lo + (hi - lo + 1) * (i + 1) // 5
        m.where((F.col("ts_us") >= a) & (F.col("ts_us") < z)).coalesce(1).write.mode("append").parquet(path)
    clock_row(spark, hi + DAY).coalesce(1).write.mode("append").parquet(path)
    return path, m


def run_stream(spark, writer, name):
    name = f"{name}-{uuid.uuid4().hex[:8]}"
    q = live.start(writer.queryName(name), name, spark)
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_alerts_and_incidents(spark, clocked, tmp_path):
    path, m = clocked
    out = str(tmp_path / "alerts")
    stream = live.alert_stream(live.metric_stream(spark, path, files_per_batch=1), LIVE, keep_us=FOREVER)
    run_stream(spark, stream.writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "alerts")
    cols = ["run_id", "ts_us", "rule_id", "severity"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    want = sorted(map(tuple, incidents.alerts(m, LIVE).select(*cols).collect()))
    assert got == want and len(got) > 10

    feed, source = str(tmp_path / "incidents"), str(tmp_path / "feed")
    written = spark.read.parquet(out).drop("batch_id")
    written.write.parquet(source)
    last = written.agg(F.max("ts_us")).first()[0]
    spark.createDataFrame([("~clock", last + DAY, "tick", "low", "")], written.schema).coalesce(1).write.mode("append").parquet(source)
    alerts = live.timed(spark.readStream.schema(written.schema).parquet(source))
    run_stream(spark, live.incident_stream(alerts, LIVE, keep_us=FOREVER).writeStream.outputMode("update").foreachBatch(live.write_batch(feed)), "incidents")
    new = spark.read.parquet(feed).where("is_new")
    assert {r.incident_id for r in new.collect()} == {r.incident_id for r in incidents.collapse(incidents.alerts(m, LIVE)).collect()}
    # Updates of one incident are at least an hour apart here.
    by = {}
    for r in spark.read.parquet(feed).orderBy("incident_id", "last_us").collect():
        by.setdefault(r.incident_id, []).append((r.last_us, r["count"]))
    for rows in by.values():
        assert all(b[0] - a[0] >= 3_600_000_000 and b[1] > a[1] for a, b in zip(rows, rows[1:]))


def test_hot_context_is_filled_in(spark, tmp_path):
    """Shuffled alerts and snapshots of 40 runs: every incident gets the snapshot that the batch form gives it."""
    sec = 1_000_000
    i = F.col("id")
    run = F.concat(F.lit("r"), F.pmod(F.xxhash64(i), F.lit(40)))
    alerts = spark.range(2000).select(run.alias("run_id"), ((F.pmod(F.xxhash64(i, F.lit(1)), F.lit(3000)) + 1) * sec).alias("ts_us"),
                                      F.concat(F.lit("rule"), F.pmod(F.xxhash64(i, F.lit(2)), F.lit(5))).alias("rule_id"), F.lit("high").alias("severity"), F.lit("t").alias("title"))
    alerts = alerts.dropDuplicates(["run_id", "rule_id", "ts_us"])
    shots = spark.range(160).select(run.alias("run_id"), ((F.pmod(F.xxhash64(i, F.lit(3)), F.lit(900)) + 1) * sec).alias("ts_us"), F.array(F.concat(F.lit("f"), i)).alias("functions"),
                                    F.array(F.lit("main"), F.concat(F.lit("f"), i)).alias("stack"), i.alias("samples")).dropDuplicates(["run_id", "ts_us"]).where("run_id <> 'r7'")
    sources = {}
    for name, rows in (("alerts", alerts), ("shots", shots)):
        sources[name] = str(tmp_path / name)
        clock = spark.createDataFrame([("~clock", DAY)], "run_id string, ts_us long").select(
            *[F.col(n) if n in ("run_id", "ts_us") else F.lit(None).cast(t).alias(n) for n, t in rows.dtypes])
        for part in (0, 1):
            rows.where(F.pmod(F.xxhash64("ts_us"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(sources[name])
        clock.coalesce(1).write.mode("append").parquet(sources[name])
    limits = incidents.LiveLimits(publish_every_us=600 * sec)
    read = {n: live.timed(spark.readStream.option("maxFilesPerTrigger", 1).schema(spark.read.parquet(p).schema).parquet(p), "2 hours") for n, p in sources.items()}
    out = str(tmp_path / "out")
    run_stream(spark, live.hot_incident_stream(read["alerts"], read["shots"], limits, keep_us=FOREVER).writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "hot")
    told = spark.read.parquet(out).where("run_id <> '~clock'")
    got = {r.incident_id: r for r in told.groupBy("incident_id").agg(F.min("first_us").alias("first"), F.count_if("is_new").alias("new"),
                                                                     F.collect_set(F.array_join("functions", ",")).alias("hot"), F.count_if(F.col("functions").isNull() & F.col("is_new")).alias("bare")).collect()}
    first = alerts.groupBy("run_id", "rule_id").agg(F.min("ts_us").alias("first_us")).withColumn("incident_id", F.concat_ws(":", "run_id", "rule_id"))
    want = {r.incident_id: r for r in incidents.with_hot(first, shots).collect()}
    assert got.keys() == want.keys() and all(g.new == 1 and g.first == want[k].first_us for k, g in got.items())
    assert {k: list(g.hot) for k, g in got.items()} == {k: [",".join(w.hot_functions)] if w.hot_functions else [] for k, w in want.items()}
    filled = [k for k, g in got.items() if g.bare and want[k].hot_functions]
    assert len(filled) > 20 and all(want[k].hot_us > want[k].first_us for k in filled)
    assert all(not g.hot for k, g in got.items() if k.startswith("r7:"))


def test_unsorted_samples_late_rows_and_ended_runs(spark, tmp_path):
    """30,000 shuffled samples of one run in two files: the alerts of the batch; a late row is dropped; no state stays."""
    n, step = 30_000, 250_000
    i = F.col("id")
    spiky = spark.range(n).select(
        F.lit("r").alias("run_id"), ((i + 1) * step).alias("ts_us"), (F.pmod(F.xxhash64(i), F.lit(100)) + F.pmod(i, F.lit(30))).cast("double").alias("cpu_pct"),
        F.pmod(F.xxhash64(i + 1), F.lit(200)).cast("double").alias("rss_mb"), F.pmod(F.floor(i / 40), F.lit(3)).cast("int").alias("open_fds"))
    m = as_samples(spiky)
    limits = incidents.LiveLimits(fds=1, rss_step_mb=150.0, cpu_pct=60.0, cpu_streak=4, rearm=8)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    shuffled = m.withColumn("__r", F.xxhash64("ts_us", F.lit(5)))
    for half in (0, 1):
        shuffled.where(F.pmod("__r", F.lit(2)) == half).coalesce(1).sortWithinPartitions("__r").drop("__r").write.mode("append").parquet(path)
    end = (n + 1) * step
    for day in (1, 2):
        clock_row(spark, end + day * DAY).coalesce(1).write.mode("append").parquet(path)
    late = spark.createDataFrame([("r", end - 1, 1.0, 10_000.0, 9)], "run_id string, ts_us long, cpu_pct double, rss_mb double, open_fds int")
    as_samples(late).unionByName(clock_row(spark, end + 9 * DAY)).coalesce(1).write.mode("append").parquet(path)
    clock_row(spark, end + 10 * DAY).coalesce(1).write.mode("append").parquet(path)
    stream = live.alert_stream(live.metric_stream(spark, path, files_per_batch=1, lateness="3 hours"), limits)
    q = run_stream(spark, stream.writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "unsorted")
    cols = ["run_id", "ts_us", "rule_id", "severity"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    assert got == sorted(map(tuple, incidents.alerts(m, limits).select(*cols).collect())) and len(got) > 300
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"]) == 1
    folder = f"{live.checkpoint_dir(spark)}/{q.name}"
    left = spark.read.format("statestore").option("path", folder).option("stateVarName", "state").load()
    assert "r" not in {r.key.run_id for r in left.collect()}


def test_ring(spark, samples, tmp_path):
    path, m = samples
    out = str(tmp_path / "ring")
    stream = live.ring_stream(live.metric_stream(spark, path, files_per_batch=1, lateness="40 days"), 50)
    run_stream(spark, stream.writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "ring")
    rows = spark.read.parquet(out)
    last = rows.join(rows.groupBy("run_id").agg(F.max("batch_id").alias("batch_id")), ["run_id", "batch_id"])
    got = sorted(map(tuple, last.select("run_id", "ts_us", "cpu_pct").collect()))
    assert got == sorted(map(tuple, series.ring(m, 50).select("run_id", "ts_us", "cpu_pct").collect()))


def test_liveness(spark, tmp_path):
    rows = [("a", t, None if 5 <= t < 17 or t == 3 else 1.0) for t in range(20)] + [("b", t, None) for t in range(20)] + \
           [("c", t, None if t % 12 else 1.0) for t in range(20)]
    ticks = spark.createDataFrame(rows, "run_id string, ts_us long, rss_mb double")
    src, out = str(tmp_path / "ticks"), str(tmp_path / "ended")
    ticks.where("ts_us < 9").coalesce(1).write.mode("append").parquet(src)
    ticks.where("ts_us >= 9").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("~clock", DAY, None)], ticks.schema).coalesce(1).write.mode("append").parquet(src)
    stream = live.timed(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src))
    run_stream(spark, live.ended_runs(stream).writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "ended")
    assert [tuple(r) for r in spark.read.parquet(out).select("run_id", "ended_us").collect()] == [("a", 16)]
    assert [tuple(r) for r in series.exhausted_runs(ticks).collect()] == [("a", 16)]


def test_scan_and_store(spark, samples, tmp_path):
    path, m = samples
    table, found = str(tmp_path / "m"), str(tmp_path / "f")
    t = rules.Thresholds.with_overrides({"mem_growth_ratio": 1.01, "mem_growth_min_mb": 1, "memory_spike_mb": 0.9, "cpu_bound_pct": 40})
    stream = live.metric_stream(spark, path, files_per_batch=1, lateness="40 days")
    run_stream(spark, stream.writeStream.foreachBatch(live.scan_batch(table, found, t, leak_every=5)), "scan")
    assert live.stored_metrics(spark, table).count() == m.count()
    last = {(r.run_id, r.rule_id) for r in spark.read.parquet(found).where("batch_id = 4").collect()}
    want = {(r.run_id, r.rule_id) for r in live.sliding_findings(m, t=t).collect()}
    assert want <= last and {rule for _, rule in want} >= {"monotonic_memory_growth", "cpu_bound_metric"}


def test_sliding_windows(spark, samples, tmp_path):
    path, m = samples
    out = str(tmp_path / "load")
    stream = live.sliding_load(live.metric_stream(spark, path, lateness="1 minute"), "90 minutes", "30 minutes")
    run_stream(spark, stream.writeStream.outputMode("update").foreachBatch(live.write_batch(out)), "load")
    got = spark.read.parquet(out)
    twin = live.sliding_load(m.withColumn("ts", F.timestamp_micros("ts_us")), "90 minutes", "30 minutes")
    key = ["run_id", "from_us", "points", "peak_rss_mb"]
    newest = got.join(got.groupBy("run_id", "from_us").agg(F.max("batch_id").alias("batch_id")), ["run_id", "from_us", "batch_id"])
    assert sorted(map(tuple, newest.select(*key).collect())) == sorted(map(tuple, twin.select(*key).collect()))


def test_rollup_replaces_the_one_before(spark, tmp_path):
    path, ms = str(tmp_path / "rollup"), 1_000_000
    cols = "record string, run_id string, span_id long, db_id long, tid long, start_ns long, dur_ns long, method string, route string, status int"
    first = spark.createDataFrame([("http", "r", 1, None, 1, 0, 300 * ms, "GET", "/users/7", 200), ("db", "r", None, 1, 1, 10 * ms, 150 * ms, None, None, None)], cols)
    second = first.where("record = 'http'").withColumn("route", F.lit("/other"))
    for batch_id, batch in enumerate((first, second)):
        live.rollup_batch(path, ["db_id"])(batch, batch_id)
        got = [(r.route, r["count"], r.db_ms_share) for r in spark.read.parquet(path).collect()]
        assert got == [[("/users/{id}", 1, 0.5)], [("/other", 1, 0.0)]][batch_id]
    # A snapshot of another run leaves this one's table as it is.
    live.rollup_batch(path, ["db_id"])(second.withColumn("run_id", F.lit("s")), 2)
    assert sorted((r.run_id, r.route) for r in spark.read.parquet(path).collect()) == [("r", "/other"), ("s", "/other")]
