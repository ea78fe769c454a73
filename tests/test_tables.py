"""Ledger, profiles, series, comparison, catalog, incidents: hand-made values, and random input against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.adapters import view
from runlens.operators import catalog, compare, digest, incidents, ledger, profiles, series, timeline
from runlens.queries import ingest

from .helpers import block, by, events, metric, metrics, one, ran, rows


def lib(fn, args, ret=None):
    return dict(event_type="libcall", syscall=fn, args=args, retval=ret)


@pytest.mark.parametrize("width", [1, 100])
def test_ledger_values(spark, width):
    ev = events(spark, [lib("malloc", "1024", "0x10"), lib("malloc", "2048", "0x20"), lib("free", "0x10"), lib("malloc", "4096", "0x30"),
                        lib("free", "(nil)"), lib("free", "0x99"), dict(syscall="brk")])
    r = one(ledger.ledger(ledger.allocator_calls(ev), block=block(width)))
    assert (r.n_alloc, r.n_free, r.bytes_allocated, r.bytes_freed, r.peak_live_bytes, r.outstanding_bytes, r.outstanding_blocks, r.free_unmatched) == (
        3, 2, 7168, 1024, 6144, 6144, 2, 1)
    ev = events(spark, [lib("calloc", "10, 128", "0x10"), lib("realloc", "0x10, 4096", "0x20"), lib("free", "0x20")])
    r = one(ledger.ledger(ledger.allocator_calls(ev), block=block(width)))
    assert (r.bytes_allocated, r.bytes_freed, r.outstanding_blocks, r.free_unmatched) == (5376, 5376, 0, 0)


def _brute_ledger(calls):
    live, total, peak, alloc, freed, bad = {}, 0, 0, 0, 0, 0
    for fn, old, new, size in calls:
        if fn != "malloc":
            got = live.pop(old, None)
            if got is not None:
                freed, total = freed + got, total - got
            elif fn == "free":
                bad += 1
        if fn != "free" and new:
            live[new] = size
            total, alloc = total + size, alloc + size
            peak = max(peak, total)
    return alloc, freed, peak, sum(live.values()), len(live), bad


@pytest.mark.parametrize("width", [3, 50])
def test_ledger_random(spark, width):
    rng = random.Random(7)
    calls = [(rng.choice(["malloc", "free", "realloc"]), rng.randrange(1, 12), rng.choice([0, *range(1, 12)]), rng.randrange(1, 500)) for _ in range(400)]
    ev = events(spark, [lib("malloc", str(s), hex(n)) if f == "malloc" else lib("free", hex(o)) if f == "free" else lib("realloc", f"{hex(o)}, {s}", hex(n))
                        for f, o, n, s in calls])
    r = one(ledger.ledger(ledger.allocator_calls(ev), block=block(width)))
    assert (r.bytes_allocated, r.bytes_freed, r.peak_live_bytes, r.outstanding_bytes, r.outstanding_blocks, r.free_unmatched) == _brute_ledger(calls)


def test_ledger_findings(spark):
    t = spark.createDataFrame([("leak", 10, 10, 262_144, 1, 0, 1), ("blocks", 10, 10, 1, 64, 0, 1), ("storm", 15_000, 5_000, 0, 0, 0, None), ("rate", 2001, 0, 0, 0, 0, 100),
                               ("uneven", 200, 50, 0, 0, 0, None), ("bad", 1, 1, 0, 0, 16, None), ("fine", 199, 1, 262_143, 63, 15, None)],
                              "run_id string, n_alloc long, n_free long, outstanding_bytes long, outstanding_blocks long, free_unmatched long, duration_ms long")
    got = sorted(rows(ledger.ledger_findings(t.drop("duration_ms"), t), "run_id", "rule_id"))
    assert got == [("bad", "free_unmatched"), ("blocks", "heap_leak"), ("leak", "heap_leak"), ("rate", "allocation_storm"), ("storm", "allocation_storm"),
                   ("uneven", "alloc_free_imbalance")]


def test_profiles(spark):
    s = spark.createDataFrame([("r", ["main", "a", "b"], 6), ("r", ["main", "a"], 3), ("r", ["main", "c", "main"], 1), ("r", [], 5), ("r", ["x"], 0), ("e", [], 1),
                               ("u", ["[unknown]"], 6), ("u", ["f"], 4)], "run_id string, frames array<string>, weight long")
    r = s.where("run_id = 'r'")
    nodes = {tuple(x.path): x.value for x in profiles.flame_paths(r).collect()}
    assert nodes == {("main",): 10, ("main", "a"): 9, ("main", "a", "b"): 6, ("main", "c"): 1, ("main", "c", "main"): 1}
    hot = {x.function: (x["self"], x.total) for x in profiles.hotspots(r).collect()}
    assert hot == {"main": (1, 10), "a": (3, 9), "b": (6, 6), "c": (0, 1)}
    ctx = by(profiles.hot_context(s), "run_id")
    assert ctx["r"].stack == ["main", "a", "b"] and ctx["r"].functions[0] == "b" and ctx["r"].samples == 10 and ctx["e"].samples == 0
    f = by(profiles.hot_function_findings(s), "run_id")
    assert f["r"].severity == "high" and f["u"].title.startswith("Hot function: f") and "e" not in f
    deep = spark.createDataFrame([("d", [str(i) for i in range(70)], 1000), ("d", ["rare"], 1)], "run_id string, frames array<string>, weight long")
    got = profiles.flame_paths(deep)
    assert got.count() == 64 and profiles.dominant_path(deep).first().stack == [str(i) for i in range(12)]
    own = spark.createDataFrame([("r", 1, ["k"], 5)], "run_id string, tid long, frames array<string>, weight long")
    spans = spark.createDataFrame([("r", 1, 1), ("r", 2, 9)], "run_id string, span_id long, tid long")
    assert {x.span_id: x.tid_unavailable for x in profiles.thread_flame(spans, own).collect()} == {1: False, 2: True}


def test_thread_drill_meets_a_flame_once(spark, tmp_path):
    """The nodes of a flame are summed up before requests meet them: no join gives a row for each request and node."""
    n = 2000
    spark.range(n).selectExpr("id % 1990 AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1000.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "concat('b', id % 5) AS p_brand", "concat('t', id % 7) AS p_type", "CAST(1 + id % 11 AS INT) AS p_size").write.parquet(
        f"{tmp_path}/part.parquet")
    out = ingest.thread_drill(spark, str(tmp_path))
    joined = metric(ran(out), "Join", "numOutputRows")
    assert joined and max(joined) <= n
    stacks = view(spark, str(tmp_path), "stacks").selectExpr("run_id", "weight % 3 AS tid", "split(folded, ';') AS frames", "weight")
    pairs = profiles.thread_flame(view(spark, str(tmp_path), "http_spans"), stacks)
    want = pairs.groupBy("span_id", "run_id", "tid_unavailable").agg(F.count("*").alias("nodes"), F.sum("value").alias("value"),
                                                                     F.min(F.array_join("path", ";")).alias("first_path"))
    assert sorted(rows(out, *want.columns)) == sorted(rows(want)) and out.count() == 1990


@pytest.mark.parametrize("need,width", [(1, 5), (3, 5), (3, 500)])
def test_rearming_alerts(spark, need, width):
    rng = random.Random(need)
    values = [rng.random() < (0.6 if (i // 25) % 2 else 0.08) for i in range(400)]
    want, fired, quiet, streak = [], False, 0, 0
    for i, on in enumerate(values):
        streak = streak + 1 if on else 0
        if on:
            if (streak == need if need > 1 else True) and not fired:
                fired = True
                want.append(i)
            quiet = 0
        else:
            quiet += 1
            if quiet >= 8:
                fired, quiet = False, 0
    m = metrics(spark, [dict(open_fds=int(v)) for v in values], step_us=1)
    got = sorted(r.ts_us for r in series.alerts_with_rearm(m, F.col("open_fds") == 1, 8, block(width, "ts_us"), need=need).collect())
    assert got == want and len(want) > 2


def _decimate(points, budget):
    if len(points) <= budget:
        return set(points)
    n, out = max(1, budget // 2), set()
    step = len(points) / n
    for b in range(n):
        part = points[int(b * step):len(points) if b == n - 1 else int((b + 1) * step)]
        out |= {min(part, key=lambda p: p[1]), max(part, key=lambda p: p[1])}
    return out


def test_thinning(spark):
    rng = random.Random(1)
    m = metrics(spark, [dict(cpu_pct=float(rng.randrange(40)), rss_mb=1.0 * (i % 9), open_fds=i % 5) for i in range(503)], step_us=1)
    s = series.series(m, "cpu_pct")
    pts = sorted(rows(s, "ts_us", "v"))
    assert set(rows(series.decimate(s, 100, block(50, "ts_us")), "ts_us", "v")) == _decimate(pts, 100)
    assert series.decimate(s, 503).count() == 503
    kept = sorted(r.ts_us for r in series.stride(m, 100, block(50, "ts_us")).collect())
    assert kept == list(range(0, 503, 6))
    w = m.withColumn("id", F.lit(1))
    thin = sorted(r.ts_us for r in series.keep_peaks(w, ["run_id", "id"], 30).collect())
    top = max(i for i, (_, v) in enumerate(pts) if v == max(v for _, v in pts))
    assert set(thin) == set(range(0, 503, 16)) | {502, top, max(i for i in range(503) if i % 9 == 8), max(i for i in range(503) if i % 5 == 4)}


def test_tree_io(spark):
    p = [("r", 0, 1, 100, 10), ("r", 0, 2, 50, 0), ("r", 1_000_000, 1, 300, 10), ("r", 2_000_000, 1, 400, 30), ("r", 2_000_000, 3, 7, 0)]
    df = spark.createDataFrame([(r, t, pid, 1.0, 1048576, 2097152, 2, 3, a, b) for r, t, pid, a, b in p], "run_id string, ts_us long, pid long, cpu_pct double, "
                               "rss_bytes long, vms_bytes long, threads int, fds int, read_bytes long, write_bytes long")
    got = sorted(rows(series.io_rate(df, block(1, "ts_us")), "ts_us", "io_read_bps", "io_write_bps"))
    assert got == [(0, None, None), (1_000_000, 200.0, 0.0), (2_000_000, 107.0, 20.0)]
    assert sorted(rows(series.tree_samples(df), "ts_us", "rss_mb", "open_fds")) == [(0, 2.0, 6), (1_000_000, 1.0, 3), (2_000_000, 2.0, 6)]


@pytest.mark.parametrize("width", [1, 2_500_000])
def test_tree_io_of_a_falling_counter(spark, width):
    p = [("r", 0, 1, 900, 0), ("r", 0, 2, 100, 0), ("r", 1_000_000, 1, 400, 0), ("r", 1_000_000, 2, 700, 5),
         ("r", 2_000_000, 1, 100, 0), ("r", 3_000_000, 1, 250, 0)]
    df = spark.createDataFrame(p, "run_id string, ts_us long, pid long, read_bytes long, write_bytes long")
    got = sorted(rows(series.io_rate(df, block(width, "ts_us")), "ts_us", "io_read_bps", "io_write_bps"))
    assert got == [(0, None, None), (1_000_000, 100.0, 5.0), (2_000_000, 0.0, 0.0), (3_000_000, 150.0, 0.0)]


def test_comparison(spark):
    pairs = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    stats = spark.createDataFrame([("a", "read", 5, 1.0), ("b", "read", 9, 2.0), ("b", "poll", 1, 3.0)], "run_id string, syscall string, count long, avg_ms double")
    got = rows(compare.by_change(compare.call_delta(stats, pairs)), "syscall", "count_a", "count_b", "delta", "avg_a", "avg_b")
    assert got == [("read", 5, 9, 4, 1.0, 2.0), ("poll", 0, 1, 1, None, 3.0)]
    f = spark.createDataFrame([("a", "x", "high", "X"), ("a", "y", "low", "Y"), ("b", "y", "low", "Y2"), ("b", "z", "low", "Z")], "run_id string, rule_id string, severity string, title string")
    delta = compare.finding_delta(f, pairs)
    assert sorted(rows(delta, "where", "title")) == [("both", "Y"), ("only_a", "X"), ("only_b", "Z")]
    s = spark.createDataFrame([("a", 100, 0.0, 5.0, 1, 1, 10, 0, 2), ("b", 90, 1.0, None, 1, 2, 20, 0, 1)],
                              "run_id string, " + ", ".join(f"{m} {'double' if 'cpu' in m or 'rss' in m else 'long'}" for m in compare.MEASURES))
    o = by(compare.overview_delta(s, pairs), "measure")
    assert (o["duration_ms"].delta, o["duration_ms"].pct, o["duration_ms"].improved) == (-10.0, -10.0, True)
    assert o["peak_cpu_pct"].pct is None and o["peak_cpu_pct"].improved is False and o["peak_rss_mb"].delta is None and o["errors"].improved is None
    text = one(compare.diff_digest(compare.overview_delta(s, pairs), delta)).digest
    assert "findings gained in B: Z" in text and "findings gone in B: X" in text and text.startswith("duration_ms: A=100.0 B=90.0")


@pytest.mark.parametrize("width", [1, 100])
def test_timeline(spark, width):
    s = 1_000_000
    ev = events(spark, [dict(syscall="execve", path="/bin/x", ts_us=0)] + [dict(syscall="open", error="ENOENT", ts_us=s + i) for i in range(3)] +
                [dict(syscall="stat", error="ENOENT", ts_us=2 * s), dict(syscall="read", lat_us=250_400, ts_us=3 * s), dict(syscall="read", ts_us=3 * s + 1),
                 dict(syscall="SIGTERM", event_type="signal", ts_us=4 * s), dict(syscall="exit", event_type="exit", retval="0", ts_us=5 * s)])
    starts = spark.createDataFrame([("r", 0)], "run_id string, started_us long")
    got = [r.text for r in timeline.timeline_lines(ev, starts, block=block(width * s, "ts_us")).orderBy("line").collect()]
    assert got == ["+0.00s exec /bin/x", "+1.00-1.00s open -> ENOENT x3", "+2.00s stat -> ENOENT", "+3.00s read took 250ms", "+4.00s signal SIGTERM", "+5.00s exited 0"]
    short = [r.text for r in timeline.timeline_lines(ev, starts, 3).orderBy("line").collect()]
    assert short == got[:2] + ["... (4 more)"]
    w = spark.createDataFrame([("r", s, s + 1), ("r", None, 9), ("r", 5 * s, 5 * s)], "run_id string, a long, z long")
    assert sorted(r.ts_us for r in timeline.inside_windows(ev.select("run_id", "ts_us"), w, "a", "z", block=block(width, "at")).collect()) == [s, s + 1, 5 * s]


def test_incidents(spark):
    inc = spark.createDataFrame([("r:x", "r", "x", "medium", "Old", 1, 3, ["a", "b", "c", "d", "e"]), ("r:x2", "r", "x", "medium", "New", 2, 1, None), ("r:y", "r", "y", "low", "Y", 5, 1, None)],
                                "incident_id string, run_id string, rule_id string, severity string, title string, ts_us long, count long, hot_stack array<string>")
    f = by(incidents.to_findings(inc), "rule_id")
    assert (f["x"].title, f["y"].severity_score) == ("New", 0.5) and "off the CPU" in f["x"].description
    assert "b > c > d > e" in by(incidents.to_findings(inc.where("ts_us = 1")), "rule_id")["x"].description


def test_catalog(spark):
    runs = spark.createDataFrame([("1", "s", 10, None, None, "running", None, None), ("2", "s", 30, None, None, "completed", 0, None), ("3", "t", 20, None, None, "analyzing", None, None)],
                                 "run_id string, session_id string, started_us long, ended_us long, duration_ms long, status string, exit_code int, exit_signal string")
    assert [r.run_id for r in catalog.session_runs(runs, "s").collect()] == ["2", "1"]
    assert [r.run_id for r in catalog.recent_runs(runs, 0, 1).collect()] == ["3"]
    assert {r.session_id: r.run_ids for r in catalog.runs_by_session(runs, 2).collect()} == {"s": ["2", "1"], "t": ["3"]}
    assert {r.session_id: (r.runs, r.run_ids) for r in catalog.runs_by_session(runs, 1).collect()} == {"s": (2, ["2"]), "t": (1, ["3"])}
    more = runs.select("run_id", "session_id", "started_us").union(spark.createDataFrame(
        [("4", "s", None), ("5", "s", 30), ("6", None, 1), ("7", None, 9)], "run_id string, session_id string, started_us long"))
    want = {("s", "5", 1, 4), ("s", "2", 2, 4), ("s", "1", 3, 4), ("s", "4", 4, 4), ("t", "3", 1, 1), (None, "7", 1, 2), (None, "6", 2, 2)}
    assert set(rows(catalog.run_places(more))) == set(rows(catalog.run_places(more, block(7, "started_us")))) == want
    assert {r.status for r in catalog.reconcile(runs).collect()} == {"error", "completed"}
    ends = spark.createDataFrame([("1", 5_000, 1, "SIGKILL")], "run_id string, ended_us long, exit_code int, exit_signal string")
    done = by(catalog.finalise(runs, ends, spark.createDataFrame([("1", "high")], "run_id string, max_severity string")), "run_id")
    assert (done["1"].duration_ms, done["1"].status, done["1"].max_severity, done["3"].status) == (4, "completed", "high", "analyzing")
    m = metrics(spark, [dict(cpu_pct=1.0)], run="9")
    assert [r.run_id for r in catalog.stale_runs(runs, m, 100, 50).collect()] == ["1"]
    assert [r.run_id for r in catalog.without_runs(runs, catalog.runs_of_sessions(runs, spark.createDataFrame([("s",)], "session_id string"))).collect()] == ["3"]
    rules = spark.createDataFrame([("a", "n", True), ("b", "m", True)], "id string, name string, enabled boolean")
    patch = spark.createDataFrame([("a", None, False, 1), ("a", "new", None, 2)], "id string, name string, enabled boolean, at long")
    assert sorted(rows(catalog.patch_by_id(rules, patch, ["id"], "at"), "id", "name", "enabled")) == [("a", "new", False), ("b", "m", True)]
    assert [r.id for r in catalog.ordered_by(spark.createDataFrame([("x", None), ("y", -2), ("z", 3)], "id string, v long"), "v").collect()] == ["z", "x", "y"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "run.log").write_bytes(b"abc")
    (tmp_path / "raw.data").write_bytes(b"\x00")
    got = by(catalog.artifacts(spark.read.format("binaryFile").load(str(tmp_path))), "name")
    assert (got["run.log"].size_bytes, got["run.log"].is_text, got["raw.data"].is_text) == (3, True, False)
    assert got["run.log"].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_digest_orders_sections(spark):
    lines = spark.createDataFrame([("r", "findings", 1, "f"), ("r", "totals", 1, "t"), ("r", "calls", 2, "b"), ("r", "calls", 1, "a")], "run_id string, section string, line int, text string")
    assert one(digest.run_digest(lines)).digest == "totals: t\ncalls: a\ncalls: b\nfindings: f"
