"""Parsers on literal lines."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from runlens.operators import latency
from runlens.schemas import TRACE_EVENTS
from runlens.sources import archive, lines as text, logs, probes, profiles

from .helpers import block, by, events, lines, one, rows


def parse(spark, *raw, dialect=logs.SYSCALL_LOG, width=1):
    return logs.parse_log(lines(spark, list(raw)), dialect, block(width)).orderBy("seq").collect()


def test_plain_calls(spark):
    a, b, c, d = parse(
        spark, '971123 1782014232.330994 access("/etc/ld.so.preload", R_OK) = -1 ENOENT (No such file or directory) <0.000020>',
        '12 1700000000.000002 mmap(NULL, 8192, PROT_READ|PROT_WRITE, MAP_PRIVATE|MAP_ANONYMOUS, -1, 0) = 0x7f657b4c0000 <0.000022>',
        '12 1700000000.000003 read(3, "he) = 9\\"llo", 4096) = 5 <0.000010>', "1700000000.0 brk(NULL) = ? <1.5>")
    assert (a.pid, a.event_type, a.syscall, a.retval, a.error, a.path, a.lat_us, a.ts_us) == (
        971123, "syscall", "access", "-1", "ENOENT", "/etc/ld.so.preload", 20, 1782014232330994)
    assert (b.syscall, b.retval, b.error, b.fd) == ("mmap", "0x7f657b4c0000", None, None)
    assert (c.syscall, c.fd, c.retval, c.args) == ("read", 3, "5", '3, "he) = 9\\"llo", 4096')
    assert (d.pid, d.syscall, d.retval, d.lat_us) == (0, "brk", "?", 1_500_000)


def test_signals_exits_garbage(spark):
    got = parse(spark, "12 1700000000.5 --- SIGSEGV {si_signo=SIGSEGV} ---", "12 1700000000.6 +++ exited with 0 +++", "12 1700000000.7 +++ killed by SIGKILL +++",
                "not a log line", "", "12 1700000000.8 odd text", "12 1700000000.9 write(1, \"x\" <unfinished ...>")
    assert [(r.event_type, r.syscall, r.retval, r.error) for r in got] == [
        ("signal", "SIGSEGV", None, None), ("exit", "exit", "0", None), ("exit", "exit", None, "SIGKILL")]


@pytest.mark.parametrize("width", [1, 100])
def test_split_calls(spark, width):
    got = parse(spark, "100 1700000000.000000 read(3,  <unfinished ...>", '200 1700000000.000100 write(4, "x", 1) = 1 <0.000005>',
                '100 1700000000.001000 <... read resumed> "data", 4096) = 100 <0.000500>', "300 1700000000.1 <... futex resumed>) = 0 <0.1>",
                "400 1700000000.2 open( <unfinished ...>", "400 1700000000.3 read(7, <unfinished ...>", '400 1700000000.4 <... read resumed>"", 9) = 0 <0.2>',
                '400 1700000000.5 <... read resumed>"", 9) = 0 <0.2>', width=width)
    assert [(r.pid, r.syscall, r.args, r.fd, r.ts_us % 1_000_000) for r in got] == [
        (200, "write", '4, "x", 1', 4, 100), (100, "read", '3,   "data", 4096', 3, 0), (300, "futex", "", None, 100_000),
        (400, "read", '7, "", 9', 7, 300_000), (400, "read", '"", 9', None, 500_000)]
    assert got[1].lat_us == 500 and got[1].retval == "100"


def test_library_log(spark):
    got = parse(spark, "734474 1782133300.300000 malloc(65536)          = 0x3640b010 <0.000101>",
                '[pid 9] 1782133300.268194 openat@SYS(AT_FDCWD, "/etc/ld.so.cache", 0x80000, 00) = 3 <0.000120>',
                "7 1782133300.310000 free(0x3640b010)        = <void> <0.000089>", "7 1782133300.642578 malloc(65536 <unfinished ...>",
                "7 1782133300.643612 brk@SYS(nil) = 0xec59000 <0.000040>", "7 1782133300.643738 <... malloc resumed> ) = 0x3640b010 <0.000432>",
                "7 1782133300.700000 --- SIGCHLD (Child exited) ---", "7 1782133300.8 +++ exited (status 0) +++",
                '9 1782133300.0 access@SYS("/x", 04) = -1 ENOENT (No such file or directory) <0.000020>', "7 1782133300.9 getenv(\"A\") = \"b c\"", dialect=logs.LIBRARY_LOG)
    assert [(r.pid, r.event_type, r.syscall, r.retval) for r in got] == [
        (734474, "libcall", "malloc", "0x3640b010"), (9, "syscall", "openat", "3"), (7, "libcall", "free", "<void>"), (7, "syscall", "brk", "0xec59000"),
        (7, "libcall", "malloc", "0x3640b010"), (7, "signal", "SIGCHLD", None), (7, "exit", "exit", "0"), (9, "syscall", "access", "-1"), (7, "libcall", "getenv", '"b c"')]
    assert got[1].path == "/etc/ld.so.cache" and got[4].ts_us % 1_000_000 == 642578 and got[4].args == "65536" and got[7].args == '"/x", 04'


@pytest.mark.parametrize("width", [1, 100])
def test_program_output(spark, width):
    raw = ['100 1700000000.000001 write(1, "hi\\n", 3) = 3 <0.000010>', " | 00000  68 69 0a                                          hi.              |",
           '100 1700000000.000002 write(2, "x", 5) = 5 <0.000010>', " | 00000  6f 6f 70 73 20 6f 6f 70  73 20 6f 6f 70 73 20 6f  oops oops oops o |",
           " | 00010  c3 a9 ff                                          ...              |", "100 1700000000.000003 close(3)          = 0 <0.000005>",
           " | 00000  41 41                                             AA               |", '100 1700000000.000004 write(1, "", 0) = 0 <0.1>']
    got = rows(logs.program_output(lines(spark, raw), block(width)).orderBy("seq"), "ts_us", "stream", "text")
    assert got == [(1700000000000001, "stdout", "hi\n"), (1700000000000002, "stderr", "oops oops oops oé�")]


REQ = ["Attached 12 probes", "REQ 1000000000 9 100 GET /slow HTTP/1.1", "Host: localhost", "", "SQL 1000500000 9 100 300000000 SELECT pg_sleep(0.3), 42",
       "RSP 1000000000 1306000000 200", "REQ 2000000000 9 101 POST /checkout HTTP/1.1", "RSP 2000000000 2008000000 500", "RSP 2000000000 2009000000 500",
       "REQ 3000000000 9 102 GET /users/42?x=1 HTTP/1.1", "RSP 3000000000 2003000000 oops", "REQ 5 9 7 GET /x HTTP/1.1", "RSP 999 1000 200", "SQL 1000 9 100 250000000"]


def test_request_probe(spark):
    got = {r.route: r for r in probes.http_spans(lines(spark, REQ)).collect()}
    assert set(got) == {"/slow", "/checkout", "/users/42"}
    assert (got["/slow"].dur_ns, got["/slow"].tid, got["/slow"].method) == (306_000_000, 100, "GET")
    assert (got["/users/42"].dur_ns, got["/users/42"].status, got["/checkout"].status) == (0, None, 500)
    q = {r.start_ns: r for r in probes.db_spans(lines(spark, REQ)).collect()}
    assert (q[1000500000].statement, q[1000500000].dur_ns) == ("SELECT pg_sleep(?.?), ?", 300_000_000)
    assert (q[1000].name, q[1000].statement) == ("query", "")


def test_intervals_probe(spark):
    raw = ["OFF 100 1000 200000000 4", "RQ 100 1300 10000000", "OFF 101 5 5000000 3", "OFF 102 5 5000 9", "noise", "OFF x y z 1", "OFF 1 2 3"]
    got = rows(probes.thread_intervals(lines(spark, raw)).orderBy("seq"), "kind", "tid", "reason")
    assert got == [("off", 100, "sleep"), ("rq", 100, None), ("off", 101, "lock"), ("off", 102, "other")]


def test_histograms(spark):
    h = ["Tracing", "     msecs               : count     distribution", "         0 -> 1          : 120      |***|", "         2 -> 3          : 30       |*|",
         "         4 -> 7          : 8        | |", "         8 -> 15         : 2        | |", "       128 -> 255        : 1        | |"]
    s = one(latency.histogram_summary(probes.log2_histograms(lines(spark, h))))
    assert (s.unit, s.total, s.p50, s.p90, s.p99, s["max"]) == ("msecs", 161, 1, 3, 15, 255)
    m = ["@other:", "[0]  9 |@|", "@usecs: ", "[0]                    3 |@@@@          |", "[1]                    8 |@@@|", "[2, 4)                 5 |@@@|",
         "[16, 32)               1 |@@            |", "[1K, 2K)  4 |@|"]
    b = probes.map_histograms(lines(spark, m), {"usecs": "usecs"})
    s = one(latency.histogram_summary(b))
    assert (s.total, s["max"]) == (21, 2048) and b.count() == 5


def test_latency_findings(spark):
    s = spark.createDataFrame([("r", "runqueue", "msecs", 50), ("r", "block_io", "msecs", 25), ("q", "runqueue", "usecs", 20000), ("z", "runqueue", "msecs", 1),
                               ("y", "runqueue", "eons", 99)], "run_id string, hist string, unit string, p99 long")
    assert sorted(rows(latency.latency_findings(s), "run_id", "rule_id", "severity")) == [
        ("q", "high_runqueue_latency", "medium"), ("r", "high_runqueue_latency", "high"), ("r", "slow_block_io", "medium")]


def test_block_io(spark):
    raw = ["TIME(s) COMM PID DISK T SECTOR BYTES LAT(ms)"] + [f"{i}.0 job {7 if i % 2 else 8} sda {'R' if i < 5 else 'W'} 1 {i * 10} {i}.5" for i in range(1, 10)] + ["short row"]
    s = one(latency.block_io_stats(probes.block_io(lines(spark, raw), spark.createDataFrame([("r", 7)], "run_id string, pid long"))))
    assert (s["count"], s.p50_ms, s.p99_ms, s.max_ms, s.read_count, s.write_count, s.bytes_total, s.total_ms) == (5, 5.5, 9.5, 9.5, 2, 3, 250, 27.5)


def test_gc(spark):
    got = rows(probes.gc_pauses(lines(spark, ["x", "GC 5000 7", "GC 9000 3", "GC a 3"])).orderBy("seq"), "start_ns", "dur_us")
    assert got == [(0, 7), (4000, 3)]
    got = rows(probes.gc_table(lines(spark, ["Tracing...", "START    TIME (us) DESCRIPTION", "1.5 2000 None", "bad row x", "2.5 10 None"])).orderBy("seq"), "start_s", "duration_ms")
    assert got == [(1.5, 2.0), (2.5, 0.01)]


def test_offcpu_stacks(spark):
    raw = ["@ostk[100, ", "        perf_trace_sched_switch+20", "        __schedule+1131", "        schedule+39", "        schedule_hrtimeout_range_clock+321",
           "        do_nanosleep+123", "]: 200000000", "stray", "@ostk[101, ", "        perf_trace_sched_switch+20", "        futex_wait_queue+0x70",
           "        schedule+1", "        futex_do_wait+200", "]: 500", "@ostk[102, ", "        schedule+1", "]: 9"]
    got = {r.tid: (r.frames, r.weight) for r in probes.offcpu_stacks(lines(spark, raw)).collect()}
    assert got == {100: (["do_nanosleep", "schedule_hrtimeout_range_clock"], 200000), 101: (["futex_do_wait", "schedule", "futex_wait_queue"], 1)}


@pytest.mark.parametrize("width", [1, 100])
def test_text_stacks(spark, width):
    raw = ["cpu  712 22377.4:  124 cycles:", "\t7ff31 leaf+0x71 (/lib/a)", "\t7ff32 [unknown] (/lib/a)", "\t7ff33 main+0x1 (/app)", "", "cpu 712 1.0: 1 cycles:",
           "\t7ff33 main (/app)", "cpu 712 1.0: 1 cycles:", "\tbroken", ""]
    assert sorted(rows(profiles.text_stacks(lines(spark, raw), block(width)), "frames")) == [(["main"],), (["main", "[unknown]", "leaf"],)]
    php = ["0 leaf /a:1", "1 main /b:2", "# note", "", "0 other /x:3", "word", ""]
    assert sorted(rows(profiles.depth_stacks(lines(spark, php), block(width)), "frames")) == [(["main", "leaf"],), (["word", "other"],)]
    col = ["a;b;c 3", "a;;b 2", "bad", "x y", "a b;c 1"]
    assert sorted(rows(profiles.collapsed_stacks(lines(spark, col)), "frames", "weight")) == [(["a", "b"], 2), (["a", "b", "c"], 3), (["a b", "c"], 1)]


def test_json_profiles(spark):
    speed = '{"shared":{"frames":[{"name":"main"},{"name":"f"},{}]},"profiles":[{"type":"sampled","samples":[[0,1],[0,2],[0,9]],"weights":[5,2]},{"type":"evented"}]}'
    cpu = ('{"nodes":[{"id":1,"callFrame":{"functionName":"(root)"},"children":[2]},{"id":2,"callFrame":{"functionName":"main","url":"file:///a/app.js","lineNumber":4},'
           '"children":[3]},{"id":3,"callFrame":{"functionName":"","url":"node:fs"}}],"samples":[3,2,3,1,77],"timeDeltas":[0,10,20,30,-5]}')
    docs = spark.createDataFrame([("s", speed), ("c", cpu)], "run_id string, doc string")
    assert sorted(rows(profiles.sampled_json(docs.where("run_id = 's'")), "frames", "weight")) == [(["main"], 1), (["main", "[unknown]"], 2), (["main", "f"], 5)]
    got = sorted(rows(profiles.linked_json(docs.where("run_id = 'c'")), "frames", "weight"))
    assert got == [(["main (app.js:4)"], 20), (["main (app.js:4)", "(anonymous)"], 40)]


def test_sampled_profiles_share_frames(spark):
    """Names are looked up inside the document: no row of a sample carries the frame table or the weights."""
    doc = ('{"shared":{"frames":[{"name":"main"},{"name":""},{"name":"g"}]},"profiles":[{"type":"sampled","samples":[[0,2],null,[-1,7],[0,1]],"weights":[3,4,5]},'
           '{"type":"evented","samples":[[0]]},{"samples":[[0]]},null,{"type":"sampled","samples":[[2]],"weights":null},{"type":"sampled"}]}')
    docs = spark.createDataFrame([("s", doc), ("n", "{}"), ("b", "no json"), ("z", None)], "run_id string, doc string")
    out = profiles.sampled_json(docs)
    assert sorted(rows(out, "run_id", "frames", "weight")) == [("s", ["g"], 1), ("s", ["main", "[unknown]"], 1), ("s", ["main", "g"], 3)]
    samples = next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in x)
    assert re.search(r"\), \[run_id#\d+\], ", samples), samples


def test_lines_keep_file_order_over_many_splits(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / f"run_id={run}").mkdir()
        (tmp_path / f"run_id={run}" / "x.log").write_text("".join(f"{run}{i}\n" if i % 7 else "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = text.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        for run in ("a", "b"):
            got = [(r.seq, r.line) for r in df.where(F.col("run_id") == run).orderBy("seq").collect()]
            assert [x for _, x in got] == [f"{run}{i}" if i % 7 else "" for i in range(3000)] and len({s for s, _ in got}) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archive_round_trips(spark, tmp_path):
    import zstandard
    ev = events(spark, [dict(syscall="read", fd=3, lat_us=5, args='"é"'), dict(syscall="x", error="EIO", retval="-1")], run="a").unionByName(
        events(spark, [dict(syscall="y")], run="b"))
    archive.write_table(ev, str(tmp_path / "pq"), ["seq"], buckets=3, spread="seq")
    back = archive.read_table(spark, str(tmp_path / "pq"), TRACE_EVENTS)
    assert sorted(map(repr, back.select(ev.columns).collect())) == sorted(map(repr, ev.collect()))
    assert "PartitionFilters: [isnotnull(run_id" in back.where("run_id = 'a'")._jdf.queryExecution().toString()
    text_rows = [r.value for r in archive.events_to_json(ev.where("run_id = 'a'")).orderBy("seq").collect()]
    (tmp_path / "z" / "run_id=a").mkdir(parents=True)
    (tmp_path / "z" / "run_id=a" / "events.zst").write_bytes(zstandard.compress("\n".join(text_rows).encode()))
    got = archive.events_from_json(archive.read_zstd_lines(spark, str(tmp_path / "z" / "*"))).orderBy("seq").collect()
    assert [(r.syscall, r.args, r.lat_us, r.fd) for r in got] == [("read", '"é"', 5, 3), ("x", "", None, None)]
    (tmp_path / "m.json.gz").write_bytes(gzip.compress(b'{"timestamp_ms": 1.5, "cpu_pct": 2.0}\n{"bad": 1}\n'))
    m = archive.metrics_from_json(spark.read.text(str(tmp_path / "m.json.gz")).select(F.lit("r").alias("run_id"), F.col("value").alias("line")))
    assert (one(m).ts_us, one(m).cpu_pct, one(m).rss_mb) == (1500, 2.0, None)


def test_profile_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a;b 3\na;b 4\n")
    (tmp_path / "two.json").write_text('{"nodes":[{"id":1,"callFrame":{"functionName":"f"}}],"samples":[1,1],"timeDeltas":[0,9]}')
    (tmp_path / "cut.json").write_text('{"nodes":[{"id":1')
    got = rows(profiles.read_profiles(spark, str(tmp_path / "one.txt"), "collapsed"), "run_id", "frames", "weight")
    assert sorted(got) == [("one", ["a", "b"], 3), ("one", ["a", "b"], 4)]
    assert rows(profiles.read_profiles(spark, str(tmp_path / "*.json"), "cpuprofile"), "run_id", "frames", "weight") == [("two", ["f"], 10)]
    with pytest.raises(ValueError):
        profiles.read_profiles(spark, str(tmp_path), "other")


def test_summary_documents(spark, tmp_path):
    ev = events(spark, [dict(syscall="read")], run="a")
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    found = spark.createDataFrame([("a", "x", "low", "X")], "run_id string, rule_id string, severity string, title string")
    m = spark.createDataFrame([("a", 1, 2.0, 3.0)], "run_id string, ts_us long, cpu_pct double, rss_mb double")
    archive.write_json(archive.run_summaries(runs, ev, m, found), str(tmp_path / "s"))
    back = by(archive.read_json(spark, str(tmp_path / "s"), archive.run_summaries(runs, ev, m, found).schema), "run_id")
    assert back["a"].findings[0].rule_id == "x" and back["a"].top_calls[0]["count"] == 1 and back["b"].events is None
