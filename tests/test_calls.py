"""Call tables: values worked out by hand for short event lists."""

import pytest

from runlens.operators import calls

from .helpers import block, by, events, metrics, one, rows

CONNECT = '3, {sa_family=AF_INET, sin_port=htons(12345), sin_addr=inet_addr("192.0.2.1")}, 16'


def test_call_stats(spark):
    ev = events(spark, [dict(syscall="read", lat_us=i * 1000) for i in range(1, 101)] + [dict(syscall="close", error="EBADF")] +
                [dict(syscall="", lat_us=5), dict(syscall="malloc", event_type="libcall", lat_us=9)])
    got = by(calls.call_stats(ev), "syscall")
    r = got["read"]
    assert (r["count"], r.total_ms, r.avg_ms, r.p50_ms) == (100, 5050.0, 50.5, 50.5)
    assert (r.p95_ms, r.p99_ms, r.pct_runtime) == pytest.approx((95.05, 99.01, 100.0))
    c = got["close"]
    assert (c["count"], c.errors, c.total_ms, c.avg_ms, c.p50_ms) == (1, 1, 0.0, None, None) and set(got) == {"read", "close"}


@pytest.mark.parametrize("width", [1, 2, 100])
def test_file_io(spark, width):
    ev = events(spark, [
        dict(syscall="openat", retval="3", path="/data/a.txt"), dict(syscall="read", retval="100", fd=3),
        dict(syscall="read", retval="50", fd=3), dict(syscall="write", retval="10", fd=3), dict(syscall="close", retval="0", fd=3),
        dict(syscall="openat", retval="4", path="/data/b.txt"), dict(syscall="write", retval="200", fd=4),
        dict(syscall="openat", retval="-1", error="ENOENT", path="/data/missing"), dict(syscall="read", retval="7", fd=9),
        dict(syscall="read", retval="-1", fd=4), dict(syscall="close", fd=4, error="EIO", retval="-1")])
    got = by(calls.file_io(ev, block(width)), "path")
    a, b = got["/data/a.txt"], got["/data/b.txt"]
    assert (a.opens, a.closes, a.reads, a.read_bytes, a.writes, a.write_bytes, a.leaked) == (1, 1, 2, 150, 1, 10, 0)
    assert (b.opens, b.closes, b.reads, b.write_bytes, b.leaked) == (1, 0, 0, 200, 1) and len(got) == 2


def test_file_io_descriptor_reuse(spark):
    ev = events(spark, [dict(syscall="open", retval="3", path="/x"), dict(syscall="close", retval="0", fd=3),
                        dict(syscall="open", retval="0x3", path="/y"), dict(syscall="read", retval="5", fd=3),
                        dict(syscall="open", retval="3", path="/z")])
    got = by(calls.file_io(ev, block(1)), "path")
    assert (got["/y"].reads, got["/y"].read_bytes, got["/x"].reads) == (1, 5, 0)
    assert {p: r.leaked for p, r in got.items()} == {"/x": 0, "/y": 0, "/z": 1}  # overwritten without close is no leak


@pytest.mark.parametrize("width", [1, 100])
def test_connections(spark, width):
    ev = events(spark, [
        dict(syscall="connect", args=CONNECT, retval="-1", error="EINPROGRESS", lat_us=180), dict(syscall="read", retval="0", fd=9),
        dict(syscall="poll", retval="0", lat_us=2_503_000), dict(syscall="poll", retval="1", lat_us=5),
        dict(syscall="connect", args='3, {sa_family=AF_UNIX, sun_path="/run/x"}', retval="0", lat_us=9),
        dict(syscall="connect", args=CONNECT, error="EALREADY"), dict(syscall="connect", args="junk", error="ECONNREFUSED"),
        dict(syscall="epoll_wait", retval="1", lat_us=7)])
    got = rows(calls.connections(ev, block(width)).orderBy("seq"), "family", "address", "port", "result", "latency_ms")
    assert got == [("AF_INET", "192.0.2.1", 12345, "timed out", 2503.18), ("AF_UNIX", "/run/x", None, "ok", 0.009),
                   ("AF_INET", "192.0.2.1", 12345, "connecting", None), ("AF_?", None, None, "ECONNREFUSED", None)]
    s = one(calls.connection_summary(calls.connections(ev)))
    assert (s.connections, s.hosts, s.failures) == (4, 2, 2)


def test_processes(spark):
    ms = 1000
    ev = events(spark, [
        dict(pid=100, syscall="execve", retval="0", path="/usr/bin/python3", ts_us=0), dict(pid=100, syscall="clone", retval="200", ts_us=10 * ms),
        dict(pid=100, syscall="read", retval="5", ts_us=20 * ms), dict(pid=100, syscall="wait4", retval="200", ts_us=500 * ms),
        dict(pid=200, syscall="execve", retval="0", path="/bin/sh", ts_us=12 * ms), dict(pid=200, syscall="write", retval="3", ts_us=15 * ms),
        dict(pid=200, syscall="exit", event_type="exit", ts_us=80 * ms), dict(pid=200, syscall="vfork", retval="300", ts_us=81 * ms)])
    got = by(calls.process_table(ev), "pid")
    assert (got[100].command, got[100].parent_pid, got[100].syscalls, got[100].ephemeral, got[100].duration_ms) == (
        "/usr/bin/python3", None, 4, False, 500.0)
    assert (got[200].command, got[200].parent_pid, got[200].exited, got[200].ephemeral) == ("/bin/sh", 100, True, True)
    assert (got[300].parent_pid, got[300].syscalls, got[300].duration_ms, got[300].ephemeral) == (200, 0, None, False)


def test_call_rate(spark):
    ev = events(spark, [dict(syscall="read", ts_us=t) for t in (740_000, 750_000, 760_000, 1_000_000, 1_000_001, 1_500_000, 9_000_000)] +
                [dict(syscall="malloc", event_type="libcall", ts_us=1_000_002), dict(syscall="SIGTERM", event_type="signal", ts_us=1_000_003)])
    m = metrics(spark, [dict(ts_us=1_000_000), dict(ts_us=1_500_000), dict(ts_us=2_000_000)])
    got = by(calls.call_rate(ev, m, block(300_000, "ts_us")), "ts_us")
    assert {t: (r.calls, r.syscall_rate) for t, r in got.items()} == {1_000_000: (2, 8.0), 1_500_000: (2, 4.0), 2_000_000: (0, 0.0)}
    assert calls.call_rate(events(spark, [dict(syscall="x", event_type="signal")]), m).count() == 0


def test_totals_and_top(spark):
    ev = events(spark, [dict(syscall="b"), dict(syscall="a", error="E1"), dict(syscall="b", event_type="libcall"), dict(syscall="S", event_type="signal"),
                        dict(syscall="exit", event_type="exit")])
    t = one(calls.run_totals(ev))
    assert (t.events, t.signals, t.syscall_events, t.errors) == (5, 1, 2, 1)
    assert rows(calls.top_calls(ev), "syscall", "count", "rank") == [("b", 1, 1), ("a", 1, 2)]


def test_library_calls(spark):
    ev = events(spark, [dict(event_type="libcall", syscall="f", lat_us=3000), dict(event_type="libcall", syscall="f", error="E"),
                        dict(event_type="libcall", syscall="g", lat_us=1000), dict(syscall="read", lat_us=99)])
    assert rows(calls.library_calls(ev).orderBy("function"), "function", "calls", "total_ms", "avg_ms", "errors") == [
        ("f", 2, 3.0, 1.5, 1), ("g", 1, 1.0, 1.0, 0)]
