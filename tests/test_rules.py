"""Every built-in rule once firing and once silent."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import rules
from runlens.operators.rules import Thresholds

from .helpers import block, by, events, metrics, one, rows

T = Thresholds()
PEER = '3, {sa_family=AF_INET, sin_port=htons(5432), sin_addr=inet_addr("10.0.0.5")}, 16'


def repeat(n, **row):
    return [dict(row) for _ in range(n)]


CASES = [
    ("repeated_open_same_file", repeat(11, syscall="openat", path="/a", retval="3"), repeat(10, syscall="openat", path="/a", retval="3")
     + repeat(50, syscall="openat", path="/usr/lib/x.so", retval="3")),
    ("failed_file_opens", repeat(6, syscall="stat", path="/etc/app.conf", error="ENOENT"), repeat(5, syscall="stat", path="/etc/app.conf", error="EACCES")
     + repeat(99, syscall="open", path="/proc/1", error="ENOENT") + repeat(9, syscall="open", error="ENOENT")),
    ("slow_network_connect", repeat(1, syscall="connect", lat_us=1_000_001, args=PEER), repeat(1, syscall="connect", lat_us=1_000_000, args=PEER)),
    ("slow_syscall", repeat(1, syscall="fsync", lat_us=1_000_001), repeat(1, syscall="futex", lat_us=9_000_000)),
    ("slow_file_io", repeat(1, syscall="write", lat_us=100_001), repeat(1, syscall="write", lat_us=100_000) + repeat(1, syscall="write", lat_us=200_000, error="EIO")),
    ("excessive_subprocess", repeat(51, syscall="execve", path="/bin/x"), repeat(50, syscall="execve") + repeat(9, syscall="execve", error="ENOENT")),
    ("connection_error", repeat(1, syscall="sendto", error="ECONNRESET"), repeat(1, syscall="close", error="ECONNRESET")),
    ("no_connection_reuse", repeat(6, syscall="connect", args=PEER), repeat(5, syscall="connect", args=PEER) + repeat(9, syscall="connect", args=PEER, error="ECONNREFUSED")),
    ("mutex_contention", repeat(21, syscall="futex", lat_us=10_001), repeat(21, syscall="futex", lat_us=10_000)),
    ("io_retry_loop", repeat(101, syscall="read", fd=4, error="EAGAIN"), repeat(100, syscall="read", fd=4, error="EINTR") + repeat(90, syscall="read", fd=5, error="EAGAIN")),
    ("small_read_storm", repeat(2001, syscall="read", fd=4, retval="1"), repeat(2000, syscall="read", fd=4, retval="1") + repeat(500, syscall="read", fd=4, retval="512")),
    ("write_storm", repeat(1001, syscall="write", fd=3, retval="1"), repeat(5000, syscall="write", fd=2, retval="1")),
]

UP = [dict(rss_mb=100.0 + i * 6) for i in range(12)]
SAW = [dict(rss_mb=100.0 + i * 20 - (i % 2) * 60) for i in range(12)]
WARM = [dict(rss_mb=10.0 + i) for i in range(200)] + [dict(rss_mb=210.0)] * 360
HOT, BOXED = [dict(cpu_pct=140.0)] * 8, [dict(cpu_pct=45.0, rss_mb=90.0)] * 8
DIAL = [dict(syscall="connect", args=PEER, error="EINPROGRESS", ts_us=5), dict(syscall="getpid"), dict(syscall="poll", lat_us=1_500_000, ts_us=9),
        dict(syscall="connect", args=PEER, error="EINPROGRESS"), dict(syscall="connect", args=PEER), dict(syscall="poll", lat_us=1_500_000)]
WAIT = [dict(syscall="connect", args=PEER, error="EINPROGRESS"), dict(syscall="read", fd=3, lat_us=600_000), dict(syscall="recv", fd=3, lat_us=500_000),
        dict(syscall="read", fd=3, lat_us=100_000), dict(syscall="close", fd=3, error="EIO"), dict(syscall="read", fd=3, lat_us=9_000_000)]
IDLE, POLLS, TIES = repeat(200, syscall="brk"), repeat(2001, syscall="poll", lat_us=5), [dict(syscall="open", path=p, retval="3") for p in ["/b", "/a"] * 12]
MB = 1024 * 1024

# name -> (events, samples, (duration, quota, limit)): each is a run of its own, and all runs are judged together.
RUNS = {f"hot {c[0]}": (c[1], [], ()) for c in CASES} | {f"quiet {c[0]}": (c[2], [], ()) for c in CASES} | {
    "dial": (DIAL, [], ()), "wait": (WAIT, [], ()), "short wait": (WAIT[:2], [], ()), "ties": (TIES, [], ()),
    "stuck": (IDLE, [], (30_000,)), "busy": (IDLE + [dict(syscall="brk")], [], (30_000,)), "brief": (IDLE, [], (29_999,)), "no events": ([], [dict(rss_mb=1.0)] * 9, (90_000,)),
    "spin": (POLLS, [dict(cpu_pct=81.0)], ()), "calm spin": (POLLS, [dict(cpu_pct=80.0)], ()), "blind spin": (POLLS, [], ()),
    "up": ([], UP, ()), "few": ([], UP[:7], ()), "saw": ([], SAW, ()), "fds": ([], [dict(open_fds=10 + i * 3) for i in range(11)], ()),
    "few fds": ([], [dict(open_fds=10 + i * 2) for i in range(11)], ()), "warm": ([], WARM, (600_000,)), "warm long": ([], WARM, (600_001,)),
    "hot": ([], HOT, ()), "hot short": ([], HOT[:7], ()), "hot io": ([], [dict(cpu_pct=140.0, io_read_bps=262_144.0)] * 8, ()),
    "rated": ([], [dict(cpu_pct=140.0, syscall_rate=49.0)] * 8, ()), "chatty": ([], [dict(cpu_pct=140.0, syscall_rate=50.0)] * 8, ()),
    "io": ([], [dict(cpu_pct=39.0, io_write_bps=65_537.0)] * 8, ()), "less io": ([], [dict(cpu_pct=39.0, io_write_bps=65_536.0)] * 8, ()),
    "boxed": ([], BOXED, (1, 0.5, 100 * MB)), "roomy": ([], BOXED, (1, 0.6, 101 * MB)), "unboxed": ([], BOXED, ()),
    "spike": ([], [dict(rss_mb=1.0), dict(), dict(rss_mb=101.5)], ()), "step": ([], [dict(rss_mb=1.0), dict(rss_mb=101.0)], ()),
}


def tables(spark):
    ev, ms, rs = [], [], []
    for name, (e, m, r) in RUNS.items():
        ev += [dict(x, run_id=name, seq=i, ts_us=x.get("ts_us", i)) for i, x in enumerate(e)]
        ms += [dict(x, run_id=name, ts_us=i * 250_000) for i, x in enumerate(m)]
        rs.append((name, *(r + (1000, None, None)[len(r):])))
    return events(spark, ev).cache(), metrics(spark, ms).cache(), spark.createDataFrame(
        rs, "run_id string, duration_ms long, cgroup_cpu_quota_cores double, cgroup_mem_limit_bytes long")


@pytest.fixture(scope="module")
def data(spark):
    return tables(spark)


@pytest.fixture(scope="module", params=[3, None], ids=["small blocks", "default blocks"])
def found(request, data):
    """run -> rule -> finding, once with blocks of a few rows and once with the default ones."""
    w = request.param
    out = {name: {} for name in RUNS}
    for r in rules.run_rules(*data, T, block=block(w) if w else None, metric_block=block(w * 250_000, "ts_us") if w else None).collect():
        out[r.run_id][r.rule_id] = r
    return out


@pytest.mark.parametrize("rule", [c[0] for c in CASES])
def test_event_rule(found, rule):
    assert rule in found[f"hot {rule}"] and rule not in found[f"quiet {rule}"]


def test_catalog_is_complete(spark):
    meta = by(rules.metadata(spark), "rule_id")
    assert len(meta) == 23 and {f for r in meta.values() for f in r.thresholds} <= set(T.__dataclass_fields__)
    left = rules.enabled_rules(rules.metadata(spark), spark.createDataFrame([("slow_syscall",)], "rule_id string"))
    assert left.count() == 22


def test_every_rule_fires_somewhere(found):
    assert {rule for r in found.values() for rule in r} == {c[0] for c in rules.CATALOG}


def test_poll_after_connect(found):
    f = found["dial"]["slow_network_connect"]
    assert (f.occurrence_count, f.first_seen_us, f.last_seen_us) == (1, 5, 5)


def test_downstream_peer(found):
    f = found["wait"]["slow_downstream_peer"]
    assert f.occurrence_count == 2 and "10.0.0.5:5432" in f.title and "slow_downstream_peer" not in found["short wait"]


def test_infinite_loop(found):
    rule = "infinite_loop_no_progress"
    assert found["stuck"][rule].severity == "critical"
    assert not any(rule in found[n] for n in ("busy", "brief", "no events"))


def test_spin_loop_needs_cpu(found):
    assert "spin_loop" in found["spin"] and "spin_loop" not in found["calm spin"] and "spin_loop" not in found["blind spin"]


def test_growth(found):
    rule = "monotonic_memory_growth"
    assert found["up"][rule].occurrence_count == 66 and rule in found["warm"]
    assert not any(rule in found[n] for n in ("few", "saw", "warm long"))
    f = found["fds"]["fd_count_growing"]
    assert (f.severity, f.occurrence_count) == ("critical", 30) and "fd_count_growing" not in found["few fds"]


def test_load_rules(found):
    assert "cpu_bound_metric" in found["hot"] and not any("cpu_bound_metric" in found[n] for n in ("hot short", "hot io", "rated"))
    assert "cpu_bound_no_syscalls" in found["rated"] and "cpu_bound_no_syscalls" not in found["chatty"]
    assert "io_wait_metric" in found["io"] and "io_wait_metric" not in found["less io"]


def test_container_rules(found):
    f = found["boxed"]
    assert f["cpu_throttled"].severity == "high" and f["rss_near_cgroup_limit"].occurrence_count == 90
    assert not any({"cpu_throttled", "rss_near_cgroup_limit"} & set(found[n]) for n in ("roomy", "unboxed"))


def test_memory_spike(found):
    assert found["spike"]["memory_spike"].occurrence_count == 1 and "memory_spike" not in found["step"]


def test_worst_group_is_first_seen_of_equals(found, data):
    f = found["ties"]["repeated_open_same_file"]
    assert f.title.startswith("/b ") and (f.first_seen_us, f.last_seen_us) == (0, 22)
    ties = data[0].where("run_id = 'ties'")
    e = rules.evidence(ties, rules.event_findings(ties, T), T)
    assert [r.seq for r in e.orderBy("rank").collect()] == list(range(0, 24, 2))


def test_severity_and_disabled(data):
    ev, m, r = data
    names = ["hot repeated_open_same_file", "hot failed_file_opens", "saw"]
    some = [x.where(F.col("run_id").isin(names)) for x in (ev, m, r)]
    f = rules.run_rules(*some, disabled=["failed_file_opens", "memory_spike"]).cache()
    assert rows(f, "run_id", "rule_id") == [(names[0], "repeated_open_same_file")]
    worst = {x.run_id: x.max_severity for x in rules.max_severity(f, some[2]).collect()}
    assert worst == {names[0]: "high", names[1]: "clean", names[2]: "clean"}


@pytest.mark.parametrize("width", [7, None])
def test_slow_leak(spark, width):
    def leak(step, n=100, every=3_000_000):
        return rules.slow_leak_findings(metrics(spark, [dict(rss_mb=100.0 + i * step) for i in range(n)], step_us=every),
                                        block(width * every, "ts_us") if width else None)
    assert one(leak(1.0)).rule_id == "slow_memory_leak"
    assert leak(0.3).count() == 0 and leak(1.0, n=19).count() == 0 and leak(1.0, every=1_000_000).count() == 0


def test_overrides(spark):
    t = Thresholds.with_overrides({"failed_open_min": 1, "unknown": 3, "slow_net_ms": None})
    assert t.failed_open_min == 1 and t.slow_net_ms == 1000.0
    table = by(rules.threshold_table(spark, spark.createDataFrame([("failed_open_min", 2.0)], "name string, value double")), "name")
    assert (table["failed_open_min"].value, table["failed_open_min"].default, table["slow_net_ms"].value) == (2.0, 5.0, 1000.0)
