"""User expressions: accepted, refused, and evaluated exactly as Python would on each row."""

import itertools

import pytest
from pyspark.sql import functions as F

from runlens.functions.expressions import EVENT_FIELDS, ExpressionError, compile_rule, describe, event_vars
from runlens.operators import custom

from .helpers import block, by, events, metrics

GOOD = [
    "latency_ms > 100", "syscall == 'read' and latency_ms >= 1.5", "syscall in ('read', 'write')", "syscall not in ['read']", "'tmp' in path",
    "not error", "error and retval_int < 0", "fd == None", "fd != None", "retval_int // 3 == 2", "retval_int % 4 == 3", "-retval_int % 4 == 1",
    "latency_ms / fd > 10", "pid + fd * 2 - 1 > 5", "1 < fd < 5", "latency_ms", "path", "fd in (3, None)", "syscall == 3", "syscall != 3", "latency_ms < 'x'",
    "(latency_ms > 50) or (fd > 'x')", "fd > 2 or latency_ms / 0 > 1", "True", "retval_int == fd", "not (fd > 3)", "error in ''", "args + path == ''",
    "(fd, pid) == (3, 1)", "+fd >= 3", "fd > 2 and syscall", "event_type == 'syscall' and not path", "0 == False", "retval == '5'", "[]", "(1,)", "timestamp_ms >= 0.002",
    "fd in ()", "1 in 'abc'", "not latency_ms",
]
BAD = ["open('x')", "path.upper()", "x > 1", "lambda: 1", "[i for i in ()]", "latency_ms >", "a := 1", "f'{path}'", "path[0]", "__import__('os')", "latency_ms ** 2",
       "1 if fd else 0", "{1: 2}", "fd is None", "~fd", "x" * 501, "b'1' == path"]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [dict(syscall=s, lat_us=lat, fd=fd, error=err, retval=ret, path=p) for s, lat, fd, err, ret, p in itertools.product(
        ["read", None], [None, 0, 120_000], [None, 0, 3], [None, "EIO"], [None, "5", "-1", "0x7"], [None, "/tmp/a"])]
    return events(spark, rows).cache()


def _value(r, f):
    text = dict(event_type=r.event_type, syscall=r.syscall, args=r.args, retval=r.retval, error=r.error, path=r.path)
    if f in text:
        return text[f] or ""
    if f == "retval_int":
        return None if r.retval is None else int(r.retval, 0)
    if f == "latency_ms":
        return None if r.lat_us is None else r.lat_us / 1000.0
    return r.ts_us / 1000.0 if f == "timestamp_ms" else r[f]


def test_same_rows_as_python(sample):
    base = sample.collect()
    got = sample.select("seq", *event_vars()).select("seq", *[compile_rule(e, "events").alias(f"g{i}") for i, e in enumerate(GOOD)]).collect()
    got = {r.seq: r for r in got}
    for i, text in enumerate(GOOD):
        code = compile(text, "rule", "eval")
        for r in base:
            try:
                want = bool(eval(code, {"__builtins__": {}}, {f: _value(r, f) for f in EVENT_FIELDS}))
            except (TypeError, ZeroDivisionError):
                want = False
            assert got[r.seq][f"g{i}"] is want, (text, r)


@pytest.mark.parametrize("text", BAD, ids=range(len(BAD)))
def test_refused(text):
    with pytest.raises(ExpressionError):
        compile_rule(text, "events")
    d = describe(text, "events")
    assert not d["ok"] and d["error"] and d["fields"] == sorted(EVENT_FIELDS)


def test_fields_differ_by_signal():
    assert describe("cpu_pct > 1", "metrics")["ok"] and not describe("cpu_pct > 1", "events")["ok"]


def rule(**kw):
    return {**dict(id="1", name="mine", description="", signal="events", severity="high", enabled=True, min_count=3, duration_ms=1000, created_at=1), **kw}


def found(spark, rules, ev=(), m=(), width=None):
    return by(custom.custom_findings(spark, events(spark, list(ev)), metrics(spark, list(m)), rules,
                                     block(width, "ts_us") if width else None), "rule_id")


def test_event_rule_counts(spark):
    ev = [dict(syscall="read", lat_us=200_000)] * 3 + [dict(syscall="read", lat_us=None)] + [dict(syscall="read", lat_us=900_000, event_type="libcall")]
    r = rule(expression="latency_ms > 100")
    f = found(spark, [r], ev)["custom:1"]
    assert (f.occurrence_count, f.title, f.severity, f.first_seen_us, f.last_seen_us) == (3, "mine (3x)", "high", 0, 2)
    assert not found(spark, [r], ev[1:]) and not found(spark, [{**r, "enabled": False}], ev) and not found(spark, [rule(expression="zzz")], ev)
    assert [x.seq for x in custom.custom_evidence(events(spark, ev), [r], 2).orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("width", [250_000, None])
def test_metric_rule_needs_a_streak(spark, width):
    hot, cold, none = dict(cpu_pct=95.0), dict(cpu_pct=5.0), dict()
    r = rule(signal="metrics", expression="cpu_pct > 90")
    f = found(spark, [r], m=[cold] + [hot] * 5 + [cold] + [hot] * 5 + [none], width=width)["custom:1"]
    assert (f.first_seen_us, f.last_seen_us, f.occurrence_count) == (7 * 250_000, 11 * 250_000, 1)  # the later of equals
    assert not found(spark, [r], m=[hot] * 4 + [none] + [hot] * 4, width=width)
    assert found(spark, [{**r, "duration_ms": 750}], m=[hot] * 4 + [none] + [hot] * 4, width=width)


def test_rule_table(spark):
    t = spark.createDataFrame([("b", True, 2), ("a", True, 1), ("c", False, 0)], "id string, enabled boolean, created_at long")
    assert [r["id"] for r in custom.load_rules(t)] == ["a", "b"]
    assert custom.custom_findings(spark, events(spark, []), metrics(spark, []), []).count() == 0


def test_rules_run_in_one_pass(spark):
    ev = events(spark, [dict(syscall="read", lat_us=1)])
    rules = [rule(id=str(i), expression=f"latency_ms > {i}") for i in range(5)]
    plan = custom.event_matches(ev, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and F.lit(1) is not None
