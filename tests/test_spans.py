"""Requests: ownership, breakdown, endpoint tables, curation - small cases and a random one against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.functions.scalars import route_template, scrub_sql
from runlens.operators import spans

from .helpers import by, one, rows

MS = 1_000_000


def http(spark, items):
    """(tid, start_ms, dur_ms, route[, method, status])"""
    return spark.createDataFrame([("r", i, x[0], 9, x[1] * MS, x[2] * MS, x[4] if len(x) > 4 else "GET", x[3], x[5] if len(x) > 5 else 200)
                                  for i, x in enumerate(items)],
                                 "run_id string, span_id long, tid long, pid long, start_ns long, dur_ns long, method string, route string, status int")


def db(spark, items):
    return spark.createDataFrame([("r", i, x[0], 9, x[1] * MS, x[2] * MS, "q", "SELECT ?") for i, x in enumerate(items)],
                                 "run_id string, db_id long, tid long, pid long, start_ns long, dur_ns long, name string, statement string")


def iv(spark, items):
    return spark.createDataFrame([("r", k, t, s * MS, d * MS, r) for k, t, s, d, r in items],
                                 "run_id string, kind string, tid long, start_ns long, dur_ns long, reason string")


def owned(h, q):
    return spans.own_queries(h, q, ["db_id"])


def test_owner_rules(spark):
    h = http(spark, [(1, 100, 300, "/slow"), (7, 0, 1000, "/report"), (7, 100, 800, "/report")])
    q = db(spark, [(1, 150, 290), (2, 160, 5), (1, 900, 5), (7, 200, 700), (1, 400, 1)])
    assert sorted(rows(owned(h, q), "db_id", "owner_id")) == [(0, 0), (3, 2), (4, 0)]  # the end is inside too
    t = by(spans.with_db_time(h, owned(h, q)), "span_id")
    assert [t[i].db_ns // MS for i in range(3)] == [291, 0, 700]


def test_db_time_is_clamped(spark):
    h = http(spark, [(1, 0, 100, "/x")])
    t = spans.with_db_time(h, owned(h, db(spark, [(1, 10, 90), (1, 10, 90)])))
    assert one(t).db_ns == 100 * MS
    assert one(spans.endpoints(t)).db_ms_share == 1.0


def test_endpoint_table(spark):
    h = http(spark, [(1, 0, 300, "/slow"), (2, 0, 302, "/slow"), (3, 0, 5, "/users/123"), (4, 0, 8, "/checkout", "POST", 500), (5, 0, 0, None, None)])
    t = spans.with_db_time(h, owned(h, db(spark, [(1, 10, 297), (2, 10, 299)])))
    got = {(r.method, r.route): r for r in spans.endpoints(t).collect()}
    assert got["GET", "/slow"]["count"] == 2 and got["GET", "/slow"].db_ms_share > 0.95 and got["GET", "/slow"].p50_ms == 301.0
    assert got["POST", "/checkout"].err_pct == 100.0 and ("GET", "/users/{id}") in got and got["?", "/"].db_ms_share == 0.0
    f = by(spans.endpoint_findings(spans.endpoints(t)), "rule_id")
    assert set(f) == {"errored_endpoint:POST /checkout"}


def test_slow_endpoint_finding(spark):
    h = http(spark, [(1, 0, 700, "/report"), (2, 0, 2500, "/big")])
    f = by(spans.endpoint_findings(spans.endpoints(spans.with_db_time(h, owned(h, db(spark, [(1, 10, 690)]))))), "rule_id")
    assert (f["slow_endpoint:GET /report"].severity, f["slow_endpoint:GET /big"].severity) == ("medium", "high")
    assert "queries" in f["slow_endpoint:GET /report"].title and "queries" not in f["slow_endpoint:GET /big"].title


@pytest.mark.parametrize("tid,q,ivs,want,reasons", [
    (1, [(1, 50, 200)], [("off", 1, 50, 200, "net"), ("rq", 1, 260, 10, None)], (90, 10, 200, 0), {}),
    (1, [], [("off", 1, 20, 200, "sleep")], (100, 0, 0, 200), {"sleep": 200}),
    (1, [], [("off", 9, 10, 80, "sleep")], (300, 0, 0, 0), {}),
    (1, [(1, 0, 100)], [("off", 1, -50, 100, "odd"), ("off", 1, -50, 100, "odd")], (200, 0, 100, 0), {}),
])
def test_breakdown(spark, tid, q, ivs, want, reasons):
    h = http(spark, [(tid, 0, 300, "/db")])
    b = one(spans.breakdown(h, owned(h, db(spark, q) if q else db(spark, [(5, 0, 1)])), iv(spark, ivs)))
    assert tuple(x // MS for x in (b.on_cpu_ns, b.runq_ns, b.db_wait_ns, b.other_off_ns)) == want
    assert {k: v // MS for k, v in b.off_reasons.items()} == reasons


def _brute(hs, qs, ivs):
    """The definition, request by request."""
    def ov(a0, a1, b0, b1):
        return max(0, min(a1, b1) - max(a0, b0))

    own = {}
    for q in qs:
        c = [h for h in hs if h[1] == q[1] and h[2] <= q[2] <= h[2] + h[3]]
        if c:
            own.setdefault(max(c, key=lambda h: (h[2], h[0]))[0], []).append(q)
    out = {}
    for h in hs:
        off = rq = wait = 0
        reasons = {}
        for k, tid, s, d, why in ivs:
            if tid != h[1]:
                continue
            x = ov(s, s + d, h[2], h[2] + h[3])
            if k == "rq":
                rq += x
            elif x > 0:
                due = min(x, sum(ov(s, s + d, q[2], q[2] + q[3]) for q in own.get(h[0], [])))
                off, wait = off + x, wait + due
                reasons[why] = reasons.get(why, 0) + x - due
        off = min(off, h[3])
        rq = min(rq, max(0, h[3] - off))
        out[h[0]] = (max(0, h[3] - off - rq), rq, wait, max(0, off - wait), {k: v for k, v in reasons.items() if v > 0})
    return out


def test_breakdown_random(spark):
    rng = random.Random(11)
    hs = [(i, rng.randrange(3), rng.randrange(20_000), rng.randrange(1, 3000)) for i in range(60)]
    qs = [(i, rng.randrange(3), rng.randrange(20_000), rng.randrange(0, 900)) for i in range(150)]
    ivs = [(rng.choice(["off", "off", "rq"]), rng.randrange(3), rng.randrange(20_000), rng.randrange(0, 700), rng.choice(["net", "lock", "disk"])) for _ in range(200)]
    h = spark.createDataFrame([("r", i, t, s, d) for i, t, s, d in hs], "run_id string, span_id long, tid long, start_ns long, dur_ns long")
    q = spark.createDataFrame([("r", i, t, s, d) for i, t, s, d in qs], "run_id string, db_id long, tid long, start_ns long, dur_ns long")
    v = spark.createDataFrame([("r", k, t, s, d, w) for k, t, s, d, w in ivs], "run_id string, kind string, tid long, start_ns long, dur_ns long, reason string")
    got = {r.span_id: (r.on_cpu_ns, r.runq_ns, r.db_wait_ns, r.other_off_ns, r.off_reasons) for r in spans.breakdown(h, owned(h, q), v).collect()}
    assert got == _brute(hs, qs, ivs)


def test_endpoint_breakdown(spark):
    h = http(spark, [(1, 0, 300, "/db"), (2, 0, 300, "/db")])
    b = spans.breakdown(h, owned(h, db(spark, [(1, 50, 200), (2, 50, 200)])), iv(spark, [("off", 1, 40, 210, "net"), ("off", 2, 50, 200, "net")]))
    r = one(spans.endpoint_breakdown(b))
    assert r.db_wait_pct > 60 and r.top_off_reason == "net" and r.other_off_ms == 10.0


def test_curation(spark):
    h = http(spark, [(1, 100, 300, "/x"), (2, 100, 300, "/x"), (3, 100, 5, "/x"), (4, 100, 8, "/y", "POST", 500)])
    t = spans.with_db_time(h, owned(h, db(spark, [(9, 0, 1)])))
    kept = spans.curated(t, spans.endpoints(t))
    assert sorted(r.route for r in kept.collect()) == ["/x", "/x", "/y"]
    anchors = spark.createDataFrame([("r", 0.0, 1_700_000.0)], "run_id string, mono0 double, wall0 double")
    at = by(spans.epoch_time(kept, anchors), "span_id")
    assert at[0].timestamp_ms == pytest.approx(1_700_000_100.0)
    assert spans.curated(t, spans.endpoints(t), cap=1).count() == 1


def test_rollup_children(spark):
    h, q = http(spark, [(1, 0, 300, "/db")]), db(spark, [(1, 150, 30), (1, 30, 60)])
    r = one(spans.slowest_requests(h, owned(h, q), q, ["db_id"]))
    assert [(k.start_ns // MS, k.offset_pct, k.width_pct, k.statement) for k in r.queries] == [(30, 10.0, 20.0, "SELECT ?"), (150, 50.0, 10.0, "SELECT ?")]
    n = one(spans.request_counts(h, q, iv(spark, [("off", 1, 0, 1, "net")])))
    assert (n.request_count, n.db_span_count, n.has_breakdown) == (1, 2, True)


@pytest.mark.parametrize("raw,want", [
    ("/users/123/orders/9", "/users/{id}/orders/{id}"), ("/i/550e8400-e29b-41d4-a716-446655440000", "/i/{uuid}"),
    ("/blob/deadbeefcafef00d1234", "/blob/{hex}"), ("/api/health", "/api/health"), ("//users//123/", "/users/{id}"), ("/", "/"), (None, "/")])
def test_route_template(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(route_template("r")).first()[0] == want


@pytest.mark.parametrize("raw,want", [
    ("SELECT * FROM t WHERE name='bob' AND id = 12", "SELECT * FROM t WHERE name='?' AND id = ?"),
    ("SELECT pg_sleep(0.3), 42", "SELECT pg_sleep(?.?), ?"), ("UPDATE u SET k = 'cut off se", "UPDATE u SET k = '?'"), ("  a\t b ", "a b")])
def test_scrub(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(scrub_sql(F.col("r"))).first()[0] == want
