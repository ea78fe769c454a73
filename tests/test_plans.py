"""The physical patterns against brute force, with blocks and bins small enough to cross many borders."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.plans import intervals, quantile, scan
from runlens.plans.topk import top_k

from .helpers import block, metric, ran


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", i, rng.choice([None, None, rng.randrange(9)])) for i in range(600)]
    return spark.createDataFrame(rows, "k string, seq long, v long").cache()


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("shared", [False, True])
def test_ordered_scan_equals_plain_windows(walk, width, shared):
    w = Window.partitionBy("k").orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("v")
    got = scan.ordered_scan(walk, ["k"], ["seq"], block(width), shared=shared, p=scan.prev("seq", "v"), n=scan.following("seq"),
                            last=scan.last_known(v), incl=scan.last_known_incl(v), nxt=scan.next_known(v), total=scan.running(v),
                            top=scan.running_max(v), rest=scan.remaining(v))
    want = walk.select("*", F.lag(F.struct("seq", "v")).over(w).alias("p"), F.lead(F.struct("seq")).over(w).alias("n"),
                       F.last_value("v", True).over(before).alias("last"), F.last_value("v", True).over(upto).alias("incl"),
                       F.first_value("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nxt"),
                       F.sum("v").over(upto).alias("total"), F.max("v").over(upto).alias("top"),
                       F.sum("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_a_dense_unit_of_time_is_cut(spark):
    rng = random.Random(9)
    at = [rng.randrange(-20_000, 90_000) for _ in range(400)]                    # sparse coarse units
    at += [200_000 + rng.randrange(10_000) for _ in range(3_000)]                # a dense one, its middle units just full enough
    at += [400_000 + rng.randrange(100) for _ in range(2_000)] + [None, None]    # one dense middle unit
    df = spark.createDataFrame([("hot", i, t) for i, t in enumerate(at)] + [("cold", i, 200_000 + i) for i in range(50)], "k string, seq long, ts long")
    cut = scan.even_blocks(df, ["k"], "ts", "b", (10_000, 100, 1), most=60)
    got = cut.collect()
    assert sorted((r.k, r.seq) for r in got) == sorted((r.k, r.seq) for r in df.collect())
    assert all(r.b is None for r in got if r.ts is None)
    hot = sorted((r.ts, r.b) for r in got if r.k == "hot" and r.ts is not None)
    assert [b for _, b in hot] == sorted(b for _, b in hot)                       # blocks ascend with time
    sizes = {b: sum(1 for _, x in hot if x == b) for _, b in hot}
    dense = {b: n for b, n in sizes.items() if b >= 200_000}
    assert max(dense.values()) <= 60 and len({r.b for r in got if r.k == "cold"}) == 1
    w = Window.partitionBy("k").orderBy("ts", "seq")
    known = cut.where("ts IS NOT NULL")
    scanned = scan.ordered_scan(known, ["k"], ["ts", "seq"], F.col("b"), p=scan.prev("seq"), total=scan.running(F.col("seq")))
    want = known.select("*", F.lag(F.struct("seq")).over(w).alias("p"), F.sum("seq").over(w).alias("total"))
    assert sorted(map(repr, scanned.collect())) == sorted(map(repr, want.select(*scanned.columns).collect()))
    with pytest.raises(ValueError):
        scan.even_blocks(df, ["k"], "ts", "b", (1_000, 300, 1))


def test_row_index(walk):
    got = scan.row_index(walk, ["k"], ["seq"], block(13)).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.seq):
        assert r.idx == seen.get(r.k, 0)
        seen[r.k] = r.idx + 1


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    data = {"a": [rng.randrange(10 ** 9) for _ in range(997)], "b": [5], "c": [-3, 7, 7, 7, 1000000, -900], "d": [0] * 50 + [1]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v long")
    got = {r.k: r for r in quantile.interpolated(df, ["k"], "v", {"p50": .5, "p95": .95, "p99": .99, "p0": 0.0, "p100": 1.0}).collect()}
    for k, vs in data.items():
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99), ("p0", 0), ("p100", 100)):
            assert got[k][name] == pytest.approx(np.percentile(vs, p), rel=1e-12), (k, name)


def test_quantile_reference_values(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("k"), (F.col("id") * 1000).alias("v"))
    r = quantile.interpolated(df, ["k"], "v", {"p50": .5, "p95": .95, "p99": .99}).first()
    assert (r.p50 / 1000, r.p95 / 1000, r.p99 / 1000) == pytest.approx((50.5, 95.05, 99.01))


def _intervals(seed, n, span, longest):
    rng = random.Random(seed)
    return [("r", rng.randrange(3), i, rng.randrange(span), int(longest ** rng.random()) - (rng.random() < .1)) for i in range(n)]


def test_contain_join(spark):
    spans, points = _intervals(1, 80, 5000, 4000), _intervals(2, 300, 6000, 2)
    s = spark.createDataFrame(spans, "run string, tid long, sid long, s0 long, sd long")
    p = spark.createDataFrame(points, "run string, tid long, pid long, at long, x long").drop("x")
    got = sorted((r.pid, r.sid) for r in intervals.contain_join(p, "at", s, "s0", "sd", ["run", "tid"], base_bits=2).collect())
    want = sorted((b[2], a[2]) for a in spans for b in points if a[1] == b[1] and a[3] <= b[3] <= a[3] + a[4])
    assert got == want and len(got) > 100


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_latest_open(spark, bits):
    rng = random.Random(bits)
    spans, points = _intervals(5, 200, 5000, 4000), _intervals(6, 400, 6000, 2)
    spans += [("r", rng.randrange(3), 1000 + i, -600 + 8 * i, rng.choice([0, 7, 8, 15, 64, 511, 512, 600])) for i in range(60)]
    spans += [("r", 0, 2000 + i, 3000, 512 * i) for i in range(5)]               # equal starts: the greater id wins
    points += [("r", rng.randrange(3), 1000 + i, x, 0) for i, x in enumerate([-601, -600, -1, 0, 7, 8, 63, 64, 3000, 3512, 10**18])]
    s = spark.createDataFrame(spans, "run string, tid long, sid long, s0 long, sd long")
    p = spark.createDataFrame(points, "run string, tid long, pid long, at long, x long").drop("x")
    found = intervals.latest_open(p, "at", s, "s0", "sd", ["run", "tid"], ["s0", "sid"], base_bits=bits)
    got = {r.pid: (r.o.s0, r.o.sid) for r in found.groupBy("pid").agg(F.max("o").alias("o")).collect()}
    want = {}
    for _, tid, pid, at, _ in points:
        open_then = [(x[3], x[2]) for x in spans if x[1] == tid and x[3] <= at <= x[3] + x[4]]
        if open_then:
            want[pid] = max(open_then)
    assert got == want and 200 < len(got) < len(points)
    assert intervals.latest_open(p, "at", s.limit(0), "s0", "sd", ["run", "tid"], ["s0", "sid"]).count() == 0


@pytest.mark.parametrize("bits", [6, 9, 40])
def test_latest_open_gives_a_point_one_row(spark, bits):
    """One row for each different point that has an owner, whatever batches a block is read in; rows without key or time have none."""
    rng = random.Random(bits)
    s = [(rng.choice("rq"), rng.randrange(2), i, rng.randrange(3000), rng.choice([0, 3, 40, 700, 5000, -5])) for i in range(300)]
    s += [("r", 0, 900, None, 10), ("r", 0, 901, 10, None), (None, 0, 902, 0, 9000), ("r", None, 903, 0, 9000)]
    p = [(rng.choice("rq"), rng.randrange(2), rng.choice([None, i]), rng.randrange(-50, 4000)) for i in range(500)]
    p += p[:80] + [("r", 0, 700, None), (None, 0, 701, 50), ("r", None, 702, 50)]
    spans = spark.createDataFrame(s, "run string, tid long, sid long, s0 long, sd long")
    points = spark.createDataFrame(p, "run string, tid long, pid long, at long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = intervals.latest_open(points, "at", spans, "s0", "sd", ["run", "tid"], ["s0", "sid", "sd"], base_bits=bits)
        got = [(r.run, r.tid, r.pid, r.at, tuple(r.o)) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for run, tid, pid, at in set(p):
        if None not in (run, tid, at):
            o = [(x[3], x[2], x[4]) for x in s if x[:2] == (run, tid) and None not in x and x[3] <= at <= x[3] + x[4]]
            want += [(run, tid, pid, at, max(o, default=None))] * bool(o)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 200


def test_latest_open_shuffles_a_point_once(spark):
    """Rows that the owner search writes to shuffles: the points and the ends of spans, not a row for each level or candidate."""
    n = 20_000
    s = spark.range(n).select(F.lit("r").alias("run"), (F.col("id") % 10).alias("tid"), F.col("id").alias("sid"), (F.col("id") * 10_000_000).alias("s0"),
                              (F.col("id") * 7919 % 500_000 * 1000).alias("sd"))
    p = spark.range(4 * n).select(F.lit("r").alias("run"), F.expr("id div 4 % 10").alias("tid"), F.col("id").alias("pid"),
                                  F.expr("id div 4 * 10000000 + id % 4 * 1000000").alias("at"))
    found = intervals.latest_open(p, "at", s, "s0", "sd", ["run", "tid"], ["s0", "sid"])
    wrote = sum(metric(ran(found), "Exchange", "shuffleRecordsWritten"))
    assert 4 * n < wrote < 5.5 * n, wrote


def test_nested_spans_make_few_rows_a_point(spark):
    """2,000 requests open at once on one thread: a point meets a row a level and those that begin or end in its cell."""
    n, step = 2_000, 1 << intervals.CELL_BITS
    s = spark.range(n).select(F.lit("r").alias("run"), F.lit(1).alias("tid"), F.col("id").alias("sid"), (F.col("id") * step).alias("s0"),
                              (3 * n * step - F.col("id") * 2 * step).alias("sd"))
    p = spark.range(n).select(F.lit("r").alias("run"), F.lit(1).alias("tid"), F.col("id").alias("pid"), (F.col("id") * step + 7).alias("at"))
    found = intervals.latest_open(p, "at", s, "s0", "sd", ["run", "tid"], ["s0", "sid"])
    assert found.count() < 8 * n
    assert found.groupBy("pid").agg(F.max("o.sid").alias("o")).where("o <> pid").count() == 0


def test_overlap_join_and_coverage(spark):
    left, right = _intervals(3, 90, 5000, 3000), _intervals(4, 200, 5000, 900)
    a = spark.createDataFrame(left, "run string, tid long, aid long, a0 long, ad long")
    b = spark.createDataFrame(right, "run string, tid long, bid long, b0 long, bd long")
    got = sorted((r.aid, r.bid) for r in intervals.overlap_join(a, "a0", "ad", b, "b0", "bd", ["run", "tid"], base_bits=3).collect())

    def shared(x, y):
        return max(0, min(x[3] + x[4], y[3] + y[4]) - max(x[3], y[3])) if x[1] == y[1] else 0

    assert got == sorted((x[2], y[2]) for x in left for y in right if shared(x, y) > 0) and len(got) > 200
    cov = intervals.coverage(a, "aid", "a0", "ad", b, "b0", "bd", ["run", "tid"],
                             {"even": F.col("bid") % 2 == 0, "all": F.lit(True)}, block_ns=100)
    sums = {r.aid: (r.even, r["all"]) for r in cov.collect()}
    for x in left:
        parts = [(shared(x, y), y[2]) for y in right]
        assert sums[x[2]] == (sum(v for v, i in parts if i % 2 == 0), sum(v for v, _ in parts))


@pytest.mark.parametrize("width", [7, 100, 10**9])
def test_coverage_over_blocks(spark, width):
    """Intervals that stay open over many blocks, blocks with marks only, times below zero, equal intervals, rows without times."""
    rng = random.Random(width)
    spans = [("r", rng.randrange(2), i, rng.randrange(-400, 900), rng.choice([0, 1, 30, 400])) for i in range(150)]
    inter = [("r", rng.randrange(2), i % 40, rng.randrange(-500, 800), rng.choice([0, 1, 9, 60, 900])) for i in range(80)]
    inter += inter[:9] + [("r", 0, 1, None, 50), ("r", 0, 1, 50, None), (None, 0, 1, 0, 50), ("r", None, 1, 0, 50)]
    a = spark.createDataFrame(spans + [(None, 0, 900, 5, 5), ("r", 0, None, 5, 5), ("r", 0, 901, None, 5)], "run string, tid long, aid long, a0 long, ad long")
    b = spark.createDataFrame(inter, "run string, tid long, bid long, b0 long, bd long")
    cov = intervals.coverage(a, "aid", "a0", "ad", b, "b0", "bd", ["run", "tid"], {"even": F.col("bid") % 2 == 0, "none": F.lit(None).cast("boolean"), "all": F.lit(True)}, width)
    got = {r.aid: (r.even, r["none"], r["all"]) for r in cov.collect()}

    def total(x, even):
        return sum(max(0, min(x[3] + x[4], y[3] + y[4]) - max(x[3], y[3])) for y in inter if None not in y and y[1] == x[1] and not (even and y[2] % 2))

    assert {x[2]: got[x[2]] for x in spans} == {x[2]: (total(x, True), 0, total(x, False)) for x in spans}


def test_coverage_and_overlap_shuffle_rows_once(spark):
    """Intervals go to a shuffle once, not as steps, scanned steps and areas; queries once, not once for each kind of pair."""
    n = 20_000
    a = spark.range(n).selectExpr("concat('r', id % 2) AS run", "id % 10 AS tid", "id AS aid", "id * 10000000 AS a0", "id * 7919 % 500000 * 1000 AS ad")
    b = spark.range(4 * n).selectExpr("concat('r', id div 4 % 2) AS run", "id div 4 % 10 AS tid", "id AS bid", "id div 4 * 10000000 + id % 4 * 1000000 AS b0", "(1 + id % 9) * 1000000 AS bd")
    cov = intervals.coverage(a, "aid", "a0", "ad", b, "b0", "bd", ["run", "tid"], {"even": F.col("bid") % 2 == 0})
    assert sum(metric(ran(cov), "Exchange", "shuffleRecordsWritten")) < 8 * n
    left = b.selectExpr("run", "tid", "bid AS cid", "b0 + 5 AS c0", "bd AS cd")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = intervals.overlap_join(left, "c0", "cd", b, "b0", "bd", ["run", "tid"], copies="n")
        assert sum(metric(ran(met), "Exchange", "shuffleRecordsWritten")) < 9 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_overlap_of_copies(spark, bits):
    left, right = _intervals(bits, 90, 5000, 3000), _intervals(7, 120, 5000, 900)
    right += right[:30] + right[:10]
    a = spark.createDataFrame(left, "run string, tid long, aid long, a0 long, ad long")
    b = spark.createDataFrame(right, "run string, tid long, bid long, b0 long, bd long")
    got = sorted((r.aid, r.bid, r.n) for r in intervals.overlap_join(a, "a0", "ad", b, "b0", "bd", ["run", "tid"], base_bits=bits, copies="n").collect())
    want = sorted((x[2], y[2], right.count(y)) for x in left for y in set(right) if x[1] == y[1] and min(x[3] + x[4], y[3] + y[4]) > max(x[3], y[3]))
    assert got == want and len(got) > 200


def test_overlap_candidates_grow_with_rows(spark):
    """One long interval on another thread changes neither the result nor how many pairs are looked at."""
    def candidates(n, long):
        a = spark.createDataFrame([("r", 1, i, i * 10, 4) for i in range(n)] + [("r", 2, n, 0, 1 << 20)] * long, "run string, tid long, aid long, a0 long, ad long")
        b = spark.createDataFrame([("r", 1, i, i * 10 + 2, 4) for i in range(n)], "run string, tid long, bid long, b0 long, bd long")
        out = intervals.overlap_join(a, "a0", "ad", b, "b0", "bd", ["run", "tid"], base_bits=3)
        t = time.perf_counter()
        return out.count(), time.perf_counter() - t

    candidates(1000, 1)
    short, s = candidates(20_000, 1)
    double, d = candidates(40_000, 1)
    assert (short, double) == (20_000, 40_000) == (candidates(20_000, 0)[0], candidates(40_000, 0)[0])
    assert d < 6 * max(s, 1.0)


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k(spark, k):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = top_k(df, ["g"], [F.desc("v")], k, rank="rank", salt_on=["v"])
    for g in (0, 1):
        want = sorted([v for v in range(5000) if v % 2 == g], reverse=True)[:k]
        assert [r.v for r in got.where(F.col("g") == g).orderBy("rank").collect()] == want


def test_no_sort_of_a_whole_key(spark):
    """A window over the whole key only ever sees block summaries."""
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    plan = scan.ordered_scan(df, ["k"], ["seq"], block(10), n=scan.running(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and sum("__block" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows) == 2
