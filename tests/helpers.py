"""Small tables of the model types."""

from pyspark.sql import functions as F

from runlens.schemas import METRICS, TRACE_EVENTS


def events(spark, rows, run="r"):
    """Rows are dicts; order is list order, one microsecond apart unless ts_us is given."""
    base = dict(run_id=run, pid=1, event_type="syscall", source="strace", syscall=None, args="", retval=None, error=None,
                lat_us=None, fd=None, path=None)
    full = [{**base, "seq": i, "ts_us": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in TRACE_EVENTS) for r in full], TRACE_EVENTS)


def metrics(spark, rows, run="r", step_us=250_000):
    base = {f.name: None for f in METRICS}
    full = [{**base, "run_id": run, "ts_us": i * step_us, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in METRICS) for r in full], METRICS)


def runs(spark, duration_ms=1000, quota=None, limit=None, run="r"):
    return spark.createDataFrame([(run, duration_ms, quota, limit)], "run_id string, duration_ms long, "
                                 "cgroup_cpu_quota_cores double, cgroup_mem_limit_bytes long")


def lines(spark, text, run="r"):
    rows = text if isinstance(text, list) else text.splitlines()
    return spark.createDataFrame([(run, i, x) for i, x in enumerate(rows)], "run_id string, seq long, line string")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def one(df):
    got = df.collect()
    assert len(got) == 1, got
    return got[0]


def by(df, key):
    return {r[key]: r for r in df.collect()}


def block(n, col="seq"):
    """Blocks of n order values, so that small inputs cross many block borders."""
    return F.floor(F.col(col) / n).cast("long")


def ran(df):
    """Collects `df`; the nodes of the plan that ran, each once, with their metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = {}, [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        todo += [node.plan()] if "QueryStage" in node.nodeName() else [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else []
        found[node.id()] = node
    return list(found.values())


def metric(nodes, kind, name):
    """Values of a metric of the nodes whose name has `kind` in it; copies of a node share theirs, which counts once."""
    found = [x.metrics().apply(name) for x in nodes if kind in x.nodeName() and x.metrics().contains(name)]
    return list({m.id(): m.value() for m in found}.values())
