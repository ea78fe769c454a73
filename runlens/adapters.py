"""The driver's tables seen as model tables. One SQL text per view, used by Spark and, in the oracles, by DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACE_EVENTS = """
WITH e AS (SELECT event_id AS seq, {us} AS ts_us, user_id AS pid, 'run-' || CAST(user_id % 5 AS STRING) AS run_id,
 event_type AS et, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(round(value * 1000) AS BIGINT) AS lat_us FROM events),
t AS (SELECT *, CASE WHEN et = 'signup' THEN 'openat' WHEN et = 'view' THEN 'read' WHEN et = 'click' THEN 'write'
 WHEN et = 'error' AND k % 4 < 2 THEN 'openat' WHEN et = 'error' AND k % 4 = 2 THEN 'connect' WHEN et = 'error' THEN 'read'
 WHEN k % 4 = 0 THEN 'close' WHEN k % 4 = 1 THEN 'poll' WHEN k % 4 = 2 THEN 'clone' ELSE 'futex' END AS syscall FROM e)
SELECT run_id, seq, ts_us, pid, 'syscall' AS event_type, syscall, k,
 CASE WHEN syscall = 'connect' THEN '3, {sa_family=AF_INET, sin_port=htons(' || CAST(1000 + k AS STRING) || '), sin_addr=inet_addr("10.0.0.' || CAST(k % 7 AS STRING) || '")}, 16' ELSE '' END AS args,
 CASE WHEN et = 'signup' THEN CAST(3 + k % 3 AS STRING) WHEN et = 'error' THEN '-1' WHEN syscall IN ('read', 'write') THEN CAST(k * 40 AS STRING)
 WHEN syscall = 'poll' THEN CAST(k % 8 - 1 AS STRING) WHEN syscall = 'clone' THEN CAST((pid + 5) % 150 AS STRING) ELSE '0' END AS retval,
 CASE WHEN et <> 'error' THEN NULL WHEN k % 4 = 0 THEN 'ENOENT' WHEN k % 4 = 1 THEN 'EACCES' WHEN k % 8 = 2 THEN 'EINPROGRESS' WHEN k % 8 = 6 THEN 'ECONNREFUSED' ELSE 'EAGAIN' END AS error,
 lat_us, CASE WHEN syscall IN ('read', 'write', 'close') THEN 3 + k % 3 END AS fd,
 CASE WHEN syscall = 'openat' THEN '/data/f' || CAST(k % 10 AS STRING) END AS path FROM t"""

METRICS = """
SELECT 'run-' || CAST(user_id % 5 AS STRING) AS run_id, {us} AS ts_us, value AS cpu_pct,
 CAST(100 + event_id / 20.0 AS DOUBLE) AS rss_mb, 10 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS open_fds,
 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 AS threads, CASE WHEN event_type = 'view' THEN value * 10000 END AS io_read_bps FROM events"""

HTTP_SPANS = """
SELECT 'run-' || CAST(o_orderkey % 5 AS STRING) AS run_id, o_orderkey AS span_id, o_orderkey % 10 AS tid, o_orderkey * 10000000 AS start_ns,
 CAST(floor(o_totalprice) AS BIGINT) * 1000 AS dur_ns, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'POST' ELSE 'GET' END AS method,
 '/orders/' || CAST(o_custkey AS STRING) || '/' || lower(o_orderstatus) AS route, CASE WHEN o_orderstatus = 'P' THEN 500 ELSE 200 END AS status FROM orders"""

DB_SPANS = """
SELECT 'run-' || CAST(l_orderkey % 5 AS STRING) AS run_id, l_orderkey % 10 AS tid, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS start_ns,
 CAST(l_quantity AS BIGINT) * 100000 AS dur_ns, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"""

THREAD_INTERVALS = """
SELECT 'run-' || CAST(l_orderkey % 5 AS STRING) AS run_id, CASE WHEN l_returnflag = 'N' THEN 'rq' ELSE 'off' END AS kind, l_orderkey % 10 AS tid,
 l_orderkey * 10000000 + l_suppkey * 10000 AS start_ns, CAST(round(l_discount * 100) AS BIGINT) * 1000000 AS dur_ns,
 CASE l_linenumber % 5 WHEN 0 THEN 'net' WHEN 1 THEN 'lock' WHEN 2 THEN 'sleep' WHEN 3 THEN 'disk' ELSE 'other' END AS reason FROM lineitem"""

# The order is lexicographic in four columns. Spark keeps them as order columns; a running number over the whole table
# (as the oracle has it) would put all rows into one task.
LIB_CALLS = """
SELECT 'run-' || CAST(l_suppkey % 5 AS STRING) AS run_id, l_orderkey * 8 + l_linenumber AS seq, l_partkey AS seq2, l_suppkey AS seq3,
 'libcall' AS event_type, CASE l_returnflag WHEN 'A' THEN 'malloc' WHEN 'N' THEN 'free' ELSE 'realloc' END AS fn,
 l_partkey % 200 + 1 AS ptr, CAST(l_quantity AS BIGINT) * 64 AS size, CAST(round(l_extendedprice) AS BIGINT) AS lat_us FROM lineitem"""

STACKS = """
SELECT 'run-' || CAST(p_partkey % 5 AS STRING) AS run_id, p_brand || ';' || p_type || ';sz' || CAST(p_size % 5 AS STRING) AS folded, CAST(p_size AS BIGINT) AS weight FROM part"""

ROUTES = """
SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS route FROM pages"""

STATEMENTS = """
SELECT c_custkey, 'SELECT *  FROM t WHERE name = ''' || c_name || ''' AND id = ' || CAST(c_custkey AS STRING) AS sql FROM customer"""

LOG_LINES = """
SELECT run_id, seq, CAST(pid AS STRING) || ' ' || CAST(CAST(floor(ts_us / 1000000) AS BIGINT) AS STRING) || '.' || lpad(CAST(ts_us % 1000000 AS STRING), 6, '0') || ' '
 || syscall || '(' || CASE WHEN fd IS NOT NULL THEN CAST(fd AS STRING) || ', ""' WHEN path IS NOT NULL THEN 'AT_FDCWD, "' || path || '"' ELSE args END || ') = ' || retval
 || CASE WHEN error IS NOT NULL THEN ' ' || error || ' (x)' ELSE '' END || ' <' || CAST(CAST(floor(lat_us / 1000000) AS BIGINT) AS STRING) || '.' || lpad(CAST(lat_us % 1000000 AS STRING), 6, '0') || '>' AS line FROM trace_events"""

VIEWS = {"trace_events": TRACE_EVENTS, "metrics": METRICS, "http_spans": HTTP_SPANS, "db_spans": DB_SPANS,
         "thread_intervals": THREAD_INTERVALS, "lib_calls": LIB_CALLS, "stacks": STACKS, "routes": ROUTES,
         "statements": STATEMENTS, "log_lines": LOG_LINES}
_SOURCE = {"trace_events": "events", "metrics": "events", "http_spans": "orders", "db_spans": "lineitem",
           "thread_intervals": "lineitem", "lib_calls": "lineitem", "stacks": "part", "routes": "pages",
           "statements": "customer", "log_lines": "trace_events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model view over the parquet tables of one scale-factor folder."""
    source = _SOURCE[name]
    if source in VIEWS:
        table = view(spark, sf_dir, source)
    else:
        table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    table.createOrReplaceTempView(source)
    return spark.sql(VIEWS[name].replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))"))


def duck(name: str) -> str:
    """The same view as a DuckDB common table expression body."""
    return VIEWS[name].replace("{us}", "epoch_us(ts)").strip()


def with_views(*names: str, sql: str) -> str:
    """`WITH <views> SELECT ...` for DuckDB; `sql` may start with further CTEs after a comma."""
    ctes = ", ".join(f"{n} AS ({duck(n)})" for n in names)
    return f"WITH {ctes}{sql}" if sql.lstrip().startswith(",") else f"WITH {ctes} {sql}"
