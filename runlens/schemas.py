"""Explicit schemas of the model tables. Times are integers: microseconds since the epoch, or monotonic nanoseconds."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


TRACE_EVENTS = _struct(run_id=_S, seq=_L, ts_us=_L, pid=_L, event_type=_S, source=_S, syscall=_S, args=_S, retval=_S,
                       error=_S, lat_us=_L, fd=_I, path=_S)
METRICS = _struct(run_id=_S, ts_us=_L, cpu_pct=_D, rss_mb=_D, vms_mb=_D, open_fds=_I, threads=_I, syscall_rate=_D,
                  io_read_bps=_D, io_write_bps=_D)
HTTP_SPANS = _struct(run_id=_S, span_id=_L, tid=_L, pid=_L, start_ns=_L, dur_ns=_L, method=_S, route=_S, status=_I)
DB_SPANS = _struct(run_id=_S, db_id=_L, tid=_L, pid=_L, start_ns=_L, dur_ns=_L, name=_S, statement=_S)
THREAD_INTERVALS = _struct(run_id=_S, kind=_S, tid=_L, start_ns=_L, dur_ns=_L, reason=_S)
STACKS = T.StructType([T.StructField("run_id", _S), T.StructField("frames", T.ArrayType(_S)),
                       T.StructField("weight", _L)])
HIST_BUCKETS = _struct(run_id=_S, hist=_S, unit=_S, lo=_L, hi=_L, count=_L)
FINDINGS = _struct(run_id=_S, rule_id=_S, severity=_S, severity_score=_D, title=_S, description=_S, first_seen_us=_L,
                   last_seen_us=_L, occurrence_count=_L)
RUNS = _struct(run_id=_S, session_id=_S, command=_S, started_us=_L, ended_us=_L, duration_ms=_L, status=_S,
               exit_code=_I, exit_signal=_S, attach=_B, monitor=_B, cgroup_cpu_quota_cores=_D,
               cgroup_mem_limit_bytes=_L)
PROCESS_SAMPLES = _struct(run_id=_S, ts_us=_L, pid=_L, cpu_pct=_D, rss_bytes=_L, vms_bytes=_L, threads=_I, fds=_I,
                          read_bytes=_L, write_bytes=_L)
INCIDENTS = _struct(incident_id=_S, run_id=_S, rule_id=_S, severity=_S, title=_S, ts_us=_L, first_us=_L, last_us=_L,
                    count=_L)
CUSTOM_RULES = _struct(id=_S, name=_S, description=_S, signal=_S, expression=_S, severity=_S, enabled=_B, min_count=_L,
                       duration_ms=_L, created_at=_L)
