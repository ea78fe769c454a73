"""The driver contract, and a cross-section of the registered queries against their SQL. All of them: python -m tests.oracle <sf dir>."""

import pytest

import __spark_entry__ as entry
from runlens import queries as registry

from . import oracle

SF = "/root/testdata/sf0.01"  # from here on the order keys of all views are unique
SOME = ["syscall_stats", "io_stats", "endpoint_red", "request_breakdown", "malloc_profile", "split_log_ingest", "live_alerts", "block_io_ingest",
        "slow_memory_leaks", "incident_hot_context", "finding_union", "time_domain"]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = registry.QUERIES  # without the training-data queries, which may be absent
    assert set(own) <= set(q) and len(own) > 100 and len(set(own) - set(o)) <= 5
    assert not any(n.startswith("op") or "llm" in n or "pipeline" in n for n in own)


@pytest.mark.parametrize("name", SOME)
def test_agrees_with_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), name, SF, entry.queries(), entry.oracle_sql()) is None
