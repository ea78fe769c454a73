"""Allocation ledger (E17) and its findings.

Pointers are global to a run. A call becomes one or two steps: a release of the old block, then the new block. Which block
a step meets is a look-back per pointer; live bytes over the run are a running sum of signed steps. Both are ordered scans,
so neither a hot pointer nor a huge run is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import alloc_size, arg, pointer
from ..plans.scan import ordered_scan, prev, running, seq_block
from ..plans.topk import top_k

c = F.col
TOP_SIZES, TOP_BLOCKS = 8, 10

# When an allocation pattern is a finding.
LEAK_BYTES, LEAK_BLOCKS, IMBALANCE, IMBALANCE_MIN = 256 * 1024, 64, 4.0, 200
STORM_CALLS, STORM_RATE, STORM_RATE_MIN, UNMATCHED_MIN = 20_000, 10_000.0, 2000, 16


def allocator_calls(events: DataFrame) -> DataFrame:
    """trace_events -> (run_id, seq, fn, is_free, old, ptr, size): `old` is released, `ptr`/`size` is the new block."""
    fn = c("syscall")
    first = pointer(arg("args", 0))
    rows = events.where((c("event_type") == "libcall") & fn.isin(names.ALLOC_FUNCS + names.FREE_FUNCS))
    return rows.select("run_id", "seq", fn.alias("fn"), fn.isin(names.FREE_FUNCS).alias("is_free"),
                       F.when(fn.isin(names.FREE_FUNCS + ["realloc"]), first).alias("old"),
                       F.when(~fn.isin(names.FREE_FUNCS), pointer(c("retval"))).alias("ptr"),
                       F.when(~fn.isin(names.FREE_FUNCS), alloc_size(fn, c("args"))).alias("size"))


def _steps(calls: DataFrame, order: list[str], block: Column) -> DataFrame:
    """One row per release or new block, with the block the pointer held before it."""
    released = F.when(c("old") != 0, F.struct(F.lit(0).alias("sub"), c("old").alias("ptr"), F.lit(None).cast("long").alias("size")))
    made = F.when((c("ptr") != 0) & c("size").isNotNull(), F.struct(F.lit(1).alias("sub"), "ptr", c("size").cast("long").alias("size")))
    s = calls.select("run_id", *order, "is_free", F.explode(F.array_compact(F.array(released, made))).alias("s")).select(
        "run_id", *order, "s.sub", "s.ptr", "s.size", "is_free")
    seen = ordered_scan(s, ["run_id", "ptr"], [*order, "sub"], block, before=prev("sub", "size"))
    held = F.when(c("before.sub") == 1, c("before.size"))
    return seen.select("run_id", "ptr", *order, "sub", "size", "is_free", held.alias("held"))


def ledger(calls: DataFrame, order: list[str] = ["seq"], block: Column | None = None) -> DataFrame:
    """Per run: calls, bytes, peak, what is still live at the end, and releases that matched nothing."""
    block = block if block is not None else seq_block(order[0])
    n = calls.groupBy("run_id").agg(F.count_if(~c("is_free")).alias("n_alloc"),
                                    F.count_if(c("is_free") & (c("old") != 0)).alias("n_free"))
    steps = _steps(calls, order, block)
    zero = F.lit(0).cast("long")
    made = c("sub") == 1
    # Overwriting a live pointer does not give its bytes back, so only a release that meets a block is a negative step.
    delta = F.when(made, c("size")).otherwise(F.coalesce(-c("held"), zero))
    flow = steps.select("run_id", *order, "sub", "size", "held", "is_free", delta.alias("delta"))
    level = ordered_scan(flow, ["run_id"], [*order, "sub"], block, shared=True, live=running(c("delta")))
    totals = level.groupBy("run_id").agg(
        F.sum(F.when(made, c("size")).otherwise(zero)).alias("bytes_allocated"),
        F.sum(F.when(~made, F.coalesce("held", zero)).otherwise(zero)).alias("bytes_freed"),
        F.greatest(zero, F.max(F.when(made, c("live")))).alias("peak_live_bytes"),
        F.count_if(c("is_free") & ~made & c("held").isNull()).alias("free_unmatched"))
    live = live_blocks(calls, order).groupBy("run_id").agg(
        F.sum("size").alias("outstanding_bytes"), F.count("*").alias("outstanding_blocks"))
    out = n.join(totals, "run_id", "left").join(live, "run_id", "left")
    return out.select("run_id", "n_alloc", "n_free", *[F.coalesce(k, zero).alias(k) for k in (
        "bytes_allocated", "bytes_freed", "peak_live_bytes", "outstanding_bytes", "outstanding_blocks", "free_unmatched")])


def live_blocks(calls: DataFrame, order: list[str] = ["seq"]) -> DataFrame:
    """Blocks never released: the last step of their pointer made them. One aggregation, combined before the shuffle."""
    released = F.when(c("old") != 0, F.struct(F.lit(0).alias("sub"), c("old").alias("ptr"), F.lit(None).cast("long").alias("size")))
    made = F.when((c("ptr") != 0) & c("size").isNotNull(), F.struct(F.lit(1).alias("sub"), "ptr", c("size").cast("long").alias("size")))
    s = calls.select("run_id", *order, F.explode(F.array_compact(F.array(released, made))).alias("s"))
    last = s.groupBy("run_id", c("s.ptr").alias("ptr")).agg(
        F.max_by(F.struct("s.sub", "s.size"), F.struct(*order, "s.sub")).alias("l"))
    return last.where(c("l.sub") == 1).select("run_id", "ptr", c("l.size").alias("size"))


def calls_by_function(calls: DataFrame) -> DataFrame:
    """Allocator calls per function; releasing null is not a call."""
    return calls.where(~c("is_free") | (c("old") != 0)).groupBy("run_id", c("fn").alias("function")).agg(
        F.count("*").alias("calls"))


def top_sizes(calls: DataFrame, order: list[str] = ["seq"], k: int = TOP_SIZES) -> DataFrame:
    """K6: the most frequent block sizes; ties go to the size seen first."""
    n = calls.where((c("ptr") != 0) & c("size").isNotNull()).groupBy("run_id", c("size").cast("long").alias("size")).agg(
        F.count("*").alias("count"), F.min(F.struct(*order)).alias("first"))
    return top_k(n, ["run_id"], [F.desc("count"), F.asc("first")], k, rank="rank").drop("first")


def largest_live(calls: DataFrame, order: list[str] = ["seq"], k: int = TOP_BLOCKS) -> DataFrame:
    """K6: the largest blocks still live, as (address text, size)."""
    top = top_k(live_blocks(calls, order), ["run_id"], [F.desc("size"), F.asc("ptr")], k, rank="rank")
    return top.withColumn("addr", F.concat(F.lit("0x"), F.lower(F.hex("ptr"))))


def ledger_findings(table: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """R26-R29."""
    t = table.join(runs.select("run_id", "duration_ms"), "run_id", "left") if runs is not None else table.withColumn(
        "duration_ms", F.lit(None).cast("long"))
    churn = c("n_alloc") + c("n_free")
    rate = F.when(c("duration_ms") > 0, churn / (c("duration_ms") / 1000.0))
    storm = (churn >= STORM_CALLS) | F.coalesce((rate >= STORM_RATE) & (churn > STORM_RATE_MIN), F.lit(False))
    leak = (c("outstanding_bytes") >= LEAK_BYTES) | (c("outstanding_blocks") >= LEAK_BLOCKS)
    uneven = (c("n_alloc") >= IMBALANCE_MIN) & (c("n_free") > 0) & (c("n_alloc") >= c("n_free") * IMBALANCE)

    def row(rid: str, sev: str, score: float, title: Column) -> Column:
        return F.struct(F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(score).alias("severity_score"),
                        title.alias("title"))

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    kb = F.format_string("%.0f", c("outstanding_bytes") / 1024.0)
    rows = [
        F.when(storm, row("allocation_storm", "medium", 0.5, text("Allocation storm: ", churn.cast("string"), " calls"))),
        F.when(leak, row("heap_leak", "high", 0.7, text("Memory not freed: ", kb, " KB in ",
                                                        c("outstanding_blocks").cast("string"), " blocks"))),
        F.when(uneven, row("alloc_free_imbalance", "medium", 0.5, text(
            "Allocations and frees out of balance: ", c("n_alloc").cast("string"), " to ", c("n_free").cast("string")))),
        F.when(c("free_unmatched") >= UNMATCHED_MIN, row("free_unmatched", "medium", 0.45, text(
            c("free_unmatched").cast("string"), " frees without a matching allocation"))),
    ]
    return t.select("run_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select(
        "run_id", "f.*", F.lit(1).cast("long").alias("occurrence_count"))
