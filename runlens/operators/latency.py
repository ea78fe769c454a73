"""Histograms, block I/O and pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_ms
from ..plans.quantile import at_ranks

c = F.col
HIST = ["run_id", "hist", "unit"]


def log2_histogram(df: DataFrame, value: str, hist: str, unit: str = "usecs") -> DataFrame:
    """Power-of-two buckets of an integer column; bucket 0 holds 0 and 1."""
    v = F.greatest(c(value), F.lit(0)).cast("long")
    exp = F.when(v < 2, 0).otherwise(F.length(F.bin(v)) - 1)
    n = df.where(c(value).isNotNull()).groupBy("run_id", exp.alias("e")).agg(F.count("*").alias("count"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), c("e"))
    return n.select("run_id", F.lit(hist).alias("hist"), F.lit(unit).alias("unit"),
                    F.when(c("e") == 0, 0).otherwise(low).alias("lo"), (low * 2 - 1).alias("hi"), "count")


def histogram_summary(buckets: DataFrame) -> DataFrame:
    """A quantile is the upper bound of the first bucket at which the running count reaches q * total.

    Buckets are a few dozen per histogram however many samples they count.
    """
    b = buckets.groupBy(*HIST, "lo", "hi").agg(F.sum("count").alias("count"))
    w = Window.partitionBy(*HIST)
    ranked = b.withColumn("total", F.sum("count").over(w)).withColumn(
        "upto", F.sum("count").over(w.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))

    def q(p: float):
        return F.min_by(F.when(c("total") > 0, c("hi")), F.when(c("upto") >= c("total") * p, c("lo")))

    return ranked.groupBy(*HIST).agg(F.max("total").alias("total"), q(0.5).alias("p50"), q(0.9).alias("p90"),
                                     q(0.99).alias("p99"), F.max_by("hi", F.when(c("count") > 0, c("lo"))).alias("max"))


def latency_findings(summary: DataFrame) -> DataFrame:
    """R25. Scheduling 10 / 50 ms, block I/O 20 / 100 ms at p99; histogram names `runqueue`, `block_io`."""
    ms = F.bround(c("p99") * unit_ms(c("unit"))).cast("long")
    rules = {"runqueue": ("high_runqueue_latency", 10, 50, "Run-queue p99 "), "block_io": ("slow_block_io", 20, 100, "Block-I/O p99 ")}
    rid = med = high = text = F.lit(None)
    for h, (name, m, hi, label) in rules.items():
        rid, med = F.when(c("hist") == h, name).otherwise(rid), F.when(c("hist") == h, m).otherwise(med)
        high, text = F.when(c("hist") == h, hi).otherwise(high), F.when(c("hist") == h, label).otherwise(text)
    s = summary.select("run_id", rid.alias("rule_id"), med.alias("med"), high.alias("hi"), text.alias("label"), ms.alias("ms"))
    severe = c("ms") >= c("hi")
    return s.where(c("ms") >= c("med")).select(
        "run_id", "rule_id", F.when(severe, "high").otherwise("medium").alias("severity"),
        F.when(severe, 0.55).otherwise(0.4).alias("severity_score"),
        F.concat(c("label"), c("ms").cast("string"), F.lit(" ms")).alias("title"),
        F.lit(1).cast("long").alias("occurrence_count"))


def block_io_stats(rows: DataFrame) -> DataFrame:
    """Count, total, nearest-rank quantiles (the element at half-even round(q * (n-1))), directions and bytes."""
    base = rows.groupBy("run_id").agg(
        F.count("*").alias("count"), F.sum("lat_ns").alias("total"), F.max("lat_ns").alias("top"),
        F.count_if(c("rw").startswith("R")).alias("read_count"), F.count_if(c("rw").startswith("W")).alias("write_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_total"))
    last = c("__total") - 1
    q = at_ranks(rows, ["run_id"], "lat_ns", {n: F.least(last, F.bround(last * F.lit(p)).cast("long"))
                                              for n, p in (("p50", 0.5), ("p99", 0.99))})
    ms = 1_000_000.0
    return base.join(q, "run_id").select("run_id", "count", (c("total") / ms).alias("total_ms"), (c("p50") / ms).alias("p50_ms"),
                                         (c("p99") / ms).alias("p99_ms"), (c("top") / ms).alias("max_ms"), "read_count",
                                         "write_count", "bytes_total")


def pause_stats(pauses: DataFrame, dur_us: str = "dur_us") -> DataFrame:
    """Collector pauses per run."""
    return pauses.groupBy("run_id").agg(F.count("*").alias("count"), (F.sum(dur_us) / 1000.0).alias("total_ms"),
                                        (F.max(dur_us) / 1000.0).alias("max_ms"),
                                        (F.sum(dur_us) / F.count(dur_us) / 1000.0).alias("avg_ms"))
