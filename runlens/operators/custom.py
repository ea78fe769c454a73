"""User-written rules (R34, R35): the expression becomes a Column, counted per run or followed over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ExpressionError, compile_rule, event_vars, metric_vars
from ..functions.scalars import severity_score
from ..schemas import FINDINGS
from ..plans.scan import ordered_scan, running
from ..plans.topk import top_k
from .series import TIME, time_block

c = F.col


def load_rules(table: DataFrame) -> list[dict]:
    """The enabled rules, oldest first. A rule table is a settings page: rows a person has typed in."""
    return [r.asDict() for r in table.where("enabled").orderBy("created_at", "id").toLocalIterator()]


def _compiled(rules: list[dict], signal: str) -> list[tuple[dict, Column]]:
    """Rules of one signal with their predicate; one that no longer compiles is left out, never an error."""
    out = []
    for r in rules:
        if r.get("signal") == signal and r.get("enabled", True):
            try:
                out.append((r, compile_rule(r["expression"], signal)))
            except ExpressionError:
                continue
    return out


def _rule_struct(r: dict) -> Column:
    text = r.get("description") or ""
    return F.struct(F.lit(f"custom:{r['id']}").alias("rule_id"), F.lit(r.get("severity") or "medium").alias("severity"),
                    F.lit(r["name"]).alias("name"), F.lit(text).alias("text"), F.lit(r["expression"]).alias("expression"),
                    F.lit(int(r.get("min_count") or 5)).cast("long").alias("min_count"),
                    F.lit(int(r["duration_ms"] if r.get("duration_ms") is not None else 5000)).cast("long").alias("min_ms"))


def event_matches(events: DataFrame, rules: list[dict]) -> DataFrame | None:
    """Every (event, rule) hit. All rules are tested in one pass."""
    ready = _compiled(rules, "events")
    if not ready:
        return None
    rows = events.where(c("event_type") != "libcall").select("run_id", "seq", "ts_us", *event_vars())
    hits = F.array_compact(F.array(*[F.when(pred, _rule_struct(r)) for r, pred in ready]))
    return rows.select("run_id", "seq", "ts_us", F.explode(hits).alias("r")).select("run_id", "seq", "ts_us", "r.*")


def custom_findings(spark: SparkSession, events: DataFrame, metrics: DataFrame, rules: list[dict],
                    metric_block: Column | None = None) -> DataFrame:
    """R34 and R35 for every run."""
    parts = []
    rule_cols = ["rule_id", "severity", "name", "text", "expression", "min_count", "min_ms"]
    hits = event_matches(events, rules)
    if hits is not None:
        n = c("n")
        g = hits.groupBy("run_id", *rule_cols).agg(F.count("*").alias("n"), F.min_by("ts_us", "seq").alias("first_us"),
                                                   F.max_by("ts_us", "seq").alias("last_us")).where(n >= c("min_count"))
        parts.append(g.select(
            "run_id", "rule_id", "severity", severity_score(c("severity"), n).alias("severity_score"),
            F.concat(c("name"), F.lit(" ("), n.cast("string"), F.lit("x)")).alias("title"),
            F.when(c("text") != "", c("text")).otherwise(F.concat(F.lit("Matched "), n.cast("string"), F.lit(" times: "),
                                                                  c("expression"))).alias("description"),
            c("first_us").alias("first_seen_us"), c("last_us").alias("last_seen_us"), n.alias("occurrence_count")))
    ready = _compiled(rules, "metrics")
    if ready:
        rows = metrics.where(c("ts_us").isNotNull()).select("run_id", "ts_us", *metric_vars(metrics.columns))
        tested = rows.select("run_id", "ts_us", F.explode(F.array(*[
            F.struct(pred.alias("hit"), *[_rule_struct(r)[k].alias(k) for k in rule_cols]) for r, pred in ready])).alias("r"))
        tested = tested.select("run_id", "ts_us", "r.*")
        block = metric_block if metric_block is not None else time_block()
        cut = ordered_scan(tested, ["run_id", "rule_id"], TIME, block,
                           misses=running(F.when(c("hit"), 0).otherwise(1).cast("long")))
        spans = cut.where("hit").groupBy("run_id", *rule_cols, "misses").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
        best = spans.groupBy("run_id", *rule_cols).agg(
            F.max(F.struct((c("z") - c("a")).alias("span"), "z", "a")).alias("b"))
        span_ms = c("b.span") / 1000.0
        hit = best.where(span_ms >= c("min_ms"))
        parts.append(hit.select(
            "run_id", "rule_id", "severity", severity_score(c("severity"), F.floor(span_ms)).alias("severity_score"),
            c("name").alias("title"),
            F.when(c("text") != "", c("text")).otherwise(F.concat(
                F.lit("Held for "), F.floor(span_ms / 1000).cast("string"), F.lit(" s: "), c("expression"))).alias("description"),
            c("b.a").alias("first_seen_us"), c("b.z").alias("last_seen_us"), F.lit(1).cast("long").alias("occurrence_count")))
    if not parts:
        return spark.createDataFrame([], FINDINGS)
    return reduce(DataFrame.unionByName, parts)


def custom_evidence(events: DataFrame, rules: list[dict], k: int = 20) -> DataFrame | None:
    """The first k matching events of each custom rule and run."""
    hits = event_matches(events, rules)
    return None if hits is None else top_k(hits, ["run_id", "rule_id"], [F.asc("seq")], k, rank="rank")
