"""Exact quantiles by rank selection.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here values are first
counted (map-side combined), the counts are rolled up into a few thousand value buckets per group, the buckets that
contain the wanted ranks are found, and only those buckets are opened. No task sees more than one bucket of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_DOUBLING = 256


def _bucket(value: Column) -> Column:
    """Order-preserving bucket of a signed BIGINT, about 0.3 % wide: the logarithm never decreases, and that is enough."""
    code = F.floor(F.log2(F.abs(value.cast("double")) + 1.0) * _PER_DOUBLING).cast("int")
    return F.when(value < 0, -code).otherwise(code)


def _ranks_at(df: DataFrame, keys: list[str], value: str, wanted: Column) -> DataFrame:
    """(keys, total, rank, value) for each zero-based rank in `wanted`, an array built from `total`."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v"))
              .agg(F.count("*").alias("__n")).withColumn("__b", _bucket(F.col("__v"))))
    whole = Window.partitionBy(*keys)
    buckets = (counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
               .withColumn("__total", F.sum("__bn").over(whole))
               .withColumn("__before", F.sum("__bn").over(whole.orderBy("__b").rowsBetween(
                   Window.unboundedPreceding, 0)) - F.col("__bn")))
    hit = (buckets.withColumn("__ranks", F.filter(
               F.array_distinct(wanted),
               lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__bn"))))
           .where(F.size("__ranks") > 0)
           .select(*keys, "__b", "__total", "__before", "__ranks"))
    opened = counts.join(hit, [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    placed = opened.withColumn("__upto", F.col("__before") + F.sum("__n").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (placed.withColumn("__rank", F.explode(F.filter(
                "__ranks", lambda r: (r >= F.col("__upto") - F.col("__n")) & (r < F.col("__upto")))))
            .select(*keys, "__total", "__rank", "__v"))


def _pick(found: DataFrame, keys: list[str], outs: dict[str, Column]) -> DataFrame:
    table = F.map_from_entries(F.collect_list(F.struct("__rank", "__v")))  # at most two entries per quantile
    rolled = found.groupBy(*keys).agg(F.max("__total").alias("__total"), table.alias("__at"))
    return rolled.select(*keys, *[c.alias(n) for n, c in outs.items()])


def interpolated(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles, position (n-1)*p. `value` must be an integer column."""
    total = F.col("__total")

    def low(p: float) -> Column:
        return F.floor((total - 1) * F.lit(p)).cast("long")

    def high(p: float) -> Column:
        return F.least(low(p) + 1, total - 1).cast("long")

    wanted = F.array(*[f(p) for p in probs.values() for f in (low, high)])
    found = _ranks_at(df, keys, value, wanted)
    outs = {}
    for name, p in probs.items():
        lo, hi = F.col("__at")[low(p)], F.col("__at")[high(p)]
        frac = (total - 1) * F.lit(p) - low(p)
        outs[name] = lo + (hi - lo) * frac
    return _pick(found, keys, outs)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Order statistics: each rank is a zero-based BIGINT expression over the column `__total`."""
    found = _ranks_at(df, keys, value, F.array(*ranks.values()))
    return _pick(found, keys, {n: F.col("__at")[r] for n, r in ranks.items()})
