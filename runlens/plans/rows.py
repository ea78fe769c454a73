"""Evaluate costly columns once per row.

A filter on a computed column is pushed below the projection that computes it, and the computation is repeated there (and
once more for every use). A one-element generator is a boundary the optimiser does not push filters through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_where(df: DataFrame, valid: Column, *cols: Column) -> DataFrame:
    """`select(cols)` for the rows on which `valid` holds, computing each column once."""
    row = F.when(valid, F.struct(*cols)).alias("__row")
    out = df.select(row).select(F.explode(F.array("__row")).alias("__row"))
    return out.where(F.col("__row").isNotNull()).select("__row.*")


def fan_out(df: DataFrame, keep: list[str], variants: list[Column], name: str) -> DataFrame:
    """One output row per non-null variant of each row; all variants are structs of one type."""
    tags = [f"__v{i}" for i in range(len(variants))]
    wide = df.select(*keep, *[v.alias(t) for v, t in zip(variants, tags)])
    return wide.select(*keep, F.explode(F.array(*tags)).alias(name)).where(F.col(name).isNotNull())
