"""Top-k per key in two steps, so a hot key is cut down before its rows meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GROUP_LIMIT = 1000  # up to here Spark cuts each task down to k rows by itself (window group limit)
_SALTS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, *, rank: str | None = None,
          salt_on: list[str] | None = None) -> DataFrame:
    """First k rows of each key in `order`. Give `salt_on` (columns that spread a key) when k is large."""
    out = rank or "__rank"
    src = df
    if k >= _GROUP_LIMIT:
        salt = F.pmod(F.hash(*(salt_on or df.columns)), F.lit(_SALTS))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        src = (df.withColumn("__salt", salt).withColumn("__r0", F.row_number().over(part))
               .where(F.col("__r0") <= k).drop("__r0", "__salt"))
    picked = src.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
    return picked if rank else picked.drop(out)
