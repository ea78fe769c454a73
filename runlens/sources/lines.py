"""Text files as ordered lines.

Spark's text source gives no line number. Lines of one split come in file order, and a split starts at a known byte, so
`2 * first byte of the split + position in the task` grows along each file: a line takes at least one byte, and only the
last, shorter split of a file can share a task with another file. No shuffle and no count is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BLOCK_BITS = 27  # 64 MB of text per block of `seq`

_TASK_ROWS = (1 << 33) - 1


def read_lines(spark: SparkSession, path: str | list[str], run_id: Column | None = None) -> DataFrame:
    """(run_id, seq, line). By default the run is the `run_id=...` folder, else the file's own name."""
    raw = spark.read.text(path)
    file = F.col("_metadata.file_path")
    named = F.coalesce(F.nullif(F.regexp_extract(file, r"run_id=([^/]+)/", 1), F.lit("")),
                       F.regexp_extract(file, r"([^/]+?)(?:\.[^/.]*)*$", 1))
    task_row = F.monotonically_increasing_id().bitwiseAND(F.lit(_TASK_ROWS))
    seq = F.col("_metadata.file_block_start").cast("long") * 2 + task_row
    return raw.select((run_id if run_id is not None else named).alias("run_id"), seq.alias("seq"),
                      F.regexp_replace("value", r"\r$", "").alias("line"))


def line_block(bits: int = LINE_BLOCK_BITS) -> Column:
    return F.shiftright(F.col("seq"), bits)


def sections(lines: DataFrame, starts: Column, block: Column | None = None) -> DataFrame:
    """Number the multi-line sections of each run; a section begins where `starts` holds. Lines before the first are 0."""
    from ..plans.scan import ordered_scan, running

    return ordered_scan(lines, ["run_id"], ["seq"], block if block is not None else line_block(),
                        section=running(F.when(starts, 1).otherwise(0).cast("long")))


def in_order(value: Column, order: str = "seq") -> Column:
    """Aggregate: the values of one small section as an array in line order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))),
                       lambda s: s["v"])


