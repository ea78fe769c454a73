"""Ordered scans that never sort one whole key in one task.

`lag`, `last non-null before me`, `running sum` and friends are windows over (keys, order). With a plain window a key
that holds a third of all rows is one task. Here each key's sequence is cut into *blocks* by a value derived from the
order column, the window runs inside a block, one summary row per block is scanned across blocks, and the state at the
block start is joined back. Only the per-block summaries of a key ever meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_BLOCK_BITS = 20            # about a million log lines per block
TIME_BLOCK_US = 3_600_000_000  # one hour of 4 Hz samples: 14,400 rows per block and run
MONO_BLOCK_NS = 1_000_000_000  # one second of one thread: calls take a microsecond at least, so a million rows or so
TIME_UNITS_US = (TIME_BLOCK_US, 1_000_000, 1_000)  # an hour, a second, a millisecond
BLOCK_ROWS = 1 << 20           # rows from which a block of time is cut finer

_BLOCK = "__block"


def seq_block(col: str = "seq", bits: int = SEQ_BLOCK_BITS) -> Column:
    return F.shiftright(F.col(col).cast("long"), bits)


def width_block(col: str, width: int) -> Column:
    return F.expr(f"`{col}` div {width}")


def even_blocks(df: DataFrame, keys: list[str], col: str, name: str, units: tuple[int, int, int], most: int = BLOCK_ROWS) -> DataFrame:
    """`df` with a block `name` along `col`: the row's coarse unit, in a coarse unit of over `most` rows its middle unit, and in a
    middle unit of over `most` rows its fine unit; `units` has their widths, each a multiple of the next.

    A block is named by where it begins, so blocks of mixed width ascend along `col`. Rows are counted by middle unit with
    map-side combining, and only the middle units of dense coarse ones are joined back, on keys that hold few rows each. Where
    there are none, which the counts tell before the join runs, the rows keep their coarse units.
    """
    coarse, middle, fine = units
    if coarse % middle or middle % fine:
        raise ValueError("each width must be a multiple of the next")
    at, big = F.col("__mid"), F.expr(f"__mid div {coarse // middle}")
    each = df.where(F.col(col).isNotNull()).groupBy(*keys, F.expr(f"`{col}` div {middle}").alias("__mid")).agg(F.count("*").alias("__n"))
    dense = each.groupBy(*keys, big.alias("__big")).agg(F.sum("__n").alias("__all")).where(F.col("__all") > most).drop("__all")
    opened = each.withColumn("__big", big).join(dense, [*keys, "__big"], "left_semi").select(*keys, "__mid", (F.col("__n") > most).alias("__open"))
    rows = df.withColumn("__mid", F.expr(f"`{col}` div {middle}")).join(opened, [*keys, "__mid"], "left")
    begins = (F.when(F.col("__open"), F.expr(f"`{col}` div {fine} * {fine}"))
              .when(F.col("__open").isNotNull(), at * middle).otherwise(big * coarse))
    return rows.select(*df.columns, begins.alias(name))


@dataclass(frozen=True)
class Carry:
    kind: str
    value: Column


def prev(*cols: str) -> Carry:
    """The row just before this one, as a struct (null for the first row)."""
    return Carry("prev", F.struct(*cols))


def following(*cols: str) -> Carry:
    """The row just after this one, as a struct (null for the last row)."""
    return Carry("next", F.struct(*cols))


def last_known(value: Column) -> Carry:
    """Last non-null value strictly before this row."""
    return Carry("last", value)


def last_known_incl(value: Column) -> Carry:
    """Last non-null value up to and including this row."""
    return Carry("last_incl", value)


def next_known(value: Column) -> Carry:
    """First non-null value at or after this row."""
    return Carry("next_known", value)


def running(value: Column) -> Carry:
    """Inclusive running sum."""
    return Carry("sum", value)


def remaining(value: Column) -> Carry:
    """Inclusive running sum from the key's end: what this row and the rows after it add up to."""
    return Carry("sum_back", value)


def running_max(value: Column) -> Carry:
    """Inclusive running maximum."""
    return Carry("max", value)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], block: Column, *, shared: bool = False,
                 **outs: Carry) -> DataFrame:
    """Add one column per carry. `block` must be non-decreasing along `order`; keys must not be null.

    The block summaries are a second, narrow, map-side-combined pass over `df`. Where producing `df` is the costly part
    (a scan over a scan) and every column of it is used afterwards, `shared=True` makes both passes read one shuffle:
    both ask for the same columns, so the exchange is reused and `df` is computed once.
    """
    src = df.withColumn(_BLOCK, block)
    if shared:
        # The join below implies these filters for one side only; stated for both, the two shuffles stay equal.
        for k in [*keys, _BLOCK]:
            src = src.where(F.col(k).isNotNull())
        src = src.repartition(*keys, _BLOCK)
    inside = Window.partitionBy(*keys, _BLOCK)
    asc = inside.orderBy(*order)
    desc = inside.orderBy(*[F.desc(c) for c in order])
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    upto = asc.rowsBetween(Window.unboundedPreceding, 0)
    back = desc.rowsBetween(Window.unboundedPreceding, 0)

    position = F.struct(*order)
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    blocks_before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks_after = Window.partitionBy(*keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)

    local, ends, carried, merged = {}, [], [], {}
    for name, carry in outs.items():
        v, tmp = carry.value, f"__c_{name}"
        at = F.when(v.isNotNull(), position)
        if carry.kind == "prev":
            local[name] = F.lag(v).over(asc)
            ends.append(F.max_by(v, position).alias(tmp))
            carried.append(F.last_value(tmp, True).over(blocks_before).alias(tmp))
            merged[name] = F.coalesce(name, tmp)
        elif carry.kind == "next":
            local[name] = F.lead(v).over(asc)
            ends.append(F.min_by(v, position).alias(tmp))
            carried.append(F.last_value(tmp, True).over(blocks_after).alias(tmp))
            merged[name] = F.coalesce(name, tmp)
        elif carry.kind in ("last", "last_incl"):
            local[name] = F.last_value(v, True).over(before if carry.kind == "last" else upto)
            ends.append(F.max_by(v, at).alias(tmp))
            carried.append(F.last_value(tmp, True).over(blocks_before).alias(tmp))
            merged[name] = F.coalesce(name, tmp)
        elif carry.kind == "next_known":
            local[name] = F.last_value(v, True).over(back)
            ends.append(F.min_by(v, at).alias(tmp))
            carried.append(F.last_value(tmp, True).over(blocks_after).alias(tmp))
            merged[name] = F.coalesce(name, tmp)
        elif carry.kind == "sum":
            local[name] = F.sum(v).over(upto)
            ends.append(F.sum(v).alias(tmp))
            carried.append(F.sum(tmp).over(blocks_before).alias(tmp))
            merged[name] = F.coalesce(F.col(name) + F.col(tmp), name, tmp)
        elif carry.kind == "sum_back":
            local[name] = F.sum(v).over(back)
            ends.append(F.sum(v).alias(tmp))
            carried.append(F.sum(tmp).over(blocks_after).alias(tmp))
            merged[name] = F.coalesce(F.col(name) + F.col(tmp), name, tmp)
        elif carry.kind == "max":
            local[name] = F.max(v).over(upto)
            ends.append(F.max(v).alias(tmp))
            carried.append(F.max(tmp).over(blocks_before).alias(tmp))
            merged[name] = F.greatest(name, tmp)
        else:
            raise ValueError(carry.kind)

    scanned = src.select("*", *[c.alias(n) for n, c in local.items()])
    if shared:
        ends.append(F.bit_xor(F.xxhash64(*df.columns)).alias("__all"))
    summary = src.groupBy(*keys, _BLOCK).agg(*ends)
    if shared:
        summary = summary.where(F.col("__all").isNotNull())
    summary = summary.select(*keys, _BLOCK, *carried)
    # A key that fits in one block has nothing to carry, so most summary rows drop out before the join.
    temps = [f"__c_{n}" for n in outs]
    summary = summary.where(reduce(lambda a, b: a | b, [F.col(t).isNotNull() for t in temps]))
    joined = scanned.join(summary, [*keys, _BLOCK], "left")
    return joined.select(*df.columns, *[merged[n].alias(n) for n in outs])


def row_index(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "idx") -> DataFrame:
    """Zero-based position of each row within its key."""
    out = ordered_scan(df, keys, order, block, **{name: running(F.lit(1).cast("long"))})
    return out.withColumn(name, F.col(name) - 1)


def islands(df: DataFrame, keys: list[str], order: list[str], block: Column, *, starts: Column,
            carry: dict[str, Carry], name: str = "island") -> DataFrame:
    """Number runs of consecutive rows. `carry` adds look-back columns first, `starts` says (from them) where one begins."""
    looked = ordered_scan(df, keys, order, block, **carry) if carry else df
    return ordered_scan(looked, keys, order, block, **{name: running(F.when(starts, 1).otherwise(0).cast("long"))})
