"""Point-in-interval, interval-overlap and coverage, without quadratic work inside a hot thread.

Intervals are put into bins whose width matches their own length (levels of a factor eight), so each interval lies in at
most two bins and short ones never meet the rows of a long neighbour's whole lifetime. Points probe one bin on each
level that really occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import MONO_BLOCK_NS, width_block

BASE_BITS = 27      # 2**27 ns: 134 ms
CELL_BITS = 33      # 2**33 ns: 9 seconds
_CELL_STEP = 4
_CELL_LEVELS = 9
_STEP_BITS = 3
_LEVELS = 12        # the last width is 2**60 ns: longer than any capture


def _bin(at: Column, level: Column, base_bits: int) -> Column:
    """Bin number on a level. Widths are powers of two: a shift is exact for any BIGINT, a division would not be."""
    return F.call_function("shiftright", at, (level * _STEP_BITS + base_bits).cast("int"))


def _level(dur: Column, base_bits: int) -> Column:
    level = F.lit(0)
    for n in range(1, _LEVELS):
        level = F.when(dur > F.lit(1 << (base_bits + _STEP_BITS * (n - 1))), n).otherwise(level)
    return level


def _levels_in(df: DataFrame, dur: str, base_bits: int) -> Column:
    """Which levels occur, as a one-row subquery of at most a dozen integers."""
    return df.select(F.sort_array(F.collect_set(_level(F.col(dur), base_bits))).alias("levels")).scalar()


def contain_join(points: DataFrame, at: str, spans: DataFrame, start: str, dur: str, keys: list[str],
                 base_bits: int = BASE_BITS, how: str = "inner") -> DataFrame:
    """Pairs with start <= at <= start + dur on equal keys. Column names must not clash beyond `keys`."""
    tagged = spans.withColumn("__lv", _level(F.col(dur), base_bits))
    lv = F.col("__lv")
    binned = tagged.withColumn("__bin", F.explode(F.sequence(
        _bin(F.col(start), lv, base_bits), _bin(F.col(start) + F.col(dur), lv, base_bits))))
    probes = (points.withColumn("__lv", F.explode(_levels_in(spans, dur, base_bits)))
              .withColumn("__bin", _bin(F.col(at), lv, base_bits)))
    a, b = probes.alias("a"), binned.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "__lv", "__bin"]]
    cond += [F.col(at) >= F.col(start), F.col(at) <= F.col(start) + F.col(dur)]
    joined = a.join(b, _all(cond), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__lv", "__bin")
    rest = [c for c in spans.columns if c not in keys]
    return joined.select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in rest])


def latest_open(points: DataFrame, at: str, spans: DataFrame, start: str, dur: str, keys: list[str], best: list[str],
                base_bits: int = CELL_BITS) -> DataFrame:
    """Each point with the greatest `best` (a struct, column `o`) of the spans with start <= at <= start + dur; equal points are
    one, points without an open span are dropped. `best` begins with `start`: the latest-started span is the greatest.

    A sweep along each key's time, cut into blocks. Points and spans are shuffled once: a point to its block, a span to the one
    or two blocks it begins and ends in. Of the spans that cover a block whole only the greatest matters (`_over_blocks`), so
    rows do not grow with the spans open at once. A block is read in order, batch by batch, with the spans still open as state.
    """
    if best[0] != start:
        raise ValueError("`best` must begin with the span's start")
    t = F.col
    s, e = t("__t"), t("__e")
    bits = F.lit(base_bits)
    rest = [x for x in points.columns if x not in [*keys, at]]
    p = points.select(*keys, _down(t(at), bits).alias("__block"), t(at).alias("__t"), F.struct(*rest).alias("p"))
    p = p.where(_all([t(k).isNotNull() for k in [*keys, "__t"]]))
    own = spans.select(*keys, t(start).alias("__t"), (t(start) + t(dur)).alias("__e"), F.struct(*best).alias("o"))
    own = own.where(_all([t(k).isNotNull() for k in [*keys, "__t", "__e"]]))
    edges = own.select(*keys, F.explode(F.array_distinct(F.array(_down(s, bits), _down(e, bits)))).alias("__block"), "__t", "__e", "o")
    over = _over_blocks(p.select(*keys, "__block").distinct(), own, keys, base_bits).select(*edges.columns)
    line = edges.unionByName(over).unionByName(p, allowMissingColumns=True).repartition(*keys, "__block").distinct()
    line = line.sortWithinPartitions(*keys, "__block", "__t", t("__e").isNull(), "o")
    kinds = T.StructType([*points.schema.fields, T.StructField("o", line.schema["o"].dataType)])
    return line.mapInArrow(_sweep(keys, at, rest, points.columns), kinds)


def _sweep(keys: list[str], at: str, rest: list[str], names: list[str]) -> Callable:
    """Batches of spans and points in order of time -> the points with the span that is then on top of the open ones."""
    group = [*keys, "__block"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ends, owners = [], []  # of the open spans; a later one ends earlier, or the earlier one can own nothing any more
        held = last = None     # what the open spans of earlier batches give; the group that was read last
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = {x: b.column(x) for x in [*group, "__t", "__e", "o", "p"]}
            first = np.zeros(n, bool)
            for x in group:
                first[1:] |= pc.not_equal(col[x].slice(1), col[x].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first[0] = last != [col[x][0] for x in group]
            last = [col[x][n - 1] for x in group]
            base = len(held) if held is not None else 0
            where, found = [], []
            for i, (new, time, end) in enumerate(zip(first.tolist(), col["__t"].to_pylist(), col["__e"].to_pylist())):
                if new:
                    ends, owners = [], []
                if end is None:
                    while ends and ends[-1] < time:
                        ends.pop()
                        owners.pop()
                    if ends:
                        where.append(i)
                        found.append(owners[-1])
                else:
                    while ends and ends[-1] <= end:
                        ends.pop()
                        owners.pop()
                    ends.append(end)
                    owners.append(base + i)
            known = pa.concat_arrays([held, col["o"]]) if base else col["o"]
            if where:
                mine = pa.array(where)
                given = dict(zip(rest, pc.take(col["p"], mine).flatten())) | {k: pc.take(col[k], mine) for k in keys}
                given[at] = pc.take(col["__t"], mine)
                yield pa.RecordBatch.from_arrays([*[given[x] for x in names], pc.take(known, pa.array(found))], names=[*names, "o"])
            held = pc.take(known, pa.array(owners, pa.int64()))
            owners = list(range(len(owners)))
    return run


def _over_blocks(blocks: DataFrame, own: DataFrame, keys: list[str], base_bits: int) -> DataFrame:
    """The greatest of the spans that cover a block whole, for each block where there is one.

    Blocks are the lowest cells of a tree in which each cell is sixteen times as wide as those below it. A span is written to
    the few widest cells it covers whole, where only the greatest span is kept, and a block meets one row on each level.
    """
    t = F.col
    s, e = t("__t"), t("__e")
    levels = min(_CELL_LEVELS, (62 - base_bits) // _CELL_STEP)
    top = F.lit(-1)
    for n in range(levels):
        top = F.when(e - s + 1 >= F.lit(1 << (base_bits + _CELL_STEP * n)), n).otherwise(top)

    def between(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def cells(k: Column) -> Column:
        """Cells of level k that the span covers and that lie in no covered cell of the next level."""
        bits, above = (k * _CELL_STEP + base_bits).cast("int"), ((k + 1) * _CELL_STEP + base_bits).cast("int")
        one = F.lit(1).cast("long")
        first, last = _down(s + F.call_function("shiftleft", one, bits) - 1, bits), _down(e + 1, bits)
        inner = _down(s + F.call_function("shiftleft", one, above) - 1, above) * (1 << _CELL_STEP)
        outer = _down(e + 1, above) * (1 << _CELL_STEP)
        # Without a covered cell above, `inner` lies at or beyond `outer`, and the two stretches meet or the second is empty.
        found = F.concat(between(first, F.least(last, inner)), between(F.greatest(inner, outer), last))
        return F.transform(F.when(first < last, found).otherwise(F.array().cast("array<bigint>")),
                           lambda i: F.struct(k.cast("int").alias("lv"), i.alias("bin")))

    covered = F.when(top >= 0, F.flatten(F.transform(F.sequence(F.lit(0), top), cells)))
    # The outer form, as the plain one would have the cells computed once more to filter empty lists.
    whole = (own.select(*keys, F.struct("o", "__t", "__e").alias("b"), F.explode_outer(covered).alias("cell")).where(t("cell").isNotNull())
             .groupBy(*keys, t("cell.lv").alias("__lv"), t("cell.bin").alias("__bin")).agg(F.max("b").alias("b")))
    highest = own.select(F.max(top)).scalar()
    asked = blocks.withColumn("__lv", F.explode(F.when(highest >= 0, F.sequence(F.lit(0), highest)).otherwise(F.array().cast("array<int>"))))
    asked = asked.withColumn("__bin", _down(t("__block"), (t("__lv") * _CELL_STEP).cast("int")))
    met = asked.join(whole, [*keys, "__lv", "__bin"]).groupBy(*keys, "__block").agg(F.max("b").alias("b"))
    return met.select(*keys, "__block", "b.__t", "b.__e", "b.o")


def _down(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def overlap_join(left: DataFrame, l_start: str, l_dur: str, right: DataFrame, r_start: str, r_dur: str,
                 keys: list[str], base_bits: int = BASE_BITS, copies: str | None = None) -> DataFrame:
    """Pairs of intervals that share more than a point, each pair once. With `copies`, equal rows of `right` are one row with
    their number in that column."""
    levels = {side: _levels_in(df, dur, base_bits) for side, df, dur in (("a", left, l_dur), ("b", right, r_dur))}
    t = F.col
    own, x, place = t("__own"), t("__x"), ["__side", "__lv", "__bin"]

    def binned(df: DataFrame, start: str, dur: str, side: int, others: Column, met: Column, alone: Column) -> DataFrame:
        """The bins of each row on its own level (`__x` -1; where `alone` holds) for `side`, and on levels of the other table."""
        out = df.withColumn("__own", _level(t(dur), base_bits)).withColumn("__x", F.explode(F.concat(F.array(F.lit(-1)), others)))
        out = out.where(F.when(x < 0, alone).otherwise(met)).withColumn("__lv", F.when(x < 0, own).otherwise(x))
        bins = F.sequence(_bin(t(start), t("__lv"), base_bits), _bin(t(start) + t(dur), t("__lv"), base_bits))
        return out.select(*df.columns, F.when(x < 0, side).otherwise(3 - side).alias("__side"), "__lv", F.explode(bins).alias("__bin"))

    # One interval of every candidate pair is on its own level, so short ones do not meet in the bins of long ones: on side 1 it
    # is the right one, on side 2, where the left one is the longer, the left one. Each table is binned and shuffled once.
    a = binned(left, l_start, l_dur, 2, levels["b"], x >= own, own > F.array_min(levels["b"]))
    b = binned(right, r_start, r_dur, 1, levels["a"], x > own, F.lit(True))
    rest = [c for c in right.columns if c not in keys]
    if copies:
        b = b.repartition(*keys, *place).groupBy(*keys, *place, *rest).agg(F.count("*").alias(copies))
        rest = [*rest, copies]
    a, b = a.alias("a"), b.alias("b")
    first = F.greatest(t(l_start), t(r_start))
    cond = [t(f"a.{k}") == t(f"b.{k}") for k in [*keys, *place]]
    # One home per pair: the coarser of the two levels, and there the bin of the later start.
    cond += [t("a.__bin") == _bin(first, t("a.__lv"), base_bits), F.least(t(l_start) + t(l_dur), t(r_start) + t(r_dur)) > first]
    return a.join(b, _all(cond)).select(*[t(f"a.{c}") for c in left.columns], *[t(f"b.{c}") for c in rest])


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def coverage(spans: DataFrame, span_id: str, start: str, dur: str, intervals: DataFrame, i_start: str, i_dur: str,
             keys: list[str], classes: dict[str, Column], block_ns: int = MONO_BLOCK_NS) -> DataFrame:
    """Per span: total length shared with the intervals of each class (overlaps counted once per interval).

    A sweep, not a join: interval ends are steps of +1 and -1, and the area under the step curve up to a time x is the sum of
    step * (x - its time); a span's share is the area at its end minus the area at its start. Work is a sort, however many
    intervals a span covers. Rows are shuffled once, whole, to the one or two blocks they begin and end in and become steps and
    marks there; a block begins with what the blocks before it have left open and their area. Times are counted from the block's
    beginning, so sums stay as small as areas.
    """
    names = list(classes)
    t = F.col
    begin = t("__block") * F.lit(block_ns)
    known = _all([t(k).isNotNull() for k in [*keys, "__block"]])

    def dealt(df: DataFrame, *cols: str) -> DataFrame:
        """Rows from `__s` to `__e` in the blocks of both, with each end, as `__a` and `__b` from the block's beginning, only in its own."""
        first, last = width_block("__s", block_ns), width_block("__e", block_ns)
        return df.withColumn("__block", F.explode(F.array_distinct(F.array(first, last)))).where(known).select(
            *keys, "__block", F.when(first == t("__block"), t("__s") - begin).alias("__a"),
            F.when(last == t("__block"), t("__e") - begin).alias("__b"), *cols)

    mask = F.lit(0)
    for i, c in enumerate(classes.values()):
        mask = mask + F.when(c, 1 << i).otherwise(0)
    inter = dealt(intervals.where(t(i_dur) > 0).select(*keys, t(i_start).alias("__s"), (t(i_start) + t(i_dur)).alias("__e"), mask.alias("__k"))
                  .where("__k > 0"), "__k")
    marks = dealt(spans.where(t(span_id).isNotNull()).select(*keys, t(start).alias("__s"), (t(start) + t(dur)).alias("__e"),
                                                              t(span_id).alias("__id")), "__id")

    def has(i: int) -> Column:
        return t("__k").bitwiseAND(1 << i) > 0

    up, down = t("__a").isNotNull().cast("long"), t("__b").isNotNull().cast("long")
    moved = F.coalesce(t("__a"), F.lit(0)) - F.coalesce(t("__b"), F.lit(0))
    each = inter.unionByName(marks.select(*keys, "__block").distinct(), allowMissingColumns=True).groupBy(*keys, "__block").agg(
        *[F.coalesce(F.sum(F.when(has(i), up - down)), F.lit(0)).alias(f"__n{i}") for i in range(len(names))],
        *[F.coalesce(F.sum(F.when(has(i), moved)), F.lit(0)).alias(f"__m{i}") for i in range(len(names))])
    key = Window.partitionBy(*keys)
    before = key.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    since = begin - F.min(begin).over(key)
    at = each.withColumn("__since", since)

    def so_far(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(before), F.lit(0))

    open_, area = [so_far(t(f"__n{i}")) for i in range(len(names))], [
        t("__since") * so_far(t(f"__n{i}")) - so_far(t(f"__n{i}") * t("__since") + t(f"__m{i}")) for i in range(len(names))]
    left = at.select(*keys, "__block", F.array(*open_).alias("__open"), F.array(*area).alias("__area"))
    left = left.where(F.exists("__open", lambda x: x != 0) | F.exists("__area", lambda x: x != 0))

    line = inter.unionByName(marks, allowMissingColumns=True).unionByName(left, allowMissingColumns=True).repartition(*keys, "__block")
    side = F.when(t("__id").isNull(), 1).otherwise(-1).cast("long")  # a span's area is that at its end less that at its start
    ends = F.array(F.struct(t("__a").alias("x"), side.alias("sign")), F.struct(t("__b").alias("x"), (-side).alias("sign")),
                   F.struct(F.when(t("__open").isNotNull(), F.lit(-1 << 62)).alias("x"), F.lit(0).cast("long").alias("sign")))
    steps = line.withColumn("__p", F.explode(F.filter(ends, lambda p: p["x"].isNotNull()))).select(
        *keys, "__block", "__id", t("__p.x").alias("__x"), t("__p.sign").alias("__sign"), "__k", "__open", "__area")
    upto = Window.partitionBy(*keys, "__block").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)

    def shared(i: int) -> Column:
        n = F.when(has(i), t("__sign")).when(t("__open").isNotNull(), F.get("__open", F.lit(i)))
        m = F.when(has(i), t("__sign") * t("__x")).when(t("__open").isNotNull(), -F.get("__area", F.lit(i)))
        zero = F.lit(0).cast("long")
        return t("__x") * F.sum(F.coalesce(n, zero)).over(upto) - F.sum(F.coalesce(m, zero)).over(upto)

    found = steps.select(*keys, "__id", "__x", "__sign", *[shared(i).alias(f"__f{i}") for i in range(len(names))]).where(t("__id").isNotNull())
    return found.groupBy(*keys, t("__id").alias(span_id)).agg(*[F.sum(t("__sign") * t(f"__f{i}")).alias(n) for i, n in enumerate(names)])
