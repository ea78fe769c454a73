"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof per row.

Nodes are rows labelled with the interval [lo, hi) of leaf ranks that they cover. The tree is built in bands of a few levels:
a band's nodes come from blocks of fan ** band neighbouring items, and the blocks' top nodes are the next band's items, so no
group of rows is larger than a block however many leaves a tree has. Every join is by containment of intervals within a level
and a bucket of ranks: children to the parent whose interval holds theirs, items to the nodes above them. What a parent's
interval has left and right of a child's are the child's siblings. An item's path is that of its band followed by the path of
the band's top node, so each level is attached once a block and not once a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

STEP = "struct<before: string, after: string>"


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' texts one after another."""
    return F.sha2(F.concat(*[p.cast("string") for p in parts]).cast("binary"), 256)


def field(value: Column) -> Column:
    """- if null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha(*[field(v) for v in values])


def _widths(fan: int) -> list[int]:
    """Leaves under a full node of each level, up to 2 ** 62."""
    out = [1]
    while out[-1] * fan < 1 << 62:
        out.append(out[-1] * fan)
    return out


def _bucket(rank: Column, level: Column, fan: int) -> Column:
    width = F.element_at(F.array([F.lit(w).cast("long") for w in _widths(fan)]), level + 1)
    return F.floor(rank / width) if fan > 2 else F.call_function("shiftright", rank, level.cast("int"))


def height(n: Column, fan: int) -> Column:
    """Levels above n leaves: 0 for one."""
    return F.size(F.filter(F.array([F.lit(w).cast("long") for w in _widths(fan)]), lambda w: w < n))


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with n, their key's number of rows, and rank, from 0, within the key by the order columns, nulls first.

    A range sort over all rows; a key may take many partitions. One row of counts for each partition and key gives the offsets.
    """
    by = [F.col(key), *[F.col(c).asc_nulls_first() for c in order]]
    placed = common.cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part"), F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy("__key").orderBy("__part")
    offsets = common.cut(counts.select("__part", "__key", "__first", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy("__key")).alias("n")))
    return placed.withColumn("__part", part).withColumn("__key", F.col(key)).join(offsets, ["__part", "__key"]) \
        .withColumn("rank", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__key", "__first", "__before", "__at")


def band_nodes(items: DataFrame, level: int, band: int, fan: int) -> DataFrame:
    """(key, level, lo, hi, digest, n): the nodes of levels level to level + band over items (key, lo, hi, digest, n) of that level.

    n is the number of leaves of the key. Trees that end within the band end with their one root.
    """
    width = fan ** level
    block = F.floor(F.col("lo") / (width * fan ** band)) if fan > 2 else F.shiftright("lo", level + band)
    blocks = items.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("row"), F.first("n").alias("n"))
    steps = F.least(F.lit(band), height(F.col("n"), fan) - level)

    def above(row: Column) -> Column:
        def node(i: Column) -> Column:
            under = F.slice(row, i * fan + 1, fan)
            return F.struct(F.element_at(under, 1)["lo"].alias("lo"), F.element_at(under, -1)["hi"].alias("hi"),
                            F.sha2(F.array_join(F.transform(under, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(row) - 1) / fan).cast("int")), node)

    rows = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), F.array("row"),
                       lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    levels = blocks.select("key", "n", F.posexplode(rows).alias("up", "row"))
    return levels.select("key", (F.col("up") + level).alias("level"), F.explode("row").alias("node"), "n").select("key", "level", "node.*", "n")


def siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """(key, level, lo, hi, before, after) of every node with a parent: the digests that its parent's interval has before its own
    and after it, each as one text, empty where there is none."""
    up = F.col("level") + 1
    children = nodes.select("key", up.alias("level"), _bucket(F.col("lo"), up, fan).alias("bucket"), F.struct("lo", "hi", "digest").alias("child"))
    parents = nodes.select("key", "level", _bucket(F.col("lo"), F.col("level"), fan).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    held = children.join(parents, ["key", "level", "bucket"]).filter("p_lo <= child.lo AND child.hi <= p_hi")
    families = held.groupBy("key", "level", "bucket", "p_lo").agg(F.sort_array(F.collect_list("child")).alias("children"))
    each = families.select("key", (F.col("level") - 1).alias("level"), "children", F.explode("children").alias("own"))

    def rest(test) -> Column:
        return F.array_join(F.transform(F.filter("children", test), lambda c: c["digest"]), "")
    return each.select("key", "level", "own.lo", "own.hi", rest(lambda c: c["hi"] <= F.col("own.lo")).alias("before"), rest(lambda c: c["lo"] >= F.col("own.hi")).alias("after"))


def paths(items: DataFrame, sides: DataFrame, level: int, band: int, fan: int) -> DataFrame:
    """(key, lo, path) of the items that have nodes of the band's levels above or at them: their siblings level by level."""
    levels = F.sequence(F.lit(level), F.least(F.lit(level + band), height(F.col("n"), fan)) - 1)
    each = items.filter(height(F.col("n"), fan) > level).select("key", "lo", "hi", F.explode(levels).alias("level"))
    each = each.withColumn("bucket", _bucket(F.col("lo"), F.col("level"), fan))
    nodes = sides.select("key", "level", _bucket(F.col("lo"), F.col("level"), fan).alias("bucket"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), "before", "after")
    held = each.join(nodes, ["key", "level", "bucket"]).filter("n_lo <= lo AND hi <= n_hi")
    steps = held.groupBy("key", "lo").agg(F.sort_array(F.collect_list(F.struct("level", "before", "after"))).alias("path"))
    return steps.select("key", "lo", F.transform("path", lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after"))).alias("path"))


def trees(leaves: DataFrame, fan: int = 2, band: int = 6) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(roots, bands) of ranked leaves (key, rank, digest, n). roots: (key, digest). A band: its items and its siblings.

    A round for each band levels of the highest tree; a round's work shrinks by fan ** band."""
    items = leaves.select("key", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n")
    most = items.agg(F.max("n")).first()[0] or 0
    level, bands, roots = 0, [], items.filter("n = 1").select("key", "digest")
    while fan ** level < most:
        nodes = common.cut(band_nodes(items, level, band, fan))
        bands.append((items, common.cut(siblings(nodes, fan))))
        top = height(F.col("n"), fan)
        roots = roots.unionByName(nodes.filter((F.col("level") == top) & (F.col("level") > level)).select("key", "digest"))
        level += band
        items = nodes.filter((F.col("level") == level) & (top > level)).drop("level")
    return roots, bands


def proofs(bands: list[tuple[DataFrame, DataFrame]], ends: DataFrame, band: int, fan: int) -> DataFrame | None:
    """(key, lo, path, root columns) of the first band's items. ends: (key, tail, ...) with the path that goes on above each root.
    None if no tree has more than one leaf."""
    known, extra = None, [c for c in ends.columns if c not in ("key", "tail")]
    for k in range(len(bands) - 1, -1, -1):
        items, sides = bands[k]
        level = k * band
        own = paths(items, sides, level, band, fan).join(items.select("key", "lo", "n"), ["key", "lo"])
        over = height(F.col("n"), fan) > level + band
        done = own.filter(~over).join(ends, "key").select("key", "lo", F.concat("path", "tail").alias("path"), *extra)
        if known is not None:
            block = F.floor(F.col("lo") / fan ** (level + band)) if fan > 2 else F.shiftright("lo", level + band)
            up = known.select("key", block.alias("block"), F.col("path").alias("tail"), *extra, F.col("lo").alias("up_lo"))
            more = own.filter(over).withColumn("block", block).join(up, ["key", "block"]).filter("up_lo <= lo")
            done = done.unionByName(more.select("key", "lo", F.concat("path", "tail").alias("path"), *extra))
        known = done if k == 0 else common.cut(done)
    return known


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def prove(rows: DataFrame, group: str, order: str, fan: int = 2, band: int = 6) -> DataFrame:
    """The rows (group, order, leaf and others) with subroot, root and path: the siblings (before, after) of each level from the
    leaf to its group's subroot and on to the root. Groups go by their UTF-8 bytes, a null one first; within a group leaves
    go by the order column, nulls first, and equal ones by their leaf. Equal rows are leaves of their own. Columns named key, n,
    rank, lo, path, subroot or root must not be among them. An empty table gives no rows."""
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    ordered = common.cut(ranked(keyed, "key", [order, "leaf"]))
    subroots, bands = trees(ordered.select("key", "rank", F.col("leaf").alias("digest"), "n"), fan, band)
    heads = common.cut(ranked(subroots.withColumn("group", F.col("key")).withColumn("key", F.lit("")), "key", ["group"]))
    roots, over = trees(heads, fan, band)
    none = F.array().cast(f"array<{STEP}>")
    ends = roots.select("key", none.alias("tail"), F.col("digest").alias("root"))
    top = proofs(over, ends, band, fan)
    if top is None:  # one group: its subroot is the root
        top = ends.select(F.lit(0).cast("long").alias("lo"), F.col("tail").alias("path"), "root")
    tops = heads.select("group", "digest", F.col("rank").alias("lo")).join(top.select("lo", "path", "root"), "lo")
    tails = common.cut(tops.select(F.col("group").alias("key"), F.col("path").alias("tail"), F.col("digest").alias("subroot"), "root"))
    alone = ordered.filter("n = 1").join(tails.withColumnRenamed("tail", "path"), "key")
    known = proofs(bands, tails, band, fan)
    if known is not None:
        alone = alone.unionByName(ordered.filter("n > 1").join(known.withColumnRenamed("lo", "rank"), ["key", "rank"]))
    return alone.drop("key", "n", "rank")


def verify(docs: DataFrame, tampered: Column, fan: int = 2, band: int = 6) -> DataFrame:
    """One row per document of doc_id, source, lang, n_chars and text, trees by lang over doc_id: doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified. Where tampered holds, the root is folded from a leaf with n_chars one higher (a null
    stays). Nulls of any column count as such; a null doc_id comes first. Extra columns are left behind."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    own = leaf(doc_id, F.col("source"), F.col("lang"), n_chars, F.col("text"))
    other = F.when(tampered & n_chars.isNotNull(), leaf(doc_id, F.col("source"), F.col("lang"), n_chars + 1, F.col("text")))
    rows = common.cut(docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), own.alias("leaf"), other.alias("other")))
    proved = prove(rows, "lang", "doc_id", fan, band)
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
