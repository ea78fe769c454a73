"""Profiler-file ingest (F2-F6): five layouts -> stacks(run_id, [tid,] frames root to leaf, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .lines import in_order, read_lines, sections

# One stack frame of a text profile, and names a runtime adds above the real roots.
_FRAME = r"^\s+([0-9a-fA-F]+)\s+(.+?)(?:\+0x[0-9a-fA-F]+)?\s+\(([^)]*)\)\s*$"
_SYNTHETIC = ["(root)", "(program)"]


def text_stacks(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """Header line, then indented leaf-first frames; a blank line or the next header ends the sample. Weight 1."""
    line = F.col("line")
    indented = line.rlike(r"^\s") & (F.trim("line") != "")
    sym = F.trim(F.regexp_extract("line", _FRAME, 2))
    cut = sections(lines, ~indented, block)
    frames = cut.where(indented & line.rlike(_FRAME)).groupBy("run_id", "section").agg(
        F.reverse(in_order(F.when(sym == "", "[unknown]").otherwise(sym))).alias("frames"))
    return frames.select("run_id", "frames", F.lit(1).cast("long").alias("weight"))


def collapsed_stacks(lines: DataFrame) -> DataFrame:
    """`a;b;leaf N` per line; malformed lines are skipped."""
    t = F.trim("line")
    return (lines.where(t.rlike(r"^.+ [+-]?\d+$"))
            .select("run_id", F.filter(F.split(F.regexp_extract(t, r"^(.+) ([+-]?\d+)$", 1), ";"),
                                       lambda s: s != "").alias("frames"),
                    F.regexp_extract(t, r"^(.+) ([+-]?\d+)$", 2).try_cast("long").alias("weight"))
            .where((F.size("frames") > 0) & F.col("weight").isNotNull()))


def depth_stacks(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """`<depth> <function> <place>` lines, leaf first, blank line between samples. Weight 1."""
    t = F.trim("line")
    cut = sections(lines, t == "", block)
    words = F.split(F.regexp_replace(t, r"\s+", " "), " ")
    frame = F.when((F.size(words) >= 2) & F.get(words, F.lit(0)).rlike("^[0-9]+$"), F.get(words, F.lit(1))
                   ).otherwise(F.get(words, F.lit(0)))
    kept = cut.where((t != "") & ~t.startswith("#") & ~t.startswith("//"))
    return (kept.groupBy("run_id", "section").agg(F.reverse(in_order(frame)).alias("frames"))
            .select("run_id", "frames", F.lit(1).cast("long").alias("weight")))


_SAMPLED = T.StructType([
    T.StructField("shared", T.StructType([T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType())])))])),
    T.StructField("profiles", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("samples", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("weights", T.ArrayType(T.DoubleType()))]))),
])


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON document per file -> (run_id, doc)."""
    raw = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    run = F.coalesce(F.nullif(F.regexp_extract(file, r"run_id=([^/]+)/", 1), F.lit("")),
                     F.regexp_extract(file, r"([^/]+?)(?:\.[^/.]*)*$", 1))
    return raw.select(run.alias("run_id"), F.col("value").alias("doc"))


def sampled_json(docs: DataFrame) -> DataFrame:
    """Shared frame table plus samples as frame-index lists; a missing weight is 1; profiles are merged."""
    d = docs.select("run_id", F.from_json("doc", _SAMPLED).alias("d"))
    names = F.transform("d.shared.frames", lambda f: F.coalesce(F.nullif(f["name"], F.lit("")), F.lit("[unknown]")))
    sampled = F.filter("d.profiles", lambda p: p["type"] == "sampled")
    prof = d.select("run_id", names.alias("names"), sampled.alias("ps")).select(
        "run_id", "names", F.explode_outer("ps").alias("p"))  # the outer form, as the plain one would have the document parsed again

    def stack(ix: Column, i: Column) -> Column:
        known = F.filter(ix, lambda k: (k >= 0) & (k < F.size("names")))
        return F.struct(F.transform(known, lambda k: F.get("names", k)).alias("frames"),
                        F.coalesce(F.get("p.weights", i), F.lit(1.0)).cast("long").alias("weight"))

    # Names are looked up before samples become rows: a row for each sample would carry the whole frame table.
    stacks = F.transform("p.samples", stack)
    return prof.select("run_id", F.explode(stacks).alias("s")).select("run_id", "s.frames", "s.weight").where(F.size("frames") > 0)


# The parts of a parent-linked profile that are read; other fields of the file are not parsed.
_LINKED = ("nodes array<struct<id:long,callFrame:struct<functionName:string,url:string,lineNumber:long>,children:array<long>>>, "
           "samples array<long>, timeDeltas array<string>")


def linked_json(docs: DataFrame) -> DataFrame:
    """Node tree plus leaf ids -> stacks. A sample weighs the time until the next one, else 1.

    Nodes and their children become tables; paths to the root are grown by doubling (a node's path joins the path of where
    it ends), so a tree of depth d takes log2(d) joins. Nodes without a root above them have no stack.
    """
    parsed = docs.select("run_id", F.xxhash64("run_id", "doc").alias("file"), F.from_json("doc", _LINKED).alias("d"))
    node = parsed.select("file", F.posexplode("d.nodes").alias("at", "n")).select("file", "at", "n.*")
    name, url = (F.coalesce(F.col(f"callFrame.{k}"), F.lit("")) for k in ("functionName", "url"))
    source = F.concat(name, F.lit(" ("), F.element_at(F.split(url, "/"), -1), F.lit(":"), F.coalesce("callFrame.lineNumber", F.lit(0)), F.lit(")"))
    label = F.when(name == "", "(anonymous)").when(url.contains("/") & ~url.startswith("node:"), source).otherwise(name)
    named = node.groupBy("file", "id").agg(F.max_by(label, "at").alias("frame"))
    above = node.select("file", "at", F.col("id").alias("up"), F.explode("children").alias("id")).groupBy("file", "id").agg(F.max_by("up", "at").alias("up"))
    known = named.select("file", F.col("id").alias("up"), F.lit(True).alias("known"))
    up = above.join(known, ["file", "up"]).select("file", "id", "up")  # a parent that is no node ends a path
    size = named.groupBy("file").agg(F.count("*").alias("n"))
    paths = cut(named.join(up, ["file", "id"], "left").join(size, "file").select("file", "id", "up", "n", F.array("frame").alias("frames")))
    while True:
        ends = paths.select("file", F.col("id").alias("up"), F.col("up").alias("top"), F.col("frames").alias("more"))
        if paths.where("up is not null").isEmpty():
            break
        grown = paths.where("up is not null").join(ends, ["file", "up"]).select(
            "file", "id", F.col("top").alias("up"), "n", F.concat("more", "frames").alias("frames"))
        # A path longer than the file's nodes goes round in a circle and never reaches a root.
        paths = cut(paths.where("up is null").unionByName(grown.where(F.size("frames") <= F.col("n"))))
    delta = F.expr("try_cast(x.delta as bigint)")
    sampled = parsed.select("run_id", "file", F.explode(F.arrays_zip(
        F.col("d.samples").alias("leaf"), F.expr("slice(coalesce(d.timeDeltas, array()), 2, greatest(size(d.timeDeltas), 1))").alias("delta"))).alias("x"))
    weight = sampled.where("x.leaf is not null").groupBy("run_id", "file", F.col("x.leaf").alias("id")).agg(
        F.sum(F.when(delta > 0, delta).otherwise(1)).cast("long").alias("weight"))
    kept = F.filter("frames", lambda f: ~f.isin(_SYNTHETIC))
    return weight.join(paths, ["file", "id"]).select("run_id", kept.alias("frames"), "weight").where(F.size("frames") > 0)


# The names collectors give their profile layouts.
LINE_FORMATS = {"perf": text_stacks, "collapsed": collapsed_stacks, "phpspy": depth_stacks}
DOCUMENT_FORMATS = {"speedscope": sampled_json, "cpuprofile": linked_json}


def read_profiles(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    """Profiler files of one layout -> stacks. A text profile's unit is samples, microseconds for off-CPU stacks."""
    if fmt in LINE_FORMATS:
        return LINE_FORMATS[fmt](read_lines(spark, path))
    if fmt in DOCUMENT_FORMATS:
        return DOCUMENT_FORMATS[fmt](documents(spark, path))
    raise ValueError(f"unknown profile format {fmt!r}: one of {sorted([*LINE_FORMATS, *DOCUMENT_FORMATS])}")
