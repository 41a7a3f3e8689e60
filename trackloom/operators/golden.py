"""Recorded runs as references: trees of fingerprints of ranges of frames, and what differs between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.operators import intervals

#: Frames of the smallest range, and ranges that one range of the next level holds.
RANGE, FAN = 256, 64
#: Differing ranges up to which they are named in the filter of the scan.
NAMED = 4096


def fingerprint(*values: Column) -> tuple[Column, ...]:
    """Two aggregates that do not depend on the order of rows: the sum of hashes and their exclusive or."""
    h = F.xxhash64(*values)
    return F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(7), h)).alias("mixed"), F.count(F.lit(1)).alias("rows")


def tree(rows: DataFrame) -> DataFrame:
    """video, level, node, total, mixed and rows of the ranges of each level; rows: video, frame and any values.

    Level 0 holds RANGE frames a node, each level above FAN nodes of the one below, up to one node a video.  The rows
    are read once; upper levels are sums of the few nodes below.
    """
    values = [c for c in rows.columns if c not in ("video", "frame")]
    ranges = rows.groupBy("video", F.expr(f"frame div {RANGE}").alias("node")).agg(*fingerprint("video", "frame", *values))
    level = cut(ranges.select("video", F.lit(0).alias("level"), "node", "total", "mixed", "rows"))
    most, out, k = level.agg(F.max("node")).first()[0] or 0, level, 0
    while most:
        k, most = k + 1, most // FAN
        level = level.groupBy("video", F.lit(k).alias("level"), F.expr(f"node div {FAN}").alias("node")).agg(
            F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"), F.sum("rows").alias("rows"))
        out = out.unionByName(level)
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """video and node of the ranges of level 0 whose fingerprints differ, or that one tree lacks.

    Levels are compared from the top; only children of nodes that differ are compared further.
    """
    a, b = cut(a), cut(b)
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (a, b))
    wanted = None
    for k in range(top, -1, -1):
        x, y = (t.filter(F.col("level") == k).select("video", "node", F.struct("total", "mixed", "rows").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if wanted is not None:
            under = [F.col("video"), F.expr(f"node div {FAN}").alias("parent")]
            x, y = (t.select(*under, "node", name).join(wanted, ["video", "parent"], "left_semi").drop("parent") for t, name in ((x, "x"), (y, "y")))
        apart = cut(x.join(y, ["video", "node"], "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("video", "node"))
        if apart.isEmpty():
            break
        wanted = apart.withColumnRenamed("node", "parent")
    return apart


def record(rows: DataFrame, folder: str) -> None:
    """A run's rows by ranges of frames, and their tree: folder/rows and folder/tree; refuses what is there."""
    own = cut(rows)
    own.withColumn("node", F.expr(f"frame div {RANGE}")).repartition("video", "node").write.partitionBy("node").mode("errorifexists").parquet(f"{folder}/rows")
    tree(own).write.mode("errorifexists").parquet(f"{folder}/tree")


def recorded_rows(spark: SparkSession, folder: str, ranges: DataFrame) -> DataFrame:
    """Rows of the recorded ranges (video, node) only: few of them prune the scan by name, more are joined."""
    rows = spark.read.parquet(f"{folder}/rows")
    if ranges.limit(NAMED + 1).count() <= NAMED:
        nodes = [r["node"] for r in ranges.select("node").distinct().collect()]
        rows = rows.filter(F.col("node").isin(nodes))
    return rows.join(ranges, ["video", "node"], "left_semi").drop("node")


def differing_frames(spark: SparkSession, a: str, b: str) -> DataFrame:
    """video, frame of two recordings where their rows differ, as sets with repeats; equal ranges are not read."""
    ranges = cut(differing(spark.read.parquet(f"{a}/tree"), spark.read.parquet(f"{b}/tree")))
    return unequal(*(recorded_rows(spark, f, ranges) for f in (a, b)))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """video, frame where the rows of two tables of equal columns differ, as sets with repeats."""
    sides = [p.groupBy("video", "frame").agg(*fingerprint(*sorted(p.columns))).select("video", "frame", F.struct("total", "mixed", "rows").alias(n)) for p, n in zip((a, b), "xy")]
    return sides[0].join(sides[1], ["video", "frame"], "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("video", "frame")


def first_gaps(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """video, gap (the first column of these that differs somewhere) and frame (where it does first) of two tables of
    frames; no row for videos whose inputs agree.  A frame that one side lacks differs in every column."""
    names = [*columns]
    both = a.select("video", "frame", F.struct(*names).alias("x")).join(b.select("video", "frame", F.struct(*names).alias("y")), ["video", "frame"], "full_outer")
    apart = lambda c: F.col("x").isNull() | F.col("y").isNull() | ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    firsts = both.groupBy("video").agg(*(F.min(F.when(apart(c), F.col("frame"))).alias(c) for c in names))
    found = F.filter(F.array(*(F.struct(F.lit(c).alias("gap"), F.col(c).alias("frame")) for c in names)), lambda s: s["frame"].isNotNull())
    return firsts.select("video", F.get(found, F.lit(0)).alias("one")).filter("one IS NOT NULL").select("video", "one.gap", "one.frame")


def verdicts(videos: DataFrame, gaps: DataFrame, frames: DataFrame, damaged: DataFrame, listed: int = 10) -> DataFrame:
    """Per video how two runs compare: verdict (inputs differ, differs, same), gap, inside and outside (differing frames
    in damaged spans and elsewhere), firsts (the first of those outside) and more, spans and damaged_frames.

    frames: differing frames; damaged: spans of the reference.  Frames inside damaged spans may differ in a same run.
    """
    hidden = intervals.inside(frames, damaged, ["video"]).distinct().withColumn("in_span", F.lit(True))
    rows = frames.distinct().join(hidden, ["video", "frame"], "left")
    out = F.col("in_span").isNull()
    apart = rows.groupBy("video").agg(F.count_if(~out).alias("inside"), F.count_if(out).alias("outside"))
    first = _least(rows.filter(out), listed)
    spans = damaged.groupBy("video").agg(F.count(F.lit(1)).alias("spans")).join(intervals.covered_frames(damaged, ["video"]).withColumnRenamed("frames", "damaged_frames"), "video")
    joined = videos.select("video").distinct().join(gaps.select("video", "gap", F.col("frame").alias("gap_frame")), "video", "left").join(apart, "video", "left").join(
        first, "video", "left").join(spans, "video", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    verdict = F.when(F.col("gap").isNotNull(), "inputs differ").when(F.coalesce("outside", F.lit(0)) > 0, "differs").otherwise("same")
    return joined.select("video", verdict.alias("verdict"), "gap", "gap_frame", zero("inside"), zero("outside"), F.coalesce("firsts", F.lit("")).alias("firsts"),
                         F.greatest(F.coalesce("outside", F.lit(0)) - listed, F.lit(0)).alias("more"), zero("spans"), zero("damaged_frames"))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """Per video its n least frames as text; what a task holds of a video is cut to n before it is dealt."""
    part = rows.select("video", "frame", F.spark_partition_id().alias("part"))
    some = part.withColumn("k", F.row_number().over(Window.partitionBy("video", "part").orderBy("frame"))).filter(F.col("k") <= n)
    best = some.withColumn("k", F.row_number().over(Window.partitionBy("video").orderBy("frame"))).filter(F.col("k") <= n)
    return best.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list("frame")), lambda f: f.cast("string")), ",").alias("firsts"))
