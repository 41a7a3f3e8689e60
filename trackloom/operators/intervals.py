"""Closed intervals of frames: union, gap-tolerant union, exclusion, containment, hulls.

Spans are rows of the key columns with first and last, both inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames per block; the equality key of range joins.
BLOCK = 1024
#: Spans of more frames are dealt as aligned runs of blocks, not block by block.
LONG = 64 * BLOCK


def merged(spans: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Unions of spans that overlap, touch, or lie at most pad frames apart; with the number of members."""
    order = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.col("first") > F.max("last").over(order) + pad + 1, F.lit(True))
    island = spans.withColumn("begins", begins.cast("long")).withColumn("island", F.sum("begins").over(along))
    return island.groupBy(*keys, "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("members")).drop("island")


def in_blocks(spans: DataFrame, size: int = BLOCK) -> DataFrame:
    """spans, one row for each block they touch."""
    return spans.withColumn("block", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"last div {size}"))))


def long_spans(spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None, list[int]]:
    """Spans as rows of at most LONG frames, aligned blocks of the longer ones, and the levels of these blocks.

    A longer span is its two ends, of less than a block each, and the blocks between them as at most two aligned
    runs of 2^level blocks for each level: 2 log n rows, however long it is.  Without long spans the blocks are None.
    """
    long = spans.filter(F.col("last") - F.col("first") >= LONG)
    if long.isEmpty():
        return spans, None, []
    # whole blocks from low up to, not including, high
    low, high = F.expr(f"(first + {BLOCK - 1}) div {BLOCK}"), F.expr(f"(last + 1) div {BLOCK}")
    sized = long.withColumn("low", low).withColumn("high", high)
    ends = [sized.withColumn("last", F.col("low") * BLOCK - 1), sized.withColumn("first", F.col("high") * BLOCK)]
    short = spans.filter(F.col("last") - F.col("first") < LONG)
    for end in ends:
        short = short.unionByName(end.filter("first <= last").select(*spans.columns))

    def runs(level):
        a, b = -F.call_function("shiftright", -F.col("low"), level), F.call_function("shiftright", F.col("high"), level)
        node = lambda at, there: F.when((a < b) & there, F.struct(level.alias("level"), at.alias("node")))
        return F.array(node(a, a.bitwiseAND(1) == 1), node(b - 1, b.bitwiseAND(1) == 1))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("high") - F.col("low") + 1)).cast("int"))
    dealt = sized.select(*spans.columns, F.explode(F.filter(F.flatten(F.transform(levels, runs)), lambda r: r.isNotNull())).alias("run")).select(*spans.columns, "run.*")
    # at most 63 numbers
    return short, dealt, [r["level"] for r in dealt.select("level").distinct().collect()]


def _probes(rows: DataFrame, levels: list[int]) -> DataFrame:
    """rows (with block), one for each level, with the run of 2^level blocks in which their block lies."""
    own = F.array(*(F.struct(F.lit(k).alias("level"), F.call_function("shiftright", F.col("block"), F.lit(k)).alias("node")) for k in levels))
    return rows.select("*", F.explode(own).alias("run")).select(*rows.columns, "run.*")


def _whole_blocks(rows: DataFrame, dealt: DataFrame, levels: list[int], keys: list[str]) -> DataFrame:
    """Keys and blocks of rows that a long span covers wholly."""
    blocks = rows.select(*keys, "block").distinct()
    return _probes(blocks, levels).join(dealt.select(*keys, "level", "node"), [*keys, "level", "node"], "left_semi").select(*keys, "block").distinct()


def _met(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str, how: str) -> DataFrame:
    short = in_blocks(spans.select(*keys, "first", "last"))
    on = [rows[k] == short[k] for k in [*keys, "block"]] + [rows[frame].between(short["first"], short["last"])]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(short, condition, how)


def outside(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Rows whose frame no span of their key covers: an anti-join on key and block, then the range."""
    short, dealt, levels = long_spans(spans.select(*keys, "first", "last"), keys)
    held = rows.withColumn("block", F.expr(f"{frame} div {BLOCK}"))
    if dealt is not None:
        held = held.join(_whole_blocks(held, dealt, levels, keys), [*keys, "block"], "left_anti").select(held.columns)
    return _met(held, short, keys, frame, "left_anti").drop("block")


def inside(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Rows whose frame some span of their key covers."""
    short, dealt, levels = long_spans(spans.select(*keys, "first", "last"), keys)
    held = rows.withColumn("block", F.expr(f"{frame} div {BLOCK}"))
    if dealt is None:
        return _met(held, short, keys, frame, "left_semi").drop("block")
    whole = _whole_blocks(held, dealt, levels, keys)
    there = held.join(whole, [*keys, "block"], "left_semi").select(held.columns)
    rest = held.join(whole, [*keys, "block"], "left_anti").select(held.columns)
    return there.unionByName(_met(rest, short, keys, frame, "left_semi")).drop("block")


def parted(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Rows whose frame a span of their key covers, and the others; every row is in one of the two."""
    return inside(rows, spans, keys, frame), outside(rows, spans, keys, frame)


def containing(rows: DataFrame, spans: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Rows with each span that contains their frame (columns of both; a row may meet several spans)."""
    short, dealt, levels = long_spans(spans, keys)
    held = rows.withColumn("block", F.expr(f"{frame} div {BLOCK}"))
    met = held.join(in_blocks(short), [*keys, "block"]).filter(F.col(frame).between(F.col("first"), F.col("last"))).drop("block")
    if dealt is None:
        return met
    # a row and a long span meet in one run of blocks, or at one of its ends
    return met.unionByName(_probes(held, levels).join(dealt, [*keys, "level", "node"]).drop("block", "level", "node"))


def widened(first: Column, last: Column, by: int) -> tuple[Column, Column]:
    """A span with so many frames on both sides, not below 0."""
    return F.greatest(F.lit(0), first - by), last + by


def intersection(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """What two spans share; empty where its first is above its last."""
    return F.greatest(a[0], b[0]), F.least(a[1], b[1])


def hull(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def covered_frames(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the frames that its spans cover, each once: the lengths of their union."""
    return merged(spans, keys).groupBy(*keys).agg(F.sum(F.col("last") - F.col("first") + 1).alias("frames"))
