"""Frames in time: steps between time stamps, jumps, lost frames, damage and crowding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.operators.intervals import merged, outside


def _rounded(x: Column) -> Column:
    return F.round(x).cast("long")


def steps(frames: DataFrame) -> DataFrame:
    """Between consecutive frames with known pts: video, frame (the later), frames and ticks between them."""
    order = Window.partitionBy("video").orderBy("frame")
    known = frames.filter(F.col("pts").isNotNull())
    out = known.select("video", "frame", (F.col("frame") - F.lag("frame").over(order)).alias("frames"),
                       (F.col("pts") - F.lag("pts").over(order)).alias("ticks"))
    return out.filter(F.col("frames").isNotNull())


def middles(rows: DataFrame, value: Column, first: str = "lower", second: str = "upper") -> DataFrame:
    """Per video the lower and the upper median of a value (the same one of an odd number of rows).

    Rows are counted by value before they meet, so that a video of any length is a few counts.
    """
    counts = rows.groupBy("video", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    along, every = Window.partitionBy("video").orderBy("value"), Window.partitionBy("video")
    placed = counts.select("video", "value", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(every).alias("rows"))
    at = lambda place: F.min(F.when(F.col("upto") >= F.expr(place), F.col("value")))
    return placed.groupBy("video").agg(at("(rows + 1) div 2").alias(first), at("rows div 2 + 1").alias(second))


def step_of(rows: DataFrame) -> DataFrame:
    """Per video the ticks of a frame, from the rows of steps(): the upper median of ticks per frame, then the mean
    over the intervals that round to their own number of frames by it."""
    middle = middles(rows, F.col("ticks") / F.col("frames"), "lower", "median")
    kept = rows.join(middle, "video").withColumn(
        "fits", _rounded(F.col("ticks") / F.col("median")) == F.col("frames"))
    return kept.groupBy("video").agg(
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("ticks"))) / F.sum(F.when(F.col("fits"), F.col("frames"))),
                   F.first("median")).alias("step"))


def typical_step(frames: DataFrame) -> DataFrame:
    """Per video the ticks of a frame; see step_of()."""
    return step_of(cut(steps(frames)))


def jumps(frames: DataFrame) -> DataFrame:
    """Frames after an interval that spans more frames of time than frames: video, frame, lost."""
    own = cut(steps(frames))
    rows = own.join(step_of(own), "video")
    spanned = _rounded(F.col("ticks") / F.col("step"))
    return rows.select("video", "frame", (spanned - F.col("frames")).alias("lost")).filter("lost > 0")


def frame_seconds(frames: DataFrame, ticks_per_second: float, rate: float) -> DataFrame:
    """Seconds of each frame: by the last known pts, carried on at the frame rate; before any by the rate alone."""
    order = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("pts").isNotNull(), F.col("frame")), ignorenulls=True).over(order)
    pts = F.last("pts", ignorenulls=True).over(order)
    return frames.select("video", "frame", F.round(F.coalesce(
        pts / F.lit(ticks_per_second) + (F.col("frame") - known) / F.lit(rate), F.col("frame") / F.lit(rate)), 6).alias("seconds"))


def before_first(frames: DataFrame, start: int) -> DataFrame:
    """Frames lost before the first known one, by its pts and the typical step, not below 0."""
    first = frames.filter(F.col("pts").isNotNull()).groupBy("video").agg(F.min(F.struct("frame", "pts")).alias("one"))
    lost = _rounded((F.col("one")["pts"] - start) / F.col("step")) - F.col("one")["frame"]
    return first.join(typical_step(frames), "video").select("video", F.greatest(lost, F.lit(0)).alias("lost"))


def last_key_before(frames: DataFrame) -> DataFrame:
    """For every frame the last key frame at or before it that is not itself damaged (null: none)."""
    order = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    clean = F.when(F.col("key_frame") & ~F.col("decode_error"), F.col("frame"))
    return frames.select("video", "frame", F.last(clean, ignorenulls=True).over(order).alias("key"))


def until_next_key(frames: DataFrame) -> DataFrame:
    """For every frame the last frame before the next key frame, or of the video.

    Frames are read from the last one back, so that a window only grows: one that shrinks is worked out anew for each row.
    """
    back = Window.partitionBy("video").orderBy(F.desc("frame"))
    following = F.min(F.when(F.col("key_frame"), F.col("frame"))).over(back.rangeBetween(Window.unboundedPreceding, -1))
    last = F.max("frame").over(back.rowsBetween(Window.unboundedPreceding, 0))
    return frames.select("video", "frame", F.coalesce(following - 1, last).alias("until"))


def damaged_spans(frames: DataFrame, half_window: int, losses: DataFrame | None = None) -> DataFrame:
    """Unions of the spans that damage reaches: from an error or a jump to the next key frame, widened by
    half a window and clipped to the video.

    losses (video, before_first, after_last: frames that no decoder gave) are damage too: what is lost before
    the first frame begins at it, what is lost after the last one half a window before the end.
    """
    starts = frames.filter("decode_error").select("video", "frame").union(jumps(frames).select("video", "frame"))
    ends = frames.groupBy("video").agg(F.max("frame").alias("end"))
    if losses is not None:
        starts = starts.union(losses.filter("before_first > 0").select("video", F.lit(0).cast("bigint").alias("frame")))
    spans = starts.distinct().join(until_next_key(frames), ["video", "frame"]).join(ends, "video").select(
        "video", F.greatest(F.lit(0), F.col("frame") - half_window).alias("first"),
        F.least(F.col("until") + half_window, F.col("end")).alias("last"))
    if losses is not None and half_window:
        spans = spans.union(ends.join(losses.filter("after_last > 0"), "video").select(
            "video", F.greatest(F.lit(0), F.col("end") + 1 - half_window).alias("first"), F.col("end").alias("last")))
    return merged(spans, ["video"])


def reconciled(frames: DataFrame, announced: DataFrame) -> DataFrame:
    """Per video the frames lost before the first, at jumps and after the last, and whether what was announced less
    these is what was decoded.

    announced: video, announced, start (the first pts of the container, null: unknown), after_last.
    """
    rows = cut(frames)
    first = rows.filter(F.col("pts").isNotNull()).groupBy("video").agg(F.min(F.struct("frame", "pts")).alias("one"))
    before = first.join(typical_step(rows), "video").select("video", "one", "step")
    counted = rows.groupBy("video").agg(F.count(F.lit(1)).alias("decoded"))
    lost = jumps(rows).groupBy("video").agg(F.sum("lost").alias("at_jumps"))
    all_ = announced.join(counted, "video").join(before, "video", "left").join(lost, "video", "left")
    early = F.greatest(_rounded((F.col("one.pts") - F.col("start")) / F.col("step")) - F.col("one.frame"), F.lit(0))
    out = all_.select("video", "announced", "decoded", F.coalesce(early, F.lit(0)).alias("before_first"), F.coalesce("at_jumps", F.lit(0)).alias("at_jumps"), "after_last")
    return out.withColumn("explained", F.col("announced") - F.col("before_first") - F.col("at_jumps") - F.col("after_last") == F.col("decoded"))


def first_unordered(frames: DataFrame) -> DataFrame:
    """Per video the first frame whose pts is not above that of the known frame before it; no row where all are."""
    order = Window.partitionBy("video").orderBy("frame")
    known = frames.filter(F.col("pts").isNotNull()).select("video", "frame", (F.col("pts") <= F.lag("pts").over(order)).alias("late"))
    return known.filter("late").groupBy("video").agg(F.min("frame").alias("frame"))


def frames_of_pts(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """video, pts and frame of the wanted time stamps (video, pts); a video of unordered pts is an error when one of
    its rows is read."""
    order = Window.partitionBy("video").orderBy("frame")
    known = frames.filter(F.col("pts").isNotNull()).select("video", "frame", "pts", F.lag("pts").over(order).alias("before"))
    checked = known.select("video", "frame", F.when(F.coalesce(F.col("pts") > F.col("before"), F.lit(True)), F.col("pts")).otherwise(
        F.raise_error(F.concat(F.lit("pts do not grow at frame "), "frame", F.lit(" of video "), "video")).cast("bigint")).alias("pts"))
    return checked.join(wanted.select("video", "pts"), ["video", "pts"]).select("video", "pts", "frame")


def reported_frames(frames: DataFrame) -> DataFrame:
    """Per video how many frames are in error or follow a jump, each once."""
    return frames.filter("decode_error").select("video", "frame").union(jumps(frames).select("video", "frame")).groupBy(
        "video").agg(F.countDistinct("frame").alias("reported"))


def unstable_spans(frames: DataFrame, detections: DataFrame, damaged: DataFrame, max_blobs: int = 20, pad: int = 30) -> DataFrame:
    """Spans around frames with too many detections, judged on readable frames only.

    The limit is max_blobs and three times the sum of the two middle counts (of one, twice itself);
    a crowded frame reaches pad frames both ways, clipped to the readable hull.
    """
    readable = outside(frames.select("video", "frame"), damaged, ["video"])
    counts = detections.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n"))
    per_frame = cut(readable.join(counts, ["video", "frame"], "left").select("video", "frame", F.coalesce("n", F.lit(0)).alias("n")))
    middle = middles(per_frame, F.col("n"))
    hull = per_frame.groupBy("video").agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    limits = middle.join(hull, "video").select("video", "low", "high", (max_blobs + 3 * (F.col("lower") + F.col("upper"))).alias("limit"))
    # one row per video
    crowded = per_frame.join(limits, "video").filter("n >= limit")
    spans = crowded.select("video", F.greatest("low", F.col("frame") - pad).alias("first"),
                           F.least("high", F.col("frame") + pad).alias("last"))
    return merged(spans, ["video"])


def ignored_spans(damaged: DataFrame, unstable: DataFrame) -> DataFrame:
    """The union of both kinds of spans."""
    return merged(damaged.select("video", "first", "last").union(unstable.select("video", "first", "last")), ["video"])


def pieces(frames: DataFrame, damaged: DataFrame) -> DataFrame:
    """Stretches of frames of one state: damaged or not, with or without pts."""
    state = F.concat_ws("/", F.when(F.col("bad"), "damaged").otherwise("clean"), F.when(F.col("pts").isNull(), "unknown").otherwise("known"))
    clean = outside(frames.select("video", "frame"), damaged, ["video"]).withColumn("ok", F.lit(True))
    order = Window.partitionBy("video").orderBy("frame")
    rows = frames.join(clean, ["video", "frame"], "left").withColumn("bad", F.col("ok").isNull()).withColumn("state", state)
    begins = F.coalesce(F.col("state") != F.lag("state").over(order), F.lit(True)).cast("long")
    island = rows.withColumn("begins", begins).withColumn("piece", F.sum("begins").over(order))
    return island.groupBy("video", "piece", "state").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def order_faults(frames: DataFrame) -> DataFrame:
    """Frames whose pts does not grow, or whose number does not follow the one before: late data are errors."""
    order = Window.partitionBy("video").orderBy("frame")
    known = F.last("pts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = frames.select("video", "frame", (F.col("pts") <= known).alias("late"),
                         (F.col("frame") - F.lag("frame").over(order) != 1).alias("missing"))
    return rows.select("video", "frame", F.coalesce("late", F.lit(False)).alias("late"),
                       F.coalesce("missing", F.lit(False)).alias("missing")).filter("late OR missing")


def sample_ranks(n: Column, count: int) -> Column:
    """Frames at the middles of `count` equal parts of n: (2 i + 1) n div (2 count), each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor((2 * i + 1) * n / (2 * count)).cast("long")))
