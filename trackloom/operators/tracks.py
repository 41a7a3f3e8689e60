"""Measures of tracks: rows (track, frame, x, y, ...) with one point per track and frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():
    """The points of a track in order of frames."""
    return Window.partitionBy("track").orderBy("frame")


def distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def stepped(points: DataFrame) -> DataFrame:
    """points with the step from the point before: dx, dy, df (null at the first)."""
    return points.select("*", *((F.col(c) - F.lag(c).over(order())).alias(n) for c, n in (("x", "dx"), ("y", "dy"), ("frame", "df"))))


def path_lengths(points: DataFrame) -> DataFrame:
    return stepped(points).groupBy("track").agg(
        F.round(F.coalesce(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.lit(0.0)), 6).alias("path"))


def chords(points: DataFrame) -> DataFrame:
    """The distance of a track's first and last point."""
    ends = points.groupBy("track").agg(F.min(F.struct("frame", "x", "y")).alias("a"), F.max(F.struct("frame", "x", "y")).alias("b"))
    return ends.select("track", F.round(distance("a.x", "a.y", "b.x", "b.y"), 6).alias("chord"))


def median_turns(points: DataFrame) -> DataFrame:
    """The median of the absolute turns between non-zero steps, between -pi and pi; 0 if there are none."""
    moved = stepped(points).filter("dx <> 0 OR dy <> 0").withColumn("heading", F.atan2("dy", "dx"))
    turn = F.col("heading") - F.lag("heading").over(order())
    turns = moved.select("track", F.abs(F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi).alias("turn"))
    medians = turns.groupBy("track").agg(F.percentile("turn", F.lit(0.5)).alias("turn"))
    return points.select("track").distinct().join(medians, "track", "left").select(
        "track", F.round(F.coalesce("turn", F.lit(0.0)), 6).alias("turn"))


def filled(points: DataFrame) -> DataFrame:
    """points with those between, interpolated along straight lines; amplitude 0 and interpolated true there."""
    fields = ["x", "y", "width", "height"]
    ahead = points.select("track", "frame", "amplitude", *fields, *(F.lead(c).over(order()).alias(f"n_{c}") for c in ["frame", *fields]))
    steps = F.coalesce(F.col("n_frame") - F.col("frame"), F.lit(1))
    spread = ahead.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1))).withColumn("steps", steps)
    at = lambda c: F.when(F.col("k") == 0, F.col(c)).otherwise(
        F.col(c) + (F.col(f"n_{c}") - F.col(c)) * F.col("k") / F.col("steps"))
    return spread.select("track", (F.col("frame") + F.col("k")).alias("frame"), *(F.round(at(c), 6).alias(c) for c in fields),
                         F.when(F.col("k") == 0, F.col("amplitude")).otherwise(0.0).alias("amplitude"), (F.col("k") > 0).alias("interpolated"))


def filled_counts(points: DataFrame) -> DataFrame:
    """The frames within each track's span that have no point."""
    return points.groupBy("track").agg((F.max("frame") - F.min("frame") + 1 - F.count(F.lit(1))).alias("filled_frames"))


def clamped(points: DataFrame, times: float = 4.0) -> DataFrame:
    """Boxes no wider or higher than so many times the track's median, about the same centre."""
    rows = points.select("*", *((times * F.percentile(c, F.lit(0.5)).over(Window.partitionBy("track"))).alias(f"most_{c}") for c in ("width", "height")))
    return rows.select("track", "frame", *(F.least(F.col(c), F.col(f"most_{c}")).alias(c) for c in ("width", "height")),
                       (F.col("x") - F.least("width", "most_width") / 2).alias("left"), (F.col("y") - F.least("height", "most_height") / 2).alias("top"))


def trails(points: DataFrame, frames: int) -> DataFrame:
    """The centres of the last `frames` frames before each point, in order."""
    back = Window.partitionBy("track").orderBy("frame").rangeBetween(-frames, -1)
    trail = F.transform(F.collect_list(F.struct("frame", "x", "y")).over(back), lambda p: F.concat_ws(
        ",", F.floor(p["x"]).cast("long"), F.floor(p["y"]).cast("long")))
    return points.select("track", "frame", F.array_join(trail, " ").alias("trail"))


def velocities(points: DataFrame, back: int = 3) -> DataFrame:
    """Speed per frame of each point from the latest one at least so many frames before, else from the one before."""
    history = F.collect_list(F.struct("frame", "x", "y")).over(Window.partitionBy("track").orderBy("frame").rowsBetween(-2 * back, -1))
    # frames grow by 1 at least: the latest point `back` frames before is among the last 2 * back ones or else the first of them
    rows = points.withColumn("history", history).withColumn("far", F.filter("history", lambda p: p["frame"] <= F.col("frame") - back))
    origin = F.when(F.size("far") > 0, F.element_at("far", -1)).otherwise(F.try_element_at("history", F.lit(-1)))
    rows = rows.withColumn("o", origin).filter("o IS NOT NULL")
    return rows.select("track", "frame", *(F.round((F.col(c) - F.col("o")[c]) / (F.col("frame") - F.col("o")["frame"]), 6).alias(f"v{c}") for c in "xy"))


def tail_speeds(points: DataFrame, tail: int = 5, slump: float = 0.4) -> DataFrame:
    """The current speed of each point (see velocities), the speed over its last `tail` points or all there
    are, and the trusted one: the tail's where the current one has slumped below a share of it."""
    first = Window.partitionBy("track").orderBy("frame").rowsBetween(-(tail - 1), 0)
    rows = points.select("track", "frame", "x", "y", *(F.first(c).over(first).alias(f"{c}0") for c in ("x", "y", "frame")))
    rows = rows.filter("frame > frame0").join(velocities(points), ["track", "frame"])
    rows = rows.withColumn("now", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).withColumn(
        "tail", distance("x", "y", "x0", "y0") / (F.col("frame") - F.col("frame0")))
    trusted = F.when(F.col("now") < slump * F.col("tail"), F.col("tail")).otherwise(F.col("now"))
    return rows.select("track", "frame", F.round("now", 6).alias("now"), F.round("tail", 6).alias("tail"), F.round(trusted, 6).alias("trusted"))


def end_velocities(points: DataFrame, most: int = 5) -> DataFrame:
    """Velocities over the first and over the last points of a track, at most so many; null for one point."""
    rows = points.withColumn("head", F.row_number().over(order())).withColumn("tail", F.row_number().over(
        Window.partitionBy("track").orderBy(F.desc("frame"))))
    point = F.struct("frame", "x", "y")
    ends = rows.groupBy("track").agg(*(f(F.when(F.col(side) <= most, point)).alias(f"{side}_{n}")
                                       for side in ("head", "tail") for n, f in (("a", F.min), ("b", F.max))))
    velocity = lambda s, c: F.when(F.col(f"{s}_b")["frame"] > F.col(f"{s}_a")["frame"], F.round(
        (F.col(f"{s}_b")[c] - F.col(f"{s}_a")[c]) / (F.col(f"{s}_b")["frame"] - F.col(f"{s}_a")["frame"]), 6))
    return ends.select("track", *(velocity(s, c).alias(f"{s}_v{c}") for s in ("head", "tail") for c in "xy"))


def numbered(points: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks of each key numbered from 1 by their first frame, the x there, and the old name."""
    firsts = points.groupBy(*keys, "track").agg(F.min(F.struct("frame", "x")).alias("one"))
    order = Window.partitionBy(*keys).orderBy("one.frame", "one.x", "track")
    return firsts.select(*keys, "track", F.row_number().over(order).cast("long").alias("id"))


def parts(tracks: DataFrame, keys: list[str], order: list[str], most: int = 20) -> DataFrame:
    """Parts of nearly equal size, at most so many tracks each: ceil(n / ceil(n / most)) per part."""
    rows = tracks.select("*", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("at"),
                         F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    size = F.ceil(F.col("n") / F.ceil(F.col("n") / most))
    return rows.select(*tracks.columns, F.floor(F.col("at") / size).cast("long").alias("part"))


def arc_lengths(points: DataFrame, *kept: str) -> DataFrame:
    """The length of the path up to each point: track, frame, length and the columns to be kept."""
    along = order().rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.0))
    return stepped(points).select("track", "frame", F.round(F.sum(step).over(along), 6).alias("length"), *kept)


def resampled(points: DataFrame, step: float, digits: int = 3) -> DataFrame:
    """Points every so many pixels along each path."""
    lengths = arc_lengths(points).join(points.select("track", "frame", "x", "y"), ["track", "frame"])
    ahead = lengths.select("*", *(F.lead(c).over(order()).alias(f"n_{c}") for c in ("length", "x", "y"))).filter("n_length > length")
    first, last = F.ceil(F.col("length") / step), F.ceil(F.col("n_length") / step) - 1
    spread = ahead.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("length")) / (F.col("n_length") - F.col("length"))
    return spread.select("track", "k", *(F.round(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * share, digits).alias(c) for c in ("x", "y")))


def measured(points: DataFrame, rate: float) -> DataFrame:
    """A row per track: times, hits, chord, path, speed, largest area, peak amplitude, filled frames."""
    base = points.groupBy("track").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count(F.lit(1)).alias("hits"),
        F.round(F.max("area")).cast("long").alias("max_area"), F.max("amplitude").alias("peak_amplitude"))
    rows = base.join(chords(points), "track").join(path_lengths(points), "track")
    seconds = F.greatest((F.col("f1") - F.col("f0")) / F.lit(rate), F.lit(1 / rate))
    return rows.select("track", clock(F.col("f0") / F.lit(rate)).alias("start"), clock(F.col("f1") / F.lit(rate)).alias("end"),
                       F.round(seconds, 6).alias("duration_s"), "hits", "chord", "path", F.round(F.col("path") / seconds, 2).alias("speed"),
                       "max_area", "peak_amplitude", (F.col("f1") - F.col("f0") + 1 - F.col("hits")).alias("filled_frames"),
                       F.round(F.col("f0") / F.lit(rate), 2).alias("start_s"))


def combined(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of one key as one: area-weighted centre, hull of the boxes, sum of areas, strongest of the rest."""
    weighted = lambda c: F.sum(F.col(c) * F.col("area")) / F.sum("area")
    low = lambda c, s: F.min(F.col(c) - F.col(s) / 2)
    high = lambda c, s: F.max(F.col(c) + F.col(s) / 2)
    return points.groupBy(*keys).agg(
        F.round(weighted("x"), 6).alias("x"), F.round(weighted("y"), 6).alias("y"), low("x", "width").alias("left"), low("y", "height").alias("top"),
        (high("x", "width") - low("x", "width")).alias("width"), (high("y", "height") - low("y", "height")).alias("height"),
        F.sum("area").alias("area"), F.max("amplitude").alias("amplitude"),
        F.when(F.bool_or(F.col("strength") == "strong"), "strong").otherwise("weak").alias("strength"))


def kept(points: DataFrame, min_hits: int = 6, min_travel: float = 45.0, most_turn: float = 0.8) -> DataFrame:
    """Per track its hits, chord and median turn, and whether it is kept: all bounds are inclusive."""
    hits = points.groupBy("track").agg(F.count(F.lit(1)).alias("hits"))
    rows = hits.join(chords(points), "track").join(median_turns(points), "track")
    return rows.select("*", ((F.col("hits") >= min_hits) & (F.col("chord") >= min_travel) & (F.col("turn") <= most_turn)).alias("kept"))


def zoom_wanted(points: DataFrame, part: Column, area: float = 100.0, amplitude: float = 40.0) -> DataFrame:
    """Whether any part of a track stays below the area or the amplitude."""
    per_part = points.groupBy("track", part.alias("part")).agg(F.max("area").alias("area"), F.max("amplitude").alias("amplitude"))
    return per_part.groupBy("track").agg(F.bool_or((F.col("area") < area) | (F.col("amplitude") < amplitude)).alias("wanted"))


def edge_distance(width: float, height: float) -> Column:
    return F.least(F.col("x"), F.lit(width) - F.col("x"), F.col("y"), F.lit(height) - F.col("y"))


def periods(tracks: DataFrame, keys: list[str], start: Column, length: Column, seconds: int = 600) -> DataFrame:
    """Tracks per tumbling period of a recording; empty periods count 0 and the last one takes what lies beyond.

    tracks: keys, with start (of each track) and length (of the recording, the same on all rows of a key).
    """
    rows = tracks.select(*keys, start.alias("start"), length.alias("length"))
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / seconds)).cast("long")
    every = rows.groupBy(*keys).agg(F.max("length").alias("length")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("period"))
    placed = rows.select(*keys, F.least(F.floor(F.col("start") / seconds).cast("long"), count - 1).alias("period"))
    counts = placed.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("tracks"))
    return every.join(counts, [*keys, "period"], "left").select(*keys, "period", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def clock(seconds: Column) -> Column:
    """h:mm:ss, rounded down, not below 0."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def prediction_error(points: DataFrame) -> DataFrame:
    """How far each point is from where the step before it led, with the reach that a gate grants there."""
    rows = stepped(points)
    rows = rows.select("*", *(F.lag(c).over(order()).alias(f"p_{c}") for c in ("x", "y", "dx", "dy", "df"))).filter("p_df IS NOT NULL")
    ahead = lambda c: F.col(f"p_{c}") + F.col(f"p_d{c}") / F.col("p_df") * F.col("df")
    rows = rows.withColumn("ax", ahead("x")).withColumn("ay", ahead("y"))
    travel = F.sqrt(F.col("p_dx") * F.col("p_dx") + F.col("p_dy") * F.col("p_dy")) / F.col("p_df") * F.col("df")
    return rows.select("track", "frame", F.round(distance("x", "y", "ax", "ay"), 6).alias("miss"), F.round(50 + travel, 6).alias("reach"))
