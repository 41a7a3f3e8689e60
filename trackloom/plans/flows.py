"""Whole runs made of the operators: detection, exclusion, tracking with twins and rejoining, and evaluation.

Tables: frames (video, frame, pts, key_frame, decode_error), detections (video, frame, det_idx, x, y, area, amplitude,
width, height, strength), targets (video, target, frame, x, y, contrast, sigma).  Every step is written once, so that what
follows reads it and not its history.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.functions.settings import DetectSettings
from trackloom.operators import dense, evaluation, intervals, matching, timeline, tracking, tracks


@dataclass(frozen=True)
class RunSettings:
    """Bounds of a run: half a window and the pad in frames, twins in pixels (none: not merged), kept tracks, judging."""

    half_window: int = 15
    max_blobs: int = 20
    pad: int = 30
    track: tracking.TrackSettings = field(default_factory=tracking.TrackSettings)
    twin_distance: float | None = 36.0
    min_travel: float = 45.0
    most_turn: float = 0.8
    rejoin: matching.RejoinSettings | None = field(default_factory=matching.RejoinSettings)
    radius: float = 24.0
    purity: float = 0.5
    min_hits: int = 6
    width: float = 1440.0
    height: float = 1080.0
    least_contrast: float = 8.0
    regions: tuple[tuple[float, float, float, float], ...] = ()


def excluded(frames: DataFrame, detections: DataFrame, settings: RunSettings = RunSettings()) -> tuple[DataFrame, DataFrame]:
    """Detections outside damaged and unstable spans, and these spans."""
    rows = cut(frames)
    damaged = cut(timeline.damaged_spans(rows, settings.half_window))
    unstable = timeline.unstable_spans(rows, detections, damaged, settings.max_blobs, settings.pad)
    ignored = cut(timeline.ignored_spans(damaged, unstable))
    return intervals.outside(detections, ignored, ["video"]), ignored


def tracked(detections: DataFrame, ignored: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """Points of the tracks of a run: video, track (numbered from 1 in a video), frame, x, y.

    Detections are associated, twins become one track, short, still and turning tracks go (but short ones may be
    pieces of others), and tracks that were hidden for a while are rejoined.
    """
    own = detections.select("video", "det_idx", "area", "amplitude", "width", "height", "strength")
    points = cut(tracking.tracked(detections, settings.track).join(own, ["video", "det_idx"]))
    if settings.twin_distance is not None:
        pairs = matching.twins(points, settings.twin_distance)
        roots = matching.groups(pairs).select(F.col("node").alias("track"), "root")
        named = points.join(roots, "track", "left").withColumn("track", F.coalesce("root", "track")).drop("root")
        points = cut(tracks.combined(named, ["video", "track", "frame"]))
    judged = cut(tracks.kept(points, settings.min_hits, settings.min_travel, settings.most_turn).select("track", "hits", "kept"))
    least = settings.rejoin.piece_points if settings.rejoin else settings.min_hits
    wanted = judged.filter(F.col("kept") | ((F.col("hits") < settings.min_hits) & (F.col("hits") >= least)))
    held = cut(points.join(wanted.select("track"), "track").select("video", "track", "frame", "x", "y"))
    if settings.rejoin:
        links = cut(matching.rejoined(matching.rejoinable(held, ignored, settings.rejoin)))
        held = cut(matching.chains(held, links, settings.rejoin).select("video", F.col("head").alias("track"), "frame", "x", "y"))
    numbers = tracks.numbered(held, ["video"])
    return held.join(numbers, ["video", "track"]).select("video", F.col("id").alias("track"), "frame", "x", "y")


def detected(frames: DataFrame, width: int, height: int, fps: float, detection: DetectSettings = DetectSettings(),
             settings: RunSettings = RunSettings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run from planes: detections, ignored spans and points of tracks of frames that have luma beside their
    other columns.  Planes of the source are width by height."""
    found = cut(dense.detected(frames.select("video", "frame", "luma"), width, height, fps, detection))
    kept, ignored = excluded(frames.drop("luma"), found, settings)
    return found, ignored, tracked(cut(kept), ignored, settings)


def seen(targets: DataFrame, ignored: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """Points of targets that can be seen: two sigmas inside the border, of enough contrast, outside regions (shares of
    the plane) and outside ignored spans.  A target without sigma has no margin."""
    sigma = F.col("sigma") if "sigma" in targets.columns else F.lit(0.0)
    points = evaluation.visible(targets, sigma, settings.width, settings.height, settings.least_contrast)
    for x0, y0, x1, y1 in settings.regions:
        points = points.filter(~((F.col("x") / settings.width).between(x0, x1) & (F.col("y") / settings.height).between(y0, y1)))
    return intervals.outside(points, ignored, ["video"])


def evaluated(points: DataFrame, targets: DataFrame, ignored: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """Per target what a run found of it (see evaluation.target_results), on the points of it that can be seen."""
    visible = cut(seen(targets, ignored, settings))
    assigned = matching.assigned_targets(points, targets, settings.radius, settings.purity).select("video", "track", "target")
    a = points.join(assigned, ["video", "track"]).select("video", "frame", F.col("target").alias("mine"), F.col("track").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = visible.select("video", "frame", F.col("target").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    hits = matching.near_pairs(a, b, ["video", "frame"], settings.radius).filter("mine = b_id")
    return evaluation.target_results(visible, hits.select("video", F.col("b_id").alias("target"), "frame", F.col("a_id").alias("track")), ["video", "target"], settings.min_hits)


def replayed(frames: DataFrame, detections: DataFrame, targets: DataFrame, settings: RunSettings) -> DataFrame:
    """Stored detections judged again under other settings: nothing is detected anew."""
    kept, ignored = excluded(frames, detections, settings)
    return evaluated(cut(tracked(kept, ignored, settings)), targets, ignored, settings)
