"""The tracker: detections of a video, in order of frames, to tracks.

Tracking is sequential, but not over a whole video: after a stretch without detections that is longer
than a track may wait, no track is open.  Videos are cut there, and each piece is tracked on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrackSettings:
    """Bounds in pixels and frames; the defaults are the reference ones."""

    max_jump: float = 120.0
    max_gap: int = 6
    margin: float = 50.0
    travel: float = 1.0
    edge: float = 30.0
    width: float = 1440.0
    height: float = 1080.0
    span: int = 3
    tail: int = 5
    slump: float = 0.4

    def __post_init__(self):
        for name in ("max_jump", "max_gap", "margin", "width", "height", "span", "tail"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise ValueError(f"{name} must be positive: {getattr(self, name)}")
        if not (math.isfinite(self.travel) and self.travel >= 0):
            raise ValueError(f"travel must not be negative: {self.travel}")


@dataclass
class OpenTrack:
    """An open track: its name and its points (frame, x, y, det_idx)."""

    name: int
    points: list[tuple[int, float, float, int]] = field(default_factory=list)

    def origin(self, s: TrackSettings):
        """The point from which the speed is measured: the latest one far enough back, else the one before."""
        last = self.points[-1][0]
        earlier = self.points[:-1]
        return next((p for p in reversed(earlier) if last - p[0] >= s.span), earlier[-1] if earlier else None)

    def led_on(self, frame: int, s: TrackSettings) -> tuple[float, float, float | None]:
        """Where the track is expected in a frame, and how far from there it may be (none: no bound)."""
        t, x, y, _ = self.points[-1]
        start = self.origin(s)
        if start is None:
            return x, y, None
        vx, vy = (x - start[1]) / (t - start[0]), (y - start[2]) / (t - start[0])
        first = self.points[max(0, len(self.points) - s.tail)]
        now, tail = math.hypot(vx, vy), math.hypot(x - first[1], y - first[2]) / (t - first[0])
        way = (tail if now < s.slump * tail else now) * (frame - t)
        free = near_edge(x, y, s) or near_edge(start[1], start[2], s)
        return x + vx * (frame - t), y + vy * (frame - t), None if free else s.margin + s.travel * way


def near_edge(x: float, y: float, s: TrackSettings) -> bool:
    return min(x, s.width - x, y, s.height - y) < s.edge


class Tracker:
    """Takes the frames of a video in order; gives tracks as they end."""

    def __init__(self, settings: TrackSettings, active: Iterable[OpenTrack] = ()):
        self.settings, self.active = settings, list(active)

    def advance(self, frame: int, detections: list[tuple[float, float, int, bool]]) -> list[OpenTrack]:
        """detections: x, y, det_idx, strong, in order of det_idx.  Strong ones are assigned before weak
        ones, to tracks with a speed before those without, then by distance, track and detection."""
        s = self.settings
        ended = [t for t in self.active if frame - t.points[-1][0] > s.max_gap + 1]
        self.active = [t for t in self.active if frame - t.points[-1][0] <= s.max_gap + 1]
        free_tracks, free = set(range(len(self.active))), set(range(len(detections)))
        expected = [t.led_on(frame, s) for t in self.active]
        young = [len(t.points) < 2 for t in self.active]
        for strength in (True, False):
            met = []
            for i in sorted(free_tracks):
                px, py, reach = expected[i]
                for j, (x, y, _, strong) in enumerate(detections):
                    if strong is not strength:
                        continue
                    miss = math.hypot(x - px, y - py)
                    if miss <= s.max_jump and (reach is None or miss <= reach or near_edge(x, y, s)):
                        met.append((young[i], miss, i, j))
            for _, _, i, j in sorted(met):
                if i in free_tracks and j in free:
                    free_tracks.discard(i)
                    free.discard(j)
                    x, y, name, _ = detections[j]
                    self.active[i].points.append((frame, x, y, name))
        # weak detections never open a track
        self.active += [OpenTrack(d[2], [(frame, d[0], d[1], d[2])]) for j, d in enumerate(detections) if j in free and d[3]]
        return ended

    def flush(self) -> list[OpenTrack]:
        ended, self.active = self.active, []
        return ended


POINTS = "video long, track long, frame long, det_idx long, x double, y double"
COLUMNS = ["video", "track", "frame", "det_idx", "x", "y"]


def rows_of(video: int, tracks: Iterable[OpenTrack]) -> pd.DataFrame:
    rows = [(video, t.name, f, i, x, y) for t in tracks for f, x, y, i in t.points]
    return pd.DataFrame(rows, columns=COLUMNS)


def frames_of(piece: pd.DataFrame) -> Iterator[tuple[int, list[tuple[float, float, int, bool]]]]:
    ordered = piece.sort_values(["frame", "det_idx"])
    for frame, rows in ordered.groupby("frame", sort=True):
        yield int(frame), list(zip(rows["x"].tolist(), rows["y"].tolist(), rows["det_idx"].tolist(), rows["strength"].eq("strong").tolist()))


def frames_along(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, int, list[tuple[float, float, int, bool]]]]:
    """Keys, frame and detections of each frame, from batches of rows in order of keys, frame and det_idx: a frame may
    lie in several batches, and no more than one batch and one frame are held."""
    at, found = None, []
    for batch in batches:
        strong = batch["strength"].eq("strong").tolist()
        for now, x, y, name, s in zip(zip(*(batch[k].tolist() for k in (*keys, "frame"))), batch["x"].tolist(), batch["y"].tolist(), batch["det_idx"].tolist(), strong):
            if now != at:
                if found:
                    yield at[:-1], at[-1], found
                at, found = now, []
            found.append((x, y, name, s))
    if found:
        yield at[:-1], at[-1], found


#: Points that are given on at once.
GIVEN = 20_000


def tracked(detections: DataFrame, settings: TrackSettings = TrackSettings()) -> DataFrame:
    """Points of all tracks (video, track, frame, det_idx, x, y), of detections outside ignored spans.

    A track is named by the detection that opened it.  Pieces of a video between stretches of more than
    max_gap + 1 empty frames are tracked apart, which changes nothing.  A piece goes through its task frame by frame: a
    point is given on when it is assigned, and of an open track only what the next frame looks at is kept.
    """
    order = Window.partitionBy("video").orderBy("frame")
    begins = F.coalesce(F.col("frame") - F.lag("frame").over(order) > settings.max_gap + 1, F.lit(True)).cast("long")
    cut = detections.select("video", "frame", "det_idx", "x", "y", "strength").withColumn("begins", begins).withColumn(
        "piece", F.sum("begins").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    back = max(math.ceil(settings.span) + 1, math.ceil(settings.tail), 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracker, out = None, None, []
        for piece, frame, found in frames_along(batches, ["video", "piece"]):
            if piece != at:
                at, tracker = piece, Tracker(settings)
            tracker.advance(frame, found)
            for t in tracker.active:
                f, x, y, i = t.points[-1]
                if f == frame:
                    out.append((piece[0], t.name, f, i, x, y))
                    del t.points[:-back]
            if len(out) >= GIVEN:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=COLUMNS)

    dealt = cut.drop("begins").repartition("video", "piece").sortWithinPartitions("video", "piece", "frame", "det_idx")
    return dealt.mapInPandas(run, POINTS)
