"""The tracker over a stream of detections, and counts per window with late data refused or dropped."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.tracking import POINTS, OpenTrack, Tracker, TrackSettings, frames_of, rows_of

STATE = "frame long, tracks string, waiting string"


def stream_tracks(detections: DataFrame, settings: TrackSettings = TrackSettings()) -> DataFrame:
    """Points of tracks as they end, from a stream of video, frame, det_idx, x, y, strength, ended.

    The state of a video is its last whole frame, its open tracks and the rows of its newest frame, which wait
    until a later frame comes: a frame may arrive in several batches.  That is bounded by the detections of
    max_gap + 2 frames and the length of open tracks.  Rows of a frame that has been passed are an error.  A
    row with ended set closes the video: what waits is tracked and all tracks end.
    """
    columns = ["frame", "det_idx", "x", "y", "strength"]

    def advance(key, batches, state):
        last, held, waiting = state.get if state.exists else (-1, "[]", "[]")
        tracker = Tracker(settings, [OpenTrack(n, [tuple(p) for p in points]) for n, points in json.loads(held)])
        rows = pd.concat(list(batches))
        ended = bool(rows["ended"].any())
        rows = rows.loc[~rows["ended"], columns]
        if len(rows) and int(rows["frame"].min()) <= last:
            raise ValueError(f"video {key[0]}: frame {int(rows['frame'].min())} comes after frame {last}")
        kept = pd.DataFrame(json.loads(waiting), columns=columns)
        rows = pd.concat([kept, rows]) if len(kept) else rows
        newest = rows["frame"].max() if len(rows) and not ended else None
        done = []
        for frame, found in frames_of(rows if newest is None else rows[rows["frame"] < newest]):
            done += tracker.advance(frame, found)
            last = frame
        if ended:
            done += tracker.flush()
        late = [] if newest is None else rows.loc[rows["frame"] == newest].astype(object).values.tolist()
        state.update((last, json.dumps([[t.name, t.points] for t in tracker.active]), json.dumps(late)))
        yield rows_of(int(key[0]), done)

    return detections.groupBy("video").applyInPandasWithState(advance, POINTS, STATE, "append", "NoTimeout")


def stream_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events per tumbling window of ts and type; what comes later than `late` is dropped with its window."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
            .select(F.col("window.start").alias("start"), "event_type", "n", "total"))
