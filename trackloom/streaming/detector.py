"""Detection over a stream of frames: a frame is judged once half a window after it has come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackloom.functions.settings import DetectSettings, half_window
from trackloom.operators import dense, kernels

COLUMNS = [c.split()[0] for c in dense.DETECTIONS.split(", ")]


class Detector(StatefulProcessor):
    """State of a video: the frame that is next to be judged and the newest one, and the prepared planes that
    windows still sample, at most 2 half + 1 and what a micro-batch brings.

    A frame is given out when the last one of its window has come.  The rest, whose windows the end cuts off, follows
    a row with ended set, or a timer when a video has been silent for quiet_s seconds; frames that come afterwards
    are an error, as are frames that do not follow the newest one.
    """

    def __init__(self, shape: dense.Geometry, half: int, quiet_s: float) -> None:
        self.shape, self.half, self.quiet_s = shape, half, quiet_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "target bigint, newest bigint, ended boolean")
        self.planes = handle.getListState("planes", "frame bigint, total bigint, units binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        target, newest, ended = self.place.get() if self.place.exists() else (0, -1, False)
        held = {f: (total, units) for f, total, units in self.planes.get()}
        end = False
        for batch in rows:
            end |= bool(batch["ended"].any())
            for f, total, units in batch[~batch["ended"]][["frame", "total", "units"]].itertuples(index=False):
                if int(f) in held or f <= newest:
                    raise ValueError(f"video {key[0]}: frame {f} came again")
                held[int(f)] = int(total), bytes(units)
        newest_now = max([newest, *held])
        if ended and newest_now > newest or [f for f in range(newest + 1, newest_now + 1) if f not in held]:
            raise ValueError(f"video {key[0]}: frames up to {newest_now} do not follow frame {newest}")
        yield from self.judged(int(key[0]), int(target), newest_now, held, ended or end)
        if not self.quiet_s:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not (ended or end):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet_s * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        target, newest, _ = self.place.get()
        yield from self.judged(int(key[0]), int(target), int(newest), {f: (total, units) for f, total, units in self.planes.get()}, True)

    def judged(self, video: int, target: int, newest: int, held: dict, end: bool) -> Iterator[pd.DataFrame]:
        """Detections of the frames whose windows are whole, or of all where the video has ended; drops planes."""
        shape, s = self.shape, self.shape.settings
        planes = {f: np.frombuffer(units, "<i2") for f, (_, units) in held.items()}
        totals = {f: total for f, (total, _) in held.items()}
        until = newest + 1 if end else max(target, newest - self.half + 1)
        found = []
        for frame, samples, background in kernels.windows(planes, list(range(target, until)), self.half, s.step) if planes else ():
            where, magnitude, bar = dense.near_of(planes, totals, frame, samples, background, s.threshold * dense.UNITS, s.noise_factor, shape.kept, shape.masked)
            lit = magnitude > dense.WEAK * bar
            found += dense.blobs_of(video, frame, where[lit], magnitude[lit], (magnitude > bar)[lit], shape) if lit.any() else []
        kept = [(f, *held[f]) for f in sorted(held) if f >= until - self.half and not end]
        self.planes.put(kept) if kept else self.planes.clear()
        self.place.update((until, newest, end))
        yield pd.DataFrame(found, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_detections(frames: DataFrame, width: int, height: int, fps: float, settings: DetectSettings = DetectSettings(), quiet_s: float = 0.0) -> DataFrame:
    """Detections (see dense.DETECTIONS, weak ones too) of a stream of frames: video, frame from 0, luma, ended.

    Planes are prepared before they are dealt by video.  The session must keep state in RocksDB, the state store
    that transformWithState asks for.  With quiet_s there are timers, and a query runs on until it is stopped, under
    availableNow too.  What comes out does not depend on how the stream is cut into micro-batches.
    """
    shape = dense.Geometry(width, height, settings)
    half = half_window(settings, fps, shape.width * shape.height)
    rows = dense.prepared_whole(frames, shape)
    return rows.groupBy("video").transformWithStateInPandas(
        Detector(shape, half, quiet_s), dense.DETECTIONS, "append", "ProcessingTime" if quiet_s else "None")


def kept_in_rocksdb(spark) -> None:
    """Sets the session's state store to RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
