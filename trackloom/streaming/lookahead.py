"""Backgrounds and gains over a stream of frames: a frame is worked out once half a window after it has come."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STATE = "target long, first long, pixels long, planes binary"
WINDOWS = "video long, frame long, samples long, gain double, background array<double>"


def window_of(target: int, newest: int, half: int, step: int) -> np.ndarray:
    """The frames that a window samples: the stride begins at its first frame, which the start of the video cuts off."""
    return np.arange(max(0, target - half), min(newest, target + half) + 1, step)


def stream_windows(frames: DataFrame, half: int, step: int) -> DataFrame:
    """Per frame the median of each pixel over its window's samples and its gain over their mean.

    frames: video, frame (from 0, each once and in order), plane (array of bytes as integers), ended.  A frame
    is given out when the last one of its window has come; a row with ended set flushes the rest with windows
    that the end cuts off.  The state of a video is at most 2 half + 1 planes.  A frame that is missing, comes
    late or has another size is an error.
    """
    def advance(key, batches, state):
        rows = pd.concat(list(batches))
        ended = bool(rows["ended"].any())
        rows = rows[~rows["ended"]].sort_values("frame")
        target, first, pixels, held = state.get if state.exists else (0, 0, 0, b"")
        planes = np.frombuffer(held, dtype=np.uint8).reshape(-1, max(1, pixels))
        if len(rows):
            pixels = pixels or len(rows["plane"].iloc[0])
            new = rows["plane"].tolist()
            expected = first + len(planes)
            if rows["frame"].tolist() != list(range(expected, expected + len(new))):
                raise ValueError(f"video {key[0]}: frames {rows['frame'].min()} to {rows['frame'].max()} do not follow frame {expected - 1}")
            if any(len(p) != pixels for p in new):
                raise ValueError(f"video {key[0]}: planes of other than {pixels} pixels")
            planes = np.concatenate([planes.reshape(-1, pixels), np.array(new, dtype=np.uint8)])
        newest, out = first + len(planes) - 1, []
        while target <= (newest if ended else newest - half):
            samples = planes[window_of(target, newest, half, step) - first].astype(np.int64)
            own = planes[target - first].astype(np.int64)
            gain = float(own.sum() * len(samples) - samples.sum()) / (len(samples) * pixels)
            out.append((int(key[0]), target, len(samples), gain, np.median(samples, axis=0).tolist()))
            target += 1
        drop = max(0, min(target - half, newest + 1) - first)
        state.update((target, first + drop, pixels, planes[drop:].tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return frames.groupBy("video").applyInPandasWithState(advance, WINDOWS, STATE, "append", "NoTimeout")
