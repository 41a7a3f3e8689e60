"""Settings of detection, stability and rendering, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _positive(name: str, value: float) -> None:
    if not (math.isfinite(value) and value > 0):
        raise ValueError(f"{name} must be positive: {value}")


def _not_negative(name: str, value: float) -> None:
    if not (math.isfinite(value) and value >= 0):
        raise ValueError(f"{name} must not be negative: {value}")


@dataclass(frozen=True)
class DetectSettings:
    """Bounds of detection; areas in pixels of the source, times in seconds."""

    threshold: float = 12.0
    min_area: float = 4.0
    max_area: float = 2700.0
    window_s: float = 1.0
    step: int = 3
    merge_radius: float = 6.0
    work_width: int = 960
    noise_factor: float = 8.0
    sigma: float = 1.5
    regions: tuple[tuple[float, float, float, float], ...] = ()

    def __post_init__(self):
        for name in ("threshold", "max_area", "window_s", "step", "work_width"):
            _positive(name, getattr(self, name))
        for name in ("min_area", "merge_radius", "noise_factor", "sigma"):
            _not_negative(name, getattr(self, name))
        if self.min_area > self.max_area:
            raise ValueError(f"min_area {self.min_area} is above max_area {self.max_area}")
        for x0, y0, x1, y1 in self.regions:
            if not (0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1):
                raise ValueError(f"a region must lie in the frame: {(x0, y0, x1, y1)}")


@dataclass(frozen=True)
class StabilitySettings:
    max_blobs: int = 20
    pad_s: float = 1.0

    def __post_init__(self):
        _positive("max_blobs", self.max_blobs)
        _not_negative("pad_s", self.pad_s)


@dataclass(frozen=True)
class RenderSettings:
    pad: int = 12
    trail_s: float = 1.0
    clip_margin_s: float = 1.5
    max_tracks: int = 300
    zoom_area: float = 100.0
    zoom_amplitude: float = 40.0

    def __post_init__(self):
        for name in ("pad", "trail_s", "clip_margin_s", "max_tracks", "zoom_area", "zoom_amplitude"):
            _not_negative(name, getattr(self, name))


#: What a window of planes may hold in memory.
WINDOW_BYTES = 4 << 30


def half_window(settings: DetectSettings, fps: float, pixels: int) -> int:
    """Frames on each side of a window: half its seconds, rounded.  Windows of fewer than three frames or
    samples, and those of more than WINDOW_BYTES of two-byte planes, are refused."""
    half = math.floor(settings.window_s * fps / 2 + 0.5)
    frames = 2 * half + 1
    if frames < 3:
        raise ValueError(f"a window of {settings.window_s} s has fewer than 3 frames")
    if -(-frames // settings.step) < 3:
        raise ValueError(f"a window of {frames} frames has fewer than 3 samples at step {settings.step}")
    if frames * pixels * 2 > WINDOW_BYTES:
        raise ValueError(f"a window of {frames} frames of {pixels} pixels takes more than {WINDOW_BYTES} bytes")
    return half
