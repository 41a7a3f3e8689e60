"""Detection from dense planes.

A frame is one row with its luma as bytes.  It is prepared where it lies (grey, area average, blur), cut into strips
of pixels and dealt out by video, block of frames and strip; a block's group also holds half a window of frames on
both sides, so that each frame travels little more than once and a group has a bounded size whatever the plane and
the video.  Only lit pixels go on, by frame, to closing, components and measures.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.functions.settings import DetectSettings, half_window
from trackloom.operators import kernels
from trackloom.operators.matching import bracketed
from trackloom.operators.planes import UNITS, kernel, luma_of

#: Frames whose windows one group works out, pixels of a strip, and frames whose lit pixels meet in a group.
BLOCK, STRIP, TOGETHER = 128, 1 << 15, 8
#: Windows of fewer samples do not raise the bar; weak pixels reach this share of it.
LEAST_SAMPLES, WEAK = 7, 0.75

#: units: 1/64 levels as two-byte integers, low byte first.
STRIPS = "video bigint, frame bigint, strip int, total bigint, units binary"
LIT = "video bigint, frame bigint, pixel bigint, magnitude double, bar double"
BACKGROUND = "video bigint, frame bigint, pixel bigint, background double"
DETECTIONS = ("video bigint, frame bigint, det_idx bigint, x double, y double, left double, top double, width double, height double, "
              "area double, amplitude double, strength string")
DETECTIONS_ARROW = pa.schema([(n, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in (c.split() for c in DETECTIONS.split(", "))])


@dataclass(frozen=True)
class Geometry:
    """Sizes of the source and of the planes that are worked on, and what follows from the settings at this size."""

    source_width: int
    source_height: int
    settings: DetectSettings

    def __post_init__(self) -> None:
        if self.settings.sigma and 2 * self.reach + 1 > min(self.width, self.height):
            raise ValueError(f"a plane of {self.width} x {self.height} is narrower than the blur of {2 * self.reach + 1} pixels")
        if self.kept <= 0:
            raise ValueError(f"the regions mask the whole plane of {self.width} x {self.height}")

    @property
    def width(self) -> int:
        return min(self.settings.work_width, self.source_width)

    @property
    def height(self) -> int:
        return max(1, math.floor(self.width * self.source_height / self.source_width + 0.5))

    @property
    def factor(self) -> float:
        return self.source_width / self.width

    @property
    def reach(self) -> int:
        return math.ceil(4 * self.settings.sigma / self.factor)

    @cached_property
    def weights(self) -> list[int]:
        return kernel(self.settings.sigma / self.factor) if self.settings.sigma else [4096]

    @cached_property
    def disk(self) -> list[tuple[int, int]]:
        return kernels.disk(self.settings.merge_radius / self.factor, self.width, self.height)

    @cached_property
    def masked(self) -> np.ndarray:
        """The pixels of the regions, rounded outwards and widened by the blur."""
        out = np.zeros((self.height, self.width), bool)
        span = lambda a, b, size: slice(max(0, math.floor(a * size) - self.reach), min(size, math.ceil(b * size) + self.reach))
        for x0, y0, x1, y1 in self.settings.regions:
            out[span(y0, y1, self.height), span(x0, x1, self.width)] = True
        return out.ravel()

    @cached_property
    def kept(self) -> int:
        return int((~self.masked).sum())


def strips_of(frames: DataFrame, to_units, masked: np.ndarray | None = None, strip: int = STRIP) -> DataFrame:
    """Strips (see STRIPS) of frames (video, frame, luma binary): to_units(luma), and the whole sum of a frame
    without masked pixels.  One narrow pass."""
    names = [c.split()[0] for c in STRIPS.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                units = to_units(np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8))
                total = int(units.sum(dtype=np.int64)) - (int(units[masked].sum(dtype=np.int64)) if masked is not None else 0)
                parts = [units[i:i + strip].astype("<i2").tobytes() for i in range(0, len(units), strip)]
                same = lambda c, n=len(parts): pa.array([batch.column(c)[k].as_py()] * n, pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    same(0), same(1), pa.array(range(len(parts)), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=names)

    return frames.select(F.col("video").cast("bigint"), F.col("frame").cast("bigint"), "luma").mapInArrow(run, STRIPS)


def units_of(luma: np.ndarray, shape: Geometry) -> np.ndarray:
    """The units of a source plane at the working size."""
    plane = kernels.averaged(kernels.grey(luma.reshape(shape.source_height, shape.source_width)), shape.width, shape.height)
    return kernels.blurred(plane, shape.weights).ravel()


def prepared(frames: DataFrame, shape: Geometry) -> DataFrame:
    """Strips of frames at the working size: grey, area average and blur.  A luma of another size is an error."""
    return strips_of(frames, lambda luma: units_of(luma, shape), shape.masked if shape.settings.regions else None)


def prepared_whole(frames: DataFrame, shape: Geometry) -> DataFrame:
    """video, frame, total, units and ended of frames (video, frame, luma, ended): one row a plane; rows with ended
    set carry none."""
    def run(batches):
        for batch in batches:
            video, frame, luma, ended = (batch.column(c) for c in range(4))
            planes = [None if luma[k].as_py() is None else units_of(np.frombuffer(luma[k].as_buffer(), np.uint8), shape) for k in range(batch.num_rows)]
            totals = [None if p is None else int(p.sum(dtype=np.int64)) - int(p[shape.masked].sum(dtype=np.int64)) for p in planes]
            yield pa.RecordBatch.from_arrays([video, frame, pa.array(totals, pa.int64()), pa.array([None if p is None else p.astype("<i2").tobytes() for p in planes], pa.binary()), ended],
                                             names=["video", "frame", "total", "units", "ended"])

    own = frames.select(F.col("video").cast("bigint"), F.col("frame").cast("bigint"), "luma", F.coalesce("ended", F.lit(False)).alias("ended"))
    return own.mapInArrow(run, "video bigint, frame bigint, total bigint, units binary, ended boolean")


def packed(planes: DataFrame) -> DataFrame:
    """Strips of planes in long form (frame, pixel, value from 0 to 255), of which every frame has every pixel: one
    shuffle by frame.  Values are taken as units."""
    frames = luma_of(planes).select(F.lit(0).cast("bigint").alias("video"), "frame", "luma")
    return strips_of(frames, lambda luma: luma.astype(np.int16))


def windowed(strips: DataFrame, half: int, step: int, work, schema: str, block: int = BLOCK) -> DataFrame:
    """Rows of work(planes, totals, target, samples, background, strip) for every frame, by groups of a block.

    planes and totals are dicts by frame.  A frame goes to its own block and to those whose windows reach it.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    wanted = F.sequence(F.expr(f"greatest(0, frame - {half}) div {block}"), F.expr(f"(frame + {half}) div {block}"))

    def run(key, table):
        video, own, strip = (k.as_py() for k in key)
        frames = table.column("frame").to_pylist()
        stack = [np.frombuffer(v.as_buffer(), "<i2") for v in table.column("units")]
        if len({len(v) for v in stack}) > 1 or len(set(frames)) < len(frames):
            raise ValueError(f"video {video}: frames that repeat, or planes of different sizes")
        planes, totals = dict(zip(frames, stack)), dict(zip(frames, table.column("total").to_pylist()))
        targets = [f for f in frames if f // block == own]
        out = [arrow.empty_table()]
        for target, samples, background in kernels.windows(planes, targets, half, step):
            columns = work(planes, totals, target, samples, background, strip)
            n = len(columns[0])
            out.append(pa.table([pa.array(np.full(n, video)), pa.array(np.full(n, target)), *(pa.array(c) for c in columns)], names=names).cast(arrow))
        return pa.concat_tables(out)

    dealt = strips.withColumn("block", F.explode(wanted))
    return dealt.groupBy("video", "block", "strip").applyInArrow(run, schema)


def backgrounds(strips: DataFrame, half: int, step: int, strip: int = STRIP, block: int = BLOCK) -> DataFrame:
    """The median of each pixel over its frame's window: video, frame, pixel, background."""
    def work(planes, totals, target, samples, background, at):
        return np.arange(len(background)) + at * strip, background.astype(np.float64)

    return windowed(strips, half, step, work, BACKGROUND, block)


def near_of(planes: dict, totals: dict, target: int, samples: list[int], background: np.ndarray, floor: float, factor: float, pixels: int,
            masked: np.ndarray | None, least: int = LEAST_SAMPLES, weak: float = WEAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of one frame whose residual is above the weak share of the floor, with magnitude and bar (see near)."""
    count, total = len(samples), sum(totals[f] for f in samples)
    # halves of integers are exact in single precision; the gain is a double
    residual = planes[target] - background
    shift = float(kernels.gain(np.int64(totals[target]), total, count, pixels))
    hit = np.abs(residual - np.float32(shift)) > weak * floor - 0.01
    if masked is not None:
        hit &= ~masked
    where = np.flatnonzero(hit)
    magnitude = np.abs(residual[where].astype(np.float64) - shift)
    where, magnitude = where[magnitude > weak * floor], magnitude[magnitude > weak * floor]
    if factor > 0 and count >= least and len(where):
        gains = kernels.gain(np.array([totals[f] for f in samples], np.int64), total, count, pixels)
        return where, magnitude, kernels.bars(np.stack([planes[f][where] for f in samples]), background[where], gains, floor, factor)
    return where, magnitude, np.full(len(where), float(floor))


def near(strips: DataFrame, half: int, step: int, floor: float, factor: float, pixels: int, masked: np.ndarray | None = None,
         least: int = LEAST_SAMPLES, weak: float = WEAK, strip: int = STRIP, block: int = BLOCK) -> DataFrame:
    """Pixels whose residual is above the weak share of the floor: video, frame, pixel, magnitude and bar.

    The residual is a pixel less its background and its frame's gain.  With at least so many samples the bar is
    raised by their noise, their gains taken against the target's own window.
    """
    def work(planes, totals, target, samples, background, at):
        hidden = None if masked is None else masked[at * strip:at * strip + len(background)]
        where, magnitude, bar = near_of(planes, totals, target, samples, background, floor, factor, pixels, hidden, least, weak)
        return where + at * strip, magnitude, bar

    return windowed(strips, half, step, work, LIT, block)


def lit(rows: DataFrame, weak: float = WEAK) -> DataFrame:
    """Pixels above their bar (strong) or above its weak share."""
    return rows.filter(F.col("magnitude") > weak * F.col("bar")).select("video", "frame", "pixel", "magnitude", (F.col("magnitude") > F.col("bar")).alias("strong"))


def blobs_of(video: int, frame: int, pixel: np.ndarray, magnitude: np.ndarray, strong: np.ndarray, shape: Geometry) -> list[dict]:
    """Detections of one frame's lit pixels, which ascend (see blobs)."""
    factor, s, out = shape.factor, shape.settings, []
    for own in (strong, np.ones(len(pixel), bool))[:1 if strong.all() else 2]:
        whole = kernels.closed(pixel[own], shape.width, shape.height, shape.disk)
        for m in kernels.measures(whole, pixel[own], magnitude[own], strong[own], shape.width):
            if (own is strong or not m["strong"]) and s.min_area <= m["hits"] * factor * factor <= s.max_area:
                out.append({"video": video, "frame": frame, "det_idx": (frame << 20) + len(out),
                            **{c: (m[c] + 0.5) * factor - 0.5 for c in ("x", "y")}, **{c: m[c] * factor for c in ("left", "top", "width", "height")},
                            "area": m["hits"] * factor * factor, "amplitude": m["peak"] / UNITS, "strength": "strong" if m["strong"] else "weak"})
    return out


def blobs(pixels: DataFrame, shape: Geometry) -> DataFrame:
    """Detections (see DETECTIONS) of lit pixels: components of the closed strong pixels, then those of all lit
    pixels that hold no strong one; areas within the settings, sizes at the source's scale."""
    def run(table):
        table = table.sort_by([("frame", "ascending"), ("pixel", "ascending")])
        frame, pixel, magnitude = (table.column(c).to_numpy() for c in ("frame", "pixel", "magnitude"))
        strong = table.column("strong").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(frame, prepend=-1))
        out, video = [], table.column("video")[0].as_py()
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            out += blobs_of(video, int(frame[a]), pixel[a:b], magnitude[a:b], strong[a:b], shape)
        return pa.Table.from_pylist(out, DETECTIONS_ARROW)

    groups = pixels.groupBy("video", F.expr(f"frame div {TOGETHER}").alias("some"))
    return groups.applyInArrow(run, DETECTIONS)


def found(frames: DataFrame, width: int, height: int, fps: float, settings: DetectSettings = DetectSettings()) -> DataFrame:
    """All detections of frames (video, frame from 0 in order, luma binary of width by height), weak ones too."""
    shape = Geometry(width, height, settings)
    half = half_window(settings, fps, shape.width * shape.height)
    rows = near(prepared(frames, shape), half, settings.step, settings.threshold * UNITS, settings.noise_factor, shape.kept, shape.masked)
    return blobs(lit(rows), shape)


def detected(frames: DataFrame, width: int, height: int, fps: float, settings: DetectSettings = DetectSettings(), **bracket: float) -> DataFrame:
    """Detections of frames, of the weak ones those that strong ones bracket in time (bounds as of bracketed)."""
    return bracketed(cut(found(frames, width, height, fps, settings)), **bracket)
