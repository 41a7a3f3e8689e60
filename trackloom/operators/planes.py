"""Pixel planes in long form: (frame, pixel, value), pixel = row * width + column.

Grey values become integer units (64 to a level) before any median, so that sums are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.lineage import cut
from trackloom.operators import kernels
from trackloom.operators.intervals import outside

UNITS = 64


def grey(luma: Column) -> Column:
    """Limited-range luma as full-range grey, by an arithmetic shift, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(luma * 4769 - 81520, 12)))


def to_source(value: Column, scale: float, kind: str) -> Column:
    """Working-size coordinates, lengths and areas at source size."""
    return {"coordinate": (value + 0.5) * scale - 0.5, "length": value * scale, "area": value * scale * scale}[kind]


def region_pixels(low: Column, high: Column, size: int, margin: int = 0) -> tuple[Column, Column]:
    """The half-open pixel range of a fraction of a side, rounded outwards, with a margin, clamped."""
    return (F.greatest(F.lit(0), F.floor(low * size) - margin).cast("long"), F.least(F.lit(size), F.ceil(high * size) + margin).cast("long"))


def masked(planes: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """planes without the pixels in spans (row, first, last; last is not in it): an equi-join by row, then the range."""
    row, column = F.expr(f"pixel div {width}"), F.expr(f"pixel % {width}")
    rows = planes.withColumn("at_row", row).withColumn("at_column", column)
    hit = (F.col("at_row") == F.col("row")) & (F.col("at_column") >= F.col("first")) & (F.col("at_column") < F.col("last"))
    return rows.join(spans, hit, "left_anti").drop("at_row", "at_column")


def axis_weights(source: int, work: int) -> list[tuple[int, int, int]]:
    """(source, work, weight) of an area average along one side; weights of a work pixel sum to source."""
    return [(s, w, min((s + 1) * work, (w + 1) * source) - max(s * work, w * source))
            for w in range(work) for s in range(source) if min((s + 1) * work, (w + 1) * source) > max(s * work, w * source)]


def reduced(planes: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Area-average downscale with exact integer weights and one rounding."""
    spark = planes.sparkSession
    # width + to_width and height + to_height rows at most: the sides of a plane
    across = F.broadcast(spark.createDataFrame(axis_weights(width, to_width), "sx long, wx long, ax long"))
    down = F.broadcast(spark.createDataFrame(axis_weights(height, to_height), "sy long, wy long, ay long"))
    rows = planes.withColumn("sx", F.expr(f"pixel % {width}").cast("long")).withColumn("sy", F.expr(f"pixel div {width}"))
    total = width * height
    return rows.join(across, "sx").join(down, "sy").groupBy("frame", (F.col("wy") * to_width + F.col("wx")).alias("pixel")).agg(
        F.sum(F.col("value") * F.col("ax") * F.col("ay")).alias("s")).select("frame", "pixel", F.expr(f"(s + {total // 2}) div {total}").alias("value"))


def kernel(sigma: float) -> list[int]:
    """Integer Gaussian weights that sum to 4096: floors, then the largest remainders in symmetric pairs;
    what is odd goes to the centre."""
    reach = math.ceil(4 * sigma)
    exact = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    scale = 4096 / sum(exact)
    weights = [math.floor(e * scale) for e in exact]
    missing = 4096 - sum(weights)
    weights[reach] += missing % 2
    pairs = sorted(range(1, reach + 1), key=lambda k: (-(exact[reach + k] * scale % 1), k))
    for k in (pairs * 2)[:missing // 2]:
        weights[reach + k] += 1
        weights[reach - k] += 1
    return weights


def blurred(planes: DataFrame, width: int, height: int, sigma: float) -> DataFrame:
    """Separable convolution with mirrored borders, in integers; units (1/64 level), rounded once.

    A frame's pixels meet in one row of bytes, which is blurred where it lies.
    """
    weights = kernel(sigma)
    if len(weights) // 2 >= min(width, height):
        raise ValueError("the plane is too small for the blur")
    luma = luma_of(planes)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                plane = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8).reshape(height, width)
                units = kernels.blurred(plane, weights).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.full(len(units), k))), pa.array(np.arange(len(units))), pa.array(units.astype(np.int64))],
                    names=["frame", "pixel", "units"])

    return luma.mapInArrow(run, T.StructType([luma.schema["frame"], *T._parse_datatype_string("pixel bigint, units bigint").fields]))


def luma_of(planes: DataFrame) -> DataFrame:
    """frame and luma: the values of a frame's pixels (all of them, 0 to 255) as bytes in order."""
    rows = planes.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("pixel", "value"))).alias("own"))
    return rows.select("frame", F.unhex(F.array_join(F.transform("own", lambda p: F.lpad(F.hex(p["value"]), 2, "0")), "")).alias("luma"))


def sampled(frames: DataFrame, half: int, step: int) -> DataFrame:
    """(frame, sample): the frames that the window of each frame samples.  The stride is anchored at the
    window's first frame, which the start of the video cuts off."""
    last = frames.agg(F.max("frame").alias("last"))
    rows = frames.select("frame").join(F.broadcast(last))
    first = F.greatest(F.col("frame") - half, F.lit(0))
    return rows.select("frame", F.explode(F.sequence(first, F.least(F.col("frame") + half, F.col("last")), F.lit(step).cast("long"))).alias("sample"))


def gains(planes: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean of a frame less the mean of its window's samples, from exact integer sums."""
    sums = planes.groupBy("frame").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("pixels"))
    around = windows.join(sums.select(F.col("frame").alias("sample"), F.col("total").alias("part")), "sample").groupBy("frame").agg(
        F.sum("part").alias("window"), F.count(F.lit(1)).alias("samples"))
    return sums.join(around, "frame").select("frame", (
        (F.col("total").cast("decimal(38,0)") * F.col("samples") - F.col("window")).cast("double") / (F.col("samples") * F.col("pixels"))).alias("gain"))


def disk(radius: float, width: int, height: int) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of a disk of the rounded radius; half widths of its rows are rounded too."""
    return [(dx, dy) for dy, half in kernels.disk(radius, width, height) for dx in range(-half, half + 1)]


def closed(pixels: DataFrame, width: int, height: int, radius: float) -> DataFrame:
    """Morphological closing with a disk: pixels (frame, pixel) whose whole disk, as far as it lies in the
    plane, is within the radius of a given pixel."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk(radius, width, height)))

    def spread(rows: DataFrame) -> DataFrame:
        placed = rows.select("frame", F.expr(f"pixel % {width}").alias("x"), F.expr(f"pixel div {width}").alias("y"), F.explode(offsets).alias("o"))
        x, y = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
        inside = x.between(0, width - 1) & y.between(0, height - 1)
        return placed.filter(inside).select("frame", (y * width + x).alias("pixel"), (F.col("y") * width + F.col("x")).alias("source"))

    marked = spread(pixels.select("frame", "pixel")).select("frame", "pixel").distinct()
    # a marked pixel counts for all whose disk holds it; disks are symmetric
    counts = spread(marked).groupBy("frame", "pixel").agg(F.count(F.lit(1)).alias("n"))
    x, y = F.col("pixel") % width, F.expr(f"pixel div {width}")
    whole = F.size(F.filter(offsets, lambda o: (x + o["dx"]).between(0, width - 1) & (y + o["dy"]).between(0, height - 1)))
    return counts.filter(F.col("n") == whole).select("frame", "pixel")


def labelled(pixels: DataFrame, width: int) -> DataFrame:
    """8-connected components: frame, pixel, label (the least pixel of the component).

    A frame's pixels meet in one row, which is labelled where it lies.
    """
    rows = pixels.groupBy("frame").agg(F.array_sort(F.collect_set("pixel")).alias("own"))
    kinds = T.StructType([pixels.schema["frame"], pixels.schema["pixel"], T.StructField("label", pixels.schema["pixel"].dataType)])

    def run(batches):
        for batch in batches:
            own = batch.column(1)
            sizes = np.diff(own.offsets.to_numpy())
            ends, flat, made = np.cumsum(sizes), own.flatten(), []
            values = flat.to_numpy()
            for end, size in zip(ends, sizes):
                one = values[end - size:end]
                part = kernels.components(one, width)
                made.append(one[np.unique(part, return_index=True)[1]][part] if size else one)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), flat,
                                              pa.array(np.concatenate([values[:0], *made]), flat.type)], names=["frame", "pixel", "label"])

    return rows.mapInArrow(run, kinds)


def blobs(components: DataFrame, lit_pixels: DataFrame, width: int) -> DataFrame:
    """Measures of components: box and centre of all pixels, number and peak of the lit ones, strength."""
    rows = components.join(lit_pixels, ["frame", "pixel"], "left").withColumn("x", F.col("pixel") % width).withColumn("y", F.expr(f"pixel div {width}"))
    return rows.groupBy("frame", "label").agg(
        F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.min("x").cast("long").alias("left"), F.min("y").cast("long").alias("top"),
        (F.max("x") - F.min("x") + 1).cast("long").alias("width"), (F.max("y") - F.min("y") + 1).cast("long").alias("height"),
        F.count("amplitude").alias("area"), F.max("amplitude").alias("amplitude"),
        F.when(F.bool_or(F.coalesce("strong", F.lit(False))), "strong").otherwise("weak").alias("strength"))


def scene(planes: DataFrame, count: int = 25, damaged: DataFrame | None = None) -> DataFrame:
    """The median of each pixel over `count` evenly ranked frames; even numbers round up.

    Ranked frames in damaged spans (first, last) are left out, unless all of them are.
    """
    ranked = planes.select("frame").distinct().select("frame", (F.row_number().over(Window.orderBy("frame")) - 1).alias("rank"))
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    ranks = n.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor((2 * i + 1) * F.col("n") / (2 * count)).cast("int")))).alias("rank"))
    chosen = ranked.join(F.broadcast(ranks), "rank").select("frame")
    if damaged is not None:
        # at most `count` rows, written once
        chosen = cut(chosen)
        readable = outside(chosen.withColumn("key", F.lit(0)), damaged.select(F.lit(0).alias("key"), "first", "last"), ["key"]).select("frame")
        chosen = chosen if readable.isEmpty() else readable
    return planes.join(F.broadcast(chosen), "frame").groupBy("pixel").agg(
        F.ceil(F.percentile("value", F.lit(0.5))).cast("int").alias("value"))


def fnv32(data: Column) -> Column:
    """FNV-1a of 32 bits over the bytes of a string."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(data, "UTF-8")), "(..)", "$1,"), ","), lambda h: h != ""),
                        lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(4294967296)))


def spot(planes: DataFrame, spots: DataFrame, width: int) -> DataFrame:
    """planes with Gaussian spots added (frame, cx, cy, amplitude, sigma): floor(A exp(-d^2 / 2 s^2)), clamped to 0..255.

    Frames without a spot stay as they are.
    """
    hit = planes.join(spots, "frame", "left")
    dx, dy = F.col("pixel") % width - F.col("cx"), F.expr(f"pixel div {width}") - F.col("cy")
    change = F.floor(F.round(F.col("amplitude") * F.exp(-(dx * dx + dy * dy) / (2 * F.col("sigma") * F.col("sigma"))), 9)).cast("int")
    added = hit.groupBy("frame", "pixel").agg(F.first("value").alias("value"), F.coalesce(F.sum(change), F.lit(0)).cast("int").alias("change"))
    return added.select("frame", "pixel", F.greatest(F.lit(0), F.least(F.lit(255), F.col("value") + F.col("change"))).alias("value"))


def injected(planes: DataFrame, spots: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Planes of luma with Gaussian spots put in, and the change that each spot made: frame, spot, change.

    spots: frame, spot, cx, cy, amplitude, sigma.  A spot touches the pixels within ceil(3 sigma) of its centre's
    pixel: its grey is raised by floor(A exp(-d^2 / 2 s^2)), clamped, and taken as the nearest luma.  Spots of one
    frame follow each other by number, each on what the one before has left.  The change is that of the grey in the
    sense of the amplitude: the least one of a dark spot, else the greatest.
    """
    lumas = F.array(*map(F.lit, nearest_luma([max(0, min(255, (v * 4769 - 81520) >> 12)) for v in range(256)])))
    own = spots.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("spot", "cx", "cy", "amplitude", "sigma"))).alias("spots"))
    x, y = F.col("pixel") % width, F.expr(f"pixel div {width}")

    def put(state: Column, s: Column) -> Column:
        reach, dx, dy = F.ceil(3 * s["sigma"]), x - s["cx"], y - s["cy"]
        near = (F.abs(x - F.floor(s["cx"])) <= reach) & (F.abs(y - F.floor(s["cy"])) <= reach)
        before = grey(state["value"])
        aimed = before + F.floor(F.round(s["amplitude"] * F.exp(-(dx * dx + dy * dy) / (2 * s["sigma"] * s["sigma"])), 9))
        after = F.element_at(lumas, F.greatest(F.lit(0), F.least(F.lit(255), aimed)).cast("int") + 1)
        made = F.struct(s["spot"].alias("spot"), s["amplitude"].alias("amplitude"), (grey(after) - before).cast("int").alias("change"))
        return F.when(near, F.struct(after.alias("value"), F.array_append(state["made"], made).alias("made"))).otherwise(state)

    kind = "array<struct<spot:bigint,amplitude:double,change:int>>"
    start = F.struct(F.col("value").cast("int").alias("value"), F.array().cast(kind).alias("made"))
    typed = own.select("frame", F.col("spots").cast("array<struct<spot:bigint,cx:double,cy:double,amplitude:double,sigma:double>>").alias("spots"))
    done = cut(planes.join(typed, "frame", "left").select("frame", "pixel", F.aggregate(F.coalesce("spots", F.array().cast(typed.schema["spots"].dataType)), start, put).alias("one")))
    changes = done.select("frame", F.explode("one.made").alias("m")).groupBy("frame", F.col("m.spot").alias("spot")).agg(
        F.when(F.max("m.amplitude") < 0, F.min("m.change")).otherwise(F.max("m.change")).alias("change"))
    return done.select("frame", "pixel", F.col("one.value").alias("value")), changes


def nearest_luma(levels: list[int]) -> list[int]:
    """For each grey level the luma whose grey is nearest, the darker of two; where exactly two lumas are one
    level off to both sides, they are taken in turns."""
    out, ties = [], 0
    for aimed in range(256):
        best = min(range(256), key=lambda v: (abs(levels[v] - aimed), v))
        if best < 255 and abs(levels[best] - aimed) == 1 and abs(levels[best + 1] - aimed) == 1:
            out.append(best + ties % 2)
            ties += 1
        else:
            out.append(best)
    return out
