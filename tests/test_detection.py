"""Detection from planes: kernels against plain loops, the run against a frame-by-frame rule, the stream against the run."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest

from trackloom.functions.settings import DetectSettings
from trackloom.operators import dense, kernels, planes


def noise(seed, *shape, low=0, high=256):
    return np.random.Generator(np.random.PCG64(seed)).integers(low, high, shape)


@pytest.mark.parametrize(("step", "half"), [(1, 2), (2, 5), (3, 15), (7, 3)])
def test_windows_are_medians_of_their_samples(step, half):
    stack = {f: row.astype(np.int16) for f, row in enumerate(noise(step, 40, 9, high=50))}
    found = {t: (samples, median.tolist()) for t, samples, median in kernels.windows(stack, list(range(40)), half, step)}
    for t in range(40):
        samples = list(range(max(0, t - half), min(39, t + half) + 1, step))
        assert found[t] == (samples, [statistics.median(float(stack[f][p]) for f in samples) for p in range(9)])


@pytest.mark.parametrize("size", [((7, 11), (7, 4)), ((9, 16), (3, 5)), ((8, 8), (8, 8)), ((12, 10), (6, 5))])
def test_averages(size):
    (h, w), (height, width) = size
    plane = noise(1, h, w).astype(np.uint8)
    out = kernels.averaged(plane, width, height)
    for y in range(height):
        for x in range(width):
            total = sum(int(plane[j, i]) * max(0, min((j + 1) * height, (y + 1) * h) - max(j * height, y * h)) * max(0, min((i + 1) * width, (x + 1) * w) - max(i * width, x * w))
                        for j in range(h) for i in range(w))
            assert out[y, x] == (total + h * w // 2) // (h * w)


def test_blur_mirrors_borders():
    plane, weights = noise(2, 9, 12).astype(np.uint8), planes.kernel(0.9)
    reach, out = len(weights) // 2, kernels.blurred(plane, weights)
    back = lambda p, n: 2 * (n - 1) - abs(p) if abs(p) > n - 1 else abs(p)
    for y in range(9):
        for x in range(12):
            total = sum(weights[j] * weights[i] * int(plane[back(y + j - reach, 9), back(x + i - reach, 12)]) for j in range(len(weights)) for i in range(len(weights)))
            assert out[y, x] == (total * 64 + (1 << 23)) >> 24


def test_components_and_closing():
    draw = random.Random(4)
    for width, height, radius, share in ((9, 7, 0.0, 0.4), (12, 10, 2.0, 0.1), (30, 20, 6.0, 0.02), (5, 40, 3.4, 0.05), (20, 20, 1.0, 0.6)):
        own = np.array(sorted(draw.sample(range(width * height), int(share * width * height))))
        rows = kernels.disk(radius, width, height)
        r = math.floor(radius + 0.5)
        assert rows == [(dy, min(width - 1, math.floor(math.sqrt(r * r - dy * dy) + 0.5))) for dy in range(-min(r, height - 1), min(r, height - 1) + 1)]
        around = lambda p: {y * width + x for dy, half in rows for y in [p // width + dy] if 0 <= y < height for x in range(max(0, p % width - half), min(width - 1, p % width + half) + 1)}  # noqa: B023, E731
        marked = set().union(*(around(int(p)) for p in own))
        whole = kernels.closed(own, width, height, rows)
        assert whole.tolist() == sorted(p for p in marked if around(p) <= marked) and set(own.tolist()) <= set(whole.tolist())
        part = kernels.components(whole, width).tolist()
        left, number = set(whole.tolist()), {}
        for first in whole.tolist():
            if first in left:
                name, todo = len(set(number.values())), [first]
                left.discard(first)
                while todo:
                    p = todo.pop()
                    number[p] = name
                    beside = {q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= p % width + dx < width for q in [p + dy * width + dx] if q in left}
                    left -= beside
                    todo += beside
        assert part == [number[p] for p in whole.tolist()]


def movie(count, width, height, seed=0):
    """Frames of noise with a bright and a dim spot that cross them."""
    out, (y, x) = noise(seed, count, height, width, low=110, high=122).astype(float), np.mgrid[0:height, 0:width]
    for f in range(count):
        for cx, cy, a in ((4 + 2.0 * f, 10 + 0.5 * f, 70), (width - 3 - 1.5 * f, height - 9, 12)):
            out[f] += a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 6)
    return out.clip(0, 255).astype(np.uint8)


def plain(frames, width, height, fps, s):
    """Detections of a list of planes, every window and frame on its own."""
    shape = dense.Geometry(width, height, s)
    units = [dense.units_of(f, shape).astype(float) for f in frames]
    keep, half, out = ~shape.masked, math.floor(s.window_s * fps / 2 + 0.5), []
    sums = [int(u[keep].sum()) for u in units]
    for t in range(len(units)):
        samples = list(range(max(0, t - half), min(len(units) - 1, t + half) + 1, s.step))
        stack = np.array([units[f] for f in samples])
        background = np.median(stack, axis=0)
        gain = lambda f: (sums[f] * len(samples) - sum(sums[k] for k in samples)) / (len(samples) * keep.sum())  # noqa: B023, E731
        size = np.abs(units[t] - background - gain(t))
        off = stack - background - np.array([[gain(f)] for f in samples])
        bar = np.full(len(size), s.threshold * 64)
        if len(samples) >= 7 and s.noise_factor:
            bar = np.maximum(bar, s.noise_factor * 1.4826 * np.median(np.abs(off - np.median(off, axis=0)), axis=0))
        lit = np.flatnonzero((size > 0.75 * np.maximum(bar, s.threshold * 64)) & keep)
        out += dense.blobs_of(5, t, lit, size[lit], size[lit] > bar[lit], shape) if len(lit) else []
    return out


SETTINGS = DetectSettings(window_s=0.6, step=2, work_width=32, sigma=1.0, merge_radius=3.0, max_area=400.0, threshold=9.0, noise_factor=3.0, regions=((0.0, 0.0, 0.1, 0.2),))
SCHEMA = "video long, frame long, luma binary"


def same(rows, expected):
    key = lambda r: (r["frame"], r["det_idx"])
    rows, expected = sorted((r.asDict() for r in rows), key=key), sorted(expected, key=key)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected):
        assert a == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in b.items()}


def test_run_is_that_of_single_windows(spark, monkeypatch):
    monkeypatch.setattr(dense, "STRIP", 100)
    frames = movie(30, 48, 36)
    df = spark.createDataFrame([(5, f, bytes(p.tobytes())) for f, p in enumerate(frames)], SCHEMA).repartition(3)
    shape = dense.Geometry(48, 36, SETTINGS)
    strips = dense.strips_of(df, lambda luma: dense.units_of(luma, shape), shape.masked, 100)
    near = dense.near(strips, 9, 2, 9.0 * 64, 3.0, shape.kept, shape.masked, strip=100, block=8)
    expected = plain(frames, 48, 36, 30.0, SETTINGS)
    assert {d["strength"] for d in expected} == {"strong", "weak"} and len(expected) > 30
    same(dense.blobs(dense.lit(near), shape).collect(), expected)
    monkeypatch.undo()
    same(dense.found(df, 48, 36, 30.0, SETTINGS).collect(), expected)


def test_a_whole_size_plane_and_its_spot(spark):
    """1440 x 1080, worked on at 960 x 720: one spot, found on every frame where it is."""
    base = noise(3, 1080, 1440, low=118, high=123)
    frames = []
    for f in range(24):
        p = base.copy()
        p[500:506, 200 + 20 * f:206 + 20 * f] += 80
        frames.append((0, f, p.astype(np.uint8).tobytes()))
    df = spark.createDataFrame(frames, SCHEMA)
    found = dense.detected(df, 1440, 1080, 30.0).collect()
    assert len(found) == 24
    for r in found:
        assert abs(r["x"] - (202.5 + 20 * r["frame"])) < 1 and abs(r["y"] - 502.5) < 1 and r["strength"] == "strong"


def test_refusals(spark):
    with pytest.raises(ValueError, match="narrower"):
        dense.Geometry(8, 8, DetectSettings(work_width=8))
    with pytest.raises(ValueError, match="mask"):
        dense.Geometry(64, 64, DetectSettings(regions=((0.0, 0.0, 1.0, 1.0),)))
    twice = spark.createDataFrame([(0, 1, bytes(36 * 48)), (0, 1, bytes(36 * 48))], SCHEMA)
    with pytest.raises(Exception, match="repeat"):
        dense.found(twice, 48, 36, 30.0, SETTINGS).collect()


@pytest.mark.parametrize("cuts", [(30,), (1, 2, 4, 17, 30), (10, 11, 30)])
def test_stream_equals_the_run(spark, tmp_path, cuts):
    from trackloom.streaming.detector import kept_in_rocksdb, stream_detections

    kept_in_rocksdb(spark)
    frames, kind, source = movie(30, 48, 36), SCHEMA + ", ended boolean", str(tmp_path / "in")
    for k, (a, b) in enumerate(zip((0, *cuts), cuts)):
        rows = [(5, f, frames[f].tobytes(), False) for f in range(a, b)] + ([(5, None, None, True)] if b == 30 else [])
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    name = f"stream_{len(cuts)}"
    query = stream_detections(stream, 48, 36, 30.0, SETTINGS).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    same(spark.sql(f"SELECT * FROM {name}").collect(), plain(frames, 48, 36, 30.0, SETTINGS))


def test_a_silent_video_is_flushed_by_its_timer(spark, tmp_path):
    import time

    from trackloom.streaming.detector import kept_in_rocksdb, stream_detections

    kept_in_rocksdb(spark)
    frames, kind = movie(12, 48, 36), SCHEMA + ", ended boolean"
    spark.createDataFrame([(5, f, frames[f].tobytes(), None) for f in range(12)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_detections(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 48, 36, 30.0, SETTINGS, quiet_s=1.0).writeStream.format(
        "memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    expected, began = plain(frames, 48, 36, 30.0, SETTINGS), time.time()
    while time.time() - began < 90 and query.isActive and spark.sql("SELECT * FROM silent").count() < len(expected):
        time.sleep(0.5)
    failure = query.exception()
    query.stop()
    assert failure is None
    same(spark.sql("SELECT * FROM silent").collect(), expected)


def test_a_run_from_planes_to_tracks(spark):
    """The bright spot of the movie is one track, found on every frame that is not near the end of the damage."""
    from trackloom.functions.settings import DetectSettings
    from trackloom.plans import flows

    frames = movie(40, 96, 64)
    rows = [(5, f, frames[f].tobytes(), 333 * f, f % 15 == 0, f == 33) for f in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", pts long, key_frame boolean, decode_error boolean")
    settings = flows.RunSettings(half_window=2, min_travel=10.0, most_turn=3.2, width=96.0, height=64.0, rejoin=None)
    found, ignored, points = flows.detected(df, 96, 64, 30.0, DetectSettings(window_s=0.6, step=2, work_width=96, sigma=1.0, merge_radius=3.0), settings)
    assert [tuple(r)[:3] for r in ignored.select("video", "first", "last").collect()] == [(5, 31, 39)]
    track = {r["frame"]: (r["x"], r["y"]) for r in points.filter("track = 1").collect()}
    assert set(track) >= set(range(2, 31)) and not set(track) & set(range(31, 40))
    assert all(abs(x - (4 + 2.0 * f)) < 1.5 and abs(y - (10 + 0.5 * f)) < 1.5 for f, (x, y) in track.items())
    targets = spark.createDataFrame([(5, 9, f, 4 + 2.0 * f, 10 + 0.5 * f, 70.0 if f % 4 else 1.0, 1.5) for f in range(40)],
                                    "video long, target long, frame long, x double, y double, contrast double, sigma double")
    result = flows.evaluated(points, targets, ignored, settings).collect()
    assert [(r["target"], r["visible"], r["found"], r["completeness"]) for r in result] == [(9, 23, True, 1.0)]


def test_components_take_no_rounds(spark):
    """A snake over a plane is one component; labelling joins nothing, so that nothing goes through the driver."""
    width, height = 64, 48
    snake = [y * width + x for y in range(height) for x in range(width) if y % 4 == 0 or x == (width - 1 if y // 2 % 2 == 0 else 0) and y % 4 == 2 or y % 2 and x == (width - 1 if y % 4 == 1 else 0)]
    rows = [(f, p) for f in range(3) for p in snake] + [(5, 9), (5, 9), (6, 0), (6, width - 1)]
    out = planes.labelled(spark.createDataFrame(rows, "frame long, pixel long"), width)
    got = {(r["frame"], r["pixel"]): r["label"] for r in out.collect()}
    assert set(got) == set(rows) and got[5, 9] == 9 and (got[6, 0], got[6, width - 1]) == (0, width - 1)
    for f in range(3):
        own, seen = set(snake), {}
        for p in snake:
            todo = [] if p in seen else [p]
            while todo:
                q = todo.pop()
                if q not in seen:
                    seen[q] = p
                    todo += [n for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= q % width + dx < width and (n := q + dy * width + dx) in own]
        assert {p: got[f, p] for p in snake} == seen
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Scan parquet" not in plan
