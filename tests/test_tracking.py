"""The tracker on small scenes, in batch and as a stream."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest

from trackloom.operators import tracking
from trackloom.operators.tracking import TrackSettings, tracked
from trackloom.streaming.tracker import stream_counts, stream_tracks

ROW = "video long, frame long, det_idx long, x double, y double, strength string"
FREE = TrackSettings(width=10_000, height=10_000)


def scene(*flights, strength="strong"):
    rows, k = [], 0
    for points in flights:
        for frame, x, y, *rest in points:
            rows.append((1, frame, k, float(x), float(y), rest[0] if rest else strength))
            k += 1
    return sorted(rows, key=lambda r: (r[1], r[2]))


def names(spark, rows, settings=FREE):
    out = tracked(spark.createDataFrame(rows, ROW), settings).collect()
    tracks = {}
    for r in out:
        tracks.setdefault(r["track"], []).append((r["frame"], r["det_idx"]))
    return {k: sorted(v) for k, v in tracks.items()}


def line(frames, x, y, vx, vy):
    return [(f, x + vx * f, y + vy * f) for f in frames]


def test_straight_flight_is_one_track(spark):
    assert len(names(spark, scene(line(range(20), 1000, 1000, 10, 5)))) == 1


def test_crossing_flights_stay_apart(spark):
    a, b = line(range(30), 1000, 1000, 10, 0), line(range(30), 1150, 850, 0, 10)
    out = names(spark, scene(a, b))
    assert sorted(len(v) for v in out.values()) == [30, 30]
    assert all(len({i // 30 for _, i in v}) == 1 for v in out.values())


@pytest.mark.parametrize(("empty", "count"), [(6, 1), (7, 2)])
def test_gap_of_the_bound_is_bridged(spark, empty, count):
    frames = [*range(10), *range(10 + empty, 20 + empty)]
    assert len(names(spark, scene(line(frames, 1000, 1000, 2, 0)))) == count


def test_weak_detections_fill_but_never_open(spark):
    assert names(spark, scene(line(range(10), 1000, 1000, 2, 0), strength="weak")) == {}
    flight = [(f, 1000 + 2 * f, 1000, "weak" if f == 5 else "strong") for f in range(10)]
    assert [len(v) for v in names(spark, scene(flight)).values()] == [10]


def test_established_track_goes_first(spark):
    # the old track expects (1030, 1000); the newborn at (1036, 1000) is nearer to (1034, 1000)
    rows = scene([(0, 1000, 1000), (1, 1010, 1000), (2, 1020, 1000), (3, 1034, 1000)], [(2, 1036, 1000)])
    out = names(spark, rows)
    assert sorted(len(v) for v in out.values()) == [1, 4]


def test_invariants_and_pieces(spark):
    draw = random.Random(1)
    rows = [(v, f, v * 100_000 + f * 50 + k, draw.uniform(0, 400), draw.uniform(0, 400), draw.choice(["strong", "strong", "weak"]))
            for v in range(2) for f in [*range(60), *range(75, 130)] for k in range(draw.randint(0, 6))]
    df = spark.createDataFrame(rows, ROW)
    out = tracked(df, FREE).collect()
    assert len({r["det_idx"] for r in out}) == len(out)
    by = {}
    for r in out:
        by.setdefault((r["video"], r["track"]), []).append(r["frame"])
    strong = {r[2] for r in rows if r[5] == "strong"}
    assert all(len(set(f)) == len(f) for f in by.values()) and all(t in strong for _, t in by)
    assert strong <= {r["det_idx"] for r in out}
    assert all(b - a <= 7 for f in by.values() for a, b in zip(sorted(f), sorted(f)[1:]))
    assert tracked(df.limit(0), FREE).count() == 0


def test_settings_are_checked():
    for bad in ({"max_jump": 0}, {"max_gap": -1}, {"travel": math.nan}, {"margin": math.inf}):
        with pytest.raises(ValueError):
            TrackSettings(**bad)


def test_stream_gives_the_tracks_of_the_batch(spark, tmp_path):
    draw = random.Random(2)
    rows = [(v, f, v * 100_000 + f * 50 + k, draw.uniform(0, 300), draw.uniform(0, 300), "strong") for v in range(3) for f in range(40) for k in range(draw.randint(0, 3))]
    expected = {tuple(r) for r in tracked(spark.createDataFrame(rows, ROW), FREE).select("video", "track", "frame", "det_idx").collect()}
    source = str(tmp_path / "in")
    kind = ROW + ", ended boolean"
    # the rows of frames 14 and 27 come in two batches
    first, last = [r for r in rows if r[1] in (14, 27) and r[2] % 2], [r for r in rows if r[1] in (14, 27) and not r[2] % 2]
    whole = [r for r in rows if r[1] not in (14, 27)]
    for part, (lo, hi) in enumerate(((0, 15), (15, 28), (28, 40))):
        own = [(*r, False) for r in [*(x for x in whole if lo <= x[1] < hi), *(x for x in first if lo <= x[1] < hi), *(x for x in last if lo <= x[1] + 1 < hi)]]
        own += [(v, None, None, None, None, None, True) for v in range(3)] if hi == 40 else []
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{source}/{part}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    query = stream_tracks(stream, FREE).writeStream.format("memory").queryName("tracks_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT video, track, frame, det_idx FROM tracks_out").collect()}
    assert got == expected


def test_stream_counts(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, 'a' AS event_type, 1.5D AS value FROM range(100)").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    query = stream_counts(stream).writeStream.format("memory").queryName("counts_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n), sum(total), count(*) FROM counts_out").first()[:] == (100, 150.0, 10)


def plain_tracks(rows, s):
    """The tracker's rules, frame by frame, over one video: rows of frame, det_idx, x, y, strong."""
    def edge(x, y):
        return min(x, s.width - x, y, s.height - y) < s.edge

    def expectation(points, frame):
        (t, x, y), before = points[-1][:3], points[:-1]
        if not before:
            return x, y, math.inf
        far = [p for p in before if t - p[0] >= s.span]
        o = far[-1] if far else before[-1]
        vx, vy = (x - o[1]) / (t - o[0]), (y - o[2]) / (t - o[0])
        f = points[-s.tail:][0]
        tail = math.hypot(x - f[1], y - f[2]) / (t - f[0])
        now = math.hypot(vx, vy)
        reach = math.inf if edge(x, y) or edge(o[1], o[2]) else s.margin + s.travel * (tail if now < s.slump * tail else now) * (frame - t)
        return x + vx * (frame - t), y + vy * (frame - t), reach

    live, done = [], []
    for frame in sorted({r[0] for r in rows}):
        done += [p for p in live if frame - p[-1][0] - 1 > s.max_gap]
        live = [p for p in live if frame - p[-1][0] - 1 <= s.max_gap]
        here = sorted(r for r in rows if r[0] == frame)
        used, met = set(), set()
        guess = [(*expectation(p, frame), len(p) == 1) for p in live]
        for strong in (True, False):
            options = sorted((guess[i][3], math.hypot(r[2] - guess[i][0], r[3] - guess[i][1]), i, k) for i in range(len(guess)) for k, r in enumerate(here) if r[4] is strong)
            for _, miss, i, k in options:
                x, y = here[k][2:4]
                if i not in met and k not in used and miss <= s.max_jump and (miss <= guess[i][2] or edge(x, y)):
                    met.add(i)
                    used.add(k)
                    live[i].append((frame, x, y, here[k][1]))
        live += [[(frame, r[2], r[3], r[1])] for k, r in enumerate(here) if r[4] and k not in used]
    return {(p[0][3], q[0], q[3]) for p in [*done, *live] for q in p}


def test_tracks_are_those_of_the_plain_rules(spark):
    draw = random.Random(11)
    small = TrackSettings(width=500, height=400)
    rows = [(1, f, f * 50 + k, draw.uniform(0, 500), draw.uniform(0, 400), draw.choice(["strong", "strong", "weak"])) for f in [*range(50), *range(70, 110)] for k in range(draw.randint(0, 5))]
    rows += [(1, f, 10_000 + f, 40.0 + 4 * f, 60.0 + 2 * f, "strong") for f in range(100) if f % 13]
    out = {(r["track"], r["frame"], r["det_idx"]) for r in tracked(spark.createDataFrame(rows, ROW), small).collect()}
    assert out == plain_tracks([(f, k, x, y, st == "strong") for _, f, k, x, y, st in rows], small)


def test_tracks_of_the_registered_query(spark):
    from trackloom.plans import registry

    folder = "/root/testdata/sf0.001"
    rows = registry.Tables(spark, folder)("detections").select("video", "frame", "det_idx", "x", "y", "strength").collect()
    out = {(r["video"], r["track"], r["frame"], r["det_idx"]) for r in registry.queries()["s01_tracks"](spark, folder).collect()}
    expected = {(v, *p) for v in {r["video"] for r in rows} for p in plain_tracks([(r["frame"], r["det_idx"], r["x"], r["y"], r["strength"] == "strong") for r in rows if r["video"] == v], TrackSettings())}
    assert out == expected


def test_run_excludes_tracks_and_judges(spark):
    from trackloom.plans import flows

    frames = spark.createDataFrame([(1, f, 333 * f, f % 15 == 0, f == 400) for f in range(460)], "video long, frame long, pts long, key_frame boolean, decode_error boolean")
    det = "video long, frame long, det_idx long, x double, y double, area double, amplitude double, width double, height double, strength string"
    fly = lambda lo, hi, x, y, vx, vy, k: [(1, f, k * 1000 + f, float(x + vx * (f - lo)), float(y + vy * (f - lo)), 10.0, 30.0, 4.0, 4.0, "strong") for f in range(lo, hi)]
    # a flight with a hole of 10 frames, its twin beside it, a still spot, a flight in the damage, a short piece far away
    rows = fly(10, 40, 100, 100, 10, 5, 1) + fly(50, 80, 500, 300, 10, 5, 2) + fly(10, 30, 110, 104, 10, 5, 3) + fly(100, 160, 700, 700, 0.1, 0, 4)
    rows += fly(395, 408, 200, 500, 12, 0, 5) + fly(300, 303, 900, 200, 5, 5, 6)
    detections = spark.createDataFrame(rows, det)
    kept, ignored = flows.excluded(frames, detections)
    assert [(r["first"], r["last"]) for r in ignored.collect()] == [(385, 419)]
    points = flows.tracked(kept, ignored).collect()
    assert {r["track"] for r in points} == {1} and sorted(r["frame"] for r in points) == [*range(10, 40), *range(50, 80)]
    apart = flows.tracked(kept, ignored, flows.RunSettings(rejoin=None)).collect()
    assert {r["track"] for r in apart} == {1, 2}
    truth = spark.createDataFrame([(1, 7, f, 100.0 + 10 * (f - 10), 100.0 + 5 * (f - 10), 20.0) for f in range(10, 80)] + [(1, 8, f, 1000.0, 900.0, 20.0) for f in range(20)],
                                  "video long, target long, frame long, x double, y double, contrast double")
    out = {r["target"]: r for r in flows.replayed(frames, detections, truth, flows.RunSettings()).collect()}
    assert out[7]["found"] and out[7]["fragments"] == 1 and abs(out[7]["completeness"] - 60 / 70) < 1e-6 and not out[8]["found"]
    strict = {r["target"]: r for r in flows.replayed(frames, detections, truth, flows.RunSettings(min_hits=61, rejoin=None)).collect()}
    assert not strict[7]["found"]


def test_rejoining_rules(spark):
    """One video a case: flights (first and last frame, place, speed), ignored spans, and the links expected."""
    from trackloom.operators import matching

    a, b = (0, 20, 300, 300, 10, 0), (30, 50, 600, 300, 10, 0)
    cases = [
        ([a, b], [], {(0, 1)}),
        ([a, b], [(22, 24)], set()),
        ([a, b], [(0, 19)], {(0, 1)}),
        ([a, (26, 50, 560, 300, 10, 0)], [], set()),  # six hidden frames: the tracker's own gap
        ([a, (40, 60, 700, 300, 10, 0)], [], set()),  # twenty
        ([a, (30, 50, 600, 380, 10, 0)], [], set()),  # too far
        ([(0, 20, 300, 10, 10, 0), (30, 50, 600, 10, 10, 0)], [], set()),  # at the edge
        ([(0, 3, 300, 300, 10, 0), (13, 16, 430, 300, 10, 0)], [], set()),  # two pieces
        ([a, (30, 33, 600, 300, 10, 0)], [], {(0, 1)}),  # a piece
        ([a, (30, 33, 595, 300, 2, 0)], [], set()),  # a piece too slow
        ([a, (30, 50, 510, 300, 1, 0)], [], set()),  # the way across too slow
        ([a, b, (30, 33, 600, 301, 10, 0)], [], {(0, 1)}),  # kept tracks before pieces
    ]
    rows = [(v, t, f, float(x + vx * (f - lo)), float(y + vy * (f - lo))) for v, (flights, _, _) in enumerate(cases)
            for t, (lo, hi, x, y, vx, vy) in enumerate(flights) for f in range(lo, hi)]
    points = spark.createDataFrame(rows, "video long, track long, frame long, x double, y double")
    ignored = spark.createDataFrame([(v, *span) for v, (_, spans, _) in enumerate(cases) for span in spans], "video long, first long, last long")
    got = {v: set() for v in range(len(cases))}
    for r in matching.rejoined(matching.rejoinable(points, ignored)).collect():
        got[r["video"]].add((r["a_id"], r["b_id"]))
    assert got == {v: links for v, (_, _, links) in enumerate(cases)}


def test_stream_of_windows_is_that_of_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from trackloom.operators import dense, planes
    from trackloom.streaming.lookahead import stream_windows

    draw = random.Random(5)
    data = [[draw.randint(0, 255) for _ in range(6)] for _ in range(23)]
    flat = spark.createDataFrame([(f, k, v) for f, plane in enumerate(data) for k, v in enumerate(plane)], "frame long, pixel int, value int")
    windows = planes.sampled(flat.select("frame").distinct(), 5, 2)
    medians = dense.backgrounds(dense.packed(flat), 5, 2).groupBy("frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pixel", "background"))), lambda s: s["background"]).alias("background"))
    expected = {r["frame"]: (round(r["gain"], 9), r["background"]) for r in planes.gains(flat, windows).join(medians, "frame").collect()}
    kind, source = "video long, frame long, plane array<int>, ended boolean", str(tmp_path / "in")
    for part, (lo, hi) in enumerate(((0, 4), (4, 15), (15, 23))):
        own = [(1, f, data[f], False) for f in range(lo, hi)] + ([(1, None, None, True)] if hi == 23 else [])
        spark.createDataFrame(own, kind).coalesce(1).write.parquet(f"{source}/{part}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    query = stream_windows(stream, 5, 2).writeStream.format("memory").queryName("windows_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["frame"]: (round(r["gain"], 9), r["background"]) for r in spark.sql("SELECT * FROM windows_out").collect()}
    assert got == expected and len(got) == 23


def test_a_piece_is_not_held_whole(spark):
    """Frames come one by one whatever the batches, and an open track keeps only what the next frame looks at."""
    rows = [(0, 0, f, 2 * f + k, 5.0 * f % 700, 100.0 + 300 * k, "strong") for f in range(300) for k in range(2)]
    frame = pd.DataFrame(rows, columns=["video", "piece", "frame", "det_idx", "x", "y", "strength"])
    asked = []

    def batches():
        for k in range(0, len(frame), 7):
            asked.append(k)
            yield frame.iloc[k:k + 7]

    along = tracking.frames_along(batches(), ["video", "piece"])
    first = [next(along) for _ in range(3)]
    assert first == [((0, 0), f, [(5.0 * f, 100.0, 2 * f, True), (5.0 * f, 400.0, 2 * f + 1, True)]) for f in range(3)] and len(asked) <= 2
    assert [f for _, f, _ in along] == list(range(3, 300))
    df = spark.createDataFrame([(v, f, d, x, y, s) for v, _, f, d, x, y, s in rows], ROW)
    tracker, done = tracking.Tracker(FREE), []
    for f in range(300):
        done += tracker.advance(f, [(x, y, d, True) for _, _, at, d, x, y, _ in rows[2 * f:2 * f + 2]])
    whole = {(t.name, *p) for t in [*done, *tracker.flush()] for p in t.points}
    assert {(r["track"], r["frame"], r["x"], r["y"], r["det_idx"]) for r in tracked(df, FREE).collect()} == whole
    assert "FlatMapGroupsInPandas" not in tracked(df, FREE)._jdf.queryExecution().executedPlan().toString()
