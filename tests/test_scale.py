"""Operators at sizes where their plain forms break: long spans, many candidates of one key."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import intervals, ledger, matching, nearness, rendering, timeline


def test_long_spans_are_few_rows(spark):
    draw = random.Random(1)
    top = 10 ** 9
    spans = [(0, 0, top), (0, 5, 5), (1, 1000, 70_000), (1, 65_536, 65_536 + 131_071), (1, 300_001, 300_001 + 65_536), (2, 7, 7 + intervals.LONG), (3, 3 * top, 3 * top + 10)]
    spans += [(4, a, a + draw.randrange(1, 400_000)) for a in (draw.randrange(10 ** 6) for _ in range(40))]
    table = spark.createDataFrame([(v, a, b, k) for k, (v, a, b) in enumerate(spans)], "video long, first long, last long, span long")
    short, dealt, levels = intervals.long_spans(table, ["video"])
    assert dealt.count() < 25 * len(spans) and max(levels) >= 18 and intervals.in_blocks(short.drop("span")).count() < 70 * len(spans)
    frames = [(v, f) for v in range(6) for f in {draw.randrange(2 * 10 ** 6) for _ in range(300)} | {0, 1, 6, 7, 999, 1000, 65_535, 65_536, 70_000, 70_001, top, top + 1, 3 * top}
              | {x for w, a, b in spans if w == v for x in (a - 1, a, b, b + 1) if x >= 0}]
    rows = spark.createDataFrame(frames, "video long, frame long")
    covering = {(v, f): sorted(k for k, (w, a, b) in enumerate(spans) if w == v and a <= f <= b) for v, f in frames}
    assert {tuple(r) for r in intervals.outside(rows, table, ["video"]).collect()} == {x for x in frames if not covering[x]}
    inside = [tuple(r) for r in intervals.inside(rows, table, ["video"]).collect()]
    assert sorted(inside) == sorted(x for x in frames if covering[x])
    met = {}
    for r in intervals.containing(rows, table, ["video"]).collect():
        met.setdefault((r["video"], r["frame"]), []).append(r["span"])
    assert {k: sorted(v) for k, v in met.items()} == {k: v for k, v in covering.items() if v}


@pytest.mark.parametrize("few", [0, 1000, 200_000])
def test_rounds_take_what_the_order_takes(spark, monkeypatch, few):
    """100,000 candidates of one key."""
    monkeypatch.setattr(matching, "FEW", few)
    draw = random.Random(3)
    pairs = [(1, draw.randrange(40), a, b) for a in range(10_000) for b in {min(9_999, max(0, a + draw.randrange(-30, 31))) for _ in range(10)}]
    free, expected = (set(), set()), set()
    for _, d, a, b in sorted(pairs):
        if a not in free[0] and b not in free[1]:
            free[0].add(a)
            free[1].add(b)
            expected.add((1, d, a, b))
    df = spark.createDataFrame(pairs, "video long, d long, a_id long, b_id long")
    got = [tuple(r) for r in matching.greedy_rounds(df, ["video"], ["d", "a_id", "b_id"], "a_id", "b_id").collect()]
    assert set(got) == expected and len(got) == len(expected)


def shrinks(df) -> bool:
    """Whether a window goes from a row to the end of its key: it is worked out anew for each row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search(r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan))


def test_until_next_key_of_long_videos(spark):
    n = 60_000
    frames = spark.range(n).select(F.lit(0).cast("long").alias("video"), F.col("id").alias("frame"), (F.col("id") % 15 == 0).alias("key_frame"))
    until = timeline.until_next_key(frames)
    assert not shrinks(until)
    assert {(r["frame"], r["until"]) for r in until.filter("frame IN (0, 14, 15, 59984, 59985, 59999)").collect()} == {
        (0, 14), (14, 14), (15, 29), (59984, 59984), (59985, 59999), (59999, 59999)}


def test_until_next_key_of_repeated_frames(spark):
    """A key frame that is given twice does not end before itself."""
    frames = spark.createDataFrame([(0, 0, True), (0, 3, True), (0, 3, True), (0, 5, False)], "video long, frame long, key_frame boolean")
    assert sorted(tuple(r) for r in timeline.until_next_key(frames).collect()) == [(0, 0, 2), (0, 3, 5), (0, 3, 5), (0, 5, 5)]


def test_what_is_left_of_many_jobs(spark):
    n = 60_000
    left = ledger.estimate(spark.range(n).select(F.lit(0).cast("long").alias("device"), F.col("id").alias("job"), F.lit(1.0).alias("spent"), F.lit(2).cast("long").alias("frames")))
    assert not shrinks(left)
    assert {(r["job"], r["left"]) for r in left.filter("job IN (0, 59998, 59999)").collect()} == {(0, 2 * (n - 1)), (59998, 2), (59999, 0)}


@pytest.mark.parametrize("cells", [1, 2, 4])
@pytest.mark.parametrize("strict", [False, True])
def test_near_pairs_by_cells_of_any_size(spark, cells, strict):
    """Pairs at, below and above the radius, on edges of cells and on both sides of 0."""
    draw = random.Random(5)
    spots = [(k % 2, k, draw.choice([draw.uniform(-60, 60), draw.randrange(-12, 12) * 5.0]), draw.choice([draw.uniform(-60, 60), draw.randrange(-12, 12) * 5.0])) for k in range(240)]
    spots += [(0, 240, 0.0, 0.0), (0, 241, 5.0, 0.0), (0, 242, -5.0, 0.0), (0, 243, 3.0, 4.0), (0, 244, 20.0, 0.0), (0, 245, 15.0, 0.0)]
    a = spark.createDataFrame(spots, "page long, a_id long, ax double, ay double")
    b = spark.createDataFrame(spots, "page long, b_id long, bx double, by double")
    got = sorted((r["a_id"], r["b_id"]) for r in matching.near_pairs(a, b, ["page"], 5.0, strict, cells).collect())
    d = lambda p, q: ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5
    assert got == sorted((p[1], q[1]) for p in spots for q in spots if p[0] == q[0] and (d(p, q) < 5.0 if strict else d(p, q) <= 5.0))


def test_markers_deal_spots_to_few_cells(spark):
    """The joins of markers hold a spot about twice, not nine times."""
    spots = spark.range(10_000).select((F.col("id") % 100 * 7.3).alias("bx"), (F.expr("id div 100") * 7.3).alias("by"))
    assert matching.in_cells(spots, 24.0, rendering.MARKER_CELLS).count() < 25_000


def test_crowded_pages_are_tiles_of_bits(spark):
    """Of 5,000 paths that all meet, 12 million pairs are a bit each, and no row holds all paths of a page."""
    paths = spark.range(5000).select(F.lit(1).cast("long").alias("page"), F.col("id").alias("path"))
    points = paths.withColumn("frame", F.explode(F.array([F.lit(k).cast("long") for k in range(3)]))).select(
        "page", "path", "frame", (F.col("frame") * 4.0).alias("x"), (F.col("path") % 7 / 4).alias("y"))
    _, tiles = nearness.near_tiles(points, 20.0)
    held = tiles.select("late", "early", "base", "paths", "early_paths", F.length("bits").alias("bytes")).collect()
    assert {(r["late"], r["early"], r["base"], r["paths"], r["early_paths"]) for r in held} == {(0, 0, 0, 4096, 4096), (1, 0, 4096, 904, 4096), (1, 1, 4096, 904, 904)}
    assert sum(r["bytes"] for r in held) == 4096 * 512 + 904 * 512 + 904 * 120
    assert {(r["path"], r["colour"]) for r in rendering.colours(points, 8, 20.0).collect()} == {(k, k % 8) for k in range(5000)}


@pytest.mark.parametrize("cells", [1 << 21, 900])
def test_colours_of_many_blocks(spark, monkeypatch, cells):
    """Blocks of few paths, and cells that grow over wide pages, give the colours of the plain rule; a path without a name
    or a place is near nothing."""
    monkeypatch.setattr(nearness, "SPOTS", 700)
    monkeypatch.setattr(nearness, "LEAST", 7)
    monkeypatch.setattr(nearness, "CELLS", cells)
    monkeypatch.setattr(nearness, "TESTS", 64)
    draw, rows = random.Random(11), []
    for page in range(2):
        for path in range(230):
            x, y = draw.choice([(draw.uniform(-300, 300), draw.uniform(-200, 200)), (draw.randrange(-15, 15) * 20.0, draw.randrange(-10, 10) * 20.0)])
            for frame in range(draw.choice([1, 1, 2, 5, 30])):
                rows.append((page, path, frame, x, y))
                x, y = x + draw.choice([0.0, 3.0, 12.0, draw.uniform(-9, 9)]), y + draw.choice([0.0, 4.0, 16.0, draw.uniform(-9, 9)])
    rows += [(0, 300, 0, None, None), (0, None, 0, 0.0, 0.0), (None, 1, 0, 0.0, 0.0), (None, 2, 0, 0.0, 0.0), (1, 301, 0, float("nan"), 1.0)]
    points = spark.createDataFrame(rows, "page long, path long, frame long, x double, y double")
    got = {(r["page"], r["path"]): r["colour"] for r in rendering.colours(points, 5, 20.0).collect()}
    expected = {}
    for page in (0, 1, None):
        spots, used, done = {}, [0] * 5, {}
        for path in sorted({r[1] for r in rows if r[0] == page}, key=lambda p: (p is not None, p)):
            own = np.array([r[3:] for r in rows if r[:2] == (page, path)], float)
            length = np.append(0.0, np.cumsum(np.hypot(*np.diff(own, axis=0).T))).round(6)
            at = np.arange(0, max(1, math.ceil(length[-1] / 5.0))) * 5.0 if np.isfinite(length[-1]) else np.zeros(0)
            at = at[at < length[-1]]
            mine = np.stack([np.append(np.interp(at, length, c).round(9), c[-1]) for c in own.T], 1)
            mine = mine[np.isfinite(mine).all(1) & (page is not None and path is not None)]
            near = [done[o] for o in done if len(mine) and len(spots[o]) and np.sqrt(((mine[:, None] - spots[o][None]) ** 2).sum(2)).min() < 20.0]
            c = min(range(5), key=lambda k: (near.count(k), used[k], k))
            used[c] += 1
            spots[path], done[path] = mine, c
        expected |= {(page, p): c for p, c in done.items()}
    assert got == expected
