"""Generators and synthetic targets."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from trackloom.functions.seeded import Draws, split_mix
from trackloom.operators import generation as g, rendering
from trackloom.operators.rendering import merge_zones


def test_split_mix_is_the_published_stream():
    stream = split_mix(1234567)
    assert [next(stream) for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_bounded_draws():
    draws = Draws(7)
    values = [draws.below(3) for _ in range(3000)]
    assert set(values) == {0, 1, 2} and all(800 < values.count(k) < 1200 for k in range(3))
    assert all(2 <= draws.uniform(2, 5) < 5 for _ in range(1000))


def test_flights_and_turns():
    scene = g.Scene()
    for seed in range(30):
        path = g.passing(Draws(seed), scene, 3.0)
        assert len(path) >= 2 and not (0 < path[0][0] < scene.width and 0 < path[0][1] < scene.height)
        hunt = g.hunting(Draws(seed), scene, 3.0, "hunt")
        assert 2 <= len(hunt) <= 120
    steps = g.turn(20.0, 0.3, 0.2, 1.0)
    assert abs(sum(by for _, by in steps) - 1.0) < 1e-9 and min(s for s, _ in steps) < 20 * 0.5
    assert len(g.turn(20.0, 0.25, 0.15, 100.0)) == 60
    assert g.progress(5, 0)[-1] == 1.0 or math.isclose(g.progress(5, 0)[-1], 1.0)


def test_targets_keep_apart(spark):
    df = spark.createDataFrame([(v, f, 700.0, 500.0) for v in range(2) for f in range(0, 900, 10)], "video long, frame long, x double, y double")
    classes = [("pass", 20.0, 1.5), ("hunt", 10.0, 3.0), ("circle", 30.0, 1.5)]
    rows = g.targets(df, classes, 4, 5).collect()
    assert {r["motion"] for r in rows} == {"pass", "hunt", "circle"} and {r["video"] for r in rows} == {0, 1}
    by = {}
    for r in rows:
        assert 0.6 * r["amplitude"] <= r["contrast"] <= r["amplitude"] and 0 <= r["frame"] < 900
        by.setdefault((r["video"], r["frame"]), []).append((r["x"], r["y"]))
    for (_, frame), own in by.items():
        assert all(math.dist(a, b) >= 60 for i, a in enumerate(own) for b in own[i + 1:])
        assert frame % 10 or all(math.dist(a, (700, 500)) >= 60 for a in own)
    again = g.targets(df.repartition(5), classes, 4, 5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_zones_merge_to_a_fixpoint():
    made = merge_zones([(0, 0, 10, 10), (10, 10, 30, 20), (100, 100, 120, 130)], 1440, 1080)
    assert made == [(0, 0, 32, 32), (100, 100, 120, 130)]


def brute_zones(boxes):
    """Merging as the reference states it, on (left, top, width, height) of a frame of 1440 x 1080."""
    def side(start, length, limit):
        length = min((length + 15) // 16 * 16, limit)
        return min(start, limit - length), length

    zones, k = [(x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in boxes], True
    while k:
        k = False
        for i, j in itertools.combinations(range(len(zones)), 2):
            (ax, ay, aw, ah), (bx, by, bw, bh) = zones[i], zones[j]
            if max(ax, bx) <= min(ax + aw, bx + bw) and max(ay, by) <= min(ay + ah, by + bh):
                left, top = min(ax, bx), min(ay, by)
                (x, w), (y, h) = side(left, max(ax + aw, bx + bw) - left, 1440), side(top, max(ay + ah, by + bh) - top, 1080)
                last = zones.pop()
                if j < len(zones):
                    zones[j] = last
                zones[i], k = (x, y, w, h), True
                break
    return [(x, y, x + w, y + h) for x, y, w, h in zones]


def test_zones_are_those_of_whole_pages(spark):
    from trackloom.plans import registry

    folder = "/root/testdata/sf0.001"
    pages = defaultdict(list)
    for r in registry.Tables(spark, folder)("detections").orderBy("det_idx").collect():
        x, y = math.floor(r["x"]), math.floor(r["y"])
        pages[r["frame"] // 20].append((x, y, x + 60, y + 40))
    expected = {(page, k, *z) for page, boxes in pages.items() for k, z in enumerate(brute_zones(boxes))}
    assert max(map(len, pages.values())) > 100
    assert {tuple(r) for r in registry.queries()["g28_merged_zones"](spark, folder).collect()} == expected


def sampled_path(path, step):
    """Spots every so far along a path (points x 2) and at its end."""
    reached = np.append(0.0, np.cumsum(np.hypot(*np.diff(path, axis=0).T))) if len(path) > 1 else np.zeros(1)
    at = np.arange(0, max(1, math.ceil(reached[-1] / step))) * step
    at = np.append(at[at < reached[-1]], reached[-1])
    spots = np.stack([np.interp(at, reached, path[:, c]) for c in (0, 1)], axis=1)
    spots[-1] = path[-1]
    return spots


def test_colours_are_those_of_the_plain_rule(spark):
    draw = random.Random(3)
    rows = [(page, path, f, draw.uniform(0, 300) + 2 * f, draw.uniform(0, 300)) for page in range(3) for path in range(25) for f in range(draw.randint(1, 4))]
    out = {(r["page"], r["path"]): r["colour"] for r in rendering.colours(spark.createDataFrame(rows, "page long, path long, frame long, x double, y double"), 4, 20.0).collect()}
    for page in range(3):
        paths = {}
        for p, path, _, x, y in rows:
            if p == page:
                paths.setdefault(path, []).append((x, y))
        spots = {k: sampled_path(np.array(v), 5.0) for k, v in paths.items()}
        done = {}
        for path in sorted(paths):
            near = [done[o] for o in done if np.hypot(*(spots[path][:, None] - spots[o][None]).transpose(2, 0, 1)).min() < 20]
            done[path] = min(range(4), key=lambda c: (near.count(c), list(done.values()).count(c), c))
        assert {k: out[page, k] for k in paths} == done


def brute_markers(paths, width, height, radius, clear):
    """Centres by the plain rule: every candidate weighed anew."""
    def spots(p):
        reached = [0.0]
        for a, b in zip(p, p[1:]):
            reached.append(reached[-1] + math.dist(a, b))
        out, total, k = [], reached[-1], 0
        while k * radius / 2 < total:
            at = k * radius / 2
            i = max(j for j in range(len(p) - 1) if reached[j] <= at)
            s = (at - reached[i]) / (reached[i + 1] - reached[i])
            out.append((p[i][0] + (p[i + 1][0] - p[i][0]) * s, p[i][1] + (p[i + 1][1] - p[i][1]) * s, math.floor(1000 * at / total + 0.5)))
            k += 1
        return [*out, (*p[-1], 1000 if total else 0)], total

    own, ends = [spots(p) for p in paths], [p[-1] for p in paths] if clear else []
    inset = radius + 2

    def met(c, others):
        return sum(math.dist(c, o) < 2 * radius + 2 for o in others), sum(math.dist(c, e) < clear for e in ends)

    def best(k, others):
        first = None
        for ring in range(41):
            found = []
            for x, y, share in own[k][0]:
                for turn in range(16 if ring else 1):
                    angle, away = math.tau * turn / 16, ring * radius / 2
                    c = (min(max(x + away * math.cos(angle), inset), width - inset), min(max(y + away * math.sin(angle), inset), height - inset))
                    cost = 1000 * sum(math.dist(c, s[:2]) < 2 * radius for j, (o, _) in enumerate(own) if j != k for s in o) + 2 * abs(share - 250)
                    found.append(((*met(c, others), cost, share), c))
            one = min(found, key=lambda f: f[0])
            first = first or one
            if not one[0][0]:
                return one
        return first

    order, chosen = sorted(range(len(paths)), key=lambda k: own[k][1]), {}
    for k in order:
        chosen[k] = best(k, list(chosen.values()))[1]
    for _ in range(8):
        before = dict(chosen)
        for k in order:
            others = [c for j, c in chosen.items() if j != k]
            now = met(chosen[k], others)
            if now != (0, 0) and (one := best(k, others))[0][:2] < now:
                chosen[k] = one[1]
        if before == chosen:
            break
    return chosen


@pytest.mark.parametrize("clear", [0.0, 30.0])
def test_markers_are_those_of_the_plain_rule(spark, clear):
    draw = random.Random(6)
    pages = [[[(200.0, 200.0), (600.0, 200.0)], [(200.0, 205.0), (600.0, 205.0)], [(400.0, 100.0), (400.0, 500.0)], [(30.0, 30.0)], [(30.0, 30.0)], [(31.0, 30.0), (35.0, 30.0)]],
             [[(200.0, 200.0), (600.0, 200.0)]],
             [[(draw.uniform(0, 120), draw.uniform(0, 90)) for _ in range(draw.randint(1, 4))] for _ in range(8)]]
    df = spark.createDataFrame([(g, k, f, *p) for g, paths in enumerate(pages) for k, own in enumerate(paths) for f, p in enumerate(own)], "page long, path long, frame long, x double, y double")
    made = {}
    for r in rendering.markers(df, 1440, 1080, 12.0, clear).collect():
        made.setdefault(r["page"], {})[r["path"]] = (r["x"], r["y"])
    for g, paths in enumerate(pages):
        expected = brute_markers(paths, 1440, 1080, 12.0, clear)
        assert made[g].keys() == expected.keys()
        for k, c in expected.items():
            assert math.dist(made[g][k], c) < 1e-6, (g, k)
    if not clear:
        assert made[1] == {0: (302.0, 200.0)}  # a quarter of the way, in steps of half a radius
    assert rendering.markers(df.limit(0), 1440, 1080, 12.0).collect() == []


def test_lengths_of_curves_are_worked_out_by_columns(spark):
    """A fold over the shares of a curve, row by row, took minutes for a million rows."""
    rows = [(0.0, 0.0, 3.0, 4.0, 6.0, 8.0), (1.5, 2.0, 700.5, 30.0, 1440.0, 900.25), (1.0, None, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    length = rendering.bezier_length(*((df[f"{p}x"], df[f"{p}y"]) for p in "abc"))
    made = df.select(length.alias("length"))
    at = lambda p, q, r, t: (1 - t) * (1 - t) * p + 2 * (1 - t) * t * q + t * t * r
    plain = lambda r: sum(math.sqrt(sum((at(*r[i::2], k / 64) - at(*r[i::2], (k - 1) / 64)) ** 2 for i in (0, 1))) for k in range(1, 65))
    assert [r["length"] for r in made.collect()] == [pytest.approx(10.0), pytest.approx(plain(rows[1]), rel=1e-12), None]
    assert "lambdafunction" not in made._jdf.queryExecution().executedPlan().toString()
