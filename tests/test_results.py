"""Result documents, pages, marker placement and kernels."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from trackloom.operators import planes, rendering
from trackloom.sources import results


def test_documents_round_trip_and_broken_ones_show(spark, tmp_path):
    df = spark.sql("SELECT 'a.mp4' AS video, 25.0D AS fps, 'done' AS state, 3L AS track_count")
    results.write_params(df, str(tmp_path / "one"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "params.json").write_text('{"video": "b.mp4", ')
    back = results.read_params(spark, str(tmp_path / "one")).first()
    assert (back["video"], back["fps"], back["track_count"], back["broken"]) == ("a.mp4", 25.0, 3, None)
    broken = results.read_params(spark, str(tmp_path / "two")).first()
    assert broken["state"] is None and broken["broken"]


def test_page_escapes_and_orders(spark, tmp_path):
    df = spark.createDataFrame([("b", "<x>", None), ("a", "&", 1)], "video string, note string, n long")
    results.write_page(results.page(df, "T & T", ["video", "note", "n"], "video"), str(tmp_path / "page"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "page")).collect()]
    assert lines[0].startswith("<!doctype html>") and "T &amp; T" in lines[0] and lines[-1] == "</table>"
    assert lines[1] == "<tr><td>a</td><td>&amp;</td><td>1</td></tr>" and lines[2] == "<tr><td>b</td><td>&lt;x&gt;</td><td></td></tr>"


def test_markers_keep_clear(spark):
    draw = random.Random(1)
    rows = [(p, k, f, 100 + 20.0 * f + draw.uniform(0, 30), 100 + 60.0 * (k // 2) + draw.uniform(0, 30)) for p in range(2) for k in range(8) for f in range(12)]
    out = rendering.markers(spark.createDataFrame(rows, "page long, path long, frame long, x double, y double"), 600, 500, 8.0).collect()
    for page in range(2):
        own = [(r["x"], r["y"]) for r in out if r["page"] == page]
        assert len(own) == 8 and all(10 <= x <= 590 and 10 <= y <= 490 for x, y in own)
        assert all(math.dist(a, b) >= 18 for i, a in enumerate(own) for b in own[i + 1:])


def test_kernels_are_exact_and_symmetric():
    for sigma in (0.5, 0.8, 1.5, 3.0):
        weights = planes.kernel(sigma)
        assert sum(weights) == 4096 and weights == weights[::-1] and max(weights) == weights[len(weights) // 2]


def test_area_weights_cover_each_pixel():
    for source, work in ((8, 5), (9, 3), (10, 10)):
        table = planes.axis_weights(source, work)
        assert all(sum(a for s, w, a in table if w == k) == source for k in range(work))
        assert all(sum(a for s, w, a in table if s == k) == work for k in range(source))


def test_covered_blocks(spark):
    spans = F.array(F.struct(F.lit(0).alias("first"), F.lit(64).alias("last")))
    row = spark.range(1).select(*(rendering.block_covered(F.lit(a), F.lit(b), spans).alias(n) for n, a, b in (("yes", 0, 63), ("no", 1, 64)))).first()
    assert row["yes"] and not row["no"]
