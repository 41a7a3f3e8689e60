"""Sinks and sources as round trips: a table is written in a format of the library and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.lineage import scratch
from trackloom.operators import planes
from trackloom.plans.adapters import oracle
from trackloom.sources import planes as plane_files
from trackloom.sources import recordings

MEASURES = ["x", "y", "area", "amplitude", "width", "height", "strength"]


def _measured(t, name: str):
    return t(name).select("*", (F.col("x") - F.col("width") / 2).alias("left"), (F.col("y") - F.col("height") / 2).alias("top"))


def _frames(t):
    """Recorded frames of the first video as gzipped lines, entries with their nested detections."""
    found = _measured(t, "detections").filter("video = 0").groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(
        "det_idx", "x", "y", "left", "top", "width", "height", "area", "amplitude", "strength"))).alias("all_"))
    lines = t("frames").filter("video = 0").join(found, "frame", "left").select(
        "frame", "pts", "key_frame", "decode_error", F.coalesce(F.transform("all_", lambda d: d.dropFields("det_idx")), F.array()).alias("detections"))
    path = scratch(t.spark) + "/frames.jsonl.gz"
    recordings.write_lines(lines, path, gzip=True)
    return recordings.read_frames(t.spark, path)


def _tracks(t):
    points = F.array_sort(F.collect_list(F.struct("frame", "x", "y", "left", "top", "width", "height", "area", "amplitude", "strength")))
    path = scratch(t.spark) + "/tracks.jsonl"
    recordings.write_lines(_measured(t, "scene_points").groupBy(F.expr("video * 10000000 + track").alias("id")).agg(points.alias("points")), path)
    return recordings.read_tracks(t.spark, path).select("track", "frame", *MEASURES)


def _table(t):
    path = scratch(t.spark) + "/tracks.csv"
    rows = t("orders").select(
        F.col("o_orderkey").alias("id"), F.lit("0:00:01").alias("start"), F.lit("0:00:02").alias("end"), F.col("o_totalprice").alias("start_s"), F.lit(1.0).alias("duration_s"),
        F.col("o_custkey").alias("hits"), F.lit(2.5).alias("chord_px"), (F.col("o_custkey") / 4).alias("path_px"), F.lit(0.0).alias("speed_px_s"), F.col("o_custkey").alias("max_area_px"),
        F.lit(8.0).alias("peak_amplitude"), F.lit(0).cast("long").alias("filled_frames"))
    recordings.write_table(rows, path)
    return recordings.read_table(t.spark, path).select("id", "start", "start_s", "hits", "path_px")


def _verdicts(t):
    path = scratch(t.spark) + "/verdicts"
    rows = t("verdicts").select(F.concat(F.lit("été "), "video").alias("video"), F.col("row_id").cast("string").alias("track"), F.lit("").alias("start"), "start_s", F.trim("verdict").alias("verdict"),
                                F.when(F.col("row_id") % 3 == 0, 'a "b"; c').alias("species"), "start_x", "start_y")
    recordings.write_verdicts(rows, path, "fr")
    return recordings.read_verdicts(t.spark, path).select("video", F.col("track").cast("bigint").alias("row_id"), F.round("start_s", 1).alias("start_s"), "verdict", "species", F.round("start_y", 1).alias("start_y"))


def _clips(t):
    """Two overlapping clips of the planes, written in one pass and read by ranges of frames."""
    frames = planes.luma_of(t("planes"))
    folder = scratch(t.spark)
    plane_files.write_clips(frames, folder, [("whole", 0, 10 ** 9), ("part", 100, 299)])
    some = plane_files.read_planes(t.spark, folder + "/part").filter("frame >= 150 AND frame < 400").select(F.lit("part").alias("clip"), "*")
    rest = plane_files.read_planes(t.spark, folder + "/whole").filter("frame <= 120").select(F.lit("whole").alias("clip"), "*")
    return some.unionByName(rest).select("clip", "frame", F.lower(F.hex("luma")).alias("luma"))


def _published(t):
    path = scratch(t.spark) + "/table"
    recordings.publish(t("nation"), path)
    return t.spark.read.parquet(path)


LUMA = "SELECT frame, string_agg(lower(printf('%02x', value)), '' ORDER BY pixel) AS luma FROM planes GROUP BY frame"

QUERIES = {
    "a03_recorded_frames": (lambda t: _frames(t)[0], "SELECT frame, pts, key_frame, decode_error FROM frames WHERE video = 0"),
    "a03_recorded_detections": (lambda t: _frames(t)[1].select("frame", "det_idx", "left", "top", *MEASURES), """
        SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY det_idx) - 1 AS det_idx, x - width / 2 AS "left", y - height / 2 AS top, x, y, area, amplitude, width, height, strength
        FROM detections WHERE video = 0"""),
    "a04_recorded_tracks": (_tracks, "SELECT video * 10000000 + track AS track, frame, x, y, area, amplitude, width, height, strength FROM scene_points"),
    "a05_written_table": (_table, "SELECT o_orderkey AS id, '0:00:01' AS start, o_totalprice AS start_s, o_custkey AS hits, CAST(o_custkey AS DOUBLE) / 4 AS path_px FROM orders"),
    "a14_written_verdicts": (_verdicts, """
        SELECT 'été ' || video AS video, row_id, round(round(start_s, 2), 1) AS start_s, nullif(trim(verdict), '') AS verdict, CASE WHEN row_id % 3 = 0 THEN 'a "b"; c' END AS species,
               round(start_y, 1) AS start_y FROM verdicts"""),
    "a18_published_table": (_published, "SELECT * FROM nation"),
    "a20_clips_by_range": (_clips, f"""
        SELECT 'part' AS clip, frame, luma FROM ({LUMA}) p WHERE frame BETWEEN 150 AND 299 UNION ALL SELECT 'whole', frame, luma FROM ({LUMA}) q WHERE frame <= 120"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
