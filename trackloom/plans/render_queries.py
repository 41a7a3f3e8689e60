"""Queries of rendering, tracking and the bench's geometry, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import keys
from trackloom.operators import generation, intervals, ledger, planes, rendering, tracking, tracks
from trackloom.plans.adapters import oracle
from trackloom.plans.time_queries import DAMAGE, _damaged, union_sql

GREY = [max(0, min(255, (y * 4769 - 81520) >> 12)) for y in range(256)]


def _boxes(t):
    return t("track_points").select("track", (F.col("x") - F.col("width") / 2).alias("left"), (F.col("y") - F.col("height") / 2).alias("top"), "width", "height")


def _tracks(t):
    return tracking.tracked(t("detections"))


def _luma(t):
    # 256 rows
    table = t.spark.createDataFrame(list(enumerate(planes.nearest_luma(GREY))), "value int, luma int")
    return t("planes").join(F.broadcast(table), "value").select("frame", "pixel", "luma")


def _zones(t):
    rows = t("detections").select(
        F.expr("frame div 20").alias("page"), F.col("det_idx").alias("id"), F.floor("x").cast("long").alias("left"), F.floor("y").cast("long").alias("top"))
    return rendering.zones(rows.select("*", (F.col("left") + 60).alias("right"), (F.col("top") + 40).alias("bottom")), 1440, 1080)


def _works(t):
    kinds = F.when(F.col("job") % 3 == 0, "zoom").when(F.col("job") % 3 == 1, "clips").otherwise("annotated")
    return rendering.work_order(t("jobs").select("device", F.col("job").alias("id"), F.expr("bytes div 1000000").alias("start"), kinds.alias("kind")), ["device"])


def _flights(t):
    n = (F.col("track") % 20 + 5).cast("int")
    rows = t("scene_points").select("track").distinct().select("track", F.posexplode(rendering.saccades(n, F.col("track") % 3)).alias("k", "at"))
    x = rendering.bezier(F.lit(0.0), F.col("track") % 700 + 0.0, F.lit(1440.0), F.col("at"))
    return rows.select("track", F.col("k").cast("long").alias("k"), F.round("at", 6).alias("progress"), F.round(x, 4).alias("x"))


def _joined(t):
    other = t("frames").filter("frame % 97 = 3").select("video", F.col("frame").alias("first"), (F.col("frame") + 5).alias("last"))
    return intervals.merged(_damaged(t).select("video", "first", "last").union(other), ["video"])


QUERIES = {
    "b03_units": (lambda t: t("planes").select("frame", "pixel", (F.col("value") * planes.UNITS).alias("units")), "SELECT frame, pixel, value * 64 AS units FROM planes"),
    "b18_video_names": (lambda t: t("pages").select("page_id", F.concat(F.when(F.col("page_id") % 4 == 0, ".").otherwise(""), "url", F.when(F.col("page_id") % 3 == 0, ".Mp4").otherwise(".txt")).alias("name")).filter(
        F.col("name").rlike(ledger.VIDEO_NAMES) & ~F.col("name").startswith(".")), """
        SELECT * FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '.' ELSE '' END || url || CASE WHEN page_id % 3 = 0 THEN '.Mp4' ELSE '.txt' END AS name FROM pages) p
        WHERE regexp_matches(name, '(?i)\\.(mp4|mov|avi|mkv|m4v)$') AND name NOT LIKE '.%'"""),
    "p12_nearest_luma": (_luma, f"""
        WITH l AS (SELECT i AS luma, greatest(0, least(255, (i * 4769 - 81520) >> 12)) AS g FROM range(0, 256) r(i)),
        best AS (SELECT a.i AS aimed, min(l.luma) AS luma FROM range(0, 256) a(i) JOIN l ON abs(l.g - a.i) = (SELECT min(abs(m.g - a.i)) FROM l m) GROUP BY a.i),
        tie AS (SELECT b.*, b.luma < 255 AND abs(x.g - aimed) = 1 AND abs(y.g - aimed) = 1 AS tied FROM best b JOIN l x ON x.luma = b.luma LEFT JOIN l y ON y.luma = b.luma + 1),
        n AS (SELECT *, sum(CASE WHEN tied THEN 1 ELSE 0 END) OVER (ORDER BY aimed) - 1 AS k FROM tie)
        SELECT frame, pixel, CAST(n.luma + CASE WHEN tied AND k % 2 = 1 THEN 1 ELSE 0 END AS INT) AS luma FROM planes p JOIN n ON n.aimed = p.value"""),
    "p14_crops": (lambda t: rendering.crops(_boxes(t), 1440, 1080, 12, 6), """
        SELECT track, CAST(least(greatest(round((x0 + x1) / 2 - n * 4 / 2), 0), 1440 - n * 4) AS BIGINT) AS "left", CAST(least(greatest(round((y0 + y1) / 2 - n * 3 / 2), 0), 1080 - n * 3) AS BIGINT) AS top,
               CAST(n * 4 AS BIGINT) AS width, CAST(n * 3 AS BIGINT) AS height FROM (
          SELECT *, least(greatest(ceil((x1 - x0) / 4), ceil((y1 - y0) / 3), 60), 360) AS n FROM (
            SELECT track, min(x - width / 2) - 12 AS x0, min(y - height / 2) - 12 AS y0, max(x - width / 2 + width) + 12 AS x1, max(y - height / 2 + height) + 12 AS y1 FROM track_points GROUP BY track) a) b"""),
    "g24_render_estimate": (lambda t: t("jobs").select("job", rendering.render_estimate(F.col("bytes").cast("double"), F.when(F.col("job") % 8 != 0, F.col("job") % 300 + 60.0), F.lit(10.0), F.lit(5.0), F.col("job") % 2 == 0).alias("estimate")), """
        SELECT job, CAST(floor(CASE WHEN job % 8 = 0 THEN w ELSE b / (job % 300 + 60.0::DOUBLE) * (10 * 3.2::DOUBLE + 5 * 2.7::DOUBLE) + w END) AS BIGINT) AS estimate
        FROM (SELECT job, CAST(bytes AS DOUBLE) AS b, CASE WHEN job % 2 = 0 THEN CAST(bytes AS DOUBLE) * 2.8::DOUBLE ELSE 0 END AS w FROM jobs) j"""),
    "g28_merged_zones": (_zones, None),
    "g31_listed_spans": (lambda t: rendering.listed_spans(intervals.merged(t("spans"), ["video"]), ["video"]), f"""
        SELECT video, array_to_string(list_slice(list(first || '-' || last ORDER BY first), 1, 3), ', ') AS shown, greatest(count(*) - 3, 0) AS more, CAST(sum(last - first) AS BIGINT) AS total
        FROM ({union_sql('SELECT * FROM spans')}) s GROUP BY video"""),
    "j26_joined_damage": (_joined, union_sql(f"SELECT video, first, last FROM ({DAMAGE}) d UNION ALL SELECT video, frame, frame + 5 FROM frames WHERE frame % 97 = 3")),
    "k01_total_order": (lambda t: tracks.numbered(t("scene_points"), ["video"]), """
        SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY f, x, track) AS id FROM (
          SELECT video, track, min(frame) AS f, arg_min(x, frame) AS x FROM scene_points GROUP BY video, track) a"""),
    "k06_track_limit": (lambda t: rendering.limited(tracks.numbered(t("track_points"), ["video"]), ["video"], 499), """
        SELECT video, count(DISTINCT track) AS tracks, CASE WHEN count(DISTINCT track) > 499 THEN 'too_many_tracks' ELSE 'done' END AS state FROM track_points GROUP BY video"""),
    "k08_next_to_see": (lambda t: rendering.after(t("verdicts").select("video", F.col("row_id").alias("idx"), "verdict"), ["video"], F.lit(5000), F.col("verdict") == ""), """
        SELECT video, coalesce(min(row_id) FILTER (WHERE row_id > 5000), min(row_id)) AS next FROM verdicts WHERE verdict = '' GROUP BY video"""),
    "k09_work_order": (_works, """
        SELECT *, row_number() OVER (PARTITION BY device ORDER BY start, CASE kind WHEN 'annotated' THEN 0 WHEN 'clips' THEN 1 ELSE 2 END, id) AS place FROM (
          SELECT device, job AS id, bytes // 1000000 AS start, CASE job % 3 WHEN 0 THEN 'zoom' WHEN 1 THEN 'clips' ELSE 'annotated' END AS kind FROM jobs) j"""),
    "k10_markers": (lambda t: rendering.markers(t("scene_points").select(
        (F.col("video") * 100000 + F.expr("frame div 60")).alias("page"), F.col("track").alias("path"), "frame", "x", "y"), 1440.0, 1080.0, 12.0, 20.0), None),
    "k11_path_colours": (lambda t: rendering.colours(t("scene_points").select(F.col("video").alias("page"), F.col("track").alias("path"), "frame", "x", "y"), 8, 20.0), None),
    "w25_saccade_flights": (_flights, """
        SELECT track, k, round(p, 6) AS progress, round(2 * (1 - p) * p * (track % 700) + p * p * 1440, 4) AS x FROM (
          SELECT track, k, CAST(sum(CASE WHEN k = 0 THEN 0 WHEN (k + track % 3) % 3 = 0 THEN 2 ELSE 1 END) OVER w AS DOUBLE)
                 / sum(CASE WHEN k = 0 THEN 0 WHEN (k + track % 3) % 3 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY track) AS p
          FROM (SELECT track, unnest(range(0, track % 20 + 5)) AS k FROM (SELECT DISTINCT track FROM scene_points) s) a WINDOW w AS (PARTITION BY track ORDER BY k ROWS UNBOUNDED PRECEDING)) b"""),
    "d04_targets": (lambda t: generation.targets(t("scene_points"), [("pass", 20.0, 1.5), ("hunt", 20.0, 1.5), ("circle", 10.0, 3.0)], 5, 1), None),
    "f10_name_keys": (lambda t: t("customer").select("c_custkey", keys.name_key("c_name").alias("key")), "SELECT c_custkey, lower(nfc_normalize(c_name)) AS key FROM customer"),
    "s01_tracks": (_tracks, None),
    "s01_kept_tracks": (lambda t: tracks.kept(_tracks(t), most_turn=3.2), None),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items() if sql}
