"""Queries over tracks, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.operators import intervals, tracks
from trackloom.plans.adapters import oracle

RATE = 30.0
STEPPED = """SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame - lag(frame) OVER w AS df
             FROM track_points WINDOW w AS (PARTITION BY track ORDER BY frame)"""
PATHS = f"SELECT track, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 6) AS path FROM ({STEPPED}) s GROUP BY track"
CHORDS = """SELECT track, round(sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)), 6) AS chord FROM (
              SELECT track, arg_min(x, frame) AS ax, arg_min(y, frame) AS ay, arg_max(x, frame) AS bx, arg_max(y, frame) AS b_y
              FROM track_points GROUP BY track) e"""
TURNS = f"""
  SELECT p.track, round(coalesce(turn, 0), 6) AS turn FROM (SELECT DISTINCT track FROM track_points) p LEFT JOIN (
    SELECT track, quantile_cont(abs((((d + {math.pi!r}) % {2 * math.pi!r}) + {2 * math.pi!r}) % {2 * math.pi!r} - {math.pi!r}), 0.5) AS turn FROM (
      SELECT track, h - lag(h) OVER (PARTITION BY track ORDER BY frame) AS d FROM (
        SELECT track, frame, atan2(dy, dx) AS h FROM ({STEPPED}) s WHERE dx <> 0 OR dy <> 0) a) b WHERE d IS NOT NULL GROUP BY track) m USING (track)"""
CLOCK = lambda s: f"""(CAST(floor({s} / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0')
                       || ':' || lpad(CAST(CAST(floor({s}) AS BIGINT) % 60 AS VARCHAR), 2, '0'))"""  # noqa: E731
ARC = f"""SELECT track, frame, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS length
          FROM ({STEPPED}) s"""
WINDOWS = """SELECT video, track, greatest(0, min(frame) - 45) AS first, least(max(frame) + 45, 900) AS last FROM scene_points GROUP BY video, track"""


def _points(t):
    return t("track_points")


def _clip_groups(t):
    clips = t("scene_points").groupBy("video", "track").agg(
        F.greatest(F.lit(0), F.min("frame") - 45).alias("first"), F.least(F.max("frame") + 45, F.lit(900)).alias("last"))
    return intervals.merged(clips, ["video"], -1)


def _union(source: str, pad: int) -> str:
    from trackloom.plans.time_queries import union_sql

    return union_sql(source, pad)


def _fill_sql(c: str) -> str:
    return f"round(CASE WHEN k = 0 THEN {c} ELSE {c} + (n_{c} - {c}) * k / steps END, 6) AS {c}"


def _edge(t):
    return t("detections").select("det_idx", (tracks.edge_distance(1440, 1080) < 30).alias("at_edge"))


VELOCITY = """
        SELECT track, frame, round((x - ox) / (frame - o), 6) AS vx, round((y - oy) / (frame - o), 6) AS vy FROM (
          SELECT a.track, a.frame, a.x, a.y, o, c.x AS ox, c.y AS oy FROM (
            SELECT a.*, coalesce((SELECT max(b.frame) FROM track_points b WHERE b.track = a.track AND b.frame <= a.frame - 3),
                                 lag(frame) OVER (PARTITION BY track ORDER BY frame)) AS o FROM track_points a) a
          JOIN track_points c ON c.track = a.track AND c.frame = a.o) d"""

QUERIES = {
    "w10_path_length": (lambda t: tracks.path_lengths(_points(t)), PATHS),
    "w11_chord": (lambda t: tracks.chords(_points(t)), CHORDS),
    "w12_median_turn": (lambda t: tracks.median_turns(_points(t)), TURNS),
    "w13_gap_fill": (lambda t: tracks.filled(_points(t)), f"""
        SELECT track, frame + k AS frame, {', '.join(map(_fill_sql, ('x', 'y', 'width', 'height')))},
               CASE WHEN k = 0 THEN amplitude ELSE 0 END AS amplitude, k > 0 AS interpolated FROM (
          SELECT *, unnest(range(0, steps)) AS k FROM (
            SELECT *, coalesce(lead(frame) OVER w - frame, 1) AS steps, lead(x) OVER w AS n_x, lead(y) OVER w AS n_y,
                   lead(width) OVER w AS n_width, lead(height) OVER w AS n_height FROM track_points WINDOW w AS (PARTITION BY track ORDER BY frame)) a) b"""),
    "w14_filled_frames": (lambda t: tracks.filled_counts(_points(t)),
                          "SELECT track, max(frame) - min(frame) + 1 - count(*) AS filled_frames FROM track_points GROUP BY track"),
    "w15_box_clamp": (lambda t: tracks.clamped(_points(t)), """
        SELECT track, frame, width, height, x - width / 2 AS "left", y - height / 2 AS top FROM (
          SELECT track, frame, x, y, least(width, 4 * quantile_cont(width, 0.5) OVER (PARTITION BY track)) AS width,
                 least(height, 4 * quantile_cont(height, 0.5) OVER (PARTITION BY track)) AS height FROM track_points) a"""),
    "w16_trails": (lambda t: tracks.trails(_points(t), 10), """
        SELECT track, frame, coalesce((SELECT string_agg(CAST(floor(b.x) AS BIGINT) || ',' || CAST(floor(b.y) AS BIGINT), ' ' ORDER BY b.frame)
          FROM track_points b WHERE b.track = a.track AND b.frame BETWEEN a.frame - 10 AND a.frame - 1), '') AS trail FROM track_points a"""),
    "w18_velocity": (lambda t: tracks.velocities(_points(t)), VELOCITY),
    "w19_tail_speed": (lambda t: tracks.tail_speeds(_points(t)), f"""
        SELECT track, frame, round(now, 6) AS now, round(tail, 6) AS tail, round(CASE WHEN now < 0.4 * tail THEN tail ELSE now END, 6) AS trusted FROM (
          SELECT a.track, a.frame, sqrt(vx * vx + vy * vy) AS now, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (a.frame - f0) AS tail FROM (
            SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(frame) OVER w AS f0
            FROM track_points WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) a
          JOIN ({VELOCITY}) v ON v.track = a.track AND v.frame = a.frame) b"""),
    "w20_end_velocities": (lambda t: tracks.end_velocities(_points(t)), "SELECT track, " + ", ".join(
        f"CASE WHEN {s}f1 > {s}f0 THEN round(({s}{c}1 - {s}{c}0) / ({s}f1 - {s}f0), 6) END AS {s}_v{c}" for s in ("head", "tail") for c in "xy") + """
        FROM (SELECT track, """ + ", ".join(
        f"arg_{m}({c}, frame) FILTER (WHERE {s} <= 5) AS {s}{'f' if c == 'frame' else c}{k}" for s in ("head", "tail") for c in ("x", "y", "frame")
        for m, k in (("min", 0), ("max", 1))) + """
        FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) AS head, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS tail
              FROM track_points) a GROUP BY track) b"""),
    "w21_track_numbers": (lambda t: tracks.numbered(_points(t), ["video"]), """
        SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY f, x, track) AS id FROM (
          SELECT video, track, min(frame) AS f, arg_min(x, frame) AS x FROM track_points GROUP BY video, track) a"""),
    "w22_track_parts": (lambda t: tracks.parts(tracks.numbered(_points(t), ["video"]), ["video"], ["id"]), """
        SELECT video, track, id, CAST(floor((id - 1) / ceil(n / ceil(n / 20.0::DOUBLE))) AS BIGINT) AS part FROM (
          SELECT *, CAST(count(*) OVER (PARTITION BY video) AS DOUBLE) AS n FROM (
            SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY f, x, track) AS id FROM (
              SELECT video, track, min(frame) AS f, arg_min(x, frame) AS x FROM track_points GROUP BY video, track) a) b) c"""),
    "w24_arc_length": (lambda t: tracks.arc_lengths(_points(t)), ARC),
    "w24_resampled_paths": (lambda t: tracks.resampled(_points(t), 25.0), f"""
        SELECT track, k, round(x + (n_x - x) * ((k * 25.0::DOUBLE - length) / (n_length - length)), 3) AS x,
               round(y + (n_y - y) * ((k * 25.0::DOUBLE - length) / (n_length - length)), 3) AS y FROM (
          SELECT *, unnest(range(CAST(ceil(length / 25) AS BIGINT), CAST(ceil(n_length / 25) AS BIGINT))) AS k FROM (
            SELECT a.*, p.x, p.y, lead(length) OVER w AS n_length, lead(p.x) OVER w AS n_x, lead(p.y) OVER w AS n_y
            FROM ({ARC}) a JOIN track_points p USING (track, frame) WINDOW w AS (PARTITION BY track ORDER BY frame)) b WHERE n_length > length) c"""),
    "g08_twin_combine": (lambda t: tracks.combined(t("twin_points"), ["track", "frame"]), """
        SELECT track, frame, round(sum(x * area) / sum(area), 6) AS x, round(sum(y * area) / sum(area), 6) AS y,
               min(x - width / 2) AS "left", min(y - height / 2) AS top, max(x + width / 2) - min(x - width / 2) AS width,
               max(y + height / 2) - min(y - height / 2) AS height, sum(area) AS area, max(amplitude) AS amplitude,
               CASE WHEN bool_or(strength = 'strong') THEN 'strong' ELSE 'weak' END AS strength FROM twin_points GROUP BY track, frame"""),
    "g09_track_table": (lambda t: tracks.measured(_points(t), RATE), f"""
        SELECT track, {CLOCK('(f0 / 30.0::DOUBLE)')} AS start, {CLOCK('(f1 / 30.0::DOUBLE)')} AS "end",
               round(greatest((f1 - f0) / 30.0::DOUBLE, {1 / RATE!r}), 6) AS duration_s, hits, chord, path,
               round(path / greatest((f1 - f0) / 30.0::DOUBLE, {1 / RATE!r}), 2) AS speed, max_area, peak_amplitude,
               f1 - f0 + 1 - hits AS filled_frames, round(f0 / 30.0::DOUBLE, 2) AS start_s FROM (
          SELECT track, min(frame) AS f0, max(frame) AS f1, count(*) AS hits, CAST(round(max(area)) AS BIGINT) AS max_area,
                 max(amplitude) AS peak_amplitude FROM track_points GROUP BY track) b JOIN ({CHORDS}) c USING (track) JOIN ({PATHS}) p USING (track)"""),
    "g10_part_peaks": (lambda t: _points(t).groupBy("track", F.expr("frame div 60").alias("part")).agg(
        F.max("area").alias("max_area"), F.max("amplitude").alias("peak_amplitude"), F.count(F.lit(1)).alias("points")), """
        SELECT track, frame // 60 AS part, max(area) AS max_area, max(amplitude) AS peak_amplitude, count(*) AS points FROM track_points GROUP BY track, frame // 60"""),
    "b09_edge_predicate": (_edge, "SELECT det_idx, least(x, 1440 - x, y, 1080 - y) < 30 AS at_edge FROM detections"),
    "b10_kept_tracks": (lambda t: tracks.kept(_points(t)), f"""
        SELECT track, hits, chord, turn, hits >= 6 AND chord >= 45 AND turn <= 0.8 AS kept FROM (
          SELECT track, count(*) AS hits FROM track_points GROUP BY track) h JOIN ({CHORDS}) c USING (track) JOIN ({TURNS}) t USING (track)"""),
    "b11_zoom_wanted": (lambda t: tracks.zoom_wanted(_points(t), F.expr("frame div 60")), """
        SELECT track, bool_or(area < 100 OR amplitude < 40) AS wanted FROM (
          SELECT track, frame // 60 AS part, max(area) AS area, max(amplitude) AS amplitude FROM track_points GROUP BY track, frame // 60) p GROUP BY track"""),
    "g26_periods": (lambda t: tracks.periods(
        t("scene_points").groupBy("video", "track").agg(F.min("frame").alias("f")).select("video", (F.col("f") * 2).alias("start"), F.lit(2500.0).alias("length")),
        ["video"], F.col("start"), F.col("length")), """
        WITH s AS (SELECT video, track, min(frame) * 2 AS start FROM scene_points GROUP BY video, track)
        SELECT v.video, p.period, count(s.track) AS tracks FROM (SELECT DISTINCT video FROM s) v CROSS JOIN range(0, 5) p(period)
        LEFT JOIN s ON s.video = v.video AND least(s.start // 600, 4) = p.period GROUP BY v.video, p.period"""),
    "g27_clip_groups": (_clip_groups, _union(WINDOWS, -1)),
    "s02_prediction_error": (lambda t: tracks.prediction_error(_points(t)), f"""
        SELECT track, frame, round(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), 6) AS miss, round(50 + travel, 6) AS reach FROM (
          SELECT track, frame, x, y, px + pdx / pdf * df AS ax, py + pdy / pdf * df AS ay, sqrt(pdx * pdx + pdy * pdy) / pdf * df AS travel FROM (
            SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, lag(df) OVER w AS pdf
            FROM ({STEPPED}) s WINDOW w AS (PARTITION BY track ORDER BY frame)) a WHERE pdf IS NOT NULL) b"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
