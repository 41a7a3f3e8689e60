"""Queries of matching and comparison, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import intervals, matching
from trackloom.plans.adapters import oracle


def greedy_sql(candidates: str, keys: str, order: str, left: str, right: str) -> str:
    """WITH RECURSIVE text of the greedy fold: table taken with all columns of the candidates."""
    same = " AND ".join(f"c.{k} = f.{k}" for k in keys.split(", "))
    free = f"NOT list_contains(f.ls, c.{left}) AND NOT list_contains(f.rs, c.{right})"
    return f"""WITH RECURSIVE cand AS ({candidates}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM cand),
      fold AS (
        SELECT *, [{left}] AS ls, [{right}] AS rs, true AS took FROM ranked WHERE rn = 1
        UNION ALL
        SELECT c.*, CASE WHEN {free} THEN list_append(f.ls, c.{left}) ELSE f.ls END, CASE WHEN {free} THEN list_append(f.rs, c.{right}) ELSE f.rs END, {free}
        FROM fold f JOIN ranked c ON {same} AND c.rn = f.rn + 1),
      taken AS (SELECT * FROM fold WHERE took)"""


DETECTIONS = greedy_sql("""
  SELECT a.video, a.frame, a.det_idx AS a_id, b.det_idx AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM detections a JOIN candidates b ON a.video = b.video AND a.frame = b.frame AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 3""",
                        "video, frame", "d, a_id, b_id", "a_id", "b_id")
A_TRACKS = "SELECT video, track, min(frame) AS start, count(*) AS points FROM scene_points GROUP BY video, track"
B_TRACKS = """SELECT video, track + 7 AS track, min(frame) + track % 9 AS start, count(*) FILTER (WHERE frame % 11 <> 0) AS points
              FROM scene_points WHERE track % 13 <> 0 GROUP BY video, track"""
TRACKS = greedy_sql(f"""
  SELECT a.video, a.track AS a_id, b.track AS b_id, abs(a.start - b.start) AS start_gap, abs(a.points - b.points) AS points_gap
  FROM ({A_TRACKS}) a JOIN ({B_TRACKS}) b ON a.video = b.video AND abs(a.start - b.start) <= 5""", "video", "start_gap, points_gap, a_id, b_id", "a_id", "b_id")
TARGETS = "SELECT video, obj AS target, frame, min(x) + 4 AS x, min(y) + 3 AS y FROM detections WHERE obj % 4 <> 3 GROUP BY video, obj, frame"
NEAR = f"""
  SELECT p.video, p.track, t.target, count(*) AS near, min(p.frame) AS met FROM scene_points p JOIN ({TARGETS}) t
    ON p.video = t.video AND p.frame = t.frame AND sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) <= 24 GROUP BY p.video, p.track, t.target"""
ASSIGNED = f"""
  SELECT video, track, target, near, points FROM (
    SELECT n.*, c.points, row_number() OVER (PARTITION BY n.video, n.track ORDER BY near DESC, met, target) AS rn
    FROM ({NEAR}) n JOIN (SELECT video, track, count(*) AS points FROM scene_points GROUP BY video, track) c ON n.video = c.video AND n.track = c.track) r
  WHERE rn = 1 AND near >= 0.5 * points"""
TWINS = """
  SELECT a.video, a.track AS a_id, b.track AS b_id, count(*) AS shared FROM scene_points a JOIN scene_points b
    ON a.video = b.video AND a.frame = b.frame AND a.track < b.track
  GROUP BY a.video, a.track, b.track HAVING max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) <= 700"""
STARTS = """SELECT video, track, CAST(min(frame) AS DOUBLE) / 30 AS start_s, CASE WHEN track % 17 <> 0 THEN arg_min(x, frame) END AS x, arg_min(y, frame) AS y
            FROM scene_points GROUP BY video, track"""
VERDICT = greedy_sql(f"""
  SELECT v.video, row_id, track, round(abs(v.start_s - t.start_s), 9) AS gap,
         coalesce(round(sqrt((start_x - x) * (start_x - x) + (start_y - y) * (start_y - y)), 9), CAST('inf' AS DOUBLE)) AS d
  FROM verdicts v JOIN ({STARTS}) t ON v.video = t.video AND round(abs(v.start_s - t.start_s), 9) <= 0.2 + 1e-6""", "video", "d, gap, row_id, track", "row_id", "track")
ALONE = """
  SELECT video, frame, 'lost' AS kind, det_idx, x, y, amplitude FROM detections d WHERE NOT EXISTS (
    SELECT 1 FROM taken m WHERE m.video = d.video AND m.frame = d.frame AND m.a_id = d.det_idx)
  UNION ALL SELECT video, frame, 'added', det_idx, x, y, amplitude FROM candidates d WHERE NOT EXISTS (
    SELECT 1 FROM taken m WHERE m.video = d.video AND m.frame = d.frame AND m.b_id = d.det_idx)"""
_PARTS = {"head": "rs <= 5", "tail": "re <= 5", "whole": "true"}
ENDS = f"""
  SELECT *, hits < 6 AS piece, {', '.join(f"sqrt({p}_vx * {p}_vx + {p}_vy * {p}_vy) AS {p}_speed" for p in _PARTS)} FROM (
    SELECT video, track, hits, whole_f0 AS first, whole_f1 AS last, whole_x0 AS first_x, whole_y0 AS first_y, whole_x1 AS last_x, whole_y1 AS last_y,
           {', '.join(f"CASE WHEN {p}_f1 > {p}_f0 THEN ({p}_{c}1 - {p}_{c}0) / ({p}_f1 - {p}_f0) ELSE 0 END AS {p}_v{c}" for p in _PARTS for c in "xy")} FROM (
      SELECT video, track, count(*) AS hits, {', '.join(
          f"arg_{m}({c}, frame) FILTER (WHERE {w}) AS {p}_{'f' if c == 'frame' else c}{k}" for p, w in _PARTS.items() for c in ("frame", "x", "y") for m, k in (("min", 0), ("max", 1)))}
      FROM (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY frame) AS rs, row_number() OVER (PARTITION BY video, track ORDER BY frame DESC) AS re
            FROM broken_points) a GROUP BY video, track) b WHERE hits >= 2) c"""
_GAP, _SQUARE = "(b.first - a.last)", "({0}) * ({0})"
_MISS = " + ".join(_SQUARE.format(f"a.last_{c} + (a.tail_v{c} + b.head_v{c}) / 2 * {_GAP} - b.first_{c}") for c in "xy")
_ACROSS = f"sqrt({' + '.join(_SQUARE.format(f'b.first_{c} - a.last_{c}') for c in 'xy')}) / {_GAP}"
_INNER = "least({0}_x, 1440 - {0}_x, {0}_y, 1080 - {0}_y) >= 30"
REJOIN = f"""
  SELECT * FROM (
    SELECT a.video, a.track AS a_id, b.track AS b_id, a.piece OR b.piece AS through_piece, b.first - a.last - 1 AS hidden, round(sqrt({_MISS}), 4) AS miss
    FROM ({ENDS}) a JOIN ({ENDS}) b ON a.video = b.video AND b.first - a.last - 1 > 6 AND b.first - a.last - 1 <= 19 AND NOT (a.piece AND b.piece)
    WHERE {_INNER.format('a.last')} AND {_INNER.format('b.first')}
      AND NOT EXISTS (SELECT 1 FROM ignored s WHERE s.video = a.video AND s.first < b.first AND a.last < s.last)
      AND (a.piece OR ({_ACROSS} >= 0.25 * a.tail_speed AND (NOT b.piece OR b.hits < 2 OR b.whole_speed >= 0.45 * a.tail_speed)))
      AND (b.piece OR ({_ACROSS} >= 0.25 * b.head_speed AND (NOT a.piece OR a.hits < 2 OR a.whole_speed >= 0.45 * b.head_speed)))) r
  WHERE miss <= 60"""
REJOINED = greedy_sql(REJOIN, "video", "through_piece, miss, a_id, b_id", "a_id", "b_id")


def _matches(t):
    return matching.matched_detections(t("detections"), t("candidates"))


def _differences(t):
    m = _matches(t)
    row = lambda df, kind: df.select("video", "frame", F.lit(kind).alias("kind"), "det_idx", "x", "y", "amplitude")
    return row(matching.residue(t("detections"), m, "a_id"), "lost").unionByName(row(matching.residue(t("candidates"), m, "b_id"), "added"))


def _runs(t):
    points = t("scene_points")
    a = points.groupBy("video", "track").agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("points"))
    b = points.filter("track % 13 <> 0").groupBy("video", "track").agg(
        F.min("frame").alias("start"), F.count_if(F.col("frame") % 11 != 0).alias("points")).select(
        "video", (F.col("track") + 7).alias("track"), (F.col("start") + F.col("track") % 9).alias("start"), "points")
    return a, b


def _track_matches(t):
    return matching.matched_tracks(*_runs(t), ["video"])


def _targets(t):
    return t("detections").filter("obj % 4 <> 3").groupBy("video", F.col("obj").alias("target"), "frame").agg(
        (F.min("x") + 4).alias("x"), (F.min("y") + 3).alias("y"))


def _starts(t):
    return t("scene_points").groupBy("video", "track").agg(F.min(F.struct("frame", "x", "y")).alias("one")).select(
        "video", "track", (F.col("one.frame") / 30).alias("start_s"), F.when(F.col("track") % 17 != 0, F.col("one.x")).alias("x"), F.col("one.y").alias("y"))


def _twins(t):
    return matching.twins(t("scene_points"), 700.0)


def _agreement(t):
    m = _matches(t)
    count = lambda df, name: df.groupBy("video").agg(F.count(F.lit(1)).alias(name))
    rows = count(t("detections"), "reference").join(count(t("candidates"), "current"), "video").join(count(m, "paired"), "video")
    return rows.select("*", (F.col("reference") - F.col("paired")).alias("lost"), (F.col("current") - F.col("paired")).alias("added"),
                       F.round(F.when(F.col("reference") > 0, F.col("paired") / F.col("reference")).otherwise(1.0), 6).alias("rate"))


def _rejoin(t):
    return matching.rejoinable(t("broken_points"), t("ignored"))


def _chains(t):
    rows = matching.chains(t("broken_points"), matching.rejoined(_rejoin(t)))
    return rows.groupBy("video", "head").agg(F.countDistinct("track").alias("parts"), F.count(F.lit(1)).alias("hits"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def _frame_lists(df):
    return df.groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("x", "y", "area"))).alias("rows"))


def _differing(t):
    a, b = _frame_lists(t("detections")), _frame_lists(t("candidates").withColumnRenamed("rows", "r"))
    both = a.join(b.withColumnRenamed("rows", "others"), ["video", "frame"], "full_outer")
    return both.filter(~F.col("rows").eqNullSafe(F.col("others"))).select("video", "frame")


def _first_gap(t):
    a = t("frames")
    b = a.select("video", "frame", F.when(F.col("frame") % 401 == 400, F.col("pts") + 1).otherwise(F.col("pts")).alias("pts2"),
                 (F.col("key_frame") | (F.col("frame") % 500 == 499)).alias("key2"), F.col("decode_error").alias("error2"))
    both = a.join(b, ["video", "frame"], "full_outer")
    gap = lambda c: F.min(F.when(c, F.col("frame")))
    return both.groupBy("video").agg(gap(~F.col("pts").eqNullSafe(F.col("pts2"))).alias("pts_gap"), gap(~F.col("key_frame").eqNullSafe(F.col("key2"))).alias("key_gap"),
                                     gap(~F.col("decode_error").eqNullSafe(F.col("error2"))).alias("error_gap"))


def _same(t):
    rows = _differing(t)
    hidden = intervals.inside(rows, t("spans").filter("span_id % 3 = 0"), ["video"]).withColumn("inside", F.lit(True))
    flagged = rows.join(hidden, ["video", "frame"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    out = F.slice(F.array_sort(F.collect_list(F.when(~F.col("inside"), F.col("frame")))), 1, 10)
    return flagged.groupBy("video").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"), out.alias("firsts")).select(
        "video", "inside", "outside", F.array_join("firsts", ",").alias("firsts"), F.greatest(F.col("outside") - 10, F.lit(0)).alias("more"))


def _crowding(t):
    a = t("candidates").select("video", "frame", F.col("det_idx").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = t("scene_points").select("video", "frame", F.col("track").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return matching.crowded(a, b, ["video", "frame"], 40.0)


def _near_flag(t):
    a = t("detections").select("video", "frame", F.col("det_idx").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = t("scene_points").select("video", "frame", F.col("track").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    on = matching.near_pairs(a, b, ["video", "frame"], 1e-6).select("a_id").distinct().withColumn("on_track", F.lit(True))
    return a.join(on, "a_id", "left").select("a_id", F.coalesce("on_track", F.lit(False)).alias("on_track"))


def _markers(t):
    return t("detections").select(F.expr("frame div 100").alias("page"), F.col("det_idx").alias("id"), F.col("obj").alias("owner"), "x", "y")


def _attach(t):
    rows, made = t("verdicts"), _starts(t)
    done = matching.attached(rows, made)
    known = made.select("video").distinct().withColumn("here", F.lit(True))
    return rows.join(done.select("video", "row_id", "track"), ["video", "row_id"], "left").join(known, "video", "left").select(
        "video", "row_id", "track", F.when(F.col("track").isNotNull(), "attached").when(F.col("here"), "lost").otherwise("elsewhere").alias("state"))


QUERIES = {
    "j01_detection_matching": (_matches, DETECTIONS + " SELECT video, frame, a_id, b_id, d FROM taken"),
    "j01_detection_residue": (lambda t: _differences(t).select("video", "frame", "kind", "det_idx"), DETECTIONS + f" SELECT video, frame, kind, det_idx FROM ({ALONE}) r"),
    "j02_track_matching": (_track_matches, TRACKS + " SELECT video, a_id, b_id, start_gap, points_gap FROM taken"),
    "j03_track_discrepancies": (lambda t: matching.discrepancies(*_runs(t), _track_matches(t), ["video"]), TRACKS + f"""
        SELECT video, 'missed' AS kind, track, start AS frame FROM ({A_TRACKS}) a WHERE NOT EXISTS (SELECT 1 FROM taken m WHERE m.video = a.video AND m.a_id = a.track)
        UNION ALL SELECT video, 'extra', track, start FROM ({B_TRACKS}) b WHERE NOT EXISTS (SELECT 1 FROM taken m WHERE m.video = b.video AND m.b_id = b.track)
        UNION ALL SELECT a.video, 'points', track, start FROM ({A_TRACKS}) a JOIN taken m ON m.video = a.video AND m.a_id = a.track WHERE points_gap > 3"""),
    "j08_bracketed_weak": (lambda t: matching.bracketed(t("detections"), off=40.0, step=200.0, close=2.0).select("video", "frame", "det_idx", "strength"), """
        SELECT video, frame, det_idx, strength FROM detections w WHERE strength = 'strong' OR (
          EXISTS (SELECT 1 FROM detections a JOIN detections b ON a.video = b.video WHERE a.video = w.video AND a.strength = 'strong' AND b.strength = 'strong'
            AND a.frame BETWEEN w.frame - 3 AND w.frame - 1 AND b.frame BETWEEN w.frame + 1 AND w.frame + 3
            AND sqrt((w.x - a.x) * (w.x - a.x) + (w.y - a.y) * (w.y - a.y)) <= 200 * (w.frame - a.frame)
            AND sqrt((w.x - b.x) * (w.x - b.x) + (w.y - b.y) * (w.y - b.y)) <= 200 * (b.frame - w.frame)
            AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) >= 20
            AND sqrt((w.x - (a.x + (b.x - a.x) * ((w.frame - a.frame) / (b.frame - a.frame)))) * (w.x - (a.x + (b.x - a.x) * ((w.frame - a.frame) / (b.frame - a.frame))))
                   + (w.y - (a.y + (b.y - a.y) * ((w.frame - a.frame) / (b.frame - a.frame)))) * (w.y - (a.y + (b.y - a.y) * ((w.frame - a.frame) / (b.frame - a.frame))))) <= 40)
          AND NOT EXISTS (SELECT 1 FROM detections c WHERE c.video = w.video AND c.frame = w.frame AND c.strength = 'strong'
            AND sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)) <= 2))"""),
    "j09_twin_pairs": (_twins, TWINS),
    "g07_twin_groups": (lambda t: matching.groups(_twins(t)), f"""
        WITH RECURSIVE e AS (SELECT a_id AS n, b_id AS m FROM ({TWINS}) p UNION SELECT b_id, a_id FROM ({TWINS}) q),
        r AS (SELECT n, n AS root FROM e UNION SELECT e.m, r.root FROM r JOIN e ON e.n = r.n)
        SELECT n AS node, min(root) AS root FROM r GROUP BY n"""),
    "j10_rejoin_candidates": (_rejoin, REJOIN),
    "j11_rejoin_greedy": (lambda t: matching.rejoined(_rejoin(t)), REJOINED + " SELECT video, through_piece, miss, a_id, b_id FROM taken"),
    "j11_rejoined_chains": (_chains, REJOINED + """, 
        down AS (SELECT video, a_id AS head, a_id AS track FROM taken t WHERE NOT EXISTS (SELECT 1 FROM taken u WHERE u.video = t.video AND u.b_id = t.a_id)
                 UNION ALL SELECT d.video, d.head, t.b_id FROM down d JOIN taken t ON t.video = d.video AND t.a_id = d.track),
        own AS (SELECT video, track, count(*) AS hits, min(frame) AS first, max(frame) AS last FROM broken_points GROUP BY video, track)
        SELECT o.video, coalesce(d.head, o.track) AS head, count(*) AS parts, CAST(sum(hits) AS BIGINT) AS hits, min(first) AS first, max(last) AS last
        FROM own o LEFT JOIN down d ON d.video = o.video AND d.track = o.track GROUP BY 1, 2 HAVING max(hits) >= 6"""),
    "j15_truth_assignment": (lambda t: matching.assigned_targets(t("scene_points"), _targets(t)), ASSIGNED),
    "j16_reference_share": (lambda t: matching.matching_share(t("scene_points"), t("candidates")), """
        SELECT p.video, p.track, count(*) FILTER (WHERE hit) AS near, count(*) AS points, count(*) FILTER (WHERE hit) >= 0.5 * count(*) AS matches FROM (
          SELECT s.video, s.track, EXISTS (SELECT 1 FROM candidates c WHERE c.video = s.video AND c.frame = s.frame
            AND sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= 24) AS hit FROM scene_points s) p GROUP BY p.video, p.track"""),
    "j17_verdict_attach": (_attach, VERDICT + f"""
        SELECT v.video, v.row_id, m.track, CASE WHEN m.track IS NOT NULL THEN 'attached' WHEN h.video IS NOT NULL THEN 'lost' ELSE 'elsewhere' END AS state
        FROM verdicts v LEFT JOIN taken m ON m.video = v.video AND m.row_id = v.row_id LEFT JOIN (SELECT DISTINCT video FROM ({STARTS}) s) h ON h.video = v.video"""),
    "j18_orphan_nearest": (lambda t: matching.nearest_in_time(t("verdicts"), _starts(t), 1.0), f"""
        SELECT video, row_id, track, gap FROM (
          SELECT v.video, v.row_id, s.track, round(abs(v.start_s - s.start_s), 6) AS gap, row_number() OVER (
            PARTITION BY v.video, v.row_id ORDER BY round(abs(v.start_s - s.start_s), 6), s.track) AS rn
          FROM verdicts v JOIN ({STARTS}) s ON v.video = s.video AND round(abs(v.start_s - s.start_s), 6) <= 1) r WHERE rn = 1"""),
    "j19_on_track": (_near_flag, """
        SELECT det_idx AS a_id, EXISTS (SELECT 1 FROM scene_points s WHERE s.video = d.video AND s.frame = d.frame
          AND sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) <= 1e-6) AS on_track FROM detections d"""),
    "j20_differing_frames": (_differing, """
        WITH a AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM detections GROUP BY video, frame),
             b AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM candidates GROUP BY video, frame)
        SELECT coalesce(a.video, b.video) AS video, coalesce(a.frame, b.frame) AS frame FROM a FULL JOIN b ON a.video = b.video AND a.frame = b.frame
        WHERE a.l IS DISTINCT FROM b.l"""),
    "j21_first_gaps": (_first_gap, """
        SELECT video, min(CASE WHEN frame % 401 = 400 AND pts IS NOT NULL THEN frame END) AS pts_gap,
               min(CASE WHEN frame % 500 = 499 AND NOT key_frame THEN frame END) AS key_gap, CAST(NULL AS BIGINT) AS error_gap FROM frames GROUP BY video"""),
    "j22_crowding": (_crowding, """
        SELECT DISTINCT c.det_idx AS a_id FROM candidates c JOIN scene_points s ON s.video = c.video AND s.frame = c.frame
        WHERE sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) < 40"""),
    "j24_grid_neighbours": (lambda t: matching.neighbours(_markers(t), ["page"], 20.0), """
        WITH m AS (SELECT frame // 100 AS page, det_idx AS id, obj AS owner, x, y FROM detections)
        SELECT a.page, a.id, count(b.id) AS crossings FROM m a LEFT JOIN m b ON a.page = b.page AND a.owner <> b.owner
          AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 40 GROUP BY a.page, a.id"""),
    "g11_agreement": (_agreement, DETECTIONS + """
        SELECT video, reference, current, paired, reference - paired AS lost, current - paired AS added, round(paired / reference, 6) AS rate FROM
          (SELECT video, count(*) AS reference FROM detections GROUP BY video) a JOIN (SELECT video, count(*) AS current FROM candidates GROUP BY video) b USING (video)
          JOIN (SELECT video, count(*) AS paired FROM taken GROUP BY video) c USING (video)"""),
    "g12_difference_groups": (lambda t: matching.difference_groups(_differences(t), ["video"], 3), DETECTIONS + f"""
        SELECT video, min(frame) AS first, max(frame) AS last, count(*) FILTER (WHERE kind = 'lost') AS lost, count(*) FILTER (WHERE kind = 'added') AS added,
               round(avg(x), 6) AS x, round(avg(y), 6) AS y, max(amplitude) AS peak FROM (
          SELECT *, sum(CASE WHEN before IS NULL OR frame > before + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame RANGE UNBOUNDED PRECEDING) AS g FROM (
            SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS before FROM ({ALONE}) r) a) b GROUP BY video, g"""),
    "g13_track_agreement": (lambda t: _track_matches(t).groupBy("video").agg(
        F.count(F.lit(1)).alias("paired"), F.count_if(F.col("points_gap") <= 3).alias("agreeing")), TRACKS + """
        SELECT video, count(*) AS paired, count(*) FILTER (WHERE points_gap <= 3) AS agreeing FROM taken GROUP BY video"""),
    "g14_error_counts": (lambda t: t("frames").groupBy("video").agg(F.count_if("decode_error").alias("errors"), F.count_if(
        F.col("decode_error") != (F.col("frame") % 422 == 17)).alias("differing")), """
        SELECT video, count(*) FILTER (WHERE decode_error) AS errors, count(*) FILTER (WHERE decode_error <> (frame % 422 = 17)) AS differing FROM frames GROUP BY video"""),
    "g15_sameness": (_same, """
        WITH a AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM detections GROUP BY video, frame),
             b AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM candidates GROUP BY video, frame),
             d AS (SELECT coalesce(a.video, b.video) AS video, coalesce(a.frame, b.frame) AS frame FROM a FULL JOIN b ON a.video = b.video AND a.frame = b.frame WHERE a.l IS DISTINCT FROM b.l),
             f AS (SELECT *, EXISTS (SELECT 1 FROM spans s WHERE s.span_id % 3 = 0 AND s.video = d.video AND d.frame BETWEEN s.first AND s.last) AS inside FROM d)
        SELECT video, count(*) FILTER (WHERE inside) AS inside, count(*) FILTER (WHERE NOT inside) AS outside,
               array_to_string(list_slice(list_sort(list(frame) FILTER (WHERE NOT inside)), 1, 10), ',') AS firsts,
               greatest(count(*) FILTER (WHERE NOT inside) - 10, 0) AS more FROM f GROUP BY video"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
