"""Rules in whole, where other queries show a part of them, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import keys, text
from trackloom.functions.lineage import cut
from trackloom.operators import evaluation, golden, intervals, ledger, matching, planes, rendering, timeline
from trackloom.plans.adapters import oracle
from trackloom.plans.ledger_queries import TARGET_RESULTS, _hits, _seen
from trackloom.plans.match_queries import ASSIGNED, _targets
from trackloom.plans.time_queries import HALF, JUMPS, STEP, union_sql

EDGES = union_sql(f"""
  SELECT b.video, greatest(0, b.frame - {HALF}) AS first,
         least(greatest(b.frame, coalesce((SELECT min(k.frame) - 1 FROM frames k WHERE k.video = b.video AND k.key_frame AND k.frame > b.frame), e.last)) + {HALF}, e.last) AS last
  FROM (SELECT video, frame FROM frames WHERE decode_error UNION SELECT video, frame FROM ({JUMPS}) j UNION SELECT video, 0 FROM announced WHERE before_first > 0
        UNION SELECT video, max(f.frame) + 1 FROM frames f JOIN announced a USING (video) WHERE after_last > 0 GROUP BY video) b
  JOIN (SELECT video, max(frame) AS last FROM frames GROUP BY video) e ON b.video = e.video""")
MATCHES = """
  SELECT p.video, p.track, count(*) FILTER (WHERE hit) >= 0.5 * count(*) AS matches FROM (
    SELECT s.video, s.track, EXISTS (SELECT 1 FROM candidates c WHERE c.video = s.video AND c.frame = s.frame AND c.det_idx % 5 = 0
      AND sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= 24) AS hit FROM scene_points s) p GROUP BY p.video, p.track"""
SPOTS = "SELECT DISTINCT frame, k AS spot FROM planes, (VALUES (0::BIGINT), (1)) s(k) WHERE frame % 3 <> 2 AND (k = 0 OR frame % 2 = 0)"
GREYS = [max(0, min(255, (v * 4769 - 81520) >> 12)) for v in range(256)]
LUMAS = "[" + ", ".join(map(str, planes.nearest_luma(GREYS))) + "]"


def _spot_sql(source: str, k: int) -> str:
    """Planes of source after spot k of each frame, with the change of the grey where it was put."""
    cx, cy = f"(frame % 7 + {k} + 0.5)", f"(frame % 5 + {2 * k} + 0.25)"
    grey = "greatest(0, least(255, ({v} * 4769 - 81520) >> 12))"
    there = f"frame % 3 <> 2 AND ({k} = 0 OR frame % 2 = 0) AND abs(pixel % 8 - floor({cx})) <= 3 AND abs(pixel // 8 - floor({cy})) <= 3"
    aimed = (f"{grey.format(v='value')} + CAST(floor(round({40 if k == 0 else -30} * exp(-((pixel % 8 - {cx}) * (pixel % 8 - {cx}) + (pixel // 8 - {cy}) * (pixel // 8 - {cy})) / 2::DOUBLE), 9)) AS INT)")
    after = f"CAST(({LUMAS})[greatest(0, least(255, {aimed})) + 1] AS INT)"
    return f"""SELECT frame, pixel, after AS value, CASE WHEN there THEN {grey.format(v='after')} - {grey.format(v='value')} END AS change FROM (
      SELECT *, CASE WHEN there THEN {after} ELSE value END AS after FROM (SELECT frame, pixel, value, {there} AS there FROM {source}) a{k}) b{k}"""


def _spots(t):
    at = t("planes").select("frame").distinct().crossJoin(t.spark.range(2).select(F.col("id").alias("spot"))).filter("frame % 3 <> 2 AND (spot = 0 OR frame % 2 = 0)")
    return at.select("frame", "spot", (F.col("frame") % 7 + F.col("spot") + 0.5).alias("cx"), (F.col("frame") % 5 + 2 * F.col("spot") + 0.25).alias("cy"),
                     F.when(F.col("spot") == 0, 40.0).otherwise(-30.0).alias("amplitude"), F.lit(1.0).alias("sigma"))


INJECTED = f"WITH one AS ({_spot_sql('planes', 0)}), two AS ({_spot_sql('one', 1)})"


def _totals(t):
    points = cut(t("scene_points"))
    return evaluation.totals(
        evaluation.target_results(_seen(t), _hits(t), ["video", "target"]), points.select("video", "track"),
        matching.assigned_targets(points, _targets(t)), matching.matching_share(points, t("candidates").filter("det_idx % 5 = 0")), t("track_points").select("video", "track"))


def _versions(t):
    """Each customer's state as loaded, saved and now, from the orders: priorities and a status."""
    orders = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("verdict"), F.substring("o_orderpriority", 1, 1).alias("species"), "o_orderkey")
    first, last = Window.partitionBy("key").orderBy("o_orderkey"), Window.partitionBy("key").orderBy(F.desc("o_orderkey"))
    rows = orders.withColumn("a", F.row_number().over(first)).withColumn("b", F.row_number().over(last))
    state = lambda where: rows.filter(where).select("key", "verdict", "species")
    return state("a = 1 AND key % 10 <> 3"), state("b = 2"), state("b = 1 AND key % 10 <> 7")


VERSIONS = """
  WITH v AS (SELECT o_custkey AS key, o_orderstatus AS verdict, substr(o_orderpriority, 1, 1) AS species, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders),
  k AS (SELECT DISTINCT key FROM v),
  s AS (SELECT k.key, coalesce(l.verdict, '') || '/' || coalesce(l.species, '') AS loaded, coalesce(s.verdict, '') || '/' || coalesce(s.species, '') AS saved, coalesce(n.verdict, '') || '/' || coalesce(n.species, '') AS now
    FROM k LEFT JOIN (SELECT * FROM v WHERE a = 1 AND key % 10 <> 3) l USING (key) LEFT JOIN (SELECT * FROM v WHERE b = 2) s USING (key) LEFT JOIN (SELECT * FROM v WHERE b = 1 AND key % 10 <> 7) n USING (key))"""


def _hits_of_videos(t):
    """What a point hits in each video."""
    dx, dy = F.col("x") - 700.0, F.col("y") - 500.0
    return t("scene_points").select("video", (F.col("track") * 10000 + F.col("frame")).alias("id"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("d")).filter("d <= 160")


def _trails(t):
    order = Window.partitionBy("video", "track").orderBy("frame")
    rows = t("scene_points").select("video", "track", "frame", F.lag("x").over(order).alias("from_x"), F.lag("y").over(order).alias("from_y"), F.col("x").alias("to_x"), F.col("y").alias("to_y"),
                                    (F.col("x") - F.col("frame") % 5 * 4 - F.col("width")).alias("left"), (F.col("y") - F.col("frame") % 3 * 2).alias("top"), "width", "height")
    return rows.filter("from_x IS NOT NULL")


PIECES = """
  WITH seg AS (SELECT video, track, frame, lag(x) OVER w AS fx, lag(y) OVER w AS fy, x AS tx, y AS ty, x - frame % 5 * 4 - width - 2 AS x0, y - frame % 3 * 2 - 2 AS y0,
                 x - frame % 5 * 4 + 2 AS x1, y - frame % 3 * 2 + height + 2 AS y1 FROM scene_points WINDOW w AS (PARTITION BY video, track ORDER BY frame)),
  s AS (SELECT *, CASE WHEN tx <> fx THEN least((x0 - fx) / (tx - fx), (x1 - fx) / (tx - fx)) WHEN fx BETWEEN x0 AND x1 THEN -1 ELSE 9 END AS ex,
                 CASE WHEN tx <> fx THEN greatest((x0 - fx) / (tx - fx), (x1 - fx) / (tx - fx)) WHEN fx BETWEEN x0 AND x1 THEN 9 ELSE -1 END AS lx,
                 CASE WHEN ty <> fy THEN least((y0 - fy) / (ty - fy), (y1 - fy) / (ty - fy)) WHEN fy BETWEEN y0 AND y1 THEN -1 ELSE 9 END AS ey,
                 CASE WHEN ty <> fy THEN greatest((y0 - fy) / (ty - fy), (y1 - fy) / (ty - fy)) WHEN fy BETWEEN y0 AND y1 THEN 9 ELSE -1 END AS ly
        FROM seg WHERE fx IS NOT NULL AND (fx <> tx OR fy <> ty)),
  m AS (SELECT *, greatest(0, ex, ey) AS a, least(1, lx, ly) AS b FROM s)
  SELECT video, track, frame, round(fx, 6) AS from_x, round(fy, 6) AS from_y, round(CASE WHEN a < b THEN fx + (tx - fx) * a ELSE tx END, 6) AS to_x, round(CASE WHEN a < b THEN fy + (ty - fy) * a ELSE ty END, 6) AS to_y
  FROM m WHERE NOT a < b OR a > 0
  UNION ALL SELECT video, track, frame, round(fx + (tx - fx) * b, 6), round(fy + (ty - fy) * b, 6), round(tx, 6), round(ty, 6) FROM m WHERE a < b AND b < 1"""


def _folders(t):
    paths = t("pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("u"), "page_id")
    out = paths.select(F.concat(F.lit("/"), "u", F.when(F.col("page_id") % 3 == 0, "/../x").when(F.col("page_id") % 3 == 1, "/./y//").otherwise("")).alias("path"))
    protected = paths.filter("page_id % 7 = 0").select(F.concat(F.lit("/"), F.substring_index("u", "/", 2), F.when(F.col("page_id") % 2 == 0, "/").otherwise("")).alias("folder"))
    return out, protected


OVERLAPS = """
  WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS u FROM pages),
  o AS (SELECT DISTINCT '/' || u || CASE page_id % 3 WHEN 0 THEN '/../x' WHEN 1 THEN '/./y//' ELSE '' END AS path,
               '/' || CASE page_id % 3 WHEN 0 THEN regexp_replace(rtrim(u, '/'), '[^/]*$', '') || 'x' WHEN 1 THEN rtrim(u, '/') || '/y' ELSE rtrim(u, '/') END AS at FROM p),
  f AS (SELECT DISTINCT '/' || array_to_string(string_split(u, '/')[1:2], '/') || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS folder,
               '/' || rtrim(array_to_string(string_split(u, '/')[1:2], '/'), '/') AS at FROM p WHERE page_id % 7 = 0)
  SELECT DISTINCT path, folder FROM o JOIN f ON o.at = f.at OR starts_with(o.at, f.at || '/') OR starts_with(f.at, o.at || '/')"""


def _compared(t):
    """The second run against the first one as its reference: inputs, detections by ranges that differ, damaged spans."""
    a = t("frames")
    other = a.select("video", "frame", F.when((F.col("video") == 0) & (F.col("frame") % 401 == 400), F.col("pts") + 1).otherwise(F.col("pts")).alias("pts"),
                     (F.col("key_frame") | ((F.col("video") == 1) & (F.col("frame") % 500 == 499))).alias("key_frame"), "decode_error")
    gaps = golden.first_gaps(a, other, ["pts", "key_frame", "decode_error"])
    rows = [cut(t(name).select("video", "frame", "x", "y", "area")) for name in ("detections", "candidates")]
    ranges = golden.differing(*(golden.tree(r) for r in rows))
    held = [r.withColumn("node", F.expr(f"frame div {golden.RANGE}")).join(ranges, ["video", "node"], "left_semi").drop("node") for r in rows]
    return golden.verdicts(a, gaps, golden.unequal(*held), timeline.damaged_spans(cut(a), HALF, t("announced")))


COMPARED = f"""
  WITH a AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM detections GROUP BY video, frame),
  b AS (SELECT video, frame, list_sort(list((x, y, area))) AS l FROM candidates GROUP BY video, frame),
  s AS ({EDGES}),
  d AS (SELECT coalesce(a.video, b.video) AS video, coalesce(a.frame, b.frame) AS frame FROM a FULL JOIN b ON a.video = b.video AND a.frame = b.frame WHERE a.l IS DISTINCT FROM b.l),
  f AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE s.video = d.video AND d.frame BETWEEN s.first AND s.last) AS hidden FROM d),
  n AS (SELECT video, count(*) FILTER (WHERE hidden) AS inside, count(*) FILTER (WHERE NOT hidden) AS outside,
          array_to_string(list_slice(list_sort(list(frame) FILTER (WHERE NOT hidden)), 1, 10), ',') AS firsts FROM f GROUP BY video),
  g AS (SELECT video, CASE WHEN p IS NOT NULL THEN 'pts' WHEN k IS NOT NULL THEN 'key_frame' END AS gap, coalesce(p, k) AS gap_frame FROM (
    SELECT video, min(CASE WHEN video = 0 AND frame % 401 = 400 AND pts IS NOT NULL THEN frame END) AS p, min(CASE WHEN video = 1 AND frame % 500 = 499 AND NOT key_frame THEN frame END) AS k
    FROM frames GROUP BY video) q)
  SELECT v.video, CASE WHEN gap IS NOT NULL THEN 'inputs differ' WHEN coalesce(outside, 0) > 0 THEN 'differs' ELSE 'same' END AS verdict, gap, gap_frame, coalesce(inside, 0) AS inside,
         coalesce(outside, 0) AS outside, coalesce(firsts, '') AS firsts, greatest(coalesce(outside, 0) - 10, 0) AS more, coalesce(c.spans, 0) AS spans, coalesce(c.damaged_frames, 0) AS damaged_frames
  FROM (SELECT DISTINCT video FROM frames) v LEFT JOIN g ON g.video = v.video LEFT JOIN n ON n.video = v.video
  LEFT JOIN (SELECT video, count(*) AS spans, CAST(sum(last - first + 1) AS BIGINT) AS damaged_frames FROM s GROUP BY video) c ON c.video = v.video"""


START = keys._mixed(keys._mixed(keys.OFFSET, (8).to_bytes(4, "little")), (8).to_bytes(4, "little"))
KEYS = f"""
  WITH RECURSIVE w AS (SELECT frame, pixel // 8 AS k, sum(CAST(value AS HUGEINT) * (CAST(1 AS HUGEINT) << (8 * (pixel % 8)))) AS word FROM planes GROUP BY frame, pixel // 8 UNION ALL SELECT DISTINCT frame, 8, 64 FROM planes),
  r AS (SELECT DISTINCT frame, 0 AS k, CAST({START} AS HUGEINT) AS h FROM planes UNION ALL
    SELECT frame, k + 1, xor(p, p // 4294967296) FROM (SELECT r.frame, r.k, (xor(r.h, CAST(w.word AS HUGEINT)) * {keys.PRIME}) % 18446744073709551616 AS p FROM r JOIN w ON w.frame = r.frame AND w.k = r.k) q)
  SELECT frame, lpad(lower(hex(CAST(h AS UBIGINT))), 16, '0') AS key FROM r WHERE k = 9"""


def _parted(t):
    a, b = intervals.parted(t("detections"), t("spans"), ["video"])
    return a.select("det_idx", F.lit("inside").alias("part")).unionByName(b.select("det_idx", F.lit("outside").alias("part")))


def _nearest(t):
    a = t("detections").select("video", "frame", F.col("det_idx").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = t("candidates").select("video", "frame", F.col("det_idx").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return matching.nearest(a, b, ["video", "frame"], 120.0).withColumn("d", F.round("d", 6))


def _curves(t):
    k, p = F.col("c_custkey"), F.col("c_nationkey")
    length = rendering.bezier_length((k % 700 + 0.0, k % 500 + 0.0), (k % 1300 + 0.5, p * 30 + 0.0), (F.lit(1440.0), k % 900 + 0.25))
    return t("customer").select("c_custkey", F.round(length, 4).alias("length"))


QUERIES = {
    "b06_covered_blocks": (lambda t: t("orders").select("o_orderkey", rendering.block_covered(F.col("o_orderkey") % 15 * 64, F.col("o_orderkey") % 15 * 64 + 63, F.array(*(
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((0, 128), (200, 420), (640, 960))))).alias("covered")), """
        SELECT o_orderkey, b + 63 < 128 OR (b >= 200 AND b + 63 < 420) OR (b >= 640 AND b + 63 < 960) AS covered FROM (SELECT o_orderkey, o_orderkey % 15 * 64 AS b FROM orders) o"""),
    "f12_points_text": (lambda t: t("scene_points").groupBy("video", "track").agg(F.array_sort(F.collect_list(F.struct("frame", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y")))).alias("p")).select(
        "video", "track", text.points_text(F.col("p")).alias("points")), """
        SELECT video, track, string_agg(p, ' ' ORDER BY frame) AS points FROM (SELECT *, lag(p) OVER (PARTITION BY video, track ORDER BY frame) AS q FROM (
          SELECT video, track, frame, CAST(round(x / 8) AS BIGINT) || ',' || CAST(round(y / 8) AS BIGINT) AS p FROM scene_points) a) b WHERE q IS DISTINCT FROM p GROUP BY video, track"""),
    "f17_curve_lengths": (_curves, """
        SELECT c_custkey, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))), 4) AS length FROM (
          SELECT c_custkey, (1 - s) * (1 - s) * ax + 2 * (1 - s) * s * bx + s * s * 1440 AS x0, (1 - s) * (1 - s) * ay + 2 * (1 - s) * s * "by" + s * s * cy AS y0,
                 (1 - e) * (1 - e) * ax + 2 * (1 - e) * e * bx + e * e * 1440 AS x1, (1 - e) * (1 - e) * ay + 2 * (1 - e) * e * "by" + e * e * cy AS y1 FROM (
            SELECT c_custkey, CAST(c_custkey % 700 AS DOUBLE) AS ax, CAST(c_custkey % 500 AS DOUBLE) AS ay, c_custkey % 1300 + 0.5::DOUBLE AS bx, CAST(c_nationkey * 30 AS DOUBLE) AS "by", c_custkey % 900 + 0.25::DOUBLE AS cy,
                   CAST(k - 1 AS DOUBLE) / 64 AS s, CAST(k AS DOUBLE) / 64 AS e FROM customer, range(1, 65) r(k)) p) q GROUP BY c_custkey"""),
    "f23_regions": (lambda t: t("lineitem").select("l_orderkey", "l_linenumber", text.region(F.concat_ws(",", F.col("l_orderkey") % 10, F.concat(F.lit(" "), F.col("l_partkey") % 7), F.when(
        F.col("l_linenumber") == 3, "x").otherwise("0.5"), F.when(F.col("l_linenumber") != 5, "1"))).alias("r")).select("l_orderkey", "l_linenumber", *(F.get("r", F.lit(k)).alias(f"r{k}") for k in range(4))), """
        SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN CAST(l_orderkey % 10 AS DOUBLE) END AS r0, CASE WHEN ok THEN CAST(l_partkey % 7 AS DOUBLE) END AS r1, CASE WHEN ok THEN 0.5::DOUBLE END AS r2,
               CASE WHEN ok THEN 1::DOUBLE END AS r3 FROM (SELECT *, l_linenumber NOT IN (3, 5) AS ok FROM lineitem) l"""),
    "k05_nearest_by_key": (_nearest, """
        SELECT video, frame, a_id, b_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, a_id ORDER BY d, b_id) AS rn FROM (
          SELECT a.video, a.frame, a.det_idx AS a_id, b.det_idx AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM detections a JOIN candidates b ON a.video = b.video AND a.frame = b.frame) p
          WHERE d <= 120) q WHERE rn = 1"""),
    "u05_parts": (_parted, """
        SELECT det_idx, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.video = d.video AND d.frame BETWEEN s.first AND s.last) THEN 'inside' ELSE 'outside' END AS part FROM detections d"""),
    "p10_plane_keys": (lambda t: planes.luma_of(t("planes")).select("frame", keys.plane_keys(F.lit(8), F.lit(8), "luma").alias("key")), KEYS),
    "g15_compared_runs": (_compared, COMPARED),
    "g03_edge_damage": (lambda t: timeline.damaged_spans(cut(t("frames")), HALF, t("announced")), EDGES),
    "g17_false_tracks": (_totals, f"""
        SELECT coalesce(r.video, c.video, k.video) AS video, coalesce(not_visible, 0) AS not_visible, coalesce(evaluated, 0) AS evaluated, coalesce(found, 0) AS found,
               coalesce(injected_tracks, 0) AS injected_tracks, coalesce(reference_tracks, 0) AS reference_tracks, coalesce(false_tracks, 0) AS false_tracks FROM (
          SELECT video, count(*) FILTER (WHERE NOT judged) AS not_visible, count(*) FILTER (WHERE judged) AS evaluated, count(*) FILTER (WHERE found) AS found FROM ({TARGET_RESULTS}) r0 GROUP BY video) r
        FULL JOIN (SELECT s.video, count(*) AS injected_tracks, count(*) FILTER (WHERE a.track IS NULL AND NOT m.matches) AS false_tracks
          FROM (SELECT DISTINCT video, track FROM scene_points) s LEFT JOIN ({ASSIGNED}) a ON a.video = s.video AND a.track = s.track JOIN ({MATCHES}) m ON m.video = s.video AND m.track = s.track GROUP BY s.video) c ON c.video = r.video
        FULL JOIN (SELECT video, count(DISTINCT track) AS reference_tracks FROM track_points GROUP BY video) k ON k.video = coalesce(r.video, c.video)"""),
    "p09_readable_median": (lambda t: planes.scene(t("planes"), 25, t("planes").filter("frame % 9 = 4").select(F.col("frame").alias("first"), (F.col("frame") + 3).alias("last")).distinct()), """
        WITH f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM planes) a),
        c AS (SELECT frame, frame % 9 BETWEEN 4 AND 7 AS bad FROM f WHERE rank IN (SELECT (2 * i + 1) * n // 50 FROM range(0, 25) r(i)))
        SELECT pixel, CAST(ceil(quantile_cont(CAST(value AS DOUBLE), 0.5)) AS INT) AS value FROM planes JOIN c USING (frame) WHERE NOT bad OR (SELECT bool_and(bad) FROM c) GROUP BY pixel"""),
    "p13_injected_planes": (lambda t: planes.injected(t("planes"), _spots(t), 8, 8)[0], f"{INJECTED} SELECT frame, pixel, value FROM two"),
    "p13_effective_changes": (lambda t: planes.injected(t("planes"), _spots(t), 8, 8)[1], f"""{INJECTED}
        SELECT frame, CAST(0 AS BIGINT) AS spot, max(change) AS change FROM one WHERE change IS NOT NULL GROUP BY frame
        UNION ALL SELECT frame, 1, min(change) FROM two WHERE change IS NOT NULL GROUP BY frame"""),
    "s06_explained_losses": (lambda t: timeline.reconciled(t("frames"), t("announced").select("video", "announced", "start", "after_last")), f"""
        SELECT *, announced - before_first - at_jumps - after_last = decoded AS explained FROM (
          SELECT a.video, a.announced, f.decoded, coalesce(greatest(CAST(round((o.pts - a.start) / t.step) AS BIGINT) - o.frame, 0), 0) AS before_first, coalesce(j.lost, 0) AS at_jumps, a.after_last
          FROM announced a JOIN (SELECT video, count(*) AS decoded FROM frames GROUP BY video) f ON f.video = a.video
          LEFT JOIN (SELECT video, min(frame) AS frame, arg_min(pts, frame) AS pts FROM frames WHERE pts IS NOT NULL GROUP BY video) o ON o.video = a.video
          LEFT JOIN ({STEP}) t ON t.video = a.video LEFT JOIN (SELECT video, CAST(sum(lost) AS BIGINT) AS lost FROM ({JUMPS}) q GROUP BY video) j ON j.video = a.video) r"""),
    "s09_state_changes": (lambda t: ledger.state_changes(*_versions(t), ["key"]), VERSIONS + " SELECT key, now <> saved AS pending, now <> loaded AS drifted FROM s WHERE now <> saved OR now <> loaded"),
    "j14_first_unordered": (lambda t: timeline.first_unordered(t("frames").withColumn("pts", F.when((F.col("frame") % 77 == 3) & (F.col("video") < 2), F.col("pts") - 5000).otherwise(F.col("pts")))), """
        SELECT video, min(frame) AS frame FROM (SELECT *, pts <= lag(pts) OVER (PARTITION BY video ORDER BY frame) AS late
          FROM (SELECT video, frame, CASE WHEN frame % 77 = 3 AND video < 2 THEN pts - 5000 ELSE pts END AS pts FROM frames) f WHERE pts IS NOT NULL) g WHERE late GROUP BY video"""),
    "j14_checked_lookup": (lambda t: timeline.frames_of_pts(t("frames"), t("frames").filter("pts IS NOT NULL").select("video", F.col("pts") + F.col("frame") % 2)
                                                            .toDF("video", "pts")), """
        SELECT f.video, f.pts, f.frame FROM frames f JOIN (SELECT video, pts + frame % 2 AS pts FROM frames WHERE pts IS NOT NULL) w ON w.video = f.video AND w.pts = f.pts"""),
    "j27_next_hit": (lambda t: ledger.next_hit(_hits_of_videos(t), ["video"]), """
        SELECT video, id AS current, coalesce(lead(id) OVER (PARTITION BY video ORDER BY d, id), first_value(id) OVER (PARTITION BY video ORDER BY d, id)) AS next FROM (
          SELECT video, track * 10000 + frame AS id, round(sqrt((x - 700) * (x - 700) + (y - 500) * (y - 500)), 6) AS d FROM scene_points) h WHERE d <= 160"""),
    "b06_clipped_trails": (lambda t: rendering.outside_box(_trails(t), 2.0).select("video", "track", "frame", *(F.round(c, 6).alias(c) for c in ("from_x", "from_y", "to_x", "to_y"))), PIECES),
    "a18_protected_folders": (lambda t: ledger.overlaps(*_folders(t)), OVERLAPS),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
