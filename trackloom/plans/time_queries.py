"""Queries over intervals and frames, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.operators import intervals, timeline
from trackloom.plans.adapters import oracle

HALF, START, TICKS, RATE = 15, 333, 9990.0, 30.0


def union_sql(source: str, pad: int = 0, keys: str = "video") -> str:
    """SQL text of the union of spans."""
    return f"""
      SELECT {keys}, min(first) AS first, max(last) AS last, count(*) AS members FROM (
        SELECT *, sum(CASE WHEN m IS NULL OR first > m + {pad} + 1 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY {keys} ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, max(last) OVER (PARTITION BY {keys} ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
          FROM ({source}) s0) s1) s2 GROUP BY {keys}, island"""


STEPS = """
  SELECT video, frame, frame - lag(frame) OVER w AS frames, pts - lag(pts) OVER w AS ticks
  FROM frames WHERE pts IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY frame)"""
STEPS = f"SELECT * FROM ({STEPS}) s WHERE frames IS NOT NULL"
STEP = f"""
  SELECT video, coalesce(CAST(sum(CASE WHEN fits THEN ticks END) AS DOUBLE) / sum(CASE WHEN fits THEN frames END), min(median)) AS step FROM (
    SELECT s.*, m.median, round(CAST(ticks AS DOUBLE) / median) = frames AS fits
    FROM ({STEPS}) s JOIN (
      SELECT video, CAST(ticks AS DOUBLE) / frames AS median FROM (
        SELECT *, row_number() OVER (PARTITION BY video ORDER BY CAST(ticks AS DOUBLE) / frames) AS rn, count(*) OVER (PARTITION BY video) AS n
        FROM ({STEPS}) a) b WHERE rn = n // 2 + 1) m ON s.video = m.video) c GROUP BY video"""
JUMPS = f"""
  SELECT video, frame, CAST(round(ticks / step) - frames AS BIGINT) AS lost
  FROM ({STEPS}) s JOIN ({STEP}) t USING (video) WHERE round(ticks / step) > frames"""
DAMAGE = union_sql(f"""
  SELECT b.video, greatest(0, b.frame - {HALF}) AS first,
         least(coalesce((SELECT min(k.frame) - 1 FROM frames k WHERE k.video = b.video AND k.key_frame AND k.frame > b.frame), e.last) + {HALF}, e.last) AS last
  FROM (SELECT video, frame FROM frames WHERE decode_error UNION SELECT video, frame FROM ({JUMPS}) j) b
  JOIN (SELECT video, max(frame) AS last FROM frames GROUP BY video) e ON b.video = e.video""")
COUNTS = f"""
  SELECT f.video, f.frame, count(d.frame) AS n FROM frames f LEFT JOIN crowded d ON d.video = f.video AND d.frame = f.frame
  WHERE NOT EXISTS (SELECT 1 FROM ({DAMAGE}) s WHERE s.video = f.video AND f.frame BETWEEN s.first AND s.last)
  GROUP BY f.video, f.frame"""
UNSTABLE = union_sql(f"""
  SELECT video, greatest(low, frame - 30) AS first, least(high, frame + 30) AS last FROM ({COUNTS}) c JOIN (
    SELECT video, 20 + 3 * (max(CASE WHEN rn = (n0 + 1) // 2 THEN n END) + max(CASE WHEN rn = n0 // 2 + 1 THEN n END)) AS lim,
           min(frame) AS low, max(frame) AS high FROM (
      SELECT *, row_number() OVER (PARTITION BY video ORDER BY n, frame) AS rn, count(*) OVER (PARTITION BY video) AS n0 FROM ({COUNTS}) c1) c2
    GROUP BY video) l USING (video) WHERE n >= lim""")
IGNORED = union_sql(f"SELECT video, first, last FROM ({DAMAGE}) d UNION ALL SELECT video, first, last FROM ({UNSTABLE}) u")


def _damaged(t):
    return timeline.damaged_spans(cut(t("frames")), HALF)


def _spans(t):
    """Damaged, unstable and all ignored spans, each worked out once."""
    frames = cut(t("frames"))
    damaged = cut(timeline.damaged_spans(frames, HALF))
    unstable = cut(timeline.unstable_spans(frames, t("crowded"), damaged))
    return frames, damaged, unstable, timeline.ignored_spans(damaged, unstable)


def _unstable(t):
    return _spans(t)[2]


def _ignored(t):
    return _spans(t)[3]


def _summary(t):
    rows, *kinds = _spans(t)
    out = rows.groupBy("video").agg(F.count(F.lit(1)).alias("frames"))
    for name, spans in zip(("damaged", "unstable", "ignored"), kinds):
        out = out.join(intervals.covered_frames(spans, ["video"]).withColumnRenamed("frames", name), "video", "left")
    return out.select("video", "frames", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("damaged", "unstable", "ignored")))


def _covered(sql: str, name: str) -> str:
    return f"(SELECT video, CAST(sum(last - first + 1) AS BIGINT) AS {name} FROM ({sql}) q GROUP BY video)"


def _algebra(t):
    """Unions, intersections, hulls and widening of each span with the next one of its video."""
    from pyspark.sql import Window

    order = Window.partitionBy("video").orderBy("span_id")
    rows = t("spans").withColumn("f2", F.lead("first").over(order)).withColumn("l2", F.lead("last").over(order)).filter("f2 IS NOT NULL")
    a, b = (F.col("first"), F.col("last")), (F.col("f2"), F.col("l2"))
    both, around, wide = intervals.intersection(a, b), intervals.hull(a, b), intervals.widened(*a, 10)
    return rows.select("span_id", both[0].alias("both_first"), both[1].alias("both_last"), (both[0] <= both[1]).alias("overlap"),
                       around[0].alias("hull_first"), around[1].alias("hull_last"), wide[0].alias("wide_first"), wide[1].alias("wide_last"))


QUERIES = {
    "g01_merged_spans": (lambda t: intervals.merged(t("spans"), ["video"]), union_sql("SELECT * FROM spans")),
    "g02_gap_merged_spans": (lambda t: intervals.merged(t("spans"), ["video"], 3), union_sql("SELECT * FROM spans", 3)),
    "g03_damage_spans": (_damaged, DAMAGE),
    "g04_reported_frames": (lambda t: timeline.reported_frames(t("frames")), f"""
        SELECT video, count(DISTINCT frame) AS reported FROM (
          SELECT video, frame FROM frames WHERE decode_error UNION ALL SELECT video, frame FROM ({JUMPS}) j) r GROUP BY video"""),
    "g05_unstable_spans": (_unstable, UNSTABLE),
    "g06_exclusion_summary": (_summary, f"""
        SELECT f.video, f.frames, coalesce(damaged, 0) AS damaged, coalesce(unstable, 0) AS unstable, coalesce(ignored, 0) AS ignored
        FROM (SELECT video, count(*) AS frames FROM frames GROUP BY video) f
        LEFT JOIN {_covered(DAMAGE, 'damaged')} a USING (video) LEFT JOIN {_covered(UNSTABLE, 'unstable')} b USING (video)
        LEFT JOIN {_covered(IGNORED, 'ignored')} c USING (video)"""),
    "j04_excluded_detections": (lambda t: intervals.outside(t("crowded"), _ignored(t), ["video"]).select("det_idx", "video", "frame", "x", "y", "area"), f"""
        SELECT det_idx, video, frame, x, y, area FROM crowded d WHERE NOT EXISTS (
          SELECT 1 FROM ({IGNORED}) s WHERE s.video = d.video AND d.frame BETWEEN s.first AND s.last)"""),
    "b14_detections_without_spans": (lambda t: t("frames").select("video", "frame").join(
        intervals.outside(t("detections"), t("spans"), ["video"]).groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n")),
        ["video", "frame"], "left").select("video", "frame", F.coalesce("n", F.lit(0)).alias("n")), """
        SELECT f.video, f.frame, count(d.frame) AS n FROM frames f LEFT JOIN (
          SELECT * FROM detections d WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.video = d.video AND d.frame BETWEEN s.first AND s.last)) d
          ON d.video = f.video AND d.frame = f.frame GROUP BY f.video, f.frame"""),
    "j05_frames_in_clips": (lambda t: intervals.containing(t("frames").select("video", "frame"), t("spans"), ["video"]).select("video", "frame", "span_id"), """
        SELECT f.video, f.frame, s.span_id FROM frames f JOIN spans s ON s.video = f.video AND f.frame BETWEEN s.first AND s.last"""),
    "j12_last_clean_key": (lambda t: timeline.last_key_before(t("frames")), """
        SELECT f.video, f.frame, max(k.frame) AS key FROM frames f LEFT JOIN frames k
          ON k.video = f.video AND k.frame <= f.frame AND k.key_frame AND NOT k.decode_error GROUP BY f.video, f.frame"""),
    "j13_until_next_key": (lambda t: timeline.until_next_key(t("frames")), """
        SELECT f.video, f.frame, coalesce((SELECT min(k.frame) - 1 FROM frames k WHERE k.video = f.video AND k.key_frame AND k.frame > f.frame),
                                          max(f.frame) OVER (PARTITION BY f.video)) AS until FROM frames f"""),
    "j14_frame_of_pts": (lambda t: t("frames").filter("pts IS NOT NULL").join(
        t("frames").filter("pts IS NOT NULL").select("video", "pts", F.col("frame").alias("served")), ["video", "pts"]).select("video", "pts", "served"), """
        SELECT a.video, a.pts, b.frame AS served FROM frames a JOIN frames b ON a.video = b.video AND a.pts = b.pts
        WHERE a.pts IS NOT NULL"""),
    "u01_span_algebra": (_algebra, """
        SELECT span_id, greatest(first, f2) AS both_first, least(last, l2) AS both_last, greatest(first, f2) <= least(last, l2) AS overlap,
               least(first, f2) AS hull_first, greatest(last, l2) AS hull_last, greatest(0, first - 10) AS wide_first, last + 10 AS wide_last
        FROM (SELECT *, lead(first) OVER w AS f2, lead(last) OVER w AS l2 FROM spans WINDOW w AS (PARTITION BY video ORDER BY span_id)) s WHERE f2 IS NOT NULL"""),
    "u02_union_distinct_frames": (lambda t: t("frames").filter("decode_error").select("video", "frame").union(
        t("frames").filter("pts IS NULL").select("video", "frame")).distinct(), """
        SELECT video, frame FROM frames WHERE decode_error UNION SELECT video, frame FROM frames WHERE pts IS NULL"""),
    "w06_pts_steps": (lambda t: timeline.steps(t("frames")), STEPS),
    "w07_typical_step": (lambda t: timeline.typical_step(t("frames")).select("video", F.round("step", 6).alias("step")), f"SELECT video, round(step, 6) AS step FROM ({STEP}) s"),
    "w08_pts_jumps": (lambda t: timeline.jumps(t("frames")), JUMPS),
    "w09_lost_before_first": (lambda t: timeline.before_first(t("frames"), -START * 4), f"""
        SELECT video, greatest(0, CAST(round((p + {START * 4}) / step) AS BIGINT) - f) AS lost FROM (
          SELECT video, arg_min(pts, frame) AS p, min(frame) AS f FROM frames WHERE pts IS NOT NULL GROUP BY video) a JOIN ({STEP}) b USING (video)"""),
    "w17_frame_seconds": (lambda t: timeline.frame_seconds(t("frames"), TICKS, RATE), f"""
        SELECT video, frame, round(coalesce(p / CAST({TICKS} AS DOUBLE) + (frame - k) / CAST({RATE} AS DOUBLE), frame / CAST({RATE} AS DOUBLE)), 6) AS seconds FROM (
          SELECT video, frame, last_value(pts IGNORE NULLS) OVER w AS p, last_value(CASE WHEN pts IS NOT NULL THEN frame END IGNORE NULLS) OVER w AS k
          FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING)) f"""),
    "g29_pieces": (lambda t: timeline.pieces(t("frames"), _damaged(t)), f"""
        SELECT video, CAST(piece AS BIGINT) AS piece, state, min(frame) AS first, max(frame) AS last FROM (
          SELECT *, sum(CASE WHEN before IS NULL OR before <> state THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING) AS piece FROM (
            SELECT *, lag(state) OVER (PARTITION BY video ORDER BY frame) AS before FROM (
              SELECT f.video, f.frame, CASE WHEN EXISTS (SELECT 1 FROM ({DAMAGE}) s WHERE s.video = f.video AND f.frame BETWEEN s.first AND s.last)
                     THEN 'damaged' ELSE 'clean' END || '/' || CASE WHEN pts IS NULL THEN 'unknown' ELSE 'known' END AS state FROM frames f) a) b) c
        GROUP BY video, piece, state"""),
    "s05_sampled_ranks": (lambda t: t("frames").groupBy("video").agg(F.count(F.lit(1)).alias("n")).select(
        "video", F.explode(timeline.sample_ranks(F.col("n"), 25)).alias("frame")), """
        SELECT DISTINCT video, (2 * i + 1) * n // 50 AS frame FROM (SELECT video, count(*) AS n FROM frames GROUP BY video) f, range(0, 25) r(i)"""),
    "s06_frame_reconciliation": (lambda t: t("frames").groupBy("video").agg(
        F.count(F.lit(1)).alias("decoded"), (F.max("frame") + 1).alias("announced"), F.count_if("decode_error").alias("errors")).select(
        "*", (F.col("decoded") == F.col("announced")).alias("explained")), """
        SELECT video, count(*) AS decoded, max(frame) + 1 AS announced, count(*) FILTER (WHERE decode_error) AS errors, count(*) = max(frame) + 1 AS explained
        FROM frames GROUP BY video"""),
    "s07_order_faults": (lambda t: timeline.order_faults(t("frames").filter("frame % 101 <> 5").withColumn(
        "pts", F.when(F.col("frame") % 77 == 3, F.col("pts") - 5000).otherwise(F.col("pts")))), """
        SELECT video, frame, late, missing FROM (
          SELECT video, frame, coalesce(pts <= last_value(pts IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late,
                 coalesce(frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) <> 1, false) AS missing
          FROM (SELECT video, frame, CASE WHEN frame % 77 = 3 THEN pts - 5000 ELSE pts END AS pts FROM frames WHERE frame % 101 <> 5) f) g WHERE late OR missing"""),
    "g30_extent": (lambda t: _summary(t).select("video", F.round(F.col("frames") / RATE, 6).alias("length_s"), F.round(F.col("ignored") / RATE, 6).alias("not_analysed_s")), f"""
        SELECT f.video, round(f.frames / CAST({RATE} AS DOUBLE), 6) AS length_s, round(coalesce(ignored, 0) / CAST({RATE} AS DOUBLE), 6) AS not_analysed_s
        FROM (SELECT video, count(*) AS frames FROM frames GROUP BY video) f LEFT JOIN {_covered(IGNORED, 'ignored')} c USING (video)"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
