"""Queries of evaluation, ledgers and text forms, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import evaluation, ledger
from trackloom.plans.adapters import oracle
from trackloom.plans.match_queries import STARTS, TARGETS, _starts, _targets


def wilson_sql(found: str, n: str, sign: str) -> str:
    f, m = f"CAST({found} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    p = f"({f} / {m})"
    half = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {m} + 3.8416::DOUBLE / (4 * {m} * {m}))"
    return (f"round(CASE WHEN {n} = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, "
            f"({p} + 3.8416::DOUBLE / (2 * {m}) {sign} {half}) / (1 + 3.8416::DOUBLE / {m}))) END, 6)")


def _hits(t):
    """Truth points and the scene's points near them."""
    from trackloom.operators.matching import near_pairs

    a = t("scene_points").select("video", "frame", F.col("track").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = _targets(t).select("video", "frame", F.col("target").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return near_pairs(a, b, ["video", "frame"], 24.0).select("video", F.col("b_id").alias("target"), "frame", F.col("a_id").alias("track"))


def _seen(t):
    return _targets(t).withColumn("contrast", F.col("frame") % 40 + 5.0)


SEEN = f"(SELECT *, CAST(frame % 40 + 5 AS DOUBLE) AS contrast FROM ({TARGETS}) t0)"
TARGET_RESULTS = f"""
  SELECT video, target, visible, visible >= 6 AS judged, CASE WHEN visible >= 6 THEN covered >= 6 END AS found,
         CASE WHEN visible >= 6 THEN round(covered / visible, 6) END AS completeness,
         CASE WHEN visible >= 6 AND covered >= 6 THEN h0 - v0 END AS start_delay, CASE WHEN visible >= 6 AND covered >= 6 THEN v1 - h1 END AS end_early,
         CASE WHEN visible >= 6 AND covered >= 6 THEN fragments END AS fragments, CASE WHEN visible >= 6 THEN contrast END AS contrast FROM (
    SELECT s.video, s.target, visible, v0, v1, contrast, coalesce(covered, 0) AS covered, h0, h1, fragments FROM (
      SELECT video, target, count(DISTINCT frame) AS visible, min(frame) AS v0, max(frame) AS v1, quantile_cont(contrast, 0.5) AS contrast FROM {SEEN} a GROUP BY video, target) s
    LEFT JOIN (
      SELECT t.video, t.target, count(DISTINCT t.frame) AS covered, min(t.frame) AS h0, max(t.frame) AS h1, count(DISTINCT p.track) AS fragments
      FROM {SEEN} t JOIN scene_points p ON p.video = t.video AND p.frame = t.frame AND sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) <= 24
      GROUP BY t.video, t.target) h ON s.video = h.video AND s.target = h.target) r"""

STATES = ["done", "already", "too_many", "failed"]
KIND = """CASE WHEN coalesce(lower(trim(verdict)), '') = '' THEN 'todo' WHEN lower(trim(verdict)) IN ('yes', 'y', 'oui', 'o', 'bat', '1') THEN 'yes'
          WHEN lower(trim(verdict)) IN ('no', 'n', 'non', '0') THEN 'no' WHEN lower(trim(verdict)) IN ('doubt', '?', 'maybe', 'doute') THEN 'doubt' ELSE 'other' END"""
GUARD = "SELECT id, motion, found, (CASE WHEN id % 10 = 3 THEN NOT found ELSE found END) AS now FROM results"


def _judged(t):
    r = t("results")
    return r.select("id", "motion", "found"), r.select("id", F.when(F.col("id") % 10 == 3, ~F.col("found")).otherwise(F.col("found")).alias("found"))


def _visible(t):
    """Detections as target points: two sigmas inside, contrast, and outside two regions."""
    points = t("detections").select("det_idx", "x", "y", (F.col("amplitude") - 20).alias("contrast"))
    seen = evaluation.visible(points, F.lit(3.0), 1440, 1080)
    regions = t.spark.createDataFrame([(100.0, 100.0, 300.0, 400.0), (700.0, 0.0, 900.0, 200.0)], "x0 double, y0 double, x1 double, y1 double")
    return evaluation.outside_regions(seen, regions).select("det_idx")


def _short(t):
    free = t.spark.createDataFrame([(0, 1_100_000_000), (1, 900_000_000), (2, 5_000_000_000), (3, 1_000_000_000)], "device long, free long")
    return ledger.short_volumes(t("jobs"), free)


def _drift(t):
    made = lambda f: t("customer").select("c_custkey", f)
    a = made(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("settings"))
    b = made(F.map_filter(F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 5 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")),
                                       F.lit("nation"), F.col("c_nationkey").cast("string")), lambda k, _: (k != "nation") | (F.col("c_custkey") % 7 != 0)).alias("settings"))
    return ledger.settings_drift(a, b, ["c_custkey"])


def _names(t):
    n = F.col("page_id")
    name = (F.when(n % 9 == 0, "params.json").when(n % 9 == 1, F.concat(F.lit("Verdicts ("), n.cast("string"), F.lit(").csv")))
            .when(n % 9 == 2, F.concat(F.lit("track_"), F.lpad(n.cast("string"), 3, "0"), F.lit("_4m05s.mp4"))).when(n % 9 == 3, F.concat(F.lit("."), n.cast("string"), F.lit(".partial")))
            .when(n % 9 == 4, "tracks.csv").when(n % 9 == 5, F.concat(F.lit("v"), n.cast("string"), F.lit("_000m-010m_1_of_2.png")))
            .when(n % 9 == 6, F.concat(F.lit("video_"), n.cast("string"), F.lit(".MP4"))).when(n % 9 == 7, ".hidden").otherwise("notes.txt"))
    return t("pages").select("page_id", name.alias("name"), ledger.output_kind(name).alias("kind"))


# Errors as they come from a run of jobs: the path of kinds and the system's error.
ERRORS = ["detection/input/decode/open", "detection/input/decode/read", "detection/blur", "video", "files/write", "clips/encode", "previous/remove", "too-many-tracks", "progress"]
SYSTEM = ["not-found", "permission-denied", "storage-full", "", "tuned", "sharing-violation"]


def _failures(t):
    pick = lambda values, n: F.array(*map(F.lit, values))[(F.col("job") % n).cast("int")]
    rows = t("jobs").select("job", pick(ERRORS, len(ERRORS)).alias("error"), pick(SYSTEM, len(SYSTEM)).alias("system"))
    return rows.select("*", text.failure_cause(F.col("error"), F.col("system")).alias("cause"), text.error_chain(F.array("error", "system")).alias("chain"))


def _escapes(t):
    name = F.concat(F.col("c_name"), F.lit(" <&\t\"\\ é>"))
    return t("customer").select("c_custkey", text.json_string(name).alias("json"), text.url(name).alias("url"), text.base64(F.encode(name, "UTF-8")).alias("base64"))


def _polygon(t):
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POLYGON))
    return t("detections").select("det_idx", text.in_polygon(F.col("x"), F.col("y"), corners).alias("inside"))


POLYGON = [(100.0, 100.0), (900.0, 200.0), (500.0, 500.0), (1200.0, 900.0), (200.0, 800.0)]
CROSSED = " + ".join(
    f"CASE WHEN ({ay}::DOUBLE > y) <> ({by}::DOUBLE > y) AND x < ({bx}::DOUBLE - {ax}) * (y - {ay}::DOUBLE) / ({by}::DOUBLE - {ay}) + {ax} THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]]))


def _clocks(t):
    s = F.col("o_totalprice") / 40
    n = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey", text.clock_minutes(s).alias("minutes"), text.clock_hundredths(s).alias("hundredths"), text.duration_words(s).alias("words"),
        text.clip_name(n % 200, F.lit(150) + n % 900, s).alias("clip"), text.period_suffix(F.floor(s / 600)).alias("period"),
        text.part_suffix(n % 3 + 1, n % 4).alias("part"), text.hex_colour(n % 256, (n * 7) % 256, (n * 13) % 256).alias("colour"), text.tick_minutes(s).alias("tick"))


def _cells(t):
    v = F.col("c_acctbal") * 0.3713
    return t("customer").select("c_custkey", text.decimal(v, 2).alias("en"), text.decimal(v, 1, ",").alias("fr"), F.round(text.hundredths(v), 2).alias("hundredths"),
                                text.quoted(F.concat(F.lit('a"b'), F.when(F.col("c_custkey") % 2 == 0, ";").otherwise("")), ";").alias("cell"),
                                text.html(F.concat(F.lit("<a href='x'>&"), F.col("c_name"))).alias("html"))


CLOCKS = """
  SELECT o_orderkey, CAST(CAST(floor(s) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS minutes,
         CASE WHEN h // 6000 < 100 THEN lpad(CAST(h // 6000 AS VARCHAR), 2, '0') ELSE CAST(h // 6000 AS VARCHAR) END || ':' || lpad(CAST(h % 6000 // 100 AS VARCHAR), 2, '0')
           || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS hundredths,
         concat_ws(' ', CASE WHEN r // 3600 > 0 THEN CAST(r // 3600 AS VARCHAR) || ' h' END, CASE WHEN r >= 60 THEN CAST(r % 3600 // 60 AS VARCHAR) || ' min' END,
                   CAST(r % 60 AS VARCHAR) || ' s') AS words,
         'track_' || lpad(CAST(o_orderkey % 200 AS VARCHAR), CAST(greatest(2, length(CAST(150 + o_orderkey % 900 AS VARCHAR))) AS INT), '0') || '_'
           || CAST(CAST(floor(s) AS BIGINT) // 60 AS VARCHAR) || 'm' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's.mp4' AS clip,
         '_' || lpad(CAST(CAST(floor(s / 600) AS BIGINT) * 10 AS VARCHAR), 3, '0') || 'm-' || lpad(CAST((CAST(floor(s / 600) AS BIGINT) + 1) * 10 AS VARCHAR), 3, '0') || 'm' AS period,
         CASE WHEN o_orderkey % 4 > 1 THEN '_' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || '_of_' || CAST(o_orderkey % 4 AS VARCHAR) ELSE '' END AS part,
         '#' || printf('%02x%02x%02x', o_orderkey % 256, (o_orderkey * 7) % 256, (o_orderkey * 13) % 256) AS colour,
         CASE WHEN s / 60 <= 10 THEN 1 WHEN s / 120 <= 10 THEN 2 WHEN s / 300 <= 10 THEN 5 ELSE 10 END AS tick
  FROM (SELECT *, o_totalprice / 40 AS s, CAST(round(o_totalprice / 40 * 100) AS BIGINT) AS h, CAST(round(o_totalprice / 40) AS BIGINT) AS r FROM orders) o"""

QUERIES = {
    "b12_visible_points": (_visible, """
        SELECT det_idx FROM detections WHERE x BETWEEN 6 AND 1434 AND y BETWEEN 6 AND 1074 AND abs(amplitude - 20) >= 8
          AND NOT (x BETWEEN 100 AND 300 AND y BETWEEN 100 AND 400) AND NOT (x BETWEEN 700 AND 900 AND y BETWEEN 0 AND 200)"""),
    "b15_row_filter": (lambda t: t("verdicts").filter(ledger.passes(ledger.verdict_kind(F.col("verdict")), "doubt")).select("row_id"), f"SELECT row_id FROM verdicts WHERE {KIND} = 'doubt'"),
    "b17_verdict_words": (lambda t: t("verdicts").select("row_id", ledger.verdict_kind(F.col("verdict")).alias("kind")), f"SELECT row_id, {KIND} AS kind FROM verdicts"),
    "d01_class_grid": (lambda t: t("documents").select("lang").distinct().crossJoin(F.broadcast(t.spark.createDataFrame(
        [(a, s) for a in (10, 20, 40) for s in (1.5, 3.0)], "amplitude long, sigma double"))), """
        SELECT lang, a AS amplitude, s AS sigma FROM (SELECT DISTINCT lang FROM documents) d, (VALUES (10::BIGINT), (20), (40)) v(a), (VALUES (1.5::DOUBLE), (3.0)) w(s)"""),
    "d06_target_faults": (lambda t: t("twin_points").groupBy("track", "frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                          "SELECT track, frame, count(*) AS n FROM twin_points GROUP BY track, frame HAVING count(*) > 1"),
    "g16_target_results": (lambda t: evaluation.target_results(_seen(t), _hits(t), ["video", "target"]), TARGET_RESULTS),
    "g17_evaluation_totals": (lambda t: evaluation.target_results(_seen(t), _hits(t), ["video", "target"]).groupBy("video").agg(
        F.count_if(~F.col("judged")).alias("not_visible"), F.count_if("judged").alias("evaluated"), F.count_if("found").alias("found")), f"""
        SELECT video, count(*) FILTER (WHERE NOT judged) AS not_visible, count(*) FILTER (WHERE judged) AS evaluated, count(*) FILTER (WHERE found) AS found FROM ({TARGET_RESULTS}) r GROUP BY video"""),
    "g18_class_summary": (lambda t: evaluation.class_summary(t("results"), ["motion", "amplitude"]), f"""
        SELECT motion, amplitude, n, found, median_completeness, median_start_delay, median_end_early, mean_fragments, median_contrast,
               {wilson_sql('found', 'n', '-')} AS low, {wilson_sql('found', 'n', '+')} AS high FROM (
          SELECT motion, amplitude, count(*) AS n, count(*) FILTER (WHERE found) AS found, round(quantile_cont(completeness, 0.5), 6) AS median_completeness,
                 round(quantile_cont(CAST(start_delay AS DOUBLE), 0.5) FILTER (WHERE found), 6) AS median_start_delay, round(quantile_cont(CAST(end_early AS DOUBLE), 0.5) FILTER (WHERE found), 6) AS median_end_early,
                 round(avg(fragments) FILTER (WHERE found), 6) AS mean_fragments, round(quantile_cont(contrast, 0.5), 6) AS median_contrast FROM results GROUP BY motion, amplitude) r"""),
    "g19_wilson": (lambda t: t("results").groupBy(F.expr("id % 50").alias("k")).agg(F.count_if("found").alias("found"), F.count(F.lit(1)).alias("n")).select(
        "k", *(F.round(b, 6).alias(c) for b, c in zip(evaluation.wilson(F.col("found").cast("double"), F.col("n").cast("double")), ("low", "high")))), f"""
        SELECT k, {wilson_sql('found', 'n', '-')} AS low, {wilson_sql('found', 'n', '+')} AS high FROM (SELECT id % 50 AS k, count(*) FILTER (WHERE found) AS found, count(*) AS n FROM results GROUP BY id % 50) r"""),
    "g20_guard": (lambda t: evaluation.guarded(*_judged(t), ["motion"]), f"""
        SELECT *, round(found / n, 6) < lowest AS failed FROM (SELECT motion, n, recorded, found, {wilson_sql('recorded', 'n', '-')} AS lowest FROM (
          SELECT motion, count(*) AS n, count(*) FILTER (WHERE found) AS recorded, count(*) FILTER (WHERE now) AS found FROM ({GUARD}) g GROUP BY motion) a) b"""),
    "j23_guard_changes": (lambda t: evaluation.guard_changes(t("results").filter("id % 7 <> 2"), t("results").filter("id % 11 <> 5").select(
        "id", F.when(F.col("id") % 10 == 3, ~F.col("found")).otherwise(F.col("found")).alias("found"))), """
        SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'recorded only' WHEN a.id IS NULL THEN 'judged only'
          WHEN a.found AND NOT b.now THEN 'lost' WHEN NOT a.found AND b.now THEN 'gained' END AS kind
          FROM (SELECT id, found FROM results WHERE id % 7 <> 2) a FULL JOIN (SELECT id, CASE WHEN id % 10 = 3 THEN NOT found ELSE found END AS now FROM results WHERE id % 11 <> 5) b ON a.id = b.id) c
        WHERE kind IS NOT NULL"""),
    "g21_tally": (lambda t: ledger.tally(t("jobs"), ["device"], STATES), "SELECT device, " + ", ".join(
        f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in STATES) + ", bool_and(state <> 'failed') AS all_done FROM jobs GROUP BY device"),
    "g22_verdict_counts": (lambda t: ledger.verdict_counts(t("verdicts"), ["video"]), "SELECT video, " + ", ".join(
        f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("yes", "no", "doubt", "other", "todo")) + f""",
        count(*) FILTER (WHERE kind <> 'todo') AS judged FROM (SELECT video, {KIND} AS kind FROM verdicts) v GROUP BY video"""),
    "g23_short_volumes": (_short, """
        SELECT device, jobs, need, free FROM (SELECT device, count(*) AS jobs, CAST(sum(bytes) + greatest(floor(sum(bytes) * 0.1::DOUBLE), 1000000000) AS BIGINT) AS need FROM jobs GROUP BY device) n
        JOIN (VALUES (0, 1100000000::BIGINT), (1, 900000000), (2, 5000000000), (3, 1000000000)) f(device, free) USING (device) WHERE need > free"""),
    "g25_folder_collisions": (lambda t: ledger.collisions(t("jobs"), F.expr("job div 2")), """
        SELECT folder, string_agg(video, '|' ORDER BY video) AS videos, count(*) AS n FROM (SELECT DISTINCT job // 2 AS folder, video FROM jobs) j GROUP BY folder HAVING count(*) > 1"""),
    "w23_eta": (lambda t: ledger.estimate(t("jobs").select("device", "job", (F.col("bytes") / 1000).alias("spent"), F.expr("bytes div 500").alias("frames"))), """
        SELECT device, job, spent, done, "left", round(spent / done * "left", 4) AS eta FROM (
          SELECT device, job, sum(bytes / 1000) OVER a AS spent, CAST(sum(bytes // 500) OVER a AS BIGINT) AS done, CAST(coalesce(sum(bytes // 500) OVER b, 0) AS BIGINT) AS "left" FROM jobs
          WINDOW a AS (PARTITION BY device ORDER BY job ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY device ORDER BY job ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) j"""),
    "s08_remaining_jobs": (lambda t: ledger.remaining(t("jobs"), t("jobs").filter("job % 3 = 0").select("job", F.when(F.col("job") % 12 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes")), ["bytes"]).select("job"), """
        SELECT job FROM jobs WHERE job % 3 <> 0 OR job % 12 = 0"""),
    "s09_latest_state": (lambda t: ledger.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]), """
        SELECT user_id, ts, event_id, event_type, versions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS versions FROM events) e WHERE rn = 1"""),
    "a10_merged_results": (lambda t: ledger.merged_results(
        t("jobs").filter("job % 4 <> 1").select(F.col("video").alias("name"), (F.col("state") == "done").alias("finished")),
        t("jobs").filter("job % 6 = 1").select(F.col("video").alias("name"), "state").withColumnRenamed("state", "cause")), """
        SELECT coalesce(a.video, b.video) AS name, CASE WHEN finished THEN 'finished' WHEN cause IS NOT NULL THEN 'failed' WHEN finished IS NOT NULL THEN 'unfinished' ELSE 'absent' END AS state, cause
        FROM (SELECT video, state = 'done' AS finished FROM jobs WHERE job % 4 <> 1) a FULL JOIN (SELECT video, state AS cause FROM jobs WHERE job % 6 = 1) b ON a.video = b.video"""),
    "a11_ledger_append": (lambda t: ledger.appended(t("jobs").filter("state = 'failed'").select("job", F.lit("old").alias("cause")), t("jobs").filter("job % 18 = 0").select("job", F.lit("new").alias("cause")), "job"), """
        SELECT job, CASE WHEN job % 18 = 0 THEN 'new' ELSE 'old' END AS cause FROM jobs WHERE state = 'failed' OR job % 18 = 0"""),
    "a12_latest_file": (lambda t: ledger.latest(t("jobs").select("device", "bytes", "video"), ["device"], ["bytes", "video"]), """
        SELECT device, bytes, video, versions FROM (SELECT device, bytes, video, row_number() OVER (PARTITION BY device ORDER BY bytes DESC, video DESC) AS rn, count(*) OVER (PARTITION BY device) AS versions FROM jobs) j WHERE rn = 1"""),
    "a13_folded_headers": (lambda t: t("part").select("p_partkey", ledger.folded_header(F.concat_ws(" (s)-", "p_name", "p_brand")).alias("header")), """
        SELECT p_partkey, regexp_replace(lower(concat_ws(' (s)-', p_name, p_brand)), '[^a-z0-9]', '', 'g') AS header FROM part"""),
    "a22_output_names": (_names, """
        SELECT page_id, name, CASE WHEN name LIKE '.%' THEN CASE WHEN name LIKE '%.partial' THEN 'partial' ELSE 'hidden' END WHEN name = 'params.json' THEN 'params'
          WHEN regexp_matches(name, '(?i)^verdicts.*\\.csv$') THEN 'verdicts' WHEN name = 'tracks.csv' THEN 'table'
          WHEN regexp_matches(name, '^track_[0-9]{2,}_[0-9]+m[0-9]{2}s\\.mp4$') THEN 'clip' WHEN regexp_matches(name, '_[0-9]{3}m-[0-9]{3}m(_[0-9]+_of_[0-9]+)?\\.png$') THEN 'summary'
          WHEN regexp_matches(name, '(?i)\\.(mp4|mov|avi|mkv|m4v)$') THEN 'video' ELSE 'other' END AS kind FROM (
          SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'params.json' WHEN 1 THEN 'Verdicts (' || page_id || ').csv' WHEN 2 THEN 'track_' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '_4m05s.mp4'
            WHEN 3 THEN '.' || page_id || '.partial' WHEN 4 THEN 'tracks.csv' WHEN 5 THEN 'v' || page_id || '_000m-010m_1_of_2.png' WHEN 6 THEN 'video_' || page_id || '.MP4' WHEN 7 THEN '.hidden' ELSE 'notes.txt' END AS name FROM pages) p"""),
    "j25_settings_drift": (_drift, """
        SELECT * FROM (SELECT c_custkey, 'segment' AS name, c_mktsegment AS was, 'NEW' AS now FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'NEW'
        UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 7 = 0) d"""),
    "j27_hit_test": (lambda t: ledger.hit_test(t("scene_points").select(
        (F.col("track") * 10000 + F.col("frame")).alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width") * 6).alias("x1"), (F.col("y") + F.col("height") * 6).alias("y1")), 700.0, 500.0, 60.0), """
        SELECT id, round(sqrt((x0 + t * dx - 700) * (x0 + t * dx - 700) + (y0 + t * dy - 500) * (y0 + t * dy - 500)), 6) AS d FROM (
          SELECT *, greatest(0, least(1, ((700 - x0) * dx + (500 - y0) * dy) / (dx * dx + dy * dy))) AS t FROM (
            SELECT track * 10000 + frame AS id, x AS x0, y AS y0, width * 6 AS dx, height * 6 AS dy FROM scene_points) a) b
        WHERE round(sqrt((x0 + t * dx - 700) * (x0 + t * dx - 700) + (y0 + t * dy - 500) * (y0 + t * dy - 500)), 6) <= 60"""),
    "f01_text_forms": (_clocks, CLOCKS),
    "f06_cells": (_cells, """
        SELECT c_custkey, regexp_replace(printf('%.2f', round(v, 2) + 0.0::DOUBLE), '(\\.[0-9]*?[0-9])0+$', '\\1') AS en,
               replace(printf('%.1f', round(v, 1) + 0.0::DOUBLE), '.', ',') AS fr, round(round(v * 100) / 100, 2) AS hundredths,
               CASE WHEN c_custkey % 2 = 0 THEN '"a""b;"' ELSE '"a""b"' END AS cell, '&lt;a href=&#39;x&#39;&gt;&amp;' || c_name AS html
        FROM (SELECT *, c_acctbal * 0.3713::DOUBLE AS v FROM customer) c"""),
    "f11_escapes": (_escapes, """
        SELECT c_custkey, '"' || c_name || ' \\u003c\\u0026\\u0009\\"\\\\ é\\u003e"' AS json, replace(c_name, '#', '%23') || '%20%3C%26%09%22%5C%20%C3%A9%3E' AS url,
               base64(encode(c_name || ' <&' || chr(9) || '"\\ é>')) AS base64 FROM customer"""),
    "f18_in_polygon": (_polygon, f"SELECT det_idx, ({CROSSED}) % 2 = 1 AS inside FROM detections"),
    "f22_failure_causes": (_failures, f"""
        SELECT *, CASE error
          WHEN 'detection/input/decode/open' THEN CASE system WHEN 'not-found' THEN 'missing' WHEN 'permission-denied' THEN 'read-refused' ELSE 'not-a-video' END
          WHEN 'detection/input/decode/read' THEN 'damaged' WHEN 'detection/blur' THEN CASE system WHEN 'tuned' THEN 'settings' ELSE 'unsupported' END
          WHEN 'video' THEN CASE system WHEN 'not-found' THEN 'missing' WHEN 'permission-denied' THEN 'read-refused' ELSE 'unexpected' END
          WHEN 'files/write' THEN CASE system WHEN 'storage-full' THEN 'disk-full' WHEN 'permission-denied' THEN 'forbidden' ELSE 'unexpected' END
          WHEN 'clips/encode' THEN CASE system WHEN 'storage-full' THEN 'disk-full' WHEN 'permission-denied' THEN 'forbidden' ELSE 'encoding' END
          WHEN 'previous/remove' THEN CASE system WHEN 'storage-full' THEN 'disk-full' WHEN 'permission-denied' THEN 'forbidden' WHEN 'sharing-violation' THEN 'in-use' ELSE 'unexpected' END
          WHEN 'too-many-tracks' THEN 'too-many-tracks' ELSE 'unexpected' END AS cause, error || ': ' || system AS chain
        FROM (SELECT job, ({ERRORS!r})[job % {len(ERRORS)} + 1] AS error, ({SYSTEM!r})[job % {len(SYSTEM)} + 1] AS system FROM jobs) j"""),
    "f15_rationals": (lambda t: t("lineitem").select("l_orderkey", "l_linenumber", text.rational(F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_suppkey") - 3).cast("string"))).alias("r")).select(
        "l_orderkey", "l_linenumber", F.col("r.num").alias("num"), F.col("r.den").alias("den")), """
        SELECT l_orderkey, l_linenumber, CASE WHEN d <> 0 THEN sign(d) * l_partkey // gcd(l_partkey, abs(d)) END AS num, CASE WHEN d <> 0 THEN abs(d) // gcd(l_partkey, abs(d)) END AS den
        FROM (SELECT *, l_suppkey - 3 AS d FROM lineitem) l"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
