"""Domain tables made of the driver's tables; one SQL text per table, for Spark and for DuckDB.

Text between {spark: ...} and {duck: ...} differs between the engines.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations"]

TABLES = {
    # one row per detection; coordinates are multiples of 1/4, so that sums are exact
    "detections": """
        SELECT event_id AS det_idx, user_id % 3 AS video, user_id % 12 AS obj,
               CAST(floor(event_id / 12) AS BIGINT) AS frame,
               CAST(((user_id % 12) * 97 + CAST(floor(event_id / 12) AS BIGINT) * 11) % 1440 AS DOUBLE) + (k % 4) * CAST(0.25 AS DOUBLE) AS x,
               CAST(((user_id % 12) * 53 + CAST(floor(event_id / 12) AS BIGINT) * 5) % 1080 AS DOUBLE) + (k % 3) * CAST(0.25 AS DOUBLE) AS y,
               CAST(1 AS DOUBLE) + (k % 50) * CAST(2.25 AS DOUBLE) AS area, CAST(8 AS DOUBLE) + k * CAST(0.5 AS DOUBLE) AS amplitude,
               CAST(3 + k % 5 AS DOUBLE) AS width, CAST(3 + k % 4 AS DOUBLE) AS height,
               CASE WHEN event_type = 'error' THEN 'weak' ELSE 'strong' END AS strength
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e""",
    # a second run over the same scene
    "candidates": """
        SELECT det_idx, video, frame, x + ((det_idx % 7) - 3) * CAST(0.75 AS DOUBLE) AS x, y, area, amplitude
        FROM detections WHERE det_idx % 11 <> 0""",
    # fifteen copies of some frames' detections
    "crowded": """
        SELECT d.det_idx * 15 + c.copy AS det_idx, video, frame, x, y, area
        FROM detections d JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14)) c(copy)
          ON c.copy = 0 OR d.frame % 101 < 2""",
    "frames": """
        SELECT video, frame, CASE WHEN frame % 50 = 7 THEN NULL ELSE 333 * frame + 999 * CAST(floor(frame / 97) AS BIGINT) END AS pts,
               frame % 15 = 0 AS key_frame, frame % 211 = 17 AS decode_error
        FROM (SELECT video, {spark: explode(sequence(0L, max(frame)))}{duck: unnest(range(0, max(frame) + 1))} AS frame
              FROM detections GROUP BY video) f""",
    # what a container may announce: the second video lacks frames before its first, the third after its last
    "announced": """
        SELECT video, max(frame) + 1 + CASE video WHEN 0 THEN 7 WHEN 2 THEN 4 ELSE 0 END AS announced, CAST(CASE WHEN video = 1 THEN -999 ELSE 0 END AS BIGINT) AS start,
               CAST(CASE WHEN video = 2 THEN 4 ELSE 0 END AS BIGINT) AS after_last, CAST(CASE WHEN video = 1 THEN 3 ELSE 0 END AS BIGINT) AS before_first
        FROM frames GROUP BY video""",
    "spans": """
        SELECT video, frame AS first, frame + det_idx % 7 AS last, det_idx AS span_id FROM detections WHERE det_idx % 5 = 0""",
    # one point per order; frames of a track grow by 1 to 3
    "track_points": """
        SELECT o_custkey AS track, o_custkey % 3 AS video,
               CAST(sum(1 + CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT)
                 + o_custkey % 40 AS frame,
               CAST((o_custkey * 7 + CAST(floor(o_totalprice) AS BIGINT) % 300) % 1440 AS DOUBLE) + (o_orderkey % 4) * CAST(0.25 AS DOUBLE) AS x,
               CAST((o_custkey * 37 + o_orderkey * 3 % 90) % 1080 AS DOUBLE) + (o_orderkey % 3) * CAST(0.25 AS DOUBLE) AS y,
               CAST(3 + o_orderkey % 5 + CASE WHEN o_orderkey % 23 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS width,
               CAST(3 + o_orderkey % 4 AS DOUBLE) AS height,
               CAST(1 AS DOUBLE) + (o_orderkey % 50) * CAST(2.25 AS DOUBLE) AS area,
               CAST(8 AS DOUBLE) + (o_orderkey % 100) * CAST(0.5 AS DOUBLE) AS amplitude,
               CASE WHEN o_orderkey % 7 = 0 THEN 'weak' ELSE 'strong' END AS strength
        FROM orders""",
    # tracks of the scene itself: an object's appearances, cut every 60 frames, one detection per frame
    "scene_points": """
        SELECT video, obj * 100000 + CAST(floor(frame / 60) AS BIGINT) AS track, frame, x, y, area, amplitude, width, height, strength
        FROM (SELECT *, row_number() OVER (PARTITION BY video, obj, frame ORDER BY det_idx) AS rn FROM detections) d WHERE rn = 1""",
    # flights with holes of about 12 frames, or of about 12 and 9 between which a few points are left
    "broken_points": """
        SELECT video, obj * 1000000 + CAST(floor(frame / 60) AS BIGINT) * 10 + CASE WHEN frame % 60 < 24 THEN 0 WHEN frame % 60 < 39 AND obj % 2 = 0 THEN 1 ELSE 2 END AS track, frame, x, y
        FROM (SELECT *, row_number() OVER (PARTITION BY video, obj, frame ORDER BY det_idx) AS rn FROM detections) d
        WHERE rn = 1 AND (frame % 60 < 24 OR frame % 60 >= 36 AND obj % 2 = 1 OR frame % 60 BETWEEN 36 AND 38 OR frame % 60 >= 48)""",
    "ignored": "SELECT video, frame AS first, frame + det_idx % 7 AS last FROM detections WHERE det_idx % 41 = 0",
    "twin_points": """
        SELECT l_orderkey AS track, l_linenumber AS frame, CAST(l_quantity AS DOUBLE) AS area, CAST(floor(l_extendedprice) AS DOUBLE) AS x,
               CAST(l_partkey % 1080 AS DOUBLE) AS y, CAST(3 + l_suppkey % 5 AS DOUBLE) AS width, CAST(3 + l_partkey % 4 AS DOUBLE) AS height,
               CAST(l_partkey % 120 AS DOUBLE) AS amplitude, CASE WHEN l_returnflag = 'R' THEN 'weak' ELSE 'strong' END AS strength
        FROM lineitem""",
    # grey planes of 8 x 8 pixels, one row per frame and pixel
    "planes": """
        SELECT frame, CAST(pixel AS INT) AS pixel, CAST(greatest(0, least(255, floor(128 + 200 * CAST(e AS DOUBLE)))) AS INT) AS value
        FROM (SELECT vec_id AS frame, {spark: posexplode(embedding) AS (pixel, e)}{duck: generate_subscripts(embedding, 1) - 1 AS pixel, unnest(embedding) AS e}
              FROM embeddings) p""",
    "results": """
        SELECT d.doc_id AS id, d.lang AS motion, CAST(l.toxic AS BIGINT) AS amplitude, l.quality = 1 AS found,
               CAST((d.n_chars % 101) AS DOUBLE) / 100 AS completeness, CAST(d.n_chars % 30 AS BIGINT) AS start_delay,
               CAST(d.n_chars % 17 AS BIGINT) AS end_early, 1 + d.n_chars % 3 AS fragments, CAST(8 + d.n_chars % 40 AS DOUBLE) AS contrast
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "jobs": """
        SELECT page_id AS job, page_id % 4 AS device, CAST(length(html) AS BIGINT) * 1000 AS bytes, url AS video,
               CASE WHEN page_id % 9 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'already' WHEN page_id % 7 = 0 THEN 'too_many' ELSE 'done' END AS state
        FROM pages""",
    "verdicts": """
        SELECT det_idx AS row_id, video, CAST(frame AS DOUBLE) / 30 + (det_idx % 5) * CAST(0.05 AS DOUBLE) AS start_s,
               x + det_idx % 3 AS start_x, y AS start_y,
               CASE det_idx % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'Doubt' WHEN 3 THEN '' WHEN 4 THEN 'oui' ELSE 'maybe' END AS verdict
        FROM detections WHERE det_idx % 5 = 0 AND strength = 'strong'""",
}

_PART = re.compile(r"\{(spark|duck): ([^{}]*)\}")


def _text(name: str, engine: str) -> str:
    return _PART.sub(lambda m: m[2] if m[1] == engine else "", TABLES[name])


@cache
def needs(name: str) -> tuple[str, ...]:
    """The domain tables that a table reads, in the order in which they can be made."""
    out: list[str] = []
    for other in TABLES:
        if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", TABLES[name]):
            out += [x for x in (*needs(other), other) if x not in out]
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a domain table of a folder."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _text(name, "spark")
    used = [t for t in (*BASE, *TABLES) if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """A DuckDB query, with the domain tables it reads as common table expressions before its own."""
    used: list[str] = []
    for name in TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql):
            used += [x for x in (*needs(name), name) if x not in used]
    made = ", ".join(f"{n} AS ({_text(n, 'duck')})" for n in used)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body) else ""
    if m := re.match(r"WITH (?:RECURSIVE )?", body):
        return f"WITH {recursive}{made + ', ' if made else ''}{body[m.end():]}"
    return f"WITH {made} {body}" if made else body
