"""Detection as one run, from planes to detections, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.settings import DetectSettings
from trackloom.operators import dense, planes
from trackloom.plans.adapters import oracle

SIZE, FPS = 8, 30.0
SETTINGS = DetectSettings(threshold=9.0, min_area=1.0, max_area=40.0, window_s=0.4, step=2, merge_radius=1.0, work_width=8, noise_factor=1.2, sigma=0.7)
HALF, FLOOR = 6, SETTINGS.threshold * planes.UNITS


def frames_of(t):
    """The planes as frames of one video."""
    return planes.luma_of(t("planes")).select(F.lit(0).cast("bigint").alias("video"), "frame", "luma")


def _mirrored(p: str) -> str:
    return f"(CASE WHEN abs({p}) > {SIZE - 1} THEN {2 * (SIZE - 1)} - abs({p}) ELSE abs({p}) END)"


KERNEL = planes.kernel(SETTINGS.sigma)
TAPS = "(VALUES " + ", ".join(f"({k - len(KERNEL) // 2}, {w})" for k, w in enumerate(KERNEL)) + ")"
DISK = "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in planes.disk(SETTINGS.merge_radius, SIZE, SIZE)) + ")"
#: Detections before bracketing, as table found.
FOUND = f"""
  WITH RECURSIVE grey AS (SELECT frame, pixel, greatest(0, least(255, (value * 4769 - 81520) >> 12)) AS value FROM planes),
  across AS (SELECT p.frame, p.pixel // 8 AS yy, x.x, sum(p.value * k.w) AS v FROM grey p JOIN range(0, 8) x(x) ON true JOIN {TAPS} k(k, w) ON {_mirrored('(x.x + k.k)')} = p.pixel % 8
    GROUP BY p.frame, p.pixel // 8, x.x),
  u AS (SELECT b.frame, CAST(y.y * 8 + b.x AS BIGINT) AS pixel, CAST((sum(b.v * k.w) * 64 + {1 << 23}) // {1 << 24} AS BIGINT) AS value
    FROM across b JOIN range(0, 8) y(y) ON true JOIN {TAPS} k(k, w) ON {_mirrored('(y.y + k.k)')} = b.yy GROUP BY b.frame, y.y, b.x),
  win AS (SELECT frame, unnest(range(greatest(frame - {HALF}, 0), least(frame + {HALF}, last) + 1, {SETTINGS.step})) AS sample FROM (SELECT DISTINCT frame, max(frame) OVER () AS last FROM u) f),
  sums AS (SELECT frame, sum(value) AS total FROM u GROUP BY frame),
  around AS (SELECT w.frame, sum(s.total) AS part, count(*) AS samples FROM win w JOIN sums s ON s.frame = w.sample GROUP BY w.frame),
  gains AS (SELECT w.frame, w.sample, CAST(s.total * a.samples - a.part AS DOUBLE) / (a.samples * 64) AS gain FROM win w JOIN sums s ON s.frame = w.sample JOIN around a ON a.frame = w.frame),
  bg AS (SELECT w.frame, u.pixel, quantile_cont(CAST(u.value AS DOUBLE), 0.5) AS background FROM win w JOIN u ON u.frame = w.sample GROUP BY w.frame, u.pixel),
  near AS (SELECT * FROM (SELECT u.frame, u.pixel, b.background, abs(u.value - b.background - CAST(s.total * a.samples - a.part AS DOUBLE) / (a.samples * 64)) AS m, a.samples
    FROM u JOIN bg b ON b.frame = u.frame AND b.pixel = u.pixel JOIN sums s ON s.frame = u.frame JOIN around a ON a.frame = u.frame) r WHERE m > {0.75 * FLOOR}),
  off AS (SELECT n.frame, n.pixel, u.value - n.background - g.gain AS d FROM near n JOIN gains g ON g.frame = n.frame JOIN u ON u.frame = g.sample AND u.pixel = n.pixel),
  noise AS (SELECT frame, pixel, quantile_cont(abs(d - c), 0.5) AS mad FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY frame, pixel) AS c FROM off) o GROUP BY frame, pixel),
  bars AS (SELECT n.frame, n.pixel, n.m, CASE WHEN samples >= 7 THEN greatest({FLOOR}::DOUBLE, {SETTINGS.noise_factor * 1.4826!r}::DOUBLE * mad) ELSE {FLOOR}::DOUBLE END AS bar
    FROM near n JOIN noise o ON o.frame = n.frame AND o.pixel = n.pixel),
  lit AS (SELECT frame, pixel, m, m > bar AS strong FROM bars WHERE m > 0.75 * bar),
  sets AS (SELECT 0 AS kind, * FROM lit WHERE strong UNION ALL SELECT 1, * FROM lit),
  closed AS (SELECT f.kind, f.frame, CAST(p AS BIGINT) AS pixel FROM (SELECT DISTINCT kind, frame FROM sets) f CROSS JOIN range(0, 64) y(p) WHERE NOT EXISTS (
    SELECT 1 FROM {DISK} o(dx, dy) WHERE p % 8 + dx BETWEEN 0 AND 7 AND p // 8 + dy BETWEEN 0 AND 7 AND NOT EXISTS (
      SELECT 1 FROM {DISK} q(ex, ey) JOIN sets b ON b.kind = f.kind AND b.frame = f.frame AND b.pixel = (p // 8 + dy + ey) * 8 + p % 8 + dx + ex
      WHERE p % 8 + dx + ex BETWEEN 0 AND 7 AND p // 8 + dy + ey BETWEEN 0 AND 7))),
  linked AS (SELECT kind, frame, pixel, pixel AS label FROM closed UNION
    SELECT b.kind, b.frame, b.pixel, r.label FROM linked r JOIN closed b ON b.kind = r.kind AND b.frame = r.frame AND abs(b.pixel % 8 - r.pixel % 8) <= 1 AND abs(b.pixel // 8 - r.pixel // 8) <= 1),
  lab AS (SELECT kind, frame, pixel, min(label) AS label FROM linked GROUP BY kind, frame, pixel),
  blobs AS (SELECT l.kind, l.frame, label, avg(l.pixel % 8) AS x, avg(l.pixel // 8) AS y, min(l.pixel % 8) AS "left", min(l.pixel // 8) AS top, max(l.pixel % 8) - min(l.pixel % 8) + 1 AS width,
    max(l.pixel // 8) - min(l.pixel // 8) + 1 AS height, count(s.m) AS area, max(s.m) / 64 AS amplitude, coalesce(bool_or(s.strong), false) AS strong
    FROM lab l LEFT JOIN sets s ON s.kind = l.kind AND s.frame = l.frame AND s.pixel = l.pixel GROUP BY l.kind, l.frame, label),
  found AS (SELECT CAST(0 AS BIGINT) AS video, frame, (frame << 20) + row_number() OVER (PARTITION BY frame ORDER BY kind, label) - 1 AS det_idx, x, y, "left", top, width, height, area, amplitude,
    CASE WHEN strong THEN 'strong' ELSE 'weak' END AS strength FROM blobs WHERE (kind = 0 OR NOT strong) AND area BETWEEN {SETTINGS.min_area} AND {SETTINGS.max_area})"""
ROUNDED = ("x", "y", "amplitude")
OUT = ("video, frame, det_idx, round(x, 6) AS x, round(y, 6) AS y, " + ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in ("left", "top", "width", "height", "area"))
       + ", round(amplitude, 6) AS amplitude, strength")


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in df.columns))


QUERIES = {
    "p08_found_detections": (lambda t: _rounded(dense.found(frames_of(t), SIZE, SIZE, FPS, SETTINGS)), f"{FOUND} SELECT {OUT} FROM found"),
    "s03_detected": (lambda t: _rounded(dense.detected(frames_of(t), SIZE, SIZE, FPS, SETTINGS, apart=3.0, off=1.5, close=1.0)), f"""{FOUND}
        SELECT {OUT} FROM found w WHERE strength = 'strong' OR (
          EXISTS (SELECT 1 FROM found a JOIN found b ON a.strength = 'strong' AND b.strength = 'strong'
            WHERE a.frame BETWEEN w.frame - 3 AND w.frame - 1 AND b.frame BETWEEN w.frame + 1 AND w.frame + 3
            AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) >= 3
            AND sqrt(pow(w.x - (a.x + (b.x - a.x) * ((w.frame - a.frame) / (b.frame - a.frame))), 2) + pow(w.y - (a.y + (b.y - a.y) * ((w.frame - a.frame) / (b.frame - a.frame))), 2)) <= 1.5)
          AND NOT EXISTS (SELECT 1 FROM found c WHERE c.frame = w.frame AND c.strength = 'strong' AND sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)) <= 1))"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
