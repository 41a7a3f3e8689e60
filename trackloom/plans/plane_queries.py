"""Queries over pixel planes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import dense, planes
from trackloom.plans.adapters import oracle

HALF, STEP, FLOOR, FACTOR, WIDTH, HEIGHT, SIGMA = 6, 3, 60.0, 1.2, 8, 8, 0.8

WINDOWS = f"""SELECT frame, unnest(range(greatest(frame - {HALF}, 0), least(frame + {HALF}, last) + 1, {STEP})) AS sample
  FROM (SELECT DISTINCT frame, max(frame) OVER () AS last FROM planes) f"""
BACKGROUND = f"SELECT w.frame, p.pixel, quantile_cont(CAST(p.value AS DOUBLE), 0.5) AS background FROM ({WINDOWS}) w JOIN planes p ON p.frame = w.sample GROUP BY w.frame, p.pixel"
SUMS = "SELECT frame, sum(value) AS total, count(*) AS pixels FROM planes GROUP BY frame"
GAIN = f"""SELECT s.frame, CAST(s.total * w.samples - w.part AS DOUBLE) / (w.samples * s.pixels) AS gain FROM ({SUMS}) s JOIN (
  SELECT w.frame, sum(t.total) AS part, count(*) AS samples FROM ({WINDOWS}) w JOIN ({SUMS}) t ON t.frame = w.sample GROUP BY w.frame) w ON s.frame = w.frame"""
CHAIN = f"win AS ({WINDOWS}), bg AS ({BACKGROUND}), gain AS ({GAIN})"
RESIDUAL = "SELECT p.frame, p.pixel, p.value, b.background, g.gain, p.value - b.background - g.gain AS residual FROM planes p JOIN bg b ON b.frame = p.frame AND b.pixel = p.pixel JOIN gain g ON g.frame = p.frame"
NEAR = f"SELECT * FROM ({RESIDUAL}) r WHERE abs(residual) > {0.75 * FLOOR}"
AROUND = f"SELECT w.frame, sum(t.total) AS part, count(*) AS samples, any_value(t.pixels) AS pixels FROM ({WINDOWS}) w JOIN ({SUMS}) t ON t.frame = w.sample GROUP BY w.frame"
BARS = f"""SELECT frame, pixel, CASE WHEN count(*) >= 4 THEN greatest({FLOOR}::DOUBLE, {FACTOR * 1.4826!r}::DOUBLE * quantile_cont(abs(d - m), 0.5)) ELSE {FLOOR}::DOUBLE END AS bar FROM (
  SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY frame, pixel) AS m FROM (
    SELECT n.frame, n.pixel, p.value - n.background - CAST(t.total * a.samples - a.part AS DOUBLE) / (a.samples * a.pixels) AS d
    FROM ({NEAR}) n JOIN win w ON w.frame = n.frame JOIN planes p ON p.frame = w.sample AND p.pixel = n.pixel JOIN ({SUMS}) t ON t.frame = w.sample JOIN ({AROUND}) a ON a.frame = n.frame) a) b
  GROUP BY frame, pixel"""
BRIGHT = "SELECT frame, CAST(pixel AS BIGINT) AS pixel FROM planes WHERE value > 150"
DISK = ", ".join(f"({dx}, {dy})" for dx, dy in planes.disk(1.5, WIDTH, HEIGHT))
CLOSED = f"""
  SELECT m.frame, y.p AS pixel FROM (SELECT DISTINCT frame FROM bright) m CROSS JOIN range(0, 64) y(p) WHERE NOT EXISTS (
    SELECT 1 FROM (VALUES {DISK}) o(dx, dy) WHERE p % 8 + dx BETWEEN 0 AND 7 AND p // 8 + dy BETWEEN 0 AND 7 AND NOT EXISTS (
      SELECT 1 FROM (VALUES {DISK}) q(ex, ey) JOIN bright b ON b.frame = m.frame AND b.pixel = (p // 8 + dy + ey) * 8 + p % 8 + dx + ex
      WHERE p % 8 + dx + ex BETWEEN 0 AND 7 AND p // 8 + dy + ey BETWEEN 0 AND 7))"""
COMPONENTS = """
  WITH RECURSIVE bright AS (SELECT frame, CAST(pixel AS BIGINT) AS pixel FROM planes WHERE value > 150),
  r AS (SELECT frame, pixel, pixel AS label FROM bright UNION
        SELECT b.frame, b.pixel, r.label FROM r JOIN bright b ON b.frame = r.frame AND abs(b.pixel % 8 - r.pixel % 8) <= 1 AND abs(b.pixel // 8 - r.pixel // 8) <= 1),
  lab AS (SELECT frame, pixel, min(label) AS label FROM r GROUP BY frame, pixel)"""


def _weights_sql(source: int, work: int) -> str:
    return "(VALUES " + ", ".join(f"({s}, {w}, {a})" for s, w, a in planes.axis_weights(source, work)) + ")"


def _reflect_sql(p: str, n: int) -> str:
    return f"(CASE WHEN abs({p}) > {n - 1} THEN {2 * (n - 1)} - abs({p}) ELSE abs({p}) END)"


KERNEL = planes.kernel(SIGMA)
TAPS = "(VALUES " + ", ".join(f"({k - len(KERNEL) // 2}, {w})" for k, w in enumerate(KERNEL)) + ")"


def _windows(t):
    return planes.sampled(t("planes").select("frame").distinct(), HALF, STEP)


def _near(t, factor: float):
    return dense.near(dense.packed(t("planes")), HALF, STEP, FLOOR, factor, WIDTH * HEIGHT, least=4).withColumn("pixel", F.col("pixel").cast("int"))


def _bright(t):
    return t("planes").filter("value > 150").select("frame", F.col("pixel").cast("long").alias("pixel"))


def _spots(t):
    return t("planes").select("frame").distinct().filter("frame % 5 = 0").select(
        "frame", (F.col("frame") % 7 + 0.5).alias("cx"), (F.col("frame") % 5 + 1.25).alias("cy"), F.lit(40.0).alias("amplitude"), F.lit(1.5).alias("sigma"))


def _regions(t):
    low, high = planes.region_pixels(F.col("l_discount"), F.col("l_discount") + F.col("l_tax"), 960, 2)
    return t("lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


def _mask(t):
    spans = t.spark.createDataFrame([(0, 0, 3), (4, 2, 8)], "row long, first long, last long")
    return planes.masked(t("planes"), spans, WIDTH).groupBy("frame").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("pixels"))


QUERIES = {
    "b01_grey": (lambda t: t("planes").select("frame", "pixel", planes.grey(F.col("value")).alias("grey")), """
        SELECT frame, pixel, greatest(0, least(255, (value * 4769 - 81520) >> 12)) AS grey FROM planes"""),
    "b02_source_scale": (lambda t: t("detections").select("det_idx", *(F.round(planes.to_source(F.col(c), 1.5, k), 6).alias(c) for c, k in (("x", "coordinate"), ("width", "length"), ("area", "area")))), """
        SELECT det_idx, round((x + 0.5) * 1.5 - 0.5, 6) AS x, round(width * 1.5, 6) AS width, round(area * 2.25, 6) AS area FROM detections"""),
    "b04_area_filter": (lambda t: t("detections").filter("area BETWEEN 4 AND 75").select("det_idx", "area"), "SELECT det_idx, area FROM detections WHERE area BETWEEN 4 AND 75"),
    "b05_masked_sums": (_mask, """
        SELECT frame, CAST(sum(value) AS BIGINT) AS total, count(*) AS pixels FROM planes
        WHERE NOT (pixel // 8 = 0 AND pixel % 8 < 3) AND NOT (pixel // 8 = 4 AND pixel % 8 >= 2) GROUP BY frame"""),
    "b07_region_pixels": (_regions, """
        SELECT l_orderkey, l_linenumber, CAST(greatest(0, floor(l_discount * 960) - 2) AS BIGINT) AS low, CAST(least(960, ceil((l_discount + l_tax) * 960) + 2) AS BIGINT) AS high FROM lineitem"""),
    "b13_proximity": (lambda t: t("scene_points").filter(F.sqrt((F.col("x") - 700) * (F.col("x") - 700) + (F.col("y") - 500) * (F.col("y") - 500)) <= 200).select("track", "frame"), """
        SELECT track, frame FROM scene_points WHERE sqrt((x - 700) * (x - 700) + (y - 500) * (y - 500)) <= 200"""),
    "p01_area_reduce": (lambda t: planes.reduced(t("planes"), 8, 8, 5, 3), f"""
        SELECT frame, CAST(wy * 5 + wx AS BIGINT) AS pixel, CAST((sum(value * ax * ay) + 32) // 64 AS BIGINT) AS value FROM planes
        JOIN {_weights_sql(8, 5)} a(sx, wx, ax) ON sx = pixel % 8 JOIN {_weights_sql(8, 3)} b(sy, wy, ay) ON sy = pixel // 8 GROUP BY frame, wy, wx"""),
    "p03_blur": (lambda t: planes.blurred(t("planes"), WIDTH, HEIGHT, SIGMA), f"""
        SELECT b.frame, y.y * 8 + b.x AS pixel, CAST((sum(b.v * k.w) * 64 + {1 << 23}) // {1 << 24} AS BIGINT) AS units FROM (
          SELECT p.frame, p.pixel // 8 AS yy, x.x, sum(p.value * k.w) AS v FROM planes p JOIN range(0, 8) x(x) ON true JOIN {TAPS} k(k, w) ON {_reflect_sql('(x.x + k.k)', 8)} = p.pixel % 8
          GROUP BY p.frame, p.pixel // 8, x.x) b JOIN range(0, 8) y(y) ON true JOIN {TAPS} k(k, w) ON {_reflect_sql('(y.y + k.k)', 8)} = b.yy GROUP BY b.frame, y.y, b.x"""),
    "w01_window_samples": (_windows, WINDOWS),
    "w03_background_median": (lambda t: dense.backgrounds(dense.packed(t("planes")), HALF, STEP).select("frame", F.col("pixel").cast("int").alias("pixel"), "background"), BACKGROUND),
    "w04_noise_bar": (lambda t: _near(t, FACTOR).select("frame", "pixel", F.round("bar", 4).alias("bar")), f"WITH {CHAIN} SELECT frame, pixel, round(bar, 4) AS bar FROM ({BARS}) b"),
    "w05_gain": (lambda t: planes.gains(t("planes"), _windows(t)).select("frame", F.round("gain", 6).alias("gain")), f"SELECT frame, round(gain, 6) AS gain FROM ({GAIN}) g"),
    "b08_lit_pixels": (lambda t: dense.lit(_near(t, 0.0)).select("frame", "pixel", F.round("magnitude", 6).alias("amplitude"), "strong"), f"""
        WITH {CHAIN} SELECT frame, pixel, round(abs(residual), 6) AS amplitude, abs(residual) > {FLOOR} AS strong FROM ({NEAR}) n"""),
    "p05_closing": (lambda t: planes.closed(_bright(t), WIDTH, HEIGHT, 1.5), f"WITH bright AS ({BRIGHT}) {CLOSED}"),
    "p06_components": (lambda t: planes.labelled(_bright(t), WIDTH), COMPONENTS + " SELECT frame, pixel, label FROM lab"),
    "p07_blob_measures": (lambda t: planes.blobs(planes.labelled(_bright(t), WIDTH), t("planes").filter("value > 160").select(
        "frame", F.col("pixel").cast("long").alias("pixel"), F.col("value").alias("amplitude"), (F.col("value") > 170).alias("strong")), WIDTH), COMPONENTS + """
        SELECT l.frame, label, round(avg(l.pixel % 8), 6) AS x, round(avg(l.pixel // 8), 6) AS y, min(l.pixel % 8) AS "left", min(l.pixel // 8) AS top,
               max(l.pixel % 8) - min(l.pixel % 8) + 1 AS width, max(l.pixel // 8) - min(l.pixel // 8) + 1 AS height, count(*) FILTER (WHERE value > 160) AS area,
               max(value) FILTER (WHERE value > 160) AS amplitude, CASE WHEN bool_or(value > 170) THEN 'strong' ELSE 'weak' END AS strength
        FROM lab l JOIN planes p ON p.frame = l.frame AND p.pixel = l.pixel GROUP BY l.frame, label"""),
    "p08_weak_components": (lambda t: planes.blobs(planes.labelled(_bright(t), WIDTH), t("planes").filter("value > 150").select(
        "frame", F.col("pixel").cast("long").alias("pixel"), F.col("value").alias("amplitude"), (F.col("value") > 165).alias("strong")), WIDTH).filter("strength = 'weak'").select("frame", "label", "area"), COMPONENTS + """
        SELECT l.frame, label, count(*) AS area FROM lab l JOIN planes p ON p.frame = l.frame AND p.pixel = l.pixel GROUP BY l.frame, label HAVING NOT bool_or(value > 165)"""),
    "p09_scene_median": (lambda t: planes.scene(t("planes")), """
        WITH f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM planes) a)
        SELECT pixel, CAST(ceil(quantile_cont(CAST(value AS DOUBLE), 0.5)) AS INT) AS value FROM planes JOIN f USING (frame)
        WHERE rank IN (SELECT (2 * i + 1) * n // 50 FROM range(0, 25) r(i)) GROUP BY pixel"""),
    "p11_fnv32": (lambda t: t("nation").select("n_nationkey", planes.fnv32(F.col("n_name")).alias("hash")), """
        WITH RECURSIVE b AS (SELECT n_nationkey, hex(encode(n_name)) AS h FROM nation),
        r AS (SELECT n_nationkey, h, 0 AS i, CAST(2166136261 AS BIGINT) AS hash FROM b UNION ALL
              SELECT n_nationkey, h, i + 1, CAST((CAST(xor(hash, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM r WHERE 2 * i < length(h))
        SELECT n_nationkey, hash FROM r WHERE 2 * i = length(h)"""),
    "p13_spot_injection": (lambda t: planes.spot(t("planes"), _spots(t), WIDTH), """
        SELECT frame, pixel, CAST(greatest(0, least(255, value + CASE WHEN frame % 5 = 0 THEN CAST(floor(round(40 * exp(-((pixel % 8 - frame % 7 - 0.5) * (pixel % 8 - frame % 7 - 0.5)
               + (pixel // 8 - frame % 5 - 1.25) * (pixel // 8 - frame % 5 - 1.25)) / 4.5::DOUBLE), 9)) AS INT) ELSE 0 END)) AS INT) AS value FROM planes"""),
}

ORACLES = {k: oracle(sql) for k, (_, sql) in QUERIES.items()}
