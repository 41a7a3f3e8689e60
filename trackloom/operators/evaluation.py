"""Recall and precision of a run against known targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96
#: Regions that are broadcast; more are refused.
MOST_REGIONS = 1000


def wilson(found: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of found among n, clamped to 0 and 1; 0 and 0 for n = 0."""
    p, z2 = found / n, Z * Z
    middle = p + z2 / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z2 / n))))
    return bound(middle - half), bound(middle + half)


def visible(points: DataFrame, sigma: Column, width: float, height: float, least: float = 8.0) -> DataFrame:
    """Points of targets that can be seen: two sigmas inside the border, with enough contrast (x, y, contrast)."""
    margin = 2 * sigma
    inside = F.col("x").between(margin, width - margin) & F.col("y").between(margin, height - margin)
    return points.filter(inside & (F.abs("contrast") >= least))


def outside_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points in no region (x0, y0, x1, y1); regions are settings, at most MOST_REGIONS, and as such broadcast."""
    if regions.limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions")
    hit = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.join(F.broadcast(regions), hit, "left_anti")


def target_results(targets: DataFrame, hits: DataFrame, keys: list[str], min_hits: int = 6) -> DataFrame:
    """Per target its visible frames and what was found of them.

    targets: keys, frame, contrast (visible points); hits: keys, frame, track (matched points).  Fewer
    than min_hits visible frames make a target not visible, and all its figures null.
    """
    seen = targets.groupBy(*keys).agg(F.countDistinct("frame").alias("visible"), F.min("frame").alias("v0"), F.max("frame").alias("v1"),
                                      F.percentile("contrast", F.lit(0.5)).alias("contrast"))
    matched = hits.join(targets.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi")
    met = matched.groupBy(*keys).agg(F.countDistinct("frame").alias("covered"), F.min("frame").alias("h0"), F.max("frame").alias("h1"),
                                     F.countDistinct("track").alias("fragments"))
    rows = seen.join(met, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    judged = F.col("visible") >= min_hits
    found = judged & (F.col("covered") >= min_hits)
    return rows.select(*keys, "visible", judged.alias("judged"), F.when(judged, F.col("covered") >= min_hits).alias("found"),
                       F.when(judged, F.round(F.col("covered") / F.col("visible"), 6)).alias("completeness"),
                       F.when(found, F.col("h0") - F.col("v0")).alias("start_delay"), F.when(found, F.col("v1") - F.col("h1")).alias("end_early"),
                       F.when(found, F.col("fragments")).alias("fragments"), F.when(judged, F.col("contrast")).alias("contrast"))


def totals(results: DataFrame, tracks: DataFrame, assigned: DataFrame, shares: DataFrame, reference: DataFrame) -> DataFrame:
    """Per video: targets not visible, evaluated and found, injected and reference tracks, and false tracks: those
    that no target has and that do not match the reference.

    results: target_results by video; tracks and reference: video, track; assigned: video, track; shares: video,
    track, matches.  A video that any of the tables names has a row.
    """
    judged = results.groupBy("video").agg(F.count_if(~F.col("judged")).alias("not_visible"), F.count_if("judged").alias("evaluated"), F.count_if("found").alias("found"))
    false = tracks.join(assigned.select("video", "track"), ["video", "track"], "left_anti").join(
        shares.filter("matches").select("video", "track"), ["video", "track"], "left_anti")
    count = lambda rows, name: rows.groupBy("video").agg(F.countDistinct("track").alias(name))
    out = judged
    for rows, name in ((tracks, "injected_tracks"), (reference, "reference_tracks"), (false, "false_tracks")):
        out = out.join(count(rows, name), "video", "full_outer")
    return out.select("video", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("not_visible", "evaluated", "found", "injected_tracks", "reference_tracks", "false_tracks")))


def class_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per class: n, found, its Wilson interval, medians over all and over the found ones (null if none)."""
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 6)
    hit = lambda c: F.when(F.col("found"), F.col(c))
    rows = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"), median(F.col("completeness")).alias("median_completeness"),
        median(hit("start_delay")).alias("median_start_delay"), median(hit("end_early")).alias("median_end_early"),
        F.round(F.avg(hit("fragments")), 6).alias("mean_fragments"), median(F.col("contrast")).alias("median_contrast"))
    low, high = wilson(F.col("found").cast("double"), F.col("n").cast("double"))
    return rows.select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def guarded(recorded: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per class of the targets judged on both sides: found then and now, and whether now lies below the
    lower Wilson bound of then.  Both tables: id, keys, found."""
    both = recorded.join(judged.select("id", F.col("found").alias("now")), "id")
    rows = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("recorded"), F.count_if("now").alias("found"))
    low, _ = wilson(F.col("recorded").cast("double"), F.col("n").cast("double"))
    return rows.withColumn("lowest", F.round(low, 6)).select("*", (F.round(F.col("found") / F.col("n"), 6) < F.col("lowest")).alias("failed"))


def guard_changes(recorded: DataFrame, judged: DataFrame) -> DataFrame:
    """Targets lost or gained between two runs, or judged in one of them only."""
    both = recorded.select("id", F.col("found").alias("was")).join(judged.select("id", F.col("found").alias("now")), "id", "full_outer")
    kind = (F.when(F.col("now").isNull(), "recorded only").when(F.col("was").isNull(), "judged only")
            .when(F.col("was") & ~F.col("now"), "lost").when(~F.col("was") & F.col("now"), "gained"))
    return both.select("id", kind.alias("kind")).filter("kind IS NOT NULL")
