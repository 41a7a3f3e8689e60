"""Band joins on a grid and deterministic greedy one-to-one matching."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut, dropped
from trackloom.operators.intervals import inside


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def in_cells(b: DataFrame, radius: float, cells: int) -> DataFrame:
    """b (with bx, by), one row for each cell (cx, cy) that it may meet rows in; see near_pairs."""
    # a little more than the radius, so that rounding leaves no cell out
    size, reach = radius * cells, radius * (1 + 1e-6)
    ends = lambda c: (_cell(c, size) - 1, _cell(c, size) + 1) if cells == 1 else (_cell(c - reach, size), _cell(c + reach, size))
    across = b.select("*", F.explode(F.sequence(*ends(F.col("bx")))).alias("cx"))
    return across.select("*", F.explode(F.sequence(*ends(F.col("by")))).alias("cy"))


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], radius: float, strict: bool = False, cells: int = 1) -> DataFrame:
    """Pairs of rows of equal keys within radius of each other (below it if strict), with their distance d.

    a has a_id, ax, ay and b has b_id, bx, by beside the keys.  Cells of so many radii make the join an
    equi-join: a goes to its own cell, b to its own and the eight around, or, of more radii, to those that it
    reaches: 2.25 cells on the average of 4 radii.  Larger cells shuffle less and compare more, which suits keys of few rows.
    """
    size = radius * cells
    held = a.withColumn("cx", _cell(F.col("ax"), size)).withColumn("cy", _cell(F.col("ay"), size))
    around = in_cells(b, radius, cells)
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = held.join(around, [*keys, "cx", "cy"]).drop("cx", "cy").withColumn("d", F.sqrt(dx * dx + dy * dy))
    return met.filter(F.col("d") < radius if strict else F.col("d") <= radius)


def greedy(pairs: DataFrame, keys: list[str], order: list[str], left: str, right: str) -> DataFrame:
    """Of candidate pairs per key, in order, each that finds both its sides free.

    The order must be total.  A fold over the sorted candidates of a key, in the JVM; its cost is the
    number of candidates times the number of matches, so keys should be fine (video and frame).
    """
    fields = [*order, *(c for c in (left, right) if c not in order)]
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    kinds = dict(pairs.dtypes)
    row = ",".join(f"{c}:{kinds[c]}" for c in fields)
    start = F.struct(F.array().cast(f"array<{kinds[left]}>").alias("l"), F.array().cast(f"array<{kinds[right]}>").alias("r"),
                     F.array().cast(f"array<struct<{row}>>").alias("out"))
    fold = F.aggregate("candidates", start, lambda acc, x: F.when(
        F.array_contains(acc["l"], x[left]) | F.array_contains(acc["r"], x[right]), acc).otherwise(F.struct(
            F.array_append(acc["l"], x[left]).alias("l"), F.array_append(acc["r"], x[right]).alias("r"),
            F.array_append(acc["out"], x).alias("out"))), lambda acc: acc["out"])
    return grouped.select(*keys, F.explode(fold).alias("m")).select(*keys, "m.*")


#: Candidates that are left for a fold by key, when the rounds of greedy_rounds have taken the rest.
FEW = 100_000


def greedy_rounds(pairs: DataFrame, keys: list[str], order: list[str], left: str, right: str) -> DataFrame:
    """The pairs that greedy takes, for keys of any size.

    In each round every pair that is the first one at both its ends is taken, and the other pairs of these ends
    drop out: the sequential order would take it too, since none before it shares an end.  A round is two grouped
    minima, combined before they are dealt, and anti-joins on the ends.  When at most FEW candidates are left,
    they are folded by key.
    """
    fields = [*order, *(c for c in (left, right) if c not in order)]
    rank = F.min(F.struct(*dict.fromkeys([*order, left, right])))
    every = rest = cut(pairs.select(*keys, *fields))
    taken = None
    while rest.limit(FEW + 1).count() > FEW:
        of_left = rest.groupBy(*keys, left).agg(rank.alias("first")).select(*keys, left, F.col(f"first.{right}").alias(right))
        of_right = rest.groupBy(*keys, right).agg(rank.alias("first")).select(*keys, F.col(f"first.{left}").alias(left), right)
        now = cut(of_left.join(of_right, [*keys, left, right]))
        after = cut(rest.join(now.select(*keys, left), [*keys, left], "left_anti").join(now.select(*keys, right), [*keys, right], "left_anti").select(rest.columns))
        if rest is not every:
            dropped(rest)
        rest, taken = after, now if taken is None else taken.unionByName(now)
    by, schema = [(c, "ascending") for c in dict.fromkeys([*order, left, right])], rest.schema

    def fold(table):
        table = table.sort_by(by)
        free, ends = [], (set(), set())
        for a, b in zip(table.column(left).to_pylist(), table.column(right).to_pylist()):
            free.append(a not in ends[0] and b not in ends[1])
            if free[-1]:
                ends[0].add(a)
                ends[1].add(b)
        return table.filter(pa.array(free, pa.bool_()))

    folded = rest.groupBy(*keys).applyInArrow(fold, schema)
    return folded if taken is None else every.join(taken, [*keys, left, right], "left_semi").select(rest.columns).unionByName(folded)


def nearest(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """For each row of a (see near_pairs) the nearest row of b within the radius, of equally near ones that of the least
    id: keys, a_id, b_id, d; rows without one are left out."""
    return near_pairs(a, b, keys, radius).groupBy(*keys, "a_id").agg(F.min(F.struct("d", "b_id")).alias("one")).select(*keys, "a_id", "one.b_id", "one.d")


def matched_detections(reference: DataFrame, current: DataFrame, bound: float = 3.0) -> DataFrame:
    """Per video and frame the greedy matches below the bound: video, frame, a_id, b_id, d.

    Both tables: video, frame, det_idx, x, y.  Ties of distance go by the index of the reference, then of the other.
    """
    a = reference.select("video", "frame", F.col("det_idx").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = current.select("video", "frame", F.col("det_idx").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return greedy(near_pairs(a, b, ["video", "frame"], bound, strict=True), ["video", "frame"], ["d", "a_id", "b_id"], "a_id", "b_id")


def residue(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Rows without a match."""
    return rows.join(matches.select("video", "frame", F.col(side).alias("det_idx")), ["video", "frame", "det_idx"], "left_anti")


def matched_tracks(a: DataFrame, b: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Greedy matches of tracks whose starts differ by at most so many frames, by the gap of starts, of
    points, and the names.  Both tables: keys, track, start, points."""
    left = a.select(*keys, F.col("track").alias("a_id"), F.col("start").alias("a_start"), F.col("points").alias("a_points"))
    right = b.select(*keys, F.col("track").alias("b_id"), F.col("start").alias("b_start"), F.col("points").alias("b_points"),
                     F.explode(F.sequence(F.expr(f"(start - {most}) div {most + 1} - 1"), F.expr(f"(start + {most}) div {most + 1}"))).alias("cell"))
    met = left.withColumn("cell", F.expr(f"a_start div {most + 1}")).join(right, [*keys, "cell"]).withColumn(
        "start_gap", F.abs(F.col("a_start") - F.col("b_start"))).filter(F.col("start_gap") <= most).withColumn(
        "points_gap", F.abs(F.col("a_points") - F.col("b_points")))
    return greedy_rounds(met, keys, ["start_gap", "points_gap", "a_id", "b_id"], "a_id", "b_id")


def discrepancies(a: DataFrame, b: DataFrame, matches: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """What two lists of tracks differ in: missed, extra, or matched with points too many apart."""
    def alone(rows: DataFrame, side: str, kind: str) -> DataFrame:
        return rows.join(matches.select(*keys, F.col(side).alias("track")), [*keys, "track"], "left_anti").select(
            *keys, F.lit(kind).alias("kind"), "track", F.col("start").alias("frame"))

    apart = matches.filter(F.col("points_gap") > most).select(*keys, F.col("a_id").alias("track")).join(
        a.select(*keys, "track", "start"), [*keys, "track"]).select(*keys, F.lit("points").alias("kind"), "track", F.col("start").alias("frame"))
    return alone(a, "a_id", "missed").unionByName(alone(b, "b_id", "extra")).unionByName(apart)


def bracketed(detections: DataFrame, frames: int = 3, step: float = 60.0, apart: float = 20.0, off: float = 10.0, close: float = 12.0) -> DataFrame:
    """Strong detections, and weak ones that strong ones bracket.

    A weak one stays if there are a strong one at most so many frames before it and one after, each
    within `step` pixels per frame of it and at least `apart` from one another, such that it lies at most
    `off` from the point that divides their line in proportion of frames; and if no strong one of its own
    frame lies within `close`.
    """
    strong = detections.filter("strength = 'strong'").select("video", "frame", "x", "y")
    weak = detections.filter("strength = 'weak'").select("video", "frame", "det_idx", "x", "y")

    def beside(sign: int, name: str) -> DataFrame:
        reach = weak.select("video", "det_idx", "frame", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(frames))).alias("gap"))
        there = strong.select("video", F.col("frame").alias("at"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        met = reach.withColumn("at", F.col("frame") + sign * F.col("gap")).join(there, ["video", "at"])
        dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
        return met.filter(F.sqrt(dx * dx + dy * dy) <= step * F.col("gap")).select(
            "video", "det_idx", "x", "y", F.col("gap").alias(f"{name}_gap"), F.col("sx").alias(f"{name}_x"), F.col("sy").alias(f"{name}_y"))

    pairs = beside(-1, "a").join(beside(1, "b").drop("x", "y"), ["video", "det_idx"])
    far = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2) >= apart
    share = F.col("a_gap") / (F.col("a_gap") + F.col("b_gap"))
    px, py = (F.col("x") - (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * share) if c == "x" else
              F.col("y") - (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * share) for c in "xy")
    good = pairs.filter(far & (F.sqrt(px * px + py * py) <= off)).select("video", "det_idx").distinct()
    crowd = weak.join(strong.select("video", "frame", F.col("x").alias("sx"), F.col("y").alias("sy")), ["video", "frame"]).filter(
        F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2) <= close).select("video", "det_idx").distinct()
    chosen = good.join(crowd, ["video", "det_idx"], "left_anti")
    kept = detections.filter("strength = 'weak'").join(chosen, ["video", "det_idx"], "left_semi")
    return detections.filter("strength = 'strong'").unionByName(kept.select(*detections.columns))


def twins(points: DataFrame, bound: float = 36.0) -> DataFrame:
    """Pairs of tracks of a video that share a frame and are within the bound on every frame they share."""
    a = points.select("video", "frame", F.col("track").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select("video", "frame", F.col("track").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near_pairs(a, b, ["video", "frame"], bound).filter("a_id < b_id").groupBy("video", "a_id", "b_id").agg(F.count(F.lit(1)).alias("near"))
    # only pairs that are near once can be near always: shared frames are counted for these
    left = near.select("video", "a_id", "b_id", "near").join(points.select("video", F.col("track").alias("a_id"), "frame"), ["video", "a_id"])
    shared = left.join(points.select("video", F.col("track").alias("b_id"), "frame"), ["video", "b_id", "frame"]).groupBy(
        "video", "a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"), F.first("near").alias("near"))
    return shared.filter("shared = near").select("video", "a_id", "b_id", "shared")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (a_id, b_id): node, root (the least node); labels take the least of
    their neighbours' and of the label they name until nothing changes."""
    both = pairs.select(F.col("a_id").alias("node"), F.col("b_id").alias("next")).unionByName(
        pairs.select(F.col("b_id").alias("node"), F.col("a_id").alias("next"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("root")))
    while True:
        sent = both.join(labels, "node").select(F.col("next").alias("node"), "root").unionByName(labels)
        near = sent.groupBy("node").agg(F.min("root").alias("near"))
        beyond = labels.select(F.col("node").alias("near"), F.col("root").alias("beyond"))
        new = cut(near.join(beyond, "near", "left").select("node", F.least("near", F.coalesce("beyond", "near")).alias("root")))
        if new.join(labels, ["node", "root"], "left_anti").isEmpty():
            return new
        labels = new


def assigned_targets(points: DataFrame, targets: DataFrame, radius: float = 24.0, purity: float = 0.5) -> DataFrame:
    """For each track the target with the most near points on equal frames, if it has the share of purity.

    points: video, track, frame, x, y; targets: video, target, frame, x, y.  Of targets with as many
    the one met first wins (by frame, then by name).
    """
    a = points.select("video", "frame", F.col("track").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = targets.select("video", "frame", F.col("target").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near_pairs(a, b, ["video", "frame"], radius).groupBy("video", "a_id", "b_id").agg(
        F.count(F.lit(1)).alias("near"), F.min("frame").alias("met"))
    best = Window.partitionBy("video", "a_id").orderBy(F.desc("near"), "met", "b_id")
    hits = points.groupBy("video", F.col("track").alias("a_id")).agg(F.count(F.lit(1)).alias("points"))
    top = near.withColumn("rank", F.row_number().over(best)).filter("rank = 1").join(hits, ["video", "a_id"])
    return top.filter(F.col("near") >= purity * F.col("points")).select(
        "video", F.col("a_id").alias("track"), F.col("b_id").alias("target"), "near", "points")


def matching_share(points: DataFrame, reference: DataFrame, radius: float = 24.0, purity: float = 0.5) -> DataFrame:
    """For each track how many points have a near reference point on their frame, and whether that is enough."""
    a = points.select("video", "frame", F.col("track").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = reference.select("video", "frame", F.col("det_idx").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near_pairs(a, b, ["video", "frame"], radius).select("video", "a_id", "frame").distinct().groupBy("video", "a_id").agg(F.count(F.lit(1)).alias("near"))
    hits = points.groupBy("video", F.col("track").alias("a_id")).agg(F.count(F.lit(1)).alias("points"))
    rows = hits.join(near, ["video", "a_id"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    return rows.select("video", F.col("a_id").alias("track"), "near", "points", (F.col("near") >= purity * F.col("points")).alias("matches"))


def attached(verdicts: DataFrame, tracks: DataFrame, within: float = 0.2) -> DataFrame:
    """Verdict rows attached to tracks of their video, greedily by pixel distance (none: last) and time gap.

    verdicts: video, row_id, start_s, start_x, start_y; tracks: video, track, start_s, x, y.
    """
    slack = within + 1e-6
    cell = F.floor(F.col("start_s") / slack).cast("long")
    left = verdicts.select("video", "row_id", F.col("start_s").alias("s"), "start_x", "start_y", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    right = tracks.select("video", "track", F.col("start_s").alias("t"), "x", "y", cell.alias("cell"))
    dx, dy = F.col("start_x") - F.col("x"), F.col("start_y") - F.col("y")
    met = left.join(right, ["video", "cell"]).withColumn("gap", F.round(F.abs(F.col("s") - F.col("t")), 9)).filter(F.col("gap") <= slack).withColumn(
        "d", F.coalesce(F.round(F.sqrt(dx * dx + dy * dy), 9), F.lit(float("inf"))))
    return greedy_rounds(met, ["video"], ["d", "gap", "row_id", "track"], "row_id", "track")


def nearest_in_time(rows: DataFrame, tracks: DataFrame, within: float) -> DataFrame:
    """For each row the track of its video whose start is nearest, within a bound; the least name of equals."""
    cell = F.floor(F.col("start_s") / within).cast("long")
    left = rows.select("video", "row_id", F.col("start_s").alias("s"), F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    right = tracks.select("video", "track", F.col("start_s").alias("t"), cell.alias("cell"))
    met = left.join(right, ["video", "cell"]).withColumn("gap", F.round(F.abs(F.col("s") - F.col("t")), 6)).filter(F.col("gap") <= within)
    return met.groupBy("video", "row_id").agg(F.min(F.struct("gap", "track")).alias("one")).select("video", "row_id", "one.track", "one.gap")


def neighbours(markers: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Per marker how many of other owners lie nearer than twice the radius."""
    a = markers.select(*keys, F.col("id").alias("a_id"), F.col("owner").alias("a_owner"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = markers.select(*keys, F.col("id").alias("b_id"), F.col("owner").alias("b_owner"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near_pairs(a, b, keys, 2 * radius, strict=True).filter("a_owner <> b_owner").groupBy(*keys, "a_id").agg(F.count(F.lit(1)).alias("crossings"))
    return markers.select(*keys, F.col("id").alias("a_id")).join(near, [*keys, "a_id"], "left").select(
        *keys, F.col("a_id").alias("id"), F.coalesce("crossings", F.lit(0)).alias("crossings"))


def difference_groups(rows: DataFrame, keys: list[str], gap: int = 30) -> DataFrame:
    """Sessions of rows at most so many frames apart: first, last, counts per kind, centre, peak amplitude.

    rows: keys, frame, kind, x, y, amplitude.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    begins = F.coalesce(F.col("frame") > F.lag("frame").over(order) + gap, F.lit(True)).cast("long")
    numbered = rows.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count_if(F.col("kind") == "lost").alias("lost"),
        F.count_if(F.col("kind") == "added").alias("added"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"),
        F.max("amplitude").alias("peak")).drop("session")


def track_ends(points: DataFrame, most: int = 5) -> DataFrame:
    """Per track its hits, ends and the velocities over at most so many first and last points and over all (0 for one).

    points: video, track, frame, x, y.
    """
    own = Window.partitionBy("video", "track")
    rows = points.select("video", "track", "frame", "x", "y", F.row_number().over(own.orderBy("frame")).alias("from_start"),
                         F.row_number().over(own.orderBy(F.desc("frame"))).alias("from_end"))
    point = F.struct("frame", "x", "y")
    parts = {"head": F.col("from_start") <= most, "tail": F.col("from_end") <= most, "whole": F.lit(True)}
    ends = rows.groupBy("video", "track").agg(F.count(F.lit(1)).alias("hits"), *(
        f(F.when(held, point)).alias(f"{name}_{n}") for name, held in parts.items() for n, f in (("a", F.min), ("b", F.max))))

    def velocity(name: str, c: str):
        first, last = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(last["frame"] > first["frame"], (last[c] - first[c]) / (last["frame"] - first["frame"])).otherwise(0.0).alias(f"{name}_v{c}")

    return ends.select("video", "track", "hits", F.col("whole_a.frame").alias("first"), F.col("whole_b.frame").alias("last"),
                       *(F.col(f"whole_{n}.{c}").alias(f"{side}_{c}") for side, n in (("first", "a"), ("last", "b")) for c in "xy"),
                       *(velocity(name, c) for name in parts for c in "xy"))


@dataclass(frozen=True)
class RejoinSettings:
    """Bounds of rejoining: hidden frames, pixels, points of pieces, shares of a kept track's speed."""

    max_gap: int = 6
    most_hidden: int = 19
    miss: float = 60.0
    min_hits: int = 6
    piece_points: int = 2
    junction: float = 0.25
    piece: float = 0.45
    edge: float = 30.0
    width: float = 1440.0
    height: float = 1080.0


def rejoinable(points: DataFrame, ignored: DataFrame, settings: RejoinSettings = RejoinSettings()) -> DataFrame:
    """Pairs (video, a_id, b_id, through_piece, hidden, miss) of tracks where b may go on where a ended.

    b begins more than max_gap and at most most_hidden hidden frames after a ends, neither end is at the edge, no
    ignored span (video, first, last) overlaps what is hidden, and both, led on to the middle, meet within `miss`.
    Tracks of fewer than min_hits points are pieces, those of fewer than piece_points nothing; two pieces are not
    linked.  The way across, and a piece of several points, must not be slower than shares of the kept track's speed.
    """
    s = settings
    speed = lambda name: F.sqrt(F.col(f"{name}_vx") * F.col(f"{name}_vx") + F.col(f"{name}_vy") * F.col(f"{name}_vy"))
    inner = lambda side: F.least(F.col(f"{side}_x"), s.width - F.col(f"{side}_x"), F.col(f"{side}_y"), s.height - F.col(f"{side}_y")) >= s.edge
    ends = track_ends(points).filter(F.col("hits") >= s.piece_points).withColumn("piece", F.col("hits") < s.min_hits).withColumn("pace", speed("whole"))
    ends = ends.withColumn("head", speed("head")).withColumn("tail", speed("tail"))
    size = s.most_hidden + 2
    a = ends.filter(inner("last")).select(
        "video", F.col("track").alias("a_id"), F.col("last").alias("until"), F.col("last_x").alias("x0"), F.col("last_y").alias("y0"),
        F.col("tail_vx").alias("vx0"), F.col("tail_vy").alias("vy0"), F.col("piece").alias("a_piece"), F.col("pace").alias("a_pace"),
        F.col("tail").alias("a_speed"), F.col("hits").alias("a_hits"), F.col("first").alias("a_first"),
        F.explode(F.sequence(F.expr(f"(last + {s.max_gap}) div {size}"), F.expr(f"(last + {s.most_hidden + 1}) div {size}"))).alias("cell"))
    b = ends.filter(inner("first")).select(
        "video", F.col("track").alias("b_id"), F.col("first").alias("since"), F.col("first_x").alias("x1"), F.col("first_y").alias("y1"),
        F.col("head_vx").alias("vx1"), F.col("head_vy").alias("vy1"), F.col("piece").alias("b_piece"), F.col("pace").alias("b_pace"),
        F.col("head").alias("b_speed"), F.col("hits").alias("b_hits"), F.expr(f"first div {size}").alias("cell"))
    met = a.join(b, ["video", "cell"]).withColumn("hidden", F.col("since") - F.col("until") - 1).filter(
        (F.col("hidden") > s.max_gap) & (F.col("hidden") <= s.most_hidden) & ~(F.col("a_piece") & F.col("b_piece")))
    gap = F.col("since") - F.col("until")
    dx = F.col("x0") + (F.col("vx0") + F.col("vx1")) / 2 * gap - F.col("x1")
    dy = F.col("y0") + (F.col("vy0") + F.col("vy1")) / 2 * gap - F.col("y1")
    across = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / gap
    fast = lambda mine, other: F.col(f"{mine}_piece") | (
        (across >= s.junction * F.col(f"{mine}_speed")) & (~F.col(f"{other}_piece") | (F.col(f"{other}_hits") < 2)
                                                           | (F.col(f"{other}_pace") >= s.piece * F.col(f"{mine}_speed"))))
    met = met.withColumn("miss", F.round(F.sqrt(dx * dx + dy * dy), 4)).filter((F.col("miss") <= s.miss) & fast("a", "b") & fast("b", "a"))
    # holes that a span reaches into, by their few frames
    holes = met.select("video", "a_id", "b_id", F.explode(F.sequence(F.col("until") + 1, F.col("since") - 1)).alias("frame"))
    hidden = inside(holes, ignored, ["video"]).select("video", "a_id", "b_id").distinct()
    return met.join(hidden, ["video", "a_id", "b_id"], "left_anti").select(
        "video", "a_id", "b_id", (F.col("a_piece") | F.col("b_piece")).alias("through_piece"), "hidden", "miss")


def rejoined(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs those taken: without pieces first, then by miss, then by names, each end and start once.

    The fold is keyed by the connected component of pairs, not by the video: what is far apart does not wait.
    """
    tagged = cut(pairs.select("*", *(F.struct("video", F.col(f"{n}_id").alias("track")).alias(f"{n}_end") for n in "ab")))
    parts = groups(tagged.select(F.col("a_end").alias("a_id"), F.col("b_end").alias("b_id"))).select(F.col("node").alias("a_end"), F.col("root").alias("part"))
    keyed = tagged.join(parts, "a_end").select("video", "part", "through_piece", "miss", "a_id", "b_id")
    return greedy(keyed, ["video", "part"], ["through_piece", "miss", "a_id", "b_id"], "a_id", "b_id").drop("part")


def chains(points: DataFrame, links: DataFrame, settings: RejoinSettings = RejoinSettings()) -> DataFrame:
    """points with head: the track that begins the chain of links (video, a_id, b_id) in which a track stands.

    Tracks without links are chains of their own; chains of pieces alone, and what is less than a piece, go.
    """
    ends = points.groupBy("video", "track").agg(F.min("frame").alias("first"), F.count(F.lit(1)).alias("hits"))
    held = groups(links.select(F.struct("video", F.col("a_id").alias("track")).alias("a_id"), F.struct("video", F.col("b_id").alias("track")).alias("b_id")))
    rows = ends.join(held.select("node.video", "node.track", F.struct(F.col("root.video"), F.col("root.track")).alias("root")), ["video", "track"], "left")
    rows = rows.withColumn("root", F.coalesce("root", F.struct("video", "track")))
    heads = rows.groupBy("root").agg(F.min(F.struct("first", "track")).alias("one"), F.max("hits").alias("hits")).filter(
        F.col("hits") >= settings.min_hits).select("root", F.col("one.track").alias("head"))
    return points.join(rows.join(heads, "root").select("video", "track", "head"), ["video", "track"])


def crowded(points: DataFrame, others: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The ids of a's rows that have a row of b nearer than a distance on their keys."""
    return near_pairs(points, others, keys, least, strict=True).select("a_id").distinct()
