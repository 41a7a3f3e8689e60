"""Which paths of a page come near each other: all pairs of paths, as bits of square tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.operators.tracks import arc_lengths

#: Spots of a block of paths; a path counts for at least LEAST, so that a block has at most 4,096 paths.
SPOTS, LEAST = 1 << 20, 256
#: Cells of a table of a tile, cells of a distance (a little more than it), and tests of spots at once.
CELLS, PER_NEAR, TESTS = 1 << 21, 8, 1 << 20
SLACK = 1 + 1e-6
#: Tasks of the tiles for each tile, and at most.
TASKS, MOST_TASKS = 3, 3000

TILES = "page {page}, late long, early long, base long, paths long, early_paths long, bits binary"


def spots_along(path: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, x and y of the spots every so far along paths, and at their ends; path: numbers in ascending order, one a
    point.  A spot without a finite place is near nothing and is left out."""
    same, last = path[1:] == path[:-1], np.append(path[1:] != path[:-1], True)
    leg = np.flatnonzero(same & (length[1:] > length[:-1]))
    first = np.ceil(length[leg] / step).astype(np.int64)
    n = np.ceil(length[leg + 1] / step).astype(np.int64) - first
    leg = np.repeat(leg, n)
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(leg))
    share = (place * step - length[leg]) / (length[leg + 1] - length[leg])
    own = np.append(path[leg], path[last])
    order = np.argsort(own, kind="stable")
    at = [np.append(np.round(c[leg] + (c[leg + 1] - c[leg]) * share, 9), c[last])[order] for c in (x, y)]
    there = np.isfinite(at[0]) & np.isfinite(at[1])
    return own[order][there], at[0][there], at[1][there]


def reaches(size: float, near: float, sure: bool) -> list[int]:
    """For each row of cells away from a cell, how many cells aside all spots (sure) or some spots of both can be near."""
    far = np.arange(PER_NEAR + 2)
    a = far + 1 if sure else np.maximum(far - 1, 0)
    counts = (size * np.hypot(a[:, None], a[None]) < near).sum(1)
    return [int(c) - 1 for c in counts if c]


def spread(table: np.ndarray, *rows: list[int]) -> list[np.ndarray]:
    """The bits of a table of words carried to the cells around (see reaches), for each of some reaches."""
    out, wide = [np.zeros_like(table) for _ in rows], table.copy()
    for width in range(1 + max((max(r) for r in rows if r), default=-1)):
        if width:
            wide[:, width:] |= table[:, :-width]
            wide[:, :-width] |= table[:, width:]
        for to, reach in zip(out, rows):
            for away, aside in enumerate(reach):
                if aside == width:
                    to[away:] |= wide[:len(wide) - away]
                    if away:
                        to[:-away] |= wide[away:]
    return out


def runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, so many of each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Early:
    """The spots of the earlier block of a tile, in cells of an eighth of the distance: `near` says for 64 later paths
    which earlier ones they come near.

    A table holds a word for each cell, a bit for each of the 64.  Carried to the cells in which every spot is near,
    and to those in which some may be, it decides nearly all pairs by one look-up for each earlier spot.  The rest is
    decided by distances, between the spots whose cells may be near.  Over pages of more than CELLS cells, cells grow.
    """

    def __init__(self, path: np.ndarray, x: np.ndarray, y: np.ndarray, paths: int, near: float):
        self.path, self.x, self.y, self.paths, self.distance = path, x, y, paths, near
        self.size, self.margin = near / PER_NEAR * SLACK, PER_NEAR + 1
        if not len(x):
            return
        self.origin = x.min(), y.min()
        while True:
            self.width, self.height = (int((c.max() - o) // self.size) + 1 + 2 * self.margin for c, o in zip((x, y), self.origin))
            if self.width * self.height <= CELLS:
                break
            self.size *= 2
        self.cx, self.cy = self.cells(x, y)
        self.cell = (self.cy * self.width + self.cx).astype(np.int32)
        self.owners, self.starts = np.unique(path, return_index=True)
        self.counts = np.diff(np.append(self.starts, len(path)))
        self.sure, self.may = reaches(self.size, near, True), reaches(self.size, near, False)

    def cells(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [((c - o) // self.size).astype(np.int64) + self.margin for c, o in zip((x, y), self.origin)]

    def near(self, bit: np.ndarray, x: np.ndarray, y: np.ndarray, before: int | None = None) -> np.ndarray:
        """paths x 64 booleans, for spots of at most 64 later paths (bit: which); of the earlier paths only those below
        `before` count."""
        out = np.zeros((self.paths, 64), bool)
        if not len(self.x) or not len(x):
            return out
        n = len(self.owners) if before is None else int(np.searchsorted(self.owners, before))
        end = self.starts[n] if n < len(self.owners) else len(self.x)
        edge = self.margin * self.size
        inside = (x >= self.origin[0] - edge) & (x < self.origin[0] + (self.width - self.margin) * self.size) & (
            y >= self.origin[1] - edge) & (y < self.origin[1] + (self.height - self.margin) * self.size)
        bit, x, y = bit[inside], x[inside], y[inside]
        if not n or not len(x):
            return out
        cx, cy = (np.clip(c, 0, most - 1) for c, most in zip(self.cells(x, y), (self.width, self.height)))
        table = np.zeros(self.width * self.height, np.uint64)
        for b in np.unique(bit):
            table[(cy * self.width + cx)[bit == b]] |= np.uint64(1 << int(b))
        sure, may = (t.ravel() for t in spread(table.reshape(self.height, self.width), self.sure, self.may))
        cell, starts = self.cell[:end], self.starts[:n]
        maybe = may[cell]
        known = np.bitwise_or.reduceat(sure[cell], starts)
        out[self.owners[:n]] = np.unpackbits(known.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        open_ = maybe & np.repeat(np.bitwise_or.reduceat(maybe, starts) & ~known, self.counts[:n])
        wide, high = self.width // PER_NEAR + 2, self.height // PER_NEAR + 2
        place = (bit * high + cy // PER_NEAR) * wide + cx // PER_NEAR
        order = np.argsort(place, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=64 * high * wide))])
        x, y, spot = x[order], y[order], np.flatnonzero(open_)
        word = open_[spot]
        while len(spot):
            # the lowest bit of each word; most words have one
            b = np.bitwise_count((word & -word) - np.uint64(1)).astype(np.int64)
            self._test(spot, b, (b * high + self.cy[spot] // PER_NEAR) * wide + self.cx[spot] // PER_NEAR, wide, begin, x, y, out)
            word &= word - np.uint64(1)
            spot, word = spot[word > 0], word[word > 0]
        return out

    def _test(self, spot: np.ndarray, b: np.ndarray, place: np.ndarray, wide: int, begin: np.ndarray, x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
        """Sets in out the pairs of a spot's path and a bit that distances show to be near.  Later spots (x, y) lie in order
        of bit and cell of the distance, whose first ones begin tells; a spot meets three rows of three cells."""
        for row in (0, -1, 1):
            left = ~out[self.path[spot], b]
            spot, b, place = spot[left], b[left], place[left]
            first = begin[place + row * wide - 1]
            counts = begin[place + row * wide + 2] - first
            ends = np.cumsum(counts)
            edges = np.searchsorted(ends, np.arange(TESTS, ends[-1] if len(ends) else 0, TESTS))
            for part in np.split(np.arange(len(spot)), np.unique(edges)):
                at, one = runs(first[part], counts[part]), np.repeat(part, counts[part])
                dx, dy = x[at] - self.x[spot[one]], y[at] - self.y[spot[one]]
                hit = one[np.sqrt(dx * dx + dy * dy) < self.distance]
                out[self.path[spot[hit]], b[hit]] = True


def near_tiles(points: DataFrame, near: float) -> tuple[DataFrame, DataFrame]:
    """Which paths of a page come nearer to an earlier one than a distance, both sampled every quarter of it.

    points: page, path, frame, x, y; a path without a name, or on a page without one, is near nothing.  Returns (page,
    path, at), paths numbered from 0 in order of their names, and tiles (page, late, early, base, paths, early_paths, bits): of two blocks of paths, whose later one begins at number
    base, a row of bits for each later path with a bit for each earlier one, rows being whole words of 64.

    All pairs are compared, so the work and the bits grow with the square of a page's paths; a task holds one tile, of
    at most 4,096 by 4,096 paths, and its spots.  Paths travel as their points, once for each block of the page.
    """
    step = near / 4
    placed = lambda c: F.when(F.col("page").isNotNull() & F.col("path").isNotNull(), F.col(c)).alias(c)
    along = arc_lengths(points.select(F.struct("page", "path").alias("track"), "frame", placed("x"), placed("y")), "x", "y")
    packed = cut(along.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("frame", "length", "x", "y"))).alias("p")).select(
        "track.page", "track.path", *(F.col(f"p.{c}").alias(c) for c in ("length", "x", "y"))))
    spots = F.greatest(F.ceil(F.element_at("length", -1) / step) + 1, F.lit(LEAST))
    order = Window.partitionBy("page").orderBy("path")
    numbers = packed.select("page", "path", spots.alias("spots")).withColumn("at", F.row_number().over(order).cast("long") - 1).withColumn(
        "block", F.expr(f"(sum(spots) OVER (PARTITION BY page ORDER BY path ROWS UNBOUNDED PRECEDING) - 1) div {SPOTS}"))
    names = cut(numbers.withColumn("blocks", F.max("block").over(Window.partitionBy("page")) + 1).drop("spots"))
    tiles = names.groupBy("page").agg(F.first("blocks").alias("n")).agg(F.sum(F.expr("n * (n + 1) div 2"))).first()[0] or 1
    named = packed.alias("p").join(names.alias("n"), F.expr("p.page <=> n.page AND p.path <=> n.path")).select("n.*", "length", "x", "y")
    dealt = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "page", F.greatest("block", "other").alias("late"), F.least("block", "other").alias("early"), "block", "at", "length", "x", "y")

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([table.schema.field("page"), *((c, pa.int64()) for c in ("late", "early", "base", "paths", "early_paths")), ("bits", pa.binary())])
        table = table.sort_by("at")
        late, early = table["late"][0].as_py(), table["early"][0].as_py()
        sides = []
        for block in (late, early):
            rows = table.filter(pc.equal(table["block"], block)).combine_chunks()
            count = rows["length"].combine_chunks().value_lengths().to_numpy()
            points = [rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("length", "x", "y")]
            sides.append((rows, *spots_along(np.repeat(np.arange(len(rows)), count), *points, step)))
        (mine, path, x, y), (theirs, *spots) = sides
        if not len(mine) or not len(theirs):
            return schema.empty_table()
        known, bits = Early(*spots, len(theirs), near), []
        for k in range(0, len(mine), 64):
            own = slice(*np.searchsorted(path, [k, min(k + 64, len(mine))]))
            met = known.near(path[own] - k, x[own], y[own], k + 64 if late == early else None)
            if late == early:
                met &= np.arange(len(theirs))[:, None] < k + np.arange(64)
            words = np.zeros((64, -(-len(theirs) // 64) * 8), np.uint8)
            words[:, :-(-len(theirs) // 8)] = np.packbits(met.T, axis=1, bitorder="little")
            bits.append(words[:len(mine) - k].tobytes())
        return pa.table([[table["page"][0].as_py()], [late], [early], [mine["at"][0].as_py()], [len(mine)], [len(theirs)], [b"".join(bits)]], schema=schema)

    tasks = dealt.repartition(int(min(max(TASKS * tiles, 1), MOST_TASKS)), "page", "late", "early")
    made = tasks.groupBy("page", "late", "early").applyInArrow(run, TILES.format(page=dict(points.dtypes)["page"]))
    return names.select("page", "path", "at"), made
