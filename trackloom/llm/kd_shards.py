"""Sharding by a k-d tree over metadata, with DataFrame functions only.

Every node splits its rows at the weighted median of its widest dimension until the leaves hold the
target bytes.  The medians of all nodes of a level are found together: rows are counted into bins of
the node's range, the bin that holds the median becomes the next range, and so on.  Up to PLANNED
leaves the driver gets one row per node and pass and the splits are part of the plan; beyond, nodes,
ranges and splits are tables (deep).  Where many rows share the median value, a hash of the row
orders them, so that one value may hold any part of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import dropped
from trackloom.llm.frames import cut, fresh, ranked

#: Bins of a range in one pass over the rows.
BINS = 2048
LARGEST = 2**63 - 1
#: Leaves up to which the splits are literals of one plan; more, and other numbers than powers of two, are tables.
PLANNED = 1024


def coded(value: Column) -> Column:
    """The first six bytes of a string as a number, in the strings' order; -1 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(value.cast("string"), "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1))


@dataclass(frozen=True)
class Split:
    """Left are the rows below value in dimension, and of those at value the ones whose tie is below tie."""

    dimension: str
    value: int
    tie: int


def _by_node(node: Column, values: dict[int, int], most: int) -> Column:
    """The value of a node, null for others: a literal array, so that the plan does not grow with the nodes."""
    return F.array(*(F.lit(values.get(k)).cast("long") for k in range(most + 1)))[node]


def _reached(rows: DataFrame, ranges: dict[int, tuple[int, int]], need: dict[int, float], where: Column) -> dict[int, tuple[int, int, int]]:
    """Per node of ranges the bin of its range in which so many bytes are reached, or else the last one with rows: the
    bin, the bytes before it and its own; rows: node, size, measure."""
    most = max(ranges)
    node = F.col("node")
    picked = rows.filter(where & (node <= most)).select(
        "node", "size", "measure", _by_node(node, {k: r[0] for k, r in ranges.items()}, most).alias("lo"),
        _by_node(node, {k: r[1] for k, r in ranges.items()}, most).alias("hi"),
        _by_node(node, {k: _step(*r) for k, r in ranges.items()}, most).alias("step"))
    # a range of more than half of all longs has differences that are none
    wide = any(hi - lo >= LARGEST for lo, hi in ranges.values())
    bin_ = "cast((cast(measure as decimal(20, 0)) - lo) div step as long)" if wide else "(measure - lo) div step"
    counts = (picked.filter(F.col("measure").between(F.col("lo"), F.col("hi")))
              .groupBy("node", F.expr(bin_).alias("bin")).agg(F.sum("size").alias("bytes")))
    # at most BINS rows a node meet here
    along = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    halves = _by_node(node, {k: math.ceil(2 * n) for k, n in need.items()}, most)
    summed = counts.withColumn("upto", F.sum("bytes").over(along))
    one = F.struct("bin", "upto", "bytes")
    chosen = summed.groupBy("node").agg(F.coalesce(F.min(F.when(2 * F.col("upto") >= halves, one)), F.max(one)).alias("one"))
    # one row a node of the level
    return {r["node"]: (r["one"]["bin"], int(r["one"]["upto"] - r["one"]["bytes"]), int(r["one"]["bytes"])) for r in chosen.collect()}


def _step(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo + 1) // BINS))


def _narrow(rows: DataFrame, ranges: dict[int, tuple[int, int]], before: dict[int, float], goal: dict[int, float],
            small: float, where: Column) -> dict[int, tuple[int, float, float]]:
    """Per node the value at which the bytes before it reach the goal, those bytes, and its own bytes.

    A range whose bin of the goal holds a single value, or at most small bytes, is narrow enough; in
    the latter case the value is an end of that bin and has no bytes of its own.
    """
    done: dict[int, tuple[int, float, float]] = {}
    ranges, before = dict(ranges), dict(before)
    while ranges:
        reached = _reached(rows, ranges, {k: goal[k] - before[k] for k in ranges}, where)
        for k, (lo, hi) in list(ranges.items()):
            if k not in reached:
                done[k] = (lo, before[k], 0)
            else:
                b, earlier, weight = reached[k]
                step, at = _step(lo, hi), before[k] + earlier
                first, last = lo + b * step, min(hi, lo + (b + 1) * step - 1)
                if step == 1 or weight <= small and last == LARGEST:
                    done[k] = (last, at, weight)
                elif weight <= small:
                    done[k] = (first, at, 0) if at + weight / 2 >= goal[k] else (last + 1, at + weight, 0)
                else:
                    before[k], ranges[k] = at, (first, last)
            if k in done:
                del ranges[k]
    return done


def place(splits: dict[int, Split], k: int, levels: int) -> Column:
    """The node below k, so many levels down, in which a row falls; every split stands once in the expression."""
    if not levels:
        return F.lit(k)
    if k not in splits:
        # no rows came here
        return F.lit(k << levels)
    s = splits[k]
    left = (F.col(s.dimension) < s.value) | ((F.col(s.dimension) == s.value) & (F.col("tie") < s.tie))
    return F.when(left, place(splits, 2 * k, levels - 1)).otherwise(place(splits, 2 * k + 1, levels - 1))


def tree(rows: DataFrame, dimensions: list[str], leaves: int, tolerance: float = 1e-4) -> tuple[Column, dict[int, Split]]:
    """The leaf of each row (0 to leaves - 1) as an expression, and the splits by node (root 1, children 2k, 2k + 1).

    rows: size, tie (0 <= tie < 2^31) and the dimensions, all non-null longs.  leaves: a power of two.
    A node is split within tolerance of a leaf's bytes, or of one row.
    """
    if leaves < 1 or leaves & (leaves - 1):
        raise ValueError("leaves must be a power of two")
    splits: dict[int, Split] = {}
    measured = [F.sum("size").alias("bytes")]
    measured += [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]
    spread: dict[str, int] = {}
    total = 0
    depth = leaves.bit_length() - 1
    for level in range(depth):
        placed = rows.withColumn("node", place(splits, 1, level))
        stats = {r["node"]: r for r in placed.groupBy("node").agg(*measured).collect()}
        if not stats:
            break
        if not level:
            total = int(stats[1]["bytes"])
            spread = {d: max(1, stats[1][f"hi_{d}"] - stats[1][f"lo_{d}"]) for d in dimensions}
        small = tolerance * total / leaves
        widest = {k: max(range(len(dimensions)), key=lambda d, r=r: (
            r[f"hi_{dimensions[d]}"] - r[f"lo_{dimensions[d]}"]) / spread[dimensions[d]]) for k, r in stats.items()}
        measure = F.array(*map(F.col, dimensions))[_by_node(F.col("node"), widest, max(widest)).cast("int")]
        goal = {k: int(r["bytes"]) / 2 for k, r in stats.items()}
        whole = {k: (r[f"lo_{dimensions[widest[k]]}"], r[f"hi_{dimensions[widest[k]]}"]) for k, r in stats.items()}
        measuring = placed.withColumn("measure", measure)
        found = _narrow(measuring, whole, {k: 0.0 for k in stats}, goal, small, F.lit(True))
        # where the median value itself holds many bytes, its rows are split by their tie
        tied = {k: v for k, v in found.items() if v[2] > small}
        ties: dict[int, int] = {}
        if tied:
            at_value = F.col("value") == _by_node(F.col("node"), {k: v[0] for k, v in tied.items()}, max(tied))
            cuts = _narrow(measuring.withColumn("value", F.col("measure")).withColumn("measure", F.col("tie")),
                           {k: (0, 2**31 - 1) for k in tied}, {k: v[1] for k, v in tied.items()}, goal, small, at_value)
            # a single tie goes where it leaves the halves nearer
            ties = {k: int(value) + (abs(at + weight - goal[k]) < abs(at - goal[k])) for k, (value, at, weight) in cuts.items()}
        for k, (value, at, weight) in found.items():
            nearer = 2**31 if abs(at + weight - goal[k]) < abs(at - goal[k]) else 0
            splits[k] = Split(dimensions[widest[k]], int(value), ties.get(k, nearer))
    return (place(splits, 1, depth) - leaves).cast("int"), splits


def _open(level: int, nodes: DataFrame) -> DataFrame:
    """A table of a row a node, broadcast while a level has few of them; later nodes are many and of like size, so that
    a join dealt by node has no hot key."""
    return F.broadcast(nodes) if 1 << level <= PLANNED else nodes


def _narrowed(level: int, rows: DataFrame, state: DataFrame, small: float, wide: bool) -> DataFrame:
    """_narrow for nodes in a table: node, value, at and weight of each row of state (node, lo, hi, before, goal);
    rows: node, size, measure.  Each pass is written; what is open is joined again."""
    done, open_ = None, cut(state.select("node", "lo", "hi", F.col("before").cast("double").alias("before"), F.col("goal").cast("double").alias("goal")))
    number = (lambda c: f"cast({c} as decimal(20, 0))") if wide else (lambda c: c)
    step = f"cast(greatest(1, ({number('hi')} - {number('lo')} + {BINS}) div {BINS}) as bigint)"
    while not open_.isEmpty():
        met = rows.join(_open(level, open_.withColumn("step", F.expr(step))), "node").filter(F.col("measure").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy("node", F.expr(f"cast(({number('measure')} - {number('lo')}) div step as bigint)").alias("bin")).agg(F.sum("size").alias("bytes"))
        # at most BINS rows a node meet here
        along = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("upto", F.sum("bytes").over(along)).join(_open(level, open_.select("node", "before", "goal")), "node")
        one = F.struct("bin", "upto", "bytes")
        reached = placed.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("before") + F.col("upto") >= F.col("goal"), one)), F.max(one)).alias("one"))
        state = open_.join(reached, "node", "left").withColumn("step", F.expr(step)).selectExpr(
            "*", "before + coalesce(one.upto - one.bytes, 0) as at", "coalesce(one.bytes, 0) as weight",
            f"cast({number('lo')} + coalesce(one.bin, 0) * {number('step')} as bigint) as first",
            f"cast(least({number('hi')}, {number('lo')} + (coalesce(one.bin, 0) + 1) * {number('step')} - 1) as bigint) as last")
        single = F.col("one").isNull() | (F.col("step") == 1) | ((F.col("weight") <= small) & (F.col("last") == LARGEST))
        low = F.col("at") + F.col("weight") / 2 >= F.col("goal")
        state = cut(state.withColumn("single", single).withColumn("closed", single | (F.col("weight") <= small)).withColumn("low", low))
        ended = state.filter("closed").select(
            "node", F.expr("case when one is null then lo when single then last when low then first else last + 1 end").alias("value"),
            F.expr("case when single or low then at else at + weight end").alias("at"), F.expr("case when single then weight else 0 end").alias("weight"))
        done = ended if done is None else done.unionByName(ended)
        open_ = cut(state.filter("not closed").select("node", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("at").alias("before"), "goal"))
    return done if done is not None else state.selectExpr("node", "lo as value", "before as at", "0 as weight")


def deep(rows: DataFrame, dimensions: list[str], leaves: int, tolerance: float = 1e-4) -> DataFrame:
    """rows with shard: the leaf of each row in a tree of any number of leaves, whose splits are tables.

    A node of n leaves is split at ceil(n / 2) / n of its bytes, so that the leaves need not be a power of two.  Rows
    carry their node and are written once a level; neither the plan nor the driver grows with the nodes.
    """
    whole = rows.agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if whole["bytes"] is None:
        return rows.withColumn("shard", F.lit(0))
    spread = {d: max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in dimensions}
    small, wide = tolerance * int(whole["bytes"]) / leaves, any(v >= LARGEST for v in spread.values())
    own = cut(rows.select("*", F.lit(0).cast("bigint").alias("node"), F.lit(leaves).cast("bigint").alias("count")))
    for level in range((leaves - 1).bit_length()):
        active = own.filter("count > 1")
        stats = active.groupBy("node").agg(F.first("count").alias("count"), F.sum("size").alias("bytes"), *(
            f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))))
        widths = F.array(*((F.col(f"hi_{d}").cast("double") - F.col(f"lo_{d}").cast("double")) / float(spread[d]) for d in dimensions))
        of = lambda n: F.get(F.array(*(F.col(f"{n}_{d}") for d in dimensions)), F.col("widest"))
        half = F.expr("(count + 1) div 2")
        nodes = cut(stats.withColumn("widest", (F.array_position(widths, F.array_max(widths)) - 1).cast("int")).select(
            "node", "count", "widest", half.alias("half"), of("lo").alias("lo"), of("hi").alias("hi"), F.lit(0.0).alias("before"), (F.col("bytes") * half / F.col("count")).alias("goal")))
        measured = active.join(_open(level, nodes.select("node", "widest")), "node").select(
            "node", "size", "tie", F.get(F.array(*map(F.col, dimensions)), F.col("widest")).alias("measure"))
        found = cut(_narrowed(level, measured, nodes, small, wide))
        tied = found.filter(F.col("weight") > small)
        at_value = measured.join(_open(level, tied.select("node", "value")), "node").filter("measure = value").select("node", "size", F.col("tie").alias("measure"))
        ties = _narrowed(level, at_value, tied.join(nodes.select("node", "goal"), "node").select(
            "node", F.lit(0).cast("bigint").alias("lo"), F.lit(2**31 - 1).cast("bigint").alias("hi"), F.col("at").alias("before"), "goal"), small, False)
        nearer = lambda at, weight: F.abs(F.col(at) + F.col(weight) - F.col("goal")) < F.abs(F.col(at) - F.col("goal"))
        # a single tie, or value, goes where it leaves the parts nearer to their goals
        splits = cut(found.join(nodes, "node").join(ties.select("node", F.col("value").alias("tie_value"), F.col("at").alias("tie_at"), F.col("weight").alias("tie_weight")), "node", "left").select(
            "node", "widest", "half", "value", F.when(F.col("tie_value").isNotNull(), F.col("tie_value") + nearer("tie_at", "tie_weight").cast("int")).otherwise(
                F.when(nearer("at", "weight"), 2**31).otherwise(0)).alias("cut_tie")))
        met = own.join(_open(level, splits), "node", "left")
        measure = F.get(F.array(*map(F.col, dimensions)), F.col("widest"))
        left = (measure < F.col("value")) | ((measure == F.col("value")) & (F.col("tie") < F.col("cut_tie")))
        after = cut(met.select(*rows.columns, F.when(F.col("half").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("half")).alias("node"),
                               F.when(F.col("half").isNull(), F.col("count")).when(left, F.col("half")).otherwise(F.col("count") - F.col("half")).alias("count")))
        dropped(own)
        own = after
    return own.withColumn("shard", F.col("node").cast("int")).drop("node", "count")


def shard(df: DataFrame, size: Column, row_id: Column, dimensions: dict[str, Column], leaves: int | None = 16,
          keep: list[str] = (), splits: int = 64, target_bytes: int | None = None) -> DataFrame:
    """The columns of keep with size, shard (0 to leaves - 1) and slot (from 0 in the shard, without gaps).

    With target_bytes instead of leaves, nodes are split at their medians until none holds more than that.  Any number
    of leaves will do (see deep).  keep should be narrow: its columns are written once to the checkpoint folder, from
    which all passes read.  Sizes must be positive for the bytes to be balanced.  A null size counts as 0, a null
    dimension as -1 and a null id as 0.  Among rows of one value a hash of id and coordinates decides, so
    repeated rows fall into one shard; an empty table gives no rows.
    """
    names = {n: f"dim_{k}" for k, n in enumerate(dimensions)}
    packed = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"),
                       F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
                       F.coalesce(row_id.cast("long"), F.lit(0)).alias("id"),
                       *(F.coalesce(c.cast("long"), F.lit(-1)).alias(names[n]) for n, c in dimensions.items()))
    # the upper half of a 64-bit hash: at every size ties are broken evenly
    tie = F.shiftrightunsigned(F.xxhash64("id", *names.values()), 33)
    rows = cut(packed.withColumn("tie", tie))
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = 1 << max(0, (-(-total // target_bytes) - 1).bit_length())
    if leaves <= PLANNED and not leaves & (leaves - 1):
        leaf, _ = tree(rows, list(names.values()), leaves)
        sharded = rows.withColumn("shard", leaf)
    else:
        sharded = deep(rows, list(names.values()), leaves)
    placed = sharded.select("kept", "size", "id", "tie", "shard", F.pmod(F.col("tie"), F.lit(splits)).alias("split"))
    out = ranked(placed, ["shard"], "split", ["id", "tie", "size"], "slot")
    size_, shard_, slot_ = fresh(list(keep), "size", "shard", "slot")
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), F.col("size").alias(size_),
                      F.col("shard").alias(shard_), F.col("slot").cast("long").alias(slot_))
