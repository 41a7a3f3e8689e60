"""Small helpers of the subpackage's DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut

__all__ = ["cut", "fresh", "named", "ranked"]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until it clashes with none (Spark ignores case)."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def named(value: Column) -> Column:
    """A string that is never null and differs for null and for every value; an equi-join key."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def ranked(df: DataFrame, group: list[str], split: str, order: list, name: str, beside: DataFrame | None = None) -> DataFrame:
    """df with name: the position of each row in its group from 0, without gaps, by split, then order.

    The columns of group and split must not hold nulls.  A group, however large, is numbered in as
    many tasks as split has values: rows are numbered within (group, split), the counts of these
    parts are summed to offsets, and the two are joined on the parts.  Only counts meet per group.

    beside: a table with one row per group, whose other columns df gets too.  It meets the offsets, not
    the rows, which are shuffled once, by their part.
    """
    keys = [*group, split]
    more = [c for c in beside.columns if c not in group] if beside is not None else []
    count, offset, within = fresh([*df.columns, *more], "count", "offset", "within")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*group).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset))
    numbered = df.withColumn(within, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if beside is not None:
        offsets = offsets.join(beside, group)
    joined = numbered.join(offsets, keys)
    return joined.select(*df.columns, *more, (F.col(offset) + F.col(within) - 1).alias(name))
