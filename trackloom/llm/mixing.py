"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources share the corpus by weight; what a source cannot fill within a bound of repeats goes to the
others.  Within a source every document expects the same number of copies, its source's target over
its size.  These expectations are prefix-summed along the source, one random offset is added, and a
document is emitted once for each integer that the sum crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.frames import fresh, named, ranked

#: Expected copies are integers in units of 2^-BITS: their prefix sums are exact and order-free.
BITS = 24


def words(text: Column) -> Column:
    """Runs of anything but U+0020 and U+0009..U+000D in a text; 0 in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, cycle: tuple[int, ...] = (1, 2, 3),
            most_repeats: int = 3) -> DataFrame:
    """Per source (one row each, from sizes) its target: source, size, target double.

    Sources weigh cycle[0], cycle[1], ... in order of their code points, null last, and share the sum
    of all sizes; a target stops at most_repeats times the source's size and the excess is shared
    again by weight until none is above.  In order of bound over weight the stopped sources come
    first, so the end of that sharing is one pass of running sums.  Sizes of 0 have the target 0.
    """
    place, weight, bound, level, over = fresh(sizes.columns, "place", "weight", "bound", "level", "over")
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weights = F.array(*map(F.lit, cycle))
    rows = (sizes.withColumn(place, F.row_number().over(order))
            .withColumn(weight, F.element_at(weights, (F.pmod(F.col(place) - 1, F.lit(len(cycle))) + 1).cast("int")))
            .withColumn(bound, F.col(size) * most_repeats))
    by_bound = Window.orderBy(F.col(bound) / F.col(weight), place)
    every = Window.partitionBy()
    left = (F.sum(size).over(every) - F.sum(bound).over(by_bound) + F.col(bound)).cast("double")
    waiting = F.sum(weight).over(every) - F.sum(weight).over(by_bound) + F.col(weight)
    rows = rows.withColumn(level, left / waiting)
    rows = rows.withColumn(over, F.col(bound) / F.col(weight) < F.col(level))
    rest = (F.sum(size).over(every) - F.sum(F.when(F.col(over), F.col(bound)).otherwise(0)).over(every)).cast("double")
    final = rest / F.sum(F.when(F.col(over), 0).otherwise(F.col(weight))).over(every)
    return rows.select(source, size, F.when(F.col(over), F.col(bound).cast("double"))
                       .otherwise(final * F.col(weight)).alias("target"))


def size_class(size: Column) -> Column:
    """Classes of like sizes: the binary length and the three digits after the first."""
    digits = F.length(F.bin(size))
    return digits * 8 + F.call_function("shiftright", size, F.greatest(digits - 4, F.lit(0))).bitwiseAND(7)


def mix(df: DataFrame, source: str, size: Column, row_id: str, seed: int = 0, splits: int = 64,
        cycle: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """df with mix_size, mix_source_size, mix_target and mix_copies (how often each row is emitted).

    Rows stand in order of size class, then of id modulo splits, then of id, so that a long document
    is weighed against its like and a source's words come near its target; a source of any size is
    ranked in splits tasks per class.  No row is repeated more than most_repeats times.  A null id
    counts as 0, a null size as 0; a null source is a source of its own; repeated rows are ranked one
    by one; an empty table stays empty.  A new column whose name df has gets underscores before it.
    """
    size_, total, target, copies, key, kind, split, rank, at = fresh(
        df.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_key", "mix_class",
        "mix_split", "mix_rank", "mix_id")
    sized = df.withColumn(size_, F.coalesce(size.cast("long"), F.lit(0)))
    sizes = sized.groupBy(source).agg(F.sum(size_).alias(total))
    shares = targets(sizes, source, total, cycle, most_repeats).select(
        named(F.col(source)).alias(key), total, F.col("target").alias(target))
    keyed = (sized.withColumn(key, named(F.col(source)))
             .withColumn(at, F.coalesce(F.col(row_id).cast("long"), F.lit(0)))
             .withColumn(kind, size_class(F.col(size_)))
             .withColumn(split, F.col(kind) * splits + F.pmod(F.col(at), F.lit(splits))))
    # rows that agree so far are told apart by all their values, so that reruns agree
    values = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    placed = ranked(keyed, [key], split, [at, size_, F.xxhash64(*values)], rank, shares)
    rate = F.when(F.col(total) > 0, F.floor(F.col(target) / F.col(total) * 2**BITS)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, BITS // 4), 16, 10).cast("long")
    crossed = lambda k: F.shiftright(k * rate + offset, BITS)
    taken = crossed(F.col(rank) + 1) - crossed(F.col(rank))
    return placed.select(*df.columns, size_, total, target, taken.alias(copies))


def emitted(mixed: DataFrame, columns: list[str], copies: str = "mix_copies") -> DataFrame:
    """The mix itself: each row as often as copies says."""
    return (mixed.filter(F.col(copies) > 0)
            .select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("mix_copy"))
            .select(*columns))


#: The digest of mix() over documents, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS bound, row_number() OVER (ORDER BY source NULLS LAST) AS place,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - sum(bound) OVER b + bound AS DOUBLE)
                / (sum(weight) OVER () - sum(weight) OVER b + weight) AS level
      FROM w WINDOW b AS (ORDER BY CAST(bound AS DOUBLE) / weight, place)),
o AS (SELECT *, CAST(bound AS DOUBLE) / weight < level AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(bound AS DOUBLE) ELSE
        CAST(sum(source_size) OVER () - sum(CASE WHEN capped THEN bound ELSE 0 END) OVER () AS DOUBLE)
        / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target FROM o),
k AS (SELECT d.*, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS kind FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, ((doc_id % 64) + 64) % 64, doc_id, size) - 1 AS rank
      FROM k),
j AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rank,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
             CAST('0x' || substr(md5('0:' || coalesce('=' || r.source, 'null')), 1, 6) AS BIGINT) AS shift
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * ((((rank + 1) * rate + shift) >> 24) - ((rank * rate + shift) >> 24)) AS BIGINT) AS taken
FROM j
"""
