"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle is hashed once: the top bits name its bin, and a bin keeps its smallest hash.  A bin
without shingles borrows, by optimal densification, the value of the first bin with one that its own
probe sequence names.  The low bits of all bins are the fingerprint; the share of equal ones,
corrected for chance agreement, estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.folds import below
from trackloom.llm.frames import cut, fresh

#: Bins, bits kept of each, words of a shingle.
BINS, BITS, SHINGLE = 256, 4, 5
#: The probes of a bin are this many hashed bins, then all bins in the order of a hash with it.
PROBES = 6
_BELOW = (1 << 56) - 1


def held(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas otherwise compute what they enclose again and again."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of the runs of so many words (split at U+0020 and U+0009..U+000D, in lower case); a text
    of fewer words is one shingle, the empty text too."""
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    coded = F.transform(tokens, lambda w: F.xxhash64(w))
    runs = lambda c: F.when(
        F.size(c) < words, F.array(F.xxhash64(F.array_join(F.transform(c, lambda x: x.cast("string")), " ")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - words, F.lit(0))),
                            lambda i: F.xxhash64(*(c[i + k] for k in range(words)))))
    return held(coded, runs)


def _signed(bin_: int) -> int:
    """The largest hash of a bin, bins in the order of signed numbers; stands for a bin without shingles."""
    return ((bin_ - BINS // 2) << 56) + _BELOW


def bins(hashes: Column) -> Column:
    """The smallest hash of each bin without its top bits, null where no shingle fell in the bin."""
    ends = F.array(*(F.lit(_signed(b)).cast("long") for b in range(BINS)))
    top = lambda h: F.shiftright(h, 56)
    firsts = lambda s: F.filter(s, lambda h, i: (i == 0) | (top(h) != top(s[F.greatest(i - 1, F.lit(0))])))
    low = lambda h: F.when(h.bitwiseAND(F.lit(_BELOW)) != _BELOW, h.bitwiseAND(F.lit(_BELOW)))
    return F.transform(held(F.sort_array(F.concat(hashes, ends)), firsts), low)


def densified(values: Column) -> Column:
    """All bins filled: an empty one copies the first filled bin of its probe sequence, which depends on the bin
    alone.  The sequence is PROBES hashed bins, then every bin in the order of its hash with the empty one, so
    that it reaches each bin and no sequence is broken off; the first filled one of the latter is the filled
    bin with the smallest hash, found in one round however few bins are filled."""
    def fill(v: Column, filled: Column) -> Column:
        probe = lambda i, a: v[F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")]
        drawn = lambda i: F.array_min(F.transform(filled, lambda f: F.struct(
            F.xxhash64(i, f["bin"]).alias("hash"), f["low"].alias("low"))))["low"]
        return F.transform(v, lambda x, i: F.coalesce(x, *(probe(i, a) for a in range(PROBES)), drawn(i)))

    def both(v: Column) -> Column:
        placed = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("bin"), x.alias("low"))),
                          lambda f: f["low"].isNotNull())
        return held(placed, lambda filled: fill(v, filled))

    return held(values, both)


def fingerprint(text: Column) -> Column:
    """The packed low bits of all bins, as BINS * BITS / 4 hexadecimal digits.  Null counts as empty.

    The bits are taken of a hash of value and bin: bins that copy one value agree by chance each on its own.
    """
    filled = densified(bins(shingles(F.coalesce(text, F.lit("")))))
    return F.lower(F.array_join(F.transform(filled, lambda x, i: F.hex(
        F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1)))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1, corrected for bins that agree by chance."""
    same = F.aggregate(F.zip_with(F.split(a, "", BINS), F.split(b, "", BINS), lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda n, x: n + x)
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def with_next(docs: DataFrame, row_id: str, columns: list[str], parts: int) -> DataFrame:
    """docs, distinct row by row, with next_<column>: the values of the next row in descending row_id, after
    the last row those of the first; rows of one id stand in order of columns.

    Rows are dealt into ranges of ids between quantiles, a few per shuffle partition, so that they hold as
    many rows each wherever the ids lie; a null id is below all others.  The rows that a range lacks are the
    ones of the largest id below it; per range one id is gathered, so the broadcast has at most `parts` rows,
    and those rows are sent along to the range above.
    """
    bucket, edge, target, copied = fresh(docs.columns, "bucket", "edge", "target", "copied")
    shares = ", ".join(f"{k / parts:.9f}D" for k in range(1, parts)) or "0.5D"
    # one row with at most `parts` numbers
    bounds = docs.filter(F.col(row_id).isNotNull()).agg(
        F.expr(f"percentile_approx(`{row_id}`, array({shares}), {max(10_000, 4 * parts)})").alias("bounds"))
    bounds = bounds.select(F.coalesce("bounds", F.array().cast(bounds.schema[0].dataType)).alias("bounds"))
    low = cut(bounds).scalar()
    dealt = docs.select("*", low.alias(edge)).selectExpr(
        *(f"`{c}`" for c in docs.columns), f"if(`{row_id}` is null, 0, {below(edge, f'`{row_id}`')}) as {bucket}")
    ranges = dealt.groupBy(F.col(bucket).alias(target)).agg(F.max(row_id).alias("top"))
    by_range = Window.orderBy(target)
    edges = ranges.select(target, F.coalesce(F.lag("top").over(by_range), F.max("top").over(
        by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(edge))
    # edges has at most `parts` rows of two numbers
    tagged = dealt.join(F.broadcast(edges), F.col(row_id).eqNullSafe(F.col(edge)), "left")
    sent = tagged.select(*docs.columns, F.explode(F.array_compact(F.array(
        F.struct(F.col(bucket), F.lit(0).alias(copied)),
        F.when(F.col(target).isNotNull(), F.struct(F.col(target).alias(bucket), F.lit(1).alias(copied)))))).alias("to"))
    spread = sent.select(*docs.columns, F.col("to")[bucket].alias(bucket), F.col("to")[copied].alias(copied))
    order = Window.partitionBy(bucket).orderBy(F.desc(copied), row_id, *columns)
    looked = spread.select("*", *(F.lag(c).over(order).alias(f"next_{c}") for c in columns))
    return looked.filter(F.col(copied) == 0).drop(bucket, copied)


def compared(docs: DataFrame, row_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its code points replaced by as many first ones of the next
    row's text.  Null texts count as empty, null ids as the smallest; a single row is its own next one.
    Equal texts have equal fingerprints.
    """
    if parts is None:
        parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(row_id, F.coalesce(F.col(text), F.lit("")).alias("t"))
    printed = own.withColumn("p", fingerprint(F.col("t")))
    pairs = with_next(printed, row_id, ["t", "p"], parts)
    length = F.char_length("t")
    part = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), length - part), F.substring(F.col("next_t"), F.lit(1), part))
    read = pairs.select(row_id, length.cast("long").alias("n_chars"), edited.alias("e"), "p", "next_p")
    printed = read.select("*", F.sha2("e", 256).alias("edited_sha256"), fingerprint(F.col("e")).alias("q"))
    return printed.select(row_id, "n_chars", "edited_sha256", F.col("p").alias("fingerprint"),
                          F.col("q").alias("edited_fingerprint"), likeness(F.col("p"), F.col("q")).alias("near_edited"),
                          likeness(F.col("p"), F.col("next_p")).alias("near_next"))
