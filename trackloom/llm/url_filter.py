"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and the beginning of a path; it fits the host, all its subdomains and every path that
begins so.  The longest fitting rule decides.  The trie is broadcast while the rules are few enough, which
is counted; more rules are joined by the keys that a URL can fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.frames import cut, fresh
from trackloom.llm.workers import mapped

#: Rules and bytes of their texts up to which a trie is broadcast (about 100 MB in a worker).
TRIE_RULES, TRIE_BYTES = 100_000, 8 << 20
#: Parts of a key that many URLs share, in the join.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


@dataclass
class Segment:
    """Rules by path below a host: whole segments lead on, the beginning of the next one ends a rule."""

    below: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)
    lengths: list = field(default_factory=list)


@dataclass
class Label:
    """A host label, from the last one of a host inwards."""

    below: dict = field(default_factory=dict)
    paths: Segment | None = None


class Trie:
    """Rules (host, path, verdict).  The longest text wins, of equal ones the one with the longer host; of two
    rules of one host and path the blocking one."""

    def __init__(self, rules) -> None:
        self.root = Label()
        for host, path, verdict in rules:
            self.add(host, path, verdict)

    def add(self, host: str, path: str, verdict: str) -> None:
        label = self.root
        for name in reversed(host.split(".")) if host else ():
            label = label.below.setdefault(name, Label())
        label.paths = segment = label.paths or Segment()
        *whole, begun = path.split("/")
        for name in whole:
            segment = segment.below.setdefault(name, Segment())
        held = segment.ends.get(begun)
        if held is None or verdict == "block":
            segment.ends[begun] = (len(host) + len(path), len(host), host + path, verdict)
        segment.lengths = sorted({len(e) for e in segment.ends}, reverse=True)

    def hosts(self, host: str) -> list[Segment]:
        """The path tries of the host and of all hosts above it."""
        label, found = self.root, [self.root.paths]
        for name in reversed(host.split(".")):
            label = label.below.get(name)
            if label is None:
                break
            found.append(label.paths)
        return [s for s in found if s is not None]

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides, and its verdict."""
        return self.best(self.hosts(host), path.split("/"))

    @staticmethod
    def best(tries: list[Segment], names: list[str]) -> tuple[str, str] | None:
        most = None
        for segment in tries:
            for place, name in enumerate(names, 1):
                # what is begun in this segment; the whole segment leads on
                end = next((e for n in segment.lengths if n <= len(name) and (e := segment.ends.get(name[:n]))), None)
                if end and (most is None or end[:2] > most[:2]):
                    most = end
                if place == len(names) or (segment := segment.below.get(name)) is None:
                    break
        return most and most[2:]


def parsed(rule: Column) -> tuple[Column, Column]:
    """Host and path of a rule text: the path begins at the first /."""
    return F.translate(F.substring_index(rule, "/", 1), UPPER, LOWER), F.regexp_extract(rule, r"(?s)^[^/]*(.*)$", 1)


def single(rules: DataFrame) -> DataFrame:
    """host, path, verdict of rules (rule, verdict), one row a host and path; null rules are left out and of two
    verdicts the block stays."""
    host, path = parsed(F.col("rule"))
    return rules.filter("rule IS NOT NULL AND verdict IN ('allow', 'block')").select(host.alias("host"), path.alias("path"), "verdict").groupBy(
        "host", "path").agg(F.max("verdict").alias("verdict"))


def judged(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", most: int = TRIE_RULES) -> DataFrame:
    """df with host, path, rule and verdict.

    rules has rule (host and path in one text, as example.org/es/) and verdict (allow or block).  A null URL and
    one without :// have an empty host and path, which only a rule without host and path fits; where no rule
    fits, rule is null and the verdict is otherwise.  Rows, repeated ones too, pass one to one; a new column
    whose name df has gets underscores before it; no rules and no rows are allowed.
    """
    host, path, rule, verdict = fresh(df.columns, "host", "path", "rule", "verdict")
    own = cut(single(rules))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    addressed = df.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    if size["n"] <= most and size["bytes"] <= TRIE_BYTES:
        return by_trie(addressed, own, host, path, rule, verdict, otherwise)
    return by_join(addressed, own, host, path, rule, verdict, otherwise)


def by_trie(df: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str, otherwise: str) -> DataFrame:
    """One pass over Arrow batches with the trie of all rules, which are few."""
    trie = df.sparkSession.sparkContext.broadcast(Trie((r["host"], r["path"], r["verdict"]) for r in rules.collect()))
    schema = T.StructType([*df.schema.fields, T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())])
    at = df.columns.index(host), df.columns.index(path)

    def run(batches):
        for batch in batches:
            tries: dict[str, list[Segment]] = {}
            found = []
            for own, rest in zip(*(batch.column(k).to_pylist() for k in at)):
                if own not in tries:
                    tries[own] = trie.value.hosts(own)
                found.append(Trie.best(tries[own], rest.split("/")) or (None, otherwise))
            columns = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return mapped(df, run, schema)


def by_join(df: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str, otherwise: str) -> DataFrame:
    """Rules of any number, by equi-joins on what a distinct host and path can fit.

    A URL has a key for each host above it and each whole beginning of its path.  The lengths of what rules
    begin after such a key make the second key, a rule's own host and path.  Every key has one row on the side
    of the rules, which is repeated SALTS times, so that a key shared by a third of the URLs is many tasks.
    """
    urls = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.array(F.lit("")))
    names = F.split("p", "/")
    stems = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(
        F.concat(F.array_join(F.slice(names, 1, k - 1), "/"), F.when(k > 1, "/").otherwise("")).alias("stem"), F.element_at(names, k).alias("begun")))
    salt = F.pmod(F.xxhash64("h", "p"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    keys = urls.select("h", "p", salt.alias("salt"), F.explode(F.array_distinct(above)).alias("host")).select("*", F.explode(stems).alias("s")).select(
        "h", "p", "salt", "host", "s.stem", "s.begun")
    stem = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    lengths = rules.select("host", stem.alias("stem"), (F.char_length("path") - F.char_length(stem)).alias("n")).groupBy("host", "stem").agg(
        F.collect_set("n").alias("lengths")).withColumn("salt", every)
    tried = keys.join(lengths, ["host", "stem", "salt"]).select("h", "p", "salt", "host", "stem", "begun", F.explode("lengths").alias("n")).filter(
        F.col("n") <= F.char_length("begun"))
    fitting = tried.select("h", "p", "salt", "host", F.concat("stem", F.expr("substring(begun, 1, n)")).alias("path")).join(
        rules.withColumn("salt", every), ["host", "path", "salt"])
    rank = F.struct((F.char_length("host") + F.char_length("path")).alias("a"), F.char_length("host").alias("b"))
    best = fitting.groupBy("h", "p").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), rank).alias("best"))
    # rows of one URL, however many, meet one row of it in many tasks
    part = fresh(df.columns, "part")[0]
    dealt = df.withColumn(part, F.floor(F.rand(5) * SALTS).cast("int"))
    met = dealt.join(best.withColumn("part_", every), (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")) & (F.col(part) == F.col("part_")), "left")
    return met.select(*df.columns, F.col("best.rule").alias(rule), F.coalesce("best.verdict", F.lit(otherwise)).alias(verdict))


#: The registered query's rules and rows, for DuckDB.
ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT u.host, u.path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = h OR suffix(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.host, u.path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
