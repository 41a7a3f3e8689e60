"""Chat formatting of reply trees, with DataFrame functions only.

Paths from leaves to roots are enumerated by self-joins of ancestor tables that double their reach, so
that a path of n messages takes log2(n) rounds; branches are ranked by the scores summed along them in as
many rounds, and each chosen path is formatted as one conversation with the spans of its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.folds import each, let, running, struct
from trackloom.llm.frames import cut, named

# The template's control strings and the escapes of the characters they need.
OPEN, CLOSE = "<turn>", "</turn>\n"
ESCAPES = [("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")]


def escaped(text: Column) -> Column:
    """A text in which no control string can occur: '<' and '[' are written \\l and \\b, a backslash twice."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of escaped: doubled backslashes are set apart first, then the other codes are undone."""
    def part(p: Column) -> Column:
        for plain, code in ESCAPES[1:]:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up) of the ancestor 1, 2, 4, ... messages up, as far as any path reaches.

    nodes: tree, node, parent with parents that exist; a cycle ends after as many rounds as there are
    messages to double over.
    """
    reach = cut(nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up")))
    tables, most = [], nodes.count()
    while 1 << len(tables) <= most and not reach.isEmpty():
        tables.append(reach)
        onward = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
        reach = cut(reach.join(onward, ["tree", "up"]).select("tree", "node", F.col("further").alias("up")))
    return tables


def linked(messages: DataFrame) -> DataFrame:
    """(tree, node, parent): messages with an id, whose parents exist or are null."""
    rows = messages.select("tree", "node", "parent").filter("tree IS NOT NULL AND node IS NOT NULL")
    present = rows.select("tree", F.col("node").alias("parent"), F.lit(1).alias("found"))
    return cut(rows.join(present, ["tree", "parent"], "left")
               .select("tree", "node", F.when(F.col("found") == 1, F.col("parent")).alias("parent")))


def leaves(nodes: DataFrame) -> DataFrame:
    """(tree, node): nodes that are nobody's parent."""
    inner = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    return nodes.join(inner, ["tree", "node"], "left_anti").select("tree", "node")


def means(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(tree, node, mean): the mean score (tree, node, score) of the path from the root to each node.

    Sums double their reach each round, so that no path is enumerated; nodes on and under a cycle have none.
    """
    reach = cut(nodes.join(scores, ["tree", "node"]).select(
        "tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")))
    rounds, most = 0, nodes.count()
    while 1 << rounds <= 2 * most and not reach.filter("up IS NOT NULL").isEmpty():
        above = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("n").alias("m"))
        reach = cut(reach.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        rounds += 1
    return reach.filter("up IS NULL").select("tree", "node", (F.col("total") / F.col("n")).alias("mean"))


def paths(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, position) of the path of each of ends (tree, node); position counts upwards.

    nodes: see linked().  Ends under a cycle have no path of their own: they are none of its leaves.
    """
    found = ends.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("position"))
    tables = ancestors(nodes)
    for k in reversed(range(len(tables))):
        # each row stays and, where there is an ancestor 2^k up, is joined by it: the plan grows by one join a round
        reached = found.join(tables[k], ["tree", "node"], "left")
        found = reached.select("tree", "leaf", F.explode(F.array_compact(F.array(
            F.struct("node", "position"),
            F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("position") + (1 << k)).alias("position")))))).alias("at"))
        found = found.select("tree", "leaf", "at.node", "at.position")
    return found


def conversations(messages: DataFrame, branches: int | None = None, answered: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen path: tree, leaf, branch, score, formatted, loss_spans.

    messages: tree, node (unique in its tree), parent, role, text, score.  A null tree is a tree of its own;
    a parent that is not there makes its child a root; rows whose node is null, and leaves under a cycle,
    have no path.  A branch's score is the mean of its messages' (null: 0); the branches of a tree are ranked
    by it, then by leaf, before any path is enumerated, and the first `branches` are formatted (all by
    default).  A turn is OPEN, the role, a line feed, the text and CLOSE, with roles and texts escaped (null:
    empty).  loss_spans: start and end, in code points of formatted, of the text of each turn whose role is
    `answered`, in order.
    """
    own, keyed = F.col("tree"), messages.withColumn("key", named(F.col("tree")))
    said = keyed.select(F.col("key").alias("tree"), own.alias("own"), "node", F.coalesce(F.col("role"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = linked(keyed.select(F.col("key").alias("tree"), "node", "parent"))
    ends = leaves(nodes)
    if branches is not None:
        scored = ends.join(means(nodes, said.select("tree", "node", "score")), ["tree", "node"])
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "node"))
        ends = scored.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", "node")
    along = paths(nodes, ends).join(said, ["tree", "node"])
    turn = F.struct((-F.col("position")).alias("at"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")).alias("role"),
                    escaped(F.col("text")).alias("text"), (F.col("role") == answered).alias("answer"))
    grouped = along.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.avg("score").alias("score"), F.first("own").alias("own"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return grouped.select(F.col("own").alias("tree"), "leaf", rank.alias("branch"), "score", formatted.alias("formatted"),
                          F.expr(masked("turns")).alias("loss_spans"))


def masked(turns: str) -> str:
    """SQL text: start and end of the text of each answer among turns (role, text, answer), as they are formatted."""
    heads = len(OPEN) + 1
    lengths = each(turns, lambda t: f"{heads + len(CLOSE)} + char_length({t}.role) + char_length({t}.text)")

    def spans(ends: str) -> str:
        every = each(turns, lambda t, i: let(f"if({i} = 0, 0, {ends}[{i} - 1]) + {heads} + char_length({t}.role)", lambda at: (
            f"if({t}.answer, {struct(start=at, end=f'{at} + char_length({t}.text)')}, null)")))
        return f"array_compact({every})"

    return let(running(lengths, lambda a, x: f"{a} + {x}"), spans)


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of role, text."""
    pieces = F.filter(F.split(formatted, CLOSE.replace("/", "\\/"), -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.char_length(role(p)) + 2, F.char_length(p))
        name = F.substring(role(p), len(OPEN) + 1, F.char_length(role(p)))
        return F.struct(_role(name).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def _role(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, r"\\\\", -1), lambda p: F.replace(
        F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chained(rows: DataFrame, tree: str, turn: str) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it, by turn, role, text."""
    order = Window.partitionBy(tree).orderBy(turn, "role", "text")
    numbered = rows.select(F.col(tree).alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn(
        "score", F.lit(None).cast("double"))
