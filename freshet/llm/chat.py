"""Reply trees as formatted conversations.

Messages point to their parents.  Self-joins that double the reach each time (a node's ancestor
at distance 1, 2, 4, ...) give every node its root, its depth and the sum of scores on its path, and
then, for the chosen leaves alone, all nodes of their root-to-leaf paths; the number of joins
grows with the logarithm of the depth.  Branches of a tree are ranked by their mean score.

Template: ``### role``, the text, ``</turn>``, each ended by a line break.  Inside roles and texts a
backslash becomes ``\\b``, ``#`` ``\\h`` and ``<`` ``\\l`` (in roles a line break ``\\n``), so neither
control string can occur there and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, written

OPEN, CLOSE = "### ", "\n</turn>\n"
#: What is escaped in texts, the backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ASSISTANT = "assistant"


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, ESCAPES)


def unescape(c: Column) -> Column:
    return _replaced(c, [(new, old) for old, new in reversed(ESCAPES)])


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def as_trees(rows: DataFrame) -> DataFrame:
    """Turns as messages: each answers the one before it.

    ``rows`` has conv_id, turn, role, text.  Equal turns follow each other by role and text, null turns
    come first; repeated rows are turns of their own.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(by).cast("long")
    return rows.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("tree"), place.alias("node"),
        F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, node, above`` for the ``branches`` best root-to-leaf paths of each tree.

    ``messages`` has tree, node, parent, score; (tree, node) is unique, a null or unknown parent makes
    a root, a null score counts 0.  Paths rank by mean score, then by leaf.  ``above`` is the distance to
    the leaf.  Messages on a cycle lead to no root and are left out.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    steps = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"),
        F.lit(1).cast("long").alias("depth"), "score",
    )
    base = cut(steps)
    jumps, reach = [], base
    limit = base.count()
    # after each join ``up`` is twice as far; a node is done when its ``up`` is null
    while (1 << len(jumps)) <= max(1, limit) and reach.where("up is not null").limit(1).count():
        jumps.append(reach.select("tree", "node", "up"))
        over = reach.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("down")
        )
        reach = cut(
            reach.join(over, ["tree", "up"], "left").select(
                "tree", "node", F.col("far").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
                (F.col("depth") + F.coalesce("down", F.lit(0))).alias("depth"), "score",
            )
        )
    rooted = reach.where("up is null")
    inner = base.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    by = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), "node")
    best = leaves.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= branches)
    found = best.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps):
        hop = jump.where("up is not null")
        found = cut(
            found.unionByName(
                found.join(hop, ["tree", "node"]).select(
                    "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")
                )
            )
        )
    return found


def format_paths(messages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per path: ``tree, leaf, rank, n_turns, formatted, loss`` (code point spans).

    The loss mask holds the texts of assistant turns, as escaped, without marks.  A null role or text
    counts as empty.  Offsets count code points.
    """
    turns = found.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = turns.select("tree", "leaf", "rank", "above", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("above").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")) + F.length("head")
    turns = turns.withColumn("start", start)
    span = F.when(F.col("role") == ASSISTANT, F.struct("start", F.length("body").cast("long").alias("length")))
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
            )
        ).alias("turns")
    )
    return rows.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best branches of each reply tree, formatted; see ``paths`` and ``format_paths``.

    Messages without a tree are one tree of their own.
    """
    kind = messages.schema["tree"].dataType
    named = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    messages = written(messages.withColumn("tree", named), "messages")
    made = format_paths(messages, paths(messages, branches))
    return made.withColumn("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 1000).cast(kind)))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, CLOSE.replace("/", "\\/"))
    # what follows the last end mark is empty
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    def turn(p):
        line = F.instr(p, "\n")
        return F.struct(
            unescape_role(F.substring(p, F.lit(len(OPEN) + 1), line - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(p, line + 1, F.length(p))).alias("text"),
        )

    return F.transform(turns, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(parts, "")
