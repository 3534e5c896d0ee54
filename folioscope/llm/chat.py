"""Chat formatting of reply trees with DataFrame functions only.

Root-to-leaf paths come from self-joins that double their reach: after k rounds every leaf knows its
ancestors up to 2^k - 1 steps away, so a conversation of n turns takes log2(n) rounds. Branches are ranked
by the sum of their turns' scores, and each chosen path becomes one string:

    <s>[ROLE]user[/ROLE][INST]text[/INST]</s>[ROLE]assistant[/ROLE]text</s>...

Inside roles and texts a backslash is doubled, and a backslash follows the first character of each
control string, so control strings of the template cannot occur there and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint

BEGIN, END, ROLE, ROLE_END, ASK, ASK_END = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees without branches: tree, node, parent, role, text, score.

    Rows follow turn (null first), then role and text; repeated rows are turns of their own.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(turns[conv].alias("tree"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
    node = F.row_number().over(order).cast("long")
    return rows.select("tree", node.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """tkey, leaf, node, back (steps from the leaf) for each leaf and each of its ancestors, itself included.

    nodes: tkey, node, parent. A parent that is not there makes its child a root. Raises ValueError if parents
    run in a circle, below a leaf or without one.
    """
    here = nodes.select("tkey", F.col("node").alias("parent"))
    jump = checkpoint(nodes.select("tkey", "node", "parent").join(here.distinct(), ["tkey", "parent"], "left_semi").select("tkey", "node", F.col("parent").alias("up")))
    leaves = nodes.select("tkey", "node").join(nodes.select("tkey", F.col("parent").alias("node")), ["tkey", "node"], "left_anti")
    found = checkpoint(leaves.select("tkey", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")))
    reach, limit = 1, 2 * nodes.count() + 2
    while True:
        if reach > limit:
            raise ValueError("parents run in a circle")
        more = checkpoint(found.join(jump, ["tkey", "node"]).select("tkey", "leaf", F.col("up").alias("node"), (F.col("back") + reach).alias("back")))
        if more.isEmpty():
            break
        found = checkpoint(found.unionByName(more))
        jump = checkpoint(jump.join(jump.select("tkey", F.col("node").alias("up"), F.col("up").alias("top")), ["tkey", "up"]).select("tkey", "node", F.col("top").alias("up")))
        reach *= 2
    # a node that no leaf's path has met hangs below no root: its parents run in a circle
    if nodes.count() and not nodes.select("tkey", "node").join(found.select("tkey", "node"), ["tkey", "node"], "left_anti").isEmpty():
        raise ValueError("parents run in a circle")
    return found


def format_trees(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """tree, leaf, branch (rank by score, ties to the smaller leaf), score, formatted, loss_spans.

    nodes: tree, node, parent, role, text, score; other columns are not looked at. Nodes are unique in
    their tree; parents that run in a circle raise ValueError. Null texts and roles are empty, a null score is 0, a null tree is a tree of its own, an empty
    table gives no rows. top keeps that many best branches of a tree (all if None). loss_spans
    holds (start, length) in code points, from 1, of each assistant text inside formatted, still escaped.
    """
    tkey = F.struct(F.col("tree").isNull().alias("no"), F.col("tree").alias("tree"))
    rows = checkpoint(
        nodes.select("tree", tkey.alias("tkey"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
    path = paths(rows.select("tkey", "node", "parent"))
    ranked = None
    if top is not None:
        sums = path.join(rows.select("tkey", "node", "score"), ["tkey", "node"]).groupBy("tkey", "leaf").agg(F.sum("score").alias("total"))
        order = Window.partitionBy("tkey").orderBy(F.desc("total"), "leaf")
        ranked = sums.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= top)
        path = path.join(ranked.select("tkey", "leaf"), ["tkey", "leaf"], "left_semi")
    asks = F.col("role") == "user"
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END), F.when(asks, F.lit(ASK)).otherwise(F.lit("")))
    turn = F.concat("head", "body", F.when(asks, F.lit(ASK_END)).otherwise(F.lit("")), F.lit(END))
    turns = path.join(rows, ["tkey", "node"]).select("tree", "tkey", "leaf", "back", "score", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.select("tree", "tkey", "leaf", "back", "score", "role", turn.alias("turn"), F.length("head").alias("head_n"), F.length("body").alias("body_n"))
    so_far = F.sum(F.length("turn")).over(Window.partitionBy("tkey", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = turns.withColumn("start", so_far - F.length("turn") + F.col("head_n") + len(BEGIN) + 1)
    item = F.struct((-F.col("back")).alias("at"), "turn", "start", "body_n", (F.col("role") == "assistant").alias("loss"))
    whole = placed.groupBy("tkey", "leaf").agg(F.first("tree").alias("tree"), F.sum("score").alias("score"), F.sort_array(F.collect_list(item)).alias("items"))
    spans = F.transform(F.filter("items", lambda x: x["loss"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["body_n"].cast("long").alias("length")))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("items", lambda x: x["turn"]), ""))
    order = Window.partitionBy("tkey").orderBy(F.desc("score"), "leaf")
    out = whole.select("tree", "tkey", "leaf", "score", text.alias("formatted"), spans.alias("loss_spans"))
    return out.select("tree", "leaf", F.row_number().over(order).alias("branch"), "score", "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, leaf, turns (array of role and text), loss_text, formatted: undone from formatted and loss_spans alone."""
    pieces = F.split(F.substr(F.col("formatted"), F.lit(len(BEGIN) + 1)), END)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(ROLE) + 1)), ROLE_END, 1)
        body = F.substr(piece, F.length(role) + len(ROLE) + len(ROLE_END) + 1)
        asked = F.substr(body, F.lit(len(ASK) + 1), F.greatest(F.length(body) - len(ASK) - len(ASK_END), F.lit(0)))
        return F.struct(unescape(role).alias("role"), unescape(F.when(body.startswith(ASK), asked).otherwise(body)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.select("tree", "leaf", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
