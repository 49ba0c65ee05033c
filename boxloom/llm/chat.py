"""Reply trees to conversations: ranked root-to-leaf paths, one formatted text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import written

#: Marks of the template, and the escape that stands for each inside a text.
OPEN, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
ESCAPES = [("\\", "\\b"), ("</s>", "\\e"), ("<s>", "\\s"), ("[/INST]", "\\j"), ("[INST]", "\\i")]


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """Replace every control string. Each backslash of the result starts a two-letter code."""
    for plain, code in ESCAPES:
        text = _swap(text, plain, code)
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = _swap(text, code, plain)
    return text


def chain_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as a tree without branches: each row replies to the row before it.

    Order: turn, role, text, nulls first. Repeated rows are turns of their own.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def root_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Chosen root-to-leaf paths of reply trees: ``tree``, ``leaf``, ``rank``, ``score``, ``node``, ``depth`` (root: 0).

    ``nodes``: ``tree``, ``node``, ``parent`` (null at a root), ``score``. Iterated self-joins double the
    distance that each node looks up, so a tree of depth d takes log2(d) joins on (tree, node) going up,
    which give every leaf its branch score (the sum over its path), and as many going down, which list
    the nodes of the chosen leaves only. Branches of a tree are ranked by score, then by the smaller leaf;
    ``top`` paths stay (None: all). Only ids are joined, texts come last.

    Defined results: a parent that the tree lacks makes a root. A null score counts 0, a null tree is a
    tree of its own, rows without node are left out. Of rows that repeat a node the one with the largest
    score, then the smallest parent, counts. Nodes on or below a cycle have no root and are on no path.
    """
    ids = nodes.filter(F.col("node").isNotNull()).select(
        F.col("tree").isNull().alias("t0"), F.coalesce(F.col("tree"), F.lit(0)).alias("t"), F.col("node"), F.col("parent"),
        F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"),
    )
    ids = ids.groupBy("t0", "t", "node").agg(F.min(F.struct(-F.col("score"), F.col("parent"))).alias("b")).select(
        "t0", "t", "node", F.col("b.parent").alias("parent"), (-F.col("b.col1")).alias("score")
    )
    ids = written(ids, "nodes")
    key = ["t0", "t", "node"]
    own = ids.select("t0", "t", F.col("node").alias("parent"), F.lit(True).alias("found"))
    step = ids.join(own, ["t0", "t", "parent"], "left").select(
        *key, F.when(F.col("found"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("hops")
    )
    step = written(step, "step")
    levels = [step]
    most = max(1, ids.count()).bit_length()
    # after k rounds `up` is the 2^k-th ancestor; null: the path to the root is summed up
    while len(levels) <= most and not step.filter("up IS NOT NULL").isEmpty():
        over = step.select("t0", "t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("hops").alias("h2"))
        step = step.join(over, ["t0", "t", "up"], "left").select(
            *key, F.col("up2").alias("up"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
        )
        step = written(step, "step")
        levels.append(step)
    rooted = step.filter("up IS NULL")
    inner = levels[0].filter("up IS NOT NULL").select("t0", "t", F.col("up").alias("node"))
    leaves = rooted.join(inner, key, "left_anti")
    if top is None:
        rank = F.row_number().over(Window.partitionBy("t0", "t").orderBy(F.desc("score"), "node"))
        chosen = leaves.withColumn("rank", rank)
    elif top == 1:
        best = leaves.groupBy("t0", "t").agg(F.min(F.struct(-F.col("score"), F.col("node"), F.col("hops"))).alias("b"))
        chosen = best.select("t0", "t", F.col("b.node").alias("node"), (-F.col("b.col1")).alias("score"), F.col("b.hops").alias("hops"), F.lit(1).alias("rank"))
    else:
        rank = F.row_number().over(Window.partitionBy("t0", "t").orderBy(F.desc("score"), "node"))
        chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= top)
    paths = chosen.select("t0", "t", F.col("node").alias("leaf"), "rank", "score", "node", (F.col("hops") - 1).alias("depth"))
    for k in range(len(levels) - 2, -1, -1):
        jump = levels[k].filter("up IS NOT NULL").select(*key, "up")
        higher = paths.join(jump, key).select(
            "t0", "t", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        paths = written(paths.unionByName(higher), "paths")
    return paths.select(F.when(~F.col("t0"), F.col("t")).alias("tree"), "leaf", "rank", "score", "node", "depth")


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One text per path: ``tree``, ``leaf``, ``rank``, ``formatted``, ``loss`` (spans of the assistant's texts).

    A turn is ``<s>[INST]role[/INST]text</s>`` with the control strings of role and text escaped. A span
    is (start, length) in code points, start from 0, and holds one escaped text without its marks. A null
    role or text is empty. A conversation becomes one value, so its turns meet in one row.
    """
    texts = nodes.filter(F.col("node").isNotNull()).select(
        F.col("tree").isNull().alias("t0"), F.coalesce(F.col("tree"), F.lit(0)).alias("t"), "node",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).dropDuplicates(["t0", "t", "node"])
    on = paths.select(
        F.col("tree").isNull().alias("t0"), F.coalesce(F.col("tree"), F.lit(0)).alias("t"), "leaf", "rank", "node", "depth"
    )
    turn = on.join(texts, ["t0", "t", "node"]).select(
        "t0", "t", "leaf", "rank", "depth",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END)).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"),
    )
    talk = turn.groupBy("t0", "t", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))

    def add(state, turn):
        begin = state.at + F.length(turn.head)
        span = F.struct(begin.cast("long").alias("start"), F.length(turn.body).cast("long").alias("length"))
        spans = F.when(turn.learn, F.concat(state.spans, F.array(span))).otherwise(state.spans)
        return F.struct((begin + F.length(turn.body) + len(TURN_END)).cast("long").alias("at"), spans.alias("spans"))

    return talk.select(
        F.when(~F.col("t0"), F.col("t")).alias("tree"), "leaf", "rank",
        F.concat_ws("", F.transform("turns", lambda x: F.concat(x.head, x.body, F.lit(TURN_END)))).alias("formatted"),
        F.aggregate("turns", start, add).spans.alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, TURN_END, -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, ROLE_END, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(x, F.locate(ROLE_END, x) + F.lit(len(ROLE_END)))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))))
