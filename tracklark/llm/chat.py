"""Chat formatting of reply trees, with DataFrame functions only.

Nodes (tree, node, parent, role, text, score) form trees of replies. Root-to-leaf paths come from iterative
self-joins that double: each round joins the path members found so far with the table of jumps, which lead 2^j nodes
up, and joins the jumps with themselves. A path of n nodes takes log2(n) rounds, and only the paths of the branches
asked for are expanded. Branches of a tree rank by the mean score of their nodes, the longer first within ties, then
by the leaf; the best ones are formatted, each as one conversation.

The template puts `<|im_start|>role`, a line break, the text and `<|im_end|>` around each turn. Control strings inside
texts and roles are escaped and `&` with them, so the output can be split and read back exactly. The loss mask of a
conversation lists (start, length) of each assistant text in code points of the output.

Nulls: null texts and roles are empty; a null tree id is a tree of its own; a null score is 0. Repeated rows are turns
of their own in `conversation_nodes`, which chains all rows of a conversation by turn (null turns last), role and
text. A node whose parent is missing is a root; nodes on cycles have no root and so no path. Empty tables give empty
tables. Columns that aren't named are not read. Memory: one conversation is one row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.session import discard, materialize, table

# The template's marks, and control strings that are escaped, `&` first.
TURN, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>"), ("[INST]", "&lsq;INST]"), ("[/INST]", "&lsq;/INST]"))
UNESCAPES = (("&lt;", "<"), ("&lsq;", "["), ("&amp;", "&"))


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for safe, plain in UNESCAPES:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def role_name(role: Column) -> Column:
    """A role that stays in its line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def branch_nodes(nodes: DataFrame, best: int = 1) -> DataFrame:
    """tree, branch (the leaf), rank, and depth, role and text of each node on the `best` best branches of each tree.

    nodes: tree, node (unique over all trees), parent, role, text, score.
    """
    spark = nodes.sparkSession
    held, held_path = materialize(
        nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    )
    known = held.select(F.col("node").alias("parent"))
    links = held.select("node", "parent", "score").join(known, "parent", "left_semi").unionByName(
        held.select("node", "parent", "score").join(known, "parent", "left_anti").withColumn("parent", F.lit(None).cast(held.schema["node"].dataType))
    )
    # up: the node 2^j above, if there is one; score and steps: over this node and those passed.
    jumps, path = materialize(links.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), "score"))
    paths = [held_path, path]
    ended, still = jumps.where("up IS NULL"), jumps.where("up IS NOT NULL")
    levels = [still.select("node", "up")]
    # Only nodes that have not reached their root go on. Nodes at all depths above a node exist, so a round that ends no
    # path leaves cycles only.
    open_before, open_now = -1, still.count()
    while open_now and open_now != open_before:
        above = ended.unionByName(still).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("score").alias("plus"))
        jumps, path = materialize(still.join(above, "up").select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("plus")).alias("score")))
        paths.append(path)
        ended, still = ended.unionByName(jumps.where("up IS NULL")), jumps.where("up IS NOT NULL")
        levels.append(still.select("node", "up"))
        open_before, open_now = open_now, still.count()
    leaves = ended.drop("up").join(held.select(F.col("parent").alias("node")), "node", "left_anti").join(held.select("tree", "node"), "node")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    members = chosen.select("tree", F.col("node").alias("branch"), "rank", "steps", "node", F.lit(0).cast("long").alias("below"))
    for j, jump in enumerate(levels[:-1] if len(levels) > 1 else []):
        # members reach up to 2^j - 1 above the leaf; the jumps of 2^j add as many again.
        members, path = materialize(members.unionByName(members.join(jump, "node").select("tree", "branch", "rank", "steps", F.col("up").alias("node"), (F.col("below") + (1 << j)).alias("below"))))
        paths.append(path)
    out = members.join(held.select("node", "role", "text"), "node").select("tree", "branch", "rank", (F.col("steps") - F.col("below")).alias("depth"), "role", "text")
    done, _ = materialize(out)
    discard(spark, *paths)
    return done


def formatted(branches: DataFrame) -> DataFrame:
    """tree, branch, rank, formatted (one string) and mask (start and length of each assistant text in it)."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda t: F.struct(role_name(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].alias("plain")))
    rows = branches.groupBy("tree", "branch", "rank").agg(turns.alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    # The running length gives where each text starts; only numbers are carried.
    sizes = F.transform("turns", lambda t: F.struct((F.length(t["role"]) + (len(TURN) + 1)).cast("long").alias("head"), F.length(t["text"]).cast("long").alias("text"), (t["plain"] == "assistant").alias("on")))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("mask"))
    step = lambda s, t: F.struct(
        (s["at"] + t["head"] + t["text"] + len(END)).alias("at"),
        F.when(t["on"], F.concat(s["mask"], F.array(F.struct((s["at"] + t["head"]).alias("start"), t["text"].alias("length"))))).otherwise(s["mask"]).alias("mask"),
    )
    return rows.select("tree", "branch", "rank", whole.alias("formatted"), F.aggregate(sizes, first, step, lambda s: s["mask"]).alias("mask"))


def read_back(text: Column) -> Column:
    """The turns of an output: an array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: F.startswith(p, F.lit(TURN)))
    body = lambda p: F.substr(p, F.lit(len(TURN) + 1))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    return F.transform(
        pieces, lambda p: F.struct(unescaped(F.replace(role(p), F.lit("&nl;"), F.lit("\n"))).alias("role"), unescaped(F.substr(body(p), F.length(role(p)) + 2)).alias("text"))
    )


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees without branches: each turn answers the one before it."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    counted = rows.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("k", F.row_number().over(order))
    # A null tree has a mark that no other tree's name starts with.
    name = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("-"))
    node = lambda k: F.concat_ws("/", name, k.cast("string"))
    return counted.select("tree", node(F.col("k")).alias("node"), F.when(F.col("k") > 1, node(F.col("k") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op10_chat_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the output, of all conversations and of one that holds control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(hard).alias("text"))
    out = formatted(branch_nodes(conversation_nodes(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = unescaped(F.array_join(F.transform("mask", lambda m: F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))), ""))
    return out.withColumns({"turns": read_back(F.col("formatted")), "loss": masked}).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    for plain, safe in ESCAPES:
        text = f"replace({text}, '{plain}', '{safe}')"
    return text


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length(replace({_sql_escaped("role")}, chr(10), '&nl;')) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op10_chat_branches": op10_chat_branches}
ORACLES = {"op10_chat_branches": ORACLE}
