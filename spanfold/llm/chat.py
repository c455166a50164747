r"""Reply trees: the best branches from root to leaf, each formatted as one conversation.

Template of a turn: ``### role: text</turn>\n``. Inside roles and texts ``\s``, ``\h`` and ``\l`` stand for a backslash,
``#`` and ``<``, and ``\c`` for ``:`` in roles, so that no text can hold a control string and the output reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

# Fixed values of the template.
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"


# What stands for a character inside roles and texts, the backslash first. No escape holds another.
_ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _escape(x: Column, role: bool = False) -> Column:
    for plain, escaped in _ESCAPES if role else _ESCAPES[:3]:
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def _unescape(x: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return x


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, score, depth, role, text): the messages of the ``top`` best branches of each root.

    ``messages`` has tree, id, parent (null at a root), role, text and score (null: 0); ids are unique strings. A
    branch's score is the mean of its messages' scores; ties go to the deeper branch, then to the smaller leaf id. A
    message whose parent does not exist starts a tree of its own. Messages on a cycle have no root and give no branch.

    Self-joins double the distance that each message has looked up: after k of them it knows its ancestor 2^k above
    and the sum of scores up to there. So a thread of depth d takes log2(d) joins of linear size. The chosen leaves
    then walk down the saved jumps, and only their own paths are written out.
    """
    scratch = Scratch(messages.sparkSession)
    rows = messages.select("tree", "id", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    up = scratch.write(
        rows.join(ids, "parent", "left").select(
            "id",
            F.when(F.col("known"), F.col("parent")).alias("up"),
            F.col("score").alias("total"),
            F.lit(1).cast("long").alias("n"),
            F.col("id").alias("root"),
        ),
        "up",
    )
    jumps, most = [up], rows.count()
    # n: messages from this one up to, not including, ``up``. root: the last of them.
    while len(jumps) <= max(1, most).bit_length() and not up.where("up is not null").isEmpty():
        above = up.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
        up = scratch.write(
            up.join(above, "up", "left").select(
                "id",
                F.col("up2").alias("up"),
                (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
                F.coalesce("root2", "root").alias("root"),
            ),
            "up",
        )
        jumps.append(up)
    parents = rows.select(F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = up.where("up is null").join(parents, "id", "left_anti").withColumn("score", F.col("total") / F.col("n"))
    best = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("n"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    path = scratch.write(chosen.select(F.col("id").alias("leaf"), "score", F.col("n").alias("length"), "id", F.lit(0).cast("long").alias("below")), "path")
    for k in range(len(jumps) - 1, -1, -1):
        if not jumps[k].where("up is not null").isEmpty():
            longer = path.unionByName(
                path.join(jumps[k].where("up is not null").select("id", "up", F.col("n").alias("step")), "id").select(
                    "leaf", "score", "length", F.col("up").alias("id"), (F.col("below") + F.col("step")).alias("below")
                )
            )
            longer = scratch.write(longer, "path")
            scratch.drop(path)
            path = longer
        scratch.drop(jumps[k])
    return path.join(rows.drop("score", "parent"), "id").select(
        "tree", "leaf", "score", (F.col("length") - F.col("below") - 1).alias("depth"), "role", "text"
    )


def format_branches(paths: DataFrame) -> DataFrame:
    """One row a branch: tree, leaf, score, formatted and loss_spans, the code points [start, end) of assistants' texts.

    A null role or text counts as empty. One conversation becomes one value, so its turns meet in one task; where a turn
    begins is a running sum, so the cost is linear in the turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), _escape(role, True), F.lit(AFTER_ROLE))
    turns = paths.select(
        "tree", "leaf", "score", "depth", head.alias("head"), _escape(text).alias("body"), (role == "assistant").alias("learn")
    )
    width = F.length("head") + F.length("body") + len(END)
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("end", (F.sum(width).over(so_far) - len(END)).cast("int"))
    turn = F.struct("depth", "head", "body", "learn", "end")
    turns = turns.groupBy("tree", "leaf").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct((t["end"] - F.length(t["body"])).alias("start"), t["end"].alias("end")))
    return turns.select(
        "tree",
        "leaf",
        "score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The rows of :func:`format_branches` with turns (role, text) and learned, the texts under the loss mask."""
    parts = F.filter(F.split("formatted", END), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(len(HEAD) + 1), F.length(x))
    role = lambda x: F.substring_index(body(x), AFTER_ROLE, 1)  # noqa: E731  a role holds no colon
    turns = F.transform(
        parts,
        lambda x: F.struct(
            _unescape(role(x)).alias("role"),
            _unescape(F.substring(body(x), F.length(role(x)) + 1 + len(AFTER_ROLE), F.length(x))).alias("text"),
        ),
    )
    learned = F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def reply_tree(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: a row answers the one before it, by turn, then role and text.

    Rows without a conv_id form one tree; repeated rows stay separate turns.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "role", "text", tree.alias("tree"), at.alias("at"))
    name = lambda i: F.concat(F.col("tree"), F.lit("/"), i.cast("string"))
    return rows.select(
        "tree", name(F.col("at")).alias("id"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def op5_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the hard one, formatted and read back. An empty table leaves the hard one, long texts are
    taken whole, rows without a conv_id are one conversation with a null id, and other columns are ignored."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    back = read_back(format_branches(branches(reply_tree(rows))))
    learned = F.array_join("learned", "")
    return back.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
