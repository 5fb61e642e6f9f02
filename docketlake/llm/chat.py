"""Reply trees to training conversations. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, table

#: The template: every control string starts with "<", which never occurs in an escaped text.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Escapes, applied in this order and undone in reverse order. After escaping, each backslash is
#: followed by its code letter, and "<" and "[" (the first letters of the control strings of the
#: common templates, this one's included) do not occur.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with keys without nulls, each key once: ``_t`` tree, ``_n`` node, ``_p`` parent.

    A null tree_id is a tree of its own. A node without an id can have no answers and is told by its content.
    Of several rows with one key the first by parent, role, text and score counts, so repeated rows are one.
    """
    key = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    alone = F.concat(F.lit("?"), F.sha2(F.concat_ws("\0", key("parent_id"), "role", "text", F.col("score").cast("string")), 256))
    rows = nodes.withColumn("_t", key("tree_id")).withColumn("_n", F.when(F.col("node_id").isNull(), alone).otherwise(key("node_id"))).withColumn("_p", F.when(F.col("parent_id").isNotNull(), key("parent_id")))
    rest = [c for c in rows.columns if c not in ("_t", "_n")]
    first = F.min(F.struct("parent_id", "role", "text", "score", *[c for c in rest if c not in ("parent_id", "role", "text", "score")])).alias("m")
    return rows.groupBy("_t", "_n").agg(first).select("_t", "_n", *[f"m.{c}" for c in rest])


def _climb(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Per node of ``edges`` (_t, _n, _p, score; null _p: a root): ``total`` score and ``depth`` of the path from
    its root. Self-joins double the reach, so a thread of n turns takes log2(n) joins of one row per node.
    A node that never comes to a root (its parents go in a circle) keeps ``_p`` not null; ``least`` is then
    the smallest of its forefathers."""
    state = scratch.put(edges.select("_t", "_n", "_p", F.col("score").alias("total"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("_p").alias("least")), "climb")
    most = edges.groupBy("_t").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < 2 * most and not (going := state.filter(F.col("_p").isNotNull())).isEmpty():
        up = state.select("_t", F.col("_n").alias("_p"), F.col("_p").alias("_further"), F.col("total").alias("_more"), F.col("depth").alias("_deeper"), F.col("least").alias("_less"))
        moved = going.join(up, ["_t", "_p"]).select("_t", "_n", F.col("_further").alias("_p"), (F.col("total") + F.col("_more")).alias("total"), (F.col("depth") + F.col("_deeper")).alias("depth"), F.least("least", "_less").alias("least"))
        grown = scratch.put(state.filter(F.col("_p").isNull()).unionByName(moved), "climb")
        scratch.drop(state)
        state, reach = grown, reach * 2
    return state


def reply_paths(nodes: DataFrame, scratch: Scratch, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees, of each tree the best ``branches`` (None: all).

    ``nodes``: (_t, _n, _p, score), keys as of :func:`_keyed`. A node whose parent is null or missing is a root;
    where parents go in a circle the smallest node of the circle is one. Leaves are ranked by the sum of
    the scores of their path, then by key; only the paths that are chosen are listed, again by joins that
    double their reach. Returns (_t, _leaf, branch, _n, pos): ``pos`` counts from 0 at the root.
    """
    known = nodes.select("_t", F.col("_n").alias("_p"), F.lit(True).alias("_known"))
    edges = nodes.select("_t", "_n", "_p", "score").join(known, ["_t", "_p"], "left").withColumn("_p", F.when(F.col("_known"), F.col("_p"))).drop("_known")
    edges = scratch.put(edges, "edges")
    state = _climb(edges, scratch)
    circle = state.filter(F.col("_p").isNotNull() & (F.col("least") == F.col("_n"))).select("_t", "_n", F.lit(True).alias("_cut"))
    if not circle.isEmpty():
        edges = scratch.put(edges.join(circle, ["_t", "_n"], "left").withColumn("_p", F.when(F.col("_cut").isNull(), F.col("_p"))).drop("_cut"), "edges")
        state = _climb(edges, scratch)
    inner = edges.filter(F.col("_p").isNotNull()).select("_t", F.col("_p").alias("_n")).distinct()
    leaves = state.join(inner, ["_t", "_n"], "left_anti")
    best = Window.partitionBy("_t").orderBy(F.col("total").desc(), "_n")
    ranked = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)
    paths = scratch.put(ranked.select("_t", F.col("_n").alias("_leaf"), "branch", "_n", F.col("depth").alias("pos")), "paths")
    jumps = scratch.put(edges.filter(F.col("_p").isNotNull()).select("_t", "_n", F.col("_p").alias("_to")), "jumps")
    reach, deepest = 1, (paths.agg(F.max("pos")).first()[0] or 0)
    while reach <= deepest:
        further = paths.join(jumps, ["_t", "_n"]).select("_t", "_leaf", "branch", F.col("_to").alias("_n"), (F.col("pos") - reach).alias("pos"))
        grown = scratch.put(paths.unionByName(further), "paths")
        onward = jumps.select("_t", F.col("_n").alias("_to"), F.col("_to").alias("_next"))
        longer = scratch.put(jumps.join(onward, ["_t", "_to"]).select("_t", "_n", F.col("_next").alias("_to")), "jumps")
        scratch.drop(paths, jumps)
        paths, jumps, reach = grown, longer, reach * 2
    return paths


def format_threads(nodes: DataFrame, scratch: Scratch, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen path.

    ``nodes``: (tree_id, node_id, parent_id, role, text, score). Paths of a tree are ranked by the sum of
    their scores, ties by the leaf's id as text; the first ``branches`` are kept. Returns tree_id, leaf_id, branch
    (rank), n_turns, formatted, loss_spans (array of start, length in code points of ``formatted``, the
    escaped texts of ``loss_role``). Null texts and roles count as empty, null scores as 0. A null tree_id is
    a tree; a node without an id is one that nothing answers; rows that repeat a node are one (the first by
    parent, role and text); a circle of parents starts at its smallest node, and each node stands in a path
    once. Texts of any length are kept whole. An empty table gives no rows; columns beyond the named ones are
    ignored.
    """
    nodes = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score"), F.lit(0)).cast("double").alias("score"))
    nodes = scratch.put(_keyed(nodes), "nodes")
    paths = reply_paths(nodes, scratch, branches)
    ids = nodes.select("_t", F.col("_n").alias("_leaf"), F.col("node_id").alias("leaf_id"))
    turns = paths.join(nodes.drop("score", "parent_id", "_p", "node_id"), ["_t", "_n"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    turns = turns.select("_t", "_leaf", "tree_id", "branch", "pos", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    along = Window.partitionBy("_t", "_leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(along), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    out = turns.groupBy("_t", "_leaf").agg(F.first("tree_id").alias("tree_id"), F.min("branch").alias("branch"), F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return out.join(ids, ["_t", "_leaf"]).select("tree_id", "leaf_id", "branch", "n_turns", F.concat_ws("", F.col("_pieces.piece")).alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation as array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, SEP, 1), len(START) + 1, 2147483647)).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.concat_ws("", F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "chat")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("text"))
    extra = spark.sql(r"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, r'</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', r'</s>[INST] ok [/INST]'")
    rows = rows.unionByName(extra)
    # a log without parents is a tree of one branch: each turn answers the one before it
    within = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    nodes = rows.withColumn("node_id", F.row_number().over(within).cast("long"))
    nodes = nodes.select(tree.alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.length("text").alias("score"))
    out = format_threads(nodes, scratch)
    turns = F.concat_ws("", F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    out = out.withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        F.expr("try_cast(tree_id AS BIGINT)").alias("conv_id"), F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(role)
        + length(regexp_replace(text || role, '[^\\<\[]', '', 'g')) + length('<|im_start|><|im_sep|><|im_end|>') AS piece FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(piece)::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
