"""Repeated line runs by distributed prefix doubling over line-id sequences. Native."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, count_words, join_hot, own_prefix, table

#: A run of lines counts as repeated matter from so many words on.
MIN_WORDS = 50


def _named(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """Add ``_rank`` and ``_first`` of the class of ``key`` and keep classes of two or more.

    ``_rank`` numbers the classes in the order of ``key``, by a range sort of the classes: of single lines in the
    order of their ids, of pairs of ranks so that ranks stay in lexicographic order. ``_first`` = (doc, row
    tag, pos) of the earliest member: the place of the copy that stays. Counting is done before the join, so
    that a line found in a third of all documents is one row of the counted side, and the rows of such a class
    are dealt over tasks.
    """
    counted = rows.groupBy(*key).agg(F.min(F.struct("doc", "tag", "pos")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    ordered = scratch.put(counted, "classes").repartitionByRange(*key).sortWithinPartitions(*key)
    ranked = scratch.put(ordered.withColumn("_rank", F.monotonically_increasing_id()), "ranked")
    return join_hot(rows, ranked, key, ["doc", "tag", "pos"], "_n").drop("_n")


def _later_copies(docs: DataFrame, scratch: Scratch, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, pos, len, _first) of the shortest runs of ``min_words`` words that occur earlier, and the places
    (doc, tag, pos, line) of the stretches that they lie in.

    A document's sequence holds the ids of its lines with a word. Ranks are doubled: rank j of a place
    is that of the run of 2^j lines that starts there in the lexicographic order of all such runs, so equal ranks
    are the suffix array's intervals of common prefixes of at least 2^j lines; places whose rank is theirs alone
    drop out. A run of l lines has the rank pair of its first and last 2^j lines, 2^j <= l: an interval of common
    prefixes of l lines. Every maximal repeated run of ``min_words`` words is the union of the shortest such
    runs that start, and that end, at each of its lines; so the intervals of those are looked up.
    """
    base = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tag"), "text").filter(F.col("text").isNotNull())
    base = base.filter(F.length("text") >= 2 * min_words - 1)
    lines = base.select("doc", "tag", F.posexplode_outer(F.split("text", "\n")).alias("line", "t")).withColumn("w", count_words(F.col("t")))
    lines = lines.filter(F.col("w") > 0).select(F.coalesce("doc", F.lit(-(2**62))).alias("doc"), "tag", "line", F.col("w").cast("int").alias("w"), F.xxhash64("t").alias("h"), F.crc32("t").alias("h2"))
    # identical rows are one document here: what is decided for one holds for the other
    lines = lines.distinct()
    order = Window.partitionBy("doc", "tag").orderBy("line")
    lines = lines.withColumn("pos", F.row_number().over(order))
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = scratch.put(lines.withColumn("c", upto.cast("long")), "lines")
    # names of single lines
    rank = scratch.put(_named(lines.select("doc", "tag", "pos", "line", "w", "c", "h", "h2"), ["h", "h2"], scratch).select("doc", "tag", "pos", "line", "w", "c", F.col("_rank").alias("r0")), "rank0")
    # stretches of adjacent repeated lines bound what can be a repeated run
    within = Window.partitionBy("doc", "tag").orderBy("pos")
    rank = rank.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(within) == 1, 0).otherwise(1)).withColumn("isle", F.sum("_new").over(within)).drop("_new")
    isle = Window.partitionBy("doc", "tag", "isle")
    rank = rank.withColumn("isle_words", F.sum("w").over(isle)).filter(F.col("isle_words") >= min_words).drop("isle_words")
    rank = scratch.put(rank, "stretches")
    runs = _shortest_runs(rank, min_words)
    runs = scratch.put(runs, "runs")
    longest = runs.agg(F.max("len")).first()[0] or 1
    levels = int(math.floor(math.log2(longest)))
    ranks = [rank.select("doc", "tag", "isle", "pos", F.col("r0").alias("r"))]
    for j in range(1, levels + 1):
        half = 2 ** (j - 1)
        ahead = Window.partitionBy("doc", "tag", "isle").orderBy("pos").rangeBetween(half, half)
        pairs = ranks[-1].withColumn("r2", F.max("r").over(ahead)).filter(F.col("r2").isNotNull())
        ranks.append(scratch.put(_named(pairs, ["r", "r2"], scratch).select("doc", "tag", "isle", "pos", F.col("_rank").alias("r")), f"rank{j}"))
    # rank pair of each run
    level = F.floor(F.log2(F.col("len").cast("double") + F.lit(1e-9))).cast("int")
    runs = runs.withColumn("j", level).withColumn("tail", F.expr("pos + len - cast(pow(2, j) as int)"))
    all_ranks = None
    for j, r in enumerate(ranks):
        r = r.select(F.col("doc").alias("_d"), F.col("tag").alias("_t"), F.col("pos").alias("_p"), F.lit(j).alias("_j"), "r")
        all_ranks = r if all_ranks is None else all_ranks.unionByName(r)
    at = lambda place: (F.col("doc") == F.col("_d")) & (F.col("tag") == F.col("_t")) & (F.col("j") == F.col("_j")) & (F.col(place) == F.col("_p"))
    runs = runs.join(all_ranks.withColumnRenamed("r", "ra"), at("pos")).drop("_d", "_t", "_p", "_j")
    runs = runs.join(all_ranks.withColumnRenamed("r", "rb"), at("tail")).drop("_d", "_t", "_p", "_j")
    again = _named(scratch.put(runs, "pairs"), ["len", "ra", "rb"], scratch).filter((F.col("_first.doc") != F.col("doc")) | (F.col("_first.tag") != F.col("tag")) | (F.col("_first.pos") != F.col("pos")))
    return again.select("doc", "tag", "pos", "len", "_first"), rank.select("doc", "tag", "pos", "line")


def repeated_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, tag, lines): line numbers (from 0) that belong to later copies of repeated runs of ``min_words`` words
    or more. Runs do not cross documents. Copies within one document count too; of equal copies the first by
    (doc_id, text hash, line) stays. Null texts have no lines; an empty table gives no rows."""
    again, places = _later_copies(docs, scratch, min_words)
    covered = again.select("doc", "tag", F.explode_outer(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos")).distinct()
    gone = covered.join(places, ["doc", "tag", "pos"])
    return gone.groupBy("doc", "tag").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, tag, line, last_line, n_lines, first_doc, first_tag, first_line): maximal runs of lines with a word that
    repeat the run of ``n_lines`` such lines from ``first_line`` of an earlier place on. Shortest runs that
    repeat one earlier document at one distance, and overlap or touch, are one run."""
    again, places = _later_copies(docs, scratch, min_words)
    key = ["doc", "tag", "_fd", "_ft", "_gap"]
    rows = again.select("doc", "tag", "pos", (F.col("pos") + F.col("len") - 1).alias("end"), F.col("_first.doc").alias("_fd"), F.col("_first.tag").alias("_ft"), (F.col("pos") - F.col("_first.pos")).alias("_gap"))
    w = Window.partitionBy(*key).orderBy("pos", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("pos") <= far + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(*key, "_run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    at = lambda d, t, p, name: places.select(F.col("doc").alias(d), F.col("tag").alias(t), F.col("pos").alias(p), F.col("line").alias(name))
    runs = runs.withColumn("_fp", F.col("pos") - F.col("_gap")).join(at("doc", "tag", "pos", "line"), ["doc", "tag", "pos"]).join(at("doc", "tag", "end", "last_line"), ["doc", "tag", "end"]).join(at("_fd", "_ft", "_fp", "first_line"), ["_fd", "_ft", "_fp"])
    return runs.select("doc", "tag", "line", "last_line", (F.col("end") - F.col("pos") + 1).alias("n_lines"), F.col("_fd").alias("first_doc"), F.col("_ft").alias("first_tag"), "first_line")


def _shortest_runs(rank: DataFrame, min_words: int) -> DataFrame:
    """(doc, tag, pos, len): shortest runs of ``min_words`` words from each line on and up to each line,
    within stretches. Running sums are strictly increasing, so the bound is found in the sorted sums."""
    grouped = rank.groupBy("doc", "tag", "isle").agg(F.sort_array(F.collect_list(F.struct("pos", "w", "c"))).alias("s"))
    forward = "transform(s, (x, i) -> struct(x.pos AS pos, size(filter(slice(s, i + 1, {m}), y -> y.c < x.c - x.w + {m})) + 1 AS len))".replace("{m}", str(min_words))
    backward = "transform(s, (x, i) -> size(filter(slice(s, greatest(1, i + 2 - {m}), least(i + 1, {m})), y -> y.c - y.w > x.c - {m})) + 1)".replace("{m}", str(min_words))
    rows = grouped.withColumn("f", F.expr(forward)).withColumn("b", F.expr(backward))
    # place and length as one number: arrays of structs are made distinct by comparing all pairs
    one = str(min_words + 1)
    rows = rows.withColumn("both", F.expr(f"concat(filter(transform(f, (x, i) -> if(i + x.len <= size(s), x.pos * {one}L + x.len, null)), x -> x is not null), filter(transform(b, (n, i) -> if(i + 1 - n >= 0, s[i + 1 - n].pos * {one}L + n, null)), x -> x is not null))"))
    rows = rows.select("doc", "tag", F.explode_outer(F.array_distinct("both")).alias("r")).filter(F.col("r").isNotNull())
    return rows.select("doc", "tag", F.expr(f"cast(r div {one} AS INT)").alias("pos"), F.expr(f"cast(r % {one} AS INT)").alias("len"))


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``n_lines_cut`` and with later copies of repeated runs cut from ``text``.

    Rows that are equal in doc_id and text are one document: what is cut from one is cut from all. Rows
    without a doc_id come first in the order. Null texts stay null with 0 lines cut; a text of which every
    line is cut becomes empty; lines without a word are no part of a run and stay. Other columns stay, those named like an added one are replaced; an empty table gives no rows.
    """
    ld = own_prefix(docs, "_ld_")
    gone = scratch.put(repeated_lines(docs, scratch, min_words), "gone").toDF(f"{ld}doc", f"{ld}tag", f"{ld}lines")
    same = (F.coalesce(docs["doc_id"], F.lit(-(2**62))) == F.col(f"{ld}doc")) & (F.xxhash64(docs["text"]) == F.col(f"{ld}tag"))
    # the decisions grow with the corpus: one plan at every size, which moves each text once
    out = docs.join(gone.hint("merge"), same, "left")
    # what stays: the lines between one line that is cut and the next
    ends = f"concat({ld}lines, array(size({ld}split)))"
    stretch = f"slice({ld}split, if(i = 0, 1, get({ld}lines, i - 1) + 2), e - if(i = 0, 0, get({ld}lines, i - 1) + 1))"
    left = F.expr(f"array_join(flatten(transform({ends}, (e, i) -> {stretch})), '\\n')")
    out = out.withColumn(f"{ld}split", F.when(F.col(f"{ld}lines").isNotNull(), F.split("text", "\n")))
    out = out.withColumn("text", F.when(F.col(f"{ld}lines").isNotNull(), left).otherwise(F.col("text")))
    n_cut = F.coalesce(F.size(f"{ld}lines"), F.lit(0)).cast("long")
    return out.withColumn("n_lines_cut", n_cut).drop(f"{ld}doc", f"{ld}tag", f"{ld}lines", f"{ld}split")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, Scratch(spark, "lines"))
    return out.select("doc_id", "n_lines_cut", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS t FROM d),
l AS (SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM u),
n AS (SELECT doc_id, line, t, w, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
             sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM l WHERE w > 0),
r AS (SELECT x.doc_id, x.pos AS s, min(y.pos) AS e FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.c >= x.c - x.w + 50 GROUP BY ALL
      UNION SELECT x.doc_id, max(y.pos) AS s, x.pos AS e FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.pos <= x.pos AND y.c - y.w <= x.c - 50 GROUP BY x.doc_id, x.pos),
m AS (SELECT r.doc_id, s, e, string_agg(t, chr(10) ORDER BY pos) AS body FROM r JOIN n ON r.doc_id = n.doc_id AND n.pos BETWEEN s AND e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS place FROM m),
g AS (SELECT DISTINCT n.doc_id, n.line FROM k JOIN n ON n.doc_id = k.doc_id AND n.pos BETWEEN s AND e WHERE place > 1),
h AS (SELECT u.doc_id, count(g.line)::BIGINT AS n_lines_cut, coalesce(string_agg(CASE WHEN g.line IS NULL THEN t END, chr(10) ORDER BY u.line), '') AS kept
      FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.line = g.line GROUP BY u.doc_id)
SELECT documents.doc_id, coalesce(n_lines_cut, 0)::BIGINT AS n_lines_cut, length(kept)::BIGINT AS n_chars_left, sha256(kept) AS text_sha256
FROM documents LEFT JOIN h USING (doc_id)
"""
