"""Merkle manifests: trees of digests per group, reduced by superblocks, with a proof for every leaf."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.common import Scratch, sized_broadcast, table

#: Nodes that become one node, and levels that one task collapses at a time: a superblock has FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 2, 10
#: Up to so many groups their table (number, size, first place, root) is broadcast (about 20 MB).
BROADCAST_GROUPS = 100_000

NODE = "g long, i long, digest string"
PROOF = "g long, i long, before array<string>, after array<string>"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The nodes of ``depth`` levels above, the given ones first. Runs of ``fanout`` consecutive nodes become their
    digest; the last run may be shorter."""
    out = [nodes]
    for _ in range(depth):
        out.append([digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def above(n: Column, block: int) -> Column:
    """Nodes that ``n`` nodes become."""
    return F.call_function("div", n + (block - 1), F.lit(block))


def superblock(nodes: DataFrame, sizes: DataFrame, n_groups: int, block: int) -> DataFrame:
    """``nodes`` with their group's size ``n`` at this level and their superblock ``b``."""
    whole = nodes.join(sized_broadcast(sizes, n_groups, BROADCAST_GROUPS), "g")
    return whole.withColumn("b", F.call_function("div", F.col("i"), F.lit(block)))


def up(nodes: DataFrame, sizes: DataFrame, n_groups: int, most: int, scratch: Scratch, fanout: int, levels: int) -> list[DataFrame]:
    """Trees over ``nodes`` (g, i, digest), superblock by superblock, the given level first; in the last each group has
    one node. ``sizes``: (g, n), ``most`` the largest n."""
    block = fanout**levels

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        node = collapse(pdf["digest"].tolist(), min(levels, height(int(pdf["n"].iloc[0]), fanout)), fanout)[-1]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "i": [pdf["b"].iloc[0]], "digest": node})

    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(scratch.put(superblock(out[-1], sizes, n_groups, block).groupBy("g", "b").applyInPandas(reduced, NODE), "nodes"))
        sizes, most = sizes.withColumn("n", above(F.col("n"), block)), -(-most // block)
    return out


def prover(fanout: int, levels: int, columns: list[str]) -> Callable:
    """What gives the proofs of one superblock's nodes: the digests beside them inside of it, then the proof of its root."""

    def prove(pdf: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        found = collapse(pdf["digest"].tolist(), min(levels, height(int(pdf["n"].iloc[0]), fanout)), fanout)[:-1]
        upper_before, upper_after = list(upper["before"].iloc[0]), list(upper["after"].iloc[0])
        before, after = [], []
        for x in range(len(pdf)):
            left, right = [], []
            for nodes in found:
                run = x - x % fanout
                left.append("".join(nodes[run:x]))
                right.append("".join(nodes[x + 1 : run + fanout]))
                x //= fanout
            before.append(left + upper_before)
            after.append(right + upper_after)
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "before": before, "after": after} | {c: pdf[c] for c in columns})

    return prove


def down(tree: list[DataFrame], sizes: DataFrame, n_groups: int, ends: DataFrame, scratch: Scratch, fanout: int, levels: int, columns: list[str]) -> DataFrame:
    """(g, i, before, after, and ``columns``) of the first level of ``tree``: the digests beside a leaf's way to the
    root, one text of concatenated digests per level for those left of it and one for those right of it.

    ``ends``: (g, i, before, after) of the last level. Each superblock is collapsed again, now keeping what stands beside
    each node (the lower proof), and the proof of its root (the upper one) is put after it. Nodes and one proof per
    superblock are moved, the proofs of leaves are not. ``columns`` of the leaves are strings.
    """
    block = fanout**levels
    sizes_at, proofs = [sizes], ends
    for _ in tree[:-1]:
        sizes_at.append(sizes_at[-1].withColumn("n", above(F.col("n"), block)))
    for k in range(len(tree) - 2, -1, -1):
        named = columns if k == 0 else []
        nodes = superblock(tree[k], sizes_at[k], n_groups, block).groupBy("g", "b")
        schema = PROOF + "".join(f", {c} string" for c in named)
        proofs = nodes.cogroup(proofs.withColumnRenamed("i", "b").groupBy("g", "b")).applyInPandas(prover(fanout, levels, named), schema)
        if k:
            proofs = scratch.put(proofs, "proofs")
    return proofs


def placed(rows: DataFrame, scratch: Scratch, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in the order of ``grp``, nulls first, and ``by``: with ``g`` (number of the group) and ``i`` (place in the
    group, from 0); and the groups (g, grp, n).

    Rows are range-sorted and numbered by range, and the numbers of the ranges are summed, so no task holds all rows or a
    group. Rows that are equal in all are told apart by their place in the written table, so they are spread as well.
    """
    read = scratch.put(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = [F.col(c).asc_nulls_first() for c in ["grp", *by, "_row"]]
    rows = read.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.put(rows.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "sorted")
    scratch.drop(read)
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_k", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    # one row per range, then one per group: windows over them are as small as they are
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(ranges), "_range").withColumn("_p", F.col("_base") + F.col("_k")).drop("_range", "_k", "_base")
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("_first"))
    groups = scratch.put(groups.withColumn("g", F.row_number().over(Window.orderBy(F.col("grp").asc_nulls_first())).cast("long") - 1), "groups")
    named = sized_broadcast(groups.select("g", F.col("grp").alias("_grp"), "_first"), groups.count(), BROADCAST_GROUPS)
    rows = rows.join(named, F.col("grp").eqNullSafe(F.col("_grp"))).withColumn("i", F.col("_p") - F.col("_first"))
    return rows.drop("_grp", "_first", "_p"), groups.select("g", "grp", "n")


def manifest(rows: DataFrame, scratch: Scratch, carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Merkle trees over ``rows`` (grp, key, leaf and the string columns ``carry``).

    In each group the leaves ascend by key, nulls first; while several nodes are left, each ``fanout`` consecutive ones (the last
    run may be shorter, even one) become the SHA-256 of their concatenated hex digests. What is left is the group's
    ``subroot``; subroots in the order of their groups, null first and bytewise, are reduced in the same way to ``root``.

    Returns key, grp, leaf, ``carry``, position, subroot, root, and the proof, level by level from the leaf to the root:
    ``before`` and ``after`` hold the concatenated digests left and right of the node in its run, "" where there are
    none (see :func:`folded`, :func:`proof_digest`). Rows that repeat a key are leaves of their own, in the order of their leaf digests and
    ``carry``; rows equal in all are alike, and whichever comes first makes no difference to the rows as a
    whole. Null keys and groups are values like others. A group of one leaf has that leaf as its subroot; a
    single group's subroot is the root. An empty table gives no rows.

    Superblocks of ``fanout ** levels`` nodes are one task's at a time, whatever the group's size; the tables between are
    written, each a superblock's size smaller than the one before.
    """
    kind = rows.schema["key"].dataType.simpleString()
    own = [f"c{k}" for k in range(len(carry))]
    rows = rows.select("grp", "key", "leaf", *[F.col(f"`{c}`").cast("string").alias(x) for c, x in zip(carry, own)])
    leaves, groups = placed(rows, scratch, ["key", "leaf", *own])
    n_groups, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    # keys travel as text: a null among numbers would make them floating-point numbers in pandas
    leaves = leaves.select("g", "i", F.col("leaf").alias("digest"), F.col("key").cast("string").alias("key"), *own)
    sizes = groups.select("g", "n")
    tree = up(leaves.select("g", "i", "digest"), sizes, n_groups, most, scratch, fanout, levels)
    # the subroots are the leaves of a tree of their own
    subroots = tree[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "digest")
    one = groups.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("g"), "n")
    top = up(subroots, one, 1, n_groups, scratch, fanout, levels)
    none = F.array().cast("array<string>")
    over = down(top, one, 1, top[-1].select("g", "i", none.alias("before"), none.alias("after")), scratch, fanout, levels, [])
    over = scratch.put(over.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "before", "after"), "proofs")
    proved = down([leaves, *tree[1:]], sizes, n_groups, over, scratch, fanout, levels, ["digest", "key", *own])
    named = groups.select("g", "grp").join(tree[-1].select("g", F.col("digest").alias("subroot")), "g")
    proved = proved.join(sized_broadcast(named, n_groups, BROADCAST_GROUPS), "g")
    root = top[-1].first()
    root = F.lit(root["digest"] if root else None).cast("string").alias("root")
    carried = [F.col(x).alias(c) for c, x in zip(carry, own)]
    return proved.select(F.col("key").cast(kind).alias("key"), "grp", F.col("digest").alias("leaf"), *carried, F.col("i").alias("position"), "subroot", root, "before", "after")


def folded(leaf: Column) -> Column:
    """The root that a leaf and the proof beside it give."""
    return F.aggregate(F.arrays_zip("before", "after"), leaf, lambda at, p: F.sha2(F.concat(p["before"], at, p["after"]), 256))


def proof_digest() -> Column:
    """SHA-256 of all digests of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.zip_with("before", "after", lambda a, b: F.concat(a, b)), ""), 256)


def field(value: Column) -> Column:
    """A value in a leaf: its size in bytes, a colon, and the value as text; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def document_leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, and the check of each one against the root: every seventh id's n_chars
    is tampered with first. n_chars plus one is taken in decimals, so the largest number does no harm."""
    docs = table(spark, sf_dir, "documents")
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.col("n_chars").cast(T.DecimalType(20, 0)) + 1
    leaf = document_leaf(F.col("n_chars"))
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf.alias("leaf"), F.when(touched & F.col("n_chars").isNotNull(), document_leaf(more)).alias("tampered"))
    out = manifest(rows, Scratch(spark, "manifest"), ("tampered",))
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295) % 7 = 0 AS hit
        FROM (SELECT DISTINCT doc_id FROM documents), tab),
f AS (SELECT d.doc_id, lang, coalesce(hit, false) AND n_chars IS NOT NULL AS hit, n_chars,
        coalesce(octet_length(encode(d.doc_id::VARCHAR)) || ':' || d.doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS b FROM documents d LEFT JOIN crc USING (doc_id)),
l AS MATERIALIZED (SELECT doc_id, lang, hit, sha256(a || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf, CASE WHEN hit THEN sha256(a || length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || b) END AS bad FROM f),
g AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, n FROM (SELECT lang, count(*) AS n FROM l GROUP BY lang)),
p AS MATERIALIZED (SELECT l.*, g.g, g.n, row_number() OVER (PARTITION BY g.g ORDER BY doc_id NULLS FIRST, leaf, bad NULLS FIRST) - 1 AS i FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
t AS (SELECT g, 0 AS lv, i, leaf AS h, n FROM p UNION ALL SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY g, lv, i // 2),
tt AS MATERIALIZED (SELECT * FROM t), s AS MATERIALIZED (SELECT g, h AS subroot, lv AS top FROM tt WHERE n = 1),
u AS (SELECT 0 AS lv, g AS i, subroot AS h, (SELECT count(*) FROM g) AS n FROM s UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lv, i // 2),
uu AS MATERIALIZED (SELECT * FROM u), r AS (SELECT h AS root, lv AS up FROM uu WHERE n = 1),
way AS MATERIALIZED (SELECT p.g, p.i, p.doc_id, p.leaf, p.bad, s.subroot, r.root, s.top, r.up FROM p JOIN s USING (g), r),
steps AS (SELECT w.g, w.i, x.lv AS k, (w.i // (1 << x.lv)) % 2 = 1 AS after, t.h FROM way w, range(48) x(lv) LEFT JOIN tt t ON t.g = w.g AND t.lv = x.lv AND t.i = xor(w.i // (1 << x.lv), 1) WHERE x.lv < w.top
     UNION ALL SELECT w.g, w.i, w.top + x.lv, (w.g // (1 << x.lv)) % 2 = 1, u.h FROM way w, range(48) x(lv) LEFT JOIN uu u ON u.lv = x.lv AND u.i = xor(w.g // (1 << x.lv), 1) WHERE x.lv < w.up),
proof AS MATERIALIZED (SELECT g, i, string_agg(h, '' ORDER BY k) AS all_, list(CASE WHEN after THEN coalesce(h, '') ELSE '' END ORDER BY k) AS before, list(CASE WHEN after THEN '' ELSE coalesce(h, '') END ORDER BY k) AS behind FROM steps GROUP BY g, i),
e AS (SELECT w.doc_id, w.leaf, w.subroot, w.root, sha256(coalesce(all_, '')) AS proof_sha256,
        list_reduce(list_concat([coalesce(bad, leaf)], coalesce(list_transform(range(len(before)), lambda k: before[k + 1] || '-' || behind[k + 1]), [])), lambda h, x: sha256(string_split(x, '-')[1] || h || string_split(x, '-')[2])) AS folded_root
      FROM way w LEFT JOIN proof USING (g, i))
SELECT *, folded_root = root AS verified FROM e
"""
