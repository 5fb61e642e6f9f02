"""Mixing sources to target weights by hash-random order and distributed prefix sums. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, count_words, own_prefix, sized_broadcast, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
ROWS_PER_BUCKET = 2000
#: Up to so many distinct sources the per-source table is broadcast (about 10 MB).
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Targets per source from (source, source_size, n_rows): one row per source.

    Sources in code point order, null last, get ``weights`` in turn and divide ``share`` of all
    words by weight. A target stops at ``max_epochs`` times its source's size; what it cannot take
    is shared out again by weight. In order of cap / weight the capped sources come first, so one
    pass of running sums finds the level at which no target is above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    s = s.withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    # the level of the first source that stays below its cap holds for all that follow
    s = s.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_level").alias("lv")))).over(everything)["lv"])
    target = F.when(F.col("_open"), F.col("_w") * F.col("_final")).otherwise(F.col("_cap"))
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, scratch: Scratch, size: Column | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, rows_per_bucket: int = ROWS_PER_BUCKET, tie: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it.

    Adds ``size`` (words), ``source_size``, ``target``, ``epochs`` (whole passes over the source)
    and ``taken`` (words taken, repeats counted). Within a source the rows are put in the order of
    ``md5(seed:doc_id)``; prefix sums of sizes are cut at the exact rest of the budget, so the row at
    the cut is taken in part. Prefix sums are distributed: rows are ranged by hash into buckets of
    about ``rows_per_bucket``, bucket totals are summed first, then rows within buckets, so that a
    source with a third of all rows is spread over many tasks.

    Null or empty texts have size 0 and nothing is taken; null sources form one source, the last;
    rows without a doc_id take ``tie`` (by default the hash of their text) for it, so that a source without
    doc_ids is spread like any other; rows that repeat a doc_id share a place and rank by size and tie; rows
    equal in all three are interchangeable. An empty table gives an empty result. Other columns of ``docs`` are kept, whatever their
    names, save those named like an added one, which are replaced.
    """
    added = ("size", "source_size", "target", "epochs", "taken")
    mx = own_prefix(docs, "_mx_")
    size = count_words(F.col("text")) if size is None else size
    if tie is None:
        tie = F.xxhash64("text") if "text" in docs.columns else F.xxhash64(size)
    rows = docs.withColumn(f"{mx}size", size.cast("long")).withColumn(f"{mx}tie", tie).drop(*[c for c in added if c in docs.columns])
    rows = rows.withColumnRenamed(f"{mx}size", "size")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col(f"{mx}tie").cast("string")))
    rows = rows.withColumn(f"{mx}key", F.md5(F.concat(F.lit(seed + ":"), name)))
    sums = scratch.put(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    n_sources = sums.count()
    per = source_targets(sums, weights, max_epochs)
    per = per.withColumn(f"{mx}b", F.ceil(F.col("n_rows") / rows_per_bucket).cast("long"))
    per = per.withColumn("epochs", F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0)).cast("long"))
    per = scratch.put(per.withColumn(f"{mx}rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "targets")
    per = per.drop("n_rows").withColumnRenamed("source", f"{mx}source")
    rows = rows.join(sized_broadcast(per, n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col(f"{mx}source"))).drop(f"{mx}source")
    place = F.conv(F.substring(f"{mx}key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumn(f"{mx}bucket", F.floor(place * F.col(f"{mx}b")).cast("long"))
    # null-safe parts of the key, the same for windows and join, so that whole rows are moved once
    where = [f"{mx}src", f"{mx}none", f"{mx}bucket"]
    rows = rows.withColumn(where[0], F.coalesce("source", F.lit(""))).withColumn(where[1], F.col("source").isNull())
    totals = rows.groupBy(*where).agg(F.sum("size").alias(f"{mx}sum"))
    ahead = Window.partitionBy(*where[:2]).orderBy(where[2]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(f"{mx}base", F.coalesce(F.sum(f"{mx}sum").over(ahead), F.lit(0))).drop(f"{mx}sum")
    inside = Window.partitionBy(*where).orderBy(f"{mx}key", "doc_id", "size", f"{mx}tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{mx}in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, where)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col(f"{mx}rest") - F.col(f"{mx}base") - F.col(f"{mx}in")))
    rows = rows.withColumn("taken", (F.col("size") * F.col("epochs") + part).cast("long"))
    return rows.drop(*[c for c in rows.columns if c.startswith(mx)])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
    docs = scratch.put(docs, "sizes")
    return mix(docs, scratch, size=F.col("words"), tie=F.col("text_hash")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3e0 AS cap,
             CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
o AS (SELECT *, cap / w > lv AS is_open,
             first_value(lv) OVER (ORDER BY CASE WHEN cap / w > lv THEN 0 ELSE 1 END, cap / w, source NULLS LAST) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN is_open THEN w * final ELSE cap END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
p AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (size * epochs + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
