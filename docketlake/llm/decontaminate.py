"""Benchmark decontamination by winnowed fingerprints whose hits are extended word by word. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, alnum_words, own_name, sized_broadcast, table

#: Words of a window that counts as a leak.
SPAN = 10
#: Words of a fingerprinted k-gram. Of each SPAN - K + 1 adjacent k-grams the one with the smallest hash (the
#: first of equals) is kept with its place, so two texts that share SPAN consecutive words share a fingerprint
#: at the same place of the shared run.
K = 5
#: A fingerprint is the upper bits of a hash with the place of its k-gram below: places up to 2^28 words.
PLACE_BITS = 28
#: Up to so many distinct fingerprints (long integers, 16 MB as a hash table) are broadcast.
BROADCAST_PRINTS = 200_000
#: Up to so many candidate documents are broadcast to pick their texts: an id and a hash each (40 MB).
BROADCAST_DOCS = 1_000_000
#: Prints beyond their limit are joined by a shuffle: each is repeated so often and documents are dealt over
#: the repeats, so no print is one task's.
PARTS = 16


def _grams(df: DataFrame, hashes: str, k: int, out: str, salt: int | None = None) -> DataFrame:
    """Add ``out``: hash and place (from 0) of all runs of ``k`` elements of array ``hashes``."""
    rest = "".join(f", get({hashes}, i + {j})" for j in range(1, k)) + ("" if salt is None else f", {salt}")
    kept = f"(xxhash64(x{rest}) & {-1 << PLACE_BITS}L) | i"
    return df.withColumn(out, F.expr(f"transform(slice({hashes}, 1, greatest(0, size({hashes}) - {k - 1})), (x, i) -> {kept})"))


def with_fingerprints(df: DataFrame, words: str, short: list[int], k: int = K, span: int = SPAN) -> DataFrame:
    """Add ``_fp``: distinct fingerprints with places, of array ``words``.

    The winnowed ones guarantee each shared run of ``span`` words. For each length in ``short`` (items of
    fewer words) every run of that length is fingerprinted, salted with the length. Explode it with
    explode_outer: for explode, Spark infers a filter on the array's size and pushes it down, which writes
    every step below out again inside the filter.
    """
    w = span - k + 1
    df = df.withColumn("_wh", F.transform(words, lambda x: F.xxhash64(x)))
    df = _grams(df, "_wh", k, "_g")
    least = "least(x" + "".join(f", get(_g, i + {j})" for j in range(1, w)) + ")"
    parts = [f"transform(slice(_g, 1, greatest(0, size(_g) - {w - 1})), (x, i) -> {least})"]
    for n in short:
        df = _grams(df, "_wh", n, f"_g{n}", n)
        parts.append(f"_g{n}")
    return df.withColumn("_fp", F.expr(f"array_distinct(concat({', '.join(parts)}))")).drop("_wh", "_g", *[f"_g{n}" for n in short])


def _print(fp: str) -> Column:
    return F.shiftright(fp, PLACE_BITS)


def _place(fp: str) -> Column:
    return F.col(fp).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _before(words: str, at: str) -> Column:
    """Up to SPAN - K words before place ``at`` (from 0), the nearest first."""
    return F.expr(f"reverse(slice({words}, greatest(1, {at} - {SPAN - K - 1}), least({at}, {SPAN - K})))")


def benchmark_prints(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """(print, gram, need, item, before, words): each fingerprint of each item with the words around it.

    ``gram``: words of the fingerprint itself; ``need``: words of a run that counts, SPAN or those of an item
    of fewer words. Also the lengths below SPAN that occur among items.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), alnum_words(F.col("text")).alias("_w"))
    rows = scratch.put(rows.filter(F.size("_w") > 0), "items")
    short = sorted(r[0] for r in rows.filter(F.size("_w") < SPAN).select(F.size("_w")).distinct().collect())  # nine values at most
    of = [(K, SPAN, with_fingerprints(rows.filter(F.size("_w") >= SPAN), "_w", []))]
    of += [(n, n, _grams(rows.filter(F.size("_w") == n).withColumn("_wh", F.transform("_w", lambda x: F.xxhash64(x))), "_wh", n, "_fp", n).drop("_wh")) for n in short]
    out = None
    for gram, need, found in of:
        at = found.withColumn("fp", F.explode_outer("_fp")).withColumn("at", _place("fp"))
        part = at.select(_print("fp").alias("print"), F.lit(gram).alias("gram"), F.lit(need).alias("need"), "item", _before("_w", "at").alias("before"), F.expr(f"slice(_w, at + 1, {SPAN})").alias("words"))
        out = part if out is None else out.unionByName(part)
    return scratch.put(out.distinct(), "prints"), short


def _equal(a: str, b: str) -> str:
    """SQL for the number of leading elements that two arrays share."""
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return f"if(array_position({same}, false) = 0, size({same}), cast(array_position({same}, false) AS INT) - 1)"


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents that hold benchmark windows.

    Returns (doc_id, text_hash, n_hit, items): ``n_hit`` counts the words inside any occurrence of any
    window, ``items`` are the ids (as strings, sorted) of the items with occurring windows. A document
    is named by doc_id and the hash of its text, so that repeated or null doc_ids are no trouble; rows equal
    in both are one document. Documents without hits, with null text or without words are absent; null
    benchmark texts have no windows, a null item_id is "null"; an item under SPAN words is one window. Empty
    tables give no rows; other columns are ignored. Texts are read whole.

    Fingerprints of documents and items are joined by their hash. Each place of a document so found is
    extended to both sides, comparing words, up to SPAN - K words: a window's own fingerprint lies in it, so
    all windows are found by the extensions of all fingerprints, and none needs to go further.
    """
    prints, short = benchmark_prints(items, scratch)
    kinds = scratch.put(prints.select("print").distinct(), "kinds")
    n_kinds = kinds.count()
    named = docs.select("doc_id", F.col("text").alias("_text")).filter(F.col("_text").isNotNull()).withColumn("text_hash", F.xxhash64("_text"))
    marks = with_fingerprints(named.withColumn("_w", alnum_words(F.col("_text"))).drop("_text"), "_w", short)
    marks = marks.select("doc_id", "text_hash", F.explode_outer("_fp").alias("fp")).withColumn("print", _print("fp"))
    if n_kinds <= BROADCAST_PRINTS:
        found = marks.join(sized_broadcast(kinds, n_kinds, BROADCAST_PRINTS), "print", "left_semi")
    else:
        found = marks.withColumn("part", _dealt("fp")).join(_repeated(kinds), ["print", "part"], "left_semi")
    found = scratch.put(found.groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("fps")), "candidates")
    # the words around each place found
    f = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "fps")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th"))
    # ids first, so that only the texts of candidates are moved
    texts = named.join(sized_broadcast(f.drop("fps"), found.count(), BROADCAST_DOCS), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.join(f, same).drop("_id", "_th")
    near = texts.select("doc_id", "text_hash", alnum_words(F.col("_text")).alias("_w"), "fps")
    p = f"cast(x & {(1 << PLACE_BITS) - 1}L AS INT)"
    around = f"struct(x AS fp, reverse(slice(_w, greatest(1, {p} - {SPAN - K - 1}), least({p}, {SPAN - K}))) AS d_before, slice(_w, {p} + 1, {SPAN}) AS d_words)"
    near = near.select("doc_id", "text_hash", F.explode_outer(F.expr(f"transform(fps, x -> {around})")).alias("a")).select("doc_id", "text_hash", "a.*")
    near = near.withColumn("print", _print("fp")).withColumn("at", _place("fp")).withColumn("part", _dealt("fp")).drop("fp")
    both = near.join(_repeated(prints), ["print", "part"]).filter(F.expr("slice(d_words, 1, gram) = slice(words, 1, gram)"))
    both = both.withColumn("left", F.expr(_equal("d_before", "before"))).withColumn("right", F.when(F.col("need") < SPAN, 0).otherwise(F.expr(_equal(f"slice(d_words, {K + 1}, {SPAN})", f"slice(words, {K + 1}, {SPAN})"))))
    both = both.withColumn("left", F.when(F.col("need") < SPAN, 0).otherwise(F.col("left"))).filter(F.col("left") + F.col("gram") + F.col("right") >= F.col("need"))
    run = F.struct((F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("gram") + F.col("right") - 1).alias("last"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(run), lambda h: F.sequence(h["first"], h["last"]))))
    return both.groupBy("doc_id", "text_hash").agg(F.size(covered).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))


def _dealt(fp: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash", fp), F.lit(PARTS)).cast("int")


def _repeated(prints: DataFrame) -> DataFrame:
    return prints.withColumn("part", F.explode_outer(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns of any name stay as they are."""
    bad = scratch.put(contaminated(docs, items, scratch).select("doc_id", "text_hash"), "bad")
    names = [own_name(docs, "_dc_id"), own_name(docs, "_dc_hash")]
    bad = bad.toDF(*names)
    same = docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.xxhash64(docs["text"]) == F.col(names[1]))
    return docs.join(bad, same, "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "decontaminate")
    docs = table(spark, sf_dir, "documents")
    bad = scratch.put(contaminated(docs, table(spark, sf_dir, "benchmark"), scratch).withColumnsRenamed({"doc_id": "_id", "text_hash": "_th"}), "found")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    both = base.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
ip AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM ip),
ns AS (SELECT DISTINCT n FROM wins),
dp AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, ns WHERE len(w) >= n),
dwin AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp),
hit AS (SELECT d.rid, d.n, d.p, wins.item FROM dwin d JOIN wins ON d.n = wins.n AND d.win = wins.win),
pos AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
