"""Running figures within keys and chains through rows, whatever the size of a key: no task holds all rows of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.core import small
from docketlake.functions.scratch import Steps

#: Up to so many splits of files their table is broadcast (about 20 MB).
SPLITS = 100_000
#: Rounds of pointer doubling: chains of up to 2 ** 62 rows.
ROUNDS = 62


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b)], F.lit(True))


def before(df: DataFrame, keys: list[str], order: list[str], **out: tuple[str, Column]) -> DataFrame:
    """``df`` with figures over the rows of the same ``keys`` that come before in ``order``: "sum" (0 at the first row),
    or "last", the last value that is not null (null if there is none).

    Rows are sorted by range and written. Figures within a range are taken per key; what a range hands on to the next one
    is a table of one row per range, so a key with a third of all rows is many tasks like any other. Rows that are
    equal in ``keys`` and ``order`` come in any order, but once only. Null keys are a key. No ``keys``: all rows.
    """
    own = [f"_v{k}" for k in range(len(out))]
    rows = df.withColumns({v: c for v, (_, c) in zip(own, out.values())})
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = Steps(df.sparkSession).keep(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))  # the range stands above 33 bits
    inside = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [kind for kind, _ in out.values()]

    # per range and key, then of each range its first key and what its last key comes to
    whole = [F.sum(v).alias(v) if kind == "sum" else F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v, kind in zip(own, kinds)]
    parts = rows.groupBy("_range", *keys).agg(F.min("_at").alias("_lo"), *whole)
    head = [F.min_by(k, "_lo").alias(f"_h{i}") for i, k in enumerate(keys)]
    tail = [F.max_by(k, "_lo").alias(f"_t{i}") for i, k in enumerate(keys)] + [F.max_by(v, "_lo").alias(v) for v in own]
    ends = parts.groupBy("_range").agg(*head, *tail)
    # the ranges that end in a key follow each other, so its running figure over them is what the next one starts with
    along = Window.partitionBy(*[f"_t{i}" for i in range(len(keys))]).orderBy("_range")
    ends = ends.withColumns({v: F.sum(v).over(along) if kind == "sum" else F.last(v, True).over(along) for v, kind in zip(own, kinds)})
    by_range = Window.orderBy("_range")
    last = F.lag(F.struct(*[f"_t{i}" for i in range(len(keys))], *own)).over(by_range)
    ends = ends.withColumn("_p", last).filter("_p is not null")
    ends = ends.filter(_same([F.col(f"_h{i}") for i in range(len(keys))], [F.col(f"_p._t{i}") for i in range(len(keys))]))
    carry = ends.select(F.col("_range").alias("_r"), *[F.col(f"_h{i}") for i in range(len(keys))], *[F.col(f"_p.{v}").alias(f"_c{v}") for v in own])
    rows = rows.withColumns({f"_i{v}": F.sum(v).over(inside) if kind == "sum" else F.last(v, True).over(inside) for v, kind in zip(own, kinds)})
    # a row per range at most
    rows = rows.join(F.broadcast(carry), (F.col("_range") == F.col("_r")) & _same([F.col(k) for k in keys], [F.col(f"_h{i}") for i in range(len(keys))]), "left")
    found = [F.coalesce(f"_i{v}", F.lit(0)) + F.coalesce(f"_c{v}", F.lit(0)) if kind == "sum" else F.coalesce(f"_i{v}", f"_c{v}") for v, kind in zip(own, kinds)]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[f.alias(name) for f, name in zip(found, out)])


def split_starts(rows: DataFrame, **more: Column) -> DataFrame:
    """(path, _split, _first, _base, ...): of each split of a file in ``rows`` (path, _split, _id, ...) the first id, the rows of the
    file's splits before it, and the aggregates ``more``. It is written, else files are read again for its uses."""
    per = rows.groupBy("path", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), *[c.alias(n) for n, c in more.items()])
    ahead = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return Steps(rows.sparkSession).keep(per.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))


def placed(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` (path, _split, _id, ...) with ``out``: running numbers from 0 within their file.

    A split of a file is one task's, and ids ascend within it, so a row's number is its distance from the first id of
    its split, after the rows of the file's splits before. There is a row per split to look that up in, and no
    task sorts a file.
    """
    per = split_starts(rows)
    return rows.join(small(per, SPLITS), ["path", "_split"]).withColumn(out, F.col("_base") + F.col("_id") - F.col("_first")).drop("_base", "_first", "_split", "_id")


def following(rows: DataFrame, keys: list[str], queries: DataFrame) -> DataFrame:
    """``queries`` (keys, id, reach) with ``next``: the id of the first of ``rows`` (keys, id, v) of the same keys with
    v >= reach, by v and id; null if there is none. Ids are numbers."""
    no = F.lit(None).cast("long")
    both = rows.select(*keys, (-F.col("v")).alias("_v"), F.lit(0).alias("_q"), (-F.col("id")).alias("_id"), F.col("id").alias("_is"), no.alias("id"))
    both = both.unionByName(queries.select(*keys, (-F.col("reach")).alias("_v"), F.lit(1).alias("_q"), F.col("id").alias("_id"), no.alias("_is"), "id"))
    return before(both, keys, ["_v", "_q", "_id"], next=("last", F.col("_is"))).filter("_q = 1").select(*keys, "id", "next")


def chained(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) of all rows on the chains from ``starts`` (keys, id) along ``links`` (keys, id, next), the starts
    included. Jumps are doubled each round: a chain of n rows takes log(n) rounds."""
    steps = Steps(links.sparkSession)
    jump = steps.keep(links.filter("next is not null").select(*keys, "id", "next"), 2)
    on = steps.keep(starts.select(*keys, "id").distinct(), 4)
    for _ in range(ROUNDS):
        reached = on.join(jump, [*keys, "id"]).select(*keys, F.col("next").alias("id"))
        new = steps.keep(reached.join(on, [*keys, "id"], "left_anti"), 4)
        if new.isEmpty():
            return on
        on = steps.keep(on.unionByName(new), 4)
        jump = steps.keep(jump.join(jump.select(*keys, F.col("id").alias("next"), F.col("next").alias("_n")), [*keys, "next"]).select(*keys, "id", F.col("_n").alias("next")), 4)
    return on
