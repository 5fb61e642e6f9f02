"""Connected components by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); ``component`` is the smallest id reachable.

    Each round maps every vertex to the smallest of itself and its neighbours and contracts the
    graph by that map. The smallest vertex of a component always maps to itself, so it is the one
    that stays. A star takes one round, a path about log(n). The maps are put together at the end, from
    the last (smallest) to the first. Loops and repeated edges do no harm; no edges give no rows.
    """
    maps = []
    live = scratch.put(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")), "map")
        maps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("na"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("nb"))
        onward = live.join(left, "a").join(right, "b").filter(F.col("na") != F.col("nb"))
        grown = scratch.put(onward.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        scratch.drop(live)
        live = grown
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[-1].select("id", F.col("to").alias("component"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("id").alias("to"), F.col("component"))
        out = step.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return scratch.put(out, "components")
