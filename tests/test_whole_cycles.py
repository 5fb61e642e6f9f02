"""Circular flows of every length up to the cap, against a plain search; addresses."""

import random

from pyspark.sql import functions as F

from docketlake.operators import graph as G
from docketlake.operators import text as T


def _search(rows, longest):
    to = {}
    for a, b, w in rows:
        to.setdefault(a, {})[b] = w
    out, stack = set(), [([a], None) for a in to]
    while stack:
        path, low = stack.pop()
        for b, w in to.get(path[-1], {}).items():
            k = w if low is None else min(low, w)
            if b == path[0] and len(path) > 1:
                out.add((tuple(path), len(path), k))
            elif b > path[0] and b not in path and len(path) < longest:
                stack.append((path + [b], k))
    return out


def test_cycles_of_every_length(spark):
    r = random.Random(4)
    rows = [(f"n{a}", f"n{b}", r.randint(1, 9)) for a in range(9) for b in range(9) if a != b and r.random() < 0.25] + [("n0", f"leaf{i}", 1) for i in range(5)] + [("leaf0", "n0", 2)]
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    for longest in (2, 3, 6, None):
        assert {(tuple(x.path), x.length, x.min_weight) for x in G.cycles(df, longest).collect()} == _search(rows, longest or 99)


def test_flows_through_three_accounts(spark):
    rows = []
    for i in range(3):  # entity i pays into account i, which pays out to entity i + 1
        rows += [(f"E{i}", f"A{i}", 10.0 + i), (f"E{(i + 1) % 3}", f"A{i}", -20.0)]
    df = spark.createDataFrame(rows, "entity string, account string, amount double")
    got = G.cycles(G.flow_edges(df)).collect()
    assert [(x.length, x.min_weight) for x in got] == [(6, 1000)]


def test_street_addresses(spark):
    df = spark.createDataFrame([("Lives at 12 Oak Tree Lane, Springfield, IL 62704. Works at 7 Main St. Apt 3 now",), ("none",)], "t string")
    assert [x[0] for x in df.select(T.street_addresses(F.col("t"))).collect()] == [["12 Oak Tree Lane, Springfield, IL 62704", "7 Main St. Apt 3"], []]


def _strong(rows):
    """Smallest node that a node reaches and is reached by, for nodes of cycles."""
    to = {}
    for a, b, _ in rows:
        to.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            new = to.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    nodes = {n for a, b, _ in rows for n in (a, b)}
    far = {n: reached(n) for n in nodes}
    return {n: min([m for m in far[n] if n in far[m]]) for n in nodes if any(n in far[m] for m in far[n] - {n})}


def test_strong_components(spark):
    r = random.Random(9)
    ring = [f"r{(7 * i) % 61:02d}" for i in range(61)]
    rows = [(a, b, 1) for a, b in zip(ring, ring[1:] + ring[:1])] + [("r03", "x", 1), ("x", "y", 1), ("y", "x", 1), ("q", "q", 1), ("q", "r03", 1), ("x", "y", 1)]
    rows += [(f"n{r.randrange(40):02d}", f"n{r.randrange(40):02d}", 1) for _ in range(70)]
    got = G.strong_components(spark.createDataFrame(rows, "src string, dst string, weight long")).collect()
    assert len(got) == len({x.node for x in got}) and {x.node: x.component for x in got} == _strong([x for x in rows if x[0] != x[1]])
    assert G.strong_components(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")).count() == 0


def test_first_cycles_stop_when_there_are_enough(spark):
    rows = [(f"n{a}", f"n{b}", a + b) for a in range(7) for b in range(7) if a != b] + [("z0", "z1", 1), ("z1", "z2", 1), ("z2", "z0", 1), ("n0", "z0", 1)]
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    want = sorted(_search(rows, 4), key=lambda x: (x[1], "|".join(x[0])))[:30]
    assert [(tuple(x.path), x.length, x.min_weight) for x in G.first_cycles(df, 30).collect()] == want
    few = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3)], "src string, dst string, weight long")
    assert [tuple(x.path) for x in G.first_cycles(few).collect()] == [("a", "b", "c")]
    assert G.first_cycles(few.limit(0)).count() == 0 and G.cycles(few.limit(0)).count() == 0
