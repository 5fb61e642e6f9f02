"""Graphs as edge tables: flows, contacts, centrality, components, communities, cycles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.core import cents
from docketlake.functions.scan import before
from docketlake.functions.scratch import Steps

#: Rounds of local moves of communities.
MOVES = 60
#: Edges, both ways counted, of a graph that each task may hold (128 MB).
HELD_EDGES = 8_000_000
#: Nodes times edges of a task that holds the graph, about, and the most such tasks.
TASK_WORK, MOST_TASKS = 100_000_000, 192
#: Figures of a table of nodes by sources inside a task (of large graphs up to four times as many, for 32 sources), and
#: those that a step looks at.
HELD_PAIRS, STEP_PAIRS = 1_000_000, 30_000
#: Pairs of a source and a node that are held at once.
PAIR_ROWS = 50_000_000
#: A sketch of neighbours has 2 ** HLL_BITS bytes.
HLL_BITS = 10
#: States of an iteration that are kept until the driver ends.
KEPT = 10_000


def flow_edges(txns: DataFrame) -> DataFrame:
    """Directed: inflows from entity to account, outflows back; weights in cents."""
    a = F.col("amount")
    node = F.concat(F.lit("Account: "), F.col("account"))
    rows = txns.filter(a.isNotNull() & (a != 0)).select(F.when(a > 0, F.col("entity")).otherwise(node).alias("src"), F.when(a > 0, node).otherwise(F.col("entity")).alias("dst"), cents(F.abs(a)).alias("c"))
    return rows.groupBy("src", "dst").agg(F.sum("c").alias("weight"), F.count(F.lit(1)).alias("n"))


def net_flow(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("dst").alias("node"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow")).withColumn("net", F.col("inflow") - F.col("outflow"))


def cycles2(edges: DataFrame) -> DataFrame:
    """Money that goes both ways between two nodes, smaller name first."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("w2"))
    return edges.join(back, ["src", "dst"]).filter(F.col("src") < F.col("dst")).select("src", "dst", F.least("weight", "w2").alias("min_weight"))


def cycles4(edges: DataFrame, max_fan: int | None = None) -> DataFrame:
    """Simple cycles of four nodes anchored at the smallest; ``max_fan`` leaves out nodes with more edges
    than that (and says so by their absence), since cycles grow with the fourth power of the fan."""
    if max_fan is not None:
        busy = edges.select(F.col("src").alias("n")).unionAll(edges.select("dst")).groupBy("n").count().filter(F.col("count") > max_fan)
        edges = edges.join(busy, edges["src"] == busy["n"], "left_anti").join(busy, F.col("dst") == busy["n"], "left_anti")
    e = lambda a, b, w: edges.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("weight").alias(w))
    two = e("a", "b", "w1").join(e("b", "c", "w2"), "b").filter((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")))
    rest = e("c", "d", "w3").join(e("d", "a", "w4"), "d").filter((F.col("a") < F.col("d")) & (F.col("a") < F.col("c")))
    return two.join(rest, ["a", "c"]).filter(F.col("b") != F.col("d")).select("a", "b", "c", "d", F.least("w1", "w2", "w3", "w4").alias("min_weight"))


def _smallest_above(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, m): the smallest node from which ``node`` can be reached, itself included, for every end of ``edges``.

    Joins merge sorted tables: a broadcast in each round would send them all through the driver. Each round takes the least of a
    node's own value, those of its predecessors, and the value of its value (what
    reaches m reaches the node too), so a path or ring of n nodes takes about log(n) rounds, not n.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    at = steps.keep(ends.select("node", F.col("node").alias("m")))

    def turn(at: DataFrame) -> DataFrame:
        over = edges.join(at.hint("merge"), edges["src"] == at["node"]).select(F.col("dst").alias("node"), "m")
        jump = at.join(at.select(F.col("node").alias("m"), F.col("m").alias("c")).hint("merge"), "m").select("node", F.col("c").alias("m"))
        return at.unionByName(over).unionByName(jump).groupBy("node").agg(F.min("m").alias("m"))

    while True:
        new = steps.keep(turn(turn(at)))
        if new.join(at.hint("merge"), ["node", "m"], "left_anti").isEmpty():
            return new
        at = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the strongly connected component, for nodes that a cycle passes.

    Forward colours give each node the smallest node that reaches it; among nodes of one colour, those that reach that
    node as well are its component. What is left, less the edges between colours, goes into the next turn. An
    edge between components is in no cycle; loops and repeated edges do no harm.
    """
    steps, kept = Steps(edges.sparkSession), Steps(edges.sparkSession)
    found = []
    live = kept.keep(edges.filter("src <> dst").select("src", "dst").distinct(), KEPT)
    none = live.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    while not live.isEmpty():
        colour = kept.keep(_smallest_above(live, steps), KEPT)
        a, b = colour.select(F.col("node").alias("src"), F.col("m").alias("a")), colour.select(F.col("node").alias("dst"), F.col("m").alias("b"))
        same = kept.keep(live.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").filter("a = b").select("src", "dst"), KEPT)
        # the smallest node that a node reaches inside of its colour is the colour itself, if any path leads there
        back = _smallest_above(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), steps)
        part = kept.keep(colour.join(back.select("node", F.col("m").alias("back")).hint("merge"), "node").filter("m = back").select("node", F.col("m").alias("component")), KEPT)
        several = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(part.join(several.hint("merge"), "component", "left_semi").select("node", "component"))
        live = same.join(part.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(part.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")
        live = kept.keep(live, KEPT)
    return reduce(DataFrame.unionByName, found) if found else none


def _circular(edges: DataFrame, steps: Steps) -> DataFrame:
    """Edges (src, dst, weight) inside of strongly connected components, and the component's number of nodes ``size``."""
    parts = strong_components(edges)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    a = parts.join(sizes.hint("merge"), "component").select(F.col("node").alias("src"), F.col("component").alias("ca"), "size")
    b = parts.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return steps.keep(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").filter("ca = cb").select("src", "dst", "weight", "size"), KEPT)


def _cycles_by_length(edges: DataFrame) -> Iterator[tuple[int, DataFrame, bool]]:
    """For 2, 3 and more nodes: (length, the cycles of that length, may there be longer ones). Paths start at the cycle's
    smallest node, stay inside of their component and are no longer than it."""
    steps = Steps(edges.sparkSession)
    live = _circular(edges.filter("src <> dst").select("src", "dst", "weight"), steps)
    back = live.select(F.col("src").alias("last"), F.col("dst").alias("first"), F.col("weight").alias("w"))
    onward = live.select(F.col("src").alias("last"), F.col("dst").alias("next"), F.col("weight").alias("w"))
    paths = live.filter("src < dst").select("size", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.col("weight").alias("low"))
    n = 2
    while True:
        closed = paths.join(back.hint("merge"), ["last", "first"]).select("path", F.lit(n).alias("length"), F.least("low", "w").alias("min_weight"))
        longer = paths.filter(F.col("size") > n)
        more = not longer.isEmpty()
        yield n, closed, more
        if not more:
            return
        n += 1
        longer = longer.join(onward.hint("merge"), "last").filter("next > first and not array_contains(path, next)")
        paths = steps.keep(longer.select("size", "first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"), F.least("low", "w").alias("low")), KEPT)


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(path, length, min_weight): simple directed cycles, each once, from its smallest node on.

    Edges between strongly connected components are cut first, so no path is followed that can't come back. Without
    ``longest``, cycles of any length are found; a component of n nodes has none longer than n, but may have as many as n!
    of them: for dense graphs give a length or take :func:`first_cycles`.
    """
    out = None
    for n, closed, _ in _cycles_by_length(edges):
        if longest is not None and n > longest:
            break
        out = closed if out is None else out.unionByName(closed)
    return out


def first_cycles(edges: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` shortest cycles, of equal length the first by their nodes joined by bars. Lengths are deepened only until there are
    enough, or none longer can be."""
    out = None
    for _, closed, _ in _cycles_by_length(edges):
        out = closed if out is None else out.unionByName(closed)
        if out.limit(most).count() >= most:
            break
    return out.orderBy("length", F.array_join("path", "|")).limit(most)


def contact_edges(rows: DataFrame, a: str = "sender", b: str = "recipient") -> DataFrame:
    """Undirected, without self-contacts and unknown ends; weight = rows."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & (F.col(a) != "Unknown") & (F.col(b) != "Unknown")
    return rows.filter(ok).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """contacts, and degree centrality = contacts / (n - 1)."""
    d = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("contacts"))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    return d.crossJoin(F.broadcast(n)).select("node", "contacts", F.when(F.col("_n") > 1, F.col("contacts") / (F.col("_n") - 1)).otherwise(1.0).alias("centrality"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node name reachable. Each round hooks every node to its smallest
    neighbour and contracts the graph, about log(n) rounds. A round writes three tables and reads those of the
    round before; older ones are deleted."""
    spark = edges.sparkSession
    steps = Steps(spark)
    live = steps.keep(edges.filter("src <> dst").select("src", "dst").distinct(), 6)
    if live.isEmpty():
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = None
    while True:
        ends = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = steps.keep(ends.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("to")), 6)
        if labels is None:
            labels = hook.withColumnRenamed("to", "component")
        else:
            labels = labels.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = steps.keep(labels, 6)
        a, b = hook.select(F.col("node").alias("src"), F.col("to").alias("a")), hook.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        live = steps.keep(live.join(a, "src").join(b, "dst").filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), 6)
        if live.isEmpty():
            return labels


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 40) -> DataFrame:
    """Weighted, undirected edges both ways, a fixed number of rounds. Joins merge sorted tables: ten rounds of broadcasts would be
    held by the driver at once."""
    fixed, steps = Steps(edges.sparkSession), Steps(edges.sparkSession)
    e = both_ways(edges)
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    e = fixed.keep(e.join(out.hint("merge"), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    n = out.count()
    ranks = steps.keep(out.select(F.col("src").alias("node"), F.lit(1.0 / max(1, n)).alias("rank")), 2)
    for k in range(rounds):
        got = e.join(ranks.hint("merge"), e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        ranks = got.select(F.col("dst").alias("node"), (F.lit((1 - alpha) / max(1, n)) + F.lit(alpha) * F.col("s")).alias("rank"))
        if k % 10 == 9 or k == rounds - 1:
            ranks = steps.keep(ranks, 2)
    return ranks


def _spread(edges: DataFrame, column: str = "weight") -> DataFrame:
    """Both directions of each edge: (src, dst, w)."""
    return both_ways(edges.select("src", "dst", F.col(column).alias("weight"))).withColumnRenamed("weight", "w")


def _distances(edges: DataFrame, sources: DataFrame, steps: Steps) -> DataFrame:
    """(s, node, d): the length of the shortest way from each source to what it reaches, along ``edges`` (src, dst, w).
    Only what got nearer in a round is followed in the next one."""
    front = steps.keep(sources.select(F.col("node").alias("s"), "node", F.lit(0).cast("double").alias("d")), KEPT)
    dist = front
    while True:
        there = front.join(edges, front["node"] == edges["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        known = dist.withColumnRenamed("d", "old")
        front = steps.keep(there.join(known, ["s", "node"], "left").filter("old is null or d < old").select("s", "node", "d"), KEPT)
        if front.isEmpty():
            return dist
        dist = steps.keep(dist.unionByName(front).groupBy("s", "node").agg(F.min("d").alias("d")), KEPT)


def _sums_along(start: DataFrame, dag: DataFrame, at: str, to: str, steps: Steps) -> list[DataFrame]:
    """(s, node, x) summed over all ways of 0, 1, 2 and more edges of ``dag`` from ``at`` to ``to``."""
    parts = [start]
    while True:
        x = parts[-1].join(dag.select("s", F.col(at).alias("node"), F.col(to).alias("_to")), ["s", "node"]).groupBy("s", F.col("_to").alias("node")).agg(F.sum("x").alias("x"))
        x = steps.keep(x, KEPT)
        if x.isEmpty():
            return parts
        parts.append(x)


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): over all sources, the share of shortest ways from them that pass a node.

    Edges on shortest ways make an acyclic graph per source. Forward, level by level, the ways to a node are counted;
    backward, each node hands the reciprocal of its count to those before it, and what comes together at a node times its
    own count is its dependency.
    """
    steps = Steps(edges.sparkSession)
    dist = _distances(edges, sources, steps)
    u, v = dist.select("s", F.col("node").alias("src"), F.col("d").alias("du")), dist.select("s", F.col("node").alias("dst"), F.col("d").alias("dv"))
    dag = steps.keep(u.join(edges, "src").join(v, ["s", "dst"]).filter("du + w = dv").select("s", "src", "dst"), KEPT)
    total = lambda parts: reduce(DataFrame.unionByName, parts).groupBy("s", "node").agg(F.sum("x").alias("x"))
    ways = _sums_along(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("x")), dag, "src", "dst", steps)
    sigma = steps.keep(total(ways), KEPT)
    back = _sums_along(sigma.select("s", "node", (1 / F.col("x")).alias("x")), dag, "dst", "src", steps)[1:]
    if not back:
        return sigma.limit(0).select("node", F.col("x").alias("b"))
    through = total(back).withColumnRenamed("x", "h").join(sigma, ["s", "node"]).filter("s <> node")
    out = through.groupBy("node").agg(F.sum(F.col("x") * F.col("h")).alias("b"))
    out = Steps(edges.sparkSession).keep(out)
    steps.forget()
    return out


def _batches(nodes: DataFrame, n: int) -> Iterator[DataFrame]:
    """``nodes`` in parts by hash, so that each part's rows for all nodes are ``PAIR_ROWS``, about."""
    parts = max(1, -(-n * nodes.count() // PAIR_ROWS))
    for k in range(parts):
        yield nodes.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)) == k) if parts > 1 else nodes


def _summed_up(parts: Iterator[DataFrame], e: DataFrame) -> DataFrame:
    """(node, b) summed over ``parts``. What has been found is written once a part, so no plan holds them all."""
    steps, sums = Steps(e.sparkSession), None
    for part in parts:
        both = part if sums is None else sums.unionByName(part)
        sums = steps.keep(both.groupBy("node").agg(F.sum("b").alias("b")), 2)
    return sums


def sources_for(n: int, error: float, chance: float = 0.05) -> int:
    """Sources, drawn at random, that bring the normalised betweenness of all ``n`` nodes within ``error`` of the exact one,
    but for the chance. A source's part of a node's figure lies between 0 and 1, so Hoeffding's bound
    holds: 2 n exp(-2 k error ** 2) <= chance."""
    return math.ceil(math.log(2 * n / chance) / (2 * error**2))


def _by_neighbours(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, rows: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes with equally many edges in, up to ``rows`` of them: (nodes, the other ends of their edges, weights), a row per node."""
    order = np.argsort(dst, kind="stable")
    src, w, degree = src[order], w[order], np.bincount(dst, minlength=n)
    start = np.cumsum(degree) - degree
    out = []
    for d in np.unique(degree[degree > 0]):
        alike = np.flatnonzero(degree == d)
        for at in range(0, len(alike), rows):
            nodes = alike[at : at + rows]
            places = start[nodes][:, None] + np.arange(d)
            out.append((nodes, src[places], w[places]))
    return out


def _nearest(groups: list, n: int, sources: np.ndarray) -> np.ndarray:
    """Distances, a row per node and a column per source: nodes take what is least over their edges until nothing changes."""
    far = np.full((n, len(sources)), np.inf)
    far[sources, np.arange(len(sources))] = 0
    while True:
        changed = False
        for nodes, ends, w in groups:
            if ends.shape[1] <= len(nodes):
                new = far[ends[:, 0]] + w[:, 0, None]
                for j in range(1, ends.shape[1]):
                    np.minimum(new, far[ends[:, j]] + w[:, j, None], out=new)
            else:
                new = np.stack([(far[e] + x[:, None]).min(axis=0) for e, x in zip(ends, w)])
            old = far[nodes]
            if (new < old).any():
                changed = True
                far[nodes] = np.minimum(old, new)
        if not changed:
            return far


def _last_edges(groups: list, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that end shortest ways, as places in the flattened ``far``: (from, to)."""
    width, a, b = far.shape[1], [], []
    for nodes, ends, w in groups:
        here = far[nodes]
        if ends.shape[1] <= len(nodes):
            known = np.isfinite(here)
            for j in range(ends.shape[1]):
                r, c = np.nonzero((far[ends[:, j]] + w[:, j, None] == here) & known)
                a.append(ends[r, j] * width + c)
                b.append(nodes[r] * width + c)
        else:
            for v, e, x, own in zip(nodes, ends, w, here):
                r, c = np.nonzero((far[e] + x[:, None] == own) & np.isfinite(own))
                a.append(e[r] * width + c)
                b.append(v * width + c)
    return np.concatenate(a), np.concatenate(b)


def _summed(x: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``x`` summed along all ways of one and more edges from ``a`` to ``b``, by the number of their edges; what leaves a place is
    taken ``times``."""
    total = np.zeros_like(x)
    while True:
        y = (x * times)[a]
        on = np.flatnonzero(y)
        if not len(on):
            return total
        x = np.bincount(b[on], weights=y[on], minlength=len(x))
        total += x


def _passed(groups: list, n: int, sources: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per node the shares of shortest ways from ``sources`` to other nodes that pass it, summed (see :func:`_dependencies`). A node stands
    for ``size`` alike (:func:`_alike`), each of which is a source, a place to pass and an end; the figure is that of one."""
    far = _nearest(groups, n, sources)
    a, b = _last_edges(groups, far)
    at, times = np.zeros(far.size), np.repeat(size, len(sources))
    start = sources * len(sources) + np.arange(len(sources))
    # no shortest way passes two that are alike, so of a source's own only itself is ever passed
    at[start] = times[start] = 1
    ways = at + _summed(at, a, b, times)
    onward = np.divide(1, ways, out=np.zeros_like(ways), where=ways > 0)
    through = (_summed(onward, b, a, times) * ways).reshape(far.shape)
    through[sources, np.arange(len(sources))] = 0
    return through @ size[sources]


def _between_alike(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, size: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """What :func:`_passed` lacks: ways from nodes that ``mine`` stand for to those alike, by way of their nearest neighbours."""
    nearest, own = np.full(n, np.inf), np.zeros(n, bool)
    np.minimum.at(nearest, src, w)
    own[mine] = True
    on = own[src] & (size[src] > 1) & (w == nearest[src])
    src, dst = src[on], dst[on]
    many = np.bincount(src, weights=size[dst], minlength=n)
    return np.bincount(dst, weights=size[src] * (size[src] - 1) / many[src], minlength=n)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(edges both ways (src, dst, w), nodes (node, id) with numbers that differ, how many nodes, how many edges)."""
    steps = Steps(edges.sparkSession)
    e = steps.keep(_spread(edges), KEPT)
    nodes = e.select(F.col("src").alias("node")).distinct()
    ids = steps.keep(nodes.withColumn("id", F.monotonically_increasing_id()), KEPT)
    return e, ids, ids.count(), e.count()


def _alike(e: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Nodes with the same edges to the same nodes are one: (nodes (node, c, size) with the id that stands for them and how many they
    are, edges (a, b, w, m) between those that stand for others, with the size of b, how many nodes and edges are left).

    Edges are told by two hashes of 64 bits each, put together by exclusive or, and by their number. Loops are on no shortest way.
    """
    e = e.filter("src <> dst")
    rows = e.groupBy("src", "dst", "w").agg(F.count(F.lit(1)).alias("times"))
    marks = [F.bit_xor(F.xxhash64("dst", "w", "times", F.lit(k))) for k in (1, 2)]
    kinds = rows.groupBy(F.col("src").alias("node")).agg(marks[0].alias("k1"), marks[1].alias("k2"), F.count(F.lit(1)).alias("k3"))
    kinds = kinds.join(ids.hint("merge"), "node")
    of = kinds.groupBy("k1", "k2", "k3").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("size"))
    nodes = Steps(e.sparkSession).keep(kinds.join(of.hint("merge"), ["k1", "k2", "k3"]).select("node", "id", "c", "size"))
    stands = nodes.filter("id = c")
    a, b = stands.select(F.col("node").alias("src"), F.col("c").alias("a")), stands.select(F.col("node").alias("dst"), F.col("c").alias("b"), F.col("size").cast("double").alias("m"))
    left = e.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("a", "b", F.col("w").cast("double").alias("w"), "m")
    return nodes, left, stands.count(), left.count()


def _from_held(known: DataFrame, picked: DataFrame, n: int, n_edges: int, near: bool) -> DataFrame:
    """For a graph of up to ``HELD_EDGES`` (a, b, w, m), see :func:`_alike`: (id, b) of :func:`_passed` over the sources ``picked`` or, if
    ``near``, (id, reach, far) of each of them.

    Sources are dealt to tasks by their number, and each task gets the edges beside them by the shuffle, packed in arrays. There it
    works on tables of nodes by some of its sources, as many as ``HELD_PAIRS`` allows.
    """
    packed = known.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(1 + n_edges // 10_000)).alias("_k")).agg(F.collect_list(F.struct("a", "b", "w", "m")).alias("held"))
    tasks = int(max(1, min(MOST_TASKS, n, n * n_edges // TASK_WORK)))
    graph = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("g"), "held", F.lit(None).cast("array<bigint>").alias("sources"))
    part = F.pmod("id", F.lit(tasks)).cast("int")
    dealt = picked.groupBy(part.alias("g")).agg(F.collect_list("id").alias("sources")).select("g", F.lit(None).cast(graph.schema["held"].dataType).alias("held"), "sources")
    width = max(1, HELD_PAIRS // max(1, n), min(32, 4 * HELD_PAIRS // max(1, n)))
    rows = max(1, STEP_PAIRS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sources = [], []
        for batch in batches:
            held = batch.column("held").flatten()
            parts.append([held.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w", "m")])
            sources.append(batch.column("sources").flatten().to_numpy(zero_copy_only=False))
        if not parts:
            return
        src, dst, w, m = (np.concatenate(x) for x in zip(*parts))
        # every node has an edge each way
        ids, src = np.unique(src, return_inverse=True)
        dst, size = np.searchsorted(ids, dst), np.ones(n)
        size[dst] = m
        groups = _by_neighbours(src, dst, w, n, rows)
        mine = np.searchsorted(ids, np.sort(np.concatenate(sources)))
        total = np.zeros(n)
        if not near:
            total += _between_alike(src, dst, w, n, size, mine)
        for at in range(0, len(mine), width):
            some = mine[at : at + width]
            if not near:
                total += _passed(groups, n, some, size)
                continue
            far = _nearest(groups, n, some)
            known = np.isfinite(far)
            # those alike are two steps away
            steps = size @ np.where(known, far, 0) + 2 * (size[some] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((size @ known).astype(np.int64)), pa.array(steps)], ["id", "reach", "far"])
        if not near:
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(total[found])], ["id", "b"])

    return graph.unionByName(dealt).repartitionById(tasks, "g").mapInArrow(run, "id bigint, reach bigint, far double" if near else "id bigint, b double")


def betweenness(edges: DataFrame, weighted: bool = True, share: float = 1.0) -> DataFrame:
    """(node, betweenness), normalised; weights are distances if ``weighted``.

    All nodes are sources, whatever the size of the graph. Nodes with the same edges are taken together (:func:`_alike`); if up to
    ``HELD_EDGES`` are left, they go to each task beside the task's sources (:func:`_from_held`). Of a larger one shortest ways are found for batches of sources at once by joins, so that it is
    never in one place. Only a caller that asks for a ``share`` below 1 gets estimates: that share of sources, by hash, is taken
    and the figures are scaled up (:func:`sources_for` tells how many an error needs).
    """
    return _betweenness(_numbered(edges), weighted, share)


def _betweenness(graph: tuple[DataFrame, DataFrame, int, int], weighted: bool, share: float = 1.0) -> DataFrame:
    e, nodes, n, _ = graph
    e = e.withColumn("w", (F.col("w") if weighted else F.lit(1)).cast("double"))
    scale = 1.0 / ((n - 1) * (n - 2)) / min(1.0, share) if n > 2 else 1.0
    if share >= 1:
        alike, left, n_left, edges_left = _alike(e, nodes)
        if edges_left <= HELD_EDGES:
            sums = _from_held(left, alike.filter("id = c").select("id"), n_left, edges_left, False).groupBy(F.col("id").alias("c")).agg((F.sum("b") * scale).alias("b"))
            found = alike.join(sums.hint("merge"), "c", "left").select("node", "b")
            return nodes.select("node").join(found.hint("merge"), "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
    picked = nodes if share >= 1 else nodes.filter(F.pmod(F.xxhash64("node"), F.lit(10**9)) < share * 10**9)
    sums = _summed_up((_dependencies(e, batch) for batch in _batches(picked.select("node"), n)), e)
    return nodes.join(sums.hint("merge"), "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _near(reach, far, n: int):
    """Closeness as a share of the nodes that are reached."""
    return F.when((far > 0) & F.lit(n > 1), (reach - 1) / far * (reach - 1) / F.lit(max(1, n - 1))).otherwise(0.0)


def closeness(edges: DataFrame, exact: bool = True, bits: int = HLL_BITS) -> DataFrame:
    """(node, closeness) by steps.

    All distances are found, whatever the size of the graph, by tasks that hold it (:func:`_from_held`) with nodes of the same neighbours
    taken together (:func:`_alike`); of a graph beyond ``HELD_EDGES`` by joins, for batches of nodes.
    Only a caller that says not ``exact`` gets estimates: each node holds a sketch of the nodes within r steps; a round unites the sketches along the edges, and
    the sums of their sizes over the rounds give the distances. There are as many rounds as the longest distance. A
    sketch of 2 ** bits bytes has a standard error of 1.04 / sqrt(2 ** bits), 3.3 % of a size at 10 bits; closeness, which has
    the square of the size over a sum of sizes, has about twice that.
    """
    return _closeness(_numbered(edges), exact, bits)


def _closeness(graph: tuple[DataFrame, DataFrame, int, int], exact: bool = True, bits: int = HLL_BITS) -> DataFrame:
    e, ids, n, _ = graph
    e, nodes, steps = e.select("src", "dst", F.lit(1.0).alias("w")), ids.select("node"), Steps(e.sparkSession)
    if exact:
        alike, left, n_left, edges_left = _alike(e.distinct(), ids)
        if edges_left <= HELD_EDGES:
            near = _from_held(left, alike.filter("id = c").select("id"), n_left, edges_left, True).withColumnRenamed("id", "c")
            found = alike.join(near.hint("merge"), "c").select("node", "reach", "far")
            found = nodes.join(found.hint("merge"), "node", "left").fillna({"reach": 1, "far": 0.0})
            return found.select("node", _near(F.col("reach"), F.col("far"), n).alias("closeness"))
        for batch in _batches(nodes, n):
            rounds = Steps(e.sparkSession)
            found = steps.keep(_distances(e, batch, rounds).groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("reach"), F.sum("d").alias("far")), KEPT)
            rounds.forget()
        found = e.sparkSession.read.schema(found.schema).parquet(*steps.paths)
        return found.select("node", _near(F.col("reach"), F.col("far"), n).alias("closeness"))
    balls = Steps(e.sparkSession)
    at = nodes.groupBy("node").agg(F.hll_sketch_agg("node", bits).alias("ball")).select("node", "ball", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("past"), F.lit(0).alias("rounds"))
    at = balls.keep(at, 2)
    while True:
        own = at.select("node", "ball", "size", "past", "rounds")
        none = [F.lit(None).cast(at.schema[c].dataType).alias(c) for c in ("size", "past", "rounds")]
        over = e.join(at.select(F.col("node").alias("src"), "ball"), "src").select(F.col("dst").alias("node"), "ball", *none)
        grown = own.unionByName(over).groupBy("node").agg(F.hll_union_agg("ball").alias("ball"), F.max("size").alias("was"), F.max("past").alias("past"), F.max("rounds").alias("rounds"))
        size = F.greatest("was", F.hll_sketch_estimate("ball"))
        at = balls.keep(grown.select("node", "ball", size.alias("size"), (F.col("past") + F.col("was")).alias("past"), (F.col("rounds") + 1).alias("rounds"), "was"), 2)
        if at.filter("size > was").isEmpty():
            # a node within d steps was missing in d rounds: what the last size lacks in each round, summed
            far = (F.col("size") * F.col("rounds") - F.col("past")).cast("double")
            return at.select("node", _near(F.least("size", F.lit(n)), far, n).alias("closeness"))


def shortest_path_centrality(edges: DataFrame, weighted: bool = True, share: float = 1.0) -> DataFrame:
    """(node, betweenness, closeness): see :func:`betweenness` and :func:`closeness`."""
    graph = _numbered(edges)
    return _betweenness(graph, weighted, share).join(_closeness(graph).hint("merge"), "node")


def _settled(graph: DataFrame, start: DataFrame, total: float, steps: Steps) -> DataFrame:
    """(id, c) after local moves: each round every node looks for the community among its neighbours' that adds most to
    the modularity, and about half of those that would gain by it move, so that neighbours don't change places for
    ever. Ends when none would gain, or after ``MOVES`` rounds.

    ``graph``: (src, dst, w) both ways, with loops; ``start``: (id, c); ``total``: sum of all w.
    """
    weights = steps.keep(graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), KEPT)
    over = graph.filter("src <> dst")
    at = steps.keep(start.join(weights, "id"), KEPT)
    for turn in range(MOVES):
        sums = at.groupBy("c").agg(F.sum("k").alias("tot"))
        links = over.join(at.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("l"))
        to = links.unionByName(at.select("id", "c", F.lit(0.0).alias("l"))).groupBy("id", "c").agg(F.sum("l").alias("l"))
        to = to.join(at.select("id", "k", F.col("c").alias("own")), "id").join(sums, "c")
        gain = F.round(F.col("l") - (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) * F.col("k") / total, 9)
        to = to.select("id", "k", "own", F.struct(gain.alias("g"), (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("c")).alias("m"))
        best = to.groupBy("id").agg(F.first("k").alias("k"), F.first("own").alias("own"), F.max("m").alias("m"))
        best = best.withColumn("to", -F.col("m.c")).withColumn("wants", F.col("to") != F.col("own"))
        goes = F.col("wants") & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        new = steps.keep(best.select("id", F.when(goes, F.col("to")).otherwise(F.col("own")).alias("c"), "k", "wants"), KEPT)
        at = new.drop("wants")
        if new.filter("wants").isEmpty():
            break
    return at.select("id", "c")


def communities(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(node, community): communities by local moves and contraction (Louvain's method) as joins; a community is named by
    its most active node, by the weights of its edges, of equals by the first.

    Nodes move in rounds (:func:`_settled`); what has come together is contracted to one node, and so on until nothing
    moves; then the nodes themselves are settled once more. The same edges give the same communities.
    """
    steps = Steps(edges.sparkSession)
    both = _spread(edges)
    active = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("active"))
    ids = steps.keep(before(active, [], ["node"], id=("sum", F.lit(1).cast("long"))), KEPT)
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    first = both.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("w") if weighted else F.lit(1)).cast("double").alias("w"))
    first = graph = steps.keep(first, KEPT)
    total = first.agg(F.sum("w")).first()[0] or 1.0
    member = ids.select("id", F.col("id").alias("c"))
    while True:
        found = _settled(graph, graph.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")), total, steps)
        if found.filter("id <> c").isEmpty():
            break
        member = steps.keep(member.join(found.select(F.col("id").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")), KEPT)
        src, dst = found.select(F.col("id").alias("src"), F.col("c").alias("a")), found.select(F.col("id").alias("dst"), F.col("c").alias("b"))
        graph = steps.keep(graph.join(src, "src").join(dst, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), KEPT)
    member = _settled(first, member, total, steps).join(ids, "id")
    name = member.groupBy("c").agg(F.max("active").alias("active")).join(member, ["c", "active"]).groupBy("c").agg(F.min("node").alias("community"))
    return member.join(name, "c").select("node", "community")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    e = both_ways(edges)
    k = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")).join(parts, "node").groupBy("community").agg(F.sum("k").alias("k"))
    a, b = parts.select(F.col("node").alias("src"), F.col("community").alias("ca")), parts.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = e.join(a, "src").join(b, "dst").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("i"))
    m2 = e.agg(F.sum("weight").alias("m2"))
    return k.join(inside, "community", "left").crossJoin(F.broadcast(m2)).agg(F.sum(F.coalesce("i", F.lit(0)) / F.col("m2") - (F.col("k") / F.col("m2")) * (F.col("k") / F.col("m2"))).alias("modularity"))


def key_players(edges: DataFrame, top: int = 50) -> DataFrame:
    """Centralities of the nodes with the highest rank."""
    edges = Steps(edges.sparkSession).keep(edges)
    out = pagerank(edges).join(degree(edges).hint("merge"), "node").join(shortest_path_centrality(edges).hint("merge"), "node")
    return out.select("node", "contacts", F.round("centrality", 4).alias("degree"), F.round("betweenness", 4).alias("betweenness"), F.round("closeness", 4).alias("closeness"), F.round("rank", 6).alias("pagerank")).orderBy(F.col("pagerank").desc(), "node").limit(top)
