"""Graph operators against plain counts on small random graphs."""

import itertools
import random
from collections import defaultdict, deque

from docketlake.operators import graph as G


def _graph(seed, n=12, p=0.2):
    r = random.Random(seed)
    return [(f"n{a:02d}", f"n{b:02d}", r.randint(1, 4)) for a, b in itertools.combinations(range(n), 2) if r.random() < p]


def _paths(rows, weighted):
    """Betweenness by listing all shortest paths."""
    adj = defaultdict(dict)
    for a, b, w in rows:
        adj[a][b] = adj[b][a] = w if weighted else 1
    nodes = sorted(adj)
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, found = None, []
        stack = [(s, 0, [s])]
        while stack:
            v, d, path = stack.pop()
            if best is not None and d > best:
                continue
            if v == t:
                if best is None or d < best:
                    best, found = d, []
                found.append(path)
                continue
            stack += [(w, d + k, [*path, w]) for w, k in adj[v].items() if w not in path]
        found = [p for p in found if sum(adj[a][b] for a, b in zip(p, p[1:])) == best]
        for p in found:
            for v in p[1:-1]:
                score[v] += 1 / len(found)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_and_closeness(spark):
    for seed, weighted in ((1, True), (2, False)):
        rows = _graph(seed, 9, 0.3)
        got = {r.node: r for r in G.shortest_path_centrality(spark.createDataFrame(rows, "src string, dst string, weight long"), weighted).collect()}
        want = _paths(rows, weighted)
        assert got.keys() == want.keys()
        assert all(abs(got[k].betweenness - want[k]) < 1e-9 for k in want)
        assert all(0 < r.closeness <= 1 for r in got.values())


def test_components(spark):
    rows = _graph(5, 30, 0.05) + [(f"p{i:03d}", f"p{i + 1:03d}", 1) for i in range(60)]
    adj = defaultdict(set)
    for a, b, _ in rows:
        adj[a].add(b), adj[b].add(a)
    want = {}
    for s in sorted(adj):
        if s not in want:
            queue = deque([s])
            want[s] = s
            while queue:
                for w in adj[queue.popleft()]:
                    if w not in want:
                        want[w] = s
                        queue.append(w)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(rows, "src string, dst string, weight long")).collect()}
    assert got == want
    assert G.components(spark.createDataFrame([], "src string, dst string, weight long")).count() == 0


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame(_graph(7), "src string, dst string, weight long")
    assert abs(sum(r["rank"] for r in G.pagerank(e).collect()) - 1) < 1e-9


def test_communities_of_two_cliques(spark):
    rows = [(f"{g}{a}", f"{g}{b}", 1) for g in "xy" for a, b in itertools.combinations(range(5), 2)] + [("x0", "y0", 1)]
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    got = {r.node: r.community for r in G.communities(e).collect()}
    assert len(set(got.values())) == 2 and all(got[f"x{i}"] == got["x0"] for i in range(5))
    assert G.modularity(e, spark.createDataFrame(list(got.items()), "node string, community string")).first()[0] > 0.4


def _steps(rows):
    """Closeness by breadth-first search."""
    adj = defaultdict(set)
    for a, b, _ in rows:
        adj[a].add(b), adj[b].add(a)
    out = {}
    for s in adj:
        dist, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        out[s] = (len(dist) - 1) / sum(dist.values()) * (len(dist) - 1) / (len(adj) - 1)
    return out


def test_closeness_by_sketches(spark):
    """Within twice the sketches' standard error of the exact one, on average far nearer."""
    rows = _graph(11, 300, 0.02) + [(f"p{i:03d}", f"p{i + 1:03d}", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    want = _steps(rows)
    got = {r.node: r.closeness for r in G.closeness(df, exact=False).collect()}
    off = [abs(got[v] - want[v]) / want[v] for v in want]
    assert got.keys() == want.keys() and max(off) < 0.2 and sum(off) / len(off) < 0.07


def test_centrality_in_batches_and_by_samples(spark, monkeypatch):
    rows = _graph(12, 40, 0.15)
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    whole = {r.node: r.betweenness for r in G.betweenness(df).collect()}
    monkeypatch.setattr(G, "PAIR_ROWS", 600)
    assert {r.node: round(r.betweenness, 12) for r in G.betweenness(df).collect()} == {v: round(x, 12) for v, x in whole.items()}
    assert G.sources_for(1_000_000, 0.01) == 87_522 and G.sources_for(10, 0.5) == 12
    some = {r.node: r.betweenness for r in G.betweenness(df, share=0.5).collect()}
    assert some.keys() == whole.keys() and max(abs(some[v] - whole[v]) for v in whole) < 0.3


def test_graphs_of_one_edge_and_of_none(spark):
    one = spark.createDataFrame([("a", "b", 3)], "src string, dst string, weight long")
    assert {(r.node, r.betweenness, r.closeness) for r in G.shortest_path_centrality(one).collect()} == {("a", 0.0, 1.0), ("b", 0.0, 1.0)}
    assert G.shortest_path_centrality(one.limit(0)).count() == 0 and G.closeness(one.limit(0), exact=False).count() == 0
