"""Ways of a graph that tasks hold are those that joins find, and are found without a join per step."""

import pytest

from docketlake.functions.scratch import Steps
from docketlake.operators import graph as G
from tests.test_graph import _graph, _paths, _steps


@pytest.mark.parametrize("weighted", [True, False])
def test_held_in_parts(spark, monkeypatch, weighted):
    """A hub, ties, and a part of its own; several tasks, and several tables of nodes by sources in each."""
    rows = [*_graph(3, 8, 0.3), *[("hub", f"n{k:02d}", 1 + k % 2) for k in range(8)], ("p1", "p2", 2), ("p2", "p3", 2)]
    monkeypatch.setattr(G, "TASK_WORK", 200)
    monkeypatch.setattr(G, "HELD_PAIRS", 30)
    got = {r.node: r for r in G.shortest_path_centrality(spark.createDataFrame(rows, "src string, dst string, weight long"), weighted).collect()}
    between, near = _paths(rows, weighted), _steps(rows)
    assert got.keys() == between.keys() and max(between.values()) > 0.05
    for v, r in got.items():
        assert r.betweenness == pytest.approx(between[v], abs=1e-12) and r.closeness == pytest.approx(near[v], abs=1e-12)


def test_too_large_to_hold(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD_EDGES", 0)
    rows = [("a", "b", 1), ("b", "c", 2), ("a", "c", 3)]
    got = {r.node: r.betweenness for r in G.betweenness(spark.createDataFrame(rows, "src string, dst string, weight long")).collect()}
    assert got == {"a": 0, "b": pytest.approx(0.5), "c": 0}


def test_few_tables_are_written(spark, monkeypatch):
    keep, kept = Steps.keep, []
    monkeypatch.setattr(Steps, "keep", lambda self, df, states=4: kept.append(1) or keep(self, df, states))
    path = [(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(20)]
    G.shortest_path_centrality(spark.createDataFrame(path, "src string, dst string, weight long")).collect()
    assert len(kept) < 6


def test_key_players_in_few_steps(spark, monkeypatch):
    keep, kept = Steps.keep, []
    monkeypatch.setattr(Steps, "keep", lambda self, df, states=4: kept.append(df.columns) or keep(self, df, states))
    path = [(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(20)]
    got = G.key_players(spark.createDataFrame(path, "src string, dst string, weight long"), 3).collect()
    assert kept[0] == ["src", "dst", "weight"] and len(kept) < 12
    assert {r.node for r in got} == {"n01", "n19", "n02"} and {r.contacts for r in got} == {2}


@pytest.mark.parametrize("weighted", [True, False])
def test_nodes_alike_are_one(spark, monkeypatch, weighted):
    """Nodes of the same edges (of equal weights: h and x; of other ones: y) stand for each other; figures are those of all pairs."""
    rows = [*_graph(3, 6, 0.5), *[(f"{k}{j}", n, w + (k == "y") * j) for k in "hxy" for j in range(3) for n, w in (("n00", 1), ("n01", 1 + (k == "x")), ("n03", 2))]]
    sizes, run = [], G._from_held
    monkeypatch.setattr(G, "_from_held", lambda known, picked, n, n_edges, near: sizes.append(n) or run(known, picked, n, n_edges, near))
    got = {r.node: r for r in G.shortest_path_centrality(spark.createDataFrame(rows, "src string, dst string, weight long"), weighted).collect()}
    between, near = _paths(rows, weighted), _steps(rows)
    assert got.keys() == between.keys() and max(sizes) < len(got)
    for v, r in got.items():
        assert r.betweenness == pytest.approx(between[v], abs=1e-12) and r.closeness == pytest.approx(near[v], abs=1e-12)
