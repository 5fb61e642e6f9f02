"""Path centrality is that of all pairs of nodes, whatever the size of the graph."""

import pytest

from docketlake.operators import graph as G
from tests.test_graph import _graph, _paths, _steps


@pytest.mark.parametrize("held", [8_000_000, 0])
def test_all_nodes_are_sources(spark, monkeypatch, held):
    rows = _graph(4, 9, 0.3)
    want = _paths(rows, True)
    for limit in ("HELD_WORK", "EXACT_WORK"):
        monkeypatch.setattr(G, limit, 0, raising=False)
    monkeypatch.setattr(G, "sources_for", lambda n, error: 2)
    monkeypatch.setattr(G, "HELD_EDGES", held)
    monkeypatch.setattr(G, "PAIR_ROWS", 30)
    got = {r.node: r.betweenness for r in G.betweenness(spark.createDataFrame(rows, "src string, dst string, weight long")).collect()}
    assert got == {v: pytest.approx(b, abs=1e-9) for v, b in want.items()}


@pytest.mark.parametrize("held", [8_000_000, 0])
def test_key_players_by_all_distances(spark, monkeypatch, held):
    rows = [*_graph(11, 25, 0.1), *[(f"p{i}", f"p{i + 1}", 1) for i in range(6)]]
    want = _steps(rows)
    for limit in ("HELD_WORK", "EXACT_WORK"):
        monkeypatch.setattr(G, limit, 0, raising=False)
    monkeypatch.setattr(G.F, "hll_sketch_agg", lambda *a: pytest.fail("a sketch"))
    monkeypatch.setattr(G, "HELD_EDGES", held)
    monkeypatch.setattr(G, "PAIR_ROWS", 500)
    df = spark.createDataFrame(rows, "src string, dst string, weight long")
    if held:
        got = {r.node: r.closeness for r in G.key_players(df).collect()}
        assert got == {v: pytest.approx(c, abs=5.1e-5) for v, c in want.items()}
    assert {r.node: r.closeness for r in G.closeness(df).collect()} == {v: pytest.approx(c, abs=1e-12) for v, c in want.items()}
