"""Ranks, degrees and path centrality are joined by sorted tables: broadcasts would all be held by the driver."""

import pytest

from docketlake.functions.scratch import Steps
from docketlake.operators import graph as G

ROWS = [("a", "b", 1), ("b", "c", 2), ("a", "c", 3), ("c", "d", 1)]


def _joins(df):
    """Joins by key that the plan broadcasts a side for."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("of", [G.shortest_path_centrality, G.key_players])
def test_no_table_is_broadcast(spark, monkeypatch, of):
    keep, found = Steps.keep, []
    monkeypatch.setattr(Steps, "keep", lambda self, df, states=4: found.append(_joins(df)) or keep(self, df, states))
    out = of(spark.createDataFrame(ROWS, "src string, dst string, weight long"))
    assert {r.node for r in out.collect()} == set("abcd")
    assert sum(found) + _joins(out) == 0
