"""Rounds over a graph send no table through the driver."""

from docketlake.functions.scratch import Steps
from docketlake.operators import graph as G


def test_no_broadcast_in_rounds(spark, monkeypatch):
    keep, plans = Steps.keep, []

    def kept(self, df, states=4):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, states)

    monkeypatch.setattr(Steps, "keep", kept)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in G.strong_components(edges).collect()} == {("a", "a"), ("b", "a")}
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
