"""Risks of changes are searched for once per text, and equal pairs of texts compared once."""

from pyspark.sql import functions as F

from docketlake.operators import text as T
from docketlake.plans import catalog


def test_risk_searched_once(spark):
    plan = catalog.queries()["dif4_change_risk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("indemnity") == 1


def test_risk_as_by_columns(spark):
    texts = [None, "", "The FEE", "fees", "trade  secret", "Ip  Rights", "capped", "cap", "indemnif", "hold harmless.", "soles", "sole", "days prior", "day advance", "limitation", "shall\tpay", "é fee é", "xfee", "right  of first", "a b c d e"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "old_text string, new_text string")
    r, k = T.change_risk(F.col("old_text"), F.col("new_text"))
    wrong = T.with_risk(df).withColumns({"r": r, "k": k}).filter("not (risk <=> r and category <=> k)")
    assert wrong.collect() == []


def test_equal_pairs_once(spark):
    rows = [(None, "a"), ("", None), ("Ab c", "aB d")] * 50
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()] == [T._ratio((a or "").lower(), (b or "").lower()) for a, b in rows]
