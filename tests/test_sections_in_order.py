"""Documents are cut as their sections come, many to a call of Python."""

from pyspark.sql import functions as F

from docketlake.operators import text as T


def test_no_python_group_per_document(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_ROWS", 3)
    rows = [(d, p, f"H{p}", f"text {p} of {d} " * 2) for d in range(40) for p in range(5)] + [(None, 1, None, "lost"), (None, 0, "Z", "first, lost")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, heading string, text string")
    out = T.structure_chunks(df.orderBy(F.rand(1)), 24, 4, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    got = {(r.doc_id, r.chunk): (r.heading, r.text, r.tokens) for r in out.collect()}
    text = lambda d, *ps: "\n\n".join(f"text {p} of {d} " * 2 for p in ps)
    for d in range(40):
        n = len(text(d, 0)) // 4
        assert got[d, 0] == ("H0 / H1 / H2", text(d, 0, 1, 2), 3 * n) and got[d, 1] == ("H3 / H4", text(d, 3, 4), 2 * n)
    assert got[None, 0] == ("Z / Preamble", "first, lost\n\nlost", 3) and len(got) == 81
