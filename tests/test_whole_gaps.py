"""Gaps between the dates of all documents."""

import datetime

from docketlake.plans import catalog


def test_gaps_are_of_all_dates(spark, tmp_path):
    days = ["1995-01-01", "1995-01-20", "1995-02-25", "1995-02-26", "1995-05-01", "1995-09-01"]
    rows = [(i, 1, "O", 1.0, datetime.datetime.fromisoformat(d), "1-URGENT") for i, d in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((str(r.day), str(r.next_day), r.days, r.severity) for r in catalog.queries()["win3_chr5_event_gaps"](spark, str(tmp_path)).collect())
    assert got == [("1995-01-20", "1995-02-25", 36, "low"), ("1995-02-26", "1995-05-01", 64, "medium"), ("1995-05-01", "1995-09-01", 123, "high")]
