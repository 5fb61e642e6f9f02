"""Files of many rows: what is done per file is not done per row, and no task or batch holds more than one file."""

import datetime

from docketlake.plans import catalog, q_formats
from docketlake.sources import files as Fi
from docketlake.sources import sinks as S
from docketlake.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_account_of_a_statement_is_looked_for_once(spark, tmp_path):
    (tmp_path / "a.ofx").write_text("<acctid>77\n<STMTTRN><DTPOSTED>20240105<TRNAMT>-5.5<NAME>X</STMTTRN>\n<stmttrn>\n<DTPOSTED>20240106\n<TRNAMT>2<MEMO>m</stmttrn>")
    (tmp_path / "b.ofx").write_text("<STMTTRN><DTPOSTED>20240107<TRNAMT>1</STMTTRN>")
    x = T.read_ofx(spark, str(tmp_path))
    got = {(r.account, r.amount, r.description, r.date.date()) for r in x.collect()}
    day = lambda d: datetime.date(2024, 1, d)
    assert got == {("77", -5.5, "X", day(5)), ("77", 2.0, "m", day(6)), ("b.ofx", 1.0, "", day(7))}
    above = x._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "ACCTID" not in above and "TRNAMT" in above


def test_ledes_rows_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("\n LEDES1998B[]\n\nHours | LINE_ITEM_HOURS|Narrative|Narrative|[]\n|2|one|two[]\n 3|4|five\r\n\nshort[]\n")
    (tmp_path / "x.txt").write_text("NARRATIVE|HOURS[]\nsix|$1,000|long|longer[]\n")
    (tmp_path / "y.txt").write_text("ledes1998b[]\n\n")
    x = T.billing(T.read_ledes(spark, str(tmp_path)))
    got = {(r.description, r.hours, r._line) for r in x.select("description", "hours", "_line").collect()}
    assert got == {("one", 2.0, 4), ("five", 3.0, 5), ("", None, 7), ("six", 1000.0, 1)}
    assert "Exchange hashpartitioning" not in x._jdf.queryExecution().executedPlan().toString()


def test_batches_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(q_formats, "FILE_ROWS", 50)
    read, seen = T.read_ledes, []
    monkeypatch.setattr(T, "read_ledes", lambda s, path: seen.append(path) or read(s, path))
    rows = catalog.queries()["src3_ledes_same_names"](spark, SF).collect()
    entries = [r.entry_id for r in catalog.lens(spark, SF, "billing").select("entry_id").collect()]
    want = []
    for k in range(5):
        want += [(k, e, i) for i, e in enumerate(sorted(e for e in entries if ord(e[-1]) % 5 == k), 1)]
    assert sorted((r.batch, r.description, r.line) for r in rows) == want
    assert Fi.binary(spark, seen[0], "*.txt").count() > 10


def test_workbooks_come_to_a_worker_one_by_one(spark):
    df = spark.range(250).selectExpr("cast(id % 2 as string) AS k", "id", "if(id % 3 = 0, null, 'v' || id) AS v")
    books = S.workbooks(df, "k", "id", rows=100)
    got = {r.path: [list(c) for _, _, c in Fi.parse_xlsx(r.path, bytes(r.content))] for r in books.collect()}
    assert sorted(got) == ["0-0.xlsx", "0-1.xlsx", "1-0.xlsx", "1-1.xlsx"]
    assert got["1-1.xlsx"][0] == ["id", "v"] and [r[0] for r in got["1-1.xlsx"][1:]] == [str(i) for i in range(201, 250, 2)]
    plan = books._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan
