"""Readers and writers on files made here."""

import datetime as dt
import io
import mailbox
import zipfile
from email.message import EmailMessage

from docketlake.sources import files as Fi
from docketlake.sources import sinks as S
from docketlake.sources import tables as Ta


def _write(path, text, enc="utf-8"):
    path.write_bytes(text.encode(enc))
    return str(path)


def test_csv_aliases(spark, tmp_path):
    p = _write(tmp_path / "b.csv", "Invoice Date,Attorney,Hours,Rate,Narrative\n1/2/2024,Bob,2.5,100,Call\nnever,Ann,x,5,\n")
    rows = Ta.billing(Ta.read_csv(spark, p)).orderBy("timekeeper").collect()
    assert [(r.timekeeper, r.hours, r.amount, r.description) for r in rows] == [("Ann", None, None, ""), ("Bob", 2.5, 250.0, "Call")]
    assert rows[1].date == dt.datetime(2024, 1, 2) and rows[0].date is None


def test_two_headers_of_one_field(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "attorney string, `Name` string")
    assert sorted(r.timekeeper for r in Ta.billing(df).collect()) == ["a", "b"]


def test_debit_and_credit(spark):
    df = spark.createDataFrame([("2024-01-01", "5", None), ("2024-01-02", None, "7"), ("2024-01-03", None, None)], "date string, debit string, credit string")
    assert [r.amount for r in Ta.transactions(df).orderBy("date").collect()] == [-5.0, 7.0, None]
    assert [r.amount for r in Ta.transactions(df).orderBy("date").collect()][:2] == [-5.0, 7.0]


def test_ledes(spark, tmp_path):
    p = _write(tmp_path / "x.txt", "LEDES1998B[]\nINVOICE_DATE|TIMEKEEPER_NAME|LINE_ITEM_TOTAL|[]\n\n20240102|Bob|12.5|[]\n20240103|Ann[]\n")
    rows = Ta.billing(Ta.read_ledes(spark, p)).orderBy("date").collect()
    assert [(r.timekeeper, r.amount) for r in rows] == [("Bob", 12.5), ("Ann", None)]


def test_ofx(spark, tmp_path):
    p = _write(tmp_path / "x.ofx", "<ACCTID>77\n<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240105120000<TRNAMT>-9.5<NAME>Shop<MEMO>m</STMTTRN><STMTTRN><DTPOSTED>20240106<TRNAMT>3<NAME>Q</STMTTRN>")
    rows = Ta.read_ofx(spark, p).orderBy("date").collect()
    assert [(r.amount, r.description, r.account, r.category) for r in rows] == [(-9.5, "Shop - m", "77", "DEBIT"), (3.0, "Q", "77", "")]


def test_chat(spark, tmp_path):
    p = _write(tmp_path / "c.txt", "[1/2/2024, 9:05:00 PM] Bob: hi: you\nmore\n1/3/24, 08:00 - Ann: yo\n")
    rows = Ta.read_chat(spark, p).orderBy("datetime").collect()
    assert [(r.sender, r.recipient, r.content_preview) for r in rows] == [("Bob", "Group", "hi: you"), ("Ann", "Group", "yo")]
    assert rows[0].datetime == dt.datetime(2024, 1, 2, 21, 5)
    assert Ta.sniff("LEDES1998B", "a.txt") == "ledes" and Ta.sniff("[1/2/2024, x", "a.txt") == "chat" and Ta.sniff("", "a.qfx") == "ofx"


def test_mail(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "A <a@x.org>", "b@y.org", "S", "<1@x>"
    m.set_content("plain body")
    m.add_attachment(b"123", maintype="application", subtype="pdf", filename="a/b.pdf")
    (tmp_path / "one.eml").write_bytes(bytes(m))
    html = EmailMessage()
    html["From"] = "c@x.org"
    html.set_content("<p>only  <b>html</b></p>", subtype="html")
    box = mailbox.mbox(tmp_path / "all.mbox")
    box.add(m), box.add(html)
    box.flush()
    (tmp_path / "bad.eml").write_bytes(b"\xff\xfe")
    eml = {r.source_file: r for r in Fi.read_eml(spark, str(tmp_path)).collect()}
    assert eml["one.eml"].body.strip() == "plain body" and eml["one.eml"].attachments[0].size == 3
    assert [r.body.strip() for r in Fi.read_mbox(spark, str(tmp_path)).orderBy("email_idx").collect()] == ["plain body", "only html"]


def test_mailboxes_split_anywhere(spark, tmp_path):
    """The rows do not depend on where a mailbox is cut; quoted From lines, other line ends and bytes that are no UTF-8."""
    mails = [f"From a@x Mon\nSubject: s{i}\n\n" + ("text From here\n>From there\nFrom no blank line before\n" * (i % 4)) + f"end {i}\n\n" for i in range(60)]
    (tmp_path / "a.mbox").write_text("".join(mails))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.mbox").write_bytes(b"From x\r\nSubject: one\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9\r\n\r\nFrom y\r\n\r\n\r\nFrom z\r\nSubject: two\r\n\r\nx\r\n")
    plain = sorted((r[0], r[1], r[8], r[9]) for p in tmp_path.rglob("*.mbox") for r in Fi.parse_mbox(p.name, p.read_bytes()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for cut in ("512", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            got = Fi.read_mbox(spark, str(tmp_path)).select("source_file", "email_idx", "subject", "body", "_error").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert all(r._error is None for r in got) and sorted((r[0], r[1], r[2], r[3].strip()) for r in got) == [(*x[:3], x[3].strip()) for x in plain] and len(got) == 62
    assert any("café" in r.body for r in got)


def test_docx_and_xlsx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", doc)
    rows = Fi.read_docx(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.text, r.level) for r in rows] == [("Title", 1), ("[TABLE]\na | b\n[/TABLE]", 0)]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Hours</t></is></c></row><row><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Attorney</t></si></sst>")
    (tmp_path / "t.xlsx").write_bytes(buf.getvalue())
    got = Ta.billing(Fi.read_xlsx(spark, str(tmp_path))).collect()
    assert [(r.timekeeper, r.hours) for r in got] == [("Unknown", 2.5)]
    for folder, rows in (("a", [["Attorney", "Hours"], ["Ann", "1"]]), ("b", [["HOURS", "Rate", "Attorney"], ["2", "30", "Bob"], ["3"]])):
        (tmp_path / "x" / folder).mkdir(parents=True)
        (tmp_path / "x" / folder / "t.xlsx").write_bytes(S.workbook_bytes(rows))
    (tmp_path / "x" / "bad.xlsx").write_bytes(b"no workbook")
    books = Fi.read_xlsx(spark, str(tmp_path / "x"))
    assert sorted((r.timekeeper, r.hours, r.rate or 0) for r in Ta.billing(books).collect()) == [("Ann", 1.0, 0), ("Bob", 2.0, 30.0), ("Unknown", 3.0, 0)]
    assert [(r._source_file, r._line) for r in books.filter("_error is not null").collect()] == [("bad.xlsx", None)]


def test_intakes_text_and_calendar(spark, tmp_path):
    j = tmp_path / "j"
    j.mkdir()
    _write(j / "a.json", '{"name": "Bob", "age": 4}')
    assert Ta.read_intake_json(spark, str(j)).first().text.split("\n") == ["age: 4", "name: Bob"]
    c = _write(tmp_path / "c.csv", "name,note\nBob,x\n")
    assert Ta.read_intake_csv(spark, c).first().text == "--- Client 1 ---\nname: Bob\nnote: x"
    two = tmp_path / "two"
    for folder, text in (("a", "name,note\nZoe,1\nAda,\n\"B\nC\",2\n"), ("b", "name,note\nEve,\n")):
        (two / folder).mkdir(parents=True)
        _write(two / folder / "c.csv", text)
    assert sorted(r.text for r in Ta.read_intake_csv(spark, str(two)).collect()) == ["--- Client 1 ---\nname: Eve", "--- Client 1 ---\nname: Zoe\nnote: 1\n\n--- Client 2 ---\nname: Ada\n\n--- Client 3 ---\nname: B\nC\nnote: 2"]
    for folder, head, row in (("x", "INVOICE_DATE|TIMEKEEPER_NAME", "20240101|Ann"), ("y", "TIMEKEEPER_NAME|INVOICE_DATE", "Bob|20240102")):
        (tmp_path / "l" / folder).mkdir(parents=True)
        _write(tmp_path / "l" / folder / "x.txt", f"LEDES1998B[]\n{head}|[]\n{row}|[]\n")
    got = Ta.billing(Ta.read_ledes(spark, str(tmp_path / "l"))).collect()
    assert sorted((r.timekeeper, r.date.day, r._line) for r in got) == [("Ann", 1, 2), ("Bob", 2, 2)]
    t = _write(tmp_path / "t.md", "# Head\nbody")
    assert [(r.text, r.level) for r in Ta.read_text_blocks(spark, t).orderBy("pos").collect()] == [("Head", 1), ("body", 0)]
    due = spark.createDataFrame([(1, 0, "Answer, due", dt.date(2024, 1, 5), "R 1")], "request_id long, step int, name string, due date, rule string")
    text = S.calendar_events(due).first().value
    assert "DTSTART;VALUE=DATE:20240105" in text and "SUMMARY:Answer\\, due" in text and "TRIGGER:-P2D" in text
    S.write_calendars(due, str(tmp_path / "cal"))
    chunks = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "doc_id long, chunk long, text string")
    assert [r.text for r in S.global_chunk_ids(chunks).orderBy("global_id").collect()] == ["a", "b", "c"]


def test_streams(spark, tmp_path):
    from docketlake.streaming import monitors as M

    src = spark.createDataFrame([("a", dt.datetime(2024, 1, d)) for d in (1, 1, 2, 9)], "sender string, datetime timestamp")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("daily", M.daily_volume(stream)), ("quiet", M.silences(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r.day.day, r.n) for r in spark.table("daily").collect()} == {(1, 2), (2, 1)}
    assert spark.table("quiet").count() == 1


def test_jobs(spark, tmp_path):
    import json

    from docketlake.sources import jobs

    p = _write(tmp_path / "x.qfx", "<STMTTRN><DTPOSTED>20240106<TRNAMT>3<NAME>Q</STMTTRN>")
    assert jobs.resolve("x.qfx", ["/nowhere", str(tmp_path)]) == tmp_path / "x.qfx" and jobs.resolve("no", []) is None
    kind, rows = jobs.read_any(spark, p)
    assert kind == "ofx" and rows.first().account == "x.qfx"
    jobs.write_status(str(tmp_path / "s.json"), state="running")
    assert json.loads((tmp_path / "s.json").read_text())["state"] == "running"
