"""Files of odd encodings and headers, images, attachments, requests, and streams of long days."""

import datetime as dt
import io
import struct
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from docketlake.functions.core import exact_median, numbered
from docketlake.operators import billing as B
from docketlake.operators import calendar as C
from docketlake.operators import mail as M
from docketlake.operators import text as T
from docketlake.sources import files as Fi
from docketlake.sources import sinks as S
from docketlake.sources import tables as Ta


def test_latin_1_files_beside_utf_8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("date,attorney,narrative\n2024-01-02,Zoë,über\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('date,attorney,narrative\n2024-01-03,Zoë,"two\nlines"\n'.encode())
    got = {r._source_file: (r.timekeeper, r.description) for r in Ta.billing(Ta.read_csv(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": ("Zoë", "über"), "b.csv": ("Zoë", "two\nlines")}


def test_ledes_with_equal_headers(spark, tmp_path):
    text = "LEDES1998B[]\nINVOICE_DATE|TIMEKEEPER_NAME|LINE_ITEM_HOURS|LINE_ITEM_HOURS|[]\n20240105|Ann|1.5|9|[]\n\n20240106|Bob|2|[]\n"
    (tmp_path / "x.ledes").write_text(text)
    got = Ta.billing(Ta.read_ledes(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r.timekeeper, r.hours, r._line) for r in got] == [("Ann", 1.5, 2), ("Bob", 2.0, 4)]


def test_lines_of_a_split_file_are_in_order(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = Ta.read_text_blocks(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert [(r.pos, r.text) for r in rows.orderBy("pos").collect()] == [(i, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def jpeg(tags, exif=(), gps=(), order="<"):
    """A JPEG of nothing but an EXIF block: lists of (tag, format, count, bytes)."""
    def directory(start, entries, next_at):
        head, tail = struct.pack(order + "H", len(entries)), b""
        for tag, form, n, value in entries:
            if len(value) > 4:
                place = struct.pack(order + "I", next_at + len(tail))
                tail += value
            else:
                place = value.ljust(4, b"\0")
            head += struct.pack(order + "HHI", tag, form, n) + place
        return head + struct.pack(order + "I", 0), tail

    def size(entries):
        return 6 + 12 * len(entries) + sum(len(v) for *_, v in entries if len(v) > 4)

    tags = [*tags, (0x8769, 4, 1, b""), (0x8825, 4, 1, b"")]
    at_exif = 8 + size(tags)
    at_gps = at_exif + size(exif)
    tags[-2] = (0x8769, 4, 1, struct.pack(order + "I", at_exif))
    tags[-1] = (0x8825, 4, 1, struct.pack(order + "I", at_gps))
    block = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    for start, entries in ((8, tags), (at_exif, list(exif)), (at_gps, list(gps))):
        head, tail = directory(start, entries, start + 6 + 12 * len(entries))
        block += head + tail
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_tags(spark, tmp_path, order):
    rational = lambda *xs: b"".join(struct.pack(order + "II", a, b) for a, b in xs)
    data = jpeg([(0x010F, 2, 6, b"Maker\0"), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x0132, 2, 20, b"2024:01:02 03:04:05\0")],
                [(0x829A, 5, 1, rational((1, 250)))], [(0x0001, 2, 2, b"S\0"), (0x0002, 5, 3, rational((33, 1), (30, 1), (0, 1)))], order)
    want = {"make": "Maker", "orientation": "6", "date": "2024:01:02 03:04:05", "exposure_time": "0.004", "gps_lat_ref": "S", "gps_lat": "33,30,0"}
    assert Fi.exif_tags(data) == want
    for cut in range(0, len(data), 7):
        try:
            assert set(Fi.exif_tags(data[:cut])) <= set(want)
        except struct.error:
            pass  # reported as no tags by read_images
    (tmp_path / "a.jpg").write_bytes(data)
    (tmp_path / "b.jpg").write_bytes(data[:60])
    (tmp_path / "c.png").write_bytes(b"\x89PNG")

    def second(b):
        if b.startswith(b"\x89"):
            raise ValueError("no such format")
        return {"make": "Other", "lens": "50mm", "none": None}

    got = {r.path.rsplit("/", 1)[1]: (r.size, r.exif) for r in Fi.read_images(spark, str(tmp_path), [Fi.exif_tags, second]).collect()}
    assert got["a.jpg"] == (len(data), want | {"lens": "50mm"}) and got["c.png"] == (4, {}) and got["b.jpg"][1]["lens"] == "50mm"


def test_attachments_are_taken_out(spark, tmp_path):
    m = EmailMessage()
    m["From"] = "a@x.org"
    m.set_content("see file")
    m.add_attachment(b"\x00\x01data", maintype="application", subtype="pdf", filename="../b c.pdf")
    m.add_attachment("text", filename="n.txt")
    (tmp_path / "one.eml").write_bytes(bytes(m))
    (tmp_path / "box.mbox").write_bytes(b"From a\n" + bytes(m) + b"\n\nFrom b\nSubject: none\n\nx\n")
    got = sorted((r.source_file, r.email_idx, r.filename, r.type, bytes(r.content).strip()) for r in Fi.read_attachments(spark, str(tmp_path)).collect())
    one = [(0, ".._b c.pdf", "application/pdf", b"\x00\x01data"), (0, "n.txt", "text/plain", b"text")]
    assert got == [(f, *x) for f in ("box.mbox", "one.eml") for x in one]


def compound(streams, cutoff=4096):
    """A compound file of streams (path to bytes); those under ``cutoff`` bytes lie in the small sectors."""
    folders = sorted({p.split("/")[0] for p in streams if "/" in p})
    names = ["Root Entry", *folders, *streams]
    sectors, mini, mini_fat, fat = [], b"", [], []

    def put(data, table, size, store):
        at, n = len(table), max(1, -(-len(data) // size))
        table += [*range(at + 1, at + n), 0xFFFFFFFE]
        store.append(data.ljust(n * size, b"\0"))
        return at

    small = []
    place = {p: put(d, mini_fat, 64, small) if len(d) < cutoff else put(d, fat, 512, sectors) for p, d in streams.items()}
    mini = b"".join(small)
    at_mini = put(mini, fat, 512, sectors) if mini else 0xFFFFFFFE
    at_mini_fat = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat), fat, 512, sectors) if mini_fat else 0xFFFFFFFE
    rows = []
    for i, n in enumerate(names):
        own = n.split("/")[-1].encode("utf-16-le")
        siblings = [k for k, m in enumerate(names) if k and m not in folders and "/" not in m] + [names.index(f) for f in folders] if i == 0 or "/" not in n else []
        kids = siblings if i == 0 else [k for k, m in enumerate(names) if m.startswith(n + "/")]
        peers = [k for k, m in enumerate(names) if k and m.rpartition("/")[0] == n.rpartition("/")[0]]
        after = next((k for k in peers if k > i), 0xFFFFFFFF) if i else 0xFFFFFFFF
        child = min(kids) if kids and (i == 0 or n in folders) else 0xFFFFFFFF
        start, size = (at_mini, len(mini)) if i == 0 else (place.get(n, 0), len(streams.get(n, b"")))
        rows.append(own.ljust(64, b"\0") + struct.pack("<HBBIII", len(own) + 2, 5 if i == 0 else 1 if n in folders else 2, 1, 0xFFFFFFFF, after, child) + bytes(36) + struct.pack("<IQ", start, size))
    at_dir = put(b"".join(rows), fat, 512, sectors)
    body = b"".join(sectors)
    n_fat = -(-(len(fat) + len(fat) // 100 + 2) // 128)
    first_fat = len(fat)
    fat += [0xFFFFFFFD] * n_fat
    body += struct.pack(f"<{n_fat * 128}I", *fat, *[0xFFFFFFFF] * (n_fat * 128 - len(fat)))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIIII", n_fat, at_dir, 0, cutoff, at_mini_fat, 1 if mini_fat else 0, 0xFFFFFFFE, 0, first_fat)
    head += b"".join(struct.pack("<I", first_fat + k if k < n_fat else 0xFFFFFFFF) for k in range(1, 109))
    return head.ljust(512, b"\0") + body


@pytest.mark.parametrize("cutoff", [0, 4096])
def test_outlook_messages(spark, tmp_path, cutoff):
    wide = lambda t: t.encode("utf-16-le")
    when = (dt.datetime(2024, 1, 5, 12) - dt.datetime(1601, 1, 1)) // dt.timedelta(microseconds=1) * 10
    streams = {"__substg1.0_0037001F": wide("Sübject"), "__substg1.0_1000001F": wide("long body " * 900), "__substg1.0_0C1A001E": b"Ann", "__substg1.0_0C1F001F": wide("ann@x.org"), "__substg1.0_0E04001F": wide("Bob"), "__substg1.0_1035001F": wide("<1@x>"), "__substg1.0_1042001F": wide("<0@x>"),
               "__properties_version1.0": bytes(32) + struct.pack("<IIQ", 0x00390040, 6, when), "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("a/b.pdf"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"12345", "__attach_version1.0_#00000000/__substg1.0_370E001F": wide("application/pdf")}
    (tmp_path / "a.msg").write_bytes(compound(streams, cutoff))
    (tmp_path / "b.msg").write_bytes(b"broken")
    (tmp_path / "c.msg").write_bytes(compound({"__substg1.0_007D001F": wide("Message-ID: <9@x>\nFrom: c@x.org\nDate: Fri, 05 Jan 2024 12:00:00 +0000\n\n"), "__substg1.0_10130102": b"<p>only  <b>rich</b></p>"}, cutoff))
    got = {r.source_file: r for r in Fi.read_msg(spark, str(tmp_path)).collect()}
    a, c = got["a.msg"], got["c.msg"]
    assert (a.message_id, a.in_reply_to, a.sender, a.recipients, a.subject, a.body, a.date) == ("<1@x>", "<0@x>", "Ann <ann@x.org>", "Bob", "Sübject", "long body " * 900, "Fri, 05 Jan 2024 12:00:00 +0000")
    assert [tuple(x) for x in a.attachments] == [("a_b.pdf", 5, "application/pdf")]
    assert (c.message_id, c.sender, c.body) == ("<9@x>", "c@x.org", "only rich") and got["b.msg"]._error.startswith("ValueError")


def test_hooks_take_the_first_long_text(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    short, long = (lambda b: "s" * len(b)), (lambda b: "long " * 40)
    assert Fi.read_with(spark, str(tmp_path), "*.pdf", [short, long, short]).first().text == "long " * 40
    bad = Fi.read_with(spark, str(tmp_path), "*.pdf", [lambda b: 1 / 0]).first()
    assert bad.text is None and bad._error.startswith("ZeroDivisionError")


def test_requests_with_custom_deadlines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"trigger_date": "2040-06-13", "jurisdiction": "WA", "event_type": "motion_filed", "service_method": "mail", "custom_deadlines": [{"name": "Letter", "days": 10}, {"days": 3, "business_days": true}]}')
    r = Ta.read_requests(spark, str(tmp_path)).withColumn("request_id", F.lit(7).cast("long"))
    got = {(x.step, x.name): x.due for x in C.deadlines(r, C.calendar_of(r, "trigger_date"), C.chains(spark), C.service_days(spark)).collect()}
    # federal chain and service days for a jurisdiction without its own, in 2040: 27 June, and 3 days of mail to a Monday
    assert got[0, "Opposition/Response Due"] == dt.date(2040, 7, 2) and got[1, "Reply Brief Due"] == dt.date(2040, 7, 9)
    assert got[1000, "Letter"] == dt.date(2040, 6, 25) and got[1001, "Custom Deadline"] == dt.date(2040, 6, 18)
    far = r.unionByName(r.withColumn("trigger_date", F.lit("9000-01-01").cast("date")))
    with pytest.raises(ValueError):
        C.calendar_of(far, "trigger_date")


def test_quarter_hours_are_summed_as_they_are(spark):
    rows = [(str(i), dt.datetime(2024, 1, 2), "T", 0.25) for i in range(40)] + [(f"x{i}", dt.datetime(2024, 1, 3), "T", 5.04) for i in range(2)]
    df = spark.createDataFrame(rows, "row_id string, date timestamp, timekeeper string, hours double")
    assert {r.row_id for r in B.excessive_daily(df).collect()} == {"x0", "x1"}
    full = df.withColumns({"amount": F.lit(1.0), "rate": F.lit(2.0)})
    assert B.spend_by(full, "timekeeper").first().hours_e4 == 200_800


def test_long_days_of_a_stream(spark, tmp_path):
    from docketlake.streaming import monitors

    rows = [("T", dt.datetime(2024, 1, 2, 8), 0.25)] * 40 + [("U", dt.datetime(2024, 1, 2, 9), 5.05)] * 2 + [("U", dt.datetime(2024, 1, 20), 1.0)]
    df = spark.createDataFrame(rows, "timekeeper string, date timestamp, hours double")
    df.write.parquet(str(tmp_path / "in"))
    stream = monitors.long_days(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("long").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.timekeeper, r.hours_e4) for r in spark.table("long").collect()] == [("U", 101_000)]


def test_a_date_said_twice_has_two_sentences(spark):
    text = "The first meeting of all the parties was on 1/2/2024 in the old town hall. A second and longer one was held on 1/2/2024 in the evening of the day."
    df = spark.createDataFrame([(text,)], "t string").select("t", F.explode(T.dates_in(F.col("t"))).alias("d"))
    got = [r[0] for r in df.select(T.sentence_around(F.col("t"), F.col("d.raw"), F.col("d.at"))).collect()]
    assert got == [text.split(". ")[0] + ".", text.split(". ")[1]]


def test_medians_without_a_sort(spark):
    import random
    import statistics

    r = random.Random(1)
    for n in (1, 2, 7, 40):
        us = [r.choice([0, 5, 86_400_000_000 * 3 + 17, 10**15]) + r.randint(-3, 3) for _ in range(n)]
        df = spark.createDataFrame([(u,) for u in us] + [(None,)], "u long")
        assert exact_median(df, F.col("u")) == statistics.median(us)
    assert exact_median(df.limit(0), F.col("u")) is None


def test_running_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 1009,) for i in range(1009)], "k long").repartition(5)
    assert {r.k: r.n for r in numbered(df, "k", "n").collect()} == {i: i + 1 for i in range(1009)}


def test_threads_by_references(spark):
    rows = [(1, "<a@x>", None, None), (2, "<b@x>", None, "<q@x> <a@x>"), (3, "<c@x>", "<q@x>", ""), (4, "<d@x>", None, "e@x"), (5, "<e@x>", "", None), (6, "<f@x>", None, "no ids here")]
    df = spark.createDataFrame(rows, "email_idx long, message_id string, in_reply_to string, refs string")
    got = {r.email_idx: (r.thread, r.thread_id) for r in M.threads(df).collect()}
    assert got == {1: (1, "thread_0001"), 2: (1, "thread_0001"), 3: (1, "thread_0001"), 4: (4, "thread_0002"), 5: (4, "thread_0002"), 6: (6, "thread_0003")}


def test_text_and_chunk_files(spark, tmp_path):
    lines = spark.createDataFrame([(2, "two"), (1, "one")], "n long, line string")
    S.write_text(lines, str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("*.txt")) == "one\ntwo\n"
    chunks = spark.createDataFrame([(2, 0, "c" * 9), (1, 1, "b"), (1, 0, "a")], "doc_id long, chunk long, text string")
    S.write_chunks(chunks, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "c/metadata")).select("doc_id", "chunks", "tokens", "first_id", "last_id").collect())) == [(1, 2, 0, 1, 2), (2, 1, 2, 3, 3)]
