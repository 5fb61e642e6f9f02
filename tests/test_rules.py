"""Edges of the rules on tiny frames."""

import datetime as dt

from pyspark.sql import functions as F

from docketlake.operators import billing as B
from docketlake.operators import calendar as C
from docketlake.operators import finance as X
from docketlake.operators import text as T
from docketlake.operators import timeseries as TS

TXN = "row_id long, date timestamp, amount double, account string, entity string"


def _t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_amount_bands(spark):
    df = spark.createDataFrame([(i, _t(2), a, "A", "E") for i, a in enumerate([8999.99, 9000.0, 9999.99, 10000.0, -9500.0, 2799.0, 2800.0, 3000.0, None])], TXN)
    assert ids(X.structuring(df)) == [1, 2, 4]
    assert ids(X.large_round(df)) == [3]
    assert ids(X.below_threshold(df)) == [6]


def test_rapid_in_out_days(spark):
    rows = [(1, _t(1), 10001.0, "A", "E"), (2, _t(3, 23), -5001.0, "A", "E"), (3, _t(1), 10001.0, "B", "E"), (4, _t(4), -5001.0, "B", "E"), (5, _t(1), 10000.0, "C", "E"), (6, _t(1), -5001.0, "C", "E")]
    assert ids(X.rapid_in_out(spark.createDataFrame(rows, TXN))) == [2]


def test_escalating_counts_share_of_rows(spark):
    up = [(i, _t(i), float(200 + i), "A", "up") for i in range(1, 5)]  # 3 rises of 4 rows
    flat = [(10 + i, _t(i), 200.0, "A", "flat") for i in range(1, 5)]
    assert ids(X.escalating(spark.createDataFrame(up + flat, TXN))) == [4]


def test_entity_names(spark):
    raw = {"POS PURCHASE ACME CORP #12": "Acme Corp", "o'NEIL": "o'NEIL", "ACH O'NEIL-SMITH": "O'Neil", "": "Unknown", "WIRE Bob 123456 REF: X1": "Bob", "ABC": "ABC"}
    df = spark.createDataFrame([(k,) for k in raw], "d string").select("d", X.entity_of(F.col("d")).alias("e"))
    assert {r.d: r.e for r in df.collect()} == raw


BILL = "row_id string, date timestamp, timekeeper string, hours double, rate double, amount double, description string"


def test_billing_edges(spark):
    d = _t(2)
    rows = [("a", d, "T", 3.0, 500.0, None, "Fifteen letters"), ("b", d, "T", 3.1, 501.0, 1.0, "document review of x"), ("c", d, "T", 4.0, 1.0, 1.0, "  meeting  "), ("d", None, "T", None, None, None, None)]
    df = spark.createDataFrame(rows, BILL)
    assert ids(B.excessive_single(df)) == ["b", "c"]
    assert ids(B.vague_description(df)) == ["c", "d"]
    assert ids(B.staffing_level(df)) == ["b"]
    assert ids(B.excessive_daily(df)) == ["a", "b", "c"]  # 10.1 hours
    assert ids(B.excessive_daily(df, 10.1)) == []


def test_duplicates_flag_the_later_row(spark):
    d = _t(2)
    rows = [(k, d, "T", 1.0, 1.0, 1.0, t) for k, t in [("1", "call with bob"), ("2", "call with bob"), ("3", "long call with bob about it"), ("4", "about it call with bob long day"), ("5", "nothing else here")]]
    got = {r.row_id: r.severity for r in B.duplicate_entry(spark.createDataFrame(rows, BILL)).collect()}
    assert got == {"2": "HIGH", "3": "HIGH", "4": "HIGH"}  # 4 holds the whole text of 1


def test_duplicates_by_pairs_and_by_index(spark):
    import random

    r = random.Random(9)
    words = ["call", "with", "bob", "re", "motion", "a", "é", "draft", "of", "to"]
    rows = [(f"{i:03d}", _t(2 + i % 2), "T", 1.0, 1.0, 1.0, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(160)]
    rows += [("900", _t(2), "T", 1.0, 1.0, 1.0, "o"), ("901", _t(2), "T", 1.0, 1.0, 1.0, "b re")]
    want = {}
    for k, day, *_, t in sorted(rows):
        for k2, day2, *_, t2 in sorted(rows):
            if k2 < k and day2 == day and k not in want:
                a, b = set(t.split()), set(t2.split())
                if t in t2 or t2 in t:
                    want[k] = "HIGH"
                elif len(a) > 2 and len(b) > 2 and len(a & b) > 0.7 * len(a | b):
                    want[k] = "MEDIUM"
    df = spark.createDataFrame(rows, BILL)
    for paired in (1000, 0):
        assert {x.row_id: x.severity for x in B.duplicate_entry(df, paired=paired).collect()} == want
    assert set(want.values()) == {"HIGH", "MEDIUM"}


def test_rate_caps_first_in_order(spark):
    df = spark.createDataFrame([("a", _t(2), "Jane Partner", 1.0, 400.0, 1.0, "x")], BILL)
    assert ids(B.rate_violation(df, B.rate_caps(spark, '{"partner": 300, "jane": 500}'))) == ["a"]
    assert ids(B.rate_violation(df, B.rate_caps(spark, '{"jane": 500, "partner": 300}'))) == []


def test_silence_of_two_and_three_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, x),) for x in (1, 4, 8)], "day date")
    assert [(r.gap_start.day, r.gap_end.day, r.days) for r in TS.silent_periods(days).collect()] == [(5, 7, 3)]


def test_holidays_by_rule():
    days = dict(C.federal_holidays(range(2021, 2024)))
    assert dt.date(2021, 6, 18) in days and dt.date(2021, 6, 19) in days  # Saturday, observed on Friday
    assert dt.date(2022, 12, 26) in days and dt.date(2023, 5, 29) in days and dt.date(2023, 11, 23) in days
    assert dt.date(2021, 12, 31) in days  # New Year's Day 2022 is a Saturday


def test_deadline_rolls_and_service(spark):
    req = spark.createDataFrame([(1, dt.date(2024, 6, 13), "federal", "complaint_served", "mail"), (2, dt.date(2024, 6, 13), "CA", "motion_filed", "personal")], "request_id long, trigger_date date, jurisdiction string, event_type string, service_method string")
    got = {(r.request_id, r.step): r.due for r in C.deadlines(req, C.calendar_of(req, 'trigger_date'), C.chains(spark), C.service_days(spark)).collect()}
    assert got[1, 0] == dt.date(2024, 7, 8)  # 4 July is a holiday: 5 July, and 3 days of mail to a Monday
    assert got[2, 0] == dt.date(2024, 6, 27)  # nine court days, Juneteenth left out
    assert got[2, 1] == dt.date(2024, 7, 5)


def test_sentence_chunks_cover_text():
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    chunks = list(T.sentence_chunks(text, 50, 12))
    assert all(len(c) // 4 <= 50 + 12 for c in chunks)
    assert text.startswith(chunks[0]) and text.endswith(chunks[-1])
    assert all(s in " ".join(chunks) for s in text.split(". "))


def test_diff_replays(spark):
    old, new = ["a", "b b", "c", "d"], ["a", "b x", "d", "e"]
    rows = T.diff_documents(spark.createDataFrame([(1, old, new)], "pair_id long, old array<string>, new array<string>")).collect()
    assert {(r.type, r.old_text, r.new_text) for r in rows} == {("modified", "b b", "b x"), ("deleted", "c", None), ("added", None, "e")}


def test_canonical_names(spark):
    df = spark.createDataFrame([("PERSON", n) for n in ("John Smith", "Smith", "Jo", "Jane")], "label string, name string")
    assert {r.name: r.canonical for r in T.canonical_names(df).collect()} == {"John Smith": "John Smith", "Smith": "John Smith", "Jo": "Jo", "Jane": "Jane"}


def test_dates_of_all_forms(spark):
    text = "On 1/2/2024, 2024-01-03, January 4, 2024, 5 January 2024 and Feb. 30, 2024 in 1/1/1800."
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(T.dates_in(F.col("t"))).alias("d")).select("d.day")
    assert sorted(str(r.day) for r in df.collect()) == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]
