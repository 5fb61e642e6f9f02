"""Court calendars and deadlines. Holidays come from rules, not from lists of dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Jurisdictions and the days that a way of service adds.
JURISDICTIONS = ["federal", "CA", "NY", "TX", "FL", "IL"]
SERVICE_DAYS = {
    "federal": {"mail": 3, "electronic": 0, "personal": 0},
    "CA": {"mail": 5, "electronic": 2, "personal": 0},
    "NY": {"mail": 5, "electronic": 1, "personal": 0},
    "TX": {"mail": 3, "electronic": 1, "personal": 0},
    "FL": {"mail": 5, "electronic": 0, "personal": 0},
    "IL": {"mail": 5, "electronic": 0, "personal": 0},
}
# Chains of deadlines as (name, days, business days, from the previous one, rule).
FEDERAL_CHAINS = {
    "complaint_served": [
        ("Answer Due", 21, False, False, "FRCP 12(a)(1)(A)(i)"),
        ("Motion to Dismiss Deadline (in lieu of answer)", 21, False, False, "FRCP 12(b)"),
        ("Rule 26(f) Conference Deadline", 99, False, False, "FRCP 26(f)"),
        ("Initial Disclosures Due", 114, False, False, "FRCP 26(a)(1)(C)"),
    ],
    "motion_filed": [("Opposition/Response Due", 14, False, False, "FRCP 6(d); Local rules vary"), ("Reply Brief Due", 7, False, True, "FRCP 6(d); Local rules vary")],
    "discovery_request": [("Discovery Response Due", 30, False, False, "FRCP 33(b)(2), 34(b)(2)(A), 36(a)(3)"), ("Motion to Compel Deadline", 30, False, True, "FRCP 37(a)")],
    "summary_judgment": [("Opposition to Summary Judgment Due", 21, False, False, "FRCP 56; Local rules vary"), ("Reply in Support of Summary Judgment Due", 14, False, True, "FRCP 56; Local rules vary")],
    "appeal_filed": [
        ("Notice of Appeal Due", 30, False, False, "FRAP 4(a)(1)(A)"),
        ("Transcript Order Due", 14, False, True, "FRAP 10(b)(1)"),
        ("Appellant's Brief Due", 40, False, True, "FRAP 31(a)(1)"),
        ("Appellee's Brief Due", 30, False, True, "FRAP 31(a)(1)"),
        ("Reply Brief Due", 21, False, True, "FRAP 31(a)(1)"),
    ],
}
STATE_CHAINS = {
    ("CA", "complaint_served"): [("Answer Due", 30, False, False, "CCP 412.20(a)(3)"), ("Demurrer Deadline", 30, False, False, "CCP 430.40"), ("Case Management Conference", 180, False, False, "CRC 3.722")],
    ("CA", "motion_filed"): [("Opposition Due (estimate)", 9, True, False, "CCP 1005(b)"), ("Reply Due (estimate)", 5, True, True, "CCP 1005(b)")],
    ("NY", "complaint_served"): [("Answer Due", 20, False, False, "CPLR 3012(a)"), ("Answer Due (out-of-state service)", 30, False, False, "CPLR 3012(a)")],
    ("TX", "complaint_served"): [("Answer Due (Monday after 20 days)", 20, False, False, "TRCP 99(b)")],
    ("FL", "complaint_served"): [("Answer Due", 20, False, False, "Fla. R. Civ. P. 1.140(a)(1)")],
    ("IL", "complaint_served"): [("Answer Due", 30, False, False, "735 ILCS 5/2-610")],
}


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    if n > 0:
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def federal_holidays(years: range) -> list[tuple[dt.date, str]]:
    """Dates of federal holidays; those on a Saturday or Sunday are also kept on the day they are observed."""
    out = []
    for y in years:
        fixed = [(1, 1, "New Year's Day"), (7, 4, "Independence Day"), (11, 11, "Veterans Day"), (12, 25, "Christmas Day")]
        if y >= 2021:
            fixed.append((6, 19, "Juneteenth"))
        for m, d, name in fixed:
            day = dt.date(y, m, d)
            out.append((day, name))
            if day.weekday() == 5:
                out.append((day - dt.timedelta(1), f"{name} (observed)"))
            elif day.weekday() == 6:
                out.append((day + dt.timedelta(1), f"{name} (observed)"))
        if y >= 1986:
            out.append((_nth(y, 1, 0, 3), "Martin Luther King Jr. Day"))
        out += [(_nth(y, 2, 0, 3), "Washington's Birthday"), (_nth(y, 5, 0, -1), "Memorial Day"), (_nth(y, 9, 0, 1), "Labor Day"), (_nth(y, 10, 0, 2), "Columbus Day"), (_nth(y, 11, 3, 4), "Thanksgiving Day")]
    return sorted(set(out))


#: Years that a calendar may span. Dates wider apart are taken for errors and refused, not left without a date.
MOST_YEARS = 1000


def years_of(df: DataFrame, *days: str, ahead: int = 2) -> range:
    """Years from the one before the earliest of the columns ``days`` to ``ahead`` after the latest."""
    ends = df.agg(*[f(F.year(F.to_date(d))).alias(f"{n}{i}") for i, d in enumerate(days) for n, f in (("a", F.min), ("z", F.max))]).first()
    found = [y for y in ends if y is not None]
    first, last = (min(found) - 1, max(found) + ahead) if found else (2000, 2000)
    if last - first > MOST_YEARS or first < 1 or last > 9998:
        raise ValueError(f"dates from {first + 1} to {last - ahead} are too wide apart for one calendar")
    return range(first, last + 1)


def holidays(spark: SparkSession, years: range) -> DataFrame:
    """(holiday, name): one row per date, for ``years``, as of :func:`years_of`."""
    days: dict[dt.date, str] = {}
    for d, name in federal_holidays(years):
        days.setdefault(d, name)
    return spark.createDataFrame(sorted(days.items()), "holiday date, name string")


def calendar_of(df: DataFrame, *days: str) -> DataFrame:
    """Business calendar about the dates in columns ``days`` of ``df``."""
    years = years_of(df, *days)
    return business_calendar(df.sparkSession, f"{years[0]:04d}-01-01", f"{years[-1]:04d}-12-31")


def business_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, is_business, next_business, seq): ``seq`` numbers business days; on other days it is the number
    of the last one before. A row per day, 365,000 at most, made by rule on the driver, so that no join works it out
    again."""
    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    off = {d for d, _ in federal_holidays(range(start.year, end.year + 2))}
    days = [start + dt.timedelta(i) for i in range((end - start).days + 1)]
    open_ = [d.weekday() < 5 and d not in off for d in days]
    seq, ahead = 0, None
    numbers, following = [], []
    for o in open_:
        seq += o
        numbers.append(seq)
    for d, o in zip(reversed(days), reversed(open_)):
        ahead = d if o else ahead
        following.append(ahead)
    return spark.createDataFrame(list(zip(days, open_, reversed(following), numbers)), "day date, is_business boolean, next_business date, seq long")


def roll_forward(df: DataFrame, calendar: DataFrame, day: str, out: str) -> DataFrame:
    """``day`` or the next business day. The calendar is a few thousand rows."""
    c = calendar.select(F.col("day").alias("_d"), F.col("next_business").alias(out))
    return df.join(F.broadcast(c), F.col(day) == F.col("_d"), "left").drop("_d")


def add_business_days(df: DataFrame, calendar: DataFrame, day: str, n: str | Column, out: str) -> DataFrame:
    """``n`` business days after ``day``, which does not count itself."""
    at = calendar.select(F.col("day").alias("_d"), F.col("seq").alias("_s"))
    to = calendar.filter("is_business").select(F.col("seq").alias("_t"), F.col("day").alias(out))
    n = F.col(n) if isinstance(n, str) else n
    moved = df.join(F.broadcast(at), F.col(day) == F.col("_d"), "left").withColumn("_to", F.col("_s") + n)
    return moved.join(F.broadcast(to), F.col("_to") == F.col("_t"), "left").drop("_d", "_s", "_t", "_to")


def chains(spark: SparkSession) -> DataFrame:
    """(jurisdiction, event_type, step, ...): a state's own chain where it has one, else the federal one."""
    rows = []
    for j in JURISDICTIONS:
        for event, chain in FEDERAL_CHAINS.items():
            rows += [(j, event, i, *s) for i, s in enumerate(STATE_CHAINS.get((j, event), chain))]
    return spark.createDataFrame(rows, "jurisdiction string, event_type string, step int, name string, days int, business_days boolean, from_previous boolean, rule string")


def service_days(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(j, m, d) for j, by in SERVICE_DAYS.items() for m, d in by.items()], "jurisdiction string, service_method string, extra int")


def deadlines(requests: DataFrame, calendar: DataFrame, steps: DataFrame, service: DataFrame, fallback: str = "federal") -> DataFrame:
    """(request_id, step, name, due, rolled, rule): all deadlines of requests (request_id, trigger_date,
    jurisdiction, event_type, service_method, and custom_deadlines if there are any).

    Calendar days are counted and rolled to a business day; business days are counted off. Days of
    service are added to steps that start at the trigger, then rolled again. A step from the previous one
    starts at that one's date; chains have five steps at most, so the fold is that many joins of a small
    calendar. ``rolled`` tells whether the date was moved off a weekend or holiday. Jurisdictions without
    rows in ``steps`` or ``service`` follow ``fallback``. Custom deadlines come after the chain, with steps of
    their own from 1000 on: a name (``Custom Deadline``), days (30) from the trigger, business days or not. A
    request without a trigger date has deadlines without a date.
    """
    def named(df: DataFrame, table: DataFrame, out: str) -> DataFrame:
        known = table.select(F.col("jurisdiction").alias("_k")).distinct().withColumn("_own", F.lit(True))
        return df.join(F.broadcast(known), F.col("jurisdiction") == F.col("_k"), "left").withColumn(out, F.when(F.col("_own"), F.col("jurisdiction")).otherwise(fallback)).drop("_k", "_own")

    longest = max(len(c) for c in [*FEDERAL_CHAINS.values(), *STATE_CHAINS.values()])
    base = named(named(requests, steps, "_j"), service, "_served")
    base = base.join(F.broadcast(steps.withColumnRenamed("jurisdiction", "_j")), ["_j", "event_type"]).join(F.broadcast(service.withColumnRenamed("jurisdiction", "_served")), ["_served", "service_method"], "left")
    done = None
    previous = None
    for k in range(longest):
        now = base.filter(F.col("step") == k)
        if previous is None:
            now = now.withColumn("_from", F.col("trigger_date"))
        else:
            now = now.join(previous, "request_id", "left").withColumn("_from", F.when(F.col("from_previous"), F.col("_prev")).otherwise(F.col("trigger_date"))).drop("_prev")
        now = _counted(now, calendar)
        extra = F.when(F.col("from_previous"), 0).otherwise(F.coalesce("extra", F.lit(0)))
        now = now.withColumn("_late", F.date_add("_due", extra))
        now = roll_forward(now, calendar, "_late", "due")
        now = now.select("request_id", "step", "name", "due", ((F.col("due") != F.col("_late")) | (~F.col("business_days") & (F.col("_calendar") != F.col("_plain")))).alias("rolled"), "rule")
        previous = now.select("request_id", F.col("due").alias("_prev"))
        done = now if done is None else done.unionByName(now)
    if "custom_deadlines" in requests.columns:
        own = requests.select("request_id", F.col("trigger_date").alias("_from"), F.posexplode("custom_deadlines").alias("_at", "_c"))
        own = own.select("request_id", "_from", (F.col("_at") + 1000).alias("step"), F.coalesce("_c.name", F.lit("Custom Deadline")).alias("name"), F.coalesce("_c.days", F.lit(30)).alias("days"), F.coalesce("_c.business_days", F.lit(False)).alias("business_days"))
        own = _counted(own, calendar)
        moved = ~F.col("business_days") & (F.col("_calendar") != F.col("_plain"))
        done = done.unionByName(own.select("request_id", "step", "name", F.col("_due").alias("due"), moved.alias("rolled"), F.lit("custom").alias("rule")))
    return done


def _counted(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """``_due``: ``days`` after ``_from``, counted off as business days or rolled to one."""
    rows = rows.withColumn("_plain", F.date_add("_from", F.col("days")))
    rows = roll_forward(rows, calendar, "_plain", "_calendar")
    rows = add_business_days(rows, calendar, "_from", "days", "_business")
    return rows.withColumn("_due", F.when(F.col("business_days"), F.col("_business")).otherwise(F.col("_calendar")))
