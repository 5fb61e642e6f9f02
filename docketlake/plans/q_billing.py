from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketlake.functions.core import cents
from docketlake.operators import billing as B
from docketlake.operators import calendar as C
from docketlake.plans.catalog import query

CAPS = '{"Partner": 450, "Supplier#000000003": 300, "supplier": 520}'


def _rows(df):
    return df.withColumnRenamed("entry_id", "row_id")


def _caps():
    return B.rate_caps(SparkSession.active(), CAPS)


def _holidays(b):
    return C.holidays(b.sparkSession, C.years_of(b, "date"))


def _days_sql() -> str:
    return ", ".join(f"(DATE '{d}')" for d in sorted({d for d, _ in C.federal_holidays(range(1990, 2036))}))


BLOCK = r"(?:\band\b.*\band\b)|(?:;\s*\w)|(?:(?:{0})\w*.*(?:{0}))".format(B.TASK_VERBS)
F_BLOCK = f"SELECT entry_id AS row_id, 'block_billing' AS rule, 'HIGH' AS severity FROM :billing WHERE length(description) >= 10 AND regexp_matches(lower(description), '{BLOCK}')"
F_VAGUE = f"SELECT entry_id AS row_id, 'vague_description' AS rule, 'MEDIUM' AS severity FROM :billing WHERE length(trim(description)) < 15 OR regexp_matches(trim(description), '{B.VAGUE}')"
F_SINGLE = "SELECT entry_id AS row_id, 'excessive_hours_single' AS rule, 'MEDIUM' AS severity FROM :billing WHERE hours > 3"
F_DAILY = "SELECT entry_id AS row_id, 'excessive_hours_daily' AS rule, 'HIGH' AS severity FROM (SELECT entry_id, sum(CAST(floor(hours * 10000 + 0.5e0) AS BIGINT)) OVER (PARTITION BY CAST(date AS DATE), timekeeper) AS t FROM :billing) q WHERE t > 100000"
F_RATE = "SELECT entry_id AS row_id, 'rate_violation' AS rule, 'HIGH' AS severity FROM (SELECT entry_id, rate, (SELECT min_by(cap, pos) FROM (VALUES (0, 'partner', 450e0), (1, 'supplier#000000003', 300e0), (2, 'supplier', 520e0)) c(pos, name, cap) WHERE contains(lower(timekeeper), name) OR contains(name, lower(timekeeper))) AS cap FROM :billing) q WHERE rate > cap"
F_DUP = """SELECT row_id, 'duplicate_entry' AS rule, severity FROM (
 SELECT b.entry_id AS row_id, CASE WHEN contains(a.d, b.d) OR contains(b.d, a.d) THEN 'HIGH' ELSE 'MEDIUM' END AS severity, row_number() OVER (PARTITION BY b.entry_id ORDER BY a.entry_id) AS k
 FROM (SELECT entry_id, CAST(date AS DATE) AS day, timekeeper, lower(trim(description)) AS d, list_distinct(string_split(lower(trim(description)), ' ')) AS w FROM :billing WHERE trim(description) <> '') a
 JOIN (SELECT entry_id, CAST(date AS DATE) AS day, timekeeper, lower(trim(description)) AS d, list_distinct(string_split(lower(trim(description)), ' ')) AS w FROM :billing WHERE trim(description) <> '') b
 ON a.day = b.day AND a.timekeeper = b.timekeeper AND a.entry_id < b.entry_id
 WHERE contains(a.d, b.d) OR contains(b.d, a.d) OR (len(a.w) > 2 AND len(b.w) > 2 AND len(list_intersect(a.w, b.w)) > 0.7e0 * len(list_distinct(list_concat(a.w, b.w))))) q WHERE k = 1"""
F_WEEKEND = f"SELECT entry_id AS row_id, CASE WHEN isodow(date) >= 6 THEN 'weekend_billing' ELSE 'holiday_billing' END AS rule, 'LOW' AS severity FROM :billing WHERE isodow(date) >= 6 OR CAST(date AS DATE) IN (SELECT d FROM (VALUES {_days_sql()}) h(d))"
F_STAFF = f"SELECT entry_id AS row_id, 'staffing_level' AS rule, 'MEDIUM' AS severity FROM :billing WHERE (regexp_matches(timekeeper, '{B.SENIOR}') OR rate > 500) AND regexp_matches(description, '{B.JUNIOR}')"
F_ROUND = "SELECT entry_id AS row_id, 'rounding_pattern' AS rule, 'LOW' AS severity FROM (SELECT entry_id, abs(hours * 2 - round(hours * 2)) < 2e-9 AS h, count(hours) OVER (PARTITION BY timekeeper) AS n, count(*) FILTER (WHERE abs(hours * 2 - round(hours * 2)) < 2e-9) OVER (PARTITION BY timekeeper) AS r FROM :billing) q WHERE h AND n >= 5 AND r > 0.8e0 * n"
F_LATE = """SELECT row_id, 'late_entry' AS rule, 'LOW' AS severity FROM (SELECT row_id, d, sqrt((sum(d * d) OVER ()::DOUBLE - sum(d) OVER ()::DOUBLE * sum(d) OVER ()::DOUBLE / count(*) OVER ()) / (count(*) OVER () - 1)) AS sd
 FROM (SELECT entry_id AS row_id, floor((epoch_us(date) - (SELECT median(epoch_us(date)) FROM :billing)) / 86400e6)::BIGINT AS d FROM :billing) a) b WHERE abs(d) > greatest(2 * sd, 30e0)"""
ALL = " UNION ALL ".join(f"SELECT * FROM ({x}) u{i}" for i, x in enumerate([F_BLOCK, F_VAGUE, F_SINGLE, F_DAILY, F_RATE, F_DUP, F_WEEKEND, F_STAFF, F_ROUND, F_LATE]))

for _name, _f, _sql in [
    ("bil1_block_billing", lambda b: B.block_billing(_rows(b)), F_BLOCK),
    ("bil2_vague_description", lambda b: B.vague_description(_rows(b)), F_VAGUE),
    ("bil3_excessive_single", lambda b: B.excessive_single(_rows(b)), F_SINGLE),
    ("bil4_excessive_daily", lambda b: B.excessive_daily(_rows(b)), F_DAILY),
    ("bil5_rate_violation", lambda b: B.rate_violation(_rows(b), _caps()), F_RATE),
    ("bil6_duplicate_entry", lambda b: B.duplicate_entry(_rows(b)), F_DUP),
    ("bil7_weekend_holiday", lambda b: B.weekend_holiday(_rows(b), _holidays(b)), F_WEEKEND),
    ("bil8_staffing_level", lambda b: B.staffing_level(_rows(b)), F_STAFF),
    ("bil9_rounding_pattern", lambda b: B.rounding_pattern(_rows(b)), F_ROUND),
    ("bil10_late_entry", lambda b: B.late_entry(_rows(b)), F_LATE),
]:
    query(_name, "billing", sql=_sql)(_f)


def _flags(b, keep=()):
    """(entries, flags): the lens is worked out once. Flags keep columns of their entries."""
    rows = B.audited(_rows(b))
    return rows, B.all_flags(rows, _caps(), _holidays(rows), keep)


@query("bil_flag_counts", "billing", sql=f"SELECT severity, rule, count(*)::BIGINT AS flags FROM ({ALL}) f GROUP BY severity, rule")
def flag_counts(b):
    return _flags(b)[1].groupBy("severity", "rule").agg(F.count("*").alias("flags"))


@query("bil11_all_flags", "billing", sql=f"SELECT row_id, rule, min(severity) AS severity FROM ({ALL}) f GROUP BY row_id, rule")
def all_flags(b):
    return _flags(b)[1]


@query("bil12_flagged_entries", "billing", sql=f"SELECT entry_id AS row_id, timekeeper, rule, severity, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS severity_rank FROM :billing JOIN ({ALL}) f ON entry_id = f.row_id")
def flagged(b):
    return B.flagged_entries(_flags(b, ["timekeeper"])[1]).select("row_id", "timekeeper", "rule", "severity", "severity_rank").orderBy("severity_rank", "row_id", "rule")


@query("bil13_savings", "billing", sql=f"SELECT sum(CAST(floor(amount * 100 + 0.5e0) AS BIGINT) * n)::BIGINT AS savings_cents, sum(CAST(floor(amount * 100 + 0.5e0) AS BIGINT))::BIGINT AS savings_distinct_cents, sum(n)::BIGINT AS n_high_flags FROM :billing JOIN (SELECT row_id, count(*) AS n FROM ({ALL}) f WHERE severity = 'HIGH' GROUP BY row_id) g ON entry_id = row_id")
def savings(b):
    return B.savings(_flags(b, ["amount"])[1])


A = "(SELECT *, coalesce(amount, hours * rate) AS amt FROM :billing) a"
CENTS = "coalesce(sum(CAST(floor(amt * 100 + 0.5e0) AS BIGINT)), 0)::BIGINT"


@query("nrm2_derived_amount", "billing", sql="SELECT entry_id, CAST(floor(coalesce(amount, hours * rate) * 100 + 0.5e0) AS BIGINT) AS cents FROM :billing")
def derived(b):
    return B.with_amount(b).select("entry_id", cents(F.col("amount")).alias("cents"))


@query("bag1_total", "billing", sql=f"SELECT {CENTS} AS total_cents FROM {A}")
def total(b):
    return B.with_amount(b).agg(F.coalesce(F.sum(cents(F.col("amount"))), F.lit(0)).cast("long").alias("total_cents"))


for _name, _key in [("bag2_by_matter", "matter"), ("bag3_by_timekeeper", "timekeeper")]:
    query(_name, "billing", sql=f"SELECT {_key}, {CENTS} AS total_cents, sum(CAST(floor(hours * 10000 + 0.5e0) AS BIGINT))::BIGINT AS hours_e4, CAST(floor(avg(rate) * 100 + 0.5e0) AS BIGINT) AS avg_rate_cents, count(*)::BIGINT AS entries FROM {A} WHERE {_key} <> '' GROUP BY {_key} ORDER BY total_cents DESC, {_key} LIMIT 20")(lambda b, k=_key: B.spend_by(B.with_amount(b), k))


@query("bag4_by_month", "billing", sql=f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {CENTS} AS total_cents, count(*)::BIGINT AS entries FROM {A} WHERE date IS NOT NULL GROUP BY 1")
def by_month(b):
    return B.with_amount(b).filter("date IS NOT NULL").groupBy(F.trunc("date", "month").alias("month")).agg(F.sum(cents(F.col("amount"))).alias("total_cents"), F.count("*").alias("entries"))


@query("bag5_rate_levels", "billing", sql=f"SELECT CASE WHEN rate > 500 THEN '500+' WHEN rate > 350 THEN '351-500' WHEN rate > 250 THEN '251-350' WHEN rate > 150 THEN '151-250' ELSE 'up to 150' END AS level, count(DISTINCT timekeeper)::BIGINT AS timekeepers, sum(CAST(rate AS BIGINT))::BIGINT AS rate_sum, count(*)::BIGINT AS entries, {CENTS} AS total_cents FROM {A} WHERE rate IS NOT NULL GROUP BY 1")
def levels(b):
    return B.with_amount(b).filter("rate IS NOT NULL").groupBy(B.rate_level(F.col("rate")).alias("level")).agg(F.countDistinct("timekeeper").alias("timekeepers"), F.sum(F.col("rate").cast("long")).alias("rate_sum"), F.count("*").alias("entries"), F.sum(cents(F.col("amount"))).alias("total_cents"))


@query("bag6_hours_distribution", "billing", sql="SELECT hours, count(*)::BIGINT AS entries FROM :billing WHERE hours IS NOT NULL GROUP BY hours")
def hours(b):
    return b.filter("hours IS NOT NULL").groupBy("hours").agg(F.count("*").alias("entries"))


@query("bag7_top_entries", "billing", sql="SELECT entry_id, CAST(floor(coalesce(amount, hours * rate) * 100 + 0.5e0) AS BIGINT) AS cents FROM :billing ORDER BY cents DESC, entry_id LIMIT 10")
def top(b):
    return B.with_amount(b).select("entry_id", cents(F.col("amount")).alias("cents")).orderBy(F.col("cents").desc(), "entry_id").limit(10)


@query("viz5_hours_histogram", "billing", sql="SELECT CAST(floor(hours / 0.5e0) AS BIGINT) + 1 AS bin, count(*)::BIGINT AS n FROM :billing GROUP BY 1")
def histogram(b):
    return b.groupBy(B.hours_band(F.col("hours")).alias("bin")).agg(F.count("*").alias("n"))


@query("viz6_timekeeper_severity", "billing", sql=f"SELECT timekeeper, severity, count(*)::BIGINT AS n FROM :billing JOIN ({ALL}) f ON entry_id = f.row_id GROUP BY 1, 2")
def viz6(b):
    return B.flagged_entries(_flags(b, ["timekeeper"])[1]).groupBy("timekeeper", "severity").agg(F.count("*").alias("n"))


_EXP = "CASE rule WHEN 'excessive_hours_single' THEN printf('%.2f', hours) || ' hours billed in a single entry' WHEN 'rate_violation' THEN 'Rate of $' || printf('%.2f', rate) || ' exceeds the agreed cap' WHEN 'rounding_pattern' THEN 'Entry of ' || printf('%.2f', hours) || ' hours at a half hour' ELSE upper(substr(rule, 1, 1)) || array_to_string(list_transform(string_split(substr(rule, 2), '_'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), ' ') || ' by ' || timekeeper END"


@query("prj2_explanations", "billing", sql=f"SELECT entry_id AS row_id, rule, {_EXP} AS explanation FROM :billing JOIN ({ALL}) f ON entry_id = f.row_id")
def explanations(b):
    return B.explained(_flags(b, B.EXPLAINED_BY)[1]).select("row_id", "rule", "explanation")


_SUM = f"""WITH b AS (SELECT *, coalesce(amount, hours * rate) AS amt FROM :billing), f AS ({ALL}), u AS (
SELECT 0 AS part, 0 AS place, 'BILLING AUDIT SUMMARY' AS line UNION ALL SELECT 0, 1, format('Total entries reviewed: {{:,}}', count(*)) FROM b UNION ALL SELECT 0, 2, format('Total spend analyzed: ${{:,.2f}}', sum(CAST(floor(amt * 100 + 0.5e0) AS BIGINT)) / 100e0) FROM b
UNION ALL SELECT 1, 0, 'FLAGS BY SEVERITY:' UNION ALL SELECT 1, 1 + CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, format('  {{}}: {{:,}}', severity, count(*)) FROM f GROUP BY severity
UNION ALL SELECT 2, 0, 'SAVINGS:' UNION ALL SELECT 2, 1, format('Estimated savings (HIGH flags): ${{:,.2f}}', sum(CAST(floor(amt * 100 + 0.5e0) AS BIGINT)) / 100e0) FROM b JOIN f ON entry_id = row_id WHERE severity = 'HIGH'
UNION ALL SELECT 3, 0, 'FLAGS BY RULE:' UNION ALL SELECT 3, row_number() OVER (ORDER BY count(*) DESC, rule), format('  {{}}: {{:,}}', rule, count(*)) FROM f GROUP BY rule
UNION ALL SELECT 4, 0, 'TOP TIMEKEEPERS BY SPEND:' UNION ALL SELECT 4, k, line FROM (SELECT row_number() OVER (ORDER BY c DESC, timekeeper) AS k, format('  {{}}: ${{:,.2f}} ({{:,.2f}}h)', timekeeper, c / 100e0, h / 10000e0) AS line FROM (SELECT timekeeper, sum(CAST(floor(amt * 100 + 0.5e0) AS BIGINT)) AS c, sum(CAST(floor(hours * 10000 + 0.5e0) AS BIGINT)) AS h FROM b GROUP BY 1) x) y WHERE k <= 5)
SELECT row_number() OVER (ORDER BY part, place)::BIGINT AS n, line FROM u"""


@query("snk3_audit_summary", "billing", sql=_SUM)
def audit_summary(b):
    """Written as text and read back."""
    from docketlake.functions.scratch import Steps
    from docketlake.sources import sinks

    rows, flags = _flags(B.with_amount(b), ["amount"])
    path = f"{Steps(b.sparkSession).root}/summary"
    sinks.write_text(B.audit_summary(rows, flags), path)
    lines = b.sparkSession.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("n", "line"))
    return lines.select((F.col("n") + 1).cast("long").alias("n"), "line")
