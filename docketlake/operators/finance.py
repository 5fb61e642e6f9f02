"""Forensic transaction analysis: entity names, anomaly flags, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.core import cents, floor_days, strip
from docketlake.functions.scan import before

# Prefixes and codes that are not part of a payee's name.
PREFIXES = [
    r"(?i)^(POS|ACH|WIRE|CHK|DEP|ATM|DBT|CRD|PMT|TFR|XFER|EFT|DD|SO)\s+",
    r"(?i)^(PURCHASE|PAYMENT|DEPOSIT|TRANSFER|WITHDRAWAL|CHECK)\s+",
    r"(?i)^(DEBIT CARD|CREDIT CARD|ONLINE|MOBILE)\s+",
]
CODES = [r"\b\d{6,}\b", r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b", r"#\w+", r"(?i)\bREF\s*:?\s*\w+", r"(?i)\bCONF\s*:?\s*\w+"]
THRESHOLD = 10_000.0


def title_case(x: Column) -> Column:
    """Capital after every character that is not a letter."""
    return F.array_join(F.transform(F.split(F.lower(x), r"(?<=[^\p{L}])"), lambda p: F.initcap(p)), "")


def entity_of(description: Column) -> Column:
    x = strip(F.coalesce(description, F.lit("")))
    for p in PREFIXES + CODES:
        x = F.regexp_replace(x, p, "")
    x = strip(F.regexp_replace(x, r"\s{2,}", " "))
    x = strip(F.split(x, r"\s{2,}|(?<=\w)\s*-\s*(?=\w{5,})", 2)[0])
    shouted = (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 3)
    x = F.when(shouted, title_case(x)).otherwise(x)
    return F.when(x == "", "Unknown").otherwise(x)


def _flag(df: DataFrame, kind: str, severity: str) -> DataFrame:
    return df.select("row_id", F.lit(kind).alias("rule"), F.lit(severity).alias("severity"))


def structuring(df: DataFrame) -> DataFrame:
    a = F.abs("amount")
    return _flag(df.filter((a >= 9000) & (a < 10000)), "structuring_indicator", "HIGH")


def large_round(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    a = F.abs("amount")
    return _flag(df.filter(~((a >= 9000) & (a < 10000)) & (a >= threshold) & (a % 100 == 0)), "large_round_amount", "MEDIUM")


def unusual_timing(df: DataFrame) -> DataFrame:
    return _flag(df.filter(F.col("amount").isNotNull() & (F.weekday("date") >= 5)), "unusual_timing", "LOW")


def rapid_in_out(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """An inflow above the threshold followed, as the account's next row, by an outflow of over half of it
    within two days. Ties of date are broken by row_id. A row's predecessor of the last three days stands in
    its own stretch of three dates or the one before, so accounts are cut into such stretches and each row
    also serves the next one: a hot account is many small windows."""
    rows = df.filter(F.col("amount").isNotNull() & F.col("date").isNotNull()).select("row_id", "amount", "date", "account")
    own = F.floor(F.unix_date(F.to_date("date")) / 3)
    rows = rows.withColumn("_own", own).withColumn("_b", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("account", "_b").orderBy("date", "row_id")
    rows = rows.withColumn("_a", F.lag("amount").over(w)).withColumn("_d", F.lag("date").over(w)).filter("_own = _b")
    days = floor_days(F.col("_d"), F.col("date"))
    return _flag(rows.filter((F.col("_a") > threshold) & (F.col("amount") < -threshold * 0.5) & days.between(0, 2)), "rapid_in_out", "HIGH")


def escalating(df: DataFrame, least: float = 100.0, n: int = 4, share: float = 0.7) -> DataFrame:
    """Last row of an entity whose amounts rise at ``share`` of its rows or more. A row's predecessor comes from a
    scan by ranges, so a hot entity is many tasks."""
    rows = df.filter((F.abs("amount") > least) & F.col("date").isNotNull()).select("row_id", "entity", "date", F.abs("amount").alias("a"))
    rows = before(rows, ["entity"], ["date", "row_id"], prev=("last", F.col("a"))).withColumn("up", (F.col("a") > F.col("prev")).cast("int"))
    by = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("up", F.lit(0))).alias("ups"), F.max_by("row_id", F.struct("date", "row_id")).alias("row_id"))
    return _flag(by.filter((F.col("n") >= n) & (F.col("ups") >= share * F.col("n"))), "escalating_amounts", "MEDIUM")


def new_large_payee(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """First dated row of an entity, by partial aggregation."""
    rows = df.filter(F.col("date").isNotNull() & F.col("amount").isNotNull())
    first = rows.groupBy("entity").agg(F.min(F.struct("date", "row_id", "amount")).alias("f"))
    return _flag(first.select("f.*").filter(F.abs("amount") > threshold), "new_large_payee", "MEDIUM")


def below_threshold(df: DataFrame) -> DataFrame:
    a = F.abs("amount")
    return _flag(df.filter((a >= 2800) & (a < 3000)), "below_threshold", "LOW")


def row_detectors(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The detectors that look at one row only, in one pass."""
    a = F.abs("amount")
    band = (a >= 9000) & (a < 10000)
    found = [
        (band, "structuring_indicator", "HIGH"),
        (~band & (a >= threshold) & (a % 100 == 0), "large_round_amount", "MEDIUM"),
        (F.col("amount").isNotNull() & (F.weekday("date") >= 5), "unusual_timing", "LOW"),
        ((a >= 2800) & (a < 3000), "below_threshold", "LOW"),
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("severity"))) for c, r, v in found]))
    return df.select("row_id", F.explode_outer(flags).alias("f")).select("row_id", "f.rule", "f.severity").filter("rule is not null")


def all_anomalies(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All detectors. Each gives a row at most one flag, so (row_id, rule) is unique."""
    return reduce(DataFrame.unionByName, [row_detectors(df, threshold), rapid_in_out(df, threshold), escalating(df), new_large_payee(df, threshold)])


def entity_summary(df: DataFrame) -> DataFrame:
    c = cents(F.col("amount"))
    rows = df.filter(F.col("amount").isNotNull())
    return rows.groupBy("entity").agg(
        F.sum(F.when(F.col("amount") > 0, c).otherwise(0)).alias("inflow_cents"), F.sum(F.when(F.col("amount") <= 0, -c).otherwise(0)).alias("outflow_cents"),
        F.sum(c).alias("net_cents"), F.count(F.lit(1)).alias("n"), F.to_date(F.min("date")).alias("first_date"), F.to_date(F.max("date")).alias("last_date"))


def totals(df: DataFrame) -> DataFrame:
    c = cents(F.col("amount"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("amount") > 0, c)).alias("in_cents"), F.sum(F.when(F.col("amount") < 0, -c)).alias("out_cents"), F.countDistinct("account").alias("accounts"), F.countDistinct("entity").alias("entities"), F.to_date(F.min("date")).alias("first_date"), F.to_date(F.max("date")).alias("last_date"))


def between_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Inclusive range that keeps null dates; the end is that day's midnight."""
    d = F.col(column)
    return df.filter(d.isNull() | d.between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last))))


def one_amount(df: DataFrame) -> DataFrame:
    """``amount`` from credit and debit columns, whichever are there."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    if "amount" in df.columns:
        return df
    if "credit" in df.columns and "debit" in df.columns:
        return df.withColumn("amount", number("credit") - number("debit"))
    if "debit" in df.columns:
        return df.withColumn("amount", -F.abs(number("debit")))
    return df.withColumn("amount", number("credit") if "credit" in df.columns else F.lit(None).cast("double"))
