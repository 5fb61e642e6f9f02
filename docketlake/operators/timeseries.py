"""Daily series, spikes, silent periods, studies of key dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.core import small


def daily_volume(rows: DataFrame, ts: str = "datetime") -> DataFrame:
    return rows.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def spikes(daily: DataFrame, high: float = 2.0, low: float = -1.5) -> DataFrame:
    """Days whose count is off by z > ``high`` or z < ``low``; three active days at least. z comes from whole
    sums, the same in any order."""
    n, s, q = F.count("n"), F.sum("n").cast("double"), F.sum(F.col("n") * F.col("n")).cast("double")
    stats = daily.agg((s / n).alias("mean"), F.when(n > 2, F.sqrt((q - s * s / n) / (n - 1))).alias("sd"))
    z = (F.col("n") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    out = daily.crossJoin(F.broadcast(stats)).withColumn("z", z).filter((F.col("z") > high) | (F.col("z") < low))
    return out.select("day", "n", F.when(F.col("z") > high, "spike").otherwise("drop").alias("kind"), F.floor(F.col("z") * 1000).cast("long").alias("z_milli"))


def silent_periods(days: DataFrame, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """Runs of at least ``least`` missing dates between active ones; ``days`` has one row per date (and key)."""
    w = Window.partitionBy(*(by or [])).orderBy("day")
    nxt = F.lead("day").over(w)
    gaps = days.withColumn("_n", nxt).withColumn("days", F.datediff("_n", "day") - 1).filter(F.col("days") >= least)
    return gaps.select(*(by or []), F.date_add("day", 1).alias("gap_start"), F.date_sub("_n", 1).alias("gap_end"), F.col("days").cast("long").alias("days"))


def event_gaps(days: DataFrame, least: int = 30, by: list[str] | None = None) -> DataFrame:
    """Gaps between consecutive distinct dates, of all rows or per key."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("day")
    g = days.select(*by, "day").distinct().withColumn("next_day", F.lead("day").over(w)).withColumn("days", F.datediff("next_day", "day").cast("long")).filter(F.col("days") >= least)
    return g.withColumn("severity", F.when(F.col("days") >= 90, "high").when(F.col("days") >= 60, "medium").otherwise("low"))


def gap_context(events: DataFrame, least: int = 30, by: list[str] | None = None, most: int = 200) -> DataFrame:
    """Gaps of events (event_id, day, text, and the keys) with ``event_before`` and ``event_after``: the first
    event, by id, of the day before the gap and of the day after it, cut to ``most`` characters."""
    by = by or []
    firsts = events.groupBy(*by, "day").agg(F.min_by(F.substring(F.coalesce("text", F.lit("")), 1, most), "event_id").alias("said"))
    gaps = event_gaps(events, least, by)
    before = firsts.withColumnRenamed("said", "event_before")
    after = firsts.withColumnsRenamed({"day": "next_day", "said": "event_after"})
    return gaps.join(before, [*by, "day"]).join(after, [*by, "next_day"])


def key_date_study(rows: DataFrame, key_dates: DataFrame, around: int = 30, names: int = 20) -> DataFrame:
    """Mean volume of active days and participants before and after each key date (day), the day itself
    left out; lists sorted, then cut to ``names``. ``key_dates`` is a short list."""
    k = small(key_dates.select(F.col("day").alias("key_date")))
    days = daily_volume(rows).join(k, F.col("day").between(F.date_sub("key_date", around), F.date_add("key_date", around)) & (F.col("day") != F.col("key_date")))
    side = F.when(F.col("day") < F.col("key_date"), "before").otherwise("after")
    vol = days.groupBy("key_date").agg(*[F.coalesce(F.sum(F.when(side == s, F.col("n"))), F.lit(0)).alias(f"sum_{s}") for s in ("before", "after")], *[F.count(F.when(side == s, 1)).alias(f"days_{s}") for s in ("before", "after")])
    people = rows.filter(F.col("datetime").isNotNull()).select(F.to_date("datetime").alias("day"), F.explode(F.array("sender", "recipient")).alias("who")).distinct()
    people = people.join(k, F.col("day").between(F.date_sub("key_date", around), F.date_add("key_date", around)) & (F.col("day") != F.col("key_date")))
    seen = people.groupBy("key_date", "who").agg(F.max((side == "before").cast("int")).alias("b"), F.max((side == "after").cast("int")).alias("a"))
    lists = seen.groupBy("key_date").agg(*[F.array_join(F.slice(F.sort_array(F.collect_set(F.when((F.col("a") == a) & (F.col("b") == 1 - a), F.col("who")))), 1, names), "|").alias(n) for n, a in (("new_participants", 1), ("lost_participants", 0))])
    return vol.join(lists, "key_date", "left")
