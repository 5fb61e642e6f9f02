"""Figures of a practice: openings, time to resolution, revenue, workload, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.functions.core import small

# Weights of case types and multipliers of stages, weights of scored categories.
TYPE_WEIGHTS = {
    "Simple contract / collections": 1.0, "Misdemeanor / traffic": 1.0, "DUI (first offense)": 1.0, "DUI with priors or injury": 1.5, "Family law (uncontested)": 1.2, "Family law (contested custody)": 2.5,
    "Personal injury (soft tissue)": 1.5, "Personal injury (catastrophic)": 3.0, "Employment / discrimination": 2.0, "Felony (non-violent)": 2.5, "Felony (violent / serious)": 3.5, "Federal civil litigation": 3.0,
    "Federal criminal": 4.0, "Class action / mass tort": 5.0, "IP litigation (patent/trade secret)": 3.5, "Corporate M&A / restructuring": 3.0, "Immigration (removal defense)": 2.0, "Bankruptcy (Chapter 11)": 3.0, "Appeals": 2.0,
}
STAGE_MULTIPLIERS = {"Intake / pre-filing": 0.5, "Early discovery": 1.0, "Active discovery / motions": 1.2, "Mediation / settlement": 1.0, "Trial prep": 1.8, "Active trial": 2.5, "Post-trial / appeal": 1.0}
SCORE_WEIGHTS = {"opening": 3, "qualification": 5, "urgency": 4, "objections": 5, "fee": 4, "close": 5, "compliance": 3}
FAVORABLE = ["Dismissed", "Acquitted", "Favorable Verdict", "Favorable Settlement", "Reduced Charges"]
AT_ONCE = ["Dismissed", "Acquitted", "Favorable Verdict"]
OBJECTIONS = {
    "Public Defender": "public defender|court appoint", "Price": "afford|expected|expensive|price|cost", "Competitor": "other lawyers|another firm|quoted|recommended someone",
    "Timing": "court date|just got arrested|need time", "Delay": "think about it|talk to my family|call back", "Denial": "just a misdemeanor|just get probation|not that serious", "Distrust": "any good|all the same|trust lawyers",
}


def case_flow(cases: DataFrame) -> DataFrame:
    """Cases opened, closed and net per month, active ones at its end, flagged when 25 % off the mean of months."""
    both = cases.select(F.trunc("opened", "month").alias("month"), F.lit(1).alias("o"), F.lit(0).alias("c")).unionByName(cases.filter("closed is not null").select(F.trunc("closed", "month").alias("month"), F.lit(0).alias("o"), F.lit(1).alias("c")))
    m = both.groupBy("month").agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"))
    total = m.agg(F.sum("opened").alias("_s"), F.count(F.lit(1)).alias("_n"))
    off = F.abs(F.col("opened") * F.col("_n") - F.col("_s")) * 4 > F.col("_s")
    net = F.col("opened") - F.col("closed")
    return m.crossJoin(F.broadcast(total)).select("month", "opened", "closed", net.alias("net"), F.sum(net).over(Window.orderBy("month")).alias("active"), off.alias("off_mean"))


def resolution_time(cases: DataFrame) -> DataFrame:
    """Mean and median days to close per type; ``skewed`` where the mean is over 1.4 medians."""
    d = F.datediff("closed", "opened")
    r = cases.filter("closed is not null").groupBy("case_type").agg(F.sum(d.cast("long")).alias("days"), F.count(F.lit(1)).alias("n"), F.median(d).alias("median_days"))
    return r.withColumn("skewed", F.col("days") / F.col("n") > 1.4 * F.col("median_days"))


def disposition_mix(cases: DataFrame, points: int = 5) -> DataFrame:
    """Share of dispositions per year of closing (per mille) and whether it moved by over ``points`` percent points."""
    by = cases.filter("closed is not null").groupBy(F.year("closed").alias("year"), "disposition").agg(F.count(F.lit(1)).alias("n"))
    share = by.withColumn("share_milli", F.floor(F.col("n") * 1000 / F.sum("n").over(Window.partitionBy("year"))))
    before = F.lag("share_milli").over(Window.partitionBy("disposition").orderBy("year"))
    return share.withColumn("moved", F.coalesce(F.abs(F.col("share_milli") - before) > points * 10, F.lit(False)))


def revenue(cases: DataFrame, by: str) -> DataFrame:
    return cases.groupBy(by).agg(F.coalesce(F.sum("fee"), F.lit(0)).alias("revenue"), F.count("fee").alias("paid_cases"), F.count(F.lit(1)).alias("cases"))


def funnel(cases: DataFrame) -> DataFrame:
    """Leads, retained (with a fee), resolved, favourable, and conversion per mille."""
    one = cases.agg(F.count(F.lit(1)).alias("leads"), F.count("fee").alias("retained"), F.count("closed").alias("resolved"), F.count(F.when(F.col("closed").isNotNull() & F.col("disposition").isin(FAVORABLE), 1)).alias("favorable"))
    return one.withColumn("retained_milli", F.expr("floor(retained * 1000 / nullif(leads, 0))")).withColumn("resolved_milli", F.expr("floor(resolved * 1000 / nullif(retained, 0))"))


def source_roi(cases: DataFrame, cost_per_case: int = 5000, top: int = 3) -> DataFrame:
    """Revenue over cost per source, ranked."""
    r = revenue(cases, "source").withColumn("cost", F.col("cases") * cost_per_case).withColumn("roi_milli", F.expr("floor((revenue - cost) * 1000 / nullif(cost, 0))"))
    r = r.withColumn("rank", F.rank().over(Window.orderBy(F.col("roi_milli").desc())))
    return r.withColumn("is_top", F.col("rank") <= top)


def _table(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, int(round(v * 10))) for k, v in values.items()], f"{key} string, {value} long"))


def weighted_cases(cases: DataFrame, types: dict = TYPE_WEIGHTS, stages: dict = STAGE_MULTIPLIERS) -> DataFrame:
    """``load_cents``: weight of the type times multiplier of the stage, in hundredths; unknown ones count 1."""
    spark = cases.sparkSession
    rows = cases.join(_table(spark, types, "case_type", "_w"), "case_type", "left").join(_table(spark, stages, "stage", "_m"), "stage", "left")
    return rows.withColumn("load_cents", F.coalesce("_w", F.lit(10)) * F.coalesce("_m", F.lit(10))).drop("_w", "_m")


def status(percent: Column) -> Column:
    return F.when(percent < 80, "Green").when(percent <= 100, "Yellow").otherwise("Red")


def capacity(cases: DataFrame, target_cents: int) -> DataFrame:
    """Per attorney: open cases, load, percent of target, status and warnings."""
    w = weighted_cases(cases.filter("closed is null"))
    by = w.groupBy("attorney").agg(F.count(F.lit(1)).alias("open_cases"), F.sum("load_cents").alias("load_cents"), F.count(F.when(F.col("stage").isin("Trial prep", "Active trial"), 1)).alias("trial_cases"), F.countDistinct("case_type").alias("types"))
    firm = by.agg(F.sum("load_cents").alias("_firm"))
    pct = F.floor(F.col("load_cents") * 100 / target_cents)
    out = by.crossJoin(F.broadcast(firm)).withColumn("percent", pct).withColumn("status", status(F.col("percent")))
    flags = F.concat_ws("|", F.when(F.col("percent") > 120, "overload"), F.when(F.col("trial_cases") > 3, "trials"), F.when(F.col("types") > 4, "types"), F.when(F.col("load_cents") * 10 > F.col("_firm") * 3, "key person"))
    return out.withColumn("flags", flags).drop("_firm")


def firm_utilisation(cap: DataFrame, target_cents: int) -> DataFrame:
    t = cap.agg(F.sum("load_cents").alias("load_cents"), (F.count(F.lit(1)) * target_cents).alias("target_cents"))
    return t.select("load_cents", "target_cents", F.floor(F.col("load_cents") * 1000 / F.col("target_cents")).alias("used_milli"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("target_cents") * 9 / 10) - F.col("load_cents")).alias("headroom_cents"), (F.col("load_cents") * 100 > F.col("target_cents") * 85).alias("hire"))


def stage_mix(cases: DataFrame) -> DataFrame:
    s = cases.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    t = s.agg(F.sum("n").alias("_t"))
    return s.crossJoin(F.broadcast(t)).select("stage", "n", F.floor(F.col("n") * 1000 / F.col("_t")).alias("share_milli"))


def load_trend(cases: DataFrame, target_cents: int) -> DataFrame:
    """Per month from the first opening to the last opening or closing: cases opened, open at its end, their load and
    use of the target per attorney with open cases (per mille), with the change from the month before."""
    w = weighted_cases(cases)
    start = w.select(F.trunc("opened", "month").alias("month"), F.lit(1).alias("o"), F.lit(1).alias("n"), "load_cents", "attorney")
    end = w.filter("closed is not null").select(F.trunc("closed", "month").alias("month"), F.lit(0).alias("o"), F.lit(-1).alias("n"), (-F.col("load_cents")).alias("load_cents"), "attorney")
    moves = start.unionByName(end).groupBy("month", "attorney").agg(F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum("load_cents").alias("l"))
    months = moves.agg(F.min("month").alias("a"), F.max("month").alias("z")).select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    grid = months.crossJoin(small(moves.select("attorney").distinct(), 100_000))
    so_far = Window.partitionBy("attorney").orderBy("month")
    held = grid.join(moves, ["month", "attorney"], "left").fillna(0, ["o", "n", "l"]).withColumn("open", F.sum("n").over(so_far)).withColumn("load", F.sum("l").over(so_far))
    by = held.groupBy("month").agg(F.sum("o").alias("opened"), F.sum("open").alias("open_cases"), F.sum("load").alias("load_cents"), F.count(F.when(F.col("open") > 0, 1)).alias("attorneys"))
    by = by.withColumn("used_milli", F.expr(f"floor(load_cents * 1000 / nullif(attorneys * {target_cents}, 0))"))
    along = Window.orderBy("month")
    return by.withColumn("open_change", F.col("open_cases") - F.lag("open_cases").over(along)).withColumn("used_change", F.col("used_milli") - F.lag("used_milli").over(along))


def call_score(scores: DataFrame, weights: dict = SCORE_WEIGHTS) -> DataFrame:
    """Weighted mean (in thousandths) of scores (call_id, category, score); missing scores do not count."""
    w = F.broadcast(scores.sparkSession.createDataFrame(list(weights.items()), "category string, weight int"))
    return scores.filter("score is not null").join(w, "category").groupBy("call_id").agg(F.floor(F.sum(F.col("score") * F.col("weight")) * 1000 / F.sum("weight")).alias("score_milli"))


def objection_class(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(OBJECTIONS.items()):
        out = F.when(text.rlike(f"(?i){p}"), name).otherwise(out)
    return out


def review_request(disposition: Column, relationship: Column, sensitive: Column) -> tuple[Column, Column]:
    """(recommendation, timing)."""
    good = relationship.isin("Excellent", "Good")
    ask = F.when(~good | ~disposition.isin(FAVORABLE), "Do Not Ask").when(sensitive & (relationship == "Excellent"), "Ask Carefully").otherwise("Ask")
    when = F.when(ask == "Do Not Ask", "Never").when(disposition.isin(AT_ONCE), "Same day").otherwise("3-5 days")
    return ask, when


def transitions(cases: DataFrame, contacts: int | None = None) -> DataFrame:
    """Counts along the client's journey and conversion between stages (per mille): first contacts (if their
    number is not given, the cases themselves), consultations (cases with a stage past intake), retained (with a fee),
    engaged (retained and past early discovery), resolved, and referred (resolved in the client's favour)."""
    met = F.col("stage") != "Intake / pre-filing"
    c = cases.agg(F.count(F.lit(1)).alias("leads"), F.count(F.when(met, 1)).alias("consulted"), F.count(F.when(met & F.col("fee").isNotNull(), 1)).alias("retained"),
                  F.count(F.when(met & (F.col("stage") != "Early discovery") & F.col("fee").isNotNull(), 1)).alias("engaged"), F.count("closed").alias("resolved"), F.count(F.when(F.col("closed").isNotNull() & F.col("disposition").isin(FAVORABLE), 1)).alias("referred"))
    if contacts is not None:
        c = c.withColumn("leads", F.lit(contacts).cast("long"))
    steps = F.expr("stack(4, 'First Contact -> Consultation', leads, consulted, 'Consultation -> Retention', consulted, retained, 'Retention -> Active Engagement', retained, engaged, 'Resolution -> Review/Referral', resolved, referred) as (transition, entered, moved_on)")
    return c.select(steps).withColumn("conversion_milli", F.expr("floor(moved_on * 1000 / nullif(entered, 0))"))


def instalments(plans: DataFrame) -> DataFrame:
    """(case_id, number, cents): equal parts of ``fee`` dollars over ``parts``, the rest on the first; sums are exact."""
    total = F.col("fee") * 100
    each = F.floor(total / F.col("parts"))
    rows = plans.filter("fee is not null").withColumn("number", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return rows.select("case_id", F.col("number").cast("long").alias("number"), F.when(F.col("number") == 1, total - each * (F.col("parts") - 1)).otherwise(each).alias("cents"))


def compare_options(options: DataFrame) -> DataFrame:
    """Break-even month and net after twelve months of options (upfront, monthly_cost, monthly_gain)."""
    gain = F.col("monthly_gain") - F.col("monthly_cost")
    return options.withColumn("break_even_month", F.when(gain > 0, F.ceil(F.col("upfront") / gain))).withColumn("net_12", gain * 12 - F.col("upfront"))
