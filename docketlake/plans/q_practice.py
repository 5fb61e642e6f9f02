from pyspark.sql import functions as F

from docketlake.operators import practice as P
from docketlake.plans.catalog import query

FAV = ", ".join(f"'{d}'" for d in P.FAVORABLE)
NOW = ", ".join(f"'{d}'" for d in P.AT_ONCE)


@query("kpi1_case_flow", "case_file", sql="WITH m AS (SELECT month, sum(o)::BIGINT AS opened, sum(c)::BIGINT AS closed FROM (SELECT CAST(date_trunc('month', opened) AS DATE) AS month, 1 AS o, 0 AS c FROM :case_file UNION ALL SELECT CAST(date_trunc('month', closed) AS DATE), 0, 1 FROM :case_file WHERE closed IS NOT NULL) q GROUP BY month) SELECT month, opened, closed, opened - closed AS net, sum(opened - closed) OVER (ORDER BY month)::BIGINT AS active, abs(opened * (SELECT count(*) FROM m) - (SELECT sum(opened) FROM m)) * 4 > (SELECT sum(opened) FROM m) AS off_mean FROM m")
def flow(c):
    return P.case_flow(c)


@query("kpi2_resolution_time", "case_file", sql="SELECT case_type, sum(closed - opened)::BIGINT AS days, count(*)::BIGINT AS n, median(closed - opened) AS median_days, sum(closed - opened) / count(*) > 1.4e0 * median(closed - opened) AS skewed FROM :case_file WHERE closed IS NOT NULL GROUP BY 1")
def resolution(c):
    return P.resolution_time(c)


@query("kpi3_dispositions", "case_file", sql="WITH s AS (SELECT year, disposition, n, CAST(floor(n * 1000 / sum(n) OVER (PARTITION BY year)) AS BIGINT) AS share_milli FROM (SELECT year(closed)::INT AS year, disposition, count(*)::BIGINT AS n FROM :case_file WHERE closed IS NOT NULL GROUP BY 1, 2) q) SELECT *, coalesce(abs(share_milli - lag(share_milli) OVER (PARTITION BY disposition ORDER BY year)) > 50, false) AS moved FROM s")
def mix(c):
    return P.disposition_mix(c)


for _n, _k in (("kpi4_revenue_by_type", "case_type"), ("kpi4_revenue_by_attorney", "attorney")):
    query(_n, "case_file", sql=f"SELECT {_k}, coalesce(sum(fee), 0)::BIGINT AS revenue, count(fee)::BIGINT AS paid_cases, count(*)::BIGINT AS cases FROM :case_file GROUP BY 1")(lambda c, k=_k: P.revenue(c, k))

FUN = f"SELECT count(*)::BIGINT AS leads, count(fee)::BIGINT AS retained, count(closed)::BIGINT AS resolved, count(*) FILTER (WHERE closed IS NOT NULL AND disposition IN ({FAV}))::BIGINT AS favorable FROM :case_file"


@query("kpi5_funnel", "case_file", sql=f"SELECT *, retained * 1000 // leads AS retained_milli, resolved * 1000 // retained AS resolved_milli FROM ({FUN}) q")
def funnel(c):
    return P.funnel(c)


@query("kpi6_source_roi", "case_file", sql="SELECT *, rank() OVER (ORDER BY roi_milli DESC)::INT AS rank, rank() OVER (ORDER BY roi_milli DESC) <= 3 AS is_top FROM (SELECT *, CAST(floor((revenue - cost) * 1000 / cost) AS BIGINT) AS roi_milli FROM (SELECT source, coalesce(sum(fee), 0)::BIGINT AS revenue, count(fee)::BIGINT AS paid_cases, count(*)::BIGINT AS cases, count(*) * 5000 AS cost FROM :case_file GROUP BY 1) a) b")
def roi(c):
    return P.source_roi(c)


_TW = " ".join(f"WHEN '{k}' THEN {int(round(v * 10))}" for k, v in P.TYPE_WEIGHTS.items())
_SM = " ".join(f"WHEN '{k}' THEN {int(round(v * 10))}" for k, v in P.STAGE_MULTIPLIERS.items())
LOAD = f"SELECT *, (CASE case_type {_TW} ELSE 10 END * CASE stage {_SM} ELSE 10 END)::BIGINT AS load_cents FROM :case_file"


@query("wrk1_weighted_load", "case_file", sql=f"SELECT case_id, load_cents FROM ({LOAD}) q")
def load(c):
    return P.weighted_cases(c).select("case_id", "load_cents")


CAP = f"SELECT attorney, open_cases, load_cents, trial_cases, types, load_cents * 100 // 40000 AS percent FROM (SELECT attorney, count(*)::BIGINT AS open_cases, sum(load_cents)::BIGINT AS load_cents, count(*) FILTER (WHERE stage IN ('Trial prep', 'Active trial'))::BIGINT AS trial_cases, count(DISTINCT case_type)::BIGINT AS types FROM ({LOAD}) q WHERE closed IS NULL GROUP BY 1) r"


@query("wrk2_wrk3_capacity", "case_file", sql=f"SELECT *, CASE WHEN percent < 80 THEN 'Green' WHEN percent <= 100 THEN 'Yellow' ELSE 'Red' END AS status, concat_ws('|', CASE WHEN percent > 120 THEN 'overload' END, CASE WHEN trial_cases > 3 THEN 'trials' END, CASE WHEN types > 4 THEN 'types' END, CASE WHEN load_cents * 10 > 3 * sum(load_cents) OVER () THEN 'key person' END) AS flags FROM ({CAP}) q")
def capacity(c):
    return P.capacity(c, 40000)


@query("wrk4_utilisation", "case_file", sql=f"SELECT load_cents, target_cents, load_cents * 1000 // target_cents AS used_milli, greatest(0, target_cents * 9 // 10 - load_cents) AS headroom_cents, load_cents * 100 > target_cents * 85 AS hire FROM (SELECT sum(load_cents)::BIGINT AS load_cents, count(*) * 40000 AS target_cents FROM ({CAP}) q) r")
def utilisation(c):
    return P.firm_utilisation(P.capacity(c, 40000), 40000)


@query("wrk5_stage_mix", "case_file", sql="SELECT stage, n, n * 1000 // sum(n) OVER ()::BIGINT AS share_milli FROM (SELECT stage, count(*)::BIGINT AS n FROM :case_file GROUP BY 1) q")
def stages(c):
    return P.stage_mix(c)


_CATS = ", ".join(f"('{k}', {i}, {w})" for i, (k, w) in enumerate(P.SCORE_WEIGHTS.items()))


@query("scr1_call_score", "case_file", sql=f"SELECT case_id AS call_id, CAST(floor(sum(s * w) * 1000 / sum(w)) AS BIGINT) AS score_milli FROM (SELECT case_id, w, CASE WHEN (case_id + i) % 8 = 0 THEN NULL ELSE (case_id * (i + 3)) % 5 + 1 END AS s FROM :case_file, (VALUES {_CATS}) v(k, i, w)) q WHERE s IS NOT NULL GROUP BY 1")
def score(c):
    cats = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(i).alias("i")) for i, k in enumerate(P.SCORE_WEIGHTS)]))
    rows = c.select("case_id", cats.alias("x")).select(F.col("case_id").alias("call_id"), "x.category", F.when((F.col("case_id") + F.col("x.i")) % 8 != 0, (F.col("case_id") * (F.col("x.i") + 3)) % 5 + 1).alias("score"))
    return P.call_score(rows)


_SAY = ["I cannot afford a lawyer", "Another firm quoted me less", "I need to think about it", "My court date is far off", "It is just a misdemeanor", "Lawyers are all the same", "Hello there", "the court appoint someone"]
_OBJ = " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{k}'" for k, p in P.OBJECTIONS.items())


@query("obj1_objections", "case_file", sql=f"SELECT case_id, CASE {_OBJ} END AS objection FROM (SELECT case_id, CASE case_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SAY)) + " END AS t FROM :case_file) q")
def objections(c):
    say = F.element_at(F.array(*[F.lit(s) for s in _SAY]), (F.col("case_id") % 8 + 1).cast("int"))
    return c.select("case_id", P.objection_class(say).alias("objection"))


@query("rvw1_review_requests", "case_file", sql=f"SELECT case_id, ask, CASE WHEN ask = 'Do Not Ask' THEN 'Never' WHEN disposition IN ({NOW}) THEN 'Same day' ELSE '3-5 days' END AS timing FROM (SELECT case_id, disposition, CASE WHEN relationship NOT IN ('Excellent', 'Good') OR disposition NOT IN ({FAV}) THEN 'Do Not Ask' WHEN sensitive AND relationship = 'Excellent' THEN 'Ask Carefully' ELSE 'Ask' END AS ask FROM :case_file) q")
def reviews(c):
    a, w = P.review_request(F.col("disposition"), F.col("relationship"), F.col("sensitive"))
    return c.select("case_id", a.alias("ask"), w.alias("timing"))


_J = "SELECT count(*)::BIGINT AS leads, count(*) FILTER (WHERE stage <> 'Intake / pre-filing')::BIGINT AS consulted, count(*) FILTER (WHERE stage <> 'Intake / pre-filing' AND fee IS NOT NULL)::BIGINT AS retained, count(*) FILTER (WHERE stage NOT IN ('Intake / pre-filing', 'Early discovery') AND fee IS NOT NULL)::BIGINT AS engaged, count(closed)::BIGINT AS resolved, count(*) FILTER (WHERE closed IS NOT NULL AND disposition IN (" + FAV + "))::BIGINT AS referred FROM :case_file"


@query("wrk5_load_trend", "case_file", sql=f"WITH w AS (SELECT attorney, opened, closed, CASE case_type {' '.join(f"WHEN '{k}' THEN {round(v * 10)}" for k, v in P.TYPE_WEIGHTS.items())} ELSE 10 END * CASE stage {' '.join(f"WHEN '{k}' THEN {round(v * 10)}" for k, v in P.STAGE_MULTIPLIERS.items())} ELSE 10 END AS l FROM :case_file), m AS (SELECT CAST(date_trunc('month', opened) AS DATE) AS month, attorney, 1 AS o, 1 AS n, l FROM w UNION ALL SELECT CAST(date_trunc('month', closed) AS DATE), attorney, 0, -1, -l FROM w WHERE closed IS NOT NULL), g AS (SELECT * FROM (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month) a, (SELECT DISTINCT attorney FROM m) b), h AS (SELECT g.month, g.attorney, coalesce(sum(o), 0) AS o, coalesce(sum(n), 0) AS n, coalesce(sum(l), 0) AS l FROM g LEFT JOIN m ON g.month = m.month AND g.attorney = m.attorney GROUP BY 1, 2), r AS (SELECT month, o, sum(n) OVER (PARTITION BY attorney ORDER BY month) AS open, sum(l) OVER (PARTITION BY attorney ORDER BY month) AS load FROM h), y AS (SELECT month, sum(o)::BIGINT AS opened, sum(open)::BIGINT AS open_cases, sum(load)::BIGINT AS load_cents, count(*) FILTER (WHERE open > 0)::BIGINT AS attorneys FROM r GROUP BY 1), z AS (SELECT *, CAST(floor(load_cents * 1000e0 / nullif(attorneys * 4000, 0)) AS BIGINT) AS used_milli FROM y) SELECT *, open_cases - lag(open_cases) OVER (ORDER BY month) AS open_change, used_milli - lag(used_milli) OVER (ORDER BY month) AS used_change FROM z")
def load_trend(c):
    return P.load_trend(c, 4000)


@query("jrn1_transitions", "case_file", sql=f"WITH j AS ({_J}) SELECT transition, entered, moved_on, moved_on * 1000 // entered AS conversion_milli FROM (SELECT 'First Contact -> Consultation' AS transition, leads AS entered, consulted AS moved_on FROM j UNION ALL SELECT 'Consultation -> Retention', consulted, retained FROM j UNION ALL SELECT 'Retention -> Active Engagement', retained, engaged FROM j UNION ALL SELECT 'Resolution -> Review/Referral', resolved, referred FROM j) q")
def journey(c):
    return P.transitions(c)


@query("prc1_instalments", "case_file", sql="SELECT case_id, k AS number, CASE WHEN k = 1 THEN fee * 100 - (fee * 100 // p) * (p - 1) ELSE fee * 100 // p END AS cents FROM (SELECT case_id, fee, p, unnest(range(1, p + 1)) AS k FROM (SELECT case_id, fee, 2 + case_id % 3 AS p FROM :case_file WHERE fee IS NOT NULL) a) q")
def instalments(c):
    return P.instalments(c.withColumn("parts", (2 + F.col("case_id") % 3).cast("int")))


@query("dec1_options", "case_file", sql="SELECT case_id, CASE WHEN g > c THEN CAST(ceil(u::DOUBLE / (g - c)) AS BIGINT) END AS break_even_month, (g - c) * 12 - u AS net_12 FROM (SELECT case_id, fee AS u, case_id % 700 AS c, case_id % 5000 AS g FROM :case_file) q")
def options(c):
    o = c.select("case_id", F.col("fee").alias("upfront"), (F.col("case_id") % 700).alias("monthly_cost"), (F.col("case_id") % 5000).alias("monthly_gain"))
    return P.compare_options(o).select("case_id", "break_even_month", "net_12")
