from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketlake.operators import calendar as C
from docketlake.plans.catalog import query

DAYS = ", ".join(f"(DATE '{d}')" for d in sorted({d for d, _ in C.federal_holidays(range(1990, 2036))}))
CAL = f"""h AS (SELECT d FROM (VALUES {DAYS}) v(d)), cal AS (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT d FROM h) AS bd FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2035-12-31', INTERVAL 1 DAY)) AS DATE) AS day) g),
c AS (SELECT day, bd, min(CASE WHEN bd THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb, sum(bd::INT) OVER (ORDER BY day)::BIGINT AS seq FROM cal)"""
T = "(SELECT txn_id, CAST(date AS DATE) AS d FROM :txn) t"


#: Jurisdictions of the requests; the last has no rules of its own and follows the federal ones.
PLACES = [*C.JURISDICTIONS, "WA"]


def _rules(j):
    return "federal" if j == "WA" else j


@query("dln1_business_days", "txn", sql=f"WITH {CAL} SELECT txn_id, bd AS is_business FROM {T} JOIN c ON c.day = d")
def business(t):
    return t.join(F.broadcast(C.calendar_of(t, "date")), F.to_date("date") == F.col("day")).select("txn_id", "is_business")


@query("dln2_roll_forward", "txn", sql=f"WITH {CAL} SELECT txn_id, nb AS rolled FROM {T} JOIN c ON c.day = d")
def rolled(t):
    return C.roll_forward(t.select("txn_id", F.to_date("date").alias("d")), C.calendar_of(t, "date"), "d", "rolled").select("txn_id", "rolled")


@query("dln3_calendar_days", "txn", sql=f"WITH {CAL} SELECT txn_id, nb AS due FROM {T} JOIN c ON c.day = d + 21")
def calendar_days(t):
    return C.roll_forward(t.select("txn_id", F.date_add(F.to_date("date"), 21).alias("d")), C.calendar_of(t, "date"), "d", "due").select("txn_id", "due")


@query("dln4_business_days_on", "txn", sql=f"WITH {CAL} SELECT txn_id, e.day AS due FROM {T} JOIN c ON c.day = d JOIN c e ON e.bd AND e.seq = c.seq + 9")
def business_on(t):
    return C.add_business_days(t.select("txn_id", F.to_date("date").alias("d")), C.calendar_of(t, "date"), "d", F.lit(9), "due").select("txn_id", "due")


def _requests(t):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("txn_id") % n + 1).cast("int"))
    return t.select(F.col("txn_id").alias("request_id"), F.to_date("date").alias("trigger_date"), pick(PLACES, 7).alias("jurisdiction"), pick(list(C.FEDERAL_CHAINS), 5).alias("event_type"), pick(["mail", "electronic", "personal"], 3).alias("service_method"))


@query("dln5_service_days", "txn", sql="SELECT txn_id AS request_id, x.extra FROM :txn JOIN (VALUES " + ", ".join(f"({i}, {j}, {C.SERVICE_DAYS[_rules(jur)][m]})" for i, jur in enumerate(PLACES) for j, m in enumerate(["mail", "electronic", "personal"])) + ") x(a, b, extra) ON txn_id % 7 = a AND txn_id % 3 = b")
def service(t):
    s = SparkSession.active()
    j = F.when(F.col("jurisdiction") == "WA", "federal").otherwise(F.col("jurisdiction"))
    return _requests(t).withColumn("jurisdiction", j).join(F.broadcast(C.service_days(s)), ["jurisdiction", "service_method"]).select("request_id", "extra")


_STEPS = ", ".join("({}, {}, {}, '{}', {}, {}, {})".format(i, k, n, s[0].replace("'", "''"), s[1], s[2], s[3]) for i, j in enumerate(PLACES) for k, e in enumerate(C.FEDERAL_CHAINS) for n, s in enumerate(C.STATE_CHAINS.get((j, e), C.FEDERAL_CHAINS[e])))
_EXTRA = ", ".join(f"({i}, {j}, {C.SERVICE_DAYS[_rules(jur)][m]})" for i, jur in enumerate(PLACES) for j, m in enumerate(["mail", "electronic", "personal"]))
RANK = f"s AS (SELECT * FROM (VALUES {_STEPS}) v(j, e, step, name, days, biz, prev)), x AS (SELECT * FROM (VALUES {_EXTRA}) w(j, m, extra)), q AS (SELECT txn_id, CAST(date AS DATE) AS d FROM :txn)"


def _step(k: int) -> str:
    start = "q.d" if k == 0 else f"CASE WHEN s.prev THEN p{k}.due ELSE q.d END"
    join = "" if k == 0 else f"LEFT JOIN d{k - 1} p{k} ON p{k}.request_id = q.txn_id"
    return f"""d{k} AS (SELECT request_id, step, name, c3.nb AS due FROM (SELECT b.*, CASE WHEN biz THEN c2.day ELSE c1.nb END + CASE WHEN prev THEN 0 ELSE extra END AS late FROM
 (SELECT q.txn_id AS request_id, s.step, s.name, s.days, s.biz, s.prev, x.extra, {start} AS f FROM q JOIN s ON s.j = q.txn_id % 7 AND s.e = q.txn_id % 5 AND s.step = {k} JOIN x ON x.j = q.txn_id % 7 AND x.m = q.txn_id % 3 {join}) b
 LEFT JOIN c c0 ON c0.day = f LEFT JOIN c c1 ON c1.day = f + days LEFT JOIN c c2 ON c2.bd AND c2.seq = c0.seq + days) y LEFT JOIN c c3 ON c3.day = late)"""


STEPS = ", ".join(_step(k) for k in range(5))
DUE = " UNION ALL ".join(f"SELECT request_id, step, name, due FROM d{k}" for k in range(5))


@query("dln6_deadlines", "txn", sql=f"WITH {CAL}, {RANK}, {STEPS} {DUE}")
def deadlines(t):
    s = SparkSession.active()
    return C.deadlines(_requests(t), C.calendar_of(t, "date"), C.chains(s), C.service_days(s)).select("request_id", "step", "name", "due")


_NAMES = ", ".join(f"({i}, '{_rules(j)}')" for i, j in enumerate(PLACES)), ", ".join(f"({k}, '{e}')" for k, e in enumerate(C.FEDERAL_CHAINS))


@query("dln7_chains", "txn", sql=f"WITH {RANK} SELECT jn.jurisdiction, en.event_type, s.step, s.name, s.days, s.biz AS business_days, s.prev AS from_previous, sum(n.n)::BIGINT AS requests FROM s JOIN (SELECT txn_id % 7 AS j, txn_id % 5 AS e, count(*) AS n FROM :txn GROUP BY 1, 2) n ON n.j = s.j AND n.e = s.e JOIN (VALUES {_NAMES[0]}) jn(j, jurisdiction) ON jn.j = s.j JOIN (VALUES {_NAMES[1]}) en(e, event_type) ON en.e = s.e GROUP BY ALL")
def chain_table(t):
    """The steps of all chains that requests follow, and how many do; places without rules follow the federal ones."""
    j = F.when(F.col("jurisdiction").isin(list(C.JURISDICTIONS)), F.col("jurisdiction")).otherwise("federal")
    asked = _requests(t).groupBy(j.alias("jurisdiction"), "event_type").agg(F.count("*").alias("requests"))
    steps = C.chains(SparkSession.active()).select("jurisdiction", "event_type", "step", "name", "days", "business_days", "from_previous")
    return steps.join(asked, ["jurisdiction", "event_type"])


_OWN = "SELECT txn_id AS request_id, 1000 AS step, 'Status letter' AS name, c1.nb AS due FROM q LEFT JOIN c c1 ON c1.day = d + 45 UNION ALL SELECT txn_id, 1001, 'Custom Deadline', c2.day FROM q LEFT JOIN c c0 ON c0.day = d LEFT JOIN c c2 ON c2.bd AND c2.seq = c0.seq + 10 UNION ALL SELECT txn_id, 1002, 'Default', c1.nb FROM q LEFT JOIN c c1 ON c1.day = d + 30"


@query("dln6_custom_deadlines", "txn", sql=f"WITH {CAL}, q AS (SELECT txn_id, CAST(date AS DATE) AS d FROM :txn) {_OWN}")
def custom(t):
    s = SparkSession.active()
    own = F.expr("array(named_struct('name', 'Status letter', 'days', 45, 'business_days', false), named_struct('name', null, 'days', 10, 'business_days', true), named_struct('name', 'Default', 'days', null, 'business_days', null))")
    r = _requests(t).withColumn("custom_deadlines", own)
    return C.deadlines(r, C.calendar_of(t, "date"), C.chains(s), C.service_days(s)).filter("step >= 1000").select("request_id", "step", "name", "due")
