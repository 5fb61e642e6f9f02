from pyspark.sql import functions as F

from docketlake.operators import finance as X
from docketlake.operators import graph as G
from docketlake.plans.catalog import query


def _rows(t):
    return t.withColumnRenamed("txn_id", "row_id")


S = "SELECT txn_id AS row_id, '{0}' AS rule, '{1}' AS severity FROM {2}"
BAND = "abs(amount) >= 9000 AND abs(amount) < 10000"
FIN = {
    "fin1_structuring": (X.structuring, S.format("structuring_indicator", "HIGH", f":txn WHERE {BAND}")),
    "fin2_large_round": (X.large_round, S.format("large_round_amount", "MEDIUM", f":txn WHERE NOT ({BAND}) AND abs(amount) >= 10000 AND abs(amount) % 100 = 0")),
    "fin3_unusual_timing": (X.unusual_timing, S.format("unusual_timing", "LOW", ":txn WHERE amount IS NOT NULL AND isodow(date) >= 6")),
    "fin4_rapid_in_out": (X.rapid_in_out, S.format("rapid_in_out", "HIGH", "(SELECT *, lag(amount) OVER w AS a, lag(date) OVER w AS d FROM :txn WINDOW w AS (PARTITION BY account ORDER BY date, txn_id)) q WHERE a > 10000 AND amount < -5000 AND floor((epoch_us(date) - epoch_us(d)) / 86400e6) BETWEEN 0 AND 2")),
    "fin5_escalating": (X.escalating, S.format("escalating_amounts", "MEDIUM", "(SELECT entity, count(*) AS n, count(*) FILTER (WHERE a > p) AS ups, max_by(txn_id, (date, txn_id)) AS txn_id FROM (SELECT *, abs(amount) AS a, lag(abs(amount)) OVER (PARTITION BY entity ORDER BY date, txn_id) AS p FROM :txn WHERE abs(amount) > 100) z GROUP BY entity) q WHERE n >= 4 AND ups >= 0.7e0 * n")),
    "fin6_new_large_payee": (X.new_large_payee, S.format("new_large_payee", "MEDIUM", "(SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, txn_id) AS k FROM :txn) q WHERE k = 1 AND abs(amount) > 10000")),
    "fin7_below_threshold": (X.below_threshold, S.format("below_threshold", "LOW", ":txn WHERE abs(amount) >= 2800 AND abs(amount) < 3000")),
}
for _n, (_f, _s) in FIN.items():
    query(_n, "txn", sql=_s)(lambda t, f=_f: f(_rows(t)))
ALL = " UNION ALL ".join(f"SELECT * FROM ({s}) u{i}" for i, (_, s) in enumerate(FIN.values()))


@query("fin8_all_anomalies", "txn", sql=f"SELECT DISTINCT row_id, rule, severity FROM ({ALL}) f")
def all_anomalies(t):
    return X.all_anomalies(_rows(t))


_E = r"""SELECT txn_id, trim(CASE WHEN regexp_matches(c, '^(.*?[a-zA-Z0-9_])\s*-\s*[a-zA-Z0-9_]{5,}') THEN regexp_extract(c, '^(.*?[a-zA-Z0-9_])\s*-\s*[a-zA-Z0-9_]{5,}', 1) ELSE c END) AS entity_name
FROM (SELECT txn_id, trim(regexp_replace(regexp_replace(regexp_replace(description, '^(POS|ACH|WIRE)\s+', '', 'i'), '#\w+', '', 'g'), '\s{2,}', ' ', 'g')) AS c FROM :txn) q"""


@query("fin9_entity_names", "txn", sql=_E)
def entity_names(t):
    return t.select("txn_id", X.entity_of(F.col("description")).alias("entity_name"))


C = "CAST(floor(amount * 100 + 0.5e0) AS BIGINT)"


@query("fag1_entity_summary", "txn", sql=f"SELECT entity, sum(CASE WHEN amount > 0 THEN {C} ELSE 0 END)::BIGINT AS inflow_cents, sum(CASE WHEN amount <= 0 THEN -{C} ELSE 0 END)::BIGINT AS outflow_cents, sum({C})::BIGINT AS net_cents, count(*)::BIGINT AS n, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date FROM :txn GROUP BY entity")
def entity_summary(t):
    return X.entity_summary(t).orderBy(F.col("n").desc(), "entity")


@query("fag2_totals", "txn", sql=f"SELECT count(*)::BIGINT AS n, sum(CASE WHEN amount > 0 THEN {C} END)::BIGINT AS in_cents, sum(CASE WHEN amount < 0 THEN -{C} END)::BIGINT AS out_cents, count(DISTINCT account)::BIGINT AS accounts, count(DISTINCT entity)::BIGINT AS entities, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date FROM :txn")
def totals(t):
    return X.totals(t)


@query("fag3_anomaly_counts", "txn", sql=f"SELECT severity, rule, count(*)::BIGINT AS n FROM (SELECT DISTINCT row_id, rule, severity FROM ({ALL}) f) g GROUP BY 1, 2")
def anomaly_counts(t):
    return X.all_anomalies(_rows(t)).groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query("flt1_date_range", "txn", sql="SELECT txn_id FROM :txn WHERE date IS NULL OR date BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'")
def date_range(t):
    return X.between_dates(t, "date", "1994-01-01", "1995-06-30").select("txn_id")


@query("nrm3_one_amount", "txn", sql="SELECT txn_id, CASE WHEN amount > 0 THEN amount ELSE 0e0 END - CASE WHEN amount < 0 THEN -amount ELSE 0e0 END AS amount FROM :txn")
def one_amount(t):
    split = t.select("txn_id", F.when(F.col("amount") > 0, F.col("amount").cast("string")).alias("credit"), F.when(F.col("amount") < 0, (-F.col("amount")).cast("string")).otherwise("n/a").alias("debit"))
    return X.one_amount(split).select("txn_id", "amount")


EDGES = f"SELECT CASE WHEN amount > 0 THEN entity ELSE 'Account: ' || account END AS src, CASE WHEN amount > 0 THEN 'Account: ' || account ELSE entity END AS dst, sum(CAST(floor(abs(amount) * 100 + 0.5e0) AS BIGINT))::BIGINT AS weight, count(*)::BIGINT AS n FROM :txn WHERE amount <> 0 GROUP BY 1, 2"


@query("grf1_flow_edges", "txn", sql=EDGES)
def flow_edges(t):
    return G.flow_edges(t)


for _n, _k in (("grf2_largest_flows", 20), ("viz1_sankey_edges", 30)):
    query(_n, "txn", sql=f"SELECT * FROM ({EDGES}) e ORDER BY weight DESC, src, dst LIMIT {_k}")(lambda t, k=_k: G.flow_edges(t).orderBy(F.col("weight").desc(), "src", "dst").limit(k))


@query("grf3_net_flow", "txn", sql=f"SELECT node, sum(i)::BIGINT AS inflow, sum(o)::BIGINT AS outflow, (sum(i) - sum(o))::BIGINT AS net FROM (SELECT dst AS node, weight AS i, 0 AS o FROM ({EDGES}) a UNION ALL SELECT src, 0, weight FROM ({EDGES}) b) q GROUP BY node")
def net_flow(t):
    return G.net_flow(G.flow_edges(t))


@query("grf4_cycles_two", "txn", sql=f"WITH e AS ({EDGES}) SELECT a.src, a.dst, least(a.weight, b.weight) AS min_weight FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def cycles_two(t):
    return G.cycles2(G.flow_edges(t))


_STEP = "SELECT f, e.dst AS l, list_append(path, e.dst) AS path, least(low, e.weight) AS low FROM r JOIN e ON e.src = r.l AND e.dst > r.f AND NOT list_contains(path, e.dst) AND len(path) < 6"


@query("grf4_cycles_flow", "txn", sql=f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT src AS f, dst AS l, [src, dst] AS path, weight AS low FROM e WHERE src < dst UNION ALL {_STEP}) SELECT array_to_string(path, '|') AS nodes, len(path)::BIGINT AS length, least(low, e.weight) AS min_weight FROM r JOIN e ON e.src = r.l AND e.dst = r.f")
def cycles_flow(t):
    """Circular flows of up to six nodes."""
    return _named(G.cycles(G.flow_edges(t), 6))


def _named(rows):
    return rows.select(F.array_join("path", "|").alias("nodes"), F.col("length").cast("long").alias("length"), "min_weight")


@query("grf4_first_cycles", "txn", sql=f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT src AS f, dst AS l, [src, dst] AS path, weight AS low FROM e WHERE src < dst UNION ALL {_STEP}) SELECT array_to_string(path, '|') AS nodes, len(path)::BIGINT AS length, least(low, e.weight) AS min_weight FROM r JOIN e ON e.src = r.l AND e.dst = r.f ORDER BY length, nodes LIMIT 20")
def first_cycles(t):
    """The report's twenty cycles, short ones first."""
    return _named(G.first_cycles(G.flow_edges(t)))


RING = "SELECT src, dst, sum(weight)::BIGINT AS weight FROM :ring GROUP BY 1, 2"
ROUND = f"WITH RECURSIVE e AS ({RING}), r AS (SELECT src AS f, dst AS l, [src, dst] AS path, weight AS low FROM e WHERE src < dst UNION ALL SELECT f, e.dst, list_append(path, e.dst), least(low, e.weight) FROM r JOIN e ON e.src = r.l AND e.dst > r.f AND NOT list_contains(path, e.dst)) SELECT array_to_string(path, '|') AS nodes, len(path)::BIGINT AS length, least(low, e.weight) AS min_weight FROM r JOIN e ON e.src = r.l AND e.dst = r.f"


def _ring(r):
    return r.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@query("grf4_ring_components", "ring", sql=f"WITH RECURSIVE e AS ({RING}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def ring_components(r):
    """Strongly connected components of transfers among rings of three to nine accounts."""
    return G.strong_components(_ring(r))


@query("grf4_ring_cycles", "ring", sql=ROUND)
def ring_cycles(r):
    """Circular flows of every length."""
    return _named(G.cycles(_ring(r)))


@query("grf4_ring_first", "ring", sql=f"{ROUND} ORDER BY length, nodes LIMIT 20")
def ring_first(r):
    return _named(G.first_cycles(_ring(r)))


DIRECTED = "SELECT sender AS src, recipient AS dst, count(*)::BIGINT AS weight FROM :comm WHERE sender <> recipient AND recipient <> 'Unknown' GROUP BY 1, 2"


@query("grf4_cycles_four", "comm", sql=f"WITH e AS ({DIRECTED}) SELECT p.src AS a, p.dst AS b, q.dst AS c, r.dst AS d, least(p.weight, q.weight, r.weight, s.weight) AS min_weight FROM e p JOIN e q ON p.dst = q.src JOIN e r ON q.dst = r.src JOIN e s ON r.dst = s.src AND s.dst = p.src WHERE p.src < p.dst AND p.src < q.dst AND p.src < r.dst AND p.dst <> r.dst")
def cycles_four(c):
    directed = c.filter("sender <> recipient AND recipient <> 'Unknown'").groupBy(F.col("sender").alias("src"), F.col("recipient").alias("dst")).agg(F.count("*").alias("weight"))
    return G.cycles4(directed)


@query("viz2_marked_transactions", "txn", sql=f"SELECT txn_id, amount, EXISTS (SELECT 1 FROM ({ALL}) f WHERE f.row_id = txn_id) AS marked FROM :txn")
def marked(t):
    bad = X.all_anomalies(_rows(t)).select("row_id").distinct()
    return t.join(bad, t["txn_id"] == bad["row_id"], "left").select("txn_id", "amount", F.col("row_id").isNotNull().alias("marked"))


@query("viz3_balance_series", "txn", sql="SELECT account, txn_id, balance FROM :txn WHERE balance IS NOT NULL AND date IS NOT NULL")
def balances(t):
    return t.filter("balance IS NOT NULL AND date IS NOT NULL").orderBy("account", "date", "txn_id").select("account", "txn_id", "balance")


