from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketlake.operators import graph as G
from docketlake.operators import timeseries as T
from docketlake.plans.catalog import query

DAILY = "SELECT CAST(datetime AS DATE) AS day, count(*)::BIGINT AS n FROM :comm WHERE datetime IS NOT NULL GROUP BY 1"
EDGES = "SELECT least(sender, recipient) AS src, greatest(sender, recipient) AS dst, count(*)::BIGINT AS weight FROM :comm WHERE sender <> recipient AND sender <> 'Unknown' AND recipient <> 'Unknown' GROUP BY 1, 2"
BOTH = f"SELECT src, dst FROM ({EDGES}) e1 UNION ALL SELECT dst, src FROM ({EDGES}) e2"


@query("cag1_daily_volume", "comm", sql=DAILY)
def daily(c):
    return T.daily_volume(c)


PEOPLE = "SELECT who, count(*) FILTER (WHERE s)::BIGINT AS sent, count(*) FILTER (WHERE NOT s)::BIGINT AS received, count(*)::BIGINT AS total FROM (SELECT sender AS who, true AS s FROM :comm UNION ALL SELECT recipient, false FROM :comm) q GROUP BY who"


def participants(c):
    both = c.select(F.col("sender").alias("who"), F.lit(1).alias("s")).unionByName(c.select(F.col("recipient").alias("who"), F.lit(0).alias("s")))
    return both.groupBy("who").agg(F.sum("s").alias("sent"), F.sum(1 - F.col("s")).alias("received"), F.count("*").alias("total"))


query("cag2_participant_volume", "comm", sql=PEOPLE)(participants)


@query("win1_spikes", "comm", sql=f"SELECT day, n, CASE WHEN z > 2 THEN 'spike' ELSE 'drop' END AS kind, CAST(floor(z * 1000) AS BIGINT) AS z_milli FROM (SELECT day, n, (n - s / c) / sqrt((q - s * s / c) / (c - 1)) AS z FROM ({DAILY}) d, (SELECT count(*) AS c, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS q FROM ({DAILY}) x) y WHERE c > 2) t WHERE z > 2 OR z < -1.5")
def spikes(c):
    return T.spikes(T.daily_volume(c))


@query("win2_silent_periods", "comm", sql=f"SELECT day + 1 AS gap_start, nx - 1 AS gap_end, (nx - day - 1)::BIGINT AS days FROM (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM ({DAILY}) d) q WHERE nx - day - 1 >= 3")
def silent(c):
    return T.silent_periods(T.daily_volume(c))


_KD = "(VALUES (DATE '2024-01-10'), (DATE '2024-01-20'))"


@query("win4_key_dates", "comm", sql=f"""WITH k AS (SELECT d AS key_date FROM {_KD} v(d)), dv AS ({DAILY}),
v AS (SELECT key_date, coalesce(sum(n) FILTER (WHERE day < key_date), 0)::BIGINT AS sum_before, coalesce(sum(n) FILTER (WHERE day > key_date), 0)::BIGINT AS sum_after, count(*) FILTER (WHERE day < key_date)::BIGINT AS days_before, count(*) FILTER (WHERE day > key_date)::BIGINT AS days_after FROM dv JOIN k ON day BETWEEN key_date - 30 AND key_date + 30 AND day <> key_date GROUP BY key_date),
p AS (SELECT key_date, who, bool_or(day < key_date) AS b, bool_or(day > key_date) AS a FROM (SELECT CAST(datetime AS DATE) AS day, sender AS who FROM :comm UNION SELECT CAST(datetime AS DATE), recipient FROM :comm) x JOIN k ON day BETWEEN key_date - 30 AND key_date + 30 AND day <> key_date GROUP BY 1, 2)
SELECT key_date, sum_before, sum_after, days_before, days_after,
 coalesce((SELECT string_agg(who, '|' ORDER BY who) FROM (SELECT who FROM p WHERE p.key_date = v.key_date AND a AND NOT b ORDER BY who LIMIT 20) z), '') AS new_participants,
 coalesce((SELECT string_agg(who, '|' ORDER BY who) FROM (SELECT who FROM p WHERE p.key_date = v.key_date AND b AND NOT a ORDER BY who LIMIT 20) z), '') AS lost_participants FROM v""")
def key_dates(c):
    days = SparkSession.active().createDataFrame([("2024-01-10",), ("2024-01-20",)], "d string").select(F.to_date("d").alias("day"))
    return T.key_date_study(c, days)


@query("set2_participants", "comm", sql="SELECT who FROM (SELECT sender AS who FROM :comm UNION SELECT recipient FROM :comm) q WHERE who NOT IN ('Unknown', 'Group')")
def people(c):
    return c.select(F.col("sender").alias("who")).union(c.select("recipient")).distinct().filter(~F.col("who").isin("Unknown", "Group"))


@query("set3_lost_participants", "comm", sql="SELECT DISTINCT sender AS who FROM :comm WHERE datetime < TIMESTAMP '2024-01-02' EXCEPT SELECT sender FROM :comm WHERE datetime >= TIMESTAMP '2024-01-30 18:00:00'")
def lost_people(c):
    early = c.filter(F.col("datetime") < F.to_timestamp(F.lit("2024-01-02"))).select(F.col("sender").alias("who"))
    return early.subtract(c.filter(F.col("datetime") >= F.to_timestamp(F.lit("2024-01-30 18:00:00"))).select("sender"))


@query("set3_new_participants", "comm", sql="SELECT DISTINCT sender AS who FROM :comm WHERE datetime >= TIMESTAMP '2024-01-30 18:00:00' EXCEPT SELECT sender FROM :comm WHERE datetime < TIMESTAMP '2024-01-02'")
def new_people(c):
    late = c.filter(F.col("datetime") >= F.to_timestamp(F.lit("2024-01-30 18:00:00"))).select(F.col("sender").alias("who"))
    return late.subtract(c.filter(F.col("datetime") < F.to_timestamp(F.lit("2024-01-02"))).select("sender"))


@query("grf5_contact_edges", "comm", sql=EDGES)
def edges(c):
    return G.contact_edges(c)


@query("grf6_degree", "comm", sql=f"SELECT src AS node, count(*)::BIGINT AS contacts, count(*)::DOUBLE / (count(*) OVER () - 1) AS centrality FROM ({BOTH}) b GROUP BY src")
def degree(c):
    return G.degree(G.contact_edges(c))


@query("grf7_grf8_path_centrality", "comm")
def paths(c):
    return G.shortest_path_centrality(G.contact_edges(c))


@query("grf9_pagerank", "comm")
def ranks(c):
    return G.pagerank(G.contact_edges(c))


@query("grf10_communities", "comm")
def comms(c):
    return G.communities(G.contact_edges(c))


@query("grf11_components", "comm", sql=f"WITH RECURSIVE g AS (SELECT src, dst FROM ({BOTH}) b), r AS (SELECT src AS node, src AS seen FROM g UNION SELECT r.node, g.dst FROM r JOIN g ON g.src = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def comps(c):
    return G.components(G.contact_edges(c))


@query("grf13_key_players", "comm")
def players(c):
    return G.key_players(G.contact_edges(c))


@query("viz4_who_to_whom", "comm", sql=f"WITH p AS ({PEOPLE}), top AS (SELECT who FROM p ORDER BY total DESC, who LIMIT 30) SELECT sender, recipient, count(*)::BIGINT AS n FROM :comm WHERE sender IN (SELECT who FROM top) AND recipient IN (SELECT who FROM top) GROUP BY 1, 2")
def who_to_whom(c):
    """The matrix in long form; ``pivot_matrix`` makes it wide."""
    top = participants(c).orderBy(F.col("total").desc(), "who").limit(30).select("who")
    rows = c.join(F.broadcast(top), c["sender"] == top["who"], "left_semi").join(F.broadcast(top), F.col("recipient") == top["who"], "left_semi")
    return rows.groupBy("sender", "recipient").agg(F.count("*").alias("n"))


def pivot_matrix(c):
    return who_to_whom(c).groupBy("sender").pivot("recipient").sum("n").fillna(0)


query("viz4_matrix", "comm")(pivot_matrix)
