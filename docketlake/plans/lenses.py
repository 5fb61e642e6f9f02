"""Domain tables as views over the driver's tables. One text serves Spark SQL and DuckDB."""

from __future__ import annotations

from functools import lru_cache
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.core import dealt, upper_by_letter

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LENSES = {
    "billing": """
SELECT l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey || '-' || l.l_suppkey || '-' || CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS entry_id,
  CASE WHEN l.l_partkey % 97 = 0 THEN CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 10 YEAR ELSE CAST(l.l_shipdate AS TIMESTAMP) END AS date,
  CASE WHEN l.l_suppkey % 10 = 0 THEN 'Partner ' || s.s_name ELSE s.s_name END AS timekeeper,
  CASE WHEN l.l_suppkey % 10 = 3 THEN CAST(ceil(l.l_quantity / 10) AS DOUBLE) WHEN l.l_suppkey % 10 = 7 THEN floor(l.l_quantity / 2) * 0.25e0 ELSE l.l_quantity / 10 END AS hours,
  CAST(100 + (l.l_partkey % 50) * 10 AS DOUBLE) AS rate,
  CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE CAST(floor(l.l_extendedprice * 100 / 40) AS DOUBLE) / 100 END AS amount,
  CASE l.l_orderkey % 8 WHEN 0 THEN 'Review' WHEN 1 THEN 'Draft motion; attend hearing for client' WHEN 2 THEN 'Document review of ' || p.p_name || ' production set'
    WHEN 3 THEN '' WHEN 4 THEN 'Telephone call with ' || p.p_name || ' witness re schedule' ELSE 'Analysis of ' || p.p_name || ' supply contract ' || p.p_type END AS description,
  'M-' || (l.l_orderkey % 40) AS matter
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "txn": """
SELECT o_orderkey AS txn_id, CAST(o_orderdate AS TIMESTAMP) AS date, 'POS ' || o_orderpriority || ' #R' || o_orderkey || ' vendor ' || (o_custkey % 40) AS description,
  'Account ' || (o_custkey % 40) AS account, 'ENT-' || o_custkey AS entity,
  CAST((CASE WHEN o_orderkey % 5 IN (0, 1) THEN -1 ELSE 1 END) * (CASE WHEN o_orderkey % 11 = 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) * 100 ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END) AS DOUBLE) AS amount,
  CAST(o_orderkey % 1000 AS DOUBLE) AS balance, o_orderstatus AS category
FROM {orders}""",
    "ring": """
SELECT 'N' || (1000000 + 9 * b + p) AS src, 'N' || (1000000 + 9 * b + CASE WHEN p >= l - 1 THEN 0 ELSE p + 1 END) AS dst, CAST(100 + k % 50 AS BIGINT) AS weight
FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 9) AS BIGINT) AS b, c_custkey % 9 AS p, 3 + CAST(floor(c_custkey / 9) AS BIGINT) % 7 AS l FROM {customer}) x
UNION ALL
SELECT 'N' || (1000000 + c_custkey - 1), 'N' || (1000000 + 9 * (1 + CAST(floor(c_custkey / 9) AS BIGINT))), CAST(7 AS BIGINT) FROM {customer} WHERE c_custkey % 36 = 10
UNION ALL
SELECT 'N' || (1000000 + c_custkey), 'N' || (1000000 + c_custkey + 2), CAST(9 AS BIGINT) FROM {customer} WHERE c_custkey % 45 = 18""",
    "comm": """
SELECT event_id AS comm_id, 'U' || user_id AS sender, CASE WHEN event_id % 97 = 0 THEN 'Unknown' ELSE 'U' || ((user_id * 7 + event_id % 5) % 150) END AS recipient,
  CAST(ts AS TIMESTAMP) AS datetime, event_type AS type, value AS duration
FROM {events} WHERE CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-12' AND DATE '2024-01-15'""",
    "mail": """
SELECT conv_id * 1000 + turn AS email_idx, '<' || conv_id || '.' || turn || '@x.org>' AS message_id,
  CASE WHEN turn > 0 AND turn % 3 <> 2 THEN '<' || conv_id || '.' || (turn - 1) || '@x.org>' END AS in_reply_to,
  CASE WHEN turn > 1 AND turn % 3 = 2 THEN '<' || conv_id || '.0@x.org> ' || conv_id || '.' || (turn - 1) || '@x.org' END AS refs, CASE conv_id % 3 WHEN 0 THEN 'box.mbox' WHEN 1 THEN 'a.EML' ELSE 'scan' END AS source_file,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(conv_id % 28 AS INT) AS date,
  'Person ' || (conv_id % 17) || ' <p' || (conv_id % 17) || '@a.org>' AS sender, '<R' || ((conv_id + turn) % 13) || '@B.org>, S <s' || (turn % 5) || '@c.org>' AS recipients,
  'Thread ' || conv_id || CASE WHEN conv_id % 9 = 0 THEN ' Attorney-Client matter' ELSE '' END AS subject,
  CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 'Please see the legal advice.' ELSE text END AS body
FROM {conversations}
UNION ALL
SELECT 900000000 + conv_id * 1000 + turn, CASE WHEN turn = 0 THEN '<' || conv_id || '.' || turn || '@x.org>' ELSE '<copy.' || conv_id || '.' || turn || '@x.org>' END, NULL, NULL, 'copies.mbox',
  TIMESTAMP '2024-02-01 00:00:00', 'Person ' || (conv_id % 17) || ' <p' || (conv_id % 17) || '@a.org>', '<other@b.org>', 'Copy ' || conv_id, '  ' || upper(text) || '  '
FROM {conversations} WHERE conv_id % 10 = 0""",
    "segment": """
SELECT conv_id AS rec_id, turn AS id, CAST(turn * 20 AS DOUBLE) AS start_s, CAST(turn * 20 + 20 AS DOUBLE) AS end_s,
  text || CASE turn % 6 WHEN 0 THEN ' I dont recall that.' WHEN 1 THEN ' Objection, form of the question.' WHEN 2 THEN ' Yes, I did.' WHEN 3 THEN ' Let the record reflect exhibit A.' WHEN 4 THEN ' But you said earlier.' ELSE '' END AS text
FROM {conversations}""",
    "turn": """
SELECT conv_id AS rec_id, turn AS pos, CAST(turn * 20 - 7 + conv_id % 11 AS DOUBLE) AS start_s, CAST(turn * 20 + 9 + conv_id % 5 AS DOUBLE) AS end_s,
  CASE WHEN role = 'system' THEN 'CLERK' ELSE upper(role) END AS speaker
FROM {conversations} WHERE conv_id % 6 <> 5""",
    "case_file": """
SELECT o_orderkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'Personal injury (soft tissue)' WHEN 1 THEN 'Felony (non-violent)' WHEN 2 THEN 'Appeals' WHEN 3 THEN 'DUI (first offense)' ELSE 'Federal criminal' END AS case_type,
  CASE o_orderkey % 7 WHEN 0 THEN 'Intake / pre-filing' WHEN 1 THEN 'Early discovery' WHEN 2 THEN 'Active discovery / motions' WHEN 3 THEN 'Mediation / settlement' WHEN 4 THEN 'Trial prep' WHEN 5 THEN 'Active trial' ELSE 'Post-trial / appeal' END AS stage,
  'Attorney ' || (o_custkey % 23) AS attorney, CAST(o_orderdate AS DATE) AS opened,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY * CAST(20 + o_orderkey % 200 + (o_orderkey % 13) * (o_orderkey % 13) AS INT) AS DATE) END AS closed,
  CASE o_orderkey % 6 WHEN 0 THEN 'Dismissed' WHEN 1 THEN 'Favorable Settlement' WHEN 2 THEN 'Conviction' WHEN 3 THEN 'Reduced Charges' WHEN 4 THEN 'Acquitted' ELSE 'Unfavorable Settlement' END AS disposition,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS fee, 'Source ' || (o_custkey % 6) AS source,
  CASE o_custkey % 4 WHEN 0 THEN 'Excellent' WHEN 1 THEN 'Good' WHEN 2 THEN 'Neutral' ELSE 'Poor' END AS relationship, o_orderkey % 31 = 0 AS sensitive
FROM {orders}""",
    "chron": """
SELECT o_orderkey AS doc_id,
  'The parties met first. On ' || CASE o_orderkey % 4 WHEN 0 THEN date_format_iso WHEN 1 THEN mm || '/' || dd || '/' || yy WHEN 2 THEN mname || ' ' || dd || ', ' || yy ELSE dd || ' ' || mname || ' ' || yy END
   || CASE o_orderkey % 6 WHEN 0 THEN ' the complaint was filed with the clerk' WHEN 1 THEN ' a hearing took place before the court' WHEN 2 THEN ' the doctor wrote a letter on the injury' WHEN 3 THEN ' the invoice was paid in full by wire' WHEN 4 THEN ' her deposition was taken under oath here' ELSE ' nothing of note was said by anyone' END || '. Later they left.' AS text
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_format_iso, CAST(year(CAST(o_orderdate AS DATE)) AS STRING) AS yy, CAST(month(CAST(o_orderdate AS DATE)) AS STRING) AS mm, CAST(day(CAST(o_orderdate AS DATE)) AS STRING) AS dd,
  CASE month(CAST(o_orderdate AS DATE)) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mname FROM {orders}) x""",
    "statement": """
SELECT doc_id * 8 + k AS event_id, doc_id, DATE '2024-01-01' + CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 40 END AS INT) AS day, substr(text, 1 + 45 * k, 45) AS text
FROM {documents} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k) WHERE length(text) > 45 * k""",
    "intake": """
SELECT c_custkey AS client_id, c_name || CASE c_custkey % 7 WHEN 0 THEN ' had a car accident and an injury; the hospital bills are unpaid. The defendant drives for a company.' WHEN 1 THEN ' wants a divorce and custody of a child, and child support.' WHEN 2 THEN ' was under arrest for dui, a misdemeanor charge with probation.' WHEN 3 THEN ' seeks a visa and a green card.' WHEN 4 THEN ' is a tenant facing eviction by the landlord; the lease ended.' WHEN 5 THEN ' was fired by the employer after harassment and retaliation.' ELSE ' called.' END
  || ' Phone 555-0' || (100 + c_custkey % 900) || '-1234, mail c' || c_custkey || '@mail.org or alt' || (c_custkey % 10) || '@mail.org. ' || c_name || ' called our client desk.' AS text,
  c_name AS name, CASE c_custkey % 8 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'FL' WHEN 4 THEN 'MN' WHEN 5 THEN 'ZZ' WHEN 6 THEN 'MO' ELSE 'IL' END AS jurisdiction,
  DATE '2022-01-01' + CAST(c_custkey % 1200 AS INT) AS incident_date
FROM {customer}""",
    "photo": """
SELECT p_partkey AS photo_id, CASE WHEN p_size % 3 = 0 THEN 'Adobe Photoshop' WHEN p_size % 7 = 0 THEN 'GIMP 2.10' ELSE p_brand END AS software, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS camera, CASE WHEN p_size % 2 = 0 THEN 'JPEG' ELSE 'PNG' END AS format,
  CAST(100 + p_size * 60 AS BIGINT) AS width, CAST(600 AS BIGINT) AS height, TIMESTAMP '2020-01-01 10:00:00' + INTERVAL 1 DAY * CAST(p_partkey % 500 AS INT) AS exif_date, TIMESTAMP '2021-03-01 12:00:00' AS mtime,
  CAST(p_size AS DOUBLE) AS deg, CAST(p_partkey % 60 AS DOUBLE) AS minutes, CAST(p_partkey % 7 AS DOUBLE) AS seconds, CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS ref, p_name AS content
FROM {part}""",
    "clause": """
SELECT l_orderkey * 10 + l_linenumber AS change_id, l_orderkey AS doc_id, l_partkey AS pk,
  CASE l_partkey % 6 WHEN 0 THEN 'The fee is due on receipt.' WHEN 1 THEN 'Tenant shall give notice in time.' WHEN 2 THEN 'This page intentionally blank.' WHEN 3 THEN 'Vendor accepts liability for damages.' WHEN 4 THEN 'The report covers the sole milestone.' ELSE 'Alpha beta gamma delta epsilon zeta.' END AS old_text,
  CASE l_partkey % 5 WHEN 0 THEN 'The fee is due later.' WHEN 1 THEN 'This page left blank.' WHEN 2 THEN 'Eta theta iota kappa lambda mu nu.' WHEN 3 THEN 'Vendor may terminate.' ELSE 'Plain words only here.' END AS new_text,
  CASE l_linenumber WHEN 1 THEN 'ARTICLE I' WHEN 2 THEN 'ARTICLE II' ELSE 'ARTICLE III' END AS section
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) d""",
    "block": """
SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE o_orderkey % 9 WHEN 0 THEN '1.2. Scope of work' WHEN 1 THEN 'ARTICLE IV' WHEN 2 THEN 'A. Parties here' WHEN 3 THEN 'GENERAL TERMS APPLY' WHEN 4 THEN '' WHEN 5 THEN 'plain text of the body ' || o_orderpriority WHEN 6 THEN 'IV. Remedies and more' WHEN 7 THEN 'section 7 is cited' ELSE '1.1.1.1.1. Deep point' END AS text
FROM {orders}""",
    "mention": """
SELECT l_orderkey AS doc_id, l_linenumber AS paragraph_index, CASE WHEN l_suppkey % 5 = 0 THEN 'Dr. ' || s_name ELSE s_name || CASE WHEN l_suppkey % 3 = 0 THEN ',' ELSE '' END END AS raw_name,
  CASE WHEN l_suppkey % 4 = 0 THEN 'ORG' WHEN l_suppkey % 4 = 1 THEN 'PERSON' WHEN l_suppkey % 4 = 2 THEN 'CARDINAL' ELSE 'GPE' END AS label, 'Context ' || l_partkey AS context
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "ocr_page": """
SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS page, CAST(CAST(floor(l_discount * 1000) AS BIGINT) * 9 + (l_partkey % 11) AS BIGINT) AS confidence_milli FROM {lineitem}""",
    "case_event": """
SELECT o_custkey AS case_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, 'Order ' || o_orderkey || ' with priority ' || o_orderpriority AS text FROM {orders}""",
    "filing": """
SELECT o_orderkey AS accession, CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN 'DEF 14A' ELSE '4' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date,
  'Signed by John Q. Smith, Chief Executive Officer and Mary Jones - Treasurer of unit ' || o_custkey AS text FROM {orders}""",
    "frame": """
SELECT user_id AS video_id, event_id AS frame_id, CAST(floor(date_part('epoch', CAST(ts AS TIMESTAMP))) AS BIGINT) % 3600 * 1000 + (event_id * 37) % 1000 AS ts_ms, event_type AS pass FROM {events}""",
}


#: Tables of short rows, and their columns, that a lens makes long texts of.
DEALT = {"intake": {"customer": ["c_custkey", "c_name"]}}


@lru_cache(maxsize=None)
def tables_of(name: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(r"\{(\w+)\}", LENSES[name]))))


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = LENSES[name].replace("date_part('epoch', CAST(ts AS TIMESTAMP))", "unix_timestamp(CAST(ts AS TIMESTAMP))")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    tables |= {t: dealt(tables[t].select(*columns)) for t, columns in DEALT.get(name, {}).items()}
    if "upper(text)" in text:  # Spark's own makes two letters of some
        text = text.replace("upper(text)", "_upper_text")
        tables = {t: df.withColumn("_upper_text", upper_by_letter(F.col("text"))) if "text" in df.columns else df for t, df in tables.items()}
    return spark.sql(text, **tables)


def with_lenses(sql: str) -> str:
    """Put the lenses that ``sql`` names (as ``:lens``) in front of it as common table expressions."""
    used = [n for n in LENSES if re.search(rf"(?<![:\w]):{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({LENSES[n].format(**{t: t for t in tables_of(n)})})" for n in used)
    for n in used:
        sql = re.sub(rf"(?<![:\w]):{n}\b", n, sql)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {sql[14:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes}\n{sql}"
