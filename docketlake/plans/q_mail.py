from pyspark.sql import functions as F

from docketlake.operators import mail as M
from docketlake.plans.catalog import query

H = r"substr(sha256(regexp_replace(lower(regexp_replace(body, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')), 1, 16)"
DUP = f"""m AS (SELECT *, {H} AS h, min(email_idx) OVER (PARTITION BY message_id) AS fi FROM :mail),
b AS (SELECT h, min(email_idx) AS fb FROM m WHERE email_idx = fi AND regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY h),
d AS (SELECT m.*, CASE WHEN fi < email_idx THEN fi WHEN fb < email_idx THEN fb END AS duplicate_of FROM m LEFT JOIN b ON m.h = b.h)"""
ADDR = r"regexp_extract_all({}, '[\w.+%-]+@[\w.-]+\.[A-Za-z]{{2,}}')"


@query("eml3_content_hash", "mail", sql=f"SELECT email_idx, {H} AS content_hash FROM :mail")
def hashes(m):
    return m.select("email_idx", M.content_hash(F.col("body")).alias("content_hash"))


@query("eml2_duplicates", "mail", sql=f"WITH {DUP} SELECT email_idx, duplicate_of FROM d WHERE duplicate_of IS NOT NULL")
def dups(m):
    return M.duplicates(m).filter("duplicate_of IS NOT NULL").select("email_idx", "duplicate_of")


THREADS = r"""WITH RECURSIVE r AS (SELECT email_idx, regexp_replace(ref, '^\s*<|>\s*$', '', 'g') AS ref FROM (SELECT email_idx, message_id AS ref FROM :mail UNION ALL SELECT email_idx, in_reply_to FROM :mail WHERE in_reply_to IS NOT NULL
 UNION ALL SELECT email_idx, unnest(string_split(refs, ' ')) FROM :mail WHERE refs IS NOT NULL) q),
f AS (SELECT ref, min(email_idx) AS first FROM r GROUP BY ref), l AS (SELECT r.email_idx AS a, first AS b FROM r JOIN f ON r.ref = f.ref WHERE r.email_idx <> first), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT email_idx, email_idx AS seen FROM :mail UNION SELECT t.email_idx, e.b FROM t JOIN e ON e.a = t.seen), g AS (SELECT email_idx, min(seen) AS thread FROM t GROUP BY email_idx),
y AS (SELECT email_idx, thread, printf('thread_%04d', dense_rank() OVER (ORDER BY thread)) AS thread_id FROM g)"""


@query("eml1_threads", "mail", sql=f"{THREADS} SELECT email_idx, thread, thread_id FROM y")
def threads(m):
    return M.threads(m)


@query("eml1_thread_summary", "mail", sql=f"{THREADS} SELECT thread_id, count(*)::BIGINT AS mails, min(date) AS first_date, max(date) AS last_date, min_by(subject, (date, email_idx)) AS subject FROM :mail JOIN y USING (email_idx) GROUP BY thread_id")
def thread_summary(m):
    return M.thread_summary(m, M.threads(m))


@query("eag1_mail_formats", "mail", sql="SELECT CASE WHEN contains(source_file, '.') THEN lower(string_split(source_file, '.')[-1]) ELSE 'unknown' END AS format, count(*)::BIGINT AS n FROM :mail GROUP BY 1")
def formats(m):
    return M.format_counts(m)


@query("eml5_names", "mail", sql=r"SELECT email_idx, '|' || lower(regexp_extract(string_split(recipients, ', ')[1], '<(.*)>', 1)) || CASE WHEN len(string_split(recipients, ', ')) > 1 THEN ';' || regexp_extract(string_split(recipients, ', ')[2], '^(.*) <', 1) || '|' || lower(regexp_extract(string_split(recipients, ', ')[2], '<(.*)>', 1)) ELSE '' END AS names FROM :mail")
def names(m):
    return m.select("email_idx", F.array_join(F.transform(M.names(F.col("recipients")), lambda x: F.concat(x["name"], F.lit("|"), x["address"])), ";").alias("names"))


_KW = " ".join(f"WHEN contains(t, '{k}') THEN 'Keyword: ''{k}'''" for k in M.PRIVILEGE)


@query("eml4_privilege", "mail", sql=f"SELECT email_idx, concat_ws('; ', CASE {_KW} END, CASE WHEN contains(a || ' ' || t, 'person 3') THEN 'Attorney name: ''person 3''' END, CASE WHEN contains(a, 'b.org') THEN 'Privileged domain: ''b.org''' END) AS reasons FROM (SELECT email_idx, lower(subject || ' ' || body) AS t, lower(sender || ' ' || recipients) AS a FROM :mail) q WHERE reasons <> ''")
def privilege(m):
    return M.privilege(m, ["Person 3"], ["b.org"]).select("email_idx", "reasons")


@query("eml5_addresses", "mail", sql=f"SELECT email_idx, lower(array_to_string({ADDR.format('recipients')}, '|')) AS addresses FROM :mail")
def addresses(m):
    return m.select("email_idx", F.array_join(M.addresses(F.col("recipients")), "|").alias("addresses"))


@query("eml6_generated_ids", "mail", sql="SELECT email_idx, CASE WHEN in_reply_to IS NULL OR in_reply_to = '' THEN '<generated-' || email_idx || '-' || substr(md5(subject), 1, 8) || '>' ELSE in_reply_to END AS id FROM :mail")
def generated(m):
    return m.select("email_idx", M.message_id(F.col("in_reply_to"), F.col("email_idx"), F.col("subject")).alias("id"))


@query("eag1_top_senders", "mail", sql=f"WITH {DUP} SELECT s AS sender, count(*)::BIGINT AS n FROM (SELECT lower(unnest({ADDR.format('sender')})) AS s FROM d WHERE duplicate_of IS NULL) q GROUP BY s ORDER BY n DESC, s LIMIT 10")
def senders(m):
    return M.duplicates(m).filter("duplicate_of IS NULL").select(F.explode(M.addresses(F.col("sender"))).alias("sender")).groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "sender").limit(10)


@query("eag2_mail_per_day", "mail", sql=f"WITH {DUP} SELECT CAST(date AS DATE) AS day, count(*)::BIGINT AS n FROM d WHERE duplicate_of IS NULL GROUP BY 1")
def per_day(m):
    return M.duplicates(m).filter("duplicate_of IS NULL").groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n"))


@query("grf14_mail_network", "mail", sql=f"WITH {DUP} SELECT src, dst, count(*)::BIGINT AS weight FROM (SELECT DISTINCT email_idx, src, lower(unnest({ADDR.format('recipients')})) AS dst FROM (SELECT email_idx, recipients, lower(unnest({ADDR.format('sender')})) AS src FROM d WHERE duplicate_of IS NULL) x) q WHERE src <> dst GROUP BY 1, 2")
def network(m):
    return M.network(M.duplicates(m).filter("duplicate_of IS NULL"))


@query("src23_strip_html", "mail", sql=r"SELECT email_idx, regexp_replace(regexp_replace(regexp_replace('<p>' || subject || '</p> <b>x</b>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM :mail")
def stripped(m):
    return m.select("email_idx", M.strip_html(F.concat(F.lit("<p>"), "subject", F.lit("</p> <b>x</b>"))).alias("text"))
