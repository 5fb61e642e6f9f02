from pyspark.sql import Window as _Window
from pyspark.sql import functions as F

from docketlake.functions.core import tasks_of
from docketlake.functions.scratch import Steps
from docketlake.operators import records as R
from docketlake.operators import text as T
from docketlake.operators import timeseries as TS
from docketlake.plans.catalog import query


def _hits(words, t="t"):
    return " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in words)


def _counts(words, t="t"):
    return " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}" for w in words)


def _best(lists, make):
    scores = ", ".join(f"({make(w)}) AS s{i}" for i, w in enumerate(lists.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(lists))) + ")"
    pick = " ".join(f"WHEN s{i} = b THEN '{k}'" for i, k in enumerate(lists))
    return scores, best, pick


_s, _b, _p = _best(T.EVENT_TYPES, _hits)
EVENT = f"SELECT doc_id, CASE WHEN b = 0 THEN 'other' {_p} END AS event_type FROM (SELECT doc_id, {_b} AS b, * EXCLUDE (doc_id) FROM (SELECT doc_id, {_s} FROM (SELECT doc_id, lower(text) AS t FROM :chron) x) y) z"


@query("chr3_event_type", "chron", sql=EVENT)
def event_type(c):
    return c.select("doc_id", T.event_type(F.col("text")).alias("event_type"))


@query("hag1_events_by_type", "chron", sql=f"SELECT event_type, count(*)::BIGINT AS n FROM ({EVENT}) e GROUP BY 1")
def by_type(c):
    return c.groupBy(T.event_type(F.col("text")).alias("event_type")).agg(F.count("*").alias("n"))


@query("hag1_events_by_document", "filing", sql="SELECT form_type, count(*)::BIGINT AS n, count(DISTINCT filing_date)::BIGINT AS days FROM :filing GROUP BY 1")
def by_document(f):
    """Events per document: the filings of a form are its events."""
    return R.events_by_document(f.select(F.col("form_type").alias("document"), F.col("filing_date").alias("day"))).withColumnRenamed("document", "form_type")


_DATES = r"""SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day FROM orders"""


def _dates(c):
    return c.select("doc_id", "text", F.explode_outer(T.dates_in(F.col("text"))).alias("d")).select("doc_id", "text", "d.raw", "d.day", "d.at").filter("day is not null")


@query("chr1_dates", "chron", sql=_DATES)
def dates(c):
    return _dates(c).select("doc_id", "day")


@query("chr2_sentences", "chron", sql=r"SELECT doc_id, CASE WHEN length(s) < 50 THEN text ELSE s END AS sentence FROM (SELECT doc_id, text, regexp_extract(text, '\. (On .*)\. Later', 1) || '.' AS s FROM :chron) q")
def sentences(c):
    return _dates(c).select("doc_id", T.sentence_around(F.col("text"), F.col("raw"), F.col("at")).alias("sentence"))


@query("flt2_flt6_event_filter", "chron", sql=f"SELECT doc_id FROM ({EVENT}) e JOIN orders ON o_orderkey = doc_id WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND event_type IN ('filing', 'payment')")
def event_filter(c):
    typed = c.select("doc_id", T.event_type(F.col("text")).alias("event_type")).filter(F.col("event_type").isin("filing", "payment"))
    return _dates(c).filter(F.col("day").between("1995-01-01", "1995-12-31")).select("doc_id").join(typed, "doc_id").select("doc_id")


@query("win3_chr5_event_gaps", "chron", sql="SELECT day, nx AS next_day, (nx - day)::BIGINT AS days, CASE WHEN nx - day >= 90 THEN 'high' WHEN nx - day >= 60 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d) q WHERE nx - day >= 30")
def gaps(c):
    return TS.event_gaps(_dates(c).select("day"))


#: Events of a case: a customer's orders.
_CASE = "SELECT o_custkey AS case_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, 'Order ' || o_orderkey || ' with priority ' || o_orderpriority AS text FROM orders"


@query("jon15_gap_context", "case_event", sql=f"WITH e AS ({_CASE}), f AS (SELECT case_id, day, min_by(text, event_id) AS said FROM e GROUP BY 1, 2), g AS (SELECT *, lead(day) OVER (PARTITION BY case_id ORDER BY day) AS next_day, lead(said) OVER (PARTITION BY case_id ORDER BY day) AS event_after FROM f) SELECT case_id, day, next_day, (next_day - day)::BIGINT AS days, CASE WHEN next_day - day >= 90 THEN 'high' WHEN next_day - day >= 60 THEN 'medium' ELSE 'low' END AS severity, said AS event_before, event_after FROM g WHERE next_day - day >= 30")
def gap_context(e):
    return TS.gap_context(e, by=["case_id"])


@query("jon7_other_dates", "chron", sql="SELECT doc_id, 'Later' AS raw FROM :chron")
def other(c):
    """A model's spans: one inside of the date that the rules find, which goes, and one elsewhere, which stays."""
    t = F.col("text")
    rows = c.withColumn("d", T.dates_in(t))
    spans = F.array(F.struct((F.col("d")[0]["at"] + 1).alias("at"), F.substring(F.col("d")[0]["raw"], 2, 3).alias("raw")), F.struct(F.locate("Later", t).alias("at"), F.lit("Later").alias("raw")))
    return rows.select("doc_id", F.explode(T.other_dates(F.col("d"), spans)).alias("s")).select("doc_id", "s.raw")


@query("chr4_dedup_events", "chron")
def dedup(c):
    return T.dedup_events(_dates(c).select(F.col("doc_id").alias("event_id"), "day", "text"))


@query("chr4_first_statements", "statement")
def first_statements(s):
    """The first of like statements of a day; a third of them stand under one day."""
    return T.dedup_events(s)


@query("chr6_statement_conflicts", "statement")
def statement_conflicts(s):
    """Like statements under different days, among thousands of different texts."""
    return T.conflicts(s)


@query("chr6_conflicts", "clause")
def conflicts(c):
    """Like statements under different days, as pairs of classes: the clauses of documents, dated by their number."""
    e = c.select(F.col("change_id").alias("event_id"), "doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("day"), F.col("old_text").alias("text"))
    return T.conflicts(e)


_s2, _b2, _p2 = _best(T.MATTERS, _counts)
_tot = " + ".join(f"s{i}" for i in range(len(T.MATTERS)))
MATTER = f"SELECT client_id, CASE WHEN b = 0 THEN 'general' {_p2} END AS matter, CASE WHEN b = 0 THEN 0 ELSE CAST(floor(b * 100 / ({_tot}) + 0.5e0) AS BIGINT) END AS confidence FROM (SELECT client_id, {_b2} AS b, * EXCLUDE (client_id) FROM (SELECT client_id, {_s2} FROM (SELECT client_id, lower(text) AS t FROM :intake) x) y) z"


@query("int3_matter_type", "intake", sql=MATTER)
def matter(i):
    return T.with_matter(i).select("client_id", "matter", "confidence")


@query("int1_contact_info", "intake", sql=rf"SELECT client_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{T.PHONE}')))[1:5], '|') AS phones, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{T.EMAIL}')))[1:5], '|') AS mails FROM :intake")
def contacts(i):
    p, m = T.contact_info(F.col("text"))
    return i.select("client_id", F.array_join(p, "|").alias("phones"), F.array_join(m, "|").alias("mails"))


@query("int2_ssn", "intake", sql=rf"SELECT client_id, len(regexp_extract_all(text, '{T.SSN}'))::BIGINT AS n FROM :intake")
def ssn(i):
    return i.select("client_id", F.regexp_count("text", F.lit(T.SSN)).cast("long").alias("n"))


@query("int4_name_variations", "intake", sql="SELECT client_id, CASE client_id % 3 WHEN 0 THEN 'John Q ' || name || '|' || name || '|John ' || name || '|J. ' || name || '|' || name || ', John|John Q. ' || name WHEN 1 THEN name || ' Roe|Roe|' || substr(name, 1, 1) || '. Roe|Roe, ' || name ELSE name END AS names FROM :intake")
def names(i):
    """Names of three, two and one parts."""
    full = F.when(F.col("client_id") % 3 == 0, F.concat(F.lit("John Q "), "name")).when(F.col("client_id") % 3 == 1, F.concat("name", F.lit(" Roe"))).otherwise(F.col("name"))
    return i.select("client_id", F.array_join(T.name_variations(full), "|").alias("names"))


_R = " ".join("WHEN " + " OR ".join(f"contains(s, '{w}')" for w in ws) + f" THEN '{r}'" for r, ws in T.ROLES.items())


@query("int5_roles", "intake", sql=rf"SELECT client_id, CASE {_R} ELSE 'Unknown' END AS role FROM (SELECT client_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[.!?]\s+'), lambda x: contains(x, lower(name))), chr(10)) AS s FROM :intake) q")
def roles(i):
    return i.select("client_id", T.infer_role(F.col("name"), F.col("text")).alias("role"))


@query("int1_street_addresses", "intake", sql="SELECT client_id, client_id || ' Oak Tree Lane, Springfield, IL 62704' AS addresses FROM :intake")
def addresses(i):
    t = F.concat(F.lit("Lives at: "), F.col("client_id").cast("string"), F.lit(" Oak Tree Lane, Springfield, IL 62704."))
    return i.select("client_id", F.array_join(T.street_addresses(t), "|").alias("addresses"))


#: Names said at an intake: the client twice, once in capitals, an adviser, a firm and an initial.
_SAID = [("ORG", 0, "'Acme ' || jurisdiction || ' LLC'"), ("PERSON", 5, "name"), ("PERSON", 9, "upper(name)"), ("PERSON", 7, "'Ann Lee'"), ("ORG", 8, "'ann lee'"), ("PERSON", 6, "' X '")]
_SAID_SQL = " UNION ALL ".join(f"SELECT client_id, {at} AS spot, {x} AS name, '{k}' AS kind FROM :intake" for k, at, x in _SAID)


@query("int6_conflict_list", "intake", sql=f"WITH s AS ({_SAID_SQL}), f AS (SELECT client_id, trim(name) AS name, kind, spot, row_number() OVER (PARTITION BY client_id, lower(trim(name)) ORDER BY CASE kind WHEN 'PERSON' THEN 0 ELSE 1 END, spot) AS k FROM s WHERE length(trim(name)) >= 2) SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY CASE kind WHEN 'PERSON' THEN 0 ELSE 1 END, spot)::BIGINT AS place, name, kind FROM f WHERE k = 1")
def conflict_list(i):
    said = F.array(*[F.struct(F.lit(at).alias("at"), F.expr(x).alias("name"), F.lit(k).alias("kind")) for k, at, x in _SAID])
    return T.conflict_list(i.select("client_id", F.explode(said).alias("s")).select("client_id", "s.*"))


_LV = ", ".join("('{}', '{}', {}, '{}')".format(m, t, k, d.replace("'", "''")) for m, t, k, d in T.checklist_rows())


@query("int7_checklist", "intake", sql=f"WITH l AS (SELECT * FROM (VALUES {_LV}) v(matter, tier, position, document)), m AS (SELECT client_id, CASE WHEN matter IN (SELECT matter FROM l) THEN matter ELSE 'general' END AS matter FROM ({MATTER}) x) SELECT client_id, matter, tier, position, document FROM m JOIN l USING (matter)")
def checklist(i):
    return T.document_checklist(T.with_matter(i).select("client_id", "matter"))


@query("int8_incident_date", "intake", sql="SELECT client_id, CASE WHEN client_id % 3 = 0 THEN incident_date ELSE DATE '2021-03-04' END AS incident FROM :intake")
def incidents(i):
    """The date that stands with the incident, else the first one past."""
    word = F.when(F.col("client_id") % 3 == 0, "it happened").otherwise("they met again")
    t = F.concat(F.lit("A long contract on the sale of the old mill was made on 3/4/2021 by both of them. In the morning of "), F.date_format("incident_date", "MMMM d, yyyy"), F.lit(" "), word, F.lit(" in the rain and the cold. Nothing else was said here."))
    return i.select("client_id", T.incident_date(t, F.lit("2026-01-01").cast("date")).alias("incident"))


_Y = "CASE jurisdiction " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.LIMITATION_YEARS["personal_injury"].items() if k != "default") + " ELSE 2 END"


@query("int8_limitation", "intake", sql=f"SELECT client_id, due, (DATE '2025-01-01' - due) * -1 AS days_left, CASE WHEN due < DATE '2025-01-01' THEN 'expired' WHEN due - DATE '2025-01-01' < 30 THEN 'urgent' WHEN due - DATE '2025-01-01' < 90 THEN 'caution' ELSE 'ok' END AS level FROM (SELECT client_id, incident_date + {_Y} * 365 AS due FROM :intake) q")
def limits(i):
    d, n, lv = T.limitation(F.lit("personal_injury"), F.col("jurisdiction"), F.col("incident_date"), F.lit("2025-01-01").cast("date"))
    return i.select("client_id", d.alias("due"), n.alias("days_left"), lv.alias("level"))


@query("int9_opposing", "intake", sql="SELECT client_id, CASE client_id % 3 WHEN 0 THEN 'Bob Roe|Zed Co' WHEN 1 THEN 'Bob Roe' ELSE '' END AS parties FROM :intake")
def opposing(i):
    person = lambda n, c: F.struct(F.lit(n).alias("name") if isinstance(n, str) else n.alias("name"), c.alias("context"))
    said = F.when(F.col("client_id") % 3 < 2, "a claim against Bob Roe").otherwise("spoke to Bob Roe")
    people = F.array(person("Bob Roe", said), person(F.col("name"), F.lit("the defendant is a client")), person("Bob Roe", F.lit("Bob Roe again")))
    fields = F.when(F.col("client_id") % 3 == 0, F.create_map(F.lit("adverse_party"), F.lit("Zed Co"), F.lit("judge"), F.lit("no")))
    return i.select("client_id", F.array_join(T.opposing_parties(people, F.col("name"), F.coalesce(fields, F.expr("map()").cast("map<string,string>"))), "|").alias("parties"))


_B = " ".join(f"WHEN regexp_matches(trim(text), '{p}') THEN {c}" for p, c in T.BOUNDARIES)
_CAPS = r"length(trim(text)) < 120 AND len(regexp_split_to_array(trim(text), '\s+')) >= 2 AND upper(text) = text AND NOT starts_with(trim(text), '[TABLE')"
BOUND = rf"""SELECT doc_id, pos, CASE WHEN h = '' THEN 'Untitled Section' ELSE h END AS heading, CASE WHEN c0 > 0 AND num <> '' THEN least(len(regexp_extract_all(regexp_replace(num, '\.+$', ''), '\.')) + 1, 4) ELSE 1 END::BIGINT AS level, confidence::BIGINT AS confidence FROM (
SELECT doc_id, pos, regexp_replace(regexp_replace(text, '^[A-Z]?-?\d+\s+', ''), '^#+\s*', '') AS h, regexp_extract(text, '^\s*([\d.]+)', 1) AS num, c0,
 CASE WHEN c0 > 0 THEN c0 WHEN caps THEN 70 WHEN k - coalesce(full_k, 0) - 1 >= 3 THEN 30 ELSE 0 END AS confidence FROM (
 SELECT *, max(CASE WHEN text <> '' THEN k END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_k FROM (SELECT doc_id, pos, text, CASE {_B} ELSE 0 END AS c0, {_CAPS} AS caps, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM :block) a) b WHERE text <> '') c WHERE confidence > 0"""


@query("chk1_boundaries", "block", sql=BOUND)
def bounds(b):
    return T.boundaries(b)


@query("chk2_clean_heading", "block", sql=r"SELECT pos, CASE WHEN h = '' THEN 'Untitled Section' ELSE h END AS heading FROM (SELECT pos, regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[A-Z]?-?\d+\s+', '')), '^#+\s*', '') AS h FROM :block) q")
def headings(b):
    return b.select("pos", T.clean_heading(F.col("text")).alias("heading"))


@query("chk6_tokens", "block", sql="SELECT pos, (length(text) // 4)::BIGINT AS tokens FROM :block")
def tokens(b):
    return b.select("pos", T.count_tokens(F.col("text")).alias("tokens"))


#: A public vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("chk6_vocabulary_tokens", "segment")
def vocabulary_tokens(s):
    return s.select("rec_id", "id", T.count_tokens(F.col("text"), VOCABULARY).alias("tokens"))


@query("chk7_mode", "block", sql=f"SELECT doc_id, count(*) FILTER (WHERE confidence >= 70)::BIGINT AS strong, CASE WHEN count(*) FILTER (WHERE confidence >= 70) >= 3 THEN 'structure' ELSE 'tokens' END AS mode FROM ({BOUND}) q GROUP BY doc_id")
def mode(b):
    return T.chunk_mode(T.boundaries(b))


@query("win5_running_section", "block", sql=r"""SELECT pos, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Preamble') AS section FROM (SELECT doc_id, pos,
CASE WHEN regexp_matches(text, '(?i)^(?:(?:ARTICLE|SECTION|CHAPTER|PART)\s+[\dIVXLCDM]+|(?:\d+\.)+\s+|[IVXLCDM]+\.\s+|[A-Z]\.\s+)') OR (length(text) < 100 AND upper(text) = text AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 2) THEN nullif(trim(substr(text, 1, 80)), '') END AS h FROM :block) q""")
def running(b):
    return T.running_section(b).select("pos", "section")


@query("dif3_sections", "block", sql=r"""SELECT pos, CASE WHEN regexp_matches(text, '(?i)^(?:(?:ARTICLE|SECTION|CHAPTER|PART)\s+[\dIVXLCDM]+|(?:\d+\.)+\s+|[IVXLCDM]+\.\s+|[A-Z]\.\s+)') OR (length(text) < 100 AND upper(text) = text AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 2) THEN trim(substr(text, 1, 80)) ELSE '' END AS section FROM :block""")
def sections(b):
    return b.select("pos", T.detect_section(F.col("text")).alias("section"))


@query("chk3_chk5_token_chunks", "segment")
def token_chunks(s):
    docs = s.groupBy(F.col("rec_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return T.chunk_documents(docs, 200, 40)


@query("chk4_structure_chunks", "block")
def structure(b):
    return T.structure_chunks(T.running_section(b).select("doc_id", "pos", F.col("section").alias("heading"), "text"), 24, 4, 8)


@query("chk8_paragraph_chunks", "segment")
def para_chunks(s):
    """All pieces of all texts."""
    return s.select("rec_id", "id", F.posexplode(T.paragraph_chunks(F.col("text"), 500)).alias("piece", "text"))


@query("chk5_page_estimates", "block", sql="SELECT doc_id, k AS chunk, greatest(1, (k * 40 * 7) // (n * 40) + 1)::BIGINT AS start_page, least(greatest(1, (k * 40 * 7) // (n * 40) + 1) + greatest(1, 7 // n), 7)::BIGINT AS end_page FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM :block) q")
def page_estimates(b):
    """Blocks as chunks of 40 characters, of documents of seven pages."""
    from pyspark.sql import Window

    chunks = b.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long").alias("chunk"), F.repeat(F.lit("x"), F.lit(40)).alias("text"))
    pages = b.groupBy("doc_id").agg(F.lit(7).alias("pages"), (F.count("*") * 40).alias("n_chars"))
    return T.page_estimates(chunks, pages).select("doc_id", "chunk", "start_page", "end_page")


@query("chk7_worth_chunking", "block", sql="SELECT doc_id FROM :block GROUP BY doc_id HAVING length(trim(string_agg(text, ' ' ORDER BY pos))) >= 50")
def worth_chunking(b):
    whole = b.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return T.worth_chunking(whole).select("doc_id")


_BOTH = "lower(old_text || ' ' || new_text)"
_HI, _ME = "|".join(T.HIGH_RISK), "|".join(T.MEDIUM_RISK)
_W = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"
RISK = rf"""SELECT change_id, section, CASE WHEN hi THEN 'HIGH' WHEN me THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN hi AND regexp_matches(b, '{T.RISK_RELEVANT}') THEN 'Risk-relevant' WHEN hi OR me THEN 'Substantive' WHEN len(list_filter(ow, lambda x: NOT list_contains(nw, x))) + len(list_filter(nw, lambda x: NOT list_contains(ow, x))) <= 3 THEN 'Administrative' ELSE 'Substantive' END AS category
FROM (SELECT change_id, section, {_BOTH} AS b, regexp_matches({_BOTH}, '(?i){_HI}') AS hi, regexp_matches({_BOTH}, '(?i){_ME}') AS me, {_W.format('old_text')} AS ow, {_W.format('new_text')} AS nw FROM :clause) q"""


def _risk(c):
    return T.with_risk(c).select("change_id", "section", "risk", "category")


@query("dif4_change_risk", "clause", sql=RISK)
def risk(c):
    return _risk(c)


@query("dag2_redline_counts", "clause", sql=f"SELECT coalesce(risk, '*') AS risk, coalesce(category, '*') AS category, coalesce(section, '*') AS section, count(*)::BIGINT AS n FROM ({RISK}) r GROUP BY GROUPING SETS ((risk), (category), (section))")
def redline(c):
    sql = "SELECT coalesce(risk, '*') AS risk, coalesce(category, '*') AS category, coalesce(section, '*') AS section, count(*) AS n FROM {r} GROUP BY GROUPING SETS ((risk), (category), (section))"
    return c.sparkSession.sql(sql, r=_risk(c))


@query("dag1_changes_by_section", "clause", sql=f"SELECT section, count(*) FILTER (WHERE risk = 'HIGH')::BIGINT AS high, count(*) FILTER (WHERE risk = 'MEDIUM')::BIGINT AS medium, count(*) FILTER (WHERE risk = 'LOW')::BIGINT AS low, count(*)::BIGINT AS total FROM ({RISK}) r GROUP BY section")
def by_section(c):
    p = _risk(c).groupBy("section").pivot("risk", ["HIGH", "MEDIUM", "LOW"]).count().fillna(0)
    return p.select("section", F.col("HIGH").alias("high"), F.col("MEDIUM").alias("medium"), F.col("LOW").alias("low"), (F.col("HIGH") + F.col("MEDIUM") + F.col("LOW")).alias("total"))


def _pairs(c):
    """Documents as pairs of old and new paragraphs."""
    return c.groupBy(F.col("doc_id").alias("pair_id")).agg(*[F.sort_array(F.collect_list(F.struct("change_id", F.col(x).alias("t")))).getField("t").alias(n) for x, n in (("old_text", "old"), ("new_text", "new"))])


@query("dif1_dif2_paragraph_diff", "clause")
def diff(c):
    return T.diff_documents(_pairs(c))


def _changes(c):
    """Changes of the pairs by index, where each paragraph of the old side that differs is a change of its own."""
    steps = Steps(c.sparkSession)  # else the lens is worked out for each side
    w = steps.keep(c.select("doc_id", "change_id", "section"))
    n = F.row_number().over(_Window.partitionBy("doc_id").orderBy("change_id")) - 1
    rows = steps.keep(w.repartition(tasks_of(w), "doc_id").withColumn("n", n.cast("long")))
    kind = F.when(F.col("n") % 3 == 0, "modified").when(F.col("n") % 3 == 1, "deleted").otherwise("added")
    old = rows.select(F.col("doc_id").alias("pair_id"), F.col("n").alias("index"), "section").filter("index % 7 <> 6")
    new = rows.select(F.col("doc_id").alias("pair_id"), F.col("n").alias("index"), F.concat(F.lit("New "), "section").alias("section"))
    changes = rows.select(F.col("doc_id").alias("pair_id"), kind.alias("type"), F.when(kind != "added", F.col("n")).alias("old_index"), F.when(kind != "deleted", F.col("n")).alias("new_index"))
    return changes, old, new


_CH = """WITH n AS (SELECT doc_id AS pair_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY change_id) - 1 AS n FROM :clause),
c AS (SELECT pair_id, n, CASE n % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' ELSE 'added' END AS type, CASE WHEN n % 3 <> 2 AND n % 7 <> 6 THEN section WHEN n % 3 <> 1 THEN 'New ' || section ELSE 'Unknown' END AS section FROM n)"""


@query("jon12_change_sections", "clause", sql=f"{_CH} SELECT pair_id, n AS place, type, section FROM c")
def change_sections(c):
    return T.change_sections(*_changes(c)).select("pair_id", F.coalesce("old_index", "new_index").alias("place"), "type", "section")


@query("dag1_section_stats", "clause", sql=f"{_CH}, g AS (SELECT pair_id, section, count(*) FILTER (WHERE type = 'added')::BIGINT AS additions, count(*) FILTER (WHERE type = 'deleted')::BIGINT AS deletions, count(*) FILTER (WHERE type = 'modified')::BIGINT AS modifications, count(*)::BIGINT AS total FROM c GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY total DESC, section)::BIGINT AS place FROM g")
def section_stats(c):
    return T.section_stats(T.change_sections(*_changes(c)))


@query("dag1_percent_changed", "clause", sql=f"{_CH} SELECT pair_id, count(*)::BIGINT AS changes, 1000::BIGINT AS changed_milli FROM c GROUP BY 1")
def percent_changed(c):
    return T.percent_changed(_changes(c)[0], _pairs(c))


@query("dif5_similarity", "clause")
def similar(c):
    return c.select("change_id", T.similarity(F.col("old_text"), F.col("new_text")).alias("ratio"))


@query("set4_word_overlap", "clause", sql=f"SELECT change_id, len(list_intersect({_W.format('old_text')}, {_W.format('new_text')}))::BIGINT AS shared FROM :clause")
def overlap(c):
    w = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda y: y != ""))
    return c.select("change_id", F.size(F.array_intersect(w("old_text"), w("new_text"))).cast("long").alias("shared"))


@query("ent2_paragraphs", "segment", sql=r"SELECT rec_id * 100000 + id AS doc_id, p - 1 AS paragraph_index, trim(x) AS text FROM (SELECT rec_id, id, unnest(range(1, 3)) AS p, unnest([text, 'second part']) AS x FROM :segment) q")
def paras(s):
    return T.paragraphs(s.select((F.col("rec_id") * 100000 + F.col("id")).alias("doc_id"), F.concat("text", F.lit("\n  \n second part \n\n ")).alias("text"))).withColumn("paragraph_index", F.col("paragraph_index").cast("long"))


_N = r"""regexp_replace(regexp_replace(raw_name, '^(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Hon\.|Judge|Attorney|Atty\.)\s+', ''), '[\s.,;:]+$', '')"""
MEN = "SELECT *, " + _N + " AS name FROM :mention WHERE label IN (" + ", ".join(f"'{x}'" for x in T.ENTITY_LABELS) + ")"


@query("ent3_flt5_names", "mention", sql=f"SELECT DISTINCT label, raw_name, name FROM ({MEN}) m")
def normal(m):
    return T.mentions(m).select("label", "raw_name", "name").distinct()


@query("nag1_flt3_entity_index", "mention", sql=f"SELECT name, label, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS documents, min_by(context, (doc_id, paragraph_index, context)) AS first_context, array_to_string(list(context ORDER BY doc_id, paragraph_index, context)[1:5], '|') AS contexts FROM ({MEN}) m GROUP BY 1, 2 HAVING count(*) >= 2")
def index(m):
    return T.entity_index(T.mentions(m), 2).withColumn("contexts", F.array_join("contexts", "|"))


@query("nag2_top_entities", "mention", sql=f"SELECT name, label, count(*)::BIGINT AS n FROM ({MEN}) m GROUP BY 1, 2 ORDER BY n DESC, name, label LIMIT 20")
def top_entities(m):
    return T.top_entities(T.mentions(m))


@query("nag2_extracts", "mention", sql=f"SELECT name, context, doc_id, paragraph_index FROM ({MEN}) m WHERE label = 'GPE'")
def extracts(m):
    return T.extracts(T.mentions(m), "GPE")


@query("nag2_type_totals", "mention", sql=f"SELECT label, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS names FROM ({MEN}) m GROUP BY label")
def totals(m):
    return T.mentions(m).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("grf15_cooccurrence", "mention", sql=f"WITH d AS (SELECT DISTINCT doc_id, paragraph_index, name FROM ({MEN}) m) SELECT a.name AS src, b.name AS dst, count(*)::BIGINT AS weight FROM d a JOIN d b USING (doc_id, paragraph_index) WHERE a.name < b.name GROUP BY 1, 2")
def together(m):
    return T.cooccurrence(T.mentions(m))


@query("grf12_entity_communities", "mention")
def entity_communities(m):
    from docketlake.operators import graph as G

    return G.communities(T.cooccurrence(T.mentions(m)), weighted=False)


@query("ent4_canonical", "mention", sql=f"WITH n AS (SELECT DISTINCT label, name FROM ({MEN}) m), h AS (SELECT a.label, a.name, first(b.name ORDER BY length(b.name) DESC, b.name) AS home FROM n a JOIN n b ON a.label = b.label AND length(a.name) >= 3 AND contains(lower(b.name), lower(a.name)) AND (length(b.name) > length(a.name) OR (length(b.name) = length(a.name) AND b.name < a.name)) GROUP BY 1, 2) SELECT n.label, n.name, coalesce(home, n.name) AS canonical FROM n LEFT JOIN h ON n.label = h.label AND n.name = h.name")
def canonical(m):
    return T.canonical_names(T.mentions(m))


_ENT_TEXT = "'Acme Trading ' || (accession % 7) || ' and Acme Trading LLC paid $' || (accession % 900) || ',000.50 to Dr. Jane Roe on 3/' || (1 + accession % 28) || '/2021 in Austin, TX under 15 U.S.C. § ' || (accession % 80) || '. ' || text"


@query("ent1_rule_entities", "filing", sql=f"WITH t AS (SELECT accession AS doc_id, accession FROM :filing) SELECT doc_id, raw_name, label FROM (SELECT doc_id, 'Acme Trading LLC' AS raw_name, 'ORG' AS label FROM t UNION ALL SELECT doc_id, '$' || (accession % 900) || ',000.50', 'MONEY' FROM t UNION ALL SELECT doc_id, 'Dr. Jane Roe', 'PERSON' FROM t UNION ALL SELECT doc_id, 'Austin, TX', 'GPE' FROM t UNION ALL SELECT doc_id, '15 U.S.C. § ' || (accession % 80), 'LAW' FROM t UNION ALL SELECT doc_id, '3/' || (1 + accession % 28) || '/2021', 'DATE' FROM t) q")
def rule_entities(f):
    paras_ = f.select(F.col("accession").alias("doc_id"), F.lit(0).cast("long").alias("paragraph_index"), F.expr(_ENT_TEXT).alias("text"))
    return T.extract_entities(paras_).select("doc_id", "raw_name", "label")


@query("off1_officers", "filing", sql="SELECT accession, CASE accession % 3 WHEN 0 THEN 'John Q. Smith:Chief Executive Officer|Mary Jones:Treasurer' WHEN 1 THEN 'Ann Lee:CFO' ELSE '' END AS officers FROM :filing")
def officers(f):
    text = F.when(F.col("accession") % 3 == 0, F.col("text")).when(F.col("accession") % 3 == 1, "Ann Lee, CFO, Ann Lee, CFO again").otherwise("no officer here, CFO")
    return f.select("accession", F.array_join(F.transform(T.officers(text), lambda o: F.concat(o["name"], F.lit(":"), o["title"])), "|").alias("officers"))


_MOM = " UNION ALL ".join("SELECT rec_id, id, '{k}' AS type, CASE {w} END AS matched_text FROM :segment".format(k=k, w=" ".join("WHEN regexp_matches(text, '(?i){p}') THEN regexp_extract(text, '(?i){p}')".format(p=p.replace("'", "''")) for p in ps)) for k, ps in T.KEY_MOMENTS.items())
MOM = f"SELECT * FROM ({_MOM}) m WHERE matched_text IS NOT NULL"


@query("dep2_key_moments", "segment", sql=MOM)
def moments(s):
    return R.key_moments(s)


@query("tag2_moments_by_type", "segment", sql=f"SELECT type, count(*)::BIGINT AS n FROM ({MOM}) q GROUP BY type")
def moment_counts(s):
    return R.key_moments(s).groupBy("type").agg(F.count("*").alias("n"))
