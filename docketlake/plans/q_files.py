"""Sources and sinks as queries: lens rows are written in a file format to the shared folder and read back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlake.functions.core import small
from docketlake.functions.scratch import Steps
from docketlake.operators import calendar as C
from docketlake.sources import sinks as S
from docketlake.sources import tables as T
from docketlake.plans.catalog import query
from docketlake.plans.q_calendar import CAL, DUE, PLACES, RANK, STEPS, _requests

CENTS = "CAST(floor({} * 100 + 0.5e0) AS BIGINT)"


def _folder(df, kind):
    """A folder for files of a kind; it goes when the driver ends."""
    return f"{Steps(df.sparkSession).root}/{kind}"


#: Rows that go into one file, about.
FILE_ROWS = 20_000


def _dealt_out(rows, key, *by):
    """(rows with ``file``, number of files): ``file`` is ``by`` (all rows, if none) and a hash of ``key``, about FILE_ROWS rows
    each, however many rows there are."""
    if not by:
        files = max(1, -(-rows.count() // FILE_ROWS))
        return rows.withColumn("file", F.pmod(F.xxhash64(key), F.lit(files)).cast("string")), files
    n = Steps(rows.sparkSession).keep(rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.count("*") / FILE_ROWS).alias("_n")))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = F.pmod(F.xxhash64(key), F.col("_n")).cast("string")
    return rows.join(small(n), same).withColumn("file", F.concat_ws("-", *by, part)).drop("_n", *[f"_{c}" for c in by]), n.agg(F.sum("_n")).first()[0] or 1


def _spread(rows, key, *by):
    return _dealt_out(rows, key, *by)[0]


#: Files that a task writes, about.
TASK_FILES = 10


def _sorted_files(lines, files, kind):
    """The lines (file, n, value) as text, a folder per ``file`` with one file, in the order of ``n``. Lines are sorted and written
    as they come, so that no task holds a file."""
    path = _folder(lines, kind)
    dealt = lines.repartition(-(-files // TASK_FILES), "file").sortWithinPartitions("file", "n")
    dealt.select("file", "value").write.partitionBy("file").text(path)
    return path


def _written(lines, kind, column="value"):
    """Text of the lines (file, n, value), one file per ``file``; the files' names differ."""
    path = _folder(lines, kind)
    whole = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", column))), lambda x: x[column]), "\n").alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("src1_csv_billing", "billing", sql=f"SELECT timekeeper, count(*)::BIGINT AS n, sum({CENTS.format('coalesce(amount, hours * rate)')})::BIGINT AS cents FROM :billing GROUP BY 1")
def csv_billing(b):
    path = _folder(b, "csv")
    b.select(F.date_format("date", "yyyy-MM-dd").alias("Invoice Date"), F.col("timekeeper").alias("Attorney"), F.col("hours").alias("Hours Worked"), F.col("rate").alias("Hourly Rate"), F.col("amount").alias("Total"), F.col("description").alias("Narrative")).write.option("header", True).csv(path)
    x = T.billing(T.read_csv(b.sparkSession, path))
    return x.groupBy("timekeeper").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("amount") * 100 + 0.5).cast("long")).alias("cents"))


# Every row of the lens is written and read back.
def _ledes(b):
    rows, files = _dealt_out(b, "entry_id")
    rows = rows.select("file", F.col("entry_id").alias("n"), F.concat_ws("|", F.date_format("date", "yyyyMMdd"), "timekeeper", F.col("hours").cast("string"), "entry_id", "matter", F.lit("[]")).alias("value"))
    head = b.sparkSession.range(files).select(F.col("id").cast("string").alias("file"), F.lit("").alias("n"), F.lit("LEDES1998B[]\nLINE_ITEM_DATE|TIMEKEEPER_NAME|LINE_ITEM_HOURS|LINE_ITEM_DESCRIPTION|CLIENT_MATTER|[]").alias("value"))
    x = T.billing(T.read_ledes(b.sparkSession, _sorted_files(rows.unionByName(head), files, "ledes")))
    return x.select("description", "timekeeper", F.floor(F.col("hours") * 100 + 0.5).cast("long").alias("hours_cents"), "matter")


query("src3_ledes_billing", "billing", sql=f"SELECT entry_id AS description, timekeeper, {CENTS.format('hours')} AS hours_cents, matter FROM :billing")(_ledes)


def _ofx(t):
    x = F.concat(F.lit("<STMTTRN><TRNTYPE>X<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000<TRNAMT>"), F.col("amount").cast("string"), F.lit("<NAME>V"), F.col("txn_id").cast("string"), F.lit("<MEMO>memo</STMTTRN>"))
    rows, files = _dealt_out(t, "txn_id", "account")
    rows = rows.select("file", F.col("txn_id").alias("n"), F.concat(F.lit("<ACCTID>"), "account", F.lit("\n"), x).alias("value"))
    got = T.read_ofx(t.sparkSession, _sorted_files(rows, files, "ofx"))
    return got.select("account", F.floor(F.col("amount") * 100 + 0.5).cast("long").alias("cents"), F.to_date("date").alias("day"), "description")


query("src4_ofx_statements", "txn", sql=f"SELECT account, {CENTS.format('amount')} AS cents, CAST(date AS DATE) AS day, 'V' || txn_id || ' - memo' AS description FROM :txn")(_ofx)


def _chat(c):
    form = F.when(F.col("comm_id") % 40 < 20, F.concat(F.lit("["), F.date_format("datetime", "M/d/yyyy, h:mm a"), F.lit("] "), "sender", F.lit(": message "), F.col("comm_id").cast("string"))).otherwise(F.concat(F.date_format("datetime", "M/d/yy, HH:mm"), F.lit(" - "), "sender", F.lit(": message "), F.col("comm_id").cast("string"), F.lit("\ncontinued")))
    rows = _spread(c, "comm_id").select("file", F.col("comm_id").alias("n"), form.alias("value"))
    return T.read_chat(c.sparkSession, _written(rows, "chat")).select("sender", "recipient", "datetime", "content_preview")


query("src5_chat_export", "comm", sql="SELECT sender, 'Group' AS recipient, date_trunc('minute', datetime) AS datetime, 'message ' || comm_id AS content_preview FROM :comm")(_chat)


def _blocks(b):
    """Lines read back, with the document that the last heading of level 1 in their file names."""
    lines = b.select("doc_id", F.struct("doc_id", "pos").alias("n"), F.when(F.col("text") == "ARTICLE IV", "## ARTICLE IV").otherwise(F.col("text")).alias("value"))
    heads = b.select("doc_id").distinct().select("doc_id", F.struct("doc_id", F.lit(None).cast("long").alias("pos")).alias("n"), F.concat(F.lit("# "), F.col("doc_id").cast("string")).alias("value"))
    got = T.read_text_blocks(b.sparkSession, _written(_spread(lines.unionByName(heads), "doc_id"), "text"))
    ahead = Window.partitionBy("file").orderBy("pos")
    return got.withColumn("doc_id", F.last(F.when(F.col("level") == 1, F.col("text").cast("long")), ignorenulls=True).over(ahead)).filter("level <> 1")


def _headings(got):
    return got.agg(F.count("*").alias("lines"), F.count(F.when((F.col("level") == 2) & (F.col("text") == "ARTICLE IV"), 1)).alias("headings"))


@query("src11_text_blocks", "block", sql="SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (WHERE text = 'ARTICLE IV')::BIGINT AS headings FROM :block GROUP BY 1")
def blocks(b):
    return _headings(_blocks(b).groupBy("doc_id"))


def _json_intake(i):
    path = _folder(i, "json")
    rows = _spread(i, "client_id")
    rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("client_id", "name"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return T.read_intake_json(i.sparkSession, path).select("text")


query("src12_json_intake", "intake", sql="SELECT 'client_id: ' || client_id || chr(10) || 'name: ' || name AS text FROM :intake")(_json_intake)


_SAFE = r"regexp_replace({}, '([,;\\\\])', '\\\\\\1', 'g')".replace("\\\\", "\\")
_RULES = ", ".join("({}, {}, {}, '{}')".format(i, k, n, x[4].replace("'", "''")) for i, j in enumerate(PLACES) for k, e in enumerate(C.FEDERAL_CHAINS) for n, x in enumerate(C.STATE_CHAINS.get((j, e), C.FEDERAL_CHAINS[e])))
_EVENTS = f"""WITH {CAL}, {RANK}, {STEPS}, dl AS ({DUE}), ru AS (SELECT * FROM (VALUES {_RULES}) rr(j, e, step, rule))
SELECT request_id, array_to_string(['BEGIN:VEVENT', 'UID:' || request_id || '-' || dl.step, 'DTSTART;VALUE=DATE:' || strftime(due, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(due + 1, '%Y%m%d'), 'SUMMARY:' || {_SAFE.format('name')}, 'DESCRIPTION:' || {_SAFE.format('rule')}, 'BEGIN:VALARM', 'TRIGGER:-P2D', 'ACTION:DISPLAY', 'DESCRIPTION:' || {_SAFE.format('name')}, 'END:VALARM', 'END:VEVENT'], chr(13) || chr(10)) AS value
FROM dl JOIN ru ON ru.j = request_id % 7 AND ru.e = request_id % 5 AND ru.step = dl.step"""


@query("snk6_calendar_events", "txn", sql=_EVENTS)
def calendar(t):
    s = t.sparkSession
    return S.calendar_events(C.deadlines(_requests(t), C.calendar_of(t, "date"), C.chains(s), C.service_days(s)))


@query("snk7_win11_chunk_ids", "block", sql="SELECT pos, row_number() OVER (ORDER BY doc_id, pos)::BIGINT AS global_id FROM :block")
def chunk_ids(b):
    return S.global_chunk_ids(b, "doc_id", "pos").select("pos", F.col("global_id").cast("long").alias("global_id"))


@query("snk7_chunk_files", "block", sql="SELECT doc_id, count(*)::BIGINT AS chunks, sum(length(text) // 4)::BIGINT AS tokens, min(g)::BIGINT AS first_id, max(g)::BIGINT AS last_id FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, pos) AS g FROM :block) q GROUP BY 1")
def chunk_files(b):
    """Chunks and their metadata are written as files; the metadata are read back."""
    path = _folder(b, "chunks")
    chunks = b.select("doc_id", F.col("pos").alias("chunk"), "text")
    S.write_chunks(chunks, path)
    return b.sparkSession.read.schema("doc_id long, chunks long, tokens long, first_id long, last_id long").json(f"{path}/metadata")


@query("set1_union_sources", "billing", "txn", sql="SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'billing' AS kind FROM :billing UNION ALL SELECT 'txn' FROM :txn) q GROUP BY 1")
def union(b, t):
    return T.union_all([b.select(F.lit("billing").alias("kind"), "entry_id"), t.select(F.lit("txn").alias("kind"), "account")]).groupBy("kind").agg(F.count("*").alias("n"))


@query("set5_ordered_distinct", "intake", sql="SELECT client_id, name || '|' || jurisdiction AS names FROM :intake")
def distinct(i):
    return i.select("client_id", F.array_join(F.array_distinct(F.array("name", "jurisdiction", "name")), "|").alias("names"))


@query("snk1_json_report", "txn", sql="SELECT category, count(*)::BIGINT AS n FROM :txn GROUP BY 1")
def report(t):
    path = _folder(t, "report")
    S.write_report(t.groupBy("category").agg(F.count("*").alias("n")), path)
    return t.sparkSession.read.schema("category string, n bigint").json(path)


@query("snk2_sorted_table", "txn", sql="SELECT txn_id, amount FROM :txn")
def sorted_table(t):
    path = _folder(t, "sorted")
    S.write_sorted(t.select("txn_id", "amount"), path, F.col("amount").desc(), "txn_id")
    return t.sparkSession.read.parquet(path)
