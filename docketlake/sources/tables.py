"""Tabular sources: header aliases, CSV, LEDES, OFX, chat exports, JSON and text. All are lazy DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.functions.core import small, strip
from docketlake.functions.scan import SPLITS, placed, split_starts
from docketlake.functions.scratch import Steps

# Header names by the field that they fill, in order of preference.
BILLING = {
    "date": ["date", "invoice_date", "work_date", "inv_date", "line_item_date", "billing_date", "service_date", "entry_date"],
    "timekeeper": ["timekeeper", "timekeeper_name", "attorney", "lawyer", "tk_name", "biller", "professional", "name"],
    "hours": ["hours", "line_item_hours", "qty", "quantity", "units", "time", "hours_worked", "billable_hours"],
    "rate": ["rate", "line_item_rate", "hourly_rate", "billing_rate", "tk_rate", "unit_price"],
    "amount": ["amount", "line_item_total", "total", "line_amount", "fee_amount", "extended_amount", "line_item_amount", "billed_amount"],
    "description": ["description", "line_item_description", "narrative", "details", "task_description", "work_description", "activity_description", "line_item_narrative"],
    "task_code": ["task_code", "utbms_task", "task"],
    "activity_code": ["activity_code", "utbms_activity", "activity"],
    "matter": ["matter", "matter_id", "matter_name", "client_matter", "case", "case_name", "matter_number"],
}
TRANSACTIONS = {
    "date": ["date", "transaction_date", "trans_date", "posting_date", "post_date", "value_date", "effective_date", "posted_date", "txn_date"],
    "description": ["description", "memo", "narrative", "details", "payee", "name", "transaction_description", "reference", "particulars"],
    "amount": ["amount", "transaction_amount", "value", "sum"],
    "debit": ["debit", "debit_amount", "withdrawal", "withdrawals", "money_out", "outflow"],
    "credit": ["credit", "credit_amount", "deposit", "deposits", "money_in", "inflow"],
    "balance": ["balance", "running_balance", "closing_balance", "available_balance", "ledger_balance"],
    "account": ["account", "account_number", "account_name", "acct", "account_id"],
    "category": ["category", "type", "transaction_type", "tran_type"],
}
COMMUNICATIONS = {
    "sender": ["from", "sender", "from_address", "from_email", "sent_from", "author", "caller", "calling_number", "originator", "source", "sent_by"],
    "recipient": ["to", "recipient", "to_address", "to_email", "sent_to", "receiver", "callee", "called_number", "destination", "target"],
    "datetime": ["date", "datetime", "timestamp", "sent_date", "sent_time", "time", "date_time", "call_date", "call_time", "message_date"],
    "content_preview": ["subject", "content", "message", "body", "text", "snippet", "preview"],
    "type": ["type", "message_type", "communication_type", "channel", "medium", "call_type"],
    "duration": ["duration", "call_duration", "length", "duration_seconds"],
}
#: Where a row comes from, as far as its reader says so.
PLACE = ["_source_file", "_source_path", "_line"]
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd"]


def any_date(c: Column) -> Column:
    """Timestamp by the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)) for f in DATE_FORMATS])


def clean_headers(df: DataFrame) -> DataFrame:
    """Trimmed, lowered, blanks to underscores; of equal names the first keeps it, the rest get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = c.strip().lower().replace(" ", "_")
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return df.toDF(*names)


def by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per field: the first non-null of its aliases; fields without one are null. Rows that stand for a file
    that can't be read are left out."""
    df = clean_headers(df.filter("_error is null").drop("_error") if "_error" in df.columns else df)
    out = []
    for field, names in aliases.items():
        found = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(field))
    keep = [F.col(c) for c in PLACE if c in df.columns]
    return df.select(*out, *keep)


def _number(c: str) -> Column:
    # most are plain numbers, which the pattern leaves as they are
    return F.coalesce(F.col(c).try_cast("double"), F.regexp_replace(F.col(c), r"[$,\s]", "").try_cast("double"))


def billing(df: DataFrame) -> DataFrame:
    x = by_alias(df, BILLING)
    x = x.select(any_date(F.col("date")).alias("date"), F.coalesce("timekeeper", F.lit("Unknown")).alias("timekeeper"), _number("hours").alias("hours"), _number("rate").alias("rate"), _number("amount").alias("amount"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("description", "task_code", "activity_code", "matter")], *[c for c in PLACE if c in x.columns])
    return x.withColumn("amount", F.coalesce("amount", F.col("hours") * F.col("rate")))


def transactions(df: DataFrame) -> DataFrame:
    x = by_alias(df, TRANSACTIONS)
    debit, credit = F.coalesce(_number("debit"), F.lit(0.0)), F.coalesce(_number("credit"), F.lit(0.0))
    parts = F.when(F.col("debit").isNotNull() & F.col("credit").isNotNull(), credit - debit).when(F.col("debit").isNotNull(), -F.abs(debit)).when(F.col("credit").isNotNull(), credit)
    return x.select(any_date(F.col("date")).alias("date"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(_number("amount"), parts).alias("amount"), _number("balance").alias("balance"), F.coalesce("account", F.lit("Unknown")).alias("account"), F.coalesce("category", F.lit("")).alias("category"), *[c for c in PLACE if c in x.columns])


def communications(df: DataFrame) -> DataFrame:
    x = by_alias(df, COMMUNICATIONS)
    return x.select(*[F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("Unknown")).alias(c) for c in ("sender", "recipient")], any_date(F.col("datetime")).alias("datetime"), F.substring(F.coalesce("content_preview", F.lit("")), 1, 500).alias("content_preview"), F.coalesce("type", F.lit("")).alias("type"), _number("duration").alias("duration"), *[c for c in PLACE if c in x.columns])


def _csv(spark: SparkSession, path: str, encoding: str | None, recursive: bool, multi_line: bool) -> DataFrame:
    """CSV rows with their file's name and path, split and id."""
    def read(enc: str) -> DataFrame:
        r = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", enc).option("recursiveFileLookup", recursive).option("multiLine", multi_line).option("escape", '"')
        m = "_metadata."
        return r.csv(path).withColumns({"_source_file": F.col(m + "file_name"), "_source_path": F.col(m + "file_path"), "_split": F.col(m + "file_block_start"), "_id": F.monotonically_increasing_id()})

    if encoding:
        return read(encoding)
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    odd = lines.filter(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("_source_path")).distinct()
    plain = read("UTF-8")
    if odd.isEmpty():
        return plain
    latin = read("ISO-8859-1").join(odd, "_source_path", "left_semi")
    return plain.join(odd, "_source_path", "left_anti").unionByName(latin, allowMissingColumns=True)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, recursive: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV files as strings with ``_source_file``; rows that do not fit are dropped. Without ``encoding``, files
    are read as UTF-8 and those that are not UTF-8 as Latin-1. Files whose quoted fields hold no line breaks are
    split among tasks with ``multi_line`` off."""
    return _csv(spark, path, encoding, recursive, multi_line).drop("_source_path", "_split", "_id")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name, after each part has been brought to its canonical columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, text) of lines, with their split and id for :func:`placed`."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.when(F.col("value").endswith("\r"), F.left("value", F.length("value") - 1)).otherwise(F.col("value")).alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line, text): lines numbered from 0 within their file. Files of the same name in several folders are
    told apart by ``path``."""
    return placed(_split_lines(spark, path), "line").select("path", "file", "line", "text")


def read_ledes(spark: SparkSession, path: str) -> DataFrame:
    """LEDES 1998B: first pipe row of a file is its header; short rows are padded, long ones cut; of equal headers
    the first counts. Where a field stands is looked up once per file, not per row, and no row is shuffled: its split's
    start and its file's header come to it."""
    # rows end in an empty bracket pair, and often in a pipe before it
    rows = _split_lines(spark, path).withColumn("t", strip(F.col("text")))
    holds = (F.col("t") != "") & ~F.upper(F.substring("t", 1, 10)).startswith("LEDES1998B")
    cells = F.split(F.when(F.col("t").endswith("[]"), F.left("t", F.length("t") - 2)).otherwise(F.col("t")), r"\|", -1)
    starts = split_starts(rows, _head=F.min(F.when(holds, F.col("_id"))))
    of_file = starts.filter("_head is not null").groupBy("path").agg(F.min_by(F.struct("_head", (F.col("_base") + F.col("_head") - F.col("_first")).alias("at")), "_split").alias("h"))
    head = rows.join(small(of_file.select("path", F.col("h._head").alias("_id"), F.col("h.at").alias("_from")), SPLITS), ["path", "_id"])
    head = head.select("path", "_from", F.transform(cells, lambda c: F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))).alias("head"))
    wanted = sorted({n for names in BILLING.values() for n in names})
    head = head.select("path", "_from", *[F.nullif(F.array_position("head", n).cast("int"), F.lit(0)).alias(f"_at_{n}") for n in wanted])
    starts = Steps(spark).keep(starts.drop("_head").join(small(head, SPLITS), "path"))
    body = rows.filter(holds).join(small(starts, SPLITS), ["path", "_split"]).withColumn("line", F.col("_base") + F.col("_id") - F.col("_first")).filter("line > _from").withColumn("cells", cells)
    field = lambda n: F.nullif(strip(F.try_element_at("cells", F.col(f"_at_{n}"))), F.lit(""))
    return body.select(*[field(n).alias(n) for n in wanted], F.col("file").alias("_source_file"), F.col("path").alias("_source_path"), F.col("line").cast("long").alias("_line"))


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """Bank statements (OFX, QFX): one row per statement transaction."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), "value")
    tag = lambda c, t: F.nullif(strip(F.regexp_extract(c, rf"(?i)<{t}>([^<\r\n]*)", 1)), F.lit(""))
    account = F.coalesce(tag(F.col("value"), "ACCTID"), F.col("file"))
    # the account is looked for before the transactions become rows: once per file, not in the whole file for each of them
    whole = whole.select("file", account.alias("account"), F.regexp_extract_all("value", F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1)).alias("xs"))
    rows = whole.select("file", "account", F.explode("xs").alias("x"))
    x = F.col("x")
    return rows.select(F.try_to_timestamp(F.substring(tag(x, "DTPOSTED"), 1, 8), F.lit("yyyyMMdd")).alias("date"), F.concat_ws(" - ", tag(x, "NAME"), tag(x, "MEMO")).alias("description"), tag(x, "TRNAMT").try_cast("double").alias("amount"), "account", F.coalesce(tag(x, "TRNTYPE"), F.lit("")).alias("category"), F.col("file").alias("_source_file"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Messenger exports, both line forms; lines without a head are left out."""
    a = r"^\[(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\]\s*([^:]+):\s*(.*)$"
    b = r"^(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\s*-\s*([^:]+):\s*(.*)$"
    rows = _lines(spark, path)
    part = lambda k: F.when(F.col("text").rlike(a), F.regexp_extract("text", a, k)).otherwise(F.regexp_extract("text", b, k))
    at = F.concat_ws(" ", part(1), F.upper(F.regexp_replace(part(2), r"\s+", " ")))
    when = F.coalesce(*[F.try_to_timestamp(at, F.lit(f)) for f in ("M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yy h:mm:ss a", "M/d/yy h:mm a", "M/d/yy H:mm:ss", "M/d/yy H:mm")])
    return rows.filter(F.col("text").rlike(a) | F.col("text").rlike(b)).select(strip(part(3)).alias("sender"), F.lit("Group").alias("recipient"), when.alias("datetime"), F.substring(part(4), 1, 500).alias("content_preview"), F.lit("chat").alias("type"), F.lit(None).cast("double").alias("duration"), F.col("file").alias("_source_file"), F.col("line").cast("long").alias("_line"))


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text, level): lines of text and Markdown files with heading levels."""
    rows = _lines(spark, path)
    marks = F.regexp_extract("text", r"^(#{1,6})\s+\S", 1)
    return rows.select("file", F.col("line").cast("long").alias("pos"), F.regexp_replace("text", r"^#{1,6}\s+", "").alias("text"), F.length(marks).cast("long").alias("level"))


def read_intake_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): objects as ``key: value`` lines."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    pairs = F.from_json(F.to_json(F.struct(*[c for c in df.columns if c != "file"])), "map<string,string>")
    return df.select("file", F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("text"))


def read_intake_clients(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, client, text): the clients of CSV files, numbered from 1 in the order of their file's rows."""
    df = _csv(spark, path, None, True, True)
    df = df.withColumnRenamed("_source_path", "path").withColumnRenamed("_source_file", "file")
    cols = [c for c in df.columns if c not in ("path", "file", "_split", "_id")]
    value = lambda c: F.nullif(strip(F.col(f"`{c}`")), F.lit(""))
    one = F.concat_ws("\n", *[F.when(value(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in cols])
    rows = placed(df.select("path", "file", "_split", "_id", one.alias("text")), "client")
    return rows.select("path", "file", (F.col("client") + 1).cast("long").alias("client"), "text")


def read_intake_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): a file's clients, each under a heading, as one text, in the order of its rows."""
    rows = read_intake_clients(spark, path)
    block = F.concat(F.lit("--- Client "), F.col("client").cast("string"), F.lit(" ---\n"), F.col("text"))
    whole = rows.groupBy("path").agg(F.first("file").alias("file"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("client", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    return whole.select("file", "text")


def read_requests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Deadline requests: a file per request, or a line per request with ``multi_line`` off."""
    schema = "trigger_date date, jurisdiction string, state string, event_type string, service_method string, case_caption string, custom_deadlines array<struct<name: string, days: int, business_days: boolean>>"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


# Kinds of files by their endings.
ENDINGS = {"csv": "csv", "tsv": "csv", "ofx": "ofx", "qfx": "ofx", "xlsx": "xlsx", "xlsm": "xlsx", "eml": "eml", "mbox": "mbox", "docx": "docx", "txt": "text", "md": "text", "json": "json"}
CHAT_LINE = r"^\[?\d{1,2}/\d{1,2}/\d{2,4},"


def kind_of(name: Column, first_line: Column) -> Column:
    """Kind of a file by its first line and, where that tells nothing, by its name's ending."""
    line = strip(F.coalesce(first_line, F.lit("")))
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.when(F.upper(line).startswith("LEDES1998B"), "ledes").when(line.rlike(CHAT_LINE), "chat").otherwise(F.coalesce(F.try_element_at(table, ending), F.lit("unknown")))


def sniff(first_line: str, name: str) -> str:
    """:func:`kind_of` for one file, on the driver."""
    import re

    line = first_line.strip()
    if line.upper().startswith("LEDES1998B"):
        return "ledes"
    if re.match(CHAT_LINE, line):
        return "chat"
    return ENDINGS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "unknown")
