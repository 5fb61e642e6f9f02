"""E-mail: content hashes, duplicates, threads, privilege, the mail network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.core import first_match, lower_by_letter, numbered, strip
from docketlake.operators.graph import components

# Phrases that mark privileged mail, in the order in which they are tried.
PRIVILEGE = [
    "privileged", "attorney-client", "attorney client", "work product", "legal advice", "counsel",
    "confidential communication", "litigation hold", "attorney work product", "protected communication",
]


def content_hash(body: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the body with white space collapsed, trimmed, lowered."""
    return F.substring(F.sha2(F.regexp_replace(lower_by_letter(strip(F.coalesce(body, F.lit("")))), r"\s+", " "), 256), 1, 16)


def message_id(raw: Column, index: Column, source: Column) -> Column:
    """The given id, or one made of index and source."""
    return F.when(raw.isNull() | (raw == ""), F.concat(F.lit("<generated-"), index.cast("string"), F.lit("-"), F.substring(F.md5(source), 1, 8), F.lit(">"))).otherwise(raw)


def duplicates(mail: DataFrame, empty_bodies: bool = False) -> DataFrame:
    """``mail`` with ``duplicate_of``: the earliest mail with the same id, else with the same body. Earliest
    rows are found by aggregation, so a body sent a million times is one row of the small side. Empty
    bodies are alike only if ``empty_bodies``."""
    rows = mail.withColumn("_h", content_hash(F.col("body")))
    by_id = rows.groupBy(F.col("message_id").alias("_m")).agg(F.min("email_idx").alias("_first_id"))
    bodies = rows if empty_bodies else rows.filter(strip(F.coalesce("body", F.lit(""))) != "")
    # a mail that repeats an id is no original of a body
    originals = bodies.join(by_id, bodies["message_id"] == F.col("_m")).filter(F.col("email_idx") == F.col("_first_id"))
    by_body = originals.groupBy(F.col("_h").alias("_b")).agg(F.min("email_idx").alias("_first_body"))
    out = rows.join(by_id, rows["message_id"] == F.col("_m"), "left").join(by_body, F.col("_h") == F.col("_b"), "left")
    dup = F.when(F.col("_first_id") < F.col("email_idx"), F.col("_first_id")).when(F.col("_first_body") < F.col("email_idx"), F.col("_first_body"))
    return out.withColumn("duplicate_of", dup).withColumn("content_hash", F.col("_h")).drop("_h", "_m", "_b", "_first_id", "_first_body")


def addresses(raw: Column) -> Column:
    """Lower-cased addresses of a list such as ``A <a@x.org>, b@y.org``."""
    return F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"[\w.+%-]+@[\w.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower)


def names(raw: Column) -> Column:
    """(name, address) of each entry of an address list."""
    entries = F.filter(F.split(F.coalesce(raw, F.lit("")), r",(?=[^>]*(?:<|$))"), lambda e: e.contains("@"))
    return F.transform(entries, lambda e: F.struct(strip(F.regexp_replace(e, r"<[^>]*>|[\w.+%-]+@[\w.-]+|\"", "")).alias("name"), F.lower(F.regexp_extract(e, r"[\w.+%-]+@[\w.-]+", 0)).alias("address")))


def threads(mail: DataFrame) -> DataFrame:
    """(email_idx, thread, thread_id): mails joined by message ids, In-Reply-To and the ids of ``refs``
    (References) if there is such a column; a thread is named by the first mail's index, and ``thread_id`` numbers
    threads in that order as thread_0001. Threads that one mail connects are one."""
    bare = lambda c: F.regexp_replace(c, r"^\s*<|>\s*$", "")
    ids = F.array(bare(F.col("message_id")), bare(F.col("in_reply_to")))
    if "refs" in mail.columns:
        # ids in brackets, and bare words with an @
        listed = F.split(F.regexp_replace(F.coalesce("refs", F.lit("")), r"[<>\s]+", " "), " ")
        ids = F.concat(ids, F.filter(listed, lambda x: x.contains("@")))
    own = mail.select("email_idx", F.explode(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))).alias("ref"))
    # the first mail of each id stands for it; ids link mails without pairs of mails
    firsts = own.groupBy("ref").agg(F.min("email_idx").alias("first"))
    links = own.join(firsts, "ref").filter("email_idx <> first").select(F.col("first").alias("src"), F.col("email_idx").alias("dst"), F.lit(1).alias("weight"))
    comp = components(links)
    out = mail.select("email_idx").join(comp.select(F.col("node").alias("email_idx"), "component"), "email_idx", "left").select("email_idx", F.coalesce("component", "email_idx").alias("thread"))
    named = numbered(out.select("thread").distinct(), "thread", "_no")
    return out.join(named, "thread").select("email_idx", "thread", F.concat(F.lit("thread_"), F.when(F.col("_no") < 10_000, F.lpad(F.col("_no").cast("string"), 4, "0")).otherwise(F.col("_no").cast("string"))).alias("thread_id"))


def thread_summary(mail: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per thread: mails, first and last date, subject of its first mail by date."""
    rows = mail.join(grouped, "email_idx")
    return rows.groupBy("thread_id").agg(F.count(F.lit(1)).alias("mails"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("subject", F.struct("date", "email_idx")).alias("subject"))


def format_counts(files: DataFrame) -> DataFrame:
    """Mails per kind of file, by the ending of ``source_file``."""
    kind = F.lower(F.regexp_extract(F.coalesce("source_file", F.lit("")), r"\.([^.]+)$", 1))
    return files.groupBy(F.when(kind == "", "unknown").otherwise(kind).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def privilege(mail: DataFrame, attorneys: list[str] = (), domains: list[str] = ()) -> DataFrame:
    """Mails with up to three reasons: first phrase, first attorney's name, first domain."""
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    addrs = F.lower(F.concat_ws(" ", F.coalesce("sender", F.lit("")), F.coalesce("recipients", F.lit(""))))
    word = first_match(text, PRIVILEGE)
    name = first_match(F.concat_ws(" ", addrs, text), [a.strip().lower() for a in attorneys if a.strip()])
    domain = first_match(addrs, [d.strip().lower() for d in domains if d.strip()])
    reasons = F.concat_ws("; ", F.concat(F.lit("Keyword: '"), word, F.lit("'")), F.concat(F.lit("Attorney name: '"), name, F.lit("'")), F.concat(F.lit("Privileged domain: '"), domain, F.lit("'")))
    return mail.withColumn("reasons", reasons).filter(F.col("reasons") != "")


def network(mail: DataFrame) -> DataFrame:
    """Directed edges from sender to each recipient, self-mail left out."""
    e = mail.select("email_idx", F.explode(addresses(F.col("sender"))).alias("src"), addresses(F.col("recipients")).alias("_to")).select("email_idx", "src", F.explode("_to").alias("dst"))
    return e.filter("src <> dst").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def strip_html(body: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"\s+", " "))
