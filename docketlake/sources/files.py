"""Sources of binary and mail files as Python data sources and byte parsers. Only the standard library is
used; readers that need more (PDF) are hooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.scan import before, placed
from docketlake.functions.scratch import Steps

MAIL_SCHEMA = (
    "source_file string, email_idx bigint, message_id string, date string, sender string, recipients string, cc string, bcc string, subject string, body string, in_reply_to string, refs string, "
    "attachments array<struct<filename: string, size: bigint, type: string>>"
)


def binary(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)


def _body(msg) -> str:
    """Plain parts that are no attachments, joined by line ends; without any, the text of the HTML parts."""
    def parts(kind: str) -> list[str]:
        return [p.get_content() for p in msg.walk() if p.get_content_type() == kind and p.get_content_disposition() != "attachment"]

    plain = parts("text/plain")
    if plain:
        return "\n".join(plain)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", "\n".join(parts("text/html")))).strip()


def _attached(msg) -> list:
    return [p for p in msg.walk() if p.get_content_disposition() == "attachment" or p.get_filename()]


def _mail_row(name: str, index: int, msg) -> tuple:
    files = [(re.sub(r"[^\w.\- ]", "_", p.get_filename() or "attachment"), len(p.get_payload(decode=True) or b""), p.get_content_type()) for p in _attached(msg)]
    h = lambda k: str(msg[k]) if msg[k] is not None else None
    return (name, index, h("Message-ID"), h("Date"), h("From"), h("To"), h("Cc"), h("Bcc"), h("Subject"), _body(msg), h("In-Reply-To"), h("References"), files)


def parse_eml(name: str, data: bytes) -> list[tuple]:
    import email
    from email import policy

    return [_mail_row(name, 0, email.message_from_bytes(data, policy=policy.default))]


def parse_mbox(name: str, data: bytes) -> list[tuple]:
    """Messages begin at lines that start with ``From `` after a blank line."""
    import email
    from email import policy

    parts = re.split(rb"(?m)(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", data)
    return [_mail_row(name, i, email.message_from_bytes(re.sub(rb"(?m)^>From ", b"From ", p), policy=policy.default)) for i, p in enumerate(x for x in parts if x.strip())]


class Compound:
    """Streams of a compound file (the container of Outlook messages), by path of names."""

    def __init__(self, data: bytes):
        import struct

        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("no compound file")
        u32 = lambda at: struct.unpack_from("<I", data, at)[0]
        self.data, self.size, self.mini_size = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        fat_sectors = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
        at, left = u32(68), u32(72)
        while at < 0xFFFFFFFA and left:  # the list of table sectors goes on in sectors of its own
            more = struct.unpack(f"<{self.size // 4}I", self._sector(at))
            fat_sectors += [x for x in more[:-1] if x < 0xFFFFFFFA]
            at, left = more[-1], left - 1
        table = b"".join(map(self._sector, fat_sectors))
        self.fat = struct.unpack(f"<{len(table) // 4}I", table)
        mini = self._chain(u32(60))
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.cutoff = u32(56)
        listed = self._chain(u32(48))
        entries = [listed[i : i + 128] for i in range(0, len(listed), 128)]
        self.mini = self._chain(struct.unpack_from("<I", entries[0], 116)[0])
        self.streams: dict[str, bytes] = {}
        todo, seen = [(struct.unpack_from("<I", entries[0], 76)[0], "")], set()
        while todo:
            i, path = todo.pop()
            if i >= len(entries) or i in seen:
                continue
            seen.add(i)
            e = entries[i]
            name = path + e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            before, after, child, start = *struct.unpack_from("<III", e, 68), struct.unpack_from("<I", e, 116)[0]
            todo += [(before, path), (after, path)]
            if e[66] == 1:
                todo.append((child, name + "/"))
            elif e[66] == 2:
                n = struct.unpack_from("<I", e, 120)[0]
                self.streams[name] = (self._chain(start) if n >= self.cutoff else self._mini_chain(start))[:n]

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    def _walk(self, start: int, table) -> Iterator[int]:
        for _ in range(len(table)):  # a chain that runs in a circle ends
            if start >= len(table):
                return
            yield start
            start = table[start]

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._walk(start, self.fat)))

    def _mini_chain(self, start: int) -> bytes:
        return b"".join(self.mini[i * self.mini_size : (i + 1) * self.mini_size] for i in self._walk(start, self.mini_fat))

    def text(self, prefix: str, tag: str) -> str | None:
        """A string property, wide or narrow."""
        wide, narrow = self.streams.get(f"{prefix}__substg1.0_{tag}001F"), self.streams.get(f"{prefix}__substg1.0_{tag}001E")
        found = wide.decode("utf-16-le", "replace") if wide is not None else narrow.decode("cp1252", "replace") if narrow is not None else None
        return found.rstrip("\0") if found is not None else None


def parse_msg(name: str, data: bytes) -> list[tuple]:
    """Outlook messages as mail rows. Where the transport's headers are kept, ids and date come from them."""
    import datetime as dt
    import email
    import struct
    from email import policy
    from email.utils import format_datetime

    f = Compound(data)
    head = email.message_from_string(f.text("", "007D") or "", policy=policy.default)
    given = lambda k: str(head[k]) if head[k] is not None else None
    date = given("Date")
    if date is None:
        fixed = f.streams.get("__properties_version1.0", b"")
        for at in range(32, len(fixed) - 15, 16):
            if struct.unpack_from("<I", fixed, at)[0] == 0x00390040:  # time of sending, in tenths of microseconds since 1601
                micros = struct.unpack_from("<Q", fixed, at + 8)[0] // 10
                date = format_datetime(dt.datetime(1601, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros))
    who, address = f.text("", "0C1A"), f.text("", "5D01") or f.text("", "0C1F")
    sender = given("From") or (f"{who} <{address}>" if who and address else who or address)
    body = f.text("", "1000")
    if not body:
        rich = f.text("", "1013") or f.streams.get("__substg1.0_10130102", b"").decode("utf-8", "replace")
        body = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", rich)).strip()
    files = []
    for box in sorted({k.split("/")[0] for k in f.streams if k.startswith("__attach_version1.0_")}):
        own = f.text(box + "/", "3707") or f.text(box + "/", "3704") or "attachment"
        files.append((re.sub(r"[^\w.\- ]", "_", own), len(f.streams.get(f"{box}/__substg1.0_37010102", b"")), f.text(box + "/", "370E") or "application/octet-stream"))
    return [(name, 0, given("Message-ID") or f.text("", "1035"), date, sender, given("To") or f.text("", "0E04"), given("Cc") or f.text("", "0E03"), f.text("", "0E02"), f.text("", "0037"), body, given("In-Reply-To") or f.text("", "1042"), given("References") or f.text("", "1039"), files)]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_docx(name: str, data: bytes) -> list[tuple]:
    """(file, pos, text, level): paragraphs with heading level, and tables as rows of cells."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            out.append((text_of(e), int(m[1]) if m else 0))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(text_of(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("[TABLE]\n" + "\n".join(rows) + "\n[/TABLE]", 0))
    return [(name, i, t, lv) for i, (t, lv) in enumerate(out)]


def parse_xlsx(name: str, data: bytes) -> list[tuple]:
    """(file, line, cells) of the first sheet; cells are strings, gaps are null."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    sheet = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))[0]
    out = []
    # rows are forgotten as they are read, so the sheet is never one tree
    for _, row in ElementTree.iterparse(z.open(sheet)):
        if row.tag != f"{_S}row":
            continue
        cells: list[str | None] = []
        for c in row.iter(f"{_S}c"):
            col = 0
            for ch in re.match(r"[A-Z]*", c.get("r", "")).group(0):
                col = col * 26 + ord(ch) - 64
            while len(cells) < (col or len(cells) + 1) - 1:
                cells.append(None)
            v = c.find(f"{_S}v")
            if c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
            elif v is None or v.text is None:
                cells.append(None)
            else:
                cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
        out.append((name, len(out), cells))
        row.clear()
    return out


#: Rows of parsed files that are handed on at once.
ROWS_AT_ONCE = 1000


def parsed(files: DataFrame, parse: Callable[[str, bytes], list[tuple]], schema: str, path: bool = False) -> DataFrame:
    """Rows of ``parse`` over binary files (path, content), and ``_error`` for files that it fails on; with ``path``,
    the file's ``_path`` too, as names may come twice."""
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*names, "_error", *["_path"] * path]).astype({n: "Int64" for n in names if f"{n} bigint" in schema})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[tuple] = []
            for place, content in zip(b["path"], b["content"]):
                name, own = place.rsplit("/", 1)[-1], [place] * path
                try:
                    held += [(*r, None, *own) for r in parse(name, bytes(content))]
                except Exception as e:  # one bad file does not end the job: it is reported as a row
                    held.append((name, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}", *own))
                if len(held) >= ROWS_AT_ONCE:
                    for at in range(0, len(held), ROWS_AT_ONCE):
                        yield frame(held[at : at + ROWS_AT_ONCE])
                    held = []
            if held:
                yield frame(held)

    return files.select("path", "content").mapInPandas(run, f"{schema}, _error string" + ", _path string" * path)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binary(spark, path, "*.eml"), parse_eml, MAIL_SCHEMA)


def parse_numbered(name: str, data: bytes) -> list[tuple]:
    """One message of a mailbox; its number stands before the mailbox's name."""
    import email
    from email import policy

    number, _, file = name.partition(" ")
    return [_mail_row(file, int(number), email.message_from_bytes(re.sub(rb"(?m)^>From ", b"From ", data), policy=policy.default))]


def mailbox_parts(spark: SparkSession, path: str, pattern: str = "*.mbox") -> DataFrame:
    """(path, file, email_idx, content): the messages of mailboxes of any size, numbered from 0 within their file.

    Mailboxes are read as lines, so a large one is split among tasks; a message starts at a line that begins with
    ``From `` after a blank line or at the top. A message is put together by one task, a mailbox is not. Messages
    of nothing but white space don't count.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")
    rows = placed(lines, "line")
    rows = before(rows, ["path"], ["line"], blank=("last", F.col("value").isin("", "\r")))
    starts = F.col("value").startswith("From ") & F.coalesce("blank", F.lit(True))
    rows = before(rows.withColumn("start", starts.cast("long")), ["path"], ["line"], part=("sum", F.col("start")))
    rows = rows.withColumn("part", F.col("part") + F.col("start")).filter("start = 0")
    whole = rows.groupBy("path", "file", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.concat("value", F.lit("\n")).alias("v")))), lambda x: x["v"]), "").alias("text"))
    whole = Steps(spark).keep(whole.filter(F.col("text").rlike(r"\S")))
    numbers = before(whole.select("path", "part"), ["path"], ["part"], email_idx=("sum", F.lit(1).cast("long")))
    return whole.join(numbers, ["path", "part"]).select("path", "file", "email_idx", F.col("text").cast("binary").alias("content"))


def read_mbox(spark: SparkSession, path: str, pattern: str = "*.mbox") -> DataFrame:
    """Mails of mailboxes of any size, see :func:`mailbox_parts`."""
    parts = mailbox_parts(spark, path, pattern).select(F.concat_ws(" ", F.col("email_idx").cast("string"), "file").alias("path"), "content")
    return parsed(parts, parse_numbered, MAIL_SCHEMA)


def read_msg(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binary(spark, path, "*.msg"), parse_msg, MAIL_SCHEMA)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binary(spark, path, "*.docx"), parse_docx, "file string, pos bigint, text string, level bigint")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Strings by header, each file by the header in its own first row: the columns are those of all files, null where a
    file has none of the name; of equal headers of a file the first counts. A workbook that can't be read gives a row with
    ``_error`` and nothing else, which the canonical tables leave out."""
    rows = Steps(spark).keep(parsed(binary(spark, path, "*.xlsx"), parse_xlsx, "file string, line bigint, cells array<string>", path=True))
    head = F.transform("cells", lambda c, i: F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit("column_"), i.cast("string"))))
    heads = rows.filter("line = 0").select("_path", head.alias("head"))
    # columns are one whatever the case of their names
    spelt = heads.select(F.posexplode("head").alias("i", "name")).groupBy(F.lower("name").alias("k")).agg(F.min("i").alias("i"), F.min("name").alias("name"))
    names = [(r["name"], r["k"]) for r in spelt.orderBy("i", "k").collect()]
    heads = heads.withColumn("head", F.transform("head", F.lower))
    named = F.filter(F.arrays_zip(F.col("head").alias("k"), F.slice("cells", F.lit(1), F.size("head")).alias("v")), lambda e, i: F.array_position("head", e["k"]) == i + 1)
    body = rows.filter("line > 0").join(heads, "_path").withColumn("m", F.map_from_entries(named))
    own = lambda df, value: df.select(*[value(k).alias(n) for n, k in names], F.col("file").alias("_source_file"), F.col("line").alias("_line"), "_error")
    return own(body, lambda k: F.try_element_at("m", F.lit(k))).unionByName(own(rows.filter("_error is not null"), lambda k: F.lit(None).cast("string")))


def read_with(spark: SparkSession, path: str, pattern: str, extractors: list[Callable[[bytes], str]], least: int = 100) -> DataFrame:
    """:func:`extracted` of the files of a folder."""
    return extracted(binary(spark, path, pattern), extractors, least)


def extracted(files: DataFrame, extractors: list[Callable[[bytes], str]], least: int = 100) -> DataFrame:
    """(file, text) by the first of several extractors that gives more than ``least`` characters; for PDF and
    other formats whose readers are installed on the cluster."""

    def parse(name: str, data: bytes) -> list[tuple]:
        best = ""
        for f in extractors:
            best = max(best, f(data) or "", key=len)
            if len(best) > least:
                break
        return [(name, best)]

    return parsed(files, parse, "file string, text string")


def parse_attachments(name: str, data: bytes) -> list[tuple]:
    """(source_file, email_idx, filename, type, content) of the attachments of a mail file or mailbox; of equal names
    in a file the later ones get a number before their ending."""
    import email
    from email import policy

    mails = re.split(rb"(?m)(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", data) if name.lower().endswith(".mbox") else [data]
    out: list[tuple] = []
    taken: set[str] = set()
    for i, part in enumerate(x for x in mails if x.strip()):
        for p in _attached(email.message_from_bytes(part, policy=policy.default)):
            plain = re.sub(r"[^\w.\- ]", "_", p.get_filename() or "attachment")
            stem, dot, end = plain.rpartition(".")
            own, k = plain, 0
            while own in taken:
                k += 1
                own = f"{stem}_{k}.{end}" if dot else f"{plain}_{k}"
            taken.add(own)
            out.append((name, i, own, p.get_content_type(), p.get_payload(decode=True) or b""))
    return out


def read_attachments(spark: SparkSession, path: str, pattern: str = "*.{eml,mbox}") -> DataFrame:
    return parsed(binary(spark, path, pattern), parse_attachments, "source_file string, email_idx bigint, filename string, type string, content binary")


# Tags of the EXIF standard that are read, by directory.
EXIF_TAGS = {
    "image": {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0131: "software", 0x0132: "date"},
    "exif": {0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "date_original"},
    "gps": {0x0001: "gps_lat_ref", 0x0002: "gps_lat", 0x0003: "gps_lon_ref", 0x0004: "gps_lon", 0x0006: "gps_altitude"},
}


def exif_tags(data: bytes) -> dict[str, str]:
    """Tags of a JPEG's EXIF block; none if there is no such block or it is broken. Rational numbers are written as
    decimals, several values with commas."""
    import struct

    at = 2
    block = b""
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            block = data[at + 10 : at + 2 + size]
            break
        at += 2 + size
    if block[:2] not in (b"II", b"MM"):
        return {}
    e = "<" if block[:2] == b"II" else ">"
    sizes, codes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}, {1: "B", 3: "H", 4: "I", 9: "i"}
    out: dict[str, str] = {}
    todo, seen = [(struct.unpack_from(e + "I", block, 4)[0], "image")] if len(block) >= 8 else [], set()
    while todo:
        start, kind = todo.pop()
        if start in seen or start + 2 > len(block):
            continue
        seen.add(start)
        for i in range(struct.unpack_from(e + "H", block, start)[0]):
            p = start + 2 + 12 * i
            if p + 12 > len(block):
                break
            tag, form, n = struct.unpack_from(e + "HHI", block, p)
            if tag in (0x8769, 0x8825):
                todo.append((struct.unpack_from(e + "I", block, p + 8)[0], "exif" if tag == 0x8769 else "gps"))
                continue
            name, length = EXIF_TAGS[kind].get(tag), sizes.get(form, 0) * n
            place = p + 8 if length <= 4 else struct.unpack_from(e + "I", block, p + 8)[0]
            if name is None or not length or place + length > len(block):
                continue
            if form in (2, 7):
                value = block[place : place + length].split(b"\0")[0].decode("latin-1").strip()
            elif form in (5, 10):
                pairs = [struct.unpack_from(e + ("II" if form == 5 else "ii"), block, place + 8 * k) for k in range(n)]
                value = ",".join(f"{a / b:.10g}" if b else "0" for a, b in pairs)
            else:
                value = ",".join(map(str, struct.unpack_from(f"{e}{n}{codes[form]}", block, place)))
            out[name] = value
    return out


def read_images(spark: SparkSession, path: str, readers: list[Callable[[bytes], dict]] | None = None) -> DataFrame:
    """:func:`image_records` of the files of a folder."""
    return image_records(binary(spark, path), readers)


def image_records(files: DataFrame, readers: list[Callable[[bytes], dict]] | None = None) -> DataFrame:
    """(path, size, modified, md5, sha256, exif): hashes by Spark; tags by the first reader (the library's own unless
    others are given), gaps filled by the ones after it. A reader that fails on a file gives nothing for it."""
    use = readers or [exif_tags]

    @F.pandas_udf("map<string,string>")
    def tags(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> dict[str, str]:
            out: dict[str, str] = {}
            for read in use:
                try:
                    found = read(bytes(b)) or {}
                except Exception:  # a broken image has no tags of this reader
                    found = {}
                out = {str(k): str(v) for k, v in found.items() if v is not None} | out
            return out

        return content.map(one)

    df = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), "content")
    return df.withColumn("exif", tags("content")).drop("content")
