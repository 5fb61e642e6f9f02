"""Sinks: reports, tables, calendars, chunk files."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scan import before


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sorted(df: DataFrame, path: str, *order, fmt: str = "parquet") -> None:
    """Globally ordered files, by range partitions."""
    df.orderBy(*order).write.mode("overwrite").format(fmt).option("header", True).save(path)


def calendar_events(deadlines: DataFrame, alarm_days: int = 2) -> DataFrame:
    """(request_id, value): one iCalendar event per deadline (request_id, step, name, due, rule). A deadline
    without a date keeps its row, with a null value: no event can stand for it."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([,;\\])", r"\\$1")
    value = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("request_id").cast("string"), F.lit("-"), F.col("step").cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("due", "yyyyMMdd")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add("due", 1), "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), safe(F.col("name"))), F.concat(F.lit("DESCRIPTION:"), safe(F.col("rule"))), F.lit("BEGIN:VALARM"), F.lit(f"TRIGGER:-P{alarm_days}D"), F.lit("ACTION:DISPLAY"), F.concat(F.lit("DESCRIPTION:"), safe(F.col("name"))), F.lit("END:VALARM"), F.lit("END:VEVENT"))
    return deadlines.select("request_id", F.when(F.col("due").isNotNull(), value).alias("value"))


def write_calendars(deadlines: DataFrame, path: str) -> None:
    """Calendars in the order of their requests, many in a file, which an iCalendar stream may hold; each task writes one
    file, and a task that fails leaves none."""
    events = calendar_events(deadlines).groupBy("request_id").agg(F.array_join(F.sort_array(F.collect_list("value")), "\r\n").alias("e"))
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//docketlake//deadlines//EN\r\n"), F.col("e"), F.lit("\r\nEND:VCALENDAR"))
    rows = events.select("request_id", text.alias("value")).repartitionByRange("request_id").sortWithinPartitions("request_id")
    rows.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def workbook_bytes(rows: list[Sequence[str | None]]) -> bytes:
    """A workbook of one sheet: strings in line, numbers as numbers, gaps left out."""
    import io
    import re
    import zipfile
    from xml.sax.saxutils import escape

    def letters(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(r: int, c: int, v: str | None) -> str:
        if v is None:
            return ""
        if re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?", v):
            return f'<c r="{letters(c)}{r}"><v>{v}</v></c>'
        return f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


#: Rows that a sheet can have, its header counted.
SHEET_ROWS = 1_048_576


def workbooks(df: DataFrame, key: str, *order, rows: int = SHEET_ROWS - 1) -> DataFrame:
    """(path, content): a workbook per value of ``key`` and ``rows`` rows, in ``order``, with the columns' names as first
    row; each is made by one task, which the size of a sheet bounds."""
    cols = [c for c in df.columns if c != key]
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    cells = df.withColumn("_key", F.col(key).cast("string")).withColumn("_k", place).select("_key", "_k", *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cols)])

    def book(table: pa.Table) -> pa.Table:
        # a workbook at a time comes to the worker, as columns
        table = table.sort_by("_k")
        data = [table.column(f"_c{i}").to_pylist() for i in range(len(cols))]
        path = f"{table.column('_key')[0].as_py() or ''}-{table.column('_part')[0].as_py()}.xlsx"
        return pa.table({"path": [path], "content": pa.array([workbook_bytes([cols, *zip(*data)])], pa.binary())})

    part = F.floor((F.col("_k") - 1) / rows).cast("int")
    return cells.withColumn("_part", part).groupBy("_key", "_part").applyInArrow(book, "path string, content binary")


def write_workbook(df: DataFrame, path: str, *order) -> None:
    """One workbook of a report in ``order``; more rows than a sheet has are refused."""
    n = df.limit(SHEET_ROWS).count()
    if n >= SHEET_ROWS:
        raise ValueError("a sheet takes 1,048,575 rows; use workbooks() or another format")
    content = workbooks(df.withColumn("_all", F.lit("all")), "_all", *order).first()
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(content["content"] if content else bytearray(workbook_bytes([df.columns])))
    out.close()


def global_chunk_ids(chunks: DataFrame, file: str = "doc_id", local: str = "chunk") -> DataFrame:
    """``global_id``: running number over files and local numbers, by a scan over ranges, so that no task holds all chunks
    or all documents."""
    return before(chunks, [], [file, local], _k=("sum", F.lit(1).cast("long"))).withColumn("global_id", F.col("_k") + 1).drop("_k")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, tokens (a quarter of the characters) and the first and last global id."""
    tokens = F.floor(F.length("text") / 4).cast("long")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(tokens).alias("tokens"), F.min("global_id").alias("first_id"), F.max("global_id").alias("last_id"))


def write_chunks(chunks: DataFrame, path: str, rows: int = 100_000) -> None:
    """``chunks/``: chunks in the order of their global ids, at most ``rows`` in a file, many documents a file;
    ``metadata/``: a line per document, with the first and the last file that hold it."""
    numbered = global_chunk_ids(chunks)
    numbered.repartitionByRange("global_id").sortWithinPartitions("global_id").write.mode("overwrite").option("maxRecordsPerFile", rows).json(f"{path}/chunks")
    stored = chunks.sparkSession.read.schema(numbered.schema).json(f"{path}/chunks").withColumn("_file", F.col("_metadata.file_name"))
    files = stored.groupBy("doc_id").agg(F.min_by("_file", "global_id").alias("first_file"), F.max_by("_file", "global_id").alias("last_file"))
    chunk_metadata(stored).join(files, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").json(f"{path}/metadata")


def summary(parts: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """(n, line) of a text summary: each part is a heading and, or no, a frame (place, line) of its lines, which
    come from small aggregates."""
    spark = next(df for _, df in parts if df is not None).sparkSession
    out = spark.createDataFrame([(i, 0, h) for i, (h, _) in enumerate(parts)], "part int, place long, line string")
    for i, (_, df) in enumerate(parts):
        if df is not None:
            out = out.unionByName(df.select(F.lit(i).alias("part"), (F.col("place") + 1).cast("long").alias("place"), "line"))
    return out.select(F.row_number().over(Window.orderBy("part", "place")).cast("long").alias("n"), "line")


def write_text(lines: DataFrame, path: str) -> None:
    """One text file of (n, line), in order."""
    one = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("value"))
    one.write.mode("overwrite").text(path)
