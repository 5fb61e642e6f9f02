"""Driver-side helpers: finding a file by candidate paths, status records of long jobs, format dispatch."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from docketlake.sources import files, tables


def resolve(name: str, folders: list[str]) -> Path | None:
    """First existing path among the name itself, its expansion, and the name in each folder, each tried once."""
    tried: dict[str, None] = {}
    base = os.path.basename(name)
    for p in [name, os.path.expanduser(name), *[os.path.join(f, x) for f in folders for x in (name, base)]]:
        tried.setdefault(os.path.abspath(p))
    return next((Path(p) for p in tried if os.path.exists(p)), None)


def write_status(path: str, **fields) -> None:
    """Replace a status record in one step, so that readers never see half of it."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(fields | {"updated": time.time()}, f)
    os.replace(name, path)


def read_any(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(kind, rows as strings) of a tabular file, by its name and first line."""
    head = spark.read.text(path).limit(1).collect()
    kind = tables.sniff(head[0][0] if head else "", path)
    readers = {"csv": tables.read_csv, "ledes": tables.read_ledes, "ofx": tables.read_ofx, "chat": tables.read_chat, "xlsx": files.read_xlsx, "text": tables.read_text_blocks, "json": tables.read_intake_json, "eml": files.read_eml, "mbox": files.read_mbox, "docx": files.read_docx}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    return kind, readers[kind](spark, path)
