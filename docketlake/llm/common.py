"""Shared helpers: table access, scratch tables in the shared checkpoint folder, word rules.

Python functions over texts rely on Spark's bound of 64 MB for an Arrow batch
(``spark.sql.execution.arrow.maxBytesPerBatch``), which holds whatever the number of rows.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the plain rule: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words of the alphanumeric rule (applied after A-Z is lowered).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that a Python function gets, and rows that it hands on, at once.
TEXTS, SLICE = 1000, 500


def give_back() -> None:
    """Memory that this process holds but does not use goes back to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps its own ways
        pass


def lean(run: Callable) -> Callable:
    """``run`` (for mapInPandas) with its frames handed on in slices of ``SLICE`` rows, and its memory given back when
    a partition is done: Python workers wait for their next task with what they held at most, beside stages
    that need it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            for frame in run(batches):
                for at in range(0, len(frame), SLICE):
                    yield frame.iloc[at : at + SLICE]
        finally:
            give_back()

    return wrapped


def own_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, or a longer one that no column of ``df`` starts with."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(text: Column) -> Column:
    """Lower A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Array of words of the alphanumeric rule; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words of the plain rule; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and all tasks run
    on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docketlake-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_batch_lock = threading.Lock()
#: Per session: how many writes bound the rows of a batch just now, and the setting before the first of them.
_batch_users: dict[int, list] = {}


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python functions get at most so many rows at once. Writes of several threads may overlap: the setting comes back
    with the last of them. No result depends on it."""
    if not rows:
        yield
        return
    me = id(spark)
    with _batch_lock:
        user = _batch_users.setdefault(me, [0, spark.conf.get(_BATCH)])
        user[0] += 1
        now = int(spark.conf.get(_BATCH))
        spark.conf.set(_BATCH, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        with _batch_lock:
            user[0] -= 1
            if not user[0]:
                spark.conf.set(_BATCH, user[1])
                del _batch_users[me]


#: Scratch objects made inside of :func:`own_tables`, in this thread.
_mine: ContextVar[list[Scratch] | None] = ContextVar("scratches", default=None)


@contextmanager
def own_tables() -> Iterator[None]:
    """Removes at its end the tables of all scratch objects that this thread made inside of it."""
    made: list[Scratch] = []
    before = _mine.set(made)
    try:
        yield
    finally:
        _mine.reset(before)
        for scratch in made:
            scratch.close()


class Scratch:
    """Tables written under the shared checkpoint folder to cut lineage.

    They are plain Parquet, so a lost executor costs a reread and not a recomputation of
    everything before. ``drop`` removes tables that no later step reads; what is left goes
    when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        if (made := _mine.get()) is not None:
            made.append(self)
        self.root = f"{checkpoint_dir(spark)}/docketlake-{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._quiet_remove, self.root)

    def put(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """Write and reread ``df``. ``batch``: rows that its Python functions get at once while it is written, for
        rows of texts; beside it, Spark's bound of 64 MB for an Arrow batch holds."""
        path = f"{self.root}/{name}-{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        with batches_of(self.spark, batch):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def close(self) -> None:
        """Remove all tables, once nothing reads them any more."""
        self._paths.clear()
        self._remove(self.root)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self._paths.pop(id(t), (None, None))
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet_remove(self, path: str) -> None:
        try:
            self._remove(path)
        except Exception:  # the session is gone already: the cluster's own clean-up takes the folder
            pass


#: A key with so many rows is hot: its rows are dealt to ``HOT_PARTS`` tasks. At most ``HOT_KEYS`` keys are named hot.
HOT_ROWS, HOT_PARTS, HOT_KEYS = 1000, 32, 50_000


def join_hot(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, one row per value of ``keys`` with its number ``n`` of rows.

    The rows of hot keys are dealt by a hash of ``spread`` and their row of ``counted`` is repeated for each
    part, so that no key is one task's. Hot keys are those above ``HOT_ROWS`` and above the share of all rows
    that at most ``HOT_KEYS`` of them can have, which bounds the list that is broadcast. ``counted`` is read
    three times: give a written table. Keys are not null. Without a hot key it is a plain join.
    """
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(counted, keys)
    hot = counted.filter(F.col(n) > least).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
    is_hot = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot_{k}") for k in keys])
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), is_hot, "left").withColumn("_part", part).drop("_hot", *[f"_hot_{k}" for k in keys])
    parts = F.when(F.col(n) > least, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(counted.withColumn("_part", F.explode_outer(parts)), [*keys, "_part"]).drop("_part")


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark ``df`` for broadcasting only if its counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df
