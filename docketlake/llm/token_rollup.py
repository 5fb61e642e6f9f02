"""Token counts kept up by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import TEXTS, Scratch, lean, table

VOCABULARIES = "/opt/tokenizers"
#: Tokenizer versions: name -> (file, kind).
TOKENIZERS = {"byte_bpe_50k": ("byte_bpe_50k.tiktoken", "tiktoken"), "byte_bpe_multi_50k": ("byte_bpe_multi_50k.tiktoken", "tiktoken")}
KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
#: Longer texts are put into tokens in pieces cut before a space that follows a non-space, where no
#: token can reach across; this bounds memory.
PIECE = 1_000_000


def read_vocabulary(folder: str, file: str) -> tuple[str, bytes, str]:
    """Name, content and splitting pattern, read where the job is planned: they travel to the executors with
    the function that uses them (under a megabyte), which so need no folder of their own."""
    import public_tokenizers

    with open(os.path.join(folder, file), "rb") as f:
        return file, f.read(), public_tokenizers.PATTERN


def encoding(vocabulary: tuple[str, bytes, str]):
    import tiktoken

    name, content, pattern = vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    at = 0
    cut = re.compile(r"(?<=\S) (?=\S)")
    while len(text) - at > PIECE:
        m = cut.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizers: dict | None = None, folder: str = VOCABULARIES) -> DataFrame:
    """One row per row of ``docs`` and tokenizer: doc_id, source, lang, tokenizer, n_tokens, n_chars. Null
    and empty texts have no tokens; null source and lang are kept as values of their own."""
    which = {name: read_vocabulary(folder, file) for name, (file, _) in (tokenizers or TOKENIZERS).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {name: encoding(v) for name, v in which.items()}
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for name, enc in loaded.items():
                n = [sum(len(enc.encode_ordinary(x)) for x in _pieces(t)) for t in texts]
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "tokenizer": name, "n_tokens": n, "n_chars": [len(t) for t in texts]})

    return docs.select("doc_id", "source", "lang", "text").mapInPandas(lean(run), "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_chars")).alias("n_chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """A changed document is taken out with its old count and put in with its new one."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Additive totals by source, language and tokenizer version under ``path``.

    * ``batches/<id>/<attempt>``: the summed deltas of a batch. An attempt counts from its mark of success on,
      so one that was cut off never does; of several finished attempts at one batch (two writers, a writer
      that lost its lease) the first by name counts and the others do not, so a batch is counted once.
    * ``manifests/<number>``: the last one names the folded table (``bases/<name>``) and the batches in it. It
      appears by one rename, so totals are those from before or those from after, never between.

    ``compact`` writes a new folded table, publishes its manifest and only then removes what the manifest
    has made needless; stopped anywhere, it can be run again. Run one compaction at a time. The table of the
    manifest before stays until the next compaction, for readers under way. Repeated delta rows count
    each time; no deltas commit an empty batch; other columns of the deltas are ignored; null keys are values
    of their own. Keys whose figures are all zero are left out.
    """

    SCHEMA = "source string, lang string, tokenizer string, " + ", ".join(f"{m} bigint" for m in MEASURES)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _id(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()[:40]

    def _find(self, pattern: str) -> list[str]:
        """Paths that match, relative to the rollup's own."""
        found = self._fs.globStatus(self._path(f"{self.path}/{pattern}")) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(s.getPath().toString().split("/")[-depth:]) for s in found)

    def _manifest(self) -> tuple[int, str | None, set[str]]:
        """Number, folded table and folded batches of the last manifest."""
        names = [n.rsplit("/", 1)[-1] for n in self._find("manifests/*")]
        names = [n for n in names if n.isdigit()]
        if not names:
            return 0, None, set()
        base, *folded = (r[0] for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect())
        return int(names[-1]), base, set(folded)

    def _attempts(self) -> dict[str, str]:
        """Batch to the attempt that counts."""
        out: dict[str, str] = {}
        for mark in self._find("batches/*/*/_SUCCESS"):
            _, batch, attempt, _ = mark.split("/")
            out.setdefault(batch, f"batches/{batch}/{attempt}")
        return out

    def committed(self, batch_id: str) -> bool:
        return self._id(batch_id) in self._manifest()[2] or bool(self._find(f"batches/{self._id(batch_id)}/*/_SUCCESS"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """True if the batch was counted now, False if it had been before."""
        if self.committed(batch_id):
            return False
        self._sum(deltas).write.parquet(f"{self.path}/batches/{self._id(batch_id)}/{uuid.uuid4().hex}")
        return True

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def _table(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        _, base, folded = self._manifest()
        parts = [f"bases/{base}"] if base else []
        parts += [place for batch, place in self._attempts().items() if batch not in folded]
        return self._sum(self._table(parts)).filter(" OR ".join(f"{m} != 0" for m in MEASURES))

    def compact(self) -> None:
        """Fold all committed batches into one table; their ids stay known."""
        number, base, folded = self._manifest()
        fresh = {batch: place for batch, place in self._attempts().items() if batch not in folded}
        if fresh:
            name = uuid.uuid4().hex
            parts = ([f"bases/{base}"] if base else []) + list(fresh.values())
            self._sum(self._table(parts)).write.parquet(f"{self.path}/bases/{name}")
            self._publish(number + 1, [name, *sorted(folded | set(fresh))])
        self._clean()

    def _publish(self, number: int, lines: list[str]) -> None:
        draft, target = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{number:012d}")
        out = self._fs.create(draft)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another compaction has published manifest {number}")

    def _clean(self) -> None:
        number, base, folded = self._manifest()
        for n in (int(m.rsplit("/", 1)[-1]) for m in self._find("manifests/*")):
            if n < number - 1:
                self._delete(f"manifests/{n:012d}")
        before = self._find(f"manifests/{number - 1:012d}")
        kept = {base} | {r[0] for m in before for r in self.spark.read.text(f"{self.path}/{m}").limit(1).collect()}
        for b in self._find("bases/*"):
            if b.rsplit("/", 1)[-1] not in kept:
                self._delete(b)
        for b in self._find("batches/*"):
            if b.rsplit("/", 1)[-1] in folded:
                self._delete(b)
        self._delete("drafts")

    def _delete(self, place: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{place}"), True)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches over the whole table: every document is inserted; documents without
    a character are deleted again; those without a language are revised to ``und``; then the batches are
    folded and two of them are sent once more, which changes nothing."""
    scratch = Scratch(spark, "rollup")
    counts = scratch.put(count_tokens(table(spark, sf_dir, "documents")), "counts", TEXTS)
    rollup = TokenRollup(spark, f"{scratch.root}/totals")
    rollup.commit("load", inserts(counts))
    empty = deletes(counts.filter(F.col("n_chars") == 0))
    rollup.commit("withdraw", empty)
    unnamed = counts.filter(F.col("lang").isNull() & (F.col("n_chars") > 0))
    rollup.commit("relabel", revisions(unnamed, unnamed.withColumn("lang", F.lit("und"))))
    rollup.compact()
    rollup.commit("load", inserts(counts))
    rollup.commit("withdraw", empty)
    return rollup.totals()
