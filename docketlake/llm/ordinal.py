"""Ordinal quality classifier: cumulative-link regression on hashed text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import give_back, lean, sized_broadcast, table

#: Hash space of the shared weights.
DIM = 1 << 18
#: Lengths of hashed word beginnings (the word's own mark counts as its first letter).
PREFIXES = (5, 6, 7)
#: Distances at which tokens are compared with earlier ones, and the shares of equal ones that are features.
ECHOES, ECHO_SHARES = (1, 2), (1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: Bound on the labelled rows that the weights are fitted on; they are those with the smallest (hash, doc_id).
MAX_FIT_ROWS = 20_000
#: Up to so many labels are sent to the tasks that read texts (about 40 MB); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: A feature takes part if it is in so many labelled texts and tells the grades apart by this log-odds.
MIN_DF, MIN_ODDS = 4, 0.5
SMOOTH = 0.3
L2, STEPS, RATE = 1e-4, 200, 0.05
#: A text stays if the probability of the top grade is at least this.
KEEP_FROM = 0.6
#: Words whose hashes a worker keeps; then it starts anew. Bounds its memory.
CACHE_WORDS = 100_000

_ECHO = np.array([[xxhash.xxh3_64_intdigest(f"\0echo {d} {share}".encode()) % DIM for share in ECHO_SHARES] for d in ECHOES], np.int64)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: well made but toxic; 2: well made and clean. Null if a label is missing."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


class Features(dict):
    """Numbers tokens and keeps their hashed features: the token itself and its beginnings."""

    def __init__(self):
        super().__init__()
        self.table = np.full((1 << 12, 1 + len(PREFIXES)), -1, np.int64)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        marked = "^" + word
        self.table[k, 0] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % DIM
        for j, n in enumerate(PREFIXES, 1):
            if len(marked) > n:
                self.table[k, j] = xxhash.xxh3_64_intdigest(b"p" + marked[:n].encode("utf-8", "surrogatepass")) % DIM
        self[word] = k
        return k

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and values: log(1 + count) / log(1 + tokens) of tokens and beginnings; 1 for each share that
        the tokens equal to the one before, or before that, reach."""
        words = _TOKEN.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table.fill(-1)  # a short word has no beginnings: none may be left of the word that had its number
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        echo = np.concatenate([_ECHO[j, [(ids[d:] == ids[:-d]).mean() >= share for share in ECHO_SHARES]] for j, d in enumerate(ECHOES) if len(ids) > d] or [np.zeros(0, np.int64)])
        kinds, times = np.unique(ids, return_counts=True)
        f = self.table[kinds].ravel()
        n = np.repeat(times, self.table.shape[1])
        have = f >= 0
        found, at = np.unique(f[have], return_inverse=True)
        return np.append(found, echo), np.append(np.log1p(np.bincount(at, weights=n[have])) / math.log1p(len(words)), np.ones(len(echo)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_cumulative_link(at: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of P(grade <= k) = sigmoid(threshold_k - score), by Adam on
    the penalised likelihood. ``at``: row of each entry."""
    n, cuts = len(y), grades - 1
    kinds, feature = np.unique(feature, return_inverse=True)
    # single precision and sums over sorted stretches: half a dozen arrays of four bytes an entry
    at, feature, value = at.astype(np.int32), feature.astype(np.int32), value.astype(np.float32)
    row_starts = np.flatnonzero(np.diff(at, prepend=-1))
    by_feature = np.argsort(feature, kind="stable").astype(np.int32)
    feature_starts = np.searchsorted(feature[by_feature], np.arange(len(kinds)))
    at_f, value_f = at[by_feature], value[by_feature]
    del by_feature
    w, th = np.zeros(len(kinds)), np.linspace(-2.0, -1.0, cuts)
    m, v = np.zeros(len(w) + cuts), np.zeros(len(w) + cuts)
    below, above = y > 0, y < cuts
    k_low, k_up = np.maximum(y - 1, 0), np.minimum(y, cuts - 1)
    s = np.zeros(n)
    for t in range(1, STEPS + 1):
        if len(at):
            s[at[row_starts]] = np.add.reduceat(w.astype(np.float32)[feature] * value, row_starts)
        up = np.where(above, _sigmoid(th[k_up] - s), 1.0)
        low = np.where(below, _sigmoid(th[k_low] - s), 0.0)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = np.where(above, up * (1 - up), 0) / p, np.where(below, low * (1 - low), 0) / p
        gs = (d_up - d_low) / n
        g_th = (np.bincount(k_low, weights=d_low, minlength=cuts) - np.bincount(k_up, weights=d_up, minlength=cuts)) / n
        g_w = np.add.reduceat(gs.astype(np.float32)[at_f] * value_f, feature_starts) if len(at) else np.zeros(0)
        g = np.concatenate([g_w + L2 * w, g_th])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, th = w - step[: len(w)], np.sort(th - step[len(w) :])
    full = np.zeros(DIM)
    full[kinds] = w
    return full, th


def _values(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a column of bytes, end to end, and their lengths; read from its buffers, without an object a row."""
    parts, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for c in column.chunks:
        _, ends, data = c.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        if data is not None and ends[-1] > ends[0]:
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
        sizes.append(np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize)
    return np.concatenate(parts), np.concatenate(sizes)


def fit(docs: DataFrame, rated: DataFrame, grades: int = 3, max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds from (doc_id, text) and (doc_id, grade); None if fewer than two grades are seen.

    Document frequencies per feature, below the top grade and in it, are counted over all labelled rows
    (at most one row per place of the hash space comes to the driver); features are scaled by their
    log-odds. The weights are fitted on at most ``max_rows`` rows, picked among the labels, so that only
    their texts are read for it.
    """
    n_rated = rated.count()
    graded = docs.join(sized_broadcast(rated, n_rated, BROADCAST_LABELS), "doc_id").filter(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, df, n = Features(), np.zeros((2, DIM), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for text, g in zip(b["text"], b["grade"]):
                top = int(g == grades - 1)
                df[top, seen.of(text)[0]] += 1
                n[top] += 1
        used = np.flatnonzero(df.sum(axis=0))
        yield pd.DataFrame({"f": np.append(used, DIM), "low": np.append(df[0, used], n[0]), "top": np.append(df[1, used], n[1])})

    counts = graded.select("text", "grade").mapInPandas(lean(count), "f bigint, low bigint, top bigint").groupBy("f").agg(F.sum("low").alias("low"), F.sum("top").alias("top")).toArrow()  # columns: rows would be objects here and in the JVM
    f, low, top = (counts[c].to_numpy() for c in ("f", "low", "top"))
    del counts
    n_low, n_top = int(low[f == DIM].sum()), int(top[f == DIM].sum())
    if not n_low or not n_top:
        return None
    f, low, top = f[f < DIM], low[f < DIM], top[f < DIM]
    odds = np.zeros(DIM)
    r = np.abs(np.log((low + SMOOTH) / (n_low + 2 * SMOOTH)) - np.log((top + SMOOTH) / (n_top + 2 * SMOOTH)))
    odds[f] = np.where((low + top >= MIN_DF) & (r >= MIN_ODDS), r, 0)
    del f, low, top, r

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Features()
        for b in batches:
            f = [seen.of(t) for t in b["text"]]
            kept = [(k[odds[k] > 0].astype(np.int32), v[odds[k] > 0].astype(np.float32)) for k, v in f]
            yield pd.DataFrame({"id": b["doc_id"].astype(str), "grade": b["grade"], "f": [k.tobytes() for k, _ in kept], "v": [v.tobytes() for _, v in kept]})

    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40))
    picked = rated.orderBy(place, "doc_id").limit(max_rows)
    rows = docs.join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "text", "grade").mapInPandas(lean(encode), "id string, grade int, f binary, v binary").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("id", "grade", "f", "v")])  # sums in one order: reruns agree
    y = rows["grade"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return None
    feature, sizes = _values(rows["f"], np.int32)
    at = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    value = _values(rows["v"], np.float32)[0] * odds.astype(np.float32)[feature]
    del rows
    w, th = fit_cumulative_link(at, feature, value, y, grades)
    del at, feature, value
    give_back()
    return w * odds, th


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_top`` (probability of the top grade) and ``kept``.

    ``labels``: (doc_id, quality, toxic); a doc_id labelled more than once counts by its worst labels. Documents
    that repeat a labelled doc_id are taught each, so a row that is repeated weighs more.
    Texts without a token (null, empty, white space) have null figures and are not kept. Without labels of
    two grades nothing can be learned: figures are null and every text with a token is kept. Whole texts
    are read; columns named like an added one are replaced, others stay; an empty table gives no rows.
    """
    added = ["expected_grade", "p_top", "kept"]
    rated = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rated = rated.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).filter(F.col("grade").isNotNull())
    model = fit(docs.select("doc_id", "text"), rated)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Features()
        for b in batches:
            expected, top, kept = [], [], []
            for text in b["text"]:
                f, v = seen.of(text)
                if model is None or not len(f):
                    expected.append(None), top.append(None), kept.append(bool(len(f)))
                    continue
                tail = 1 - _sigmoid(model[1] - float((model[0][f] * v).sum()))
                expected.append(float(tail.sum())), top.append(float(tail[-1])), kept.append(bool(tail[-1] >= keep_from))
            yield b.assign(expected_grade=pd.array(expected, "Float64"), p_top=pd.array(top, "Float64"), kept=kept)

    rest = docs.drop(*[c for c in added if c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInPandas(lean(run), f"{schema}, expected_grade double, p_top double, kept boolean")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "expected_grade", "p_top", "kept")


