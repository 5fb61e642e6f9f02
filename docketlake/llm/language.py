"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import lean, table

#: n-grams of one to so many letters, words padded by one space on each side.
MAX_N = 3
#: Ranks of a language profile and of a document's profile.
PROFILE, DOC_PROFILE = 400, 400
UNKNOWN = "und"
#: Letters of a text are counted in pieces of so many code points, which bounds memory.
PIECE = 1_000_000


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; all but letters become single spaces."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.int64)
    kinds = np.unique(c)
    letter = np.array([chr(k).isalpha() if k < 0xD800 or 0xE000 <= k < 0x110000 else False for k in kinds], bool)
    is_letter = letter[np.searchsorted(kinds, c)]
    c = np.where(is_letter, c, 32).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = c[keep]
    return np.concatenate([[32], c, [32]]) if len(c) and c[-1] != 32 else np.concatenate([[32], c])


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, coded as 21 bits a letter, and their counts."""
    c = _letters(text)
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [c[c != 32]]
    if MAX_N > 1:
        parts.append(c[:-1] << 21 | c[1:])
    if MAX_N > 2:
        inner = c[1:-1] != 32
        parts.append((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def _pieces(text: str) -> Iterator[str]:
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    kinds, at = np.unique(codes, return_inverse=True)
    return kinds, np.bincount(at, weights=n, minlength=len(kinds)).astype(np.int64)


def fit_profiles(docs: DataFrame, top: int = PROFILE) -> DataFrame:
    """(lang, code, rank): the ``top`` most frequent n-grams of each language over all of ``docs`` (text, lang).

    Ties go to the smaller code. Null texts and null languages teach nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for b in batches:
            for lang, rows in b.groupby("lang"):
                # many short texts are counted at once; the joint is a space
                joined = "\n".join(rows["text"])
                held[lang] = [_summed([*held.get(lang, []), *map(count_ngrams, _pieces(joined))])]
        for lang, [(codes, n)] in held.items():
            yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counts = docs.select("lang", "text").dropna().mapInPandas(lean(count), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", "code", "rank")


def identify(docs: DataFrame, profiles: pd.DataFrame, top: int = DOC_PROFILE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``lang_pred`` and ``score``.

    A document's most frequent n-grams are compared with each profile by the sum of differences in rank;
    an n-gram that a profile lacks counts as its full length. The nearest language wins, ties to the
    first in code point order. ``score`` is one less the share of the largest distance possible. Null
    texts, texts without a letter and a missing model give ``und`` and 0. Every text is counted whole.
    """
    langs = sorted(profiles["lang"].unique())
    codes = np.unique(profiles["code"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(codes) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        p = profiles[profiles["lang"] == lang]
        ranks[i, np.searchsorted(codes, p["code"].to_numpy(np.int64))] = p["rank"].to_numpy(np.int64)

    def predict(text: str | None) -> tuple[str, float]:
        found, n = _summed([count_ngrams(x) for x in _pieces(text)]) if text and len(text) > PIECE else count_ngrams(text or "")
        if not len(found) or not langs:
            return UNKNOWN, 0.0
        order = np.lexsort((found, -n))[:top]
        mine = found[order]
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        theirs = np.where(codes[at] == mine, ranks[:, at], -1)
        away = np.abs(theirs - np.arange(1, len(mine) + 1))
        distance = np.where(theirs < 0, PROFILE, np.minimum(away, PROFILE)).sum(axis=1)
        best = int(distance.argmin())
        return langs[best], float(1 - distance[best] / (PROFILE * len(mine)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [predict(t) for t in b["text"]]
            out = b.drop(columns="text")
            out["lang_pred"], out["score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    rest = [f for f in docs.schema if f.name not in ("text", "lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInPandas(lean(run), f"{schema}, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Profiles are learned from all documents that are not held out; they are a few hundred rows a
    language (400 n-grams each), which is what goes to the driver."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = fit_profiles(docs.filter(~held)).toPandas()
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles)
