"""Quality rules from tokeniser fertility: characters per token, byte fallback, token entropy."""

from __future__ import annotations

import math
import re
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import lean, table
from docketlake.llm.token_rollup import encoding, read_vocabulary

VOCABULARIES = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Words whose tokens a worker keeps; then it starts anew. Bounds its memory.
CACHE_WORDS = 400_000

#: Rejection bands per language, else per script, else the default. A text is rejected outside of
#: (least, most) characters per piece, (least, most) characters per token of the byte vocabulary,
#: above the share of byte-fallback pieces, or below the entropy of its pieces as a share of the most
#: that a text of so many pieces can have. The lower bands stand four or more standard deviations under
#: the least fluent prose seen per language, so that only text dense in odd symbols falls below.
BANDS = {
    "en": (1.70, 6.5, 1.85, 6.5, 0.10, 0.30),
    "de": (1.75, 7.0, 1.95, 7.0, 0.10, 0.30),
    "fr": (1.50, 6.5, 1.72, 6.5, 0.10, 0.30),
    "es": (1.60, 6.5, 1.80, 6.5, 0.10, 0.30),
    "latin": (1.30, 7.0, 1.30, 7.0, 0.15, 0.30),
    "default": (0.30, 7.0, 0.30, 7.0, 0.90, 0.30),
}

SCHEMA = """_row struct<doc_id: bigint>, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,
n_repeat_words bigint, base_failed boolean, kept boolean, chars_per_piece double, chars_per_token double,
byte_share double, entropy_share double, band string"""


#: Runs of characters whose letters count as Latin.
LATIN = re.compile("[\\u0000-\\u024f\\u1e00-\\u1eff]+")


class Words(dict):
    """Numbers words as they come and keeps the pieces of each under both vocabularies."""

    def __init__(self, pieces: bytes, vocabulary: tuple[str, bytes, str]):
        super().__init__()
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self._bpe = encoding(vocabulary)
        self.n_pieces = self._sp.get_piece_size()
        self.is_byte = np.array([self._sp.is_byte(i) for i in range(self.n_pieces)])
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.tokens = np.zeros(1 << 14, np.int32)
        self.used = 0

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        text = word.decode("utf-8", "replace")
        pieces = self._sp.encode(text)
        if k >= len(self.start):
            for name in ("start", "length", "tokens"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.used + len(pieces) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[k], self.length[k] = self.used, len(pieces)
        self.tokens[k] = len(self._bpe.encode_ordinary(" " + text))
        self.flat[self.used : self.used + len(pieces)] = pieces
        self.used += len(pieces)
        self[word] = k
        return k


def read_vocabularies(folder: str) -> tuple[bytes, tuple[str, bytes, str]]:
    """Both vocabularies, which travel with the function that uses them (1.3 MB)."""
    with open(os.path.join(folder, PIECES), "rb") as f:
        return f.read(), read_vocabulary(folder, BYTES)


def script_of(text: str) -> str:
    """"latin" if most of the letters of the text, all of them counted, are Latin."""
    rest = LATIN.sub("", text)
    letters, other = sum(map(str.isalpha, text)), sum(map(str.isalpha, rest))
    return "latin" if letters and (letters - other) * 2 >= letters else "default"


def repeated_in_windows(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    # two steps keep the numbers small for any number of distinct words
    pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    triple = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, at, n = np.unique(triple, return_inverse=True, return_counts=True)
    again = n[at] >= 2
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None, lang: str | None, words: Words, bands: dict) -> tuple:
    text = text or ""
    if len(words) > CACHE_WORDS:
        words.reset()
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            if line in seen:
                dup += 1
            seen.add(line)
    ids = np.fromiter(map(words.__getitem__, found), np.int64, n)
    repeat = repeated_in_windows(ids)
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    if not n:
        return n, word_chars, symbols, dup, repeat, failed, False, None, None, None, None, None
    kinds, times = np.unique(ids, return_counts=True)
    size = words.length[kinds]
    total = int(size.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    pieces = words.flat[np.repeat(words.start[kinds], size) + offset]
    counts = np.bincount(pieces, weights=np.repeat(times, size), minlength=words.n_pieces)
    n_pieces = counts.sum()
    p = counts[counts > 0] / n_pieces
    entropy = float(-(p * np.log2(p)).sum()) / math.log2(min(n_pieces, words.n_pieces)) if n_pieces > 1 else 0.0
    per_piece, per_token = word_chars / n_pieces, word_chars / max(1, int((words.tokens[kinds] * times).sum()))
    share = float(counts[words.is_byte].sum() / n_pieces)
    band = lang if lang in bands else script_of(text)
    a, b, c, d, most, least = bands[band]
    good = a <= per_piece <= b and c <= per_token <= d and share <= most and entropy >= least
    return n, word_chars, symbols, dup, repeat, failed, bool(good and not failed), per_piece, per_token, share, entropy, band


def quality_rules(docs: DataFrame, folder: str = VOCABULARIES, bands: dict | None = None) -> DataFrame:
    """Base counts, fertility figures and verdict of each document.

    Each word is put into pieces by two public vocabularies (both split at white space, so words
    can be cut one at a time and kept). Null or empty texts and texts without a word have zero counts,
    null figures, ``base_failed`` true and ``kept`` false. An unknown or null ``lang`` falls back to
    the band of the script. Long texts are measured whole. Repeated rows are measured each; extra
    columns are ignored; an empty table gives no rows.
    """
    bands, both = BANDS | (bands or {}), read_vocabularies(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(*both)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_piece", "chars_per_token", "byte_share", "entropy_share", "band"]
        for b in batches:
            rows = [measure(t, g, words, bands) for t, g in zip(b["text"], b["lang"])]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    schema = SCHEMA.replace("_row struct<doc_id: bigint>", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", lang.alias("lang")).mapInPandas(lean(run), schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
