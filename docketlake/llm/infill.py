"""Fill-in-the-middle: texts are cut at random tokens by a sparse index of checkpoints and put together anew."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.common import own_prefix, table

#: Tokens from one checkpoint to the next.
EVERY = 64
#: Bytes of a text that are looked at at once while its tokens are counted.
BLOCK = 1 << 20
SEED = 42
#: Of 100 documents so many are cut, and of 100 cut ones so many put the suffix first.
RATE, SPM_SHARE = 50, 80
# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def checkpoints(data: bytes, every: int = EVERY, block: int = BLOCK) -> tuple[int, np.ndarray]:
    """Number of tokens of a UTF-8 text, and its index: a row (tokens, bytes, code points) before the first
    token and after each ``every`` tokens.

    A token ends with a run of other than white space, or with the text. The text is read in blocks, so that beside
    it only the index grows with it.
    """
    rows = [np.zeros((1, 3), np.int64)]
    tokens = points = 0
    for lo in range(0, len(data), block):
        part = np.frombuffer(data, np.uint8, min(block, len(data) - lo), lo)
        space = (part == 32) | ((part - np.uint8(9)) <= 4)
        after = np.empty(len(part), bool)  # is the next byte white space, or the end
        after[:-1] = space[1:]
        at = lo + len(part)
        after[-1] = at == len(data) or data[at] == 32 or 9 <= data[at] <= 13
        ends = np.flatnonzero(~space & after)
        if at == len(data) and space[-1]:
            ends = np.append(ends, len(part) - 1)
        passed = np.cumsum((part & 0xC0) != 0x80)  # code points up to and with each byte
        marks = np.arange(every - tokens % every - 1, len(ends), every)
        if len(marks):
            rows.append(np.stack([tokens + marks + 1, lo + ends[marks] + 1, points + passed[ends[marks]]], 1))
        tokens, points = tokens + len(ends), points + int(passed[-1])
    return tokens, np.concatenate(rows)


def locate(data: bytes, index: np.ndarray, unit: int) -> tuple[int, int]:
    """Byte and code-point offset after ``unit`` tokens: the last checkpoint before by binary search, then a short
    scan."""
    k = int(np.searchsorted(index[:, 0], unit, "right")) - 1
    done, at, points = (int(x) for x in index[k])
    end = at
    if done < unit:
        found = _TOKEN.finditer(data, at)
        for _ in range(unit - done):
            end = next(found).end()
    return end, points + len(data[at:end].decode("utf-8", "surrogatepass"))


CUTS = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "b1", "c1", "b2", "c2")])


@F.pandas_udf(CUTS)
def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Tokens of a text, and both cuts: bytes and code points before them."""
    out = np.zeros((len(text), 5), np.int64)
    for i, (t, x, y) in enumerate(zip(text, h1, h2)):
        data = (t or "").encode("utf-8", "surrogatepass")
        n, index = checkpoints(data)
        x, y = int(x) % (n + 1), int(y) % (n + 1)
        out[i] = (n, *locate(data, index, min(x, y)), *locate(data, index, max(x, y)))
    return pd.DataFrame(out, columns=CUTS.names)


def _draw(name: Column, k: int) -> Column:
    """The ``k``-th group of 8 digits of a hash as a number."""
    return F.conv(F.substring(name, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and output (the new text).

    Tokens are runs of other than white space with the white space before them; white space at the end is a token.
    Python gets the text and gives the cuts alone; the parts are sliced by their byte offsets in Spark. All draws
    come from the hash of the seed and doc_id, so rows that repeat a doc_id are cut at the same draws and a lost
    task gives the same rows again. A null text counts as empty; empty texts and texts that hold a mark are plain; a
    null doc_id is drawn as an empty one. Texts of any length are read whole. Other columns of ``docs`` stay; those
    named like an added one are replaced, whatever their case; an empty table gives no rows.
    """
    me = own_prefix(docs, "_fim_")
    text, name = F.coalesce("text", F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.withColumn(f"{me}h", name).withColumn(f"{me}c", cuts(text, _draw(F.col(f"{me}h"), 1), _draw(F.col(f"{me}h"), 2)))
    marked = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = marked | (_draw(F.col(f"{me}h"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col(f"{me}h"), 4) % 100 < spm_share, "spm").otherwise("psm")
    data, c = text.cast("binary"), F.col(f"{me}c")
    piece = lambda lo, hi: F.substring(data, (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string")
    first, middle, last = piece(F.lit(0), c["b1"]), piece(c["b1"], c["b2"]), piece(c["b2"], F.octet_length(text))
    psm = F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle)
    added = {
        "n": c["n"], "form": F.col(f"{me}f"), "prefix_chars": F.when(F.col(f"{me}f") != "plain", c["c1"]), "middle_chars": F.when(F.col(f"{me}f") != "plain", c["c2"] - c["c1"]),
        "output": F.when(F.col(f"{me}f") == "plain", text).when(F.col(f"{me}f") == "psm", psm).otherwise(spm),
    }
    kept = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in added]
    return rows.withColumn(f"{me}f", form).select(*kept, *[v.alias(k) for k, v in added.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Only outputs that are not plain hold marks, each once."""
    before, after = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1)), lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's new text, and of the text rebuilt from it."""
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2, ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
