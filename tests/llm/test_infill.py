"""Fill-in-the-middle against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(n=200, seed=5):
    r = random.Random(seed)
    parts = ["a", "né", "語", "🙂", " ", "  ", "\n", "\t", "\x0b", " ", " ", "\x1c", "word", "<P", ">", "\x00"]
    return ["".join(r.choices(parts, k=r.randint(0, 300))) for _ in range(n)] + ["", " ", "x", " x", "x ", "́", "a" * 5000, "ab " * 3000, "語 " * 2000 + " "]


@pytest.mark.parametrize("every,block", [(1, 1), (1, 7), (4, 3), (64, 1 << 20), (5, 64)])
def test_index_finds_every_token(every, block):
    for t in texts(60):
        data, ends = t.encode(), [0, *(m.end() for m in TOKEN.finditer(t))]
        n, index = infill.checkpoints(data, every, block)
        assert n == len(ends) - 1 and list(index[:, 0]) == list(range(0, n + 1, every))
        for unit in {0, n, *np.random.default_rng(1).integers(0, n + 1, 20).tolist()}:
            assert infill.locate(data, index, unit) == (len(t[: ends[unit]].encode()), ends[unit])


def plain(doc_id, text):
    t = text or ""
    w = TOKEN.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, t
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(w), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_against_a_plain_version_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c"), (7, None), (8, "has <S> in it"), (9, "twice the same"), (9, "twice the same"), (-3, "minus three words"), (2**62, "large id of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fim_c", F.lit(1)).withColumn("Form", F.lit("clash")).withColumn("lang", F.lit("en"))
    out = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "_fim_c", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = out.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = "några ord\n" * 400_000
    df = spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string")
    got = infill.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("h")).collect()
    assert {tuple(r) for r in got} == {(*(x := plain(i, long))[:5], hashlib.sha256(x[5].encode()).hexdigest()) for i in range(6)}
