"""Conflicts are looked for among all pairs of texts."""

import datetime
import difflib
import itertools

from docketlake.operators import text as T


def test_conflicts_need_no_rare_word(spark):
    texts = [f"payment was made under the agreement no {i}" for i in range(6)] + [f"{i} {i + 1} a b c 12 34" for i in range(4)] + ["оплата по договору 1", "оплата по договору 2", "x", "", "something else entirely was said of it"]
    rows = [(i, i, datetime.date(2024, 1, 1 + i % 3), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "event_id long, doc_id long, day date, text string")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] != b[2] and difflib.SequenceMatcher(None, *sorted((a[3].lower(), b[3].lower()))).ratio() >= 0.6}
    assert {tuple(r) for r in T.conflicts(df).collect()} == want
    assert any(a in range(6, 10) for a, _ in want) and any(a == 10 for a, _ in want)
