"""Scans over ranges and chains by doubling, against plain folds."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from docketlake.functions.scan import before, chained, following
from docketlake.operators import records as R


@pytest.fixture
def many_ranges(spark):
    """Small shuffle partitions stay apart, so that keys go over several ranges."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def test_running_figures(many_ranges):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice(["x", None]), i, r.choice([None, 1, 2, 5])) for i in range(400)] + [(f"k{i}", "x", 1000 + i, 3) for i in range(60)]
    r.shuffle(rows)
    df = many_ranges.createDataFrame(rows, "k string, j string, at long, v long")
    got = {x.at: (x.s, x.n, x.last) for x in before(df, ["k", "j"], ["at"], s=("sum", F.coalesce("v", F.lit(0))), n=("sum", F.lit(1)), last=("last", F.col("v"))).collect()}
    held, want = collections.defaultdict(lambda: (0, 0, None)), {}
    for k, j, at, v in sorted(rows, key=lambda x: x[2]):
        s, n, last = want[at] = held[k, j]
        held[k, j] = (s + (v or 0), n + 1, v if v is not None else last)
    assert got == want
    assert {x.at: x.n for x in before(df, [], ["at"], n=("sum", F.lit(1))).collect()} == {at: i for i, at in enumerate(sorted(x[2] for x in rows))}
    assert before(df.limit(0), ["k"], ["at"], n=("sum", F.lit(1))).count() == 0
    same = many_ranges.createDataFrame([("a", 1)] * 50, "k string, at long")  # rows that are equal in all
    assert sorted(x.n for x in before(same, ["k"], ["at"], n=("sum", F.lit(1))).collect()) == list(range(50))


def test_following_and_chains(many_ranges):
    r = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, r.randrange(900)) for i in range(300)]
    df = many_ranges.createDataFrame(rows, "k string, id long, v long")
    links = following(df, ["k"], df.select("k", "id", (F.col("v") + 7).alias("reach")))
    nxt = lambda k, v: min(((w, j) for c, j, w in rows if c == k and w >= v), default=(None, None))[1]
    want = {(k, i): nxt(k, v + 7) for k, i, v in rows}
    assert {(x.k, x.id): x.next for x in links.collect()} == want
    starts = [("hot", 1), ("cold", 0)]
    way = set()
    for k, i in starts:
        while i is not None:
            way.add((k, i))
            i = want[k, i]
    assert {tuple(x) for x in chained(links, many_ranges.createDataFrame(starts, "k string, id long"), ["k"]).collect()} == way and len(way) > 50


def test_spaced_frames(many_ranges):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.randrange(5000)) for i in range(300)] + [(4, 900, 10), (4, 901, 10), (4, 902, 110), (4, 903, 109)]
    want = set()
    for v in {x[0] for x in rows}:
        last = None
        for ts, i in sorted((x[2], x[1]) for x in rows if x[0] == v):
            if last is None or ts - last >= 100:
                want.add((v, i))
                last = ts
    df = many_ranges.createDataFrame(rows, "video_id long, frame_id long, ts_ms long")
    assert {(x.video_id, x.frame_id) for x in R.spaced_frames(df).collect()} == want


def test_topics_of_a_long_recording(many_ranges):
    """One recording over many ranges; equal counts go by first use; an open window at the end."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "x1abc", "Émile", "snake_case", "omega"]
    rows, t = [], 0.0
    for i in range(300):
        e = t + r.choice([0.5, 3, 20, 70])
        rows.append((7, i, t, e, " ".join(r.choices(words, k=4)) if i % 11 else None))
        t = e
    got = sorted(R.topic_windows(many_ranges.createDataFrame(rows, "rec_id long, id long, start_s double, end_s double, text string")).collect(), key=lambda x: x.window)
    want, start, n, said = [], 0.0, 0, collections.Counter()
    import re

    def close():
        best = [w.title() for w, _ in said.most_common(5)]
        want.append((7, len(want), start, e, n, ", ".join(best) or "General Discussion"))

    for _, _, _, e, text in rows:
        n += 1
        said.update(w for w in re.findall(r"\b[a-zA-Z]{3,}\b", (text or "").lower()) if w != "the")
        if e - start >= 60:
            close()
            start, n, said = e, 0, collections.Counter()
    if n:
        close()
    assert [tuple(x) for x in got] == want
