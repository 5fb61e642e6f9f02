"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import vectors
from docketlake.llm.common import Scratch

KIND = "vec_id long, embedding array<{}>"


def plain(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
            if a < b and len(x) == len(y) and vectors.cosine(x, y) >= least:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(links[k]), low, i is not None and low == i))
    return sorted(out, key=str)


def near(r, v, cos):
    """A vector at the cosine to ``v``."""
    v = v / np.linalg.norm(v)
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return cos * v + math.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def check(spark, rows, kind="double", **more):
    df = spark.createDataFrame(rows, KIND.format(kind)).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("label", F.lit(2))
    got = vectors.near_vectors(df.repartition(3), Scratch(spark, "t"), **more).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    return got


@pytest.mark.parametrize("dim", [3, 16, 64, 100])
def test_against_all_pairs(spark, dim):
    r = np.random.default_rng(dim)
    base = r.normal(size=(60, dim))
    rows = list(base) + [near(r, base[k % 20], c) * s for k, (c, s) in enumerate((c, s) for c in (0.9502, 0.96, 0.99, 0.9498, 0.93) for s in (1, 1e-3, 50) for _ in range(4))]
    got = check(spark, [(1000 - i, v.tolist()) for i, v in enumerate(rows)])
    assert sum(x.n_links for x in got) > 0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [1.0, 2.0]), (None, v), (11, [-1.0, -2.0, -3.0]), (12, [1e300, 2e300, 3e300]), (13, [1e-320, 2e-320, 3e-320]), (14, [0.0, -0.0, 5.0]), (15, [-0.0, 0.0, 5.0]), (10, [0.0, 1.0, 0.0])]
    check(spark, rows)
    assert vectors.near_vectors(spark.createDataFrame([], KIND.format("float")), Scratch(spark, "t")).count() == 0
    check(spark, [(1, [0.5]), (2, [3.0]), (3, [-1.0])], "float")


def test_a_large_group_is_split_and_counted_once(spark):
    """Copies, and vectors that are all near each other, beyond what one task compares."""
    r = np.random.default_rng(0)
    centre = r.normal(size=32)
    rows = [(i, near(r, centre, 0.99).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, r.normal(size=32).astype(np.float32).tolist()) for i in range(30)]
    got = check(spark, rows, "float", unit=16)
    assert max(x.n_links for x in got) >= 150 and len({x.component_id for x in got if x.n_links}) == 1


def test_a_cosine_at_the_bound(spark):
    """19 of 20 parts along the other, 39 = 36 + 1 + 1 + 1 across: 0.95 to the last digit."""
    a, b = [20.0, 0.0, 0.0, 0.0, 0.0], [19.0, 6.0, 1.0, 1.0, 1.0]
    assert vectors.cosine(np.array(a), np.array(b)) == 0.95
    check(spark, [(1, a), (2, b)])


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_recall_at_the_bound(parts):
    """Pairs at exactly the least cosine meet as often as the tables were made for."""
    r = np.random.default_rng(parts)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.array([near(r, x, 0.95) for x in a])
    tables = vectors.tables_for(64, parts, 0.95, 0.999)
    h = vectors.Hashes(64, parts, tables)
    x, y = h.codes(a), h.codes(b)
    met = np.zeros(len(a), bool)
    for t in range(tables):
        met |= vectors.met(x[:, t], y[:, t])
    assert met.mean() >= 0.997


def test_more_parts_for_more_vectors():
    assert [vectors.parts_for(n, 64) for n in (0, 500, 1024, 1025, 130_000, 10**9, 10**12)] == [1, 1, 1, 2, 2, 4, 6]
    assert vectors.parts_for(10**15, 2) == 8 and vectors.Hashes(4, 8, 1).probes == 16


def test_rows_do_not_depend_on_their_batch():
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 64))
    h = vectors.Hashes(64, 2, 4)
    whole = h.codes(x)
    assert all((h.codes(x[k : k + 1])[0] == whole[k]).all() and (h.codes(x[k : k + 1], 2)[0] == whole[k, :2]).all() for k in range(50))
