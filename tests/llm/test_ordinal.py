"""The quality classifier against plain versions: its likelihood and gradient, and the whole query."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from docketlake.llm import ordinal, registry

SF = "/root/testdata/sf0.001"


def loss(x, y, w, th):
    """Penalised mean negative log-likelihood, row by row."""
    total = 0.0
    for row, k in zip(x, y):
        s = float(row @ w)
        below = lambda c: 1 / (1 + math.exp(-(th[c] - s)))
        up = below(k) if k < len(th) else 1.0
        low = below(k - 1) if k > 0 else 0.0
        total -= math.log(max(up - low, 1e-300))
    return total / len(y) + ordinal.L2 / 2 * float(w @ w)


def slope(f, point, h=1e-5):
    """Gradient by differences."""
    out = np.zeros(len(point))
    for i in range(len(point)):
        up, down = point.copy(), point.copy()
        up[i] += h
        down[i] -= h
        out[i] = (f(up) - f(down)) / (2 * h)
    return out


def rows_of(seed, n=200, d=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (r.random((n, d)) < 0.7)
    s = x @ np.array([1.5, -1.0, 0.5, 0.0, 2.0]) + r.logistic(size=n)
    return x, np.digitize(s, [-1.0, 0.8])


def fitted(x, y):
    at, feature = np.nonzero(x)
    w, th = ordinal.fit_cumulative_link(at, feature, x[at, feature], y, 3)
    return w[: x.shape[1]], th


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_reaches_the_least_loss(seed):
    """The loss is convex: Newton's method on a plain form of it, by differences, finds the least one."""
    x, y = rows_of(seed)
    f = lambda p: loss(x, y, p[:5], p[5:])
    p = np.concatenate([np.zeros(5), [-1.0, 1.0]])
    for _ in range(12):
        g = slope(f, p)
        hessian = np.array([(slope(f, p + 1e-4 * e) - slope(f, p - 1e-4 * e)) / 2e-4 for e in np.eye(7)])
        p = p - np.linalg.solve(hessian + 1e-9 * np.eye(7), g)
    assert np.abs(slope(f, p)).max() < 1e-6
    w, th = fitted(x, y)
    mine = np.concatenate([w, th])
    assert f(mine) <= f(p) + 1e-3 and np.abs(slope(f, mine)).max() < 0.01 and np.abs(mine - p).max() < 0.1 and th[0] < th[1]


def plain_features(text):
    """Hashed feature -> value."""
    words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    n = Counter()
    place = lambda b: xxhash.xxh3_64_intdigest(b) % ordinal.DIM
    for w in words:
        n[place(w.encode())] += 1
        for k in ordinal.PREFIXES:
            if len(w) + 1 > k:
                n[place(b"p" + f"^{w}"[:k].encode())] += 1
    out = defaultdict(float, {k: math.log1p(c) / math.log1p(len(words)) for k, c in n.items()})
    for d in ordinal.ECHOES:
        if len(words) > d:
            same = sum(a == b for a, b in zip(words, words[d:])) / (len(words) - d)
            for share in ordinal.ECHO_SHARES:
                if same >= share:
                    out[place(f"\0echo {d} {share}".encode())] += 1
    return out


def test_query_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = 0 if r.quality == 0 else 1 if r.toxic == 1 else 2
    feats = {d: plain_features(t) for d, t in docs}
    rated = [(d, labels[d]) for d, _ in docs if d in labels]
    low, top = Counter(), Counter()
    for d, g in rated:
        (top if g == 2 else low).update(list(feats[d]))
    n_top = sum(g == 2 for _, g in rated)
    n_low = len(rated) - n_top
    odds = {}
    for k in set(low) | set(top):
        r = math.log((low[k] + 0.3) / (n_low + 0.6)) - math.log((top[k] + 0.3) / (n_top + 0.6))
        if low[k] + top[k] >= 4 and abs(r) >= 0.5:
            odds[k] = abs(r)
    used = sorted(odds)
    x = np.array([[feats[d].get(k, 0.0) * odds[k] for k in used] for d, _ in rated])
    y = np.array([g for _, g in rated])
    # the same descent on dense rows in double precision
    w, th, m, v = np.zeros(len(used)), np.array([-2.0, -1.0]), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, ordinal.STEPS + 1):
        c = sig(th[None, :] - (x @ w)[:, None])
        ends = np.concatenate([np.zeros((len(y), 1)), c, np.ones((len(y), 1))], 1)
        i = np.arange(len(y))
        p = ends[i, y + 1] - ends[i, y]
        d_up, d_low = ends[i, y + 1] * (1 - ends[i, y + 1]) / p, ends[i, y] * (1 - ends[i, y]) / p
        g_th = np.array([(d_low[y == k + 1].sum() - d_up[y == k].sum()) / len(y) for k in range(2)])
        g = np.concatenate([x.T @ (d_up - d_low) / len(y) + ordinal.L2 * w, g_th])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = ordinal.RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, th = w - move[:-2], np.sort(th - move[-2:])
    weight = {k: a * odds[k] for k, a in zip(used, w)}
    got = {r.doc_id: r for r in registry.queries()["op8_quality_classifier"](spark, SF).collect()}
    assert got.keys() == feats.keys()
    for d, f in feats.items():
        tail = [1 - 1 / (1 + math.exp(-(c - sum(weight.get(k, 0.0) * a for k, a in f.items())))) for c in th]
        if not f:
            assert got[d].p_top is None and not got[d].kept
            continue
        assert abs(got[d].p_top - tail[1]) < 0.01 and abs(got[d].expected_grade - sum(tail)) < 0.02
        assert abs(tail[1] - ordinal.KEEP_FROM) < 0.01 or got[d].kept == (tail[1] >= ordinal.KEEP_FROM)


def test_repeated_rows_are_judged_alike(spark):
    rows = [(i, "good clean words of prose " * (1 + i % 3)) for i in range(20)] + [(100 + i, "junk ### $$$ junk ### " * (1 + i % 3)) for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    out = [(r.doc_id, r.text, r.p_top, r.kept) for r in ordinal.classify(docs, labels).collect()]
    assert len(out) == 45 and all(len({x[2:] for x in out if x[:2] == r}) == 1 for r in rows[:3])
    assert {x[3] for x in out if x[0] is not None and x[0] < 100 and x[1]} == {True} and {x[3] for x in out if x[0] is not None and x[0] >= 100} == {False}
