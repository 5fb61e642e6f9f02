"""Merkle manifests against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketlake.llm import manifest
from docketlake.llm.common import Scratch


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Root, and for each leaf the digests left and right of its way, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    proofs = []
    for x in range(len(leaves)):
        way = []
        for nodes in levels[:-1]:
            run = nodes[x - x % fanout : x - x % fanout + fanout]
            way.append(("".join(run[: x % fanout]), "".join(run[x % fanout + 1 :])))
            x //= fanout
        proofs.append(way)
    return levels[-1][0], proofs


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for grp, key, leaf in rows:
        groups[grp].append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, over = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, over):
        for k, (x, way) in enumerate(zip(sorted(groups[g]), trees[g][1])):
            out.append((x[1] if x[0] else None, g, x[2], k, trees[g][0], root, tuple(a for a, _ in way + top), tuple(b for _, b in way + top)))
    return out


@pytest.mark.parametrize("fanout,levels", [(2, 10), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_against_a_plain_version(spark, fanout, levels):
    r = random.Random(fanout)
    rows = [(r.choice(["a", "a", "a", "b", "é", "z", "", None]), r.choice([None, *range(-50, 400)]), h([str(r.random())])) for _ in range(200)]
    rows += [("one", 1, h("x")), ("𐀀", 1, h("x")), ("￿", 1, h("x"))] + [("a", 7, h("same"))] * 5
    df = spark.createDataFrame(rows, "grp string, key long, leaf string").withColumn("n", F.concat(F.lit("c"), F.col("key").cast("string")))
    got = manifest.manifest(df, Scratch(spark, "t"), ("n",), fanout, levels).collect()
    assert all(x.n == (None if x.key is None else f"c{x.key}") for x in got)
    key = lambda x: tuple(map(str, x))
    want = sorted(plain_manifest(rows, fanout), key=key)
    assert sorted(((x.key, x.grp, x.leaf, x.position, x.subroot, x.root, tuple(x.before), tuple(x.after)) for x in got), key=key) == want


def test_small_tables(spark):
    run = lambda rows: manifest.manifest(spark.createDataFrame(rows, "grp string, key long, leaf string"), Scratch(spark, "t"))
    assert run([]).count() == 0
    one = run([(None, None, "x")]).select("*", manifest.folded(F.col("leaf")).alias("f"), manifest.proof_digest().alias("p")).first()
    assert (one.subroot, one.root, one.before, one.after, one.f, one.p) == ("x", "x", [], [], "x", h(""))
    two = run([("a", 1, "x"), ("b", 1, "y")]).collect()
    assert {(x.subroot, x.root, tuple(x.before), tuple(x.after)) for x in two} == {("x", h("xy"), ("",), ("y",)), ("y", h("xy"), ("x",), ("",))}
    assert run([("a", 1, "x")] * 3).select("root").distinct().collect()[0].root == h([h("xx"), h("x")])


def test_documents_are_checked_against_the_root(spark, tmp_path):
    r = random.Random(1)
    long = "très " * 300_000
    rows = [(i, r.choice([None, "", "x", "é\n", long if i == 5 else "text"]), r.choice(["de", "en", "en", None]), r.choice([None, "s", "web"]), r.choice([None, 0, 7, 2**63 - 1])) for i in range(120)]
    rows += [(None, "no id", "en", "s", 5), rows[14], rows[14], (14, "other", rows[14][2], "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("clash")).withColumn("i", F.lit(3))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op11_manifest(spark, str(tmp_path)).collect()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda d, n: h([value(d[0]), value(d[3]), value(d[2]), value(n), value(d[1])])
    want, bad = plain_manifest([(d[2], d[0], leaf_of(d, d[4])) for d in rows], 2), {}
    for d in rows:
        if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0:
            bad[leaf_of(d, d[4])] = leaf_of(d, d[4] + 1)
    rows_want = []
    for key, _, leaf, _, subroot, root, before, after in want:
        at = bad.get(leaf, leaf)
        for a, b in zip(before, after):
            at = h([a, at, b])
        rows_want.append((key, leaf, subroot, root, h(a + b for a, b in zip(before, after)), at, at == root))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(rows_want, key=key) and 0 < sum(not x.verified for x in got) == sum(leaf in bad for _, _, leaf, *_ in want)
