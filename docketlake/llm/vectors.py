"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.common import Scratch, lean, sized_broadcast, table
from docketlake.llm.graph import components

SEED = 17
#: Vectors of a bucket, about: parts of a hash are added until there are so many buckets. At most ``MOST_PARTS`` parts.
PER_BUCKET, MOST_PARTS = 8, 8
#: Other buckets that a vector is put into, per part of the hash, and coordinates of a part that come into question.
PROBES, RANKS = 2, 4
#: Chance that a pair exactly at the least cosine meets in a bucket; pairs by which the rate of a table is simulated.
RECALL, SIMULATED = 0.9999, 4000
#: Signs of a vector's sketch, and by how many of them a pair that is compared may differ beyond what is expected, in
#: standard deviations.
SIGNS, DEVIATIONS = 128, 6.0
#: Rows of a bucket that are compared in one task; larger buckets are compared by pairs of parts.
UNIT = 256
#: Up to so many large buckets are broadcast (about 5 MB).
BROADCAST_BUCKETS = 50_000
#: Pairs whose products are taken at once, and numbers that are rotated at once: both bound a task's memory.
PAIRS, NUMBERS = 20_000, 1 << 20
#: Cosines so near the least one are taken again by sums without rounding.
CLOSE = 1e-9


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform. Sums and differences are taken one by one, so a vector gives
    the same numbers in whatever batch."""
    n, size = x.shape
    for s in signs:
        x, h = x * s, 1
        while h < size:
            y = x.reshape(n, -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
            h *= 2
    return x * size**-1.5


class Hashes:
    """``tables`` hashes of vectors of ``dim`` components; each is of ``parts`` cross-polytope hashes."""

    def __init__(self, dim: int, parts: int, tables: int, probes: int | None = None, seed: int = SEED):
        self.dim, self.parts, self.tables = dim, parts, tables
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.ranks = min(RANKS, self.size)
        # buckets beside the nearest: those where at most two parts take a later coordinate
        near = set()
        for a, b in itertools.combinations_with_replacement(range(parts), 2):
            for x, y in itertools.product(range(self.ranks), repeat=2):
                near.add(tuple(x if k == a else y if k == b else 0 for k in range(parts)))
        self.near = np.array(sorted(near))
        self.probes = min(PROBES * parts if probes is None else probes, len(near) - 1)
        r = np.random.default_rng([seed, dim])
        self.sketch_signs = r.choice([-1.0, 1.0], (-(-SIGNS // self.size), 3, self.size))
        self.signs = r.choice([-1.0, 1.0], (tables, parts, 3, self.size))

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : self.dim] = x
        return out

    def codes(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """(vectors, tables, 1 + probes): the nearest bucket of each table first, then the next by how much smaller
        their coordinates are."""
        upto = self.tables if upto is None else upto
        out = np.empty((len(x), upto, self.probes + 1), np.int64)
        step = max(1, NUMBERS // self.size)
        for lo in range(0, len(x), step):
            rows = self.padded(x[lo : lo + step])
            for t in range(upto):
                code = np.zeros((len(rows), len(self.near)), np.int64)
                lost = np.zeros(code.shape)
                for k in range(self.parts):
                    y = rotated(rows, self.signs[t, k])
                    best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : self.ranks]
                    v = np.take_along_axis(y, best, 1)
                    part, less = best * 2 + (v < 0), (np.abs(v[:, :1]) - np.abs(v)) ** 2
                    code = code * (2 * self.size) + part[:, self.near[:, k]]
                    lost += less[:, self.near[:, k]]
                pick = np.argsort(lost, axis=1, kind="stable")[:, : self.probes + 1]
                out[lo : lo + step, t] = np.take_along_axis(code, pick, 1)
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """``SIGNS`` signs of rotated coordinates as two longs."""
        rows = self.padded(x)
        bits = np.concatenate([rotated(rows, s) for s in self.sketch_signs], 1)[:, :SIGNS] > 0
        return np.packbits(bits, axis=1).view(np.int64)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of one table's codes: does one's nearest bucket stand among the other's."""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def parts_for(n: int, dim: int) -> int:
    """Parts of a hash that give ``n`` vectors enough buckets."""
    size, parts = 1 << max(1, (dim - 1).bit_length()), 1
    while (2 * size) ** parts * PER_BUCKET < n and parts < MOST_PARTS and (2 * size) ** (parts + 1) < 1 << 62:
        parts += 1
    return parts


def tables_for(dim: int, parts: int, least: float, recall: float = RECALL) -> int:
    """Tables that a pair at the cosine ``least`` takes to meet with the chance ``recall``. The chance of one table is
    simulated on random pairs, less three standard deviations."""
    if dim == 1:
        return 1
    r = np.random.default_rng(SEED)
    count = min(SIMULATED, max(200, 4_000_000 // dim))
    a, b = r.normal(size=(2, count, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = least * a + math.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1)[:, None]
    h = Hashes(dim, parts, 2, seed=SEED + 1)
    x, y = h.codes(a), h.codes(b)
    p = float(np.mean([met(x[:, t], y[:, t]) for t in range(2)]))
    p = min(max(p - 3 * math.sqrt(p * (1 - p) / (2 * count)), 0.01), 0.9999)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


SHAPE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])


def shaped(kind: type):
    """Of an array: a 128-bit key of its numbers, how many, and the numbers; nulls if it can't be compared."""

    @F.pandas_udf(SHAPE)
    def run(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for x in vectors:
            x = None if x is None else np.asarray(x, dtype=kind) + kind(0)  # one zero
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append((None, None, None))
            else:
                out.append((xxhash.xxh3_128_digest(x.tobytes()), len(x), x.tobytes()))
        return pd.DataFrame(out, columns=SHAPE.names)

    return run


def as_rows(values: pd.Series, kind: type) -> np.ndarray:
    """Numbers of vectors of one length as rows of length 1. The largest is taken out first, so that squares don't overflow."""
    x = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """By sums that are rounded once."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def pairs_within(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of rows of one unit, ``PAIRS`` at a time; rows of a unit stand together."""
    ends = np.searchsorted(unit, unit, "right")
    later = ends - np.arange(len(unit)) - 1  # rows of its unit that follow a row
    upto = np.cumsum(later)
    total = int(upto[-1]) if len(unit) else 0
    for lo in range(0, total, PAIRS):
        k = np.arange(lo, min(lo + PAIRS, total))
        i = np.searchsorted(upto, k, "right")
        yield i, i + 1 + k - (upto[i] - later[i])


def linked(b: pd.DataFrame, h: Hashes, least: float, kind: type) -> pd.DataFrame:
    """Links among rows (t, code, pa, pb, side, home, key, n, v) of whole units and vectors of one length. Gives for each
    row with links the vectors that it links to and an id that the linked rows share.

    A pair may meet in several buckets. It counts in the first table where it meets, there in the smaller bucket; the
    buckets of the few vectors with links are worked out again from their numbers.
    """
    x, home, side, n = as_rows(b["v"], kind), b["home"].to_numpy(), b["side"].to_numpy(), b["n"].to_numpy()
    t, code, key = b["t"].to_numpy(), b["code"].to_numpy(), b["key"].to_numpy()
    new = np.ones(len(b), bool)
    where = b[["t", "code", "pa", "pb"]].to_numpy()
    new[1:] = (where[1:] != where[:-1]).any(axis=1)
    parted = (b["pa"] != b["pb"]).to_numpy()
    found = []
    for i, j in pairs_within(np.cumsum(new)):
        ok = (home[i] | home[j]) & (~parted[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        c = np.einsum("ij,ij->i", x[i], x[j])
        near = c >= least - CLOSE
        for p in np.flatnonzero(near & (c < least + CLOSE)):
            near[p] = cosine(*(np.frombuffer(b["v"].iloc[q], kind).astype(np.float64) / np.abs(np.frombuffer(b["v"].iloc[q], kind)).max().astype(np.float64) for q in (i[p], j[p]))) >= least
        if near.any():
            found.append((i[near], j[near]))
    if not found:
        return pd.DataFrame({"key": np.array([], object), "n": np.array([], np.int64), "root": np.array([], object)})
    i, j = (np.concatenate(z) for z in zip(*found))
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    buckets = h.codes(x[used], int(t[used].max()) + 1)
    total, label = np.zeros(len(used), np.int64), np.arange(len(used))
    a, z = at[: len(i)], at[len(i) :]
    for lo in range(0, len(a), PAIRS):
        p, q, pt, here = a[lo : lo + PAIRS], z[lo : lo + PAIRS], t[i[lo : lo + PAIRS]], code[i[lo : lo + PAIRS]]
        first = np.ones(len(p), bool)
        for k in range(int(pt.max())):
            open_ = np.flatnonzero(first & (pt > k))
            first[open_] = ~met(buckets[p[open_], k], buckets[q[open_], k])
        own_p, own_q = buckets[p, pt, 0], buckets[q, pt, 0]
        in_p, in_q = (own_p[:, None] == buckets[q, pt]).any(1), (own_q[:, None] == buckets[p, pt]).any(1)
        first &= here == np.where(in_p & in_q, np.minimum(own_p, own_q), np.where(in_p, own_p, own_q))
        np.add.at(total, p[first], n[used[q[first]]])
        np.add.at(total, q[first], n[used[p[first]]])
    while True:  # the smallest row that a row is linked to, also over others
        before = label.copy()
        np.minimum.at(label, a, label[z])
        np.minimum.at(label, z, label[a])
        label = label[label]
        if (label == before).all():
            break
    return pd.DataFrame({"key": key[used], "n": total, "root": key[used[label]]})


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = 0.95, recall: float = RECALL, unit: int = UNIT) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows are linked where the cosine of their embeddings, in double precision, is ``least`` or more; each pair that shares a
    bucket is verified, so no pair below it is linked, and one exactly at it is found with the chance ``recall``, a
    nearer one with a higher chance. ``n_links`` counts the other rows that a row is linked to, ``component_id`` is the
    smallest vec_id reachable by links, ``kept`` marks that row.

    Equal embeddings are one vector of several rows. Embeddings that are null, empty or zero, or that hold a null or a
    number that is not finite, link with nothing; those of different lengths don't link with each other. Each row
    is a vector of its own: rows that repeat a vec_id with its embedding link with each other. Rows without a vec_id
    link with nothing, have no component and are not kept. Other columns are ignored; an empty table gives no
    rows.

    Buckets have about ``PER_BUCKET`` vectors whatever the number of vectors. Only vectors that have a likely partner in a
    bucket (their sketches of signs agree) are moved. Larger buckets are split and compared by pairs of parts, and
    rows with links are counted, not listed by pairs; so a group of m different near vectors costs its m * m / 2
    products, dealt over tasks, and m rows per bucket and part.
    """
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    numbers = F.col("embedding").cast(f"array<{'float' if kind is np.float32 else 'double'}>")
    rows = vectors.select("vec_id", shaped(kind)(numbers).alias("s")).select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("s.key")).alias("key"), "s.dim", "s.v")
    rows = scratch.put(rows, "rows")
    classes = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lo"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = scratch.put(classes, "classes")
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    widest = widest or 1
    parts = parts_for(n, widest)
    tables = tables_for(widest, parts, least, recall)
    found = links(classes, scratch, parts, tables, least, kind, unit)
    per = found.groupBy("key").agg(F.sum("n").alias("m"))
    joined = components(found.filter("root != key").select(F.col("root").alias("a"), F.col("key").alias("b")), scratch)
    low = classes.select(F.col("key").alias("id"), "lo")
    joined = joined.join(low, "id")
    smallest = joined.groupBy("component").agg(F.min("lo").alias("component_id"))
    joined = joined.join(smallest, "component").select(F.col("id").alias("key"), "component_id")
    labels = classes.select("key", "n", "lo").join(per, "key", "left").join(joined, "key", "left")
    labels = labels.select("key", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component_id", "lo").alias("component_id")).filter("n_links > 0")
    out = rows.select("vec_id", "key").join(labels, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _differ(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a}s0 ^ {b}s0) + bit_count({a}s1 ^ {b}s1)")


def links(classes: DataFrame, scratch: Scratch, parts: int, tables: int, least: float, kind: type, unit: int = UNIT) -> DataFrame:
    """(key, n, root) of ``classes`` (key, n, dim, v), several rows per key: the sum of ``n`` is how many rows of
    others a vector links to, and ``root`` is a vector that it is connected with."""
    hashes: dict[int, Hashes] = {}

    def of(dim: int) -> Hashes:
        if dim not in hashes:
            hashes.clear()  # one length at a time
            hashes[dim] = Hashes(dim, parts, tables)
        return hashes[dim]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby("dim", sort=False):
                h, x = of(int(dim)), as_rows(rows["v"], kind)
                s = h.sketch(x)
                yield pd.DataFrame({"key": rows["key"].to_numpy(), "dim": int(dim), "width": h.probes + 1, "codes": list(h.codes(x).reshape(len(x), -1)), "s0": s[:, 0], "s1": s[:, 1]})

    signed = scratch.put(classes.select("key", "dim", "v").mapInPandas(lean(sign), "key binary, dim int, width int, codes array<long>, s0 long, s1 long"), "signed")
    at = signed.select("key", "dim", "width", "s0", "s1", F.posexplode("codes").alias("p", "code"))
    at = at.select("key", "dim", "s0", "s1", "code", F.expr("p div width").cast("int").alias("t"), (F.col("p") % F.col("width") == 0).alias("home"))
    bucket = ["dim", "t", "code"]
    # large buckets are few: each has more than ``unit`` of the rows
    large = scratch.put(at.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > unit), "large")
    at = at.join(sized_broadcast(large, large.count(), BROADCAST_BUCKETS), bucket, "left")
    at = at.withColumn("m", F.coalesce(F.ceil(F.col("m") / unit), F.lit(1)).cast("int")).withColumn("side", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    at = at.withColumn("o", F.explode(F.when(F.col("m") > 1, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(F.lit(0)))))
    at = at.withColumn("pa", F.least("side", "o")).withColumn("pb", F.greatest("side", "o")).drop("m", "o")
    place = [*bucket, "pa", "pb"]
    a, b = (at.select(*[F.col(c).alias(x + c) for c in at.columns]) for x in ("a_", "b_"))
    angle = math.acos(least) / math.pi
    # coordinates of one rotation are not independent, but near enough for a bound of six deviations
    most = math.ceil(SIGNS * angle + DEVIATIONS * math.sqrt(SIGNS * angle * (1 - angle)))
    likely = F.expr("a_key != b_key and (a_home or b_home) and (a_pa = a_pb or a_side != b_side)") & (_differ("a_", "b_") <= most)
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in place]
    both = on[0]
    for c in on[1:]:
        both = both & c
    mine = a.join(b.select(*[f"b_{c}" for c in [*place, "key", "home", "side", "s0", "s1"]]), both & likely, "left_semi")
    mine = mine.select(*[F.col(f"a_{c}").alias(c) for c in [*place, "side", "home", "key"]])
    mine = mine.join(classes.select("key", "n", "v"), "key").repartition(*place).sortWithinPartitions(*place)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by unit; one may go on in the next batch."""
        rest: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for dim, of_dim in rows.groupby("dim", sort=False):
                yield linked(of_dim.reset_index(drop=True), of(int(dim)), least, kind)

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b[place].to_numpy() == b[place].iloc[-1].to_numpy()).all(axis=1)
            rest = b[last]
            if not last.all():
                yield from done(b[~last])
        if rest is not None:
            yield from done(rest)

    return scratch.put(mine.mapInPandas(lean(compare), "key binary, n long, root binary"), "links")


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.95, whatever their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


OP12_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS x FROM u UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT id, min(x) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id
"""
