import hashlib
import math

import numpy as np
import pytest

from quillspark.llm import clusters, queries

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string"


def brute(rows, k=16, dim=64, scale=64, rounds=3):
    """Lloyd's rounds with Python integers; ``rows`` are (vec_id, embedding)."""
    kept = []
    for v, e in rows:
        if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e):
            kept.append((v, [max(-clusters.LIMIT, min(clusters.LIMIT, math.floor(scale * float(c)))) for c in e]))
    name = lambda v: hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest()
    centroids = [x for v, x in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            mine = [x for (_, x), (_, k) in zip(kept, of) if k == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    of, by = assign(), {}
    for d, c in of:
        by[c] = by.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(v, c, d, by[c], sum(by.values()), sha[c]) for (v, _), (d, c) in zip(kept, of)], key=str)


def got(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op11_centroid_clusters(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("k,rounds", [(1, 2), (2, 3), (5, 6), (6, 3), (40, 5)])
def test_bounds_are_exact(spark, k, rounds):
    rng = np.random.default_rng(k)
    # Small numbers make ties between centroids and equal vectors.
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 4)]) for i in range(300)] + [(i, [float(c) for c in rng.normal(size=4) * 10.0 ** rng.integers(-3, 6)]) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(clusters.cluster(df, k, 4, 1, rounds)) == brute(rows, k, 4, 1, rounds)


def test_most_vectors_are_certified_without_a_scan():
    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (32, 8))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-5, 6, (4000, 8))
    held = clusters.Bounds(x, centres).begin()
    after = centres + rng.integers(-2, 3, centres.shape)
    drift = np.sqrt(((after - centres) ** 2).sum(1)) * (1 + clusters.MARGIN)
    scanned = []

    class Counting(clusters.Bounds):
        def scan(self, rows):
            scanned.append(len(rows))
            super().scan(rows)

    moved = Counting(x, after).resume(held.cluster, held.upper, held.others, held.lowers, held.rest, drift)
    moved.assign()
    d = ((x[:, None] - after[None]) ** 2).sum(2)
    assert (moved.cluster == d.argmin(1)).all()
    assert sum(scanned) < 400
    # Bounds hold after the round.
    root = np.sqrt(d)
    every = np.arange(len(x))
    assert (moved.upper >= root[every, moved.cluster]).all() and (moved.lowers <= np.take_along_axis(root, moved.others, 1)).all()
    rest = root.copy()
    rest[every, moved.cluster] = np.inf
    np.put_along_axis(rest, moved.others, np.inf, 1)
    assert (moved.rest <= rest.min(1)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * j) % 7 - 3) / 4 for j in range(64)], 9, "a") for i in range(30)]
    odd = [(100, None, 1, None), (101, [], 1, ""), (102, [1.0] * 63, 1, ""), (103, [1.0] * 65, 1, ""), (104, [None] + [1.0] * 63, 1, ""), (105, [nan] + [1.0] * 63, 1, ""), (106, [-inf] + [1.0] * 63, 1, "")]
    ties = [good[3], good[3], (3, [0.25] * 64, 0, ""), (None, [0.5] * 64, 0, ""), (None, [0.5] * 64, 0, ""), (200, [3e38] + [-3e38] * 63, 0, "")]
    rows = good + odd + ties
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(clusters.cluster(df)) == brute([r[:2] for r in rows])
    assert got(clusters.cluster(spark.createDataFrame(good[:3], SCHEMA))) == brute([r[:2] for r in good[:3]])
    assert clusters.cluster(df.limit(0)).collect() == [] and clusters.cluster(spark.createDataFrame(odd, SCHEMA)).collect() == []
    same = spark.createDataFrame([good[5]] * 20, SCHEMA)
    assert got(clusters.cluster(same)) == brute([good[5][:2]] * 20)
    with pytest.raises(ValueError):
        clusters.cluster(df, k=1 << 20)
