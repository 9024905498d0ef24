"""Centroid clustering with adaptive lower bounds, exact over integer vectors.

Each vector keeps its centroid with an upper bound of the distance, its ``BOUNDS`` nearest other centroids with a lower bound each, and
one remainder bound that holds for all further centroids. When centroids move, each bound is moved by its centroid's drift, the remainder by the largest drift.
If the upper bound lies below all lower bounds, the centroid is certified to stay. Otherwise the exact distance to it tightens the upper bound; if that is
not enough, distances are taken in the stored order up to the first bound that certifies the rest, and if even the remainder bound does not, to all
centroids. So the assignment is exact, ties included: bounds are widened beyond rounding, and distances that are compared are integers.

State goes from round to round in a table of vectors and bounds; tasks take the centroids with them, ``k`` times ``dim`` integers whose
size is checked. Sums are exact integers, added up by task before they are shuffled.

Defined cases: vectors of another length, and with a null or non-finite component, are left out; components are scaled to floor(scale * x) and held
within +-2**26, so that all squared distances fit 64 bits; rows that share a vec_id are vectors of their own; a null vec_id is kept, its seed hash
is that of the empty id and it counts after all others; equal hashes go by components; with fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table

#: Lower bounds of single centroids that a vector keeps beside the remainder bound.
BOUNDS = 4
#: Bounds are widened by this relative margin whenever they are made or moved, far more than doubles lose by it.
MARGIN = 1e-12
LIMIT = 1 << 26
#: Centroids go to each task: so many numbers at most.
MAX_CENTROID_NUMBERS = 1 << 22
STATE = "vec_id long, x array<int>, cluster int, upper double, others array<int>, lowers array<double>, rest double"


def scaled(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and x: integer vectors of those that count."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    ok = (F.size("embedding") == dim) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, F.lit(float(LIMIT))), F.lit(-float(LIMIT))) * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull()).where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<vec_id>``, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(F.col("vec_id").isNull(), key, "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64)


def matrix(col: pa.Array, kind) -> np.ndarray:
    """A list column whose rows are equally long as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


class Bounds:
    """The bounds of a batch of vectors, and what is done to them in a round."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray):
        self.x, self.centroids, k = x, centroids, len(centroids)
        self.b = min(BOUNDS, k - 1)

    def begin(self) -> Bounds:
        n = len(self.x)
        self.cluster, self.upper, self.rest = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        self.others, self.lowers = np.zeros((n, self.b), np.int64), np.zeros((n, self.b))
        self.scan(np.arange(n))
        return self

    def scan(self, rows: np.ndarray) -> None:
        """All centroids, in the order of exact distance and number."""
        if not len(rows):
            return
        d = np.stack([self.row_distance(rows, np.full(len(rows), j)) for j in range(len(self.centroids))], 1)
        order = np.argsort(d, 1, kind="stable")
        near = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        self.cluster[rows], self.upper[rows] = order[:, 0], near[:, 0] * (1 + MARGIN)
        near *= 1 - MARGIN
        self.others[rows], self.lowers[rows] = order[:, 1 : self.b + 1], near[:, 1 : self.b + 1]
        self.rest[rows] = near[:, self.b + 1] if near.shape[1] > self.b + 1 else np.inf

    def row_distance(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.centroids[to]
        return np.einsum("ij,ij->i", d, d)

    def resume(self, cluster, upper, others, lowers, rest, drift: np.ndarray) -> Bounds:
        """Moves all bounds by the drift of their centroids."""
        self.cluster, self.others = cluster, others
        self.upper = (upper + drift[cluster]) * (1 + MARGIN)
        self.lowers = lowers - drift[others] - MARGIN * (np.abs(lowers) + drift[others])
        self.rest = rest - drift.max() * (1 + MARGIN) - MARGIN * np.where(np.isinf(rest), 0, np.abs(rest))
        return self

    def certain(self, low: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether all that ``low`` bounds is surely farther than the centroid."""
        return self.upper[rows] < low

    def assign(self) -> None:
        every = np.arange(len(self.x))
        # Bounds of all that lie at or behind place j of the order.
        behind = np.minimum.accumulate(np.concatenate([self.lowers, self.rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        open_ = every[~self.certain(behind[:, 0], every)]
        self.upper[open_] = np.sqrt(self.row_distance(open_, self.cluster[open_]).astype(float)) * (1 + MARGIN)
        left = open_[~self.certain(behind[open_, 0], open_)]
        for j in range(1, self.b + 1):
            # What lies behind place j is farther than the centroid, so the nearest is the centroid or one of the first j.
            done = self.certain(behind[left, j], left)
            self.reorder(left[done], j)
            left = left[~done]
        self.scan(left)

    def reorder(self, rows: np.ndarray, j: int) -> None:
        """Exact distances to the centroid and the first ``j`` others, which trade places by them; the other bounds stay."""
        if not len(rows):
            return
        ids = np.concatenate([self.cluster[rows, None], self.others[rows, :j]], 1)
        d = np.stack([self.row_distance(rows, ids[:, i]) for i in range(j + 1)], 1)
        order = np.lexsort((ids, d), axis=1)
        ids, near = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        self.cluster[rows], self.upper[rows] = ids[:, 0], near[:, 0] * (1 + MARGIN)
        self.others[rows, :j], self.lowers[rows, :j] = ids[:, 1:], near[:, 1:] * (1 - MARGIN)

    def batch(self, vec_id: pa.Array) -> pa.RecordBatch:
        def listed(a, kind):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()).cast(kind))

        columns = [vec_id, listed(self.x, pa.int32()), pa.array(self.cluster.astype(np.int32)), pa.array(self.upper), listed(self.others, pa.int32()), listed(self.lowers, pa.float64()), pa.array(self.rest)]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "others", "lowers", "rest"])


def start(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield Bounds(matrix(b.column("x"), np.int64), centroids).begin().batch(b.column("vec_id"))

    return vectors.mapInArrow(run, STATE)


def step(state: DataFrame, before: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The state after the centroids have moved."""
    drift = np.sqrt(((centroids - before) ** 2).sum(1).astype(float)) * (1 + MARGIN)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, held = b.num_rows, Bounds(matrix(b.column("x"), np.int64), centroids)
            held.resume(
                b.column("cluster").to_numpy().astype(np.int64),
                b.column("upper").to_numpy(),
                matrix(b.column("others"), np.int64) if held.b else np.zeros((n, 0), np.int64),
                matrix(b.column("lowers"), float) if held.b else np.zeros((n, 0)),
                b.column("rest").to_numpy(),
                drift,
            ).assign()
            yield held.batch(b.column("vec_id"))

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty ones stay."""
    k, dim = centroids.shape

    def run(batches):
        sums, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            of, x = b.column("cluster").to_numpy(), matrix(b.column("x"), np.int64)
            for c in np.unique(of):
                sums[c] += x[of == c].sum(0)
            count += np.bincount(of, minlength=k)
        some = np.flatnonzero(count)
        place = np.tile(np.arange(dim, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim).astype(np.int32)), pa.array(place), pa.array(sums[some].ravel()), pa.array(np.repeat(count[some], dim))], names=["cluster", "place", "s", "n"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, place int, s long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.place] = r.s // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    if k * dim > MAX_CENTROID_NUMBERS:
        raise ValueError("centroids are sent to every task: use fewer or shorter ones")
    spark = vectors.sparkSession
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = table(scaled(vectors, dim, scale), "vectors")
    centroids = seeds(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], result)
    state = table(start(kept, centroids), "clusters")
    for _ in range(rounds):
        after = moved(state, centroids)
        old, state = state, table(step(state, centroids, after), "clusters")
        release(old)
        centroids = after
    release(kept)

    def run(batches):
        for b in batches:
            of, x = b.column("cluster"), matrix(b.column("x"), np.int64)
            d = x - centroids[of.to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), of, pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    ended = state.select("vec_id", "cluster", "x").mapInArrow(run, "vec_id long, cluster int, distance long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r.cluster: r.s for r in ended.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    found = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ended.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
