"""k-means over integer vectors with Yinyang bounds: exact results from few distances.

Centroids are grouped once.  For each vector an upper bound of the distance to its own centroid and a lower bound for
each group are kept; after a round the bounds move by what centroids have moved.  A vector whose upper bound is below all
lower bounds keeps its centroid (global filter); of the others only groups that may be nearer are looked at (group filter),
and in them only centroids that may be (local filter), by exact integer distances.

Vectors lie in blocks, one row each, in a table that is written once, bucketed by block; each round writes only
clusters, bounds and sums of moved vectors, bucketed alike, so a round is a join without exchange."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, materialise, shared_dir, shuffle_partitions

#: Production parameters: centroids, rounds, groups of centroids, salt of the start.
K, ROUNDS, GROUPS, SALT = 8, 10, 3, "3:"
#: Components of a vector, scale to integers, greatest size of one, vectors of a block, blocks that go to Python at once.
DIM, SCALE, GREATEST, BLOCK, BATCH = 64, 1024, 1 << 27, 1024, 16
#: Bounds are doubles; they only count if they differ by more than this, relative and absolute.
SLACK = 1e-9

_BLOCKS = "block long, ids array<long>, x binary"
_STATE = "block long, cluster binary, upper binary, lower binary, sums array<long>, scanned long"


def integer_vectors(rows: DataFrame, vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, x: vectors of exactly dim components, none null or non-finite, as integers floor(1024 * component);
    these are held within +-2^27, so that a squared distance fits 64 bits."""
    c = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    near = lambda v: F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(GREATEST))), F.lit(-float(GREATEST)))
    kept = rows.where(F.coalesce((F.size(c) == dim) & F.forall(c, finite), F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(near(v)).cast("int")).alias("x"))


def start_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least hash of their id (fewer, if there are fewer), ties by components; vectors without an id come last."""
    chosen = vectors.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)), "x").limit(k)
    return np.array([r["x"] for r in chosen.select("x").collect()], np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of plain k-means over the centroids themselves."""
    c = centroids.astype(float)
    seeds = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)]
    for _ in range(5):
        of = ((c[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
        seeds = np.array([c[of == g].mean(0) if (of == g).any() else seeds[g] for g in range(len(seeds))])
    return np.unique(of, return_inverse=True)[1]


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c (one centroid, or one for each row)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _least_by_group(bounds: np.ndarray, of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Least bound of each group for each row, its own centroid left out."""
    b = bounds.copy()
    b[np.arange(len(b)), own] = np.inf
    return np.stack([b[:, of == g].min(1) for g in range(of.max() + 1)], axis=1)


def first_assignment(x: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower, distances computed."""
    d = np.stack([distance(x, c) for c in centroids], axis=1)
    cluster = d.argmin(1)
    root = np.sqrt(d.astype(float))
    return cluster, root[np.arange(len(x)), cluster], _least_by_group(root, of, cluster), d.size


def next_assignment(x: np.ndarray, centroids: np.ndarray, of: np.ndarray, moved: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved by `moved`, from the former result.  Ties go to the smaller number."""
    far = lambda u: u * (1 + SLACK) + SLACK
    most = np.array([moved[of == g].max() for g in range(of.max() + 1)])
    old, cluster, upper, lower = lower, cluster.copy(), upper + moved[cluster], lower - most
    at = np.flatnonzero(far(upper) >= lower.min(1))  # global filter
    if not len(at):
        return cluster, upper, lower, 0
    d_own = distance(x[at], centroids[cluster[at]])
    upper[at] = np.sqrt(d_own.astype(float))
    scanned, open_ = len(at), far(upper[at]) >= lower[at].min(1)  # once more, with the exact distance
    at, d_own = at[open_], d_own[open_]
    if not len(at):
        return cluster, upper, lower, scanned
    limit, own, xs, rows = far(upper[at]), cluster[at], x[at], np.arange(len(at))
    near = lower[at] <= limit[:, None]  # group filter
    d = np.full((len(at), len(centroids)), np.iinfo(np.int64).max)
    d[rows, own] = d_own
    bounds = old[at][:, of] - moved[None]
    for c in range(len(centroids)):
        go = np.flatnonzero(near[:, of[c]] & (own != c) & (bounds[:, c] <= limit))  # local filter
        d[go, c] = distance(xs[go], centroids[c])
        bounds[go, c] = np.sqrt(d[go, c].astype(float))
        scanned += len(go)
    bounds[rows, own] = upper[at]
    cluster[at] = d.argmin(1)
    upper[at] = np.sqrt(d[rows, cluster[at]].astype(float))
    seen = _least_by_group(bounds, of, cluster[at])
    without = lower[at]  # a group that wasn't looked at keeps its bound, but the centroid that was left may lie in it
    without[rows, of[own]] = np.where(cluster[at] != own, np.minimum(without[rows, of[own]], bounds[rows, own]), without[rows, of[own]])
    lower[at] = np.where(near, seen, without)
    return cluster, upper, lower, scanned


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, dim = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            x = np.asarray(part.column("x").flatten()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])
            n += 1


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[dict, np.ndarray]]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        yield row, np.frombuffer(row["x"].as_buffer(), np.int32).astype(np.int64).reshape(-1, dim)


def _assigned(row: dict, x: np.ndarray, centroids, of, moved):
    if moved is None:
        return None, first_assignment(x, centroids, of)
    cluster = np.frombuffer(row["cluster"].as_buffer(), np.int32).astype(np.int64)
    upper = np.frombuffer(row["upper"].as_buffer(), np.float64)
    return cluster, next_assignment(x, centroids, of, moved, cluster, upper, np.frombuffer(row["lower"].as_buffer(), np.float64).reshape(len(x), -1))


def _round(centroids: np.ndarray, of: np.ndarray, moved: np.ndarray | None):
    """Blocks (with their state, but for the first round) to states; sums: what each centroid's sum and count (last) gain."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, x in _rows(batch, dim):
                old, (cluster, upper, lower, scanned) = _assigned(row, x, centroids, of, moved)
                xs, sums = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1), np.zeros((k, dim + 1), np.int64)
                went = slice(None) if old is None else old != cluster
                for c in range(k):
                    sums[c] = xs[went][cluster[went] == c].sum(0)
                    if old is not None:
                        sums[c] -= xs[went][old[went] == c].sum(0)
                out.append((row["block"].as_py(), cluster.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), sums.ravel(), scanned))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _final(centroids: np.ndarray, of: np.ndarray, moved: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in _rows(batch, centroids.shape[1]):
                cluster = _assigned(row, x, centroids, of, moved)[1][0]
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(cluster.astype(np.int32)), pa.array(distance(x, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

    return run


class _Store:
    """Tables in the shared folder, bucketed by block."""

    def __init__(self, df: DataFrame):
        self.spark, self.buckets, self.names = df.sparkSession, shuffle_partitions(df.sparkSession), []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"yinyang_{uuid.uuid4().hex}"
        df.write.option("path", f"{shared_dir(self.spark)}/{name}").option("compression", "zstd").bucketBy(self.buckets, "block").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for n in self.names:
            self.spark.sql(f"drop table if exists {n}")


class Clustering:
    """What a run gives: assignments (vec_id, cluster, distance), final centroids, distances computed in each round."""

    def __init__(self, assignments: DataFrame, centroids: np.ndarray, scanned: list[int]):
        self.assignments, self.centroids, self.scanned = assignments, centroids, scanned


def yinyang(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS, salt: str = SALT) -> Clustering | None:
    """Clusters (vec_id, x: equally long integer arrays); None if there are no vectors.

    Each round assigns all vectors to the nearest centroid (ties: the smaller number) and moves every centroid that has vectors
    to the floor of their mean; at the end vectors are assigned once more.  Repeated rows are vectors of their own.
    When no centroid moves any more, further rounds would change nothing and are left out.  The driver holds centroids
    and their sums (k by components), nothing that grows with the vectors; sums are exact at any size."""
    centroids = start_centroids(vectors, k, salt)
    if not len(centroids):
        return None
    k, dim = centroids.shape
    of, spark, store = grouped(centroids, groups), vectors.sparkSession, _Store(vectors)
    sums, moved, state, scanned = [[0] * (dim + 1) for _ in range(k)], None, None, []
    with batch_rows(spark, BATCH):
        with batch_rows(spark, 10 * BLOCK):
            blocks = store.write(vectors.mapInArrow(_to_blocks, _BLOCKS).repartition(store.buckets, "block"))
        joined = lambda: blocks if state is None else blocks.join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")
        for _ in range(rounds):
            state = store.write(joined().drop("ids").mapInArrow(_round(centroids, of, moved), _STATE))
            gained = state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # k * (dim + 1) rows
            scanned.append(state.agg(F.sum("scanned")).first()[0])
            for r in gained:
                sums[r["i"] // (dim + 1)][r["i"] % (dim + 1)] += int(r["v"])
            after = np.array([[v // s[-1] for v in s[:-1]] if s[-1] else c.tolist() for s, c in zip(sums, centroids, strict=True)], np.int64)
            moved, centroids = np.sqrt(distance(after, centroids).astype(float)), after
            if not moved.any():
                break
        assignments = materialise(joined().mapInArrow(_final(centroids, of, moved), "vec_id long, cluster int, distance long"), "clusters")
    store.forget()
    return Clustering(assignments, centroids, scanned)


def cluster_report(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every kept row of (vec_id, embedding);
    no rows if none is kept.  Vectors of another length, with null or non-finite components, are left out; null ids are kept.
    Inertias over the greatest long are given as that."""
    schema, spark = "_c int, cluster_inertia long, inertia long, centroid_sha256 string", rows.sparkSession
    c = yinyang(integer_vectors(rows))
    if c is None:
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {schema}").drop("_c")
    sums = {r[0]: int(r[1]) for r in c.assignments.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    long = lambda x: min(x, 2**63 - 1)
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    per = [(i, long(sums.get(i, 0)), long(sum(sums.values())), digest(x)) for i, x in enumerate(c.centroids.tolist())]
    return c.assignments.join(F.broadcast(spark.createDataFrame(per, schema)), F.col("cluster") == F.col("_c")).drop("_c")
