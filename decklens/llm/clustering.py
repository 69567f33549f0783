"""Centroid clustering with heap-ordered bounds.

Exact Lloyd rounds that look only at vectors whose assignment may have changed. When a vector is
scanned, the gap between its distance to the second nearest and to the nearest centroid is kept. In
a round the gap of a vector of cluster c shrinks by no more than what c moved plus the most that any
other centroid moved; these drifts add up to one offset per cluster. A gap stored as gap + offset at
the time of the scan therefore expires when the cluster's offset reaches it, and stored keys of a
cluster never change: they are a heap whose smallest keys expire first.

The heaps are tables. Each round writes one run of the vectors it scanned, in the order of (cluster,
key), and a round pops from every earlier run the rows whose key lies between the former offset of
their cluster and the present one, a range that Parquet's statistics prune. Runs are never changed, so
a lost executor repeats its read. Only k centroids, their sums and counts pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens.llm.common import staged
from decklens.session import scratch_folder

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components beyond this have no squared distance in 64 bits (at the default scale and dimensions).
LARGEST = 65_536
#: Bounds are rounded to doubles; a gap counts as expired this share of the distances earlier.
MARGIN = 1e-9
#: Vectors that a task compares with the centroids at once.
TOGETHER = 8192


def points(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point) of the vectors that can be clustered: their components as integers floor(scale * x)."""
    fit = F.size("embedding") == dimensions
    small = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))
    rows = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & fit).filter(F.coalesce(small, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("point"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The points with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids by their points."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), "point").orderBy("h", "point").limit(clusters).collect()
    return np.array([r.point for r in rows], np.int64)


def _squared(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    return (block * block).sum(1)[:, None] - 2 * block @ centroids.T + (centroids * centroids).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for i in range(0, whole.num_rows, TOGETHER):
            b = whole.slice(i, TOGETHER)
            yield b, b.column("point").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)


def scanned(rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """A run: ``rows`` (vec_id, point, cluster) with the nearest centroid as cluster, the former one as
    before, and the key at which their gap expires, which is above the offset of the cluster."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in _blocks(batches):
            d = _squared(block, centroids)
            nearest = d.argmin(1)
            at = np.arange(len(d))
            upper = np.sqrt(d[at, nearest].astype(float))
            d[at, nearest] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(1).astype(float)) if len(centroids) > 1 else np.full(len(d), np.inf)
            own = offsets[nearest]
            key = np.maximum(lower - upper + own - MARGIN * (lower + upper + own + 1), np.nextafter(own, np.inf))
            if len(centroids) == 1:
                key = lower
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("point"), b.column("cluster"), pa.array(nearest.astype(np.int32)), pa.array(key)],
                ["vec_id", "point", "before", "cluster", "key"])

    vec_id = rows.schema["vec_id"].dataType.simpleString()
    run = rows.select("vec_id", "point", "cluster").mapInArrow(of, f"vec_id {vec_id}, point array<int>, before int, cluster int, key double")
    return run.sortWithinPartitions("cluster", "key")


def _expired(offsets: np.ndarray, former: np.ndarray) -> Column:
    """Rows whose keys the offsets have reached, and had not before."""
    ranges = [
        (F.col("cluster") == c) & (F.col("key") > a) & (F.col("key") <= b)
        for c, (a, b) in enumerate(zip(former.tolist(), offsets.tolist())) if a < b
    ]
    return reduce(Column.__or__, ranges, F.lit(False))


def _live(offsets: np.ndarray) -> Column:
    return reduce(Column.__or__, [(F.col("cluster") == c) & (F.col("key") > x) for c, x in enumerate(offsets.tolist())])


def _moved(run: DataFrame, clusters: int, dimensions: int) -> list:
    """(before, cluster, n, sums) of a run: its rows by former and present cluster (-1: none before), and their
    component sums. Tasks add up their own rows first; k (k + 1) rows reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((clusters + 1) * clusters, np.int64), np.zeros(((clusters + 1) * clusters, dimensions), np.int64)
        for b, block in _blocks(batches):
            pair = (b.column("before").fill_null(-1).to_numpy() + 1) * clusters + b.column("cluster").to_numpy()
            n += np.bincount(pair, minlength=len(n))
            for p in np.unique(pair):
                sums[p] += block[pair == p].sum(0)
        p = np.flatnonzero(n)
        lists = pa.array(sums[p].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p // clusters - 1, pa.int32()), pa.array(p % clusters, pa.int32()), pa.array(n[p]), lists], ["before", "cluster", "n", "sums"])

    parts = run.select("before", "cluster", "point").mapInArrow(of, "before int, cluster int, n long, sums array<long>")
    spread = parts.select("before", "cluster", "n", F.posexplode("sums").alias("i", "s"))
    whole = spread.groupBy("before", "cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return whole.groupBy("before", "cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums")).collect()


def fit(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, DataFrame, list[int]]:
    """Centroids after ``rounds`` rounds, (vec_id, point, cluster) by one more assignment, and the number of
    vectors scanned in each assignment. Rounds end early once no centroid moves, which changes nothing."""
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return centroids, kept.select("vec_id", "point", F.lit(0).alias("cluster")), []
    k, dimensions = centroids.shape
    offsets = former = np.zeros(k)
    sums, counts, popped = [[0] * dimensions for _ in range(k)], [0] * k, []
    spark, folder, heaps = kept.sparkSession, scratch_folder(kept.sparkSession), None
    for turn in range(rounds + 1):
        rows = kept.withColumn("cluster", F.lit(None).cast("int")) if heaps is None else heaps.filter(_expired(offsets, former))
        run = scanned(rows, centroids, offsets)
        run.write.parquet(f"{folder}/run={turn}")
        # All runs are one table: its scan packs small files together.
        heaps = spark.read.schema(T.StructType([*run.schema.fields, T.StructField("run", T.IntegerType())])).parquet(folder)
        changes = _moved(heaps.filter(F.col("run") == turn), k, dimensions)
        popped.append(sum(r.n for r in changes))
        if turn == rounds:
            break
        for r in changes:
            for c, sign in ((r.cluster, 1), (r.before, -1)):
                if c >= 0 and r.cluster != r.before:
                    counts[c] += sign * r.n
                    sums[c] = [s + sign * x for s, x in zip(sums[c], r.sums)]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
        moves = np.sqrt(((new - centroids) ** 2).sum(1).astype(float))
        centroids = new
        if not moves.any():
            break
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(k)])
        former, offsets = offsets, offsets + moves + others
    return centroids, heaps.filter(_live(offsets)).select("vec_id", "point", "cluster"), popped


def distances(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): squared distance to the own centroid."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in _blocks(batches):
            gaps = block - centroids[b.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array((gaps * gaps).sum(1))], ["vec_id", "cluster", "distance"])

    vec_id = assigned.schema["vec_id"].dataType.simpleString()
    return assigned.mapInArrow(of, f"vec_id {vec_id}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row per vector.

    Vectors that are null, of another length, or hold a null or non-finite component are left out, as
    are those with a component beyond LARGEST in size. Rows that repeat are vectors of their own, and a null id is
    kept (as a first centroid it ranks as the empty id). With fewer vectors than ``clusters``, each is
    a centroid; equal ones leave later centroids empty, and those stay. Distances that tie go to the
    smaller number. An inertia beyond 64 bits is null. Other columns are not read; an empty table gives
    an empty result.
    """
    centroids, assigned, _ = fit(points(vectors, dimensions, scale), clusters, rounds, seed)
    found = staged(distances(assigned, centroids))
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    whole = sum(int(r["sum"]) for r in each)
    fits = lambda n: n if n < 2**63 else None
    # One row per cluster.
    rows = [
        (r.cluster, fits(int(r["sum"])), fits(whole), centroids[r.cluster].tolist(), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
        for r in each
    ]
    totals = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
