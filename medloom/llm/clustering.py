"""Centroid clustering by Orchard search, in exact integers.

Each centroid has the list of the others, nearest first. A vector starts at one
centroid and goes through its list; as soon as a centroid is closer (or as close, with a
smaller number), it becomes the current one and its list is gone through from the start.
Centroids that were met are marked and not measured again. The search stops at the first
entry that lies strictly beyond twice the current distance: by the triangle inequality
neither it nor any later one can be closer, or as close.

Vectors never move. A round sends one row of sums from each task and cluster; the lists
are as large as the square of the number of centroids, which is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, packed, quoted, unpacked

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Four times the squared distance of up to 1,024 components within this fits a long; beyond, Python's integers take over.
SAFE = 1 << 24
RESULT = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
_LONG = 1 << 63


def scaled_vector(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs, held at the ends of a long; null unless there are ``dims`` components, none of them null or non-finite."""
    whole = vector.cast("array<double>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ends = lambda x: F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18))
    return F.when((F.size(whole) == dims) & F.forall(whole, good), F.transform(whole, lambda x: F.floor(ends(x)).cast("long")))


class OrchardIndex:
    """Sorted neighbour lists of centroids, and the search of many vectors side by side."""

    def __init__(self, centroids: list[list[int]]):
        biggest = max((abs(x) for c in centroids for x in c), default=0)
        self.exact = biggest > SAFE
        self.centroids = np.array(centroids, dtype=object if self.exact else np.int64)
        k = len(centroids)
        away = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in centroids] for x in centroids]
        self.lists = np.array([sorted((s for s in range(k) if s != c), key=lambda s, c=c: (away[c][s], s)) for c in range(k)], dtype=np.int64).reshape(k, max(k - 1, 0))
        # Squared distances along each list; four times the current squared distance is twice the distance.
        self.beyond = np.array([[away[c][s] for s in self.lists[c]] for c in range(k)], dtype=self.centroids.dtype).reshape(k, max(k - 1, 0))

    def _squared(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = vectors - self.centroids[numbers]
        return (gap * gap).sum(axis=1)

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
        n, k = len(vectors), len(self.centroids)
        if self.exact or n and (np.abs(vectors) > SAFE).any():
            vectors = vectors.astype(object)
        current, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        best = self._squared(vectors, current)
        met = np.zeros((n, k), dtype=bool)
        met[:, 0] = True
        going = np.arange(n) if k > 1 else np.arange(0)
        while len(going):
            c, step = current[going], at[going]
            # Strictly beyond: a centroid at just twice the distance can be as close.
            inside = (self.beyond[c, step] <= 4 * best[going]).astype(bool)
            going, c, step = going[inside], c[inside], step[inside]
            at[going] = step + 1
            other = self.lists[c, step]
            new = ~met[going, other]
            rows, other = going[new], other[new]
            met[rows, other] = True
            found = self._squared(vectors[rows], other)
            closer = ((found < best[rows]) | (found == best[rows]) & (other < current[rows])).astype(bool)
            jump = rows[closer]
            current[jump], best[jump], at[jump] = other[closer], found[closer], 0
            going = going[at[going] < k - 1]
        return current, best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_batches(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, k = OrchardIndex(centroids), len(centroids)
        counts, sums = [0] * k, [[0] * len(c) for c in centroids]
        for batch in batches:
            vectors = _matrix(batch.column(0))
            cluster, _ = index.search(vectors)
            if (np.abs(vectors) > SAFE).any():
                vectors = vectors.astype(object)
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                counts[c] += len(own)
                sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0))]
        some = [c for c in range(k) if counts[c]]
        decimal = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([counts[c] for c in some], pa.int64()), pa.array([[Decimal(x) for x in sums[c]] for c in some], pa.list_(decimal))],
            names=["cluster", "n", "sums"],
        )

    return run


def _assign_batches(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = OrchardIndex(centroids)
        for batch in batches:
            cluster, distance = index.search(_matrix(batch.column(1)))
            held = [int(d) if d < _LONG else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())], names=[USER, "cluster", "distance"])

    return run


def fit(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after ``rounds`` of assigning every row of ``vectors`` (v) and taking exact floors of the means.

    An empty cluster keeps its centroid. If a round changes nothing no later one would,
    and none is run. What comes to the driver is a count and a sum of each cluster.
    """
    dims = len(centroids[0]) if centroids else 0
    kind = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])
    for _ in range(rounds if centroids else 0):
        parts = vectors.select("v").mapInArrow(_sum_batches(centroids), kind)
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums")).collect()
        moved = list(centroids)
        for r in totals:
            moved[r.cluster] = [int(x) // r.n for x in r.sums]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def first_centroids(docs: DataFrame, id_col: str, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors v of the ``k`` rows with the smallest sha256 of ``seed:id``; rows without an id come last, ties go by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(quoted(id_col)).cast("string")), 256)
    return [list(r.v) for r in docs.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()]


def cluster_vectors(
    docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` with a whole vector, with their columns and cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector without exactly ``dims`` components, or with a null or non-finite one, goes. A
    row is a vector: one that repeats counts again, and equal vectors get the same
    cluster. Rows with a null id are clustered, but come last as first centroids. With
    fewer rows than ``k`` there are fewer clusters; an empty table gives an empty result.
    Scaled components are held at the ends of a long; a distance or inertia beyond a
    long is null. Columns named like the results are replaced, others may have any name.
    No text is read, so its length does not matter.
    """
    scratch = Scratch(docs.sparkSession, "clusters")
    scaled = scaled_vector(F.col(quoted(vector_col)), dims, scale)
    thin = scratch.keep(docs.select(F.col(quoted(id_col)).alias("id"), scaled.alias("v")).where("v IS NOT NULL"))
    centroids = fit(thin, first_centroids(thin, "id", k, seed), rounds)
    scratch.drop(thin)

    rows = packed(docs, scaled.alias("v")).where("v IS NOT NULL")
    kind = T.StructType([rows.schema[USER], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = scratch.keep(rows.mapInArrow(_assign_batches(centroids), kind))
    whole = lambda x: F.when(F.count(F.lit(1)) == F.count(x), F.sum(x.cast("decimal(38,0)")))
    sums = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(whole(F.col("distance")).alias("inertia")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    held = lambda x: None if x is None or x >= _LONG else int(x)
    text = [",".join(map(str, c)) for c in centroids]
    table = docs.sparkSession.createDataFrame([(c, held(sums.get(c)), held(total), text[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, text string")
    # One row for each centroid.
    table = F.broadcast(table.select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256")))
    out = assigned.join(table, "cluster").select(USER, *RESULT)
    return unpacked(out, [c for c in docs.columns if c.lower() not in RESULT], *RESULT)
