"""Centroid clustering against every vector with every centroid, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from medloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, user string, cluster string, `a.b` string"


def brute(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """(id, cluster, distance, cluster_inertia, inertia, digest) of the rows that are kept; null is what no long holds."""
    kept = [(r[0], [math.floor(scale * float(x)) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in final if c == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = lambda x: x if x < 2**63 else None
    return sorted((i is None, i or 0, c, held(d), held(inertia[c]), held(sum(inertia)), digest[c]) for i, c, d in final)


def plain(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(n=120, dims=64):
    rng = random.Random(8)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    vec = lambda c, w: [float(np.float32(x + rng.gauss(0, w))) for x in c]
    rows = [(k, vec(centres[k % 6], 0.2)) for k in range(n)]
    grid = [[float(x)] * dims for x in (0, 0, 1, 2, 2, 4, -1)]
    rows += [(1000 + k, v) for k, v in enumerate(grid)]
    # A third of all rows are the same vector, some under the same id.
    rows += [(2000 + k % 40, rows[3][1]) for k in range(n // 2)]
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [0.5] * (dims - 1) + [None], [math.nan] + [0.5] * (dims - 1), [math.inf] * dims, [-math.inf] + [0.0] * (dims - 1)]
    return rows + [(3000 + k, v) for k, v in enumerate(bad)] + [(None, vec(centres[0], 0.1)), (None, vec(centres[1], 0.1))]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "u", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def test_against_every_pair(spark):
    rows = vectors()
    got = clustering.cluster_vectors(table(spark, rows))
    assert got.columns == ["vec_id", "embedding", "label", "user", "a.b", *clustering.RESULT]
    assert plain(got) == brute(rows)


@pytest.mark.parametrize("k,rounds", [(1, 2), (20, 2), (500, 1)])
def test_numbers_of_centroids(spark, k, rounds):
    rows = vectors(60)
    assert plain(clustering.cluster_vectors(table(spark, rows), k=k, rounds=rounds)) == brute(rows, k, rounds)


def test_small_and_empty_tables(spark):
    assert clustering.cluster_vectors(table(spark, [])).count() == 0
    assert clustering.cluster_vectors(table(spark, [(1, None), (2, [1.0])])).count() == 0
    one = [(7, [0.25] * 64)]
    assert plain(clustering.cluster_vectors(table(spark, one))) == brute(one)


def test_large_components_are_exact(spark):
    """Beyond the safe range Python's integers are used; distances beyond a long are null."""
    rng = random.Random(2)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * 10 ** rng.choice([1, 5, 6]))) for _ in range(64)]) for k in range(40)]
    assert plain(clustering.cluster_vectors(table(spark, rows), rounds=3)) == brute(rows, rounds=3)
    far = clustering.cluster_vectors(table(spark, [*rows, (99, [3e38] * 64)]), k=2, rounds=1).collect()
    assert len(far) == 41 and any(r.distance is None or r.inertia is None for r in far)


def test_search_skips_and_stops():
    """The search gives what measuring all centroids gives, with ties, and measures fewer."""
    rng = np.random.default_rng(4)
    centroids = rng.integers(-5, 6, (60, 4)).tolist() + [[100 * k, 0, 0, 0] for k in range(1, 60)]
    index = clustering.OrchardIndex(centroids)
    queries = rng.integers(-6, 7, (400, 4))
    measured = []
    whole = index._squared
    index._squared = lambda v, c: (measured.append(len(v)), whole(v, c))[1]
    number, distance = index.search(queries)
    every = ((queries[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert sum(measured) < 0.6 * every.size
