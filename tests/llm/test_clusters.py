import hashlib
import math
import random

import numpy as np
import pytest

from casegate.llm import clusters
from casegate.llm.queries import op13_clusters

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(vectors, k=8, rounds=10, size=64):
    """Exhaustive rounds in whole numbers."""
    kept = []
    for key, vector in vectors:
        if vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(1024 * x) for x in vector]))
    hashed = lambda key: hashlib.sha256(f"3:{'' if key is None else key}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        near = [min((far(v, c), i) for i, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for i in range(len(centroids)):
                members = [v for (_, v), (_, j) in zip(kept, near, strict=True) if i == j]
                if members:
                    centroids[i] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    spread = [sum(d for d, j in near if j == i) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((key, j, d, spread[j], sum(spread), digests[j]) for (key, _), (d, j) in zip(kept, near, strict=True)), key=str)


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>")


def rows(spark, folder):
    return sorted((tuple(r) for r in op13_clusters(spark, str(folder)).select(*COLUMNS).collect()), key=str)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert rows(spark, folder) == brute(vectors)


def test_edge_cases(spark, tmp_path):
    rng = random.Random(3)
    point = lambda spread: [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]
    vectors = [(i, point(0.2)) for i in range(120)]
    same = point(0.2)
    vectors += [(i, same) for i in range(200, 260)] + [(260, same), (260, same), (None, point(1)), (None, None), (261, []), (262, same[:63])]
    vectors += [(263, [*same[:63], None]), (264, [*same[:63], float("nan")]), (265, [*same[:63], float("inf")]), (266, [0.0] * 64), (267, [-1e-9] * 64)]
    vectors += [(268, [50_000.0] * 64), (269, [-50_000.0] * 64)]
    df = frame(spark, vectors).selectExpr("*", "'clash' id", "'clash' v", "1 cluster", "2 upper", "3 distance").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = brute([(k, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for k, v in vectors])
    assert rows(spark, tmp_path) == wanted


@pytest.mark.parametrize("count", [0, 1, 5])
def test_few_vectors(spark, tmp_path, count):
    vectors = [(i, [float((i * j) % 7) for j in range(64)]) for i in range(count)]
    frame(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(spark, tmp_path) == brute(vectors)


def test_too_large_components_are_refused(spark):
    df = frame(spark, [(1, [200_000.0] * 64)])
    with pytest.raises(Exception, match="131072 or more"):
        clusters.lattice(df, df["vec_id"], df["embedding"]).collect()


def test_exact_distances_of_large_components():
    rng = np.random.default_rng(4)
    vectors, centroids = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in vectors]
    assert clusters.squared(vectors, centroids).tolist() == wanted


def test_loosening_holds_and_saves():
    """No vector of a sphere comes nearer than the bound says, and the bounds spare most of the scans."""
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-3000, 3000, (4, 6))
        new = old + rng.integers(-400, 400, (4, 6))
        radius = rng.uniform(1, 3000, 4)
        move = clusters.Move.between(old, new, radius)
        tighter += np.count_nonzero(move.loosened < 0.9 * max(move.drift))
        for i in range(4):
            ways = rng.normal(size=(400, 6))
            sphere = old[i] + ways / np.linalg.norm(ways, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.1
            for j in range(4):
                if i != j:
                    nearer = np.linalg.norm(sphere - old[j], axis=1) - np.linalg.norm(sphere - new[j], axis=1)
                    assert nearer.max() <= move.loosened[i] + 1e-9
    assert tighter > 200


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(9)
    blobs = [(i, (rng.normal(0, 0.05, 64) + 3 * (np.arange(64) % 8 == i % 8)).tolist()) for i in range(800)]
    df = frame(spark, blobs)
    found = clusters.cluster(clusters.lattice(df, df["vec_id"], df["embedding"]))
    assert found.measured[0] == 800 and sum(found.measured[1:]) < 0.5 * 800 * (len(found.measured) - 1)
