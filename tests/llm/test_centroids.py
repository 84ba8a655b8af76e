import hashlib
import random

import numpy as np
import pytest

from corpusflow.llm import centroids as C


def nearest(points, v):
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, p, strict=True)), i) for i, p in enumerate(points))


@pytest.mark.parametrize("k,dims,spread,leaf", [(1, 3, 5, 1), (2, 2, 2, 1), (8, 4, 3, 2), (40, 2, 6, 1), (200, 3, 1000, 4), (60, 64, 2**26, 2)])
def test_tree_finds_the_nearest_with_ties(k, dims, spread, leaf):
    rng = np.random.default_rng(k)
    points = rng.integers(-spread, spread, (k, dims))  # small spreads: many equal points and equal distances
    vectors = np.concatenate([rng.integers(-spread, spread, (300, dims)), points])
    which, best = C.VantageTree(points, leaf).nearest(vectors)
    assert list(zip(best.tolist(), which.tolist(), strict=True)) == [nearest(points, v) for v in vectors]


def test_tree_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    points, looked = rng.integers(-10_000, 10_000, (500, 2)), []
    true = C.squares
    tree = C.VantageTree(points)
    monkeypatch.setattr(C, "squares", lambda v, p: looked.append(len(v)) or true(v, p))
    tree.nearest(rng.integers(-10_000, 10_000, (1_000, 2)))
    assert sum(looked) < 1_000 * 60  # of 500 points


def brute(rows, k, rounds, seed, dims, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)[:k]
    centroids = [p for _, p in first]
    for _ in range(rounds):
        near = [nearest(centroids, p)[1] for _, p in kept]
        for c in range(len(centroids)):
            own = [p for n, (_, p) in zip(near, kept, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted([(str(i), nearest(centroids, p)[1], nearest(centroids, p)[0]) for i, p in kept]), centroids


@pytest.mark.parametrize("k,rounds", [(1, 1), (5, 4), (100, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(60)]
    rows += [(70, None), (71, []), (72, [0.1] * 3), (73, [0.1, None, 0.2, 0.3]), (74, [float("nan")] * 4), (75, [float("-inf")] * 4)]
    rows += [(76, [0.0] * 4), (76, [0.0] * 4), (76, [0.5] * 4), (None, [0.25] * 4), (77, [-0.0001] * 4)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, point int").repartition(3)
    found, centroids = C.clustered(df, k, rounds, 3, 4, 1024)
    want, points = brute(rows, k, rounds, 3, 4, 1024)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.tolist() == points


def test_hard_tables(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, None)], "vec_id long, embedding array<float>")
    found, centroids = C.clustered(df.limit(0), 8, 2, 3, 4, 1024)
    assert found.count() == 0 and found.columns == ["id", "cluster", "distance"] and len(centroids) == 0
    found, centroids = C.clustered(df, 8, 2, 3, 4, 1024)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0)] and centroids.tolist() == [[1024] * 4]
    big = spark.createDataFrame([(1, [3e30] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exact 64-bit"):
        C.clustered(big, 8, 2, 3, 4, 1024)


def test_query_of_an_empty_table(spark, tmp_path):
    from corpusflow.llm import queries

    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["op12_centroids"](spark, str(tmp_path)).count() == 0
