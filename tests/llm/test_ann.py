import numpy as np
import pytest

from quillmill.llm.ann import Shards, grow_forest, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    clean = {i: np.array(v, float) for i, v, _ in rows}
    for q in queries:
        ranked = sorted(((-float(np.array(clean[q]) @ v), i) for i, v in clean.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in ranked]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16)), rng.normal(size=(1500, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(nearest(df, df.where("vec_id % 50 = 0"), k=10, leaf=32, least=600, budget=2400, probes=256, shard=500, block=32))
    exact = brute(rows, range(0, 3000, 50), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits / (10 * len(exact)) >= 0.9
    for q in exact:
        for i, s in got[q]:
            assert abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-9


def test_small_tables_are_exact(spark):
    same = [1.0, 0.0, 2.0]
    rows = [(i, same, 0) for i in range(0, 90, 3)] + [(100, [1.0, 1.0, 0.0], 0), (101, [0.0, 1.0, 0.0], 0), (100, [1.0, 1.0, 0.0], 0)]
    bad = [(200, None, 0), (201, [], 0), (202, [0.0, 0.0, 0.0], 0), (203, [1.0, None, 1.0], 0), (204, [float("nan"), 1.0, 1.0], 0), (205, [float("inf"), 1.0, 1.0], 0), (206, [1.0, 2.0], 0), (None, same, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    got = found(nearest(df, df.where("vec_id % 3 = 0 or vec_id >= 100"), k=20))
    exact = brute(rows, [r[0] for r in rows], 20)
    assert got == exact


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    assert found(nearest(df, df, k=20)) == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_forest_leaves_are_bounded():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    forest = grow_forest(x, 3, 20, 2)
    leaves = forest.leaf_of(x)
    assert leaves.shape == (500, 3)
    assert np.bincount(leaves.ravel()).max() <= 20
    same = grow_forest(np.ones((50, 4), np.float32), 2, 5, 2)
    assert same.leaves == 2


@pytest.mark.parametrize("scale", [1.0, 7.0])
def test_lengths_matter(spark, scale):
    rows = [(i, [float(np.cos(i)), float(np.sin(i)) * (1 + scale * (i % 3))], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = found(nearest(df, df, k=5))
    exact = brute(rows, range(60), 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exact.items()}


@pytest.mark.parametrize("n", [500, 2000, 5000])
def test_production_parameters_on_small_tables(spark, n):
    """Half of the vectors in clusters, half without near neighbours; every query has all its rows."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(20, 64))
    x = np.concatenate([centres[rng.integers(0, 20, n // 2)] + 0.3 * rng.normal(size=(n // 2, 64)), rng.normal(size=(n // 2, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(nearest(df, df.where("vec_id % 20 = 0"), k=20))
    exact = brute(rows, range(0, n, 20), 20)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(exact, 20)
    recalls = [len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) / 20 for q in exact]
    assert np.mean(recalls) >= (0.9 if n > 4096 else 1)


def test_floor_leaves_no_query_short(spark):
    x = np.random.default_rng(3).normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = found(nearest(df, df.where("vec_id % 30 = 0"), k=20, leaf=32, least=100, budget=100, probes=600))
    assert {len(v) for v in got.values()} == {20} and len(got) == 30


def test_passes_go_on_where_the_last_one_ended():
    x = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    forest = grow_forest(x, 2, 20, 2)
    np.add.at(forest.sizes, forest.leaf_of(x).ravel(), 1)
    margins = x[0] @ forest.normals.T - forest.cuts
    whole = forest.search(margins, 0, 500, np.inf)
    first = forest.search(margins, 0, 150, np.inf)
    assert forest.sizes[first].sum() >= 150 and first + forest.search(margins, 150, 500, np.inf) == whole
    near = forest.search(margins, 0, 500, 0.01)
    assert near == whole[: len(near)] and len(near) < len(whole)


def test_shards_are_bounded():
    sizes = np.array([3, 4, 25, 1, 0, 9, 2])
    shards = Shards.of(sizes, 10)
    assert shards.parts.tolist() == [1, 1, 3, 1, 1, 1, 1]
    load = np.zeros(20)
    for n, a, p in zip(sizes, shards.first, shards.parts):
        load[a : a + p] += n / p
    assert load.max() <= 10 and load.sum() == sizes.sum()


def test_queries_and_vectors_that_repeat(spark):
    """A hot vector, an id with two vectors, doubles, and queries that are no row."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(699, x[0].tolist(), 0), (698, x[698].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = found(nearest(df, df.where("vec_id % 20 = 0 and vec_id < 600"), k=20, leaf=16, least=200, budget=2000, probes=64, shard=40, block=4))
    for q, v in got.items():
        scores = {}
        for i, w, _ in rows:
            scores[i] = max(scores.get(i, -9e9), float(x[q] @ np.array(w)))
        exact = sorted((-s, i) for i, s in scores.items() if i != q)[:20]
        assert len(v) == 20 and len({i for i, _ in v} & {i for _, i in exact}) >= 18
        if 100 <= q < 400:
            assert [i for i, _ in v] == [i for _, i in exact]
