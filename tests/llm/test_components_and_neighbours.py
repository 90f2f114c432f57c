import random

import numpy as np
from pyspark.sql import functions as F

from hybridrank.llm.components import counted_links, group_records, star_components
from hybridrank.llm.neighbours import hilbert_key, nearest

VEC = "ids string, vectors array<float>, cls int, row string"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(90)]
    pairs += [("hub", f"leaf{i}") for i in range(300)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    df = spark.createDataFrame([(*p, 1) for p in pairs + pairs[:40] + [(b, a) for a, b in pairs[:40]]], "a string, b string, high int")
    got = {r["member"]: r["head"] for r in star_components(df, "a", "b").collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_components_with_hot_nodes(spark, monkeypatch):
    from hybridrank.llm import components as C

    monkeypatch.setattr(C, "HOT_LEAST", 5)
    rng = random.Random(9)
    pairs = [("m", f"leaf{i}") for i in range(200)] + [(f"z{rng.randint(0, 40)}", f"z{rng.randint(0, 40)}") for _ in range(60)] + [("leaf3", "a")]
    got = {r["member"]: r["head"] for r in star_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_components_edges(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("x", "x"), (None, None)], "a string, b string")
    assert star_components(df, "a", "b").count() == 0
    assert star_components(df.limit(0), "a", "b").count() == 0
    long = "z" * 100_000
    assert star_components(spark.createDataFrame([(long, "a")], "a string, b string"), "a", "b").first()["member"] == long
    records = spark.createDataFrame([("k1", 1), ("k2", 2), (None, 3), ("k1", 4)], "key string, head int")
    got = group_records(records, "key", spark.createDataFrame([("k2", "k1")], "a string, b string"), "a", "b").collect()
    assert sorted((r["head"], r["group_id"]) for r in got) == [(1, "k1"), (2, "k1"), (3, None), (4, "k1")]


def test_counted_links(spark):
    df = spark.createDataFrame([(" a ", "b", " SAME "), ("a", "c", "same_topic"), ("", "c", "same"), ("a", None, "same"), ("a", "d", None)], "a string, b string, relation string")
    assert [(r["a"], r["b"]) for r in counted_links(df).collect()] == [("a", "b")]


def test_hilbert_curve_is_a_path():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_key(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 12)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != x), key=lambda j: (-s[x, j], ids[j]))[:k]] for x, i in enumerate(ids)}


def found(df, **kw):
    out = {}
    for r in nearest(df, "ids", "vectors", dims=8, **kw).collect():
        out.setdefault(r["key"], {})[r["rank"]] = r["neighbour"]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_recall_with_small_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    rows = [(f"v{i:04d}", (centres[i % 60] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC)
    truth, got = brute(rows, 5), found(df, window=128, curve_dims=6)
    hits = sum(len(set(truth[i]) & set(got[i])) for i in truth)
    assert hits / (5 * len(rows)) >= 0.95 and all(len(v) == 5 for v in got.values())


def test_recall_in_a_dense_cluster_of_many_windows(spark):
    rng = np.random.default_rng(5)
    dense = np.array([1.0] + [0.0] * 7) + 0.001 * rng.normal(size=(1200, 8))
    rows = [(f"v{i:04d}", v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([dense, rng.normal(size=(300, 8))]))]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC)
    truth, got = brute(rows, 5), found(df, window=128)
    hits = sum(len(set(truth[i]) & set(got[i])) for i in truth)
    assert hits / (5 * len(rows)) >= 0.95 and all(len(v) == 5 for v in got.values())


def test_unusable_copies_ties_and_few(spark):
    nan, same = float("nan"), [1.0] + [0.0] * 7
    rows = [(f"s{i}", same) for i in range(12)] + [("t", [0.9, 0.1] + [0.0] * 6), ("u", [0.9, 0.1] + [0.0] * 6)]
    bad = [("b1", None), ("b2", [0.0] * 8), ("b3", [nan] + same[1:]), ("b4", same[:7]), (None, same), ("b5", [float("inf")] + same[1:]), ("b6", [None] + same[1:])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + rows[:5] + bad], VEC)
    assert found(df) == brute(rows, 5)
    two = spark.createDataFrame([("a", same, 0, "x"), ("b", [0.0] + same[:7], 0, "x")], VEC)
    assert found(two) == {"a": ["b"], "b": ["a"]}
    assert nearest(two.limit(0), "ids", "vectors", dims=8).count() == 0
    assert nearest(two.where(F.col("ids") == "a"), "ids", "vectors", dims=8).count() == 0
