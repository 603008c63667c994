import hashlib
import math
import random

from factloom.llm.centroids import cluster

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, size, clusters, rounds, scale=64, seed="1"):
    """Rows as ``cluster`` gives them, in plain Python."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))][:clusters]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((gap(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, group in groups.items():
            centres[k] = [sum(x) // len(group) for x in zip(*group)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    of = lambda k: sum(d for _, d, c in found if c == k)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, k, d, of(k), total, sha(centres[k])) for i, d, k in found), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_same_as_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.uniform(-0.3, 0.3) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.5] * 4), (None, [0.5] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5)]
    rows += [(904, [1.0, None, 1.0, 1.0]), (905, [float("nan")] * 4), (906, [float("inf"), 0.0, 0.0, 0.0]), (907, [0.0] * 4), (908, [-1e-9] * 4)]
    rows += [(1000 + i, [2.0, 2.0, -2.0, 0.015625 * (i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    df = df.selectExpr("*", "'x' AS cluster", "'y' AS distance", "'z' AS _v", "1 AS _id")
    assert got(cluster(df, size=4, clusters=6)) == brute(rows, 4, 6, 3)
    assert got(cluster(df, size=4, clusters=6, rounds=0, scale=3, seed="s")) == brute(rows, 4, 6, 0, 3, "s")


def test_ties_and_centroids_without_vectors(spark):
    rows = [(i, [float(i % 2)]) for i in range(40)]
    assert got(cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), size=1, clusters=16)) == brute(rows, 1, 16, 3)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(5, [1.0, -0.01])], "vec_id int, embedding array<float>")
    out = cluster(one, size=2)
    assert got(out) == brute([(5, [1.0, -0.01])], 2, 16, 3) and dict(out.dtypes)["vec_id"] == "int"
    none = cluster(one.limit(0), size=2)
    assert none.collect() == [] and none.dtypes == out.dtypes


def test_vast_components_do_not_fail(spark):
    rows = [(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [3e7, 0.0])]
    found = {r.vec_id: r for r in cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=2, clusters=1).collect()}
    assert len(found) == 3 and all(r.distance >= 0 and r.inertia is not None for r in found.values())
