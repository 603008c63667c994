import numpy as np

from factloom.llm.vector_dedup import hadamard, near_duplicates
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(n=1500, size=64, seed=1):
    """Vectors of which many have neighbours just above and below the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k and rng.random() < 0.4:
            v = rows[rng.integers(0, k)][1]
            v = v / np.linalg.norm(v)
            noise = rng.normal(0, 1, size)
            noise -= (noise @ v) * v
            cos = rng.uniform(0.90, 1.0)
            v = cos * v + np.sqrt(1 - cos**2) * noise / np.linalg.norm(noise)
            rows.append((n - k, v * rng.uniform(0.5, 2), rows[-1][2] if rng.random() < 0.1 else None))
            rows[-1] = (rows[-1][0], rows[-1][1], int(rng.integers(0, 2)))
        else:
            rows.append((n - k, rng.normal(0, 1, size), int(rng.integers(0, 2))))
    return rows


def links(rows, least=0.93):
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    labels = np.array([y for _, _, y in rows])
    return [(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))) if labels[a] == labels[b]]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, [float(x) for x in v], y) for i, v, y in rows], SCHEMA).repartition(5)
    got = {r.vec_id: r for r in near_duplicates(df, **more).collect()}
    return [got[i] for i, _, _ in rows]


def test_recall_and_precision(spark):
    rows = planted()
    pairs = links(rows)
    assert len(pairs) > 150
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    got = run(spark, rows)
    found = np.array([r.n_links for r in got])
    assert (found <= degree).all() and found.sum() >= 0.97 * degree.sum()
    for r in got:
        assert r.kept == (r.vec_id == r.component_id)
    want = brute.components(len(rows), pairs, [i for i, _, _ in rows])
    assert np.mean([r.component_id == c for r, c in zip(got, want)]) > 0.97


def test_one_large_family(spark):
    """More near copies in a bucket than a block holds, and exact copies: every link counts once."""
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 64)
    rows = [(k, base + rng.normal(0, 0.02, 64), 1) for k in range(1250)] + [(5000 + k, base, 1) for k in range(250)] + [(9000 + k, base, 2) for k in range(3)]
    got = run(spark, rows)
    assert {r.n_links for r in got[:1500]} == {1499} and {r.component_id for r in got[:1500]} == {0}
    assert [(r.n_links, r.component_id, r.kept) for r in got[1500:]] == [(2, 9000, True), (2, 9000, False), (2, 9000, False)]


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(3, one, 1), (2, [2.0, 4.0, 6.0], 1), (4, one, None), (5, one, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [0.0] * 3, 1), (9, [1.0, None, 2.0], 1), (10, [float("nan"), 1.0, 1.0], 1), (11, [1.0], 1), (None, one, 1), (3, one, 1), (12, [1e-30, 2e-30, 3e-30], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS c", "3 AS code")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, None)]
    assert got == sorted([(2, 3, 2, True), (3, 3, 2, False), (3, 3, 2, False), (12, 3, 2, False), *alone], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_hadamard():
    x = np.random.default_rng(1).normal(0, 1, (5, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(hadamard(x), x @ h / 4)
