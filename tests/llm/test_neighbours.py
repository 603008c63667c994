import numpy as np
import pytest

from factloom.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, top=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted((-float((v * q).sum()), j) for j, v in rows if j != i)
            out[i] = [(j, -s) for s, j in near[:top]]
    return out


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, 0) for i, v in rows], SCHEMA).repartition(5)
    out = {}
    for r in nearest(df, df.where(f"vec_id % {every} = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / max(1, len(want[i])) for i in want])


@pytest.mark.parametrize("clusters", [1, 30])
def test_recall(spark, clusters):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (clusters, 32))
    rows = [(k, centres[k % clusters] * 0.8 + rng.normal(0, 1, 32)) for k in range(4000)]
    want, got = brute(rows, 20), run(spark, rows, 20, part_rows=400)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for i in got:
        scores = dict(got[i])
        q = np.array(rows[i][1], np.float32).astype(float)
        for j, s in scores.items():
            assert abs(s - float((np.array(rows[j][1], np.float32).astype(float) * q).sum())) < 1e-9


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(run(spark, rows, 20, part_rows=100), brute(rows, 20)) >= 0.9


def test_ties_copies_and_few_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, 8)
    rows = [(k, v) for k in range(6000, 0, -1)]  # more copies than a block holds
    got = run(spark, rows, 2000)
    assert {i: [j for j, _ in n] for i, n in got.items()} == {i: [j for j in range(1, 23) if j != i][:20] for i in (2000, 4000, 6000)}
    few = [(k, rng.normal(0, 1, 8)) for k in range(7)]
    assert {i: [j for j, _ in n] for i, n in run(spark, few, 1).items()} == {i: [j for j, _ in n] for i, n in brute(few, 1).items()}
    assert run(spark, few[:1], 1) == {}


def test_odd_vectors(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (0, [1.0, 2.0]), (2, [-1.0, 0.0])],
        "vec_id long, embedding array<float>",
    ).selectExpr("*", "1 AS id", "2 AS part", "3 AS score")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, -1.0)]
    assert nearest(df.limit(0), df).collect() == []


@pytest.mark.parametrize("n,clusters", [(50_000, 1), (20_000, 300), (500, 1)])
def test_recall_with_the_parameters_in_use(spark, folder, n, clusters):
    """Tables beyond the sample, and a small one: the routing is measured on rows it was not fitted on."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    x = (rng.normal(0, 1, (clusters, 24))[np.arange(n) % clusters] + rng.normal(0, 1, (n, 24))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{folder}/v.parquet")
    df = spark.read.parquet(f"{folder}/v.parquet").repartition(8)
    step = n // 100
    found = nearest(df, df.where(f"vec_id % {step} = 0")).collect()
    asked = np.arange(0, n, step)
    near = x[asked].astype(float) @ x.T.astype(float)
    near[np.arange(len(asked)), asked] = -np.inf
    want = {int(i): set(np.argsort(-row, kind="stable")[:20].tolist()) for i, row in zip(asked, near)}
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert np.mean([len(got[i] & want[i]) / 20 for i in want]) >= 0.9
