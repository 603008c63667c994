"""Vectors of several lengths in one table: each length is compared by itself."""

import numpy as np

from factloom.llm.neighbours import nearest
from factloom.llm.vector_dedup import near_duplicates


def test_links_inside_every_length(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for size, n in ((64, 30), (48, 7), (5, 4), (2, 3), (1, 2)):
        base = rng.normal(0, 1, size)
        first = len(rows)
        rows += [(first + k, [float(x) for x in base * (k + 1)], 1) for k in range(n)]
        want |= {first + k: (n - 1, first, k == 0) for k in range(n)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()} == want


def test_neighbours_of_every_length(spark):
    """A length with a learned partition and shorter ones without: each query finds rows of its length."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 16 if k < 600 else 6 if k < 640 else 3)]) for k in range(650)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in nearest(df, df.where("vec_id % 10 = 0"), top=5, part_rows=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(found) == list(range(0, 650, 10))
    share = []
    for i, got in found.items():
        same = [(-float(np.dot(v, rows[i][1])), j) for j, v in rows if j != i and len(v) == len(rows[i][1])]
        want = [j for _, j in sorted(same)[:5]]
        if i < 600:
            share.append(len(set(got) & set(want)) / 5)
        else:
            assert got == want
    assert np.mean(share) >= 0.9
