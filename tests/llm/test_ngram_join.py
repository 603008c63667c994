import random

import pytest

from factloom.llm import ngram_join
from factloom.llm.components import components
from factloom.llm.ngram_join import jaccard_components
from tests.llm import brute, texts


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **{"bits": 16, **more}).collect()), key=str)


def expected(rows, **more):
    return sorted(((i, n, c) for (i, _), (n, c) in zip(rows, brute.ngram_join(rows, **more))), key=str)


@pytest.mark.parametrize("seed,bits", [(1, 16), (3, 8)])
def test_same_as_brute_force(spark, seed, bits):
    rows = texts.corpus(160, seed=seed) + texts.ODD
    want = expected(rows)
    assert sum(c is not None and c != i for i, _, c in want) > 20
    assert run(spark, rows, bits=bits) == want


def test_chains_of_near_copies(spark):
    """Each text is linked to the next only: components reach further than links."""
    rng = random.Random(5)
    rows, w = [], [f"c{k}" for k in range(60)]
    for i in range(40):
        rows.append((100 - i, " ".join(w)))
        w[rng.randrange(60)] = f"n{i}"
    for i in range(60):  # one family whose members are linked to its base, hardly to each other
        v = [f"b{k}" for k in range(200)]
        for k in rng.sample(range(200), 4):
            v[k] = f"e{i}-{k}"
        rows.append((1000 + i, " ".join(v)))
    want = expected(rows)
    assert run(spark, rows) == want


def test_regions_of_many_are_joined_in_blocks(spark, monkeypatch):
    """A family just below the threshold, with links here and there: no link is lost, and only links come out."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(11)
    rows = []
    for i in range(70):
        v = [f"b{k}" for k in range(120)]
        for k in rng.sample(range(120), 1 if i % 7 == 0 else 3):
            v[k] = f"e{rng.randrange(25)}"
        rows.append((i, " ".join(v)))
    rows += texts.corpus(60, seed=9)
    want = expected(rows)
    assert 5 < len({c for i, _, c in want if i is not None and i < 70}) < 70
    assert run(spark, rows) == want


def test_threshold_is_exact(spark):
    base = [f"t{k}" for k in range(13)]  # 9 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[:-2])), (4, " ".join(base[1:-2]))]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, percent=90) == expected(rows, percent=90)


def test_empty_table(spark):
    out = jaccard_components(spark.createDataFrame([], "doc_id long, text string, component_id int"), bits=12)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (500, 400)]
    want = brute.components(501, links, list(range(501)))
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: want[x] for x in {y for a, b in links if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
