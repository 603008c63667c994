import pytest

from factloom.llm.substring_dedup import COVERS, remove_repeated_passages
from tests.llm import brute, texts


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_words int").repartition(5)
    df = df.withColumn("place", df.n_words)
    out = {r.place: (r.text, r.n_words, r.n_removed) for r in remove_repeated_passages(df, bits=20, **more).collect()}
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


@pytest.mark.parametrize("seed,period", [(1, 21), (2, 31)])
def test_same_as_brute_force(spark, seed, period):
    rows = texts.corpus(120, seed=seed) + texts.ODD
    expected = brute.substring_dedup(rows)
    assert sum(e[2] for e in expected) > 500
    assert run(spark, rows, period=period) == expected


def test_short_window_and_small_filter(spark):
    rows = texts.corpus(80, seed=4, vocabulary=6)
    assert run(spark, rows, size=12, period=7) == brute.substring_dedup(rows, 12)


def test_empty_table(spark):
    out = remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string"), bits=16)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"] and out.collect() == []
