import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import quality_classifier as Q
from factloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_quality_classifier"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labelled = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = [r.predicted == r.quality for r in labelled]
    assert len(right) > 80 and np.mean(right) > 0.97
    good = [r.score for r in labelled if r.quality == 1]
    bad = [r.score for r in labelled if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    for r in labelled:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objective agree, so the fitted model is the best one."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(0, 40, 6) + 40 * (k % 2) * (rng.random(6) < 0.6), 99)).astype(np.int32) for k in range(200)]
    good = np.arange(200) % 2 == 0
    weights = Q.fit(rows, good, rounds=400)
    n = 1 << Q.BITS
    count = [np.ones(n), np.ones(n)]
    for r, y in zip(rows, good):
        count[int(y)][r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    used = np.unique(np.concatenate(rows))
    w = weights[used] / ratio[used]
    x = np.array([np.isin(used, r) / np.sqrt(len(r)) for r in rows]) * ratio[used]
    margin = np.where(good, 1, -1) * (x @ w + weights[-1])
    objective = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - np.where(good, 1, -1) * (x @ w + b)).sum()
    best = objective(w, weights[-1])
    assert (margin > 0).mean() > 0.9
    for _ in range(200):
        assert objective(w + rng.normal(0, 0.02, len(w)), weights[-1] + rng.normal(0, 0.02)) > best - 1e-3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (2, "BAD!! WORDS!!", "b"), (3, None, "c"), (None, "", "d"), (2, "BAD!! WORDS!!", "b"), (4, "w " * 60_000, "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (9, 0), (4, 7)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).collect()
    by = {r.text: r for r in rows}
    assert len(rows) == 6 and by["good words here"].predicted == 1 and by["BAD!! WORDS!!"].predicted == 0
    assert by[None].score == by[""].score
    none = Q.train(docs, labels.where(F.lit(False)))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), none).collect() == []


def plain_features(text):
    """The n-grams of a text as tuples."""
    def shape(word):
        kinds = [b"0" if 48 <= c < 58 else b"A" if 65 <= c < 91 else b"a" if 97 <= c < 123 or c > 127 else bytes([c]) for c in word]
        return b"".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    out = {("word", x) for x in w} | {("words", x, y) for x, y in zip(w, w[1:])}
    out |= {("shape", shape(x)) for x in w} | {("shapes", shape(x), shape(y)) for x, y in zip(w, w[1:])}
    out |= {("share", 10 * len(set(w)) // max(1, len(w)))} | ({("again",)} if any(x == y for x, y in zip(w, w[1:])) else set())
    return out


def test_features_and_scores_against_plain_python(spark):
    """Texts share as many hashed n-grams as they share n-grams, and a score is the sum of their weights."""
    texts = ["The cat sat, the cat sat.", "the THE the the", "a1 b2 C3 d4!! a1", "é ß Ünder 12.5% 99", "one", "", None, "x " * 30, "Buy NOW!!! Buy NOW!!!"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found, plain = Q.features(batch, "text"), [plain_features(t) for t in texts]
    assert [len(f) for f in found] == [len(p) for p in plain]
    for f, p in zip(found, plain):
        assert [len(np.intersect1d(f, g)) for g in found] == [len(p & q) for q in plain]
    weights = np.random.default_rng(4).normal(0, 1, (1 << Q.BITS) + 1).astype(np.float32)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in Q.score(docs, weights).collect():
        f = found[r.doc_id].tolist()
        margin = sum(float(weights[k]) for k in f) / len(f) ** 0.5 + float(weights[-1])
        assert abs(r.score - 1 / (1 + np.exp(-Q.SLOPE * margin))) < 1e-9 and r.predicted == int(r.score >= 0.5)
