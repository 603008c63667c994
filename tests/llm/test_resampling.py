import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from factloom.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    w = WORD.findall((text or "").encode().lower().decode())
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, most=1, buckets=10_000, seed="2024", percent=10, least=20):
    number = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(number(f) for _, text in docs for f in features(text, most)[1])
    t = Counter(number(f) for text in target for f in features(text, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = features(text, most)
        weight = sum(gain[number(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus():
    words = [f"W{i % 7}x{i % 5}é" for i in range(60)]
    docs = [(i, "\n".join(" ".join(words[(i * j) % 50 : (i * j) % 50 + 3 + j % 4]) for j in range(1 + i % 9)) + ("" if i % 3 else "\n\nThe same LINE\nthe same line")) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "\n \n"), (503, "one"), (504, "big-" * 40_000), (505, "a\nb\nc\nd\ne " * 30), (505, "a\nb\nc\nd\ne " * 30), (505, "z y " * 20)]
    docs += [(None, "no id here " * 10)] * 30 + [(None, None)]
    return docs, ["W1x1É w2x2é the same line", "one two\nthree", None, "", "a b c"]


@pytest.mark.parametrize("most,percent", [(1, 10), (3, 40), (2, 100), (1, 0)])
def test_same_as_brute_force(spark, most, percent):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "'r' AS rank", "'w' AS weight", "1 AS _gain", "2 AS _words", "3 AS n")
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, percent=percent, buckets=1000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, most, 1000, percent=percent)


def test_empty_tables(spark):
    docs, target = corpus()
    df = spark.createDataFrame(docs[:40], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resample(df, none.select("text"), buckets=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs[:40], [], buckets=100)
    out = resample(none, spark.createDataFrame([(t,) for t in target], "text string"))
    assert out.collect() == [] and [k for _, k in out.dtypes] == ["bigint"] * 5


def test_hot_score_is_dealt_out(spark):
    """Rows that agree in every column take consecutive ranks."""
    docs = [(None, "the very same words " * 6)] * 400 + [(i, "others " * 25) for i in range(100)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), spark.createDataFrame([("same words",)], "text string"), percent=50, buckets=100)
    ranks = sorted(r.rank for r in got.collect() if r.rank is not None)
    assert ranks == list(range(1, 251))
