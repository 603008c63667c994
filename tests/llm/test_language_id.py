from collections import defaultdict
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id as L
from factloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


class Plain:
    """Prediction by partial matching with dictionaries and sets, one byte at a time."""

    def __init__(self, texts, order, least):
        self.order = order
        count = defaultdict(lambda: defaultdict(int))
        for text in texts:
            data = b"\n" * order + text.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    count[data[i - k : i]][data[i]] += 1
        self.count = {c: {s: n for s, n in after.items() if n >= least} for c, after in count.items()}
        self.count = {c: after for c, after in self.count.items() if after}

    def chance(self, context, symbol):
        chance, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            after = self.count.get(context[len(context) - k :] if k else b"", {})
            left = {s: n for s, n in after.items() if s not in gone}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return chance * left[symbol] / total
                chance *= len(left) / total
            gone |= set(after)
        return chance / (256 - len(gone))

    def bits(self, text):
        data = b"\n" * self.order + text.encode()
        return -sum(log2(self.chance(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


TEXTS = {
    "aa": ["the cat sat on the mat", "the dog ate the cat", "a cat and a dog", ""],
    "bb": ["die katze saß auf der matte", "der hund aß die katze", "été à la plage"],
    "cc": ["le chat dort", None],
}


def trees_of(spark, **more):
    rows = [(i, lang, text) for i, (lang, text) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    return L.train(spark.createDataFrame(rows, "doc_id int, lang string, text string"), **more)


@pytest.mark.parametrize("order,least", [(3, 1), (2, 2), (0, 1), (5, 1)])
def test_code_lengths_are_those_of_plain_matching(spark, order, least):
    trees = trees_of(spark, order=order, least=least)
    plain = {lang: Plain([t for t in ts if t], order, least) for lang, ts in TEXTS.items()}
    assert trees.languages == sorted(plain)
    texts = ["the cat", "katze ß", "zz\x00\x7f\U0001f600 qq", "\n\n", "a"]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = sum(trees.bits(keys).sum(0) for _, keys in L.grams(raw, np.array([0, len(raw)]), order, 3))
        assert np.allclose(got, [plain[lang].bits(text) for lang in trees.languages], rtol=1e-9)


def test_chances_of_all_bytes_add_up_to_one(spark):
    trees = trees_of(spark, order=3, least=1)
    for context in (b"the", b"at ", b"zzz", b"\n\n\n", b"\xc3\x9f "):
        high = sum(b << (8 * (3 - i)) for i, b in enumerate(context))
        keys = np.array([high + s for s in range(256)], np.uint64)
        assert np.allclose(np.exp2(-trees.bits(keys)).sum(0), 1.0)


def test_held_out_accuracy(spark):
    rows = QUERIES["op12_language_id"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    of = rows.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(of) > 300 and np.mean([r.lang == r.lang_pred for r in of]) > 0.99 and all(0 <= r.score <= 1 for r in of)


def test_odd_rows(spark):
    trees = trees_of(spark, least=1)
    rows = [(1, None), (2, ""), (3, "12 + 34 = ?!"), (4, "the cat " * 150_000), (5, "der hund"), (5, "der hund"), (None, "le chat"), (6, "ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS score", "7 AS lang_pred", "'k' AS _letters", "'t' AS _text")
    out = L.predict(docs, trees)
    assert out.columns == ["doc_id", "text", "_letters", "_text", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred, r._letters) for r in out.collect()]
    assert sorted(found, key=str) == sorted([(1, "und", "k"), (2, "und", "k"), (3, "und", "k"), (4, "aa", "k"), (5, "bb", "k"), (5, "bb", "k"), (None, "cc", "k"), (6, "bb", "k")], key=str)
    assert L.predict(docs.limit(0), trees).collect() == []


def test_bounds_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "y", None), (3, None, "fr"), (None, "zz", "en"), (None, "zz", "en")], "doc_id int, text string, lang string")
    none = L.train(docs.where(F.lit(False)))
    assert none.languages == [] and {(r.lang_pred, r.score) for r in L.predict(docs, none).collect()} == {("und", 0.0)}
    trees = L.train(docs, least=1)
    assert trees.languages == ["en", "fr"]
    assert {r.text: r.lang_pred for r in L.predict(docs, trees).collect()} == {"x": "en", "y": "fr", None: "und", "zz": "en"}
    few = trees_of(spark, least=1, most=60, sample=2, languages=2)
    assert few.languages == ["aa", "bb"] and sum(len(g) for g in few.grams) < 200
