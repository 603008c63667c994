"""The pipeline against plain Python, stage by stage, each on its own input."""

import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import quality_classifier
from factloom.llm.common import written
from factloom.llm.queries import WORDS, held_out
from tests.llm import brute
from tests.llm.test_mixing import targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]
    outs, inputs = {}, {}
    for name, stage in stages.items():
        inputs[name] = docs.collect()
        docs = written(stage(spark, docs, SF), "test")
        outs[name] = docs.collect()
        if name != "BPE encoding and decoding":
            assert docs.columns == columns
    key = lambda rows: Counter(tuple(r) for r in rows)

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out())
    source = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality_classifier.score(source, quality_classifier.train(source, labels))
    assert key(outs["quality classifier"]) == key(scored.where("score >= 0.5").select(columns).collect())
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in outs["quality classifier"]}
    assert sum((i in kept) == (q == 1) for i, q in truth.items()) >= 0.95 * len(truth)

    rows = inputs["line dedup"]
    plain = brute.line_dedup([(r.doc_id, r.text) for r in rows])
    want = [(r.doc_id, t, r.lang, r.source, len(t) if n else r.n_chars) for r, (t, _, n) in zip(rows, plain)]
    assert key(outs["line dedup"]) == Counter(want)

    rows = inputs["n-gram Jaccard join"]
    groups = brute.ngram_join([(r.doc_id, r.text) for r in rows])
    assert key(outs["n-gram Jaccard join"]) == key([r for r, (_, c) in zip(rows, groups) if c == r.doc_id])

    rows, got = inputs["mixing sources"], Counter(r.doc_id for r in outs["mixing sources"])
    size = {r.doc_id: len(brute.words(r.text)) for r in rows}
    totals, taken = Counter(), Counter()
    for r in rows:
        totals[r.source] += size[r.doc_id]
        taken[r.source] += got[r.doc_id] * size[r.doc_id]
    for s, t in targets(totals).items():
        assert got and abs(taken[s] - t) <= max(size[r.doc_id] for r in rows if r.source == s) / 2
    assert max(got.values()) <= 2 and {tuple(r) for r in outs["mixing sources"]} <= {tuple(r) for r in rows}

    tokenizer = Tokenizer.from_file(WORDS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in inputs["BPE encoding and decoding"]:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert key(outs["BPE encoding and decoding"]) == want
    assert key(corpus_pipeline.run(spark, SF).collect()) == want


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
