"""One row of every group of near copies, where ids repeat or are null."""

import corpus_pipeline


def test_one_row_a_group(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [
        (1, text("a")), (1, text("a")), (2, text("a")), (1, text("a") + " end"),
        (None, text("b")), (None, text("b")), (None, text("c")), (9, text("c")), (9, text("d")), (8, text("d")),
        (9, text("e")), (None, "lone words"), (None, ""), (None, None), (9, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, df.repartition(3), "").collect()
    kept = sorted(((r.doc_id, (r.text or "")[:4]) for r in got), key=str)
    assert kept == sorted([(1, "a0 a"), (None, "b0 b"), (9, "c0 c"), (8, "d0 d"), (9, "e0 e"), (None, "lone"), (None, ""), (None, ""), (9, "")], key=str)
    assert got[0].__fields__ == df.columns
