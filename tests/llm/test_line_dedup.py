from factloom.llm.line_dedup import drop_repeated_lines
from tests.llm import brute, texts


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_lines int").repartition(5)
    # The input's own n_lines is replaced; _row of each document travels as another column.
    df = df.withColumn("place", df.n_lines)
    out = {r.place: (r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(df, **more).collect()}
    return [out[k] for k in range(len(rows))]


def test_same_as_brute_force(spark):
    rows = texts.corpus(150)
    expected = brute.line_dedup(rows)
    assert sum(e[2] for e in expected) > 20
    assert run(spark, rows) == expected


def test_odd_rows(spark):
    line = "this line is in all of the documents"
    rows = [(1, line), (2, f"{line}\nmine"), (2, line), (None, line), (9, f" {line.upper()}\t\n\n{line}"), (None, None), (4, "")]
    assert run(spark, rows) == brute.line_dedup(rows)
    two = [(1, line), (1, line), (2, line), (None, line)]  # two distinct ids only
    assert [x[2] for x in run(spark, two)] == [0, 0, 0, 0]


def test_full_filter_changes_nothing(spark):
    rows = texts.corpus(80, seed=2)
    assert run(spark, rows, bits=9, probes=1) == brute.line_dedup(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"] and out.collect() == []
